"""Chat formatting with spans found by incremental black-box rendering.

A template is any callable from a list of (role, text) turns to a string. locate() renders the
prefixes of 1, 2, ... turns and compares consecutive outputs: if each output begins with the one
before, what was added is the span of the new turn; if not, the template rewrites history and
has no such spans. Nothing is assumed about how the template works.

A conversation longer than WINDOW turns is rendered window by window, so that time isn't quadratic in
its length. That is exact if rendering is additive, which is checked at every border: all turns so far,
rendered together, must equal the windows' renderings joined. Where they don't (a template that begins with
something once, numbers turns or cuts old ones), the window's prefixes are rendered from the conversation's start,
as those of short conversations are; only a template whose outputs aren't prefixes of each other rewrites history.

marked(), the template of the table operators, is additive by its make: with it, windows are streamed and checked
against their neighbour only.

Rows are hash-partitioned by conversation, sorted by turn and streamed, so that a conversation
of any length passes through one task without being held there; its digests are updated window
by window.

Cases: null role and text count as empty; turns that tie are ordered by role, then text;
repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table
gives no rows; control strings within texts are escaped reversibly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns of a conversation whose prefixes are rendered from its start; longer ones go by windows of this length.
WINDOW = 512

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """A control string begins with <| ; a backslash goes between, one more where there are some already."""
    return _ESCAPE.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def _role(role: str) -> str:
    """A role in one line: backslashes are doubled and line feeds named."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n") if "\\" in role or "\n" in role else role)


def _unrole(role: str) -> str:
    role = unescape(role)
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", role) if "\\" in role else role


def marked(turns: list[Turn]) -> str:
    """The template in use: every turn between marks, its control strings escaped."""
    return "".join([f"<|im_start|>{_role(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns])


def read(formatted: str) -> list[Turn]:
    """The turns of marked() output."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text between turns at {at}")
        at = m.end()
        out.append((_unrole(m[1]), unescape(m[2])))
    if at != len(formatted):
        raise ValueError(f"an unfinished turn at {at}")
    return out


@dataclass
class Located:
    formatted: str
    #: where each turn's output ends; None if the template rewrites history
    ends: list[int] | None


def locate(template: Template, turns: list[Turn], done: int = 0, before: str = "") -> Located:
    """Renders the prefixes beyond the first `done` turns, whose output is `before`."""
    ends = []
    for n in range(done + 1, len(turns) + 1):
        now = template(turns[:n])
        if not now.startswith(before):
            return Located(template(turns), None)
        ends.append(len(now))
        before = now
    return Located(before, ends)


def windows(template: Template, turns: Iterator[Turn], size: int = WINDOW) -> Iterator[tuple[list[Turn], Located]]:
    """Turns, output and spans (within that output) window by window, for any template: keeps the turns of
    the conversation. From the first prefix that rewrites history, spans are None and a window's output is that of its turns alone."""
    every: list[Turn] = []
    before, rewrites = "", False
    while window := list(islice(turns, size)):
        done = len(every)
        every += window
        found = locate(template, window)
        if not rewrites and done:
            now = template(every)
            if found.ends is None or now != before + found.formatted:
                true = locate(template, every, done, before)
                rewrites = true.ends is None
                if not rewrites:
                    found = Located(now[len(before) :], [end - len(before) for end in true.ends])
            before = now
        else:
            before, rewrites = found.formatted, rewrites or found.ends is None
        yield window, Located(found.formatted, None) if rewrites else found


def streamed(template: Template, turns: Iterator[Turn], size: int = WINDOW) -> Iterator[tuple[list[Turn], Located]]:
    """As windows(), for a template that renders each turn alone: keeps two windows, and fails if they show that it isn't so."""
    last: tuple[list[Turn], Located] | None = None
    while window := list(islice(turns, size)):
        found = locate(template, window)
        if found.ends is None or last is not None and template(last[0] + window) != last[1].formatted + found.formatted:
            raise ValueError("the template doesn't render each turn alone")
        yield window, found
        last = window, found


def loss_text(turns: list[Turn], found: Located, template: Template = marked) -> Iterator[str]:
    """What the loss mask covers: in each assistant turn's span, the text between the header and the end mark."""
    start = 0
    for (role, text), end in zip(turns, found.ends or []):
        if role == "assistant":
            span = found.formatted[start:end]
            head = span.index("\n") + 1
            yield span[head : len(span) - len("<|im_end|>\n")]
        start = end


def mask(turns: list[Turn], template: Template = marked) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the [start, end) intervals under the loss mask: the assistant texts, still escaped."""
    found = locate(template, turns)
    if found.ends is None:
        raise ValueError("the template rewrites history: turns have no spans")
    out, start = [], 0
    for (role, _), end in zip(turns, found.ends):
        if role == "assistant":
            out.append((found.formatted.index("\n", start) + 1, end - len("<|im_end|>\n")))
        start = end
    return found.formatted, out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text."""
    common.prepare(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            n = loss_chars = formatted_chars = 0
            turns_hash, loss_hash = sha256(), sha256()
            for turns, found in streamed(marked, (r[1:] for r in rows)):
                formatted_chars += len(found.formatted)
                back = read(found.formatted)
                n += len(back)
                turns_hash.update("".join([f"{r}\n{t}\n" for r, t in back]).encode("utf-8"))
                for text in loss_text(back, found):
                    text = unescape(text)
                    loss_chars += len(text)
                    loss_hash.update(text.encode("utf-8"))
            out.append((conv, n, turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), formatted_chars, False))
            if len(out) >= common.BATCH_ROWS:
                yield _batch(out, key)
                out = []
        if out:
            yield _batch(out, key)

    key, kind = _key(conversations)
    return _ordered(conversations).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


def _key(conversations: DataFrame) -> tuple[pa.DataType, str]:
    """The type of conv_id, for Arrow and for Spark."""
    kind = conversations.schema["conv_id"].dataType
    return to_arrow_type(kind), kind.simpleString()


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted text of each conversation and the intervals under the loss mask, one row per window of turns.

    Columns: conv_id, part (0 for all but very long conversations), formatted, loss_spans (array of start, end).
    """
    common.prepare(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            for part, (turns, _) in enumerate(streamed(marked, (r[1:] for r in rows))):
                text, spans = mask(turns)
                yield pa.RecordBatch.from_arrays([pa.array([conv], key), pa.array([part], pa.int32()), pa.array([text], pa.string()), pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "part", "formatted", "loss_spans"])

    key, kind = _key(conversations)
    return _ordered(conversations).mapInArrow(run, f"conv_id {kind}, part int, formatted string, loss_spans array<struct<start:long,end:long>>")
