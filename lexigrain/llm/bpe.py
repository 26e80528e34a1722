"""BPE encoding and decoding with a published vocabulary of words that carry an end-of-word mark.

encode merges by a priority queue of merge ranks over a doubly linked list of symbols: the
queue holds one entry per adjacent pair that has a rank; an entry whose symbols have changed
since it was pushed is stale and skipped. decode joins the vocabulary strings of the ids.

Splitting at white space first is exact: no match of the pre-tokeniser, no special token and no
canonical composition spans white space. Distinct words are therefore encoded once and kept in a
bounded dictionary of the worker. Those of some texts that it lacks are encoded together: one
search of the pre-tokeniser over all of them, and merges of all their short pieces at a time, each
by the lowest rank and of equal ones the leftmost, as the queue does for one piece.

Cases: null text counts as empty; empty or blank text gives 0 ids and the hash of the empty
string; special tokens within a text become their ids, as in the library; repeated rows give
repeated rows; texts are never cut.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Distinct words, and pieces, that a worker keeps; beyond it, the dictionary starts anew.
KEEP = 200_000
#: Characters of the texts whose words are encoded together; a longer text is taken alone.
CHUNK = 2_000_000
#: Bytes of the pieces that are merged together, the longest first of each width; longer pieces have a queue of their own.
WIDTHS = (4, 8, 12, 16, 24, 32)
#: Pieces that are merged together at most.
TOGETHER = 50_000

_WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(f"[{_WHITE}]+")
_PIECE = regex.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
#: _PIECE for lower-case ASCII.
_PLAIN = re.compile(r"[a-z]+|\n|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")
#: str.split also breaks at these, the vocabulary's pre-tokeniser doesn't.
_ODD = regex.compile("[\x1c-\x1f]")


#: Code points that the regex module has as letters or numbers and the library's older Unicode doesn't.
_NEW = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
#: Letters that the library lower-cases and this Python doesn't yet: ranges, and what is added to them.
_LOWERS = "1c89-1c89+1 a7cb-a7cb-42343 a7cc-a7cc+1 a7ce-a7ce+1 a7d2-a7d2+1 a7d4-a7d4+1 a7da-a7da+1 a7dc-a7dc-42561 10d50-10d65+32 16ea0-16eb8+27"


def _spans(text: str) -> Iterator[tuple[int, int, int]]:
    for m in re.finditer(r"([0-9a-f]+)(?:-([0-9a-f]+))?([+-]\d+)?", text):
        yield int(m[1], 16), int(m[2] or m[1], 16), int(m[3] or 0)


_NEW_CLASS = "".join(rf"\U{a:08x}-\U{z:08x}" for a, z, _ in _spans(_NEW))
_ANY_NEW = regex.compile(f"[{_NEW_CLASS}]")
#: _PIECE with these as symbols.
_OLDER = regex.compile(rf"(?V1)\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_NEW_CLASS}]]+|[\p{{N}}--[{_NEW_CLASS}]]|[[^{_WHITE}\p{{L}}\p{{N}}][{_NEW_CLASS}]]+")
_LOWER = {c: c + d for a, z, d in _spans(_LOWERS) for c in range(a, z + 1)}
_ANY_LOWER = regex.compile("[" + "".join(rf"\U{a:08x}-\U{z:08x}" for a, z, _ in _spans(_LOWERS)) + "]")


def byte_alphabet() -> list[str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.specials.items()}
        self.alphabet = byte_alphabet()
        self.inner = [self.ids.get(c) for c in self.alphabet]
        self.final = [self.ids.get(c + self.suffix) for c in self.alphabet]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(self.ids[a] << 20 | self.ids[b], (rank, self.ids[a + b]))
        self._tables()
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def _tables(self) -> None:
        """Merges as arrays: sorted pairs with ranks, new symbols by rank, and ranks by pairs of bytes (final ones from 256 on, 512: none)."""
        pairs = sorted(self.merges)
        self._pairs = np.array(pairs, np.int64)
        self._ranks = np.array([self.merges[p][0] for p in pairs], np.int32)
        self._none = np.int32(np.iinfo(np.int32).max)
        self._new = np.zeros(int(self._ranks.max(initial=-1)) + 1, np.int32)
        self._new[self._ranks] = [self.merges[p][1] for p in pairs]
        symbols = [-1 if i is None else i for i in (*self.inner, *self.final, None)]
        self._symbols = np.array(symbols, np.int32)
        place = {s: k for k, s in enumerate(symbols) if s >= 0}
        self._bytes = np.full((513, 513), self._none, np.int32)
        for p, (rank, _) in self.merges.items():
            if (a := place.get(p >> 20)) is not None and (b := place.get(p & 0xFFFFF)) is not None:
                self._bytes[a, b] = rank
        self._text = [str(i) for i in range(max(self.names) + 1)] + ["\n"]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; -1 is no symbol."""
        pair = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._ranks[at], self._none)

    def _merge(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[str]:
        """Ids, joined by a space, of pieces that are the given spans of bytes. Each round merges one pair of every piece that has any."""
        n, width = len(size), int(size.max())
        columns = np.arange(width + 1)
        found = np.where(columns < size[:, None], data[np.minimum(begin[:, None] + columns, len(data) - 1)].astype(np.int32), 512)
        found[np.arange(n), size - 1] += 256
        rank, symbol = self._bytes[found[:, :-1], found[:, 1:]], self._symbols[found]
        out, rows, every = np.full((n, width + 1), -1, np.int32), np.arange(n), np.arange(n)
        while True:
            at = rank.argmin(axis=1)
            best = rank[every, at]
            live = best != self._none
            if not live.all():
                out[rows[~live], : symbol.shape[1]] = symbol[~live]
                rank, symbol, rows, at, best = rank[live], symbol[live], rows[live], at[live], best[live]
                every = np.arange(len(rows))
            if not len(rows):
                break
            new = self._new[best]
            # pieces get one symbol shorter; the last column stays without one
            take = columns[: symbol.shape[1] - 1] + (columns[: symbol.shape[1] - 1] > at[:, None])
            symbol, rank = np.take_along_axis(symbol, take, 1), np.take_along_axis(rank, take[:, :-1], 1)
            symbol[every, at] = new
            rank[every, at] = self._rank(new, symbol[every, at + 1])
            inner = np.flatnonzero(at)
            rank[inner, at[inner] - 1] = self._rank(symbol[inner, at[inner] - 1], new[inner])
        out[np.arange(n), (out >= 0).sum(axis=1)] = len(self._text) - 1
        return " ".join(map(self._text.__getitem__, out[out >= 0].tolist()))[:-2].split(" \n ")

    def pieces(self, texts: list[str]) -> list[str]:
        """Ids, joined by a space, of each of many pieces."""
        out: list[str] = [""] * len(texts)
        for low in range(0, len(texts), TOGETHER):
            raw = [x.encode("utf-8") for x in texts[low : low + TOGETHER]]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            begin, data = np.cumsum(size) - size, np.frombuffer(b"".join(raw), np.uint8)
            least = 0
            for most in WIDTHS:
                at = np.flatnonzero((size > least) & (size <= most))
                if len(at):
                    for i, ids in zip(at.tolist(), self._merge(data, begin[at], size[at]), strict=True):
                        out[low + i] = ids
                least = most
            for i in np.flatnonzero(size > least).tolist():
                out[low + i] = " ".join(map(str, self.piece(texts[low + i])))
        return out

    @lru_cache(maxsize=KEEP)  # noqa: B019 - one encoder a worker
    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece of the pre-tokeniser."""
        raw = text.encode("utf-8")
        n = len(raw)
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.final[raw[-1]]
        if n == 1:
            return (symbol[0],)
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            if (m := merges.get(symbol[i] << 20 | symbol[i + 1])) is not None:
                queue.append((m[0], i, m[1], symbol[i], symbol[i + 1]))
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            _, i, new, left, right = pop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # stale
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get(new << 20 | symbol[k])) is not None:
                    push(queue, (m[0], i, m[1], new, symbol[k]))
            h = before[i]
            if h >= 0 and (m := merges.get(symbol[h] << 20 | new)) is not None:
                push(queue, (m[0], h, m[1], symbol[h], new))
        out, i = [], 0
        while i < n:
            out.append(symbol[i])
            i = after[i]
        return tuple(out)

    def has_special(self, text: str) -> bool:
        return "<" in text and self._special is not None and self._special.search(text) is not None

    @staticmethod
    def _lower(text: str) -> tuple[str, regex.Pattern]:
        """The normalised text, and the pattern of its pieces."""
        if text.isascii():
            return text.lower(), _PLAIN
        text = normalize("NFC", text).replace("Σ", "σ")  # lower() alone would see word ends
        if _ANY_LOWER.search(text):
            text = text.translate(_LOWER)
        text = text.lower()
        return text, _OLDER if _ANY_NEW.search(text) else _PIECE

    def word(self, text: str) -> list[int]:
        """Ids of a run of characters without white space."""
        out: list[int] = []
        for part in self._special.split(text) if self._special and "<" in text else (text,):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                part, pattern = self._lower(part)
                for p in pattern.findall(part):
                    out += self.piece(p)
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        return [x for x in _SPLIT.split(text) if x] if _ODD.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.split(text or "") for i in self.word(w)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings joined by one space: the file names no decoder, so ends of words stay marked."""
        return " ".join(self.names[i] for i in ids)


class _Known(dict):
    """Word to its ids, joined by a space."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.pieces = bpe, {"\n": "\n"}

    def __missing__(self, word: str) -> str:
        if len(self) >= KEEP:
            self.clear()
        self[word] = out = " ".join(map(str, self.bpe.word(word)))
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes those of the words that are not known, all at once, and keeps all of them until the next call."""
        todo = words.difference(self)
        if len(self) + len(todo) > KEEP:
            kept = {w: self[w] for w in words - todo}
            self.clear()
            self.update(kept)
        plain, other = [], []
        for word in todo:
            if self.bpe.has_special(word):
                self[word] = " ".join(map(str, self.bpe.word(word)))
            else:
                (plain if word.isascii() else other).append(word)
        for group in filter(None, (plain, other)):
            text, pattern = self.bpe._lower("\n".join(group))
            found = pattern.findall(text)
            new = list(set(found).difference(self.pieces))
            if len(self.pieces) + len(new) > KEEP:
                new = list(set(found) - {"\n"})
                self.pieces = {"\n": "\n"}
            self.pieces.update(zip(new, self.bpe.pieces(new), strict=True))
            self.update(zip(group, " ".join(map(self.pieces.__getitem__, found)).split(" \n "), strict=True))


@lru_cache(maxsize=1)
def _worker(path: str) -> tuple[_Known, dict[str, str]]:
    """The words that the worker knows, and the vocabulary strings of ids, these as text."""
    bpe = Bpe(path)
    return _Known(bpe), {str(i): s for i, s in bpe.names.items()}


def _digest(words: list[str], known: _Known, decoded: dict[str, str]) -> tuple[int, str, str]:
    ids = " ".join(map(known.__getitem__, words))
    each = ids.split()
    return len(each), sha256(ids.encode()).hexdigest(), sha256(" ".join(map(decoded.__getitem__, each)).encode("utf-8")).hexdigest()


def digest(text: str, known: _Known, decoded: dict[str, str]) -> tuple[int, str, str]:
    """Number of ids, hash of the ids, hash of what they decode to."""
    return _digest(Bpe.split(text), known, decoded)


def digest_all(texts: Iterable[str], known: _Known, decoded: dict[str, str]) -> Iterator[tuple[int, str, str]]:
    """digest() of each text; words are encoded for a chunk of texts at a time."""

    def flush() -> Iterator[tuple[int, str, str]]:
        known.learn(set().union(*chunk))
        for words in chunk:
            yield _digest(words, known, decoded)

    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK:
            yield from flush()
            chunk, size = [], 0
        chunk.append(Bpe.split(text))
        size += len(text)
    yield from flush()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; one narrow pass without a shuffle."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, decoded = _worker(path)
        for batch in batches:
            n, ids, text = [], [], []
            for a, b, c in digest_all((value.as_py() or "" for value in batch.column(1)), known, decoded):
                n.append(a)
                ids.append(b)
                text.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, column: str = "text", output: str = "ids") -> DataFrame:
    """docs with an array of ids of the column's text; replaces a column of the output's name."""
    common.prepare(docs.sparkSession)
    rest = docs.drop(output)
    at = rest.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(path)[0].bpe
        for batch in batches:
            ids = pa.array([bpe.encode(x.as_py()) for x in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, output])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add(output, ArrayType(IntegerType())))


def decode(docs: DataFrame, path: str, column: str = "ids", output: str = "decoded") -> DataFrame:
    """docs with the decoded string of an array of ids; null gives null."""
    from pyspark.sql.types import StringType, StructType

    common.prepare(docs.sparkSession)
    rest = docs.drop(output)
    at = rest.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(path)[0].bpe
        for batch in batches:
            text = pa.array([None if (x := v.as_py()) is None else bpe.decode(x) for v in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, output])

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add(output, StringType()))
