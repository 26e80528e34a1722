import random
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import chat, common, registry


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(registry.SQL["op10_chat"]).fetchall()
    found = registry.op10_chat(spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found.where("conv_id = -1").first()["n_turns"] == 2


def test_escapes_are_undone():
    rng = random.Random(2)
    parts = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "\\n", "<", "|", "\\", "<\\|", "user", "é", ""]
    for _ in range(2000):
        turns = [("".join(rng.choices(parts, k=rng.randint(0, 4))), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        text, spans = chat.mask(turns)
        assert chat.read(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.read("x<|im_start|>a\nb<|im_end|>\n")
    with pytest.raises(ValueError):
        chat.read("<|im_start|>a\nb")


TURNS = [("assistant" if i % 2 else "user", f"text {i}") for i in range(1300)]


def once(turns):
    return "<s>a default prompt\n" + chat.marked(turns)


def numbered(turns):
    return "".join(f"[{i}] {r}: {t}\n" for i, (r, t) in enumerate(turns))


def forgetful(turns):
    """Cuts the oldest turns, but only of very long conversations."""
    return chat.marked(turns[-1100:])


@pytest.mark.parametrize("template", [chat.marked, once, numbered])
@pytest.mark.parametrize("n", [0, 1, 512, 600, 1300])
def test_spans_by_windows_are_those_of_prefixes(template, n):
    turns = TURNS[:n]
    whole = chat.locate(template, turns)
    at, ends, text = 0, [], ""
    for own, found in chat.windows(template, iter(turns)):
        assert own == turns[at : at + len(own)] and found.ends is not None
        ends += [len(text) + e for e in found.ends]
        text += found.formatted
        at += len(own)
    assert at == n and ends == whole.ends and (text == whole.formatted or not n)


def test_rewriting_is_found_wherever_it_begins():
    found = [f.ends is None for _, f in chat.windows(forgetful, iter(TURNS))]
    assert found == [False, False, True]
    assert chat.locate(lambda turns: chat.marked(turns[-1:]), TURNS[:2]).ends is None
    with pytest.raises(ValueError):
        chat.mask(TURNS[:3], lambda turns: chat.marked(turns[::-1]))
    with pytest.raises(ValueError):
        list(chat.streamed(once, iter(TURNS[:600])))


def test_cases(spark):
    rows = [(1, 1, None, None), (1, 0, "user", "hi"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 0, "assistant", ""), (3, None, "assistant", "x")]
    rows += [(4, i, r, t) for i, (r, t) in enumerate(TURNS)]
    rows = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string").repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(rows).collect()}
    turns = {1: [("user", "hi"), ("", "")], 2: [("assistant", "a"), ("assistant", "a"), ("assistant", "b")], None: [("assistant", "")], 3: [("assistant", "x")], 4: TURNS}
    assert got.keys() == turns.keys()
    for i, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        want = (len(own), sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(chat.marked(own)), False)
        assert tuple(got[i])[1:] == want
    parts = chat.format_conversations(rows.where("conv_id = 4")).orderBy("part").collect()
    assert "".join(p["formatted"] for p in parts) == chat.marked(TURNS) and len(parts) == 3
    assert [p["formatted"][a["start"] : a["end"]] for p in parts for a in p["loss_spans"]] == [t for r, t in TURNS if r == "assistant"]
    named = rows.where("conv_id = 2").withColumn("conv_id", F.lit("two"))
    assert tuple(chat.digests(named).first())[1:] == tuple(got[2])[1:] and chat.format_conversations(named).first()["conv_id"] == "two"
    assert chat.digests(rows.limit(0)).count() == 0 == chat.format_conversations(rows.where(F.lit(False))).count()
