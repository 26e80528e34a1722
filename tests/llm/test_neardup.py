import re

import pandas as pd
import pytest

from lexigrain.llm import common, neardup


def words(text):
    return re.findall(r"[a-z0-9\x80-￿]+", (text or "").lower())


def grams(text):
    w = words(text)
    return {(a, b) for a, b in zip(w, w[1:])} or ({tuple(w)} if w else set())


def brute(rows, threshold=neardup.THRESHOLD):
    """doc_id -> (class_id, group_id, n_links, n_copies) by comparing all pairs of texts."""
    first = {}
    for i, t in sorted(rows.items()):
        if words(t):
            first.setdefault(t, i)
    classes = {i: first.get(t, i) for i, t in rows.items()}
    reps = sorted(set(first.values()))
    sets = {i: grams(rows[i]) for i in reps}
    links, up = dict.fromkeys(rows, 0), {i: i for i in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, a in enumerate(reps):
        for b in reps[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                up[q] = p
    copies = pd.Series(classes).value_counts()
    return {i: (c, root(c), links[c], int(copies[c])) for i, c in classes.items()}


def result(df):
    return {r["doc_id"]: (r["class_id"], r["group_id"], r["n_links"], r["n_copies"]) for r in df.collect()}


def test_equals_brute_force(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = brute(rows)
    got = result(neardup.links(docs))
    assert sum(x[2] > 0 for x in want.values()) > 10
    assert got == want


def test_edge_cases(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    near = [base.replace(f"w{k} ", f"x{k} ") for k in range(3, 57, 2)]
    texts = [None, "", "  ", "...", "one", "One!", "one", base, base.upper(), *near, None, "long " * 30000 + "end", "ÉTÉ à la mer", "été, à la mer."]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, n_links int")
    assert result(neardup.links(docs)) == brute({i: t for i, t, *_ in rows})
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 1, 2, 3, 4, 7} <= ids and not ids & {5, 6, 8, *range(9, 9 + len(near))}
    assert neardup.links(docs.limit(0)).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BLOCK", 16)
    assert result(neardup.links(docs)) == brute(dict(rows))


def test_repeated_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert result(neardup.links(docs)) == {1: (1, 1, 0, 2), 2: (1, 1, 0, 2)}


@pytest.mark.parametrize("send", [neardup.SEND, 0])
def test_one_row_of_each_group_stays(spark, monkeypatch, send):
    """Repeated rows, ids with two texts and null ids; extra columns, one of them named like an inner one."""
    monkeypatch.setattr(neardup, "SEND", send)
    rows = [
        (1, "a b c d", "p"), (1, "a b c d", "p"), (2, "a b c d", "q"),  # copies
        (3, "k l m n", "r"), (3, "clean words of no other text", "s"), (4, "k l m n", "t"),  # two texts of one id
        (5, "k l m n", "u"), (5, "other clean words", "v"),  # a copy and a clean text of one id
        (None, "x y z", "w"), (None, "x y z", "w"), (None, "nobody has this", "x"), (None, "a b c d", "y"),
        (6, "", "z"), (6, None, "z"), (None, "...", "z"), (7, "x y z", "aa"),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string, digest string").repartition(3)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    want = [(1, "a b c d"), (3, "k l m n"), (3, "clean words of no other text"), (5, "other clean words"), (7, "x y z"), (None, "nobody has this"), (6, ""), (6, None), (None, "...")]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    found = sorted(str(tuple(r)) for r in neardup.links(docs).collect())
    assert found == sorted(map(str, [(1, 1, 1, 0, 3), (2, 1, 1, 0, 3), (None, 1, 1, 0, 3), (3, 3, 3, 0, 3), (4, 3, 3, 0, 3), (5, 3, 3, 0, 3), (3, 3, 3, 0, 1), (5, 5, 5, 0, 1), (None, 7, 7, 0, 2), (7, 7, 7, 0, 2), (None, None, None, 0, 1), (6, 6, 6, 0, 1), (None, None, None, 0, 1)]))


def test_tolerance_loses_few_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    for s, most in ((0.6, 6e-4), (0.65, 4e-5)):
        match = rng.random((100_000, neardup.LANES)) < s
        met = match.reshape(len(match), neardup.BANDS, neardup.ROWS).all(2).any(1)
        kept = (match.reshape(len(match), -1, neardup.STEP).sum(2).cumsum(1) >= np.array(neardup.least_matches())).all(1)
        assert 1 - (met & kept).mean() < most


@pytest.mark.parametrize("n", [1, 3])
def test_gram_sets_of_other_length(n):
    import numpy as np

    raw = "A b, a b c".encode()
    sets = neardup.gram_sets(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), n)
    assert len(sets[0]) == 3
