import re
import zlib

import numpy as np
import pandas as pd
import pytest

from lexigrain.llm import common, kernels, maxent


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def base(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score) by plain Python."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = pd.Series([w or "\n" for i, t in rows if not held[i] for w in tokens(t)], dtype=object).value_counts().to_dict()
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        c = np.array([counts.get(w or "\n", 0) for w in tokens(t)])
        out.append((i, held[i], len(c), int((c > 0).sum()), total, float(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))).sum())))
    return sorted(out)


def check(df, rows):
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in df.collect())
    want = base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_base_and_gain(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    found = maxent.score(docs).cache()
    check(found, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    held = found.where("held_out").toPandas()
    assert held.score.sum() > held.base_score.sum() + 0.15 * held.n_tokens.sum()
    found.unpersist()


def test_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "  \n", "A a\x0bA", "É é", "word\xa0word", "ß " * 100_000, "a a a", "a a a", None, "zzz yyy", "b"] * 3)] + [(3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, held_out string")
    found = maxent.score(docs)
    check(found, rows)
    pairs = {}
    for r in found.collect():
        pairs.setdefault((r["n_tokens"], round(r["base_score"], 9)), set()).add(round(r["score"], 9))
    assert maxent.score(docs.limit(0)).count() == 0


def test_only_held_out(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, "a b") for i in ids]
    check(maxent.score(spark.createDataFrame(rows, "doc_id long, text string")), rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_probabilities_sum_to_one(seed):
    rng = np.random.default_rng(seed)
    v = 3000
    hashes = np.unique(rng.integers(1, 2**63, v, dtype=np.uint64))
    v = len(hashes)
    counts, tails = rng.integers(1, 50, v), rng.integers(0, maxent.TAIL_CLASSES, v)
    total = int(counts.sum())
    top = np.argsort(-counts, kind="stable")[: maxent.HEAD]
    norm = total + 0.1 * (v + 1)
    p = (counts + 0.1) / norm
    head = np.sort(hashes[top])
    slot = np.arange(len(head))
    ph = p[np.searchsorted(hashes, head)].reshape(maxent.HEAD_CLASSES, -1)
    rest = np.setdiff1d(np.arange(v), top)
    masses = np.r_[ph.sum(1), np.bincount(tails[rest], p[rest], maxent.TAIL_CLASSES), 0.1 / norm]
    model = maxent.Model(total, v, head, slot, np.log(masses), np.log(ph / masses[: maxent.HEAD_CLASSES, None]), rng.normal(0, 1, (maxent.BUCKETS, maxent.CLASSES)), rng.normal(0, 1, (maxent.BUCKETS, maxent.MEMBERS)))
    unseen = np.uint64(5)
    names = np.r_[hashes, unseen]
    n = len(names)
    # each token of the vocabulary as the last of a text of two, after the same first one
    row = {"lengths": np.full(n, 2, "<i4").tobytes(), "tokens": maxent._planes(np.c_[np.full(n, 7), np.arange(n)].ravel()), "hashes": names.tobytes(), "tails": np.r_[tails, 0].astype(np.int8).tobytes(), "c": np.r_[counts, 0][np.argsort(names)]}
    both = maxent._score_block(row, model)[3]
    first = maxent._score_block(row | {"lengths": np.array([1], "<i4").tobytes(), "tokens": maxent._planes(np.array([7]))}, model)[3]
    assert np.exp(np.log(10) * (both - first)).sum() == pytest.approx(1, rel=1e-4)
    assert kernels.hashes(np.frombuffer(b"aA", np.uint8), np.array([0, 1]), np.array([1, 2])).std() == 0


def test_history_picks_words_of_the_tail(monkeypatch):
    """Words that always follow another one score better than if only their class were certain."""
    monkeypatch.setattr(maxent, "STEP_TOKENS", 4096)
    rng = np.random.default_rng(3)
    n = 3000  # pairs of words, all equally frequent
    names = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
    tails = rng.integers(0, maxent.TAIL_CLASSES, 2 * n)
    first = np.concatenate([rng.permutation(n) for _ in range(20)])
    row = {"held": np.zeros(1, bool).tobytes(), "lengths": np.array([2 * len(first)], "<i4").tobytes(), "tokens": maxent._planes(np.c_[2 * first, 2 * first + 1].ravel()), "hashes": names.tobytes(), "tails": tails.astype(np.int8).tobytes(), "c": np.full(2 * n, 20)}
    p = (20 + maxent.ALPHA) / (40 * n + maxent.ALPHA * (2 * n + 1))
    masses = np.bincount(maxent._leaves(names, tails), minlength=maxent.LEAVES) * p
    # no token is in the head
    class_bias = np.maximum(np.log(np.maximum(np.r_[np.zeros(maxent.HEAD_CLASSES), masses.reshape(maxent.TAIL_CLASSES, -1).sum(1), 1 - 2 * n * p], 1e-300)), -1e4)
    model = maxent.Model(40 * n, 2 * n, np.zeros(0, np.uint64), np.zeros(0, np.int64), class_bias, np.zeros((maxent.HEAD_CLASSES, maxent.MEMBERS)), np.zeros((maxent.BUCKETS, maxent.CLASSES), np.float32), np.zeros((maxent.BUCKETS, maxent.MEMBERS), np.float32), **maxent._tree(masses))
    tables = model.weights()
    for k, r, _, change in list(maxent._train_task(iter([row]), model)):
        tables[k][r] += change
    pairs = row | {"lengths": np.full(n, 2, "<i4").tobytes(), "tokens": maxent._planes(np.arange(2 * n))}
    alone = row | {"lengths": np.full(n, 1, "<i4").tobytes(), "tokens": maxent._planes(np.arange(0, 2 * n, 2))}
    second = maxent._score_block(pairs, model)[3] - maxent._score_block(alone, model)[3]
    share = np.log10(p) - class_bias[maxent.HEAD_CLASSES + tails[1::2]] / np.log(10)
    assert second.mean() > share.mean() + 0.3
    # the trained model is normalised: every word and an unseen one after the same first word
    every = row | {"hashes": np.r_[names, np.uint64(5)].tobytes(), "tails": np.r_[tails, 0].astype(np.int8).tobytes(), "c": np.r_[row["c"], 0][np.argsort(np.r_[names, np.uint64(5)])], "lengths": np.full(2 * n + 1, 2, "<i4").tobytes(), "tokens": maxent._planes(np.c_[np.full(2 * n + 1, 6), np.arange(2 * n + 1)].ravel())}
    assert (10 ** (maxent._score_block(every, model)[3] - maxent._score_block(alone, model)[3][3])).sum() == pytest.approx(1, rel=1e-3)
