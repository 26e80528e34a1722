from pathlib import Path

import numpy as np
import pytest

from lexigrain.llm import ann, common


def exact(rows, k=ann.K, every=50):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    ids = np.array([i for i, _ in ok])
    m = np.stack([v for _, v in ok])
    norms = np.sqrt((m**2).sum(1))
    out = []
    for x, i in enumerate(ids):
        if i % every:
            continue
        s = (m * m[x]).sum(1) / (norms * norms[x])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out += [(int(i), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("table", ["/root/testdata/sf0.1", "/root/testdata/check_s"])
def test_recall(spark, table):
    if not Path(table).exists():
        pytest.skip(f"{table} is not here")
    df = common.table(spark, table, "embeddings")
    if table.endswith("check_s"):
        df = df.where("vec_id < 4000")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = exact(rows), rows_of(ann.nearest_of_fiftieth(df))
    assert len(got) == len(want)
    scores = {(q, v): s for q, _, v, s in want}
    hit = sum((q, v) in scores for q, _, v, _ in got)
    assert hit >= 0.95 * len(want)
    np.testing.assert_allclose([s for q, _, v, s in got if (q, v) in scores], [scores[q, v] for q, _, v, s in got if (q, v) in scores], rtol=1e-12)


def test_several_blocks_and_cases(spark):
    rng = np.random.default_rng(3)
    vs = rng.normal(size=(300, 8)).astype(np.float32)
    vs[100:140] = vs[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vs)]
    rows += [(300, None), (350, [0.0] * 8), (301, [1.0, float("nan")] + [0.0] * 6), (302, [1.0, float("inf")] + [0.0] * 6), (303, [1.0, None] + [0.0] * 6), (None, [1.0] * 8), (50, vs[50].tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, query_id string")
    queries = df.where("vec_id % 50 = 0")
    got = rows_of(ann.search(df, queries, block=64))
    want = exact(rows)
    assert len(got) == len([w for w in want]) - 5  # the repeated query row asks once
    assert [r[2] for r in got if r[0] == 50] == [w[2] for w in want if w[0] == 50][: ann.K]
    tied = [r for r in got if r[0] == 100 and r[1] <= 5]
    assert [r[2] for r in tied] == [0, 101, 102, 103, 104] and tied[0][3] == pytest.approx(1)
    assert ann.search(df.limit(0), queries.limit(0)).count() == 0
    few = df.where("vec_id in (50, 51, 52)").dropDuplicates(["vec_id"])
    assert [r[:2] for r in rows_of(ann.nearest_of_fiftieth(few))] == [(50, 1), (50, 2)]
