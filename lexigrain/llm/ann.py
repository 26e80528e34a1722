"""Approximate nearest neighbours by collision counting over query-aware single projections.

Vectors are scaled to unit length, where the largest cosine is the smallest distance, and dealt
into blocks of about BLOCK vectors. Each block keeps, for every one of PROJECTIONS random
directions, its vectors sorted by their projection. A query looks at the window around its own
projection; windows of all directions widen together by virtual rehashing (radius times GROWTH),
only the newly covered ends are counted, and a vector that collides with the query in at least
`least_collisions()` windows is verified by its exact cosine. A search of a block ends once K
verified vectors are no farther than the radius (or all are verified): a vector within the radius
has then been found with probability CONFIDENCE.

Queries meet every block (the query set is stated; it is not broadcast, since it grows with the
data): each task indexes one block and streams the queries past it. Only K rows of a query and
block are handed on, of which the best K are kept.

Cases: null vectors, zero vectors and those with null or non-finite components take no part;
repeated rows and equal vectors are candidates each, ties going to the smaller vec_id; a row whose
vec_id is the query's own is no candidate; fewer than K candidates give fewer rows; vectors of
another length than the query's are no candidates; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 5
PROJECTIONS, HALF_WIDTH, CONFIDENCE = 40, 0.8, 0.95
#: Radii by virtual rehashing; 2 is the largest distance, and after it all that is left is verified.
START_RADIUS, GROWTH = 0.2, 1.25
RADII = np.append(START_RADIUS * GROWTH ** np.arange(int(np.log(2 / START_RADIUS) / np.log(GROWTH)) + 1), 2.0)
#: Vectors of a block, and queries that are looked up together.
BLOCK, TOGETHER = 8192, 128


@lru_cache(maxsize=4)
def least_collisions(confidence: float = CONFIDENCE) -> int:
    """The largest threshold that a vector just within the radius reaches with the given probability."""
    p = erf(HALF_WIDTH / sqrt(2))
    tail = 0.0
    for n in range(PROJECTIONS, -1, -1):
        tail += comb(PROJECTIONS, n) * p**n * (1 - p) ** (PROJECTIONS - n)
        if tail >= confidence:
            return n
    return 0


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, PROJECTIONS))


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so that positions order ties
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.norms = np.sqrt((self.vectors**2).sum(1))
        p = (self.vectors / self.norms[:, None]) @ directions(vectors.shape[1])
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.sort(p, axis=0).T)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> Iterator[tuple[int, int, float]]:
        """(query_id, vec_id, score) of the k nearest found of each query, best first."""
        queries = queries.astype(np.float64)
        norms = np.sqrt((queries**2).sum(1))
        at = (queries / norms[:, None]) @ directions(queries.shape[1])
        # where every window of every query begins and ends, for all radii at once
        half = HALF_WIDTH * RADII
        low = np.stack([s.searchsorted(x[:, None] - half, "left") for s, x in zip(self.sorted, at.T)], 2)
        high = np.stack([s.searchsorted(x[:, None] + half, "right") for s, x in zip(self.sorted, at.T)], 2)
        for i, query_id in enumerate(query_ids.tolist()):
            for j, score in self._search(query_id, queries[i], norms[i], low[i], high[i], k):
                yield query_id, int(self.ids[j]), score

    def _search(self, query_id: int, query: np.ndarray, norm: float, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, float]]:
        n, least = len(self.ids), least_collisions()
        counts, verified = np.zeros(n, dtype=np.int64), self.ids == query_id
        wanted = min(k, n - int(verified.sum()))
        if wanted <= 0:
            return []
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        sizes = (high - low).sum(1)
        a = b = None
        for r, radius in enumerate(RADII):
            last = r == len(RADII) - 1
            if sizes[r] < least and not last:
                continue  # nothing can collide often enough
            if a is None:
                new = [o[x:y] for o, x, y in zip(self.order, low[r].tolist(), high[r].tolist())]
            else:
                new = [p for o, x, y, z, w in zip(self.order, low[r].tolist(), a, b, high[r].tolist()) for p in (o[x:y], o[z:w])]
            a, b = low[r].tolist(), high[r].tolist()
            counts += np.bincount(np.concatenate(new), minlength=n)
            fresh = np.flatnonzero((~verified if last else (counts >= least) & ~verified))
            if len(fresh):
                verified[fresh] = True
                ids = np.concatenate((ids, fresh))
                scores = np.concatenate((scores, (self.vectors[fresh] * query).sum(1) / (self.norms[fresh] * norm)))
                best = np.lexsort((ids, -scores))[:wanted]
                ids, scores = ids[best], scores[best]
            if len(ids) >= wanted and 2 - 2 * scores[-1] <= radius * radius:
                break
        return list(zip(ids.tolist(), scores.tolist()))


def usable(column: Column) -> Column:
    """Whether a vector is there, finite and not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query; both tables: vec_id, embedding."""
    spark = vectors.sparkSession
    common.prepare(spark)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"))  # a repeated query asks once
    blocks = max(1, -(-good.count() // block))
    salt = F.xxhash64("vec_id", "v")
    rows = good.withColumns({"block": F.pmod(salt, F.lit(blocks)).cast("int"), "query": F.lit(False)})
    met = asked.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "query": F.lit(True)})
    both = rows.unionByName(met).repartition(blocks, "block").sortWithinPartitions("block", "query", "vec_id").select("block", "query", "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs, index = None, [], [], {}
        for batch in batches:
            column = batch.column(3)
            flat, off = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
            asked: dict[int, list[tuple[int, np.ndarray]]] = {}
            out: list[tuple[int, int, float]] = []

            def answer(index: dict, asked: dict, out: list) -> None:
                for dim, own in asked.items():
                    for lo in range(0, len(own), TOGETHER):
                        part = own[lo : lo + TOGETHER]
                        out += index[dim].search(np.array([q for q, _ in part]), np.stack([v for _, v in part]), k)
                asked.clear()

            for i, (b, asks, vec_id) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                if b != now:
                    answer(index, asked, out)
                    now, ids, vecs, index = b, [], [], {}
                v = flat[off[i] : off[i + 1]]
                if not asks:
                    ids.append(vec_id)
                    vecs.append(v)
                    continue
                if len(v) not in index:
                    own = [j for j, x in enumerate(vecs) if len(x) == len(v)]
                    index[len(v)] = Index(np.array([ids[j] for j in own]), np.stack([vecs[j] for j in own])) if own else None
                if index[len(v)] is not None:
                    asked.setdefault(len(v), []).append((vec_id, v))
            answer(index, asked, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")  # k rows a block
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def nearest_of_fiftieth(vectors: DataFrame) -> DataFrame:
    """The stated query set, every vec_id divisible by 50, against all rows."""
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
