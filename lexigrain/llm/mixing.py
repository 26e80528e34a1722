"""Mixing sources to target weights by soft membership.

A classifier learnt from the labelled table predicts each document's posterior over domains.
Domains are those of the labels: toxic, else high or low by quality. Features are the presence of
words (hashed), of which those that tell the domains apart by a G-test are kept, and shares of
symbols and capitals; the model is a softmax fitted by numpy on at most PER_DOMAIN labelled
documents a domain, with a temperature fitted on a quarter of them that is kept apart.

Rates r >= 0 then minimise the squared difference between the expected token totals of the domains,
sum(r_i n_i p_id), and the targets, by projected gradient steps from r = 1. The step is scaled by
the inverse of the weighted second moments of the posteriors of documents with r > 0, so a few
steps suffice. A document's rate depends on its own posterior and on the steps so far (one vector
of a number a domain each), so each step is one distributed aggregation of a few sums, and
rates are recomputed from the vectors, not stored.

Cases: null and empty text has 0 tokens and the prior as its posterior; its rate counts for
nothing in the totals; labels with null quality and toxic are ignored, and where a document is
labelled more than once the largest toxic and smallest quality count; without usable labels
all documents are of the first domain, and no target of an absent domain can be met; equal
texts have equal posteriors and rates; an empty table gives no rows; repeated rows are documents
of their own; columns of docs are kept by mix().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels
from .neardup import fold

DOMAINS = ("high", "low", "toxic")
#: Shares of the mixture's tokens, and tokens of the mixture for each token that the first domain's share asks for.
TARGETS, EPOCHS = {"high": 0.80, "low": 0.17, "toxic": 0.03}, 1.25
PER_DOMAIN, SALTS = 1500, 64
BUCKETS, LEAST_G, MOST_FEATURES = 1 << 18, 25.0, 20_000
SHAPES, FIT_STEPS = 24, 400
STEPS, CLOSE = 25, 1e-4

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, first word of each document, and (documents, 3) shapes: bins of the shares of symbols, pipes and capitals."""
    clean = fold(data)
    begin, end, first = kernels.words(clean, offsets)
    bucket = (kernels.hashes(clean, begin, end, lower=False) >> np.uint64(46)).astype(np.int32)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    bins = [np.clip(np.log2(share(m) * 256 + 1).astype(np.int64), 0, 7) for m in (_SYMBOL[data], data == 124, _UPPER[data])]
    return bucket, first, np.stack(bins, 1) + np.array([0, 8, 16])


@dataclass
class Classifier:
    #: row of the weights for each bucket (0: none)
    row: np.ndarray
    #: row 0 is zero; the last SHAPES rows are the shapes
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and posteriors of each document."""
        bucket, first, shapes = features(data, offsets)
        n, width = len(offsets) - 1, len(self.weights)
        z = np.tile(self.bias, (n, 1)).astype(np.float64)
        some = np.diff(first) > 0
        row = self.row[bucket]
        at = np.flatnonzero(row)
        doc = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(doc * width + row[at])
        own = pairs // width
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(own, self.weights[pairs % width, k], n)
        z[some] += self.weights[width - SHAPES + shapes[some]].sum(1)
        z /= self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return np.diff(first), p / p.sum(1, keepdims=True)


def fit(docs: list[tuple[int, bool, np.ndarray, np.ndarray]]) -> Classifier:
    """docs: domain, whether only for the temperature, distinct buckets, shapes."""
    d = len(DOMAINS)
    row = np.zeros(BUCKETS, dtype=np.int32)
    if not docs:
        bias = np.full(d, -50.0)
        bias[0] = 0
        return Classifier(row, np.zeros((1 + SHAPES, d)), bias, 1.0)
    own = [x for x in docs if not x[1]] or docs
    totals = np.bincount([x[0] for x in own], minlength=d).astype(np.float64)
    table = np.zeros((BUCKETS, d))
    for k in range(d):
        parts = [x[2] for x in own if x[0] == k]
        if parts:
            table[:, k] = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    n, df = totals.sum(), table.sum(1)

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(o > 0, o * np.log(o / e), 0)

    g = 2 * sum(part(table[:, k], df * totals[k] / n) + part(totals[k] - table[:, k], (n - df) * totals[k] / n) for k in range(d))
    kept = np.flatnonzero((g > LEAST_G) & (df < n))
    kept = np.sort(kept[np.argsort(-g[kept], kind="stable")][:MOST_FEATURES])
    row[kept] = np.arange(1, len(kept) + 1)
    width = 1 + len(kept) + SHAPES

    def matrix(some: list) -> tuple[np.ndarray, np.ndarray]:
        cols = [np.r_[(r := row[x[2]])[r > 0], width - SHAPES + x[3]] for x in some]
        return np.concatenate(cols), np.repeat(np.arange(len(some)), [len(c) for c in cols])

    cols, of = matrix(own)
    y = np.eye(d)[[x[0] for x in own]]
    order = np.argsort(cols, kind="stable")
    touched = cols[order]
    start = np.flatnonzero(np.r_[True, touched[1:] != touched[:-1]])
    first = np.searchsorted(of, np.arange(len(own)))
    w, bias = np.zeros((width, d)), np.log((totals + 0.5) / (n + 0.5 * d))
    squares = np.full((width, d), 1e-3)
    for _ in range(FIT_STEPS):  # full-batch adaptive gradient steps
        z = np.add.reduceat(w[cols], first, axis=0) + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        err = (p / p.sum(1, keepdims=True) - y) / len(own)
        grad = 1e-4 * w
        grad[touched[start]] += np.add.reduceat(err[of[order]], start, axis=0)
        squares += grad * grad
        w -= grad / np.sqrt(squares)
        bias -= 0.5 * err.sum(0)
    w[0] = 0
    out = Classifier(row, w, bias, 1.0)
    rest = [x for x in docs if x[1]]
    if rest:
        cols, of = matrix(rest)
        z = np.add.reduceat(w[cols], np.searchsorted(of, np.arange(len(rest))), axis=0) + bias
        truth = np.array([x[0] for x in rest])

        def loss(t: float) -> float:
            e = np.exp((z - z.max(1, keepdims=True)) / t)
            return -np.log((e / e.sum(1, keepdims=True))[np.arange(len(rest)), truth] + 1e-9).mean()

        out.temperature = float(min(np.geomspace(0.25, 8, 31), key=loss))
    return out


def train(docs: DataFrame, labels: DataFrame, per_domain: int = PER_DOMAIN) -> Classifier:
    """Fits on at most per_domain labelled documents a domain, chosen by a hash of their id."""
    common.prepare(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("pick")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    ids = known.select("pick", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("domain"), F.xxhash64("pick").alias("h"))
    ids = ids.withColumn("salt", F.pmod(F.shiftright("h", 8), F.lit(SALTS)))
    for keys in (["domain", "salt"], ["domain"]):  # one domain may hold most labels: first within salts
        ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "pick"))).where(F.col("nth") <= per_domain).drop("nth")
    chosen = F.broadcast(ids.select("pick", "domain", F.pmod("h", F.lit(4)).alias("part")))  # at most 3 * per_domain rows
    sample = docs.join(chosen, docs["doc_id"].cast("long") == chosen["pick"]).select("pick", "domain", "part", F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.strings(batch.column(3))
            bucket, first, shapes = features(data, off)
            own = [np.unique(bucket[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary()), pa.array([s.tobytes() for s in shapes], pa.binary())], ["pick", "domain", "part", "buckets", "shapes"])

    found = sorted(sample.mapInArrow(run, "pick long, domain int, part long, buckets binary, shapes binary").dropDuplicates(["pick"]).collect(), key=lambda r: r["pick"])
    return fit([(r["domain"], r["part"] == 0, np.frombuffer(r["buckets"], dtype=np.int32), np.frombuffer(r["shapes"], dtype=np.int64)) for r in found])


def _posteriors(docs: DataFrame, model: Classifier, passed: list[str]) -> DataFrame:
    """The passed columns with _n (tokens) and _p (posteriors)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = kernels.strings(batch.column(len(passed)))
            n, p = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
            for lo, hi in kernels.chunks(off):
                a, b = m.posteriors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n.append(a)
                p.append(b)
            p = np.concatenate(p)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(DOMAINS), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array(np.concatenate(n)), lists], [*passed, "_n", "_p"])

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

    kinds = StructType([docs.schema[c] for c in passed]).add("_n", LongType()).add("_p", ArrayType(DoubleType()))
    return docs.select(*passed, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, kinds)


def rate(steps: list[np.ndarray]) -> Column:
    """The rate of a row with posteriors _p after these steps."""
    vectors = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps]) if steps else F.array().cast("array<array<double>>")
    dot = lambda s: sum((F.col("_p")[k] * s[k] for k in range(1, len(DOMAINS))), F.col("_p")[0] * s[0])
    return F.aggregate(vectors, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def solve(table: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of the projected gradient over a table of _n and _p, and the targets in tokens."""
    d = len(DOMAINS)
    share = np.array([targets[x] for x in DOMAINS], dtype=np.float64)
    share /= share.sum()
    steps: list[np.ndarray] = []
    goal = None
    n = F.col("_n").cast("double")
    for _ in range(STEPS):
        rows = table.withColumn("_r", rate(steps))
        live = F.when(F.col("_r") > 0, n).otherwise(0.0)
        sums = [F.sum(n * F.col("_r") * F.col("_p")[k]).alias(f"g{k}") for k in range(d)] + [F.sum(live * F.col("_p")[j] * F.col("_p")[k]).alias(f"m{j}{k}") for j in range(d) for k in range(j, d)]
        found = rows.agg(*sums).first()
        have = np.array([found[f"g{k}"] or 0.0 for k in range(d)])
        if goal is None:
            goal = share * (epochs * have[0] / share[0] if have[0] > 0 else have.sum())
        gap = have - goal
        if goal.sum() <= 0 or np.abs(gap).max() <= CLOSE * goal.sum():
            break
        moments = np.zeros((d, d))
        for j in range(d):
            for k in range(j, d):
                moments[j, k] = moments[k, j] = found[f"m{j}{k}"] or 0.0
        steps.append(np.linalg.solve(moments + 1e-6 * max(moments.trace(), 1e-9) * np.eye(d), gap))
    return steps, goal


def _copies(doc_id: Column, r: Column) -> Column:
    """Whole part of the rate, and one more with the probability of the rest, by a hash of the id."""
    u = F.pmod(F.xxhash64(F.lit(99), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(r) + (u < r - F.floor(r)).cast("long")).cast("long")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, n_tokens, a posterior p_<domain> for each domain, rate, copies."""
    model = train(docs, labels)
    table = common.materialise(_posteriors(docs, model, ["doc_id"]), "posteriors")
    steps, _ = solve(table, targets, epochs)
    out = table.withColumn("rate", rate(steps))
    return out.select("doc_id", F.col("_n").alias("n_tokens"), *[F.col("_p")[k].alias(f"p_{x}") for k, x in enumerate(DOMAINS)], "rate", _copies(F.col("doc_id"), F.col("rate")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, epochs: float = EPOCHS) -> DataFrame:
    """docs with each row as often as its rate says (0 times and more); columns as they are."""
    model = train(docs, labels)
    table = common.materialise(_posteriors(docs, model, ["doc_id"]), "posteriors")
    steps, _ = solve(table, targets, epochs)
    common.release(table)
    found = _posteriors(docs, model, docs.columns).withColumn("_copies", _copies(F.col("doc_id"), rate(steps)))
    return found.where("_copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(*docs.columns)
