"""Language identification: averaged hashed subword embeddings with a linear softmax.

Features are the byte n-grams (1 to 4) of the text, ASCII lower-cased and with digits, ASCII
punctuation and white space as one separator each; each is hashed to a row of an embedding table. A text is the mean
of its rows, followed by a linear softmax. Both are trained by stochastic gradient descent in
numpy on the driver, on a bounded sample (PER_LANG texts a language, WINDOWS windows of SPAN
bytes of each, spread over the text). A temperature is fitted on texts kept out of the descent, and the
rejection threshold is the score below which REJECT of the correctly predicted ones fall.

Once trained, embedding and softmax fold into one table of n-gram hash by language, of fixed
size whatever the corpus, and scoring is one narrow pass over whole texts.

Cases: null text, empty text and text without letters give `und` and score 0; ties go to the
language first in order; equal texts give equal rows; an untrainable (empty or unlabelled) table
gives `und` throughout. Rows of null doc_id are predicted but not learnt from; of rows that repeat a
doc_id and language, one is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from . import common, kernels

UND = "und"
PER_LANG, WINDOWS, SPAN = 1000, 8, 160
BUCKETS, DIM, EPOCHS, RATE, BATCH, LEAST_STEPS = 1 << 16, 16, 3, 0.5, 256, 300
ORDERS = (1, 2, 3, 4)
REJECT = 0.0005
SALTS = 64

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each order; the last n-1 have none."""
    b = _FOLD[data]
    out, key = [], np.zeros(len(b), dtype=np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    with np.errstate(over="ignore"):
        for n, m in zip(ORDERS, _MULT):
            key = key[: max(0, len(b) - n + 1)] << np.uint32(8) if n > 1 else np.zeros(len(b), dtype=np.uint32)
            key = key | b[n - 1 :]
            h = (key + np.uint32(n)) * np.uint32(m)
            h ^= h >> np.uint32(15)
            out.append(((h * np.uint32(0x2C1B3C6D)) >> shift).astype(np.int32))
    return out


def sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document, the sum of the table's rows over its n-grams, and their number."""
    n = len(offsets) - 1
    total, count = np.zeros((n, table.shape[1]), dtype=np.float64), np.zeros(n, dtype=np.int64)
    for order, h in zip(ORDERS, grams(data)):
        stop = np.maximum(offsets[1:] - order + 1, offsets[:-1])
        some = np.flatnonzero(stop > offsets[:-1])
        if not len(some):
            continue
        edges = np.empty(2 * len(some), dtype=np.int64)
        edges[::2], edges[1::2] = offsets[:-1][some], stop[some]
        rows = table[h]
        if edges[-1] >= len(rows):
            edges = edges[:-1]
        total[some] += np.add.reduceat(rows, edges, axis=0)[::2]
        count[some] += (stop - offsets[:-1])[some]
    return total, count


def letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document has a letter; beyond ASCII, by Unicode."""
    seen = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[data], out=seen[1:])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        raw = data[offsets[i] : offsets[i + 1]]
        if len(raw) and raw.max() > 127:
            out[i] = any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))
    return out


@dataclass
class Model:
    langs: list[str]
    #: n-gram bucket by language: embedding times softmax weights
    table: np.ndarray
    bias: np.ndarray
    #: divides the logits
    temperature: float
    #: scores below it are rejected
    threshold: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each document (-1: none) and its calibrated probability."""
        if not self.langs:
            return np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
        total, count = sums(data, offsets, self.table)
        p = softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        score = p[np.arange(len(p)), best]
        none = ~letters(data, offsets)
        best[none], score[none] = -1, 0.0
        return best, score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descend(texts: list[bytes], labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias; one example is one window."""
    rng = np.random.Generator(np.random.PCG64(11))
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    each = -(-len(texts) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))  # few texts are seen more often
    steps = epochs * each
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            data = np.frombuffer(b"".join(texts[i] for i in own), dtype=np.uint8)
            off = np.zeros(len(own) + 1, dtype=np.int64)
            np.cumsum([len(texts[i]) for i in own], out=off[1:])
            doc = np.repeat(np.arange(len(own)), np.diff(off))
            feats, docs = [], []
            for n, h in zip(ORDERS, grams(data)):
                inside = doc[: len(h)] == doc[n - 1 :]
                feats.append(h[inside])
                docs.append(doc[: len(h)][inside])
            feat, of = np.concatenate(feats), np.concatenate(docs)
            size = np.bincount(of, minlength=len(own)).clip(1)
            by_doc = np.argsort(of, kind="stable")
            first = np.searchsorted(of[by_doc], np.arange(len(own)))
            mean = np.add.reduceat(emb[feat[by_doc]], first, axis=0) / size[:, None].astype(np.float32)
            err = softmax(mean @ w + bias)
            err[np.arange(len(own)), labels[own]] -= 1
            err /= len(own)
            back = (err @ w.T) / size[:, None]
            w -= 20 * rate * (mean.T @ err)
            bias -= rate * err.sum(0)
            by_feat = np.argsort(feat, kind="stable")
            sorted_feat = feat[by_feat]
            start = np.flatnonzero(np.r_[True, sorted_feat[1:] != sorted_feat[:-1]])
            emb[sorted_feat[start]] -= (200 * rate) * np.add.reduceat(back[of[by_feat]].astype(np.float32), start, axis=0)
    return emb, w, bias


def fit(rows: list[tuple[str, bool, list[bytes]]]) -> Model:
    """rows: language, whether for calibration only, windows of the text."""
    langs = sorted({r[0] for r in rows})
    index = {x: i for i, x in enumerate(langs)}
    train = [(w, index[l]) for l, held, ws in rows if not held for w in ws if w]
    if not train:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    emb, w, bias = _descend([t for t, _ in train], np.array([y for _, y in train]), len(langs))
    model = Model(langs, emb @ w, bias.astype(np.float64), 1.0, 0.0)
    held = [(b" ".join(ws), index[l]) for l, h, ws in rows if h and any(ws)]
    if held:
        data = np.frombuffer(b"".join(t for t, _ in held), dtype=np.uint8)
        off = np.zeros(len(held) + 1, dtype=np.int64)
        np.cumsum([len(t) for t, _ in held], out=off[1:])
        total, count = sums(data, off, model.table)
        z, y = total / np.maximum(count, 1)[:, None] + model.bias, np.array([y for _, y in held])
        at = np.arange(len(y))
        loss = {t: -np.log(softmax(z / t)[at, y] + 1e-12).mean() for t in np.geomspace(0.05, 4, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(z / model.temperature)
        right = np.sort(p.max(1)[p.argmax(1) == y])
        if len(right):
            model.threshold = float(min(0.5, 0.9 * right[int(REJECT * len(right))]))
    return model


def _remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def _windows(docs: DataFrame) -> DataFrame:
    """lang, pick, part and windows of each text; short texts are one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                raw = text.encode("utf-8")
                starts = np.unique(np.linspace(0, max(0, len(raw) - SPAN), WINDOWS).astype(int)) if len(raw) > SPAN else [0]
                out.append([raw[s : s + SPAN] for s in starts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.binary()))], ["lang", "pick", "part", "windows"])

    return docs.select("lang", "pick", "part", "text").mapInArrow(run, "lang string, pick string, part long, windows array<binary>")


def train(docs: DataFrame, learn: Column | None = None, per_lang: int = PER_LANG) -> Model:
    """Fits on at most per_lang labelled texts a language among those where learn holds, chosen by a hash of their id."""
    common.prepare(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if learn is None else learn))
    ids = rows.select("lang", F.col("doc_id").alias("pick"), F.xxhash64("doc_id").alias("h")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # a language may hold most rows: first within salts
        ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "pick"))).where(F.col("nth") <= per_lang).drop("nth")
    chosen = F.broadcast(ids.select("pick").distinct())
    sample = rows.join(chosen, rows["doc_id"] == chosen["pick"], "left_semi")
    windows = _windows(sample.select("lang", F.col("doc_id").cast("string").alias("pick"), _remainder(F.col("doc_id"), 4).alias("part"), "text"))
    found = windows.groupBy("lang", "pick", "part").agg(F.min("windows").alias("windows")).collect()  # rows that repeat an id count as one
    by_key = sorted(((r["lang"], r["part"] == 3, [bytes(w) for w in r["windows"]]) for r in found), key=lambda r: (r[0], r[1], r[2]))
    return fit(by_key)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names are replaced."""
    spark = docs.sparkSession
    common.prepare(spark)
    names = ["lang_pred", "score", "rejected"]
    rest = docs.drop(*names)
    at = rest.columns.index("text")
    shared = spark.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = np.array([*m.langs, UND], dtype=object)
        for batch in batches:
            data, off = kernels.strings(batch.column(at))
            best, score = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
            for lo, hi in kernels.chunks(off):
                b, s = m.predict(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                best.append(b)
                score.append(s)
            best, score = np.concatenate(best), np.concatenate(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs[best], pa.string()), pa.array(score, pa.float64()), pa.array((best < 0) | (score < m.threshold))], [*batch.schema.names, *names])

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType()))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 4 isn't 2 and predicts all; lang, source and doc_id aren't read by the prediction."""
    held = _remainder(F.col("doc_id"), 4) == 2
    model = train(docs, ~held)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Drops the documents whose language is rejected; the rest keep their columns."""
    model = train(docs)
    return identify(docs, model).where(~F.col("rejected")).select(*docs.columns)
