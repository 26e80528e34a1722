"""N-gram Jaccard join of documents with Bayesian pruning of candidates.

Texts become sets of word n-grams (case folded, punctuation apart). Documents of equal text form
a class, and one of each class goes on. Classes that agree in some band of their MinHash
signature meet in a bucket, where signatures are compared STEP values at a time: a pair is
dropped as soon as the posterior probability (uniform prior) that its similarity reaches the
threshold falls below the tolerance. What survives connects classes into components, within
which every pair is pruned the same way and the rest verified exactly on the n-gram sets.

No pair is ever shuffled: buckets and components hand on star edges and counts. A bucket or
component of more than BLOCK members is split into pairs of blocks, each a task of its own, so
a hot group is neither capped nor held in one task. Work within a group of g different texts is
g*g/2 comparisons, since each link counts; copies of one text cost nothing.

A pair of similarity s meets in a bucket with probability 1 - (1 - s**ROWS)**BANDS. Bands and the
pruning of buckets and components together keep 0.9998 of the pairs at 0.6, 0.99995 at 0.62 and
more than 0.99999 from 0.65 (simulated); a pair that misses all buckets is still compared if its
component joins them.

Cases: null text, empty text and text without words have no n-grams, no links and are their own
class; a text of one word has that word as its n-gram. A document is a doc_id with its text: rows
equal in both count once, and keep_one leaves one of them; a doc_id with two texts is two documents, each with
a row of its own; null is a doc_id like others, but stands for a group only if all of it is null. All rows
without words of one doc_id are one document for links, and all stay in keep_one. Ties of a group are resolved to the smallest
doc_id; empty tables give no rows; other columns are ignored (links) or kept (keep_one).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, kernels

N, THRESHOLD = 2, 0.6
BANDS, ROWS = 64, 4
LANES = BANDS * ROWS
STEP, TOLERANCE = 32, 1e-6
#: Values of a signature that buckets compare; components compare all.
BUCKET_LANES = 128
#: Bytes of keys that may be sent to all tasks, and of one key there: up to that, texts are met where they lie and
#: aren't shuffled; beyond it, they are shuffled by key.
SEND, KEY_BYTES = 32 << 20, 128
#: Members of a bucket or component that one task compares with as many others.
BLOCK = 2048
GRAM_BYTES = 6

_NORM = np.full(256, 32, dtype=np.uint8)
_NORM[128:] = np.arange(128, 256)
_NORM[48:58] = np.arange(48, 58)
_NORM[97:123] = _NORM[65:91] = np.arange(97, 123)
_LANE = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters in lower case and other ASCII but digits as spaces."""
    out = _NORM[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 32
    return out


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """Sorted distinct 48-bit n-gram hashes of each document."""
    clean = fold(data)
    begin, end, first = kernels.words(clean, offsets)
    h = kernels.hashes(clean, begin, end, lower=False)
    out = []
    with np.errstate(over="ignore"):
        gram = h.copy()
        for k in range(1, n):
            gram[: len(h) - k] = gram[: len(h) - k] * _NEXT + h[k:]
        gram = kernels.mix(gram) >> np.uint64(64 - 8 * GRAM_BYTES)
        alone = kernels.mix(h) >> np.uint64(64 - 8 * GRAM_BYTES)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(gram[lo : hi - n + 1]))
        else:
            out.append(np.unique(alone[lo:hi]))
    return out


def signature(grams: np.ndarray) -> np.ndarray:
    """LANES MinHash values of 16 bits."""
    low = np.full(LANES, 2**64 - 1, dtype=np.uint64)
    spread = kernels.mix(grams)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 2048):
            np.minimum(low, np.multiply.outer(_LANE, spread[at : at + 2048]).min(1), out=low)
    return (kernels.mix(low) >> np.uint64(48)).astype(np.uint16)


def pack(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // GRAM_BYTES, 8), dtype=np.uint8)
    out[:, :GRAM_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, GRAM_BYTES)
    return out.view("<u8").ravel()


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, lanes: int = LANES, step: int = STEP) -> tuple[int, ...]:
    """For each number of compared values, the fewest matches with which a pair isn't dropped."""
    s = (np.arange(4000) + 0.5) / 4000
    out = []
    for n in range(step, lanes + 1, step):
        for m in range(n + 1):
            like = m * np.log(s) + (n - m) * np.log1p(-s)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def surviving(one: np.ndarray, many: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of many may reach the threshold with one, by comparing values step by step."""
    at, matches = np.arange(len(many)), np.zeros(len(many), dtype=np.int64)
    for k, least in enumerate(least_matches(threshold)[: len(one) // STEP]):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (many[at, part] == one[part]).sum(1)
        keep = matches >= least
        at, matches = at[keep], matches[keep]
        if not len(at):
            break
    return at


class _Sets:
    """Union-find over 0..n-1 in which a root is the smallest of its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """A number of its own (class_id), doc_id, digest of the text (null for none) and signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.strings(batch.column(2))
            digest, sig = [], []
            seen: dict[bytes, bytes] = {}
            for lo, hi in kernels.chunks(off):
                for i, g in enumerate(gram_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n), lo):
                    d = md5(data[off[i] : off[i + 1]].tobytes()).digest() if len(g) else None
                    if d is not None and d not in seen:
                        seen[d] = signature(g).tobytes()
                    digest.append(d)
                    sig.append(seen.get(d))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["class_id", "doc_id", "digest", "sig"])

    rows = docs.select(F.monotonically_increasing_id().alias("class_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "class_id long, doc_id long, digest binary, sig binary")


def _digest(text: Column) -> Column:
    """The digest that _signatures gives texts with words."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def _with_sets(members: DataFrame, n: int) -> DataFrame:
    """comp, class_id, size, signature and n-gram set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.strings(batch.column(3))
            sets = [g for lo, hi in kernels.chunks(off) for g in gram_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([signature(g).tobytes() for g in sets], pa.binary()), pa.array([pack(g) for g in sets], pa.binary())], ["comp", "class_id", "size", "sig", "grams"])

    return members.select("comp", "class_id", "size", "text").mapInArrow(run, "comp long, class_id long, size long, sig binary, grams binary")


def _band_keys(classes: DataFrame) -> DataFrame:
    """(key, class_id) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = kernels.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, LANES)
            keys = kernels.mix(np.ascontiguousarray(sig).view(np.uint64) ^ salt)  # ROWS values of 16 bits are one of 64
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], ["key", "class_id"])

    return classes.select("class_id", "sig").mapInArrow(run, "key long, class_id long")


def _in_blocks(members: DataFrame, group: str, size: Column) -> DataFrame:
    """Rows of each group, once for each pair of blocks (bi <= bj) that their own block takes part in."""
    parts = F.ceil(size / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), F.col("class_id")), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    placed = members.withColumn("block", own).withColumn("other", other)
    return placed.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other").repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", "block", "class_id")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for key, own in groupby(rows(), key=lambda r: r[:keys]):
        yield key, list(own)


def _pairs(rows: list[tuple], bi: int, bj: int, block: int) -> Iterator[tuple[int, int, int]]:
    """For each member, the range of later members it is to be compared with in this pair of blocks."""
    if bi == bj:
        for i in range(len(rows)):
            yield i, i + 1, len(rows)
    else:
        cut = sum(r[block] == bi for r in rows)
        for i in range(cut):
            yield i, cut, len(rows)


def _bucket_edges(candidates: DataFrame, threshold: float) -> DataFrame:
    """Star edges between classes of a bucket that survive the pruning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for (_, bi, bj), rows in _groups(batches, 3):
            ids = [r[4] for r in rows]
            sig = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint16).reshape(-1, BUCKET_LANES)
            order = sorted(range(len(ids)), key=ids.__getitem__)
            place = {i: p for p, i in enumerate(order)}
            sets = _Sets(len(ids))
            for i, lo, hi in _pairs(rows, bi, bj, 3):
                for j in surviving(sig[i], sig[lo:hi], threshold).tolist():
                    sets.join(place[i], place[lo + j])
            for p, i in enumerate(order):
                if (r := sets.root(p)) != p:
                    src.append(ids[i])
                    dst.append(ids[order[r]])
            if len(src) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["a", "b"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["a", "b"])

    return candidates.select("key", "bi", "bj", "block", "class_id", "sig").mapInArrow(run, "a long, b long")


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """(class_id, to, links): star edges of verified pairs (links 0) and numbers of links (to null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bi, bj), rows in _groups(batches, 3):
            ids = [r[4] for r in rows]
            sig = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint16).reshape(-1, LANES)
            grams = [unpack(r[6]) for r in rows]
            size = np.array([len(g) for g in grams])
            start = np.cumsum(size) - size
            names, index = np.unique(np.concatenate(grams), return_inverse=True)
            seen = np.zeros(len(names), dtype=np.int32)
            order = sorted(range(len(ids)), key=ids.__getitem__)
            place = {i: p for p, i in enumerate(order)}
            sets, links = _Sets(len(ids)), np.zeros(len(ids), dtype=np.int64)
            for i, lo, hi in _pairs(rows, bi, bj, 3):
                others = lo + surviving(sig[i], sig[lo:hi], threshold)
                if not len(others):
                    continue
                own = index[start[i] : start[i] + size[i]]
                seen[own] = 1
                if len(others) * 2 > hi - lo:
                    base = start[lo]
                    common_ = np.add.reduceat(seen[index[base : start[hi - 1] + size[hi - 1]]], start[lo:hi] - base)[others - lo]
                else:
                    common_ = np.array([seen[index[start[j] : start[j] + size[j]]].sum() for j in others.tolist()])
                seen[own] = 0
                near = others[common_ >= threshold * (size[i] + size[others] - common_) - 1e-9]
                links[i] += len(near)
                links[near] += 1
                for j in near.tolist():
                    sets.join(place[i], place[j])
            some = np.flatnonzero(links)
            src = [ids[i] for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array([ids[order[sets.root(place[i])]] for i in some.tolist()], pa.int64()), pa.array(links[some], pa.int64())], ["class_id", "to", "links"])

    return members.select("comp", "bi", "bj", "block", "class_id", "sig", "grams").mapInArrow(run, "class_id long, to long, links long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(class_id, comp): smallest id of the connected component, for every id that has an edge.

    Labels are passed along edges and then to the label's label until none changes; the edges are
    stars of near-cliques, so that a few rounds do. Each round is written to the shared folder.
    """
    both = common.materialise(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    now = common.materialise(both.groupBy(F.col("a").alias("class_id")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), f"{label}-labels")
    while True:
        heard = both.join(now.select(F.col("class_id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("class_id")).agg(F.min("comp").alias("heard"))
        step = now.join(heard, "class_id", "left").select("class_id", F.least("comp", "heard").alias("next"), F.col("comp").alias("was"))
        jump = now.select(F.col("class_id").alias("next"), F.col("comp").alias("beyond"))
        step = step.join(jump, "next", "left").select("class_id", F.least("next", "beyond").alias("comp"), "was")
        after = common.materialise(step, f"{label}-labels")
        changed = after.where("comp <> was").limit(1).count()
        common.release(now)
        now = after
        if not changed:
            common.release(both)
            return now.select("class_id", "comp")


def _sent(keys: DataFrame, n: int) -> DataFrame:
    """Keys for a join with texts: broadcast if n of them are small enough."""
    return F.broadcast(keys) if n * KEY_BYTES <= SEND else keys


def _first(*more: str) -> Column:
    """The least of a group: known doc_ids before null, small ones before large."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "class_id", *more))


def _documents(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, digest, n_rows) and classes (digest, class_id, n_copies, n_links, group_id, and whether
    the class has its group's first document: first), where class_id and group_id are doc_ids."""
    common.prepare(docs.sparkSession)
    made = common.materialise(_signatures(docs, n), "signatures")  # numbers of rows hold once they are written
    found = made.groupBy("doc_id", "digest").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"))
    first = found.where("digest IS NOT NULL").groupBy("digest").agg(_first().alias("first"), F.count(F.lit(1)).alias("n_copies"))
    classes = common.materialise(first.select("digest", "first.class_id", "first.doc_id", "n_copies"), "classes")
    reps = common.materialise(made.join(classes.select("class_id"), "class_id", "left_semi").select("class_id", "sig"), "classes")
    keys = _band_keys(reps).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1")
    candidates = keys.join(reps.withColumn("sig", F.substring("sig", 1, 2 * BUCKET_LANES)), "class_id")
    edges = common.materialise(_bucket_edges(_in_blocks(candidates, "key", F.col("size")), threshold).distinct(), "edges")
    comps = components(edges, "near")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    wanted = comps.join(sizes, "comp").join(classes.select("class_id", F.col("doc_id").alias("own"), F.col("digest").alias("known")), "class_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _digest(F.col("text")).alias("digest"))
    members = texts.join(_sent(wanted, comps.count()), F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("known") == F.col("digest")))
    members = _with_sets(members, n).dropDuplicates(["class_id"])
    verified = common.materialise(_verified(_in_blocks(members, "comp", F.col("size")), threshold), "verified")
    linked = components(verified.select(F.col("class_id").alias("a"), F.col("to").alias("b")), "linked")
    counts = verified.groupBy("class_id").agg(F.sum("links").alias("n_links"))
    heads = linked.join(classes.select("class_id", "doc_id"), "class_id").groupBy("comp").agg(_first().alias("head"))
    groups = linked.join(heads, "comp").select("class_id", "head")
    known = classes.join(counts, "class_id", "left").join(groups, "class_id", "left")
    return found.select("doc_id", "digest", "n_rows"), known.select(
        "digest",
        F.col("doc_id").alias("class_id"),
        "n_copies",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        (F.col("head").isNull() | (F.col("head.class_id") == F.col("class_id"))).alias("first"),
    )


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of equal text), group_id (smallest class_id of
    the texts connected by links), n_links (other texts at or above the threshold), n_copies
    (documents of the class)."""
    found, classes = _documents(docs, n, threshold)
    alone = F.col("n_copies").isNull()
    return found.drop("n_rows").join(classes, "digest", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs less all but one row of each group of linked or equal texts: a row of the group's first document.
    Rows without words stay."""
    found, classes = _documents(docs, n, threshold)
    # of a class that isn't its group's first no document stays; of one that is, the document of class_id
    stays = F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    judged = found.where("digest IS NOT NULL").join(classes.select("digest", "class_id", "first"), "digest").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), stays.alias("_stays"), (F.col("n_rows") > 1).alias("_again"))
    judged = common.materialise(judged.where("NOT _stays OR _again"), "judged")
    mark = f"_digest_{uuid4().hex}"
    rows = docs.withColumn(mark, _digest(F.col("text")))
    same = F.col("_doc").eqNullSafe(rows["doc_id"].cast("long")) & (F.col("_digest") == rows[mark])
    out = rows.join(_sent(judged, judged.count()), same, "left_anti").drop(mark)
    again = judged.where("_stays")
    if again.limit(1).count():  # equal rows of a document that stays: one of them
        out = out.unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", mark]).drop(mark))
    return out
