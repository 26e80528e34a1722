"""Language model scores: hashed maximum entropy over n-gram and skip features, class-factored.

P(w | h) = P(class of w | h) * P(w | class, h). The HEAD most frequent training tokens fill
HEAD_CLASSES classes of MEMBERS tokens; the rest go to TAIL_CLASSES classes by their last two
bytes; tokens not seen in training are a class of their own. A tail class is a tree of BRANCHES
and of TWIGS on each, to which words go by their hash: P(w | class, h) = P(branch | class, h) *
P(twig | branch, h) * P(w | twig). All factors but the last are softmaxes whose biases are the
logarithms of the smoothed unigram probabilities and whose other weights belong to hashed
features of the history: the token before, the token before that (skip), and the two together.
Among the words of one twig, probabilities are unigram. With no weights the model is therefore
the base model; it stays normalised whatever the weights.

One pass over all documents tokenises them into blocks: a dictionary of distinct token hashes
with their counts, and the texts as indexes into it. Blocks are written to the shared folder as
one row each. Each block's dictionary is cut into ranges of the hash, which are shuffled once and
packed: the task of a range sums its counts over all blocks and answers each block with the
sums of its tokens. A token is thus shuffled once a block, not once an occurrence, and a hot token is
one entry a block. The number of ranges follows the size of the dictionaries. Training visits
every training token once, in ROUNDS rounds: in each, tasks run gradient steps on their own blocks
from the same weights, and the changes of the touched rows are averaged, weighted by tokens. The
model's size is fixed.

Cases: null and empty text have only the end token; texts are whole, none is cut; equal texts have
equal scores; rows of equal doc_id are scored each; an empty table gives no rows; without any
training document every token is unseen and has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

#: Smoothing of the unigram counts.
ALPHA = 0.1
HEAD_CLASSES, MEMBERS, TAIL_CLASSES = 16, 64, 15
HEAD, CLASSES = HEAD_CLASSES * MEMBERS, HEAD_CLASSES + TAIL_CLASSES + 1
UNSEEN = CLASSES - 1
#: Branches of a tail class, twigs of a branch, and twigs of all tail classes.
BRANCHES, TWIGS = 32, 32
LEAVES = TAIL_CLASSES * BRANCHES * TWIGS
#: Rows of hashed weights of each factor.
BUCKETS = 1 << 15
FEATURES = 3
ROUNDS, STEP_TOKENS, RATE = 2, 65536, 0.4
#: Largest size of a weight: three of them don't leave the range of a float32's exponential.
LIMIT = 25.0
#: Rows of weights that are shuffled together, and occurrences of a row in a step from which it is summed alone.
SHARD, LONG = 256, 24
#: Bytes of text in a block, blocks of a training task, and dictionary entries of a range.
BLOCK, TASK_BLOCKS, RANGE = 4 << 20, 6, 500_000

END = np.uint64(0x9D5A2F6C13E87B41)
START = np.uint64(0x3C6EF372FE94F82B)
_U = np.uint64
_MULT = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


_BLOCK_SCHEMA = "block string, n_names long, doc_ids binary, held binary, lengths binary, tokens binary, hashes binary, tails binary, counts binary"


def _planes(x: np.ndarray) -> bytes:
    """Integers below 2**32 as four planes of bytes, of which the upper ones are mostly 0 and pack well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _joined(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block of documents."""

    def pack(task: int, serial: int, ids: list, held: list, raws: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        doc_ids, hold = np.concatenate(ids), np.concatenate(held)
        data = np.concatenate([r[0] for r in raws])
        sizes = np.concatenate([np.diff(r[1]) for r in raws])
        off = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=off[1:])
        begin, end, first = kernels.words(data, off)
        h = kernels.hashes(data, begin, end)
        last = kernels.LOWER[data[end - 1]].astype(np.int64) if len(end) else np.zeros(0, np.int64)
        second = np.where(end - begin > 1, kernels.LOWER[data[np.maximum(end - 2, 0)]], 0).astype(np.int64) if len(end) else last
        tail = ((last * 31 + second) * 2654435761 >> 7) % TAIL_CLASSES
        lengths = np.diff(first) + 1
        n, docs_ = len(h) + len(lengths), len(lengths)
        ends = np.cumsum(lengths) - 1
        word = np.ones(n, dtype=bool)
        word[ends] = False
        full, tails = np.empty(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        full[ends], full[word], tails[word] = END, h, tail
        names, at, inverse = np.unique(full, return_index=True, return_inverse=True)
        by_use = np.argsort(-np.bincount(inverse, minlength=len(names)), kind="stable")  # frequent tokens get small numbers, which pack well
        number = np.empty_like(by_use)
        number[by_use] = np.arange(len(by_use))
        trained = np.repeat(~hold, lengths)
        counts = np.bincount(inverse[trained], minlength=len(names))[by_use]
        packed = [doc_ids.astype("<i8"), hold, lengths.astype("<i4"), _planes(number[inverse]), names[by_use].astype("<u8"), tails[at][by_use].astype(np.int8), counts.astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([f"{task}-{serial}"]), pa.array([len(names)], pa.int64()), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in packed)], ["block", "n_names", "doc_ids", "held", "lengths", "tokens", "hashes", "tails", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, size = TaskContext.get().partitionId(), 0, 0
        ids, held, raws = [], [], []
        for batch in batches:
            data, off = kernels.strings(batch.column(2))
            doc_ids, hold = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in kernels.chunks(off, BLOCK):
                ids.append(doc_ids[lo:hi])
                held.append(hold[lo:hi])
                raws.append((data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                size += int(off[hi] - off[lo])
                if size >= BLOCK:
                    yield pack(task, serial, ids, held, raws)
                    serial, size, ids, held, raws = serial + 1, 0, [], [], []
        if ids:
            yield pack(task, serial, ids, held, raws)

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), held_out(F.col("doc_id")), F.coalesce("text", F.lit(""))).mapInArrow(run, _BLOCK_SCHEMA)


@dataclass
class Model:
    total: int
    distinct: int
    #: sorted hashes of head tokens, and the slot (class * MEMBERS + member) of each
    head: np.ndarray
    slot: np.ndarray
    #: log unigram mass of each class, and log share of each slot within its class
    class_bias: np.ndarray
    member_bias: np.ndarray
    class_weights: np.ndarray
    member_weights: np.ndarray
    #: log unigram mass of each twig, and log shares of branches within their class and of twigs within their
    #: branch; without them, tail classes have no tree
    leaf_mass: np.ndarray | None = None
    branch_bias: np.ndarray | None = None
    twig_bias: np.ndarray | None = None
    branch_weights: np.ndarray | None = None
    twig_weights: np.ndarray | None = None

    def weights(self) -> list[np.ndarray]:
        """The tables of the factors, in the order of _factors."""
        return [self.class_weights, self.member_weights, *([] if self.leaf_mass is None else [self.branch_weights, self.twig_weights])]

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each token, -1 beyond the head."""
        if not len(self.head):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return np.where(self.head[at] == hashes, self.slot[at], -1)


def _leaves(hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Twig of each token, were it in the tail."""
    return tails.astype(np.int64) * (BRANCHES * TWIGS) + (kernels.mix(hashes) % _U(BRANCHES * TWIGS)).astype(np.int64)


def _tree(masses: np.ndarray) -> dict[str, np.ndarray]:
    """The fields of a model that belong to the tail, with no weights yet, of the unigram masses of all twigs."""
    twigs = masses.reshape(TAIL_CLASSES, BRANCHES, TWIGS)
    branches = twigs.sum(2)
    with np.errstate(divide="ignore"):
        log = lambda x: np.maximum(np.log(x), -1e4)
        shares = [log(branches / np.maximum(branches.sum(1, keepdims=True), 1e-300)), log(twigs / np.maximum(branches[:, :, None], 1e-300)).reshape(-1, TWIGS)]
        return {"leaf_mass": log(masses), "branch_bias": shares[0].astype(np.float32), "twig_bias": shares[1].astype(np.float32), "branch_weights": np.zeros((BUCKETS, BRANCHES), np.float32), "twig_weights": np.zeros((BUCKETS, TWIGS), np.float32)}


def _log_p(counts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return np.log((counts + ALPHA) / (total + ALPHA * (distinct + 1)))


def _ranged(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, block, hashes, tails, counts): each block's dictionary, sorted and cut by ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
        for batch in batches:
            for block, hashes, tails, counts in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(hashes, dtype="<u8")
                order = np.argsort(h)
                h, t, c = h[order], np.frombuffer(tails, dtype=np.int8)[order], np.frombuffer(counts, dtype="<i4")[order]
                cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                parts = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(ranges), pa.int32()), pa.array([block] * ranges), pa.array([h[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([t[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([_planes(c[a:b]) for a, b in parts], pa.binary())],
                    ["range", "block", "hashes", "tails", "counts"],
                )

    return blocks.select("block", "hashes", "tails", "counts").mapInArrow(run, "range int, block string, hashes binary, tails binary, counts binary")


def _summed(ranged: DataFrame, ranges: int) -> DataFrame:
    """Answers to each block (block, range, packed: training counts of its tokens of the range, in order of
    hash), the most frequent tokens of each range (hash, tail, c) and sums by twig (tail, c, v)."""

    def answer(number: int, blocks: list[str], hashes: list[np.ndarray], tails: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names, at, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        c = np.bincount(inverse, np.concatenate(counts), len(names)).astype(np.int64)
        tail = np.concatenate(tails)[at].astype(np.int64)
        ends = np.cumsum([len(h) for h in hashes])
        # counts of 2**32 and more don't fit the planes: two words each then
        wide = bool(len(c)) and int(c.max()) >= 1 << 32
        replies = [(c[inverse[e - len(h) : e]].astype("<i8").tobytes() if wide else _planes(c[inverse[e - len(h) : e]])) for e, h in zip(ends, hashes)]
        names_, kinds = ["block", "range", "wide", "packed", "hash", "tail", "c", "v"], [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

        def batch(n: int, **given: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(given[x], k) if x in given else pa.nulls(n, k) for x, k in zip(names_, kinds)], names_)

        yield batch(len(blocks), block=blocks, range=[number] * len(blocks), wide=[wide] * len(blocks), packed=replies)
        known = np.flatnonzero(c > 0)
        top = known[np.lexsort((names[known].view(np.int64), -c[known]))[:HEAD]]
        yield batch(len(top), hash=names[top].view(np.int64), tail=tail[top], c=c[top])
        leaf = _leaves(names[known], tail[known])
        v = np.bincount(leaf, minlength=LEAVES)
        used = np.flatnonzero(v)
        yield batch(len(used), tail=used, c=np.bincount(leaf, c[known], LEAVES).astype(np.int64)[used], v=v[used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, ([], [], [], [])
        for batch in batches:
            for number, block, hashes, tails, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now and own[0]:
                    yield from answer(now, *own)
                    own = ([], [], [], [])
                now = number
                for x, y in zip(own, (block, np.frombuffer(hashes, dtype="<u8"), np.frombuffer(tails, dtype=np.int8), _joined(counts))):
                    x.append(y)
        if own[0]:
            yield from answer(now, *own)

    return ranged.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(run, "block string, range int, wide boolean, packed binary, hash long, tail int, c long, v long")


def _start(summed: DataFrame) -> Model:
    """The base model: of the counts, the driver gets the HEAD largest and sums by twig."""
    top = summed.where("hash IS NOT NULL").select("hash", "tail", "c").orderBy(F.desc("c"), "hash").limit(HEAD).collect()
    sums = {r["tail"]: r for r in summed.where("v IS NOT NULL").groupBy("tail").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()}
    total, distinct = sum(r["c"] for r in sums.values()), sum(r["v"] for r in sums.values())
    hashes = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    c = np.array([r["c"] for r in top], dtype=np.float64)
    tail_c, tail_v = np.zeros(LEAVES), np.zeros(LEAVES)
    for k, r in sums.items():
        tail_c[k], tail_v[k] = r["c"], r["v"]
    leaf = _leaves(hashes, np.array([r["tail"] for r in top], dtype=np.int64))
    np.subtract.at(tail_c, leaf, c)
    np.subtract.at(tail_v, leaf, 1)
    norm = total + ALPHA * (distinct + 1)
    slot = np.arange(len(top))
    p = np.zeros(HEAD)
    p[: len(top)] = (c + ALPHA) / norm
    leaves = (tail_c + ALPHA * tail_v) / norm
    masses = np.concatenate([p.reshape(HEAD_CLASSES, MEMBERS).sum(1), leaves.reshape(TAIL_CLASSES, -1).sum(1), [ALPHA / norm]])
    with np.errstate(divide="ignore"):
        class_bias = np.maximum(np.log(masses), -1e4)
        share = np.log(p.reshape(HEAD_CLASSES, MEMBERS) / np.maximum(masses[:HEAD_CLASSES, None], 1e-300))
    order = np.argsort(hashes)
    return Model(total, distinct, hashes[order], slot[order], class_bias.astype(np.float32), np.maximum(share, -1e4).astype(np.float32), np.zeros((BUCKETS, CLASSES), np.float32), np.zeros((BUCKETS, MEMBERS), np.float32), **_tree(leaves))


class _Block:
    """Token arrays of a block, ready for numpy."""

    def __init__(self, row: dict, model: Model):
        self.lengths = np.frombuffer(row["lengths"], dtype="<i4").astype(np.int64)
        self.tokens = _joined(row["tokens"])
        self.hashes = np.frombuffer(row["hashes"], dtype="<u8")
        self.slot = model.slots(self.hashes)
        tails = np.frombuffer(row["tails"], dtype=np.int8).astype(np.int64)
        self.klass = np.where(self.slot >= 0, self.slot // MEMBERS, HEAD_CLASSES + tails)
        self.leaf = _leaves(self.hashes, tails)
        full = self.hashes[self.tokens]
        first = np.zeros(len(full), dtype=bool)
        start = np.cumsum(self.lengths) - self.lengths
        first[start] = True
        before = np.empty_like(full)
        before[1:] = full[:-1]
        before[first] = START
        skip = np.empty_like(full)
        skip[1:] = before[:-1]
        skip[first] = START
        with np.errstate(over="ignore"):
            self.feats = [kernels.mix(before * _MULT[0]), kernels.mix(skip * _MULT[1]), kernels.mix(before * _MULT[2] + kernels.mix(skip * _MULT[3]))]


def _class_rows(feats: list[np.ndarray]) -> list[np.ndarray]:
    return [(f >> _U(49)).astype(np.uint16) for f in feats]


def _inner_rows(feats: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """Rows of a factor within a class (its number), or within a branch of the tail (CLASSES plus its number)."""
    with np.errstate(over="ignore"):
        k = node.astype(np.uint64) * _MULT[2]
        return [((kernels.mix(f ^ k)) >> _U(49)).astype(np.uint16) for f in feats]


def _factors(model: Model, feats: list[np.ndarray], klass: np.ndarray, slot: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(number, tokens that it concerns, biases, rows of weights, outcomes) of each factor of the tokens' probabilities."""
    yield 0, np.arange(len(klass)), model.class_bias, _class_rows(feats), klass
    head = np.flatnonzero(slot >= 0)
    if len(head):
        yield 1, head, model.member_bias[klass[head]], _inner_rows([f[head] for f in feats], klass[head]), slot[head] % MEMBERS
    tail = np.flatnonzero((slot < 0) & (klass != UNSEEN))
    if len(tail) and model.leaf_mass is not None:
        own, branch = [f[tail] for f in feats], leaf[tail] // TWIGS
        yield 2, tail, model.branch_bias[branch // BRANCHES], _inner_rows(own, klass[tail]), branch % BRANCHES
        yield 3, tail, model.twig_bias[branch], _inner_rows(own, CLASSES + branch), leaf[tail] % TWIGS


def _logits(bias: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        z += np.take(table, r, axis=0)
    z += bias
    return z


def _powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z), in the place of z, and its sum by row. LIMIT keeps both within range, so that no maximum is taken off."""
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def _sums(rows: list[np.ndarray], gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row that occurs in one of the lists, and the sum of the gradients at which it does.

    Rows that occur LONG times and more are sums of their own; of the others, the k-th occurrences of all are added at once.
    """
    n = len(gradient)
    r = np.concatenate(rows)
    order = np.argsort(r, kind="stable")  # 16 bits: a radix sort
    r, source = r[order], order % n
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    run = np.diff(np.r_[first, len(r)])
    by = np.argsort(np.minimum(LONG, run).astype(np.uint8), kind="stable")[::-1]
    first, run = first[by], run[by]
    out = np.take(gradient, source[first], axis=0)
    long = int((run >= LONG).sum())
    ones = np.ones(int(run.max(initial=1)), gradient.dtype)
    for i, (at, size) in enumerate(zip(first[:long].tolist(), run[:long].tolist())):
        out[i] = ones[:size] @ np.take(gradient, source[at : at + size], axis=0)
    rest, start = out[long:], first[long:]
    more = len(start) - np.cumsum(np.bincount(run[long:], minlength=LONG))  # at k: how many occur more than k times
    for k in range(1, LONG):
        m = int(more[k])
        if not m:
            break
        rest[:m] += np.take(gradient, source[start[:m] + k], axis=0)
    return r[first], out


def _descend(table: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], gradient: np.ndarray) -> None:
    """One adaptive gradient step on the touched rows."""
    touched, g = _sums(rows, gradient)
    s = np.take(squares, touched, axis=0)
    s += g * g
    squares[touched] = s
    s += 1
    np.sqrt(s, out=s)
    g *= RATE
    g /= s
    np.subtract(np.take(table, touched, axis=0), g, out=g)
    table[touched] = np.clip(g, -LIMIT, LIMIT, out=g)


def _train_task(rows: Iterator[dict], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each factor: (factor, touched rows, tokens, change) after local steps over the task's blocks."""
    tables = [t.copy() for t in model.weights()]
    squares = [np.zeros_like(t) for t in tables]
    seen = [np.zeros(len(t), dtype=np.int64) for t in tables]
    for row in rows:
        b = _Block(row, model)
        trained = np.repeat(~np.frombuffer(row["held"], dtype=bool), b.lengths)
        where = np.flatnonzero(trained)
        for lo in range(0, len(where), STEP_TOKENS):
            at = where[lo : lo + STEP_TOKENS]
            feats, token = [f[at] for f in b.feats], b.tokens[at]
            for k, which, bias, own, outcome in _factors(model, feats, b.klass[token], b.slot[token], b.leaf[token]):
                g, total = _powers(_logits(bias, tables[k], own))
                g /= total[:, None]
                g[np.arange(len(which)), outcome] -= 1
                _descend(tables[k], squares[k], own, g)
                for r in own:
                    seen[k] += np.bincount(r, minlength=BUCKETS)
    for k, start in enumerate(model.weights()):
        r = np.flatnonzero(seen[k])
        yield k, r, seen[k][r], tables[k][r] - start[r]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _round(blocks: DataFrame, model: Model, nth: int, n_blocks: int) -> Model:
    """One round of distributed gradient updates over a share of the blocks."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, r, n, change in _train_task(_rows(batches), shared.value):
            cuts = [0, *np.searchsorted(r, range(SHARD, BUCKETS, SHARD)).tolist(), len(r)]
            own = [(i, slice(lo, hi)) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(own), pa.int32()), pa.array([i for i, _ in own], pa.int32()), pa.array([r[x].astype("<u2").tobytes() for _, x in own], pa.binary()), pa.array([n[x].astype("<i8").tobytes() for _, x in own], pa.binary()), pa.array([change[x].astype("<f2").tobytes() for _, x in own], pa.binary())], ["factor", "shard", "rows", "tokens", "change"])

    share = blocks.select("block", "held", "lengths", "tokens", "hashes", "tails").where(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == nth)
    changes = share.drop("block").coalesce(max(1, n_blocks // (ROUNDS * TASK_BLOCKS))).mapInArrow(run, "factor int, shard int, rows binary, tokens binary, change binary")
    widths = [t.shape[1] for t in model.weights()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, i, rows, tokens, x in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, i) not in sums:
                    sums[k, i] = np.zeros(SHARD, dtype=np.int64), np.zeros((SHARD, widths[k]))
                r, n = np.frombuffer(rows, dtype="<u2").astype(np.int64) - i * SHARD, np.frombuffer(tokens, dtype="<i8")
                sums[k, i][0][r] += n
                sums[k, i][1][r] += np.frombuffer(x, dtype="<f2").reshape(-1, widths[k]).astype(np.float64) * n[:, None]
        if sums:
            means = [(x / np.maximum(n, 1)[:, None]).astype("<f4").tobytes() for n, x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()), pa.array(means, pa.binary())], ["factor", "shard", "mean"])

    weights = [t.copy() for t in model.weights()]
    for r in changes.repartition("factor", "shard").mapInArrow(add, "factor int, shard int, mean binary").collect():  # at most the size of the model
        k, lo = r["factor"], r["shard"] * SHARD
        weights[k][lo : lo + SHARD] = np.clip(weights[k][lo : lo + SHARD] + np.frombuffer(r["mean"], dtype="<f4").reshape(SHARD, -1), -LIMIT, LIMIT)
    shared.destroy()
    return Model(**(model.__dict__ | dict(zip(("class_weights", "member_weights", "branch_weights", "twig_weights"), weights))))


def _score_block(row: dict, model: Model) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score, score of the block's documents."""
    b = _Block(row, model)
    counts = np.empty(len(b.hashes))
    counts[np.argsort(b.hashes)] = row["c"]
    known = counts > 0
    base = _log_p(counts, model.total, model.distinct)
    klass = np.where(known, b.klass, UNSEEN)
    mass = model.class_bias[klass] if model.leaf_mass is None else model.leaf_mass[b.leaf]
    within = np.where((b.slot >= 0) | ~known, 0.0, base - mass)
    n = len(b.tokens)
    score, tables = within[b.tokens], model.weights()
    for lo in range(0, n, STEP_TOKENS):
        part = slice(lo, min(n, lo + STEP_TOKENS))
        feats, token = [f[part] for f in b.feats], b.tokens[part]
        for k, which, bias, own, outcome in _factors(model, feats, klass[token], b.slot[token], b.leaf[token]):
            z = _logits(bias, tables[k], own)
            score[lo + which] += z[np.arange(len(which)), outcome]
            score[lo + which] -= np.log(_powers(z)[1])
    start = np.cumsum(b.lengths) - b.lengths
    add = lambda x: np.add.reduceat(x, start) if len(start) else x
    return b.lengths, add(known[b.tokens].astype(np.int64)), add(base[b.tokens]) / np.log(10), add(score) / np.log(10)


def score(docs: DataFrame) -> DataFrame:
    """Scores every document, learning from those that aren't held out."""
    spark = docs.sparkSession
    common.prepare(spark)
    blocks = common.materialise(_blocks(docs), "blocks")
    sizes = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_names").alias("names")).first()
    ranges = max(1, -(-(sizes["names"] or 0) // RANGE))
    summed = common.materialise(_summed(_ranged(blocks, ranges), ranges), "counts")
    model = _start(summed)
    for nth in range(ROUNDS):
        model = _round(blocks, model, nth, sizes["blocks"])
    shared = spark.sparkContext.broadcast(model)
    texts = blocks.select("block", F.lit(-1).alias("range"), F.lit(False).alias("wide"), F.col("tokens").alias("packed"), "doc_ids", "held", "lengths", "hashes", "tails")
    answers = summed.where("block IS NOT NULL").select("block", "range", "wide", "packed")
    both = texts.unionByName(answers, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = _rows(batches)
        for _, own in groupby(rows, key=lambda r: r["block"]):
            text, *parts = own  # the block comes first, then its answers by range
            c = np.concatenate([np.frombuffer(r["packed"], dtype="<i8") if r["wide"] else _joined(r["packed"]) for r in parts])
            n, known, base, score_ = _score_block(text | {"tokens": text["packed"], "c": c}, m)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(text["doc_ids"], dtype="<i8")), pa.array(np.frombuffer(text["held"], dtype=bool)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), m.total), pa.int64()), pa.array(base, pa.float64()), pa.array(score_, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.repartition("block").sortWithinPartitions("block", "range").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
