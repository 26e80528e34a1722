"""Vectorised text kernels: tokens and hashes of whole Arrow string columns without per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call works on; a longer document is a chunk of its own.
CHUNK = 2_000_000

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTE_LOWER = _BYTE[LOWER]


def _inverse(a: int) -> int:
    return pow(a, -1, 2**64)


_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    have = _powers.get("n", 0)
    if have < n + 1:
        n = max(n + 1, CHUNK + 1)
        with np.errstate(over="ignore"):
            up = np.full(n, _BASE, dtype=np.uint64)
            up[0] = 1
            down = np.full(n, _U(_inverse(int(_BASE))), dtype=np.uint64)
            down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > 4 * CHUNK:  # a very long text: don't keep tables of its size
            return up, down
        _powers.update(n=n, up=up, down=down)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents of about so many bytes together."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ASCII white space, and each document's first token (n+1 positions)."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = word[starts]
    last[starts[1:] - 1] = word[starts[1:] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offsets)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span of bytes, with A-Z as a-z if lower."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.multiply((_BYTE_LOWER if lower else _BYTE)[data], up[: len(data)], out=total[1:])
        np.add.accumulate(total, out=total)
        h = total[end]
        h -= total[begin]
        h *= down[begin]
        h += (end - begin).astype(np.uint64)
    return mix(h)


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> pa.Array:
    """The spans as an Arrow string array."""
    size = end - begin
    off = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=off[1:])
    at = np.repeat(begin - off[:-1], size) + np.arange(off[-1])
    raw = data[at]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(off), pa.py_buffer(LOWER[raw] if lower else raw))


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values within each document's run of tokens; 0 for none."""
    total = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
