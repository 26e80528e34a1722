"""Baseline JPEG in numpy: read DC-only luminance thumbnails, and store bytes as such thumbnails.

Reading parses the markers, splits the scan at restart markers and Huffman-decodes all restart
intervals of all images of a batch in lock step: one table look-up per symbol serves every
interval at once. Only DC coefficients of the first component are kept; dequantised and divided
by 8 they are the thumbnail, one sample per 8x8 block.

Storing is the reverse: each byte is the one sample of a flat 8x8 block, so its quantised DC
coefficient (step 8) is the byte less 128 and the thumbnail read back is the payload, exactly.
A row holds 64 blocks and is one restart interval; after 8191 rows, JPEG's limit, another image
follows in the same stream.

Cases: null text counts as empty and is padded to one row of zeros; equal texts give equal
values; media null, empty or no baseline JPEG give null dimensions and hashes; truncated scans give null
as well; texts are never cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from . import common, kernels

ROW = 64
MAX_ROWS = 65535 // 8

#: Code lengths (1 to 16 bits) and symbols of the usual table for luminance DC categories.
DC_COUNTS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
#: AC table of stored payloads: the end of the block is all that occurs.
AC_COUNTS, AC_SYMBOLS = [1] + [0] * 15, [0]


def huffman_codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits: length of the code they begin with << 8 | its symbol; 0 for no code."""
    table = np.zeros(65536, dtype=np.int32)
    for symbol, code, length in huffman_codes(counts, symbols):
        at = code << (16 - length)
        table[at : at + (1 << (16 - length))] = length << 8 | symbol
    return table


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = {s: (c, n) for s, c, n in huffman_codes(DC_COUNTS, DC_SYMBOLS)}
    value, length = np.zeros(511, dtype=np.int64), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255] = (code << size | extra) << 1  # and the 1-bit end of block, 0
        length[d + 255] = n + size + 1
    return value, length


VALUE, LENGTH = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([8] * 64))
        + _segment(0xC0, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]))
        + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))
        + _segment(0xDD, ROW.to_bytes(2, "big"))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _scans(samples: np.ndarray, phase: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded rows of 64 samples, each followed by its restart marker unless last; and where each row ends."""
    n = len(samples)
    dc = samples.astype(np.int64)
    dc -= 128
    diff = dc.copy()
    diff[:, 1:] -= dc[:, :-1]
    diff += 255
    length = LENGTH[diff]
    end = np.cumsum(length, axis=1)
    begin = end - length
    shift = 24 - length - (begin & 7)
    width = 124
    at = (begin >> 3) + np.arange(0, n * width, width)[:, None]
    total = end[:, -1]
    window = np.bincount(at.ravel(), weights=(VALUE[diff] << shift).ravel(), minlength=n * width).astype(np.int64)
    raw = window >> 16
    raw[1:] += (window[:-1] >> 8) & 255
    raw[2:] += window[:-2] & 255
    raw = raw.astype(np.uint8).reshape(n, width)
    size = (total + 7) >> 3
    raw[np.arange(n), size - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)  # fill bits
    used = np.arange(width) < size[:, None]
    flat, row = raw[used], np.repeat(np.arange(n), size)
    stuffed = flat == 255
    marks = 2 * ~last
    before = np.cumsum(marks) - marks
    pos = np.arange(len(flat)) + np.cumsum(stuffed) - stuffed + before[row]
    stuff_per_row = np.bincount(row, weights=stuffed, minlength=n).astype(np.int64)
    ends = np.cumsum(size + stuff_per_row + marks)
    out = np.zeros(ends[-1], dtype=np.uint8)
    out[pos] = flat
    out[ends[~last] - 2] = 255
    out[ends[~last] - 1] = 0xD0 + phase[~last]
    return out, ends


def store(payloads: list[bytes]) -> list[bytes]:
    """Streams of baseline JPEGs whose thumbnails are the payloads; each a positive multiple of 64 bytes."""
    rows = np.array([len(p) // ROW for p in payloads])
    if not len(rows):
        return []
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, ROW)
    first = np.cumsum(rows) - rows
    within = np.arange(len(samples)) - np.repeat(first, rows)
    frame_row = within % MAX_ROWS
    last = (frame_row == MAX_ROWS - 1) | (within == np.repeat(rows, rows) - 1)
    out, ends = _scans(samples, (frame_row % 8).astype(np.uint8), last)
    raw, streams, at = out.tobytes(), [], 0
    for f, n in zip(first.tolist(), rows.tolist()):
        parts = []
        for lo in range(0, n, MAX_ROWS):
            hi = min(n, lo + MAX_ROWS)
            stop = int(ends[f + hi - 1])
            parts += [header(hi - lo), raw[at:stop], b"\xff\xd9"]
            at = stop
        streams.append(b"".join(parts))
    return streams


@dataclass
class Scan:
    """One entropy-coded scan that holds the first component."""

    width: int
    height: int
    quant: int
    #: (component, horizontal, vertical sampling, DC table, AC table) of the scan
    parts: list[tuple[int, int, int, bytes, bytes]]
    sampling: tuple[int, int]
    restart: int
    start: int
    stop: int = 0
    dc: list[np.ndarray] = field(default_factory=list)

    def blocks(self) -> tuple[int, int]:
        """MCUs across and down."""
        if len(self.parts) == 1:
            _, h, v, *_ = self.parts[0]
            w, t = -(-self.width * h // self.sampling[0]), -(-self.height * v // self.sampling[1])
            return -(-w // 8), -(-t // 8)
        return -(-self.width // (8 * self.sampling[0])), -(-self.height // (8 * self.sampling[1]))

    def plan(self) -> list[int]:
        """Component of each block of an MCU."""
        return [0] if len(self.parts) == 1 else [i for i, (_, h, v, *_x) in enumerate(self.parts) for _ in range(h * v)]


def parse(media: bytes, base: int, ends: np.ndarray) -> list[Scan]:
    """The scans of a stream that begins at base of the batch; ends: where in the batch markers follow scans."""
    n, at, found = len(media), 0, []
    quants, tables, comps, dims, restart = {}, {}, {}, (0, 0), 0
    while at + 1 < n:
        if media[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0xD8:
            quants, tables, comps, dims, restart = {}, {}, {}, (0, 0), 0
            at += 2
        elif marker == 0xD9 or 0xD0 <= marker <= 0xD7 or marker == 1:
            at += 2
        else:
            size = int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            if size < 2 or len(body) != size - 2:
                raise ValueError("a segment is cut short")
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quants[body[0] & 15] = int.from_bytes(body[1 : 2 + bool(wide)], "big")
                    body = body[1 + 64 * (1 + bool(wide)) :]
            elif marker == 0xC4:
                while body:
                    k = sum(body[1:17])
                    tables[body[0]] = bytes(body[1 : 17 + k])
                    body = body[17 + k :]
            elif marker == 0xC0 or marker == 0xC1:
                if body[0] != 8:
                    raise ValueError("samples aren't of 8 bits")
                dims = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
                comps = {body[6 + 3 * i]: (i, body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
                if not all(dims) or not comps:
                    raise ValueError("no size")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                parts = []
                for i in range(body[0]):
                    index, h, v, _ = comps[body[1 + 2 * i]]
                    t = body[2 + 2 * i]
                    parts.append((index, h, v, tables[t >> 4], tables[0x10 | t & 15]))
                k = int(np.searchsorted(ends, base + at))
                stop = int(ends[k]) - base if k < len(ends) else n
                if stop > n:
                    raise ValueError("the scan doesn't end")
                if parts[0][0] == 0:
                    sampling = max(c[1] for c in comps.values()), max(c[2] for c in comps.values())
                    quant = next(c[3] for c in comps.values() if c[0] == 0)
                    found.append(Scan(*dims, quants[quant], parts, sampling, restart, base + at, base + stop))
                at = stop
    if not found:
        raise ValueError("no scan")
    return found


def _decode(window: np.ndarray, bit: np.ndarray, limit: np.ndarray, mcus: np.ndarray, plan: list[int], tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """DC coefficients of component 0 of every interval, padded to the longest, and whether each interval decoded."""
    order = np.argsort(-mcus, kind="stable")
    bit, limit, count = bit[order].copy(), limit[order], mcus[order]
    top, own = len(window) - 1, plan.count(0)
    out = np.zeros((int(count[0]) * own, len(bit)), dtype=np.int32)
    good = np.ones(len(bit), dtype=bool)
    preds = [np.zeros(len(bit), dtype=np.int64) for _ in tables]
    k = 0

    def peek(at: np.ndarray) -> np.ndarray:
        return (window[np.minimum(at >> 3, top)] >> (16 - (at & 7))) & 0xFFFF

    for m in range(int(count[0])):
        live = int(np.searchsorted(-count, -m, "left"))
        b = bit[:live]
        for c in plan:
            dc, ac = tables[c]
            hit = dc[peek(b)]
            size = hit & 255
            good[:live] &= (hit > 0) & (size <= 11)
            b += hit >> 8
            extra = peek(b) >> (16 - np.minimum(size, 16))
            b += size
            half = (1 << size) >> 1
            value = extra - np.where(extra < half, (1 << size) - 1, 0)
            pred = preds[c][:live]
            pred += value
            if c == 0:
                out[k, :live] = pred
                k += 1
            hit = ac[peek(b)]
            b += hit >> 8
            busy = np.flatnonzero((hit & 255) != 0)
            if len(busy) or not hit.all():
                good[:live] &= hit > 0
                symbol, done = hit[busy] & 255, np.ones(len(busy), dtype=np.int64)
                while len(busy):
                    size, run = symbol & 15, symbol >> 4
                    b[busy] += size
                    done += run + 1
                    more = (done < 64) & ~((size == 0) & (run < 15))
                    busy, done = busy[more], done[more]
                    if not len(busy):
                        break
                    hit = ac[peek(b[busy])]
                    good[busy] &= hit > 0
                    b[busy] += hit >> 8
                    more = ((hit & 255) != 0) & (hit > 0)
                    busy, done, symbol = busy[more], done[more], hit[more] & 255
    good &= bit <= limit
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return out.T[back], good[back]


def thumbnails(media: list[bytes | None]) -> list[tuple[int, int, np.ndarray] | None]:
    """Width, height and thumbnail of each stream; the images of one stream are stacked. None if it can't be read."""
    raw = b"".join(m or b"" for m in media)
    if not raw:
        return [None] * len(media)
    buf = np.frombuffer(raw, dtype=np.uint8)
    ff = np.flatnonzero(buf[:-1] == 255)
    after = buf[ff + 1]
    is_restart = (after >= 0xD0) & (after <= 0xD7)
    ends = ff[(after != 0) & (after != 255) & ~is_restart]
    restarts = ff[is_restart]
    scans: list[list[Scan] | None] = []
    base = 0
    for m in media:
        try:
            scans.append(parse(m, base, ends) if m else None)
        except (ValueError, KeyError, IndexError, StopIteration):
            scans.append(None)
        base += len(m or b"")
    keep = np.ones(len(buf) + 1, dtype=bool)  # bytes that are data: neither stuffed zeros nor restart markers
    keep[ff[after == 0] + 1] = False
    keep[restarts] = False
    keep[restarts + 1] = False
    place = np.cumsum(keep) - keep
    data = np.concatenate([buf[keep[:-1]], np.full(4, 255, dtype=np.uint8)]).astype(np.int64)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    groups = defaultdict(list)
    for s in (s for each in scans if each for s in each):
        groups[tuple(s.plan()), tuple((p[3], p[4]) for p in s.parts)].append(s)
    bad = set()
    for (plan, tables), members in groups.items():
        starts, stops, mcus, owner = [], [], [], []
        for i, s in enumerate(members):
            across, down = s.blocks()
            total = across * down
            step = s.restart or total
            lo, hi = np.searchsorted(restarts, (s.start, s.stop))
            cuts = restarts[lo:hi]
            want = -(-total // step)
            if len(cuts) != want - 1:
                bad.add(id(s))
                continue
            starts.append(np.concatenate([[s.start], cuts + 2]))
            stops.append(np.concatenate([cuts, [s.stop]]))
            mcus.append(np.minimum(step, total - step * np.arange(want)))
            owner.append(np.full(want, i))
        if not starts:
            continue
        starts, stops, mcus, owner = map(np.concatenate, (starts, stops, mcus, owner))
        pair = [(lookup(list(d[:16]), list(d[16:])), lookup(list(a[:16]), list(a[16:]))) for d, a in tables]
        # window index of a byte of the batch: place; stop is where the next marker is
        dc, good = _decode(window, place[starts] * 8, place[stops] * 8, mcus, list(plan), pair)
        edges = np.searchsorted(owner, np.arange(len(members) + 1))
        own = plan.count(0)
        for i, s in enumerate(members):
            lo, hi = int(edges[i]), int(edges[i + 1])
            if lo == hi:
                continue
            if not good[lo:hi].all():
                bad.add(id(s))
                continue
            if (mcus[lo:hi] == mcus[lo]).all():
                s.dc = [dc[lo:hi, : int(mcus[lo]) * own].ravel()]
            else:
                s.dc = [dc[j, : int(mcus[j]) * own] for j in range(lo, hi)]
    out: list[tuple[int, int, np.ndarray] | None] = []
    for each in scans:
        if not each or any(id(s) in bad for s in each):
            out.append(None)
            continue
        stack = []
        for s in each:
            flat = np.concatenate(s.dc)
            across, down = s.blocks()
            _, h, v, *_ = s.parts[0]
            if len(s.parts) == 1:
                h = v = 1
            image = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            rows, cols = -(-s.height * s.parts[0][2] // (8 * s.sampling[1])), -(-s.width * s.parts[0][1] // (8 * s.sampling[0]))
            stack.append(np.clip((image[:rows, :cols] * s.quant + 4) // 8 + 128, 0, 255).astype(np.uint8))
        same = len({x.shape[1] for x in stack}) == 1
        out.append((each[0].width, sum(s.height for s in each) if same else each[0].height, np.concatenate(stack) if same else stack[0]))
    return out


def _cells(sums: np.ndarray, n: int) -> np.ndarray:
    """Means over 8 runs along axis 0 of running sums; shorter axes repeat."""
    lo = np.arange(8) * n // 8
    hi = np.maximum(lo + 1, (np.arange(1, 9) * n) // 8)
    return (sums[hi] - sums[lo]) / (hi - lo).reshape(8, *[1] * (sums.ndim - 1))


def average_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which cells of an 8x8 reduction are above their mean."""
    rows, cols = thumb.shape
    down = np.zeros((rows + 1, cols))
    np.cumsum(thumb, axis=0, out=down[1:])
    down = _cells(down, rows)
    right = np.zeros((cols + 1, 8))
    np.cumsum(down.T, axis=0, out=right[1:])
    cells = _cells(right, cols).T
    return np.packbits(cells > cells.mean()).tobytes().hex()


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW if text else ROW)


def _digest_batch(texts: list[bytes]) -> list[tuple]:
    payloads = [pad(t) for t in texts]
    media = store(payloads)
    out = []
    for t, m, read in zip(texts, media, thumbnails(media)):
        w, h, thumb = read
        back = thumb.tobytes()
        out.append((len(t), len(back), sha256(back).hexdigest(), crc32(back[-64:]), len(m), sha256(m).hexdigest(), f"{w}x{h}:{average_hash(thumb)}"))
    return out


NAMES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def digests(docs: DataFrame) -> DataFrame:
    """Stores each text as JPEG, reads it back and describes both; one narrow pass without a shuffle."""
    common.prepare(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.strings(batch.column(1))
            raw, rows = data.tobytes(), []
            for lo, hi in kernels.chunks(off):
                rows += _digest_batch([raw[off[i] : off[i + 1]] for i in range(lo, hi)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 7, kinds))], ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """media with the size and thumbnail hashes of the column's baseline JPEGs; columns of these names are replaced."""
    common.prepare(media.sparkSession)
    names = ["width", "height", "thumb_ahash", "thumb_sha256"]
    rest = media.drop(*names)
    at = rest.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = batch.column(at), []
            _, off = kernels.strings(values)
            for lo, hi in kernels.chunks(off):
                for read in thumbnails([v.as_py() for v in values[lo:hi]]):
                    rows.append((None,) * 4 if read is None else (read[0], read[1], average_hash(read[2]), sha256(read[2].tobytes()).hexdigest()))
            cols = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string())))], [*batch.schema.names, *names])

    schema = StructType([*rest.schema.fields]).add("width", LongType()).add("height", LongType()).add("thumb_ahash", StringType()).add("thumb_sha256", StringType())
    return rest.mapInArrow(run, schema)


def store_column(docs: DataFrame, column: str = "text", output: str = "media") -> DataFrame:
    """docs with the column's text stored as JPEG; a column of the output's name is replaced."""
    from pyspark.sql.types import BinaryType

    common.prepare(docs.sparkSession)
    rest = docs.drop(output)
    at = rest.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.strings(batch.column(at))
            raw, media = data.tobytes(), []
            for lo, hi in kernels.chunks(off):
                media += store([pad(raw[off[i] : off[i + 1]]) for i in range(lo, hi)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary())], [*batch.schema.names, output])

    return rest.mapInArrow(run, StructType([*rest.schema.fields]).add(output, BinaryType()))
