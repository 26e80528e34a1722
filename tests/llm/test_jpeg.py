from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from lexigrain.llm import common, jpeg

ZIGZAG = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else -p[1]))


def expected(text):
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
    return len(raw), len(payload), sha256(payload).hexdigest(), crc32(payload[-64:])


def test_round_trip_of_the_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = jpeg.digests(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found} == {i: expected(t) for i, t in rows.items()}
    assert all(0 <= r["tail_crc32"] < 2**32 and r["media_bytes"] > 0 for r in found)


def test_cases(spark):
    long = "long text é " * 60_000  # more rows than one image has
    texts = [None, "", "a", "a" * 64, "b" * 65, "\x00", "same", "same", long]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, media string")
    found = {r["doc_id"]: r for r in jpeg.digests(docs).collect()}
    assert len(long.encode()) > jpeg.ROW * jpeg.MAX_ROWS
    for i, t in enumerate(texts):
        assert tuple(found[i])[1:5] == expected(t)
    assert tuple(found[6])[1:] == tuple(found[7])[1:] and tuple(found[0])[1:] == tuple(found[1])[1:]
    stored = jpeg.store_column(docs)
    assert stored.columns == ["doc_id", "text", "media"]
    media = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    assert all(sha256(media[i]).hexdigest() == found[i]["media_sha256"] and len(media[i]) == found[i]["media_bytes"] for i in media)
    seen = {r["doc_id"]: r for r in jpeg.describe(stored).collect()}
    assert seen[2]["width"] == 512 and seen[2]["height"] == 8 and seen[2]["thumb_sha256"] == expected("a")[2]
    assert jpeg.digests(docs.limit(0)).count() == 0


def test_broken_media_have_no_size(spark):
    good = jpeg.store([jpeg.pad(b"some text that is stored" * 20)])[0]
    media = [None, b"", b"no jpeg", good, good[: len(good) // 2], good[:-2], good.replace(b"\xff\xc0", b"\xff\xc2")]
    found = [r["width"] for r in jpeg.describe(spark.createDataFrame([(i, m) for i, m in enumerate(media)], "i int, media binary").coalesce(1)).orderBy("i").collect()]
    assert found[3] == 512 and [found[i] for i in (0, 1, 2, 4, 6)] == [None] * 5


def encode(image, sampling, restart=0):
    """A plain baseline encoder: grey (sampling 1), or YCbCr with luma sampled `sampling` times each way."""
    h, w = image.shape[:2]
    c = np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8)[:, None] == 0, np.sqrt(1 / 8), 0.5)
    quant = np.arange(8)[:, None] + np.arange(8)[None] + 5
    planes = [image[:, :, 0]] if sampling == 1 else [image[:, :, 0], image[::2, ::2, 1], image[::2, ::2, 2]]
    factors = [1] if sampling == 1 else [2, 1, 1]
    unit = 8 * max(factors)
    across, down = -(-w // unit), -(-h // unit)
    blocks = []
    for p, f in zip(planes, factors):
        full = np.pad(p, ((0, down * f * 8 - p.shape[0]), (0, across * f * 8 - p.shape[1])), mode="edge").astype(float) - 128
        b = full.reshape(down * f, 8, across * f, 8).transpose(0, 2, 1, 3)
        blocks.append(np.rint(c @ b @ c.T / quant).astype(int))
    sizes = list(range(12))
    dc_counts, ac_counts = [0] * 3 + [12] + [0] * 12, [0] * 7 + [162 + 14] + [0] * 8
    ac_symbols = sorted({r << 4 | s for r in range(16) for s in range(1, 11)} | {0, 0xF0} | {r << 4 for r in range(1, 15)})
    dc_code = {s: (k, n) for s, k, n in jpeg.huffman_codes(dc_counts, sizes)}
    ac_code = {s: (k, n) for s, k, n in jpeg.huffman_codes(ac_counts, ac_symbols)}

    def scan(units):
        bits, last = [], [0] * len(planes)

        def number(v):
            s = int(abs(v)).bit_length()
            return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

        for y, x in units:
            for k, f in enumerate(factors):
                for dy in range(f):
                    for dx in range(f):
                        block = blocks[k][y * f + dy, x * f + dx]
                        line = [int(block[p]) for p in ZIGZAG]
                        s, tail = number(line[0] - last[k])
                        last[k] = line[0]
                        bits.append(format(dc_code[s][0], f"0{dc_code[s][1]}b") + tail)
                        run = 0
                        end = max([i for i in range(1, 64) if line[i]], default=0)
                        for v in line[1 : end + 1]:
                            if not v:
                                run += 1
                                continue
                            while run > 15:
                                bits.append(format(ac_code[0xF0][0], f"0{ac_code[0xF0][1]}b"))
                                run -= 16
                            s, tail = number(v)
                            code = ac_code[run << 4 | s]
                            bits.append(format(code[0], f"0{code[1]}b") + tail)
                            run = 0
                        if end < 63:
                            bits.append(format(ac_code[0][0], f"0{ac_code[0][1]}b"))
        raw = "".join(bits)
        raw += "1" * (-len(raw) % 8)
        return int(raw, 2).to_bytes(len(raw) // 8, "big").replace(b"\xff", b"\xff\x00")

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    n = len(planes)
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + segment(0xFE, b"a comment") + segment(0xDB, b"\x00" + bytes(int(quant[p]) for p in ZIGZAG))
    out += segment(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([k + 1, f << 4 | f, 0]) for k, f in enumerate(factors)))
    out += segment(0xC4, b"\x00" + bytes(dc_counts) + bytes(sizes) + b"\x10" + bytes(ac_counts) + bytes(ac_symbols))
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))
    out += segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\x00\x3f\x00")
    units = [(y, x) for y in range(down) for x in range(across)]
    step = restart or len(units)
    parts = [scan(units[i : i + step]) for i in range(0, len(units), step)]
    for i, part in enumerate(parts):
        out += part + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"")
    means = np.clip((blocks[0][: -(-h // 8), : -(-w // 8), 0, 0] * quant[0, 0] + 4) // 8 + 128, 0, 255)
    return out + b"\xff\xd9", means


@pytest.mark.parametrize(("size", "sampling", "restart"), [((40, 56), 1, 0), ((33, 41), 1, 3), ((48, 64), 2, 0), ((35, 50), 2, 2), ((8, 8), 1, 0)])
def test_images_of_another_encoder(size, sampling, restart):
    """DC thumbnails of images with AC coefficients, colour, subsampling and restart markers."""
    rng = np.random.default_rng(7)
    image = np.cumsum(rng.integers(-9, 10, (*size, 3)), axis=1) % 256
    media, means = encode(image, sampling, restart)
    width, height, thumb = jpeg.thumbnails([media])[0]
    assert (height, width) == size
    np.testing.assert_array_equal(thumb, means)
    assert len(jpeg.average_hash(thumb)) == 16
    if size[0] > 8:
        flat, _ = encode(np.full((*size, 3), 90), sampling, restart)
        many = jpeg.thumbnails([media, None, flat, media])
        np.testing.assert_array_equal(many[3][2], means)
        assert many[1] is None and abs(many[2][2].astype(int) - 90).max() <= 1
