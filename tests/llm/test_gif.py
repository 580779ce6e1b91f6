import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from hitweave.llm import gif as G


def lzw(pixels: bytes, least: int) -> bytes:
    """A plain encoder that fills its table and starts again."""
    clear, end = 1 << least, (1 << least) + 1
    bits, codes = 0, []
    acc = 0

    def put(code, width):
        nonlocal acc, bits
        acc |= code << bits
        bits += width

    def fresh():
        return {bytes([i]): i for i in range(clear)}, end + 1, least + 1

    table, nxt, width = fresh()
    put(clear, width)
    now = b""
    for p in pixels:
        more = now + bytes([p])
        if more in table:
            now = more
            continue
        put(table[now], width)
        if nxt < 4096:
            table[more] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            put(clear, width)
            table, nxt, width = fresh()
        now = bytes([p])
    if now:
        put(table[now], width)
    put(end, width if nxt != 1 << width or width == 12 else width + 1)
    codes = acc.to_bytes(-(-bits // 8), "little")
    return codes


@pytest.mark.parametrize("least,n", [(2, 5), (2, 3000), (4, 500), (8, 1), (8, 700), (8, 60000), (7, 20000)])
def test_lzw_round_trip(least, n):
    r = random.Random(n)
    pixels = bytes(r.choice([r.randrange(1 << least), 0, 1]) for _ in range(n))
    assert G.lzw_decode(lzw(pixels, least), least, n) == pixels


def frame(pixels, w, h, left=0, top=0, disposal=0, delay=5, clear=None, palette=None, interlaced=False, least=2):
    out = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0)
    flags = 0x40 * interlaced | (0x80 | (len(palette).bit_length() - 2) if palette else 0)
    out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags)
    out += b"".join(bytes(c) for c in palette) if palette else b""
    body = lzw(bytes(pixels), least)
    return out + bytes([least]) + b"".join(bytes([len(p)]) + p for p in (body[i : i + 255] for i in range(0, len(body), 255))) + b"\0"


RGB = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]


def file(*frames, w=2, h=2):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + b"".join(map(bytes, RGB)) + b"".join(frames) + b";"


def colours(f):
    return [[tuple(p[:3]) if p[3] else None for p in row] for row in f.pixels.tolist()]


def test_disposal_transparency_and_palettes():
    r, g, b, k = RGB[1], RGB[2], RGB[3], RGB[0]
    fs = list(G.frames(file(
        frame([1, 1, 1, 1], 2, 2, disposal=1, delay=7),
        frame([2, 3], 2, 1, disposal=3, clear=3),
        frame([3], 1, 1, left=1, top=1, disposal=2),
        frame([0, 1], 1, 2, palette=[(9, 9, 9), (8, 8, 8)], clear=1),
    )))
    assert colours(fs[0]) == [[r, r], [r, r]]
    assert colours(fs[1]) == [[g, r], [r, r]]  # one pixel is transparent
    assert colours(fs[2]) == [[r, r], [r, b]]  # the frame before is undone
    assert colours(fs[3]) == [[(9, 9, 9), r], [r, None]]  # background is restored
    assert [(f.start_ms, f.duration_ms) for f in fs] == [(0, 70), (70, 50), (120, 50), (170, 50)]
    h = G.histogram(fs[3].pixels)
    assert h.sum() == 3 and h[0] == 1 and h[48] == 2 and k


def test_interlaced_rows():
    rows = [i % 4 for i in range(10)]
    order = [*range(0, 10, 8), *range(4, 10, 8), *range(2, 10, 4), *range(1, 10, 2)]
    f = next(G.frames(file(frame([rows[i] for i in order], 1, 10, interlaced=True), w=1, h=10)))
    assert [c[0] for c in colours(f)] == [RGB[i] for i in rows]


def test_broken_files_give_what_is_whole():
    data = file(frame([1, 2, 3, 0], 2, 2), frame([1, 1, 1, 1], 2, 2))
    assert len(list(G.frames(data))) == 2
    for n in range(len(data)):
        assert len(list(G.frames(data[:n]))) <= 2
    assert not list(G.frames(None)) and not list(G.frames(b"")) and not list(G.frames(b"PNG" * 9))


def test_payload_round_trip():
    for n in (0, 1, 575, 576, 577, 600000):
        body = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        p = G.pad(body)
        assert len(p) % 576 == 0 and p[:n] == body and set(p[n:]) <= {255} and p
        assert b"".join(f.pixels[:, :, 0].tobytes() for f in G.frames(G.store(p))) == p


def test_digest_of_documents(odd, empty):
    got = G.media_digest(G.store_texts(odd)).collect()
    texts = {(r.doc_id, len((r.text or "").encode())): r.text for r in odd.collect()}
    assert len(got) == 11
    for r in got:
        p = G.pad((texts[r.doc_id, r.n_bytes] or "").encode())
        assert r.payload_bytes == len(p) and r.payload_sha256 == hashlib.sha256(p).hexdigest()
        assert r.tail_crc32 == zlib.crc32(p[-32:]) and r.media_sha256 == hashlib.sha256(G.store(p)).hexdigest()
        assert sum(r.histogram) == len(p) and r.frames == len(p) // 576
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert G.media_digest(G.store_texts(empty)).count() == 0


def test_frames_of_files(spark):
    data = file(frame([1, 1, 1, 1], 2, 2), frame([2], 1, 1))
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"x"))], "id long, gif binary")
    got = sorted(G.gif_frames(df).collect(), key=lambda r: r.frame)
    assert [(r.id, r.frame, r.width, r.height) for r in got] == [(1, 0, 2, 2), (1, 1, 2, 2)]
    assert bytes(got[1].rgba) == bytes([0, 255, 0, 255] + [255, 0, 0, 255] * 3)
