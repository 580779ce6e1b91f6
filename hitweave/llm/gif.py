"""GIF columns: files are decoded into timed frames with colour histograms; byte payloads are stored as frames.

Decoding follows the 89a format: LZW code streams, global and local palettes, interlacing, transparency, and the
disposal rules (keep, restore to background, restore to previous) on one canvas. A frame row holds the composed
canvas as RGBA bytes, its start and length in ms, and a histogram of its visible pixels with ``BINS`` colours (two
bits of each channel).

Storing takes one byte for a pixel: a payload of k x 576 bytes becomes k frames of 24 x 24 grey pixels. Its code
streams hold literal codes with a clear code every 192 pixels, so that codes stay 9 bits wide; any decoder reads them.

Defined cases: null bytes or a file without the GIF signature give no frames; a cut file gives the frames before the
cut, a cut code stream leaves its missing pixels as they were; a delay of 0 counts as 0 ms.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 24
UNIT = SIDE * SIDE
RUN = 192  # literals after a clear code: 258 + 192 entries stay below 512
BINS = 64
DELAY_CS = 4
GROUP = 256  # frames that are packed at once
_GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


@dataclass
class Frame:
    index: int
    start_ms: int
    duration_ms: int
    disposal: int
    transparent: bool
    pixels: np.ndarray  # height x width x 4


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Visible pixels by the two upper bits of red, green and blue."""
    p = pixels.reshape(-1, 4)
    bins = (p[:, 0] >> 6 << 4) + (p[:, 1] >> 6 << 2) + (p[:, 2] >> 6)
    shown = p[:, 3] > 0
    return np.bincount(bins if shown.all() else bins[shown], minlength=BINS)


def lzw_codes(data: bytes, width: int) -> np.ndarray:
    """All codes of a stream of codes of one width, lowest bit first."""
    n = len(data) * 8 // width
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    codes = np.packbits(bits[:, :8], axis=1, bitorder="little")[:, 0].astype(np.int32)
    for i in range(8, width):
        codes += bits[:, i].astype(np.int32) << i
    return codes


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """Pixels of a code stream; ``least`` is the size of literal codes in bits, ``most`` the pixels wanted."""
    clear, end = 1 << least, (1 << least) + 1
    codes = lzw_codes(data, least + 1)
    stop = np.flatnonzero(codes == end)
    if len(stop):
        # while every run between clear codes is short, the table never outgrows the first width
        codes = codes[: stop[0]]
        at = np.flatnonzero(codes == clear)
        runs = np.diff(np.concatenate([[-1], at, [len(codes)]])) - 1
        if runs.max() <= clear - 1 and (codes <= clear).all():
            return codes[codes != clear].astype(np.uint8).tobytes()[:most]
    out = bytearray()
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    width, acc, have, last = least + 1, 0, 0, b""
    for byte in data:
        acc |= byte << have
        have += 8
        while have >= width:
            code, acc, have = acc & ((1 << width) - 1), acc >> width, have - width
            if code == clear:
                del table[end + 1 :]
                width, last = least + 1, b""
            elif code == end or len(out) >= most:
                return bytes(out[:most])
            else:
                if code < len(table):
                    now = table[code]
                elif code == len(table) and last:
                    now = last + last[:1]
                else:
                    return bytes(out[:most])
                out += now
                if last and len(table) < 4096:
                    table.append(last + now[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
                last = now
    return bytes(out[:most])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Data of a chain of sub-blocks and the position after it."""
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(parts), at + 1


def _palette(rgb: bytes) -> np.ndarray:
    """Opaque colours of a palette, one row each."""
    p = np.frombuffer(rgb, np.uint8).reshape(-1, 3)
    return np.hstack([p, np.full((len(p), 1), 255, np.uint8)])


def frames(data: bytes | None) -> Iterator[Frame]:
    if not data or data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, common = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        common = _palette(data[at : at + size].ljust(size, b"\0"))
        at += size
    canvas = np.zeros((height, width, 4), np.uint8)
    index = clock = disposal = delay = 0
    clear_index: int | None = None
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            body, to = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else None
            at = to
        elif kind == 0x2C and at + 10 < len(data):
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = common
            if flags & 0x80:
                size = 3 << ((flags & 7) + 1)
                palette = _palette(data[at : at + size].ljust(size, b"\0"))
                at += size
            if at >= len(data) or palette is None:
                return
            least = data[at]
            body, at = _blocks(data, at + 1)
            got = np.frombuffer(lzw_decode(body, least, w * h), np.uint8)
            cells = np.full(w * h, -1, np.int16)
            cells[: len(got)] = got
            cells = cells.reshape(h, w)
            if flags & 0x40:
                rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(cells)
                straight[rows] = cells
                cells = straight
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            cells = cells[: area.shape[0], : area.shape[1]]
            shown = (cells >= 0) & (cells < len(palette))
            if clear_index is not None:
                shown &= cells != clear_index
            if shown.all():
                area[:] = palette[cells]
            else:
                area[shown] = palette[cells[shown]]
            yield Frame(index, clock, delay * 10, disposal, clear_index is not None, canvas.copy())
            index, clock = index + 1, clock + delay * 10
            if disposal == 2:
                area[:] = 0
            elif before is not None:
                canvas = before
            disposal, delay, clear_index = 0, 0, None
        else:
            return


def pad(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of ``UNIT``."""
    return payload + b"\xff" * (-len(payload) % UNIT if payload else UNIT)


def store(payload: bytes) -> bytes:
    """A GIF with one frame for each ``UNIT`` bytes of a padded payload."""
    n = len(payload) // UNIT
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _GREY
    before = b"\x21\xf9\x04" + struct.pack("<BHBB", 0, DELAY_CS, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    out = [head]
    for at in range(0, n, GROUP):
        body = np.frombuffer(payload, np.uint8)[at * UNIT : (at + GROUP) * UNIT].reshape(-1, UNIT // RUN, RUN)
        codes = np.full((len(body), UNIT // RUN, RUN + 1), 256, np.int32)
        codes[:, :, 1:] = body
        codes = np.concatenate([codes.reshape(len(body), -1), np.full((len(body), 1), 257, np.int32)], axis=1)
        bits = (codes[:, :, None] >> np.arange(9)) & 1
        packed = np.packbits(bits.reshape(len(body), -1).astype(np.uint8), axis=1, bitorder="little")
        for row in packed:
            stream = row.tobytes()
            out.append(before + b"".join(bytes([len(p := stream[i : i + 255])]) + p for i in range(0, len(stream), 255)) + b"\0")
    return b"".join(out) + b"\x3b"


FRAMES = (
    "frame long, start_ms long, duration_ms long, width int, height int, disposal int, transparent boolean, "
    "rgba binary, histogram array<long>"
)


def gif_frames(files: DataFrame, key: str = "id", column: str = "gif") -> DataFrame:
    """One row for each frame of each file: ``key``, timing, size, rules, composed pixels, histogram."""
    kind = files.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                for f in frames(data.as_py()):
                    h, w, _ = f.pixels.shape
                    row = [f.index, f.start_ms, f.duration_ms, w, h, f.disposal, f.transparent, f.pixels.tobytes(), histogram(f.pixels).tolist()]
                    types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_(), pa.binary(), pa.list_(pa.int64())]
                    cols = [pa.array([k.as_py()], batch.schema.field(0).type)] + [pa.array([v], t) for v, t in zip(row, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names)

    names = [key, *(x.split()[0] for x in FRAMES.split(", "))]
    return files.select(key, column).mapInArrow(decode, f"`{key}` {kind}, {FRAMES}")


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as GIF files: ``key, n_bytes, gif``. Equal texts give equal files; a null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                body = (t.as_py() or "").encode()
                cols = [pa.array([k.as_py()], batch.schema.field(0).type), pa.array([len(body)], pa.int64()), pa.array([store(pad(body))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [key, "n_bytes", "gif"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(encode, f"`{key}` {kind}, n_bytes long, gif binary")


DIGEST = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames long, duration_ms long, histogram array<long>"
)


def _digest(data: bytes) -> list:
    payload, crc, tail, total = hashlib.sha256(), 0, b"", 0
    hist, count, clock = np.zeros(BINS, np.int64), 0, 0
    for f in frames(data):
        part = f.pixels[:, :, 0].tobytes()
        payload.update(part)
        tail = (tail + part)[-32:]
        total += len(part)
        hist += histogram(f.pixels)
        count, clock = count + 1, f.start_ms + f.duration_ms
    crc = zlib.crc32(tail)
    feature = f"{count}x{clock}ms:" + ",".join(f"{i}={v}" for i, v in enumerate(hist.tolist()) if v)
    return [total, payload.hexdigest(), crc, len(data), hashlib.sha256(data).hexdigest(), feature, count, clock, hist.tolist()]


def media_digest(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored bytes hold: the payload read back from the frames, and sums over the frames.

    Frames are decoded one at a time and never gathered.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "duration_ms", "histogram"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(x.as_py()) for x in batch.column(2)]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], [key, "n_bytes", *names])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "n_bytes", "gif").mapInArrow(read, f"`{key}` {kind}, n_bytes long, {DIGEST}")
