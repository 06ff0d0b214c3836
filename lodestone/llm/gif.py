"""Media columns (operator 6): GIF streams to timed frames with colour histograms.

Decoding reads the blocks of a GIF87a or GIF89a stream, LZW code streams of any code width with early and late
clear codes, global and local palettes, interlaced rows, transparency, and the four disposal methods; each frame is
what a viewer would show at that time. Encoding writes raw samples without loss: rows of 192 grey samples, split into
frames, compressed with LZW. Frames leave the canvas, clear it or bring back what was there, in turns, and a row of
samples that the canvas already shows is stored as transparent, so reading back goes through all of these rules.

`gif_frames` gives one row for each frame, and one row with `error` for a stream that can't be read (frames before the
fault are kept), which includes canvases and frames of more than `MOST_PIXELS` pixels: a viewer would set aside three
bytes for each. Payloads of any length are stored, as more frames. A null stream gives no rows. Payloads of null and
empty texts are one row of blanks. Repeated rows give repeated results; an empty table gives none. Columns besides the
identifier and the text or stream are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents

#: Samples in a row and rows in a frame of an encoded payload; hundredths of a second a frame is shown.
ROW, FRAME_ROWS, DELAY = 192, 64, 10
#: Bins of each colour's histogram.
BINS = 8
MOST_CODES, MOST_BITS = 4096, 12
#: What a viewer sets aside at most for a canvas.
MOST_PIXELS = 1 << 26


class GifError(ValueError):
    pass


# --- LZW ---


def _widths(start: int, count: int, literals: int) -> np.ndarray:
    """Bits of codes number start, start + 1, ... after a clear code; literals: palette size, a power of two."""
    entries = np.minimum(literals + 2 + np.maximum(np.arange(start, start + count) - 1, 0), MOST_CODES - 1)
    return np.frexp(entries.astype(float))[1].astype(np.int64)


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The code stream of samples below 2 ** bits."""
    clear = 1 << bits
    codes, lengths = [clear], [1]
    table: dict[int, int] = {}
    free, since = clear + 2, 1
    if samples:
        prefix = samples[0]
        get = table.get
        for c in samples[1:]:
            key = prefix << 8 | c
            code = get(key)
            if code is None:
                codes.append(prefix)
                if free == MOST_CODES:
                    codes.append(clear)
                    lengths.append(len(codes) - since)
                    since = len(codes)
                    table.clear()
                    free = clear + 2
                else:
                    table[key] = free
                    free += 1
                prefix = c
            else:
                prefix = code
        codes.append(prefix)
    codes.append(clear + 1)
    lengths.append(len(codes) - since)
    # The first code and each run up to and with a clear code count from zero.
    width = np.concatenate([_widths(0, n, clear) for n in lengths])
    values = np.array(codes, np.int64)
    at = np.arange(MOST_BITS)
    return np.packbits(((values[:, None] >> at) & 1).astype(np.uint8)[at < width[:, None]], bitorder="little").tobytes()


def _codes(data: np.ndarray, bit: int, start: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """As many codes as may come before the table is full, read from `bit` on, and where each ends."""
    width = _widths(start, MOST_CODES, literals)
    ends = bit + np.cumsum(width)
    n = int(np.searchsorted(ends, (len(data) - 3) * 8, side="right"))
    width, ends = width[:n], ends[:n]
    begins = ends - width
    byte = begins >> 3
    word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
    return (word >> (begins & 7)) & ((1 << width) - 1), ends


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The first `most` samples of a code stream; a stream may end without its end code."""
    if not 1 <= bits <= 11:
        raise GifError("code size")
    clear = 1 << bits
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    singles = [bytes([i]) if i < 256 else b"" for i in range(clear)] + [b"", b""]
    bit, start, out, size = 0, 0, [], 0
    table, before = singles.copy(), None
    while size < most:
        codes, ends = _codes(data, bit, start, clear)
        if not len(codes):
            break
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(marks[0]) if len(marks) else len(codes)
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
            elif code == len(table) and before is not None:
                entry = before + before[:1]
            else:
                raise GifError("code")
            out.append(entry)
            if before is not None and len(table) < MOST_CODES:
                table.append(before + entry[:1])
            before = entry
        size = sum(map(len, out)) if stop else size
        if len(marks):
            if codes[stop] == clear + 1:
                break
            bit, start = int(ends[stop]), 0
            table, before = singles.copy(), None
        else:
            bit, start = int(ends[-1]), start + len(codes)
    return b"".join(out)[:most]


# --- the container ---


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int  # -1: none
    pixels: np.ndarray  # (height, width, 3) of the whole canvas as shown


def _block(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes."""
    return b"".join(bytes([len(x := data[i : i + 255])]) + x for i in range(0, len(data), 255)) + b"\0"


def _palette(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(-1, 3)


GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


#: What becomes of a frame when the next one is shown, in turns: it stays, the canvas comes back, or its area is cleared.
DISPOSALS = (1, 3, 2)


def encode_gif(samples: bytes, width: int = ROW, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """8-bit samples in rows of `width` as an animated grey GIF; frames lie at the top left corner, the last may be lower.

    If some value is no sample, it stands for transparency, and rows that the canvas shows already are stored so."""
    rows, rest = divmod(len(samples), width)
    if rest or not rows:
        raise ValueError("samples must fill at least one row")
    image = np.frombuffer(samples, np.uint8).reshape(rows, width)
    free = np.flatnonzero(np.bincount(image.ravel(), minlength=256) == 0)
    clear = int(free[-1]) if len(free) else None
    canvas = np.zeros((min(rows, frame_rows), width), np.uint8)
    out = [b"GIF89a", width.to_bytes(2, "little"), min(rows, frame_rows).to_bytes(2, "little"), b"\xf7\0\0", GREY]
    for k, begin in enumerate(range(0, rows, frame_rows)):
        part, disposal = image[begin : begin + frame_rows], DISPOSALS[k % len(DISPOSALS)]
        area = canvas[: len(part)]
        stored = part
        if clear is not None and (shown := (part == area).all(axis=1)).any():
            stored = part.copy()
            stored[shown] = clear
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (clear is not None)]), delay.to_bytes(2, "little"), bytes([clear or 0]), b"\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), len(part).to_bytes(2, "little"), b"\0\x08", _block(lzw_encode(stored.tobytes()))]
        if disposal != 3:
            area[...] = part if disposal == 1 else 0
    return b"".join([*out, b"\x3b"])


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise GifError("the stream ends early")
        self.at += n
        return part

    def number(self) -> int:
        return int.from_bytes(self.take(2), "little")

    def sub_blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)


def _row_order(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a stream, composed; raises GifError where it can't go on."""
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF")
    width, height = r.number(), r.number()
    if width * height > MOST_PIXELS:
        raise GifError("canvas")
    flags = r.take(3)[0]
    common = _palette(r.take(3 << (flags & 7) + 1)) if flags & 0x80 else None
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, transparent = 0, 0, -1
    while True:
        kind = r.take(1)[0]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = r.take(1)[0]
            body = r.sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal = body[0] >> 2 & 7
                delay = int.from_bytes(body[1:3], "little") * 10
                transparent = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise GifError("block")
        left, top, w, h = (r.number() for _ in range(4))
        own = r.take(1)[0]
        palette = _palette(r.take(3 << (own & 7) + 1)) if own & 0x80 else common
        if palette is None:
            raise GifError("no palette")
        if w * h > MOST_PIXELS:
            raise GifError("frame")
        bits = r.take(1)[0]
        samples = np.frombuffer(lzw_decode(r.sub_blocks(), bits, w * h), np.uint8)
        if len(samples) < w * h:
            raise GifError("too few samples")
        samples = samples.reshape(h, w)
        if own & 0x40:
            straight = np.empty_like(samples)
            straight[_row_order(h)] = samples
            samples = straight
        kept = canvas.copy() if disposal == 3 else None
        # What lies outside the canvas isn't shown.
        inside = samples[: max(0, height - top), : max(0, width - left)]
        area = canvas[top : top + h, left : left + w]
        drawn = inside < len(palette)
        if transparent >= 0:
            drawn &= inside != transparent
        colours = palette[np.minimum(inside, len(palette) - 1)]
        if drawn.all():
            area[...] = colours
        else:
            area[drawn] = colours[drawn]
        yield Frame(left, top, w, h, delay, disposal, transparent, canvas.copy())
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = kept
        delay, disposal, transparent = 0, 0, -1


def histograms(pixels: np.ndarray, bins: int = BINS) -> list[list[int]]:
    """Counts of red, green and blue in equal bins."""
    scaled = pixels.reshape(-1, 3) // (256 // bins)
    return [np.bincount(scaled[:, c], minlength=bins).tolist() for c in range(3)]


FRAMES = "media_id long, frame int, at_ms long, delay_ms long, left int, top int, width int, height int, disposal int, transparent int, red array<long>, green array<long>, blue array<long>, pixels_sha256 string, pixels binary, error string"


def gif_frames(media: DataFrame, id_col: str = "doc_id", data_col: str = "data", keep_pixels: bool = True) -> DataFrame:
    """media: an identifier and a binary GIF stream. One row for each frame, as shown."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("media_id", pa.int64()), ("frame", pa.int32()), ("at_ms", pa.int64()), ("delay_ms", pa.int64()), *((n, pa.int32()) for n in ("left", "top", "width", "height", "disposal", "transparent")), *((n, pa.list_(pa.int64())) for n in ("red", "green", "blue")), ("pixels_sha256", pa.string()), ("pixels", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                rows, at, k = [], 0, 0
                try:
                    for k, f in enumerate(decode_gif(data.as_py()), 1):  # noqa: B007
                        raw = f.pixels.tobytes()
                        rows.append([name, k - 1, at, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, *histograms(f.pixels), hashlib.sha256(raw).hexdigest(), raw if keep_pixels else None, None])
                        at += f.delay_ms
                        if len(rows) == 64:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows = []
                except GifError as e:
                    rows.append([name, k, at, *[None] * 12, str(e)])
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return media.select(F.col(id_col).cast("long"), F.col(data_col)).mapInArrow(emit, FRAMES)


def payload_of(text: bytes) -> bytes:
    """The bytes, with blanks up to a positive multiple of a row."""
    return text + b" " * (-len(text) % ROW or (ROW if not text else 0))


def read_back(stored: bytes) -> tuple[bytes, str]:
    """The samples of a stored payload, and its feature: frames, time shown and the sum of the grey histograms."""
    parts, total, shown, n = [], np.zeros(BINS, np.int64), 0, 0
    for f in decode_gif(stored):
        grey = f.pixels[: f.height, : f.width, 0]
        parts.append(grey.tobytes())
        total += np.bincount(grey.ravel() // (256 // BINS), minlength=BINS)
        shown += f.delay_ms
        n += 1
    return b"".join(parts), f"frames={n};ms={shown};grey={','.join(map(str, total.tolist()))}"


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, data binary"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_data: bool = True) -> DataFrame:
    """Texts stored as GIF streams and read back: sizes, digests, feature and the stream of every row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.strip().split()[0] for x in MEDIA.split(",")]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for begin in range(0, len(ids), 64):
                out = []
                for i in range(begin, min(begin + 64, len(ids))):
                    raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                    stored = encode_gif(payload_of(raw))
                    back, feature = read_back(stored)
                    out.append((ids[i], len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, stored if keep_data else None))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(emit, MEDIA)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir), keep_data=False).drop("data")
