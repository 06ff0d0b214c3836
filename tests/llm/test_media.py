import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import gif as G


def test_lzw_round_trips():
    r = random.Random(1)
    for bits in (2, 3, 5, 8):
        for n in (1, 2, 5, 3000, 30_000):
            data = bytes(r.randrange(1 << bits) for _ in range(n))
            assert G.lzw_decode(G.lzw_encode(data, bits), bits, n) == data
    assert G.lzw_decode(G.lzw_encode(b"\0" * 50_000), 8, 50_000) == b"\0" * 50_000


def test_late_clear_codes():
    """A stream that never clears its full table goes on with codes of 12 bits."""
    data = bytes(random.Random(2).randrange(256) for _ in range(9000))
    table, free, codes = {bytes([i]): i for i in range(256)}, 258, [256]
    w = b""
    for c in data:
        if (x := w + bytes([c])) in table:
            w = x
            continue
        codes.append(table[w])
        if free < 4096:
            table[x] = free
            free += 1
        w = bytes([c])
    codes += [table[w], 257]
    value, at = 0, 0
    for code, width in zip(codes, G._widths(0, len(codes), 256).tolist(), strict=True):
        value |= code << at
        at += width
    assert G.lzw_decode(value.to_bytes(at // 8 + 1, "little"), 8, len(data)) == data


def picture(frames, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), width=4, height=4):
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf1\0\0", bytes(x for c in palette for x in c), b"\x21\xfe\x03abc\0"]
    for left, top, w, h, samples, disposal, transparent, delay, interlaced in frames:
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (transparent >= 0)]), delay.to_bytes(2, "little"), bytes([max(transparent, 0)]), b"\0", b"\x2c", *(x.to_bytes(2, "little") for x in (left, top, w, h)), bytes([0x40 * interlaced]), b"\x02", G._block(G.lzw_encode(bytes(samples), 2))]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_interlace():
    full = [1] * 16
    frames = list(G.decode_gif(picture([
        (0, 0, 4, 4, full, 1, -1, 5, False),
        (1, 1, 2, 2, [2, 0, 0, 2], 3, 0, 7, False),  # 0 is transparent; then what was there returns
        (0, 0, 2, 1, [3, 3], 2, -1, 1, False),  # then the area is cleared
        (3, 3, 2, 2, [2] * 4, 0, -1, 0, False),  # partly outside
        (0, 0, 4, 4, [r for k in (0, 2, 1, 3) for r in [k] * 4], 0, -1, 0, True),
    ])))
    red, green, blue, black = ([255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0])
    assert (frames[0].pixels == red).all() and frames[0].delay_ms == 50
    assert frames[1].pixels[1, 1].tolist() == green and frames[1].pixels[1, 2].tolist() == red
    assert frames[2].pixels[1, 1].tolist() == red and frames[2].pixels[0, 0].tolist() == blue
    assert frames[3].pixels[0, 0].tolist() == black and frames[3].pixels[3, 3].tolist() == green
    assert [frames[4].pixels[y, 0].tolist() for y in range(4)] == [black, red, green, blue]


def test_frames_of_a_table(spark):
    good = picture([(0, 0, 4, 4, [1] * 16, 1, -1, 5, False), (0, 0, 1, 1, [2], 1, -1, 5, False)])
    rows = [(1, bytearray(good)), (2, bytearray(good[:60])), (3, bytearray(b"")), (4, None), (1, bytearray(good))]
    got = G.gif_frames(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, data binary, frame int")).collect()
    assert sorted((r.media_id, r.frame, r.at_ms) for r in got if r.error is None and r.media_id == 1) == [(1, 0, 0), (1, 0, 0), (1, 1, 50), (1, 1, 50)]
    assert {r.media_id for r in got if r.error} == {2, 3}
    first = next(r for r in got if r.media_id == 1 and r.frame == 0)
    assert (sum(first.red), first.red[7], first.green[0]) == (16, 16, 16)


def test_texts_come_back(spark, odd_rows, odd_docs, clashing_docs, no_docs):
    want = {}
    for i, t, *_ in odd_rows:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want[str(i), len(raw)] = (len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    for docs in (odd_docs, clashing_docs):
        got = G.text_media(docs).collect()
        assert len(got) == len(odd_rows)
        for r in got:
            assert want[str(r.doc_id), r.n_bytes] == (r.payload_bytes, r.payload_sha256, r.tail_crc32)
            assert (r.media_bytes, r.media_sha256) == (len(r.data), hashlib.sha256(r.data).hexdigest())
    assert G.text_media(no_docs).count() == 0


def test_faults():
    for bad in (b"", b"GIF89a", b"PNG", G.encode_gif(b"a" * 192)[:-30]):
        with pytest.raises(G.GifError):
            list(G.decode_gif(bad))
    assert np.array_equal(np.sort(G._row_order(9)), np.arange(9))


def test_stored_payloads_use_disposal_and_transparency():
    r = random.Random(9)
    rows = [bytes([r.randrange(250)]) * 192 for _ in range(4)]
    samples = b"".join(r.choice(rows) for _ in range(64 * 7 + 5))
    stored = G.encode_gif(samples)
    frames = list(G.decode_gif(stored))
    assert {f.disposal for f in frames} == {1, 2, 3} and all(f.transparent >= 0 for f in frames)
    assert G.read_back(stored)[0] == samples
    every = bytes(range(256)) * 192  # no value is free
    assert all(f.transparent == -1 for f in G.decode_gif(G.encode_gif(every))) and G.read_back(G.encode_gif(every))[0] == every
    black = bytes(192 * 70)  # the canvas is black before anything is drawn
    assert G.read_back(G.encode_gif(black))[0] == black


def plain_lzw(stream, bits):
    """Codes one by one into a list of strings."""
    value, n = int.from_bytes(stream, "little"), 8 * len(stream)
    table, width, at, last, out = [], bits + 1, 0, None, bytearray()
    while at + width <= n:
        code, at = value >> at & (1 << width) - 1, at + width
        if code == 1 << bits:
            table, width, last = [bytes([i]) for i in range(1 << bits)] + [b"", b""], bits + 1, None
        elif code == (1 << bits) + 1:
            break
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return bytes(out)


def plain_frames(data):
    """What the format's text says, pixel by pixel: the canvas after each frame, as rows of colours."""
    assert data[:6] == b"GIF89a"
    width, height = (int.from_bytes(data[i : i + 2], "little") for i in (6, 8))
    at = 13
    common = data[at : at + (3 << (data[10] & 7) + 1)] if data[10] & 0x80 else b""
    at += len(common)
    canvas = [[(0, 0, 0)] * width for _ in range(height)]
    control = (0, None)

    def blocks():
        nonlocal at
        out = b""
        while n := data[at]:
            out, at = out + data[at + 1 : at + 1 + n], at + 1 + n
        at += 1
        return out

    while data[at] != 0x3B:
        kind, at = data[at], at + 1
        if kind == 0x21:
            label, at = data[at], at + 1
            body = blocks()
            if label == 0xF9:
                control = (body[0] >> 2 & 7, body[3] if body[0] & 1 else None)
            continue
        left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (0, 2, 4, 6))
        flags, at = data[at + 8], at + 9
        palette = data[at : at + (3 << (flags & 7) + 1)] if flags & 0x80 else common
        at += len(palette) if flags & 0x80 else 0
        bits, at = data[at], at + 1
        samples = plain_lzw(blocks(), bits)
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)] if flags & 0x40 else range(h)
        before = [list(row) for row in canvas]
        for i, y in enumerate(order):
            for x in range(w):
                s = samples[i * w + x]
                if s != control[1] and top + y < height and left + x < width:
                    canvas[top + y][left + x] = tuple(palette[3 * s : 3 * s + 3])
        yield canvas
        if control[0] == 3:
            canvas = before
        elif control[0] == 2:
            for y in range(top, min(top + h, height)):
                canvas[y][left : left + w] = [(0, 0, 0)] * len(canvas[y][left : left + w])
        control = (0, None)


def test_an_independent_reader_sees_the_same():
    r = random.Random(12)
    frames = [(r.randrange(4), r.randrange(4), w, h, [r.randrange(4) for _ in range(w * h)], r.randrange(4), r.choice([-1, 0, 2]), 5, r.random() < 0.5) for w, h in ((1 + r.randrange(6), 1 + r.randrange(6)) for _ in range(30))]
    odd = picture(frames)
    rows = [bytes([r.randrange(250)]) * 192 for _ in range(4)]
    for data in (odd, G.encode_gif(b"".join(r.choice(rows) for _ in range(130))), G.encode_gif(bytes(r.randrange(256) for _ in range(192 * 66)))):
        seen = 0
        for frame, canvas in zip(G.decode_gif(data), plain_frames(data), strict=True):
            assert frame.pixels.tolist() == [[list(c) for c in row] for row in canvas]
            seen += 1
        assert seen >= 2


def test_payloads_come_back_through_the_independent_reader():
    r = random.Random(13)
    payload = G.payload_of(("süß und " * 700 + "".join(chr(r.randrange(32, 900)) for _ in range(3000))).encode())
    stored, back = G.encode_gif(payload), b""
    for frame, canvas in zip(G.decode_gif(stored), plain_frames(stored), strict=True):
        back += bytes(c[0] for row in canvas[: frame.height] for c in row[: frame.width])
    assert back == payload
