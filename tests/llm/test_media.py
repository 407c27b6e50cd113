"""GIF round trips, and decoding of palettes, disposal, transparency, interlacing and damage."""

import hashlib
import random
import struct
import zlib

import pytest

from loomline.llm import gif


def pixels(index, least=8):
    codes, resets = gif.lzw_codes(bytes(index))
    assert least == 8
    return bytes([8]) + gif.blocks(gif.pack_codes(codes, resets))


def test_round_trip():
    r = random.Random(3)
    for n in (64, 128, 640, 64 * 700, 64 * 2500):
        for data in (bytes(r.randrange(256) for _ in range(n)), b"ab" * (n // 2), bytes(n), ("the quick fox " * n).encode()[:n]):
            frames = gif.decode(gif.encode(data))
            assert b"".join(f.samples for f in frames) == data
            assert len(frames) == -(-n // 65536) and frames[0].delay_ms == 100
            assert (gif.histogram(frames[:1]).sum(1) == frames[0].width * frames[0].height).all()
    assert gif.payload_of(b"") == bytes(64) and len(gif.payload_of(b"x" * 64)) == 64 and len(gif.payload_of(b"x" * 65)) == 128


def test_deferred_clear():
    data = bytes(random.Random(2).randrange(256) for _ in range(9000))
    known, codes, prefix = {}, [256], data[0]
    for b in data[1:]:  # no clear code once the table is full
        if (key := prefix << 8 | b) in known:
            prefix = known[key]
            continue
        codes.append(prefix)
        if len(known) < 4096 - 258:
            known[key] = 258 + len(known)
        prefix = b
    codes += [prefix, 257]
    assert gif.lzw_decode(gif.pack_codes(codes, [0]), 8, len(data)) == data


def test_frames():
    palette = bytes([255, 0, 0, 0, 255, 0] + [0] * (3 * 254))
    control = lambda disposal, clear: b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 5, clear or 0, 0)
    image = lambda x, y, w, h, data, flags=0: b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + pixels(data)
    raw = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0xF7, 0, 0) + palette
    raw += control(1, None) + image(0, 0, 2, 2, [0, 0, 0, 0])
    raw += control(3, 1) + image(0, 0, 2, 1, [1, 0])  # transparent 1
    raw += control(2, None) + image(1, 1, 1, 1, [1])
    raw += b"\x21\xfe\x02hi\x00" + control(0, None) + image(0, 0, 1, 2, [1, 1]) + b"\x3b"
    a, b, c, d = gif.decode(raw)
    red, green, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 0, 0]
    assert a.canvas.tolist() == [[red, red], [red, red]]
    assert b.canvas.tolist() == a.canvas.tolist() and b.delay_ms == 50
    assert c.canvas.tolist() == [[red, red], [red, green]]
    assert d.canvas.tolist() == [[green, red], [green, none]]
    tall = bytes(range(16))
    laced = bytes(tall[y] for s, t in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(s, 16, t))
    raw = b"GIF87a" + struct.pack("<HHBBB", 1, 16, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 16, 0xC7) + palette + pixels(laced) + b"\x3b"
    assert gif.decode(raw)[0].samples == tall
    for cut in range(1, len(raw)):
        with pytest.raises(gif.GifError):
            gif.decode(raw[:-cut])


def test_query_rows(spark):
    rows = [(1, "abc", 0), (2, None, 0), (None, "é" * 50, 0), (3, "abc", 1), (3, "abc", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = gif.decoded(gif.media(docs)).collect()
    assert len(got) == 5
    for x in got:
        text = next(t for d, t, _ in rows if d == x.doc_id) or ""
        assert b"".join(f.samples for f in x.frames) == gif.payload_of(text.encode())
        assert x.media_sha256 == hashlib.sha256(gif.encode(gif.payload_of(text.encode()))).hexdigest()
    assert gif.media(docs.filter("doc_id > 9")).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in gif.op8_media_gif(spark, str(tmp_path)).collect()}
    p = b"abc" + bytes(61)
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (3, 64, hashlib.sha256(p).hexdigest(), zlib.crc32(p))
    assert got[2].feature.startswith("frames=1;red=64,0,") and got[2].n_bytes == 0


def test_whole_frames_are_counted_by_index():
    """Frames that are shown alone are counted by palette index; the counts are those of their pixels."""
    import dataclasses
    import random

    from loomline.llm import gif

    r = random.Random(8)
    for n in (1, 3, 1024, 1500):
        frames = gif.decode(gif.encode(bytes(r.choice(b"abc \xff\x00") for _ in range(64 * n))))
        # the last frame may be lower than the canvas
        assert [f.colours is not None for f in frames] == [f.canvas.shape[:2] == (f.height, f.width) for f in frames]
        assert (gif.histogram(frames) == gif.histogram([dataclasses.replace(f, colours=None) for f in frames])).all()
