"""Media columns: GIF files with LZW code streams, palettes, disposal, transparency and timed frames.

``encode`` stores bytes losslessly as palette indexes: frames of 64 columns under a grey palette,
each frame drawn over the one before. ``decode`` reads any GIF87a or GIF89a: local and global
palettes, interlacing, transparency, disposal, delays, and gives the samples as stored and the
frames as composed. Histograms have ``BINS`` bins a colour channel over all composed frames.

Nulls and empty texts: the payload is 64 zero bytes. Null ids stay null; equal texts give equal
values, repeated rows equal rows. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import configure, load, table

WIDTH, ROWS, DELAY, BINS = 64, 1024, 10, 8
CLEAR, END, FREE, MOST = 256, 257, 258, 4096
#: Bit positions of the codes after a clear code: the code with number j has bit_length(257 + j) bits, 9 to 12.
_WIDTHS = np.clip(np.array([(257 + j).bit_length() for j in range(MOST)]), 9, 12)
_GREY = bytes(x for i in range(256) for x in (i, i, i))


class GifError(ValueError):
    """Bytes that aren't a whole GIF."""


def lzw_codes(data: bytes) -> tuple[list[int], list[int]]:
    """Codes and their numbers since the last clear code."""
    out: list[int] = [CLEAR]
    resets = [0]
    known: dict[int, int] = {}
    free, prefix = FREE, data[0]
    get, add = known.get, out.append
    for b in data[1:]:
        key = prefix << 8 | b
        code = get(key)
        if code is None:
            add(prefix)
            if free < MOST:
                known[key] = free
                free += 1
            else:
                add(CLEAR)
                resets.append(len(out) - 1)
                known.clear()
                free = FREE
            prefix = b
        else:
            prefix = code
    add(prefix)
    add(END)
    return out, resets


def pack_codes(codes: list[int], resets: list[int]) -> bytes:
    c = np.array(codes)
    number = np.arange(len(c))
    begin = np.zeros(len(c), np.int64)
    begin[resets] = resets
    number -= np.maximum.accumulate(begin) + 1  # the clear code itself is -1 after the clear before
    width = _WIDTHS[np.minimum(number, MOST - 1)]
    at = np.array(resets[1:], int)
    width[at] = _WIDTHS[np.minimum(number[at - 1] + 1, MOST - 1)]
    width[0] = 9
    # a code lies in three bytes at most; bits of different codes are apart, so that bytes add up without a carry
    ends = np.cumsum(width)
    at = ends - width
    c <<= at & 7
    at >>= 3
    size = int(ends[-1] + 7) >> 3
    raw = sum(np.bincount(at + j, c >> 8 * j & 255, size + 2) for j in range(3))
    return raw[:size].astype(np.uint8).tobytes()


def lzw_decode(raw: bytes, least: int, count: int) -> bytes:
    """The first ``count`` samples of a code stream with ``least`` bits a literal."""
    clear, end = 1 << least, (1 << least) + 1
    free = clear + 2
    widths = _WIDTHS if least == 8 else np.clip(np.array([(end + j).bit_length() for j in range(MOST)]), least + 1, 12)
    stream = np.frombuffer(raw + bytes(4), np.uint8).astype(np.uint32)
    words = stream[:-3] | stream[1:-2] << 8 | stream[2:-1] << 16 | stream[3:] << 24
    total, bit = 8 * len(raw), 0
    starts = np.concatenate(([0], np.cumsum(widths)))
    out = bytearray()
    while len(out) < count:
        # codes up to the next clear or end code; an encoder may defer it while the table is full
        for most in (MOST + 4, total // (least + 1) + 1):
            number = np.arange(most)
            place = bit + np.where(number < MOST, starts[np.minimum(number, MOST - 1)], starts[MOST - 1] + 12 * (number - MOST + 1))
            width = widths[np.minimum(number, MOST - 1)]
            fits = place + width <= total
            place, width = place[fits], width[fits]
            codes = (words[place >> 3] >> (place & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop):
                break
        else:
            raise GifError("the code stream ends early")
        k = int(stop[0])
        bit = int(place[k] + width[k])
        segment, finished = codes[:k].tolist(), codes[k] == end
        offsets: list[int] = []
        mark = offsets.append
        for c in segment:
            n = len(out)
            mark(n)
            if c < clear:
                out.append(c)
                continue
            try:
                s, e = offsets[c - free], offsets[c - free + 1] + 1
            except IndexError:
                raise GifError("a code before its entry") from None
            out += out[s:e]
            if e > n:
                out.append(out[s])
        if finished:
            break
    if len(out) < count:
        raise GifError("too few samples")
    return bytes(out[:count])


def blocks(raw: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (raw[i : i + 255] for i in range(0, len(raw), 255))) + b"\0"


def encode(payload: bytes) -> bytes:
    """payload: a positive multiple of 64 bytes."""
    if not payload or len(payload) % WIDTH:
        raise GifError("the payload isn't a positive multiple of 64 bytes")
    parts = [payload[i : i + WIDTH * ROWS] for i in range(0, len(payload), WIDTH * ROWS)]
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(parts[0]) // WIDTH, 0xF7, 0, 0), _GREY]
    for part in parts:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(blocks(pack_codes(*lzw_codes(part))))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: bytes
    canvas: np.ndarray  # RGBA as shown
    colours: np.ndarray | None = None  # of a frame that alone is shown, its palette


def decode(raw: bytes) -> list[Frame]:
    """All frames of a GIF, composed in order."""
    try:
        return list(_frames(raw))
    except (struct.error, IndexError) as e:
        raise GifError("the file ends early") from e


def _sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while raw[at]:
        part = raw[at + 1 : at + 1 + raw[at]]
        if len(part) < raw[at]:
            raise GifError("a block ends early")
        parts.append(part)
        at += 1 + raw[at]
    return b"".join(parts), at + 1


def _palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    size = 3 << ((flags & 7) + 1)
    if len(raw) < at + size:
        raise GifError("a palette ends early")
    colours = np.frombuffer(raw, np.uint8, size, at).reshape(-1, 3)
    return colours, at + size


def _frames(raw: bytes) -> Iterator[Frame]:
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    common, at = _palette(raw, 13, flags) if flags & 0x80 else (None, 13)
    canvas = np.zeros((high, wide, 4), np.uint8)
    disposal, delay, clear = 0, 0, None
    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            kind = raw[at + 1]
            data, at = _sub_blocks(raw, at + 2)
            if kind == 0xF9:
                bits, delay, index = struct.unpack("<BHB", data)
                disposal, clear = bits >> 2 & 7, index if bits & 1 else None
            continue
        if raw[at] != 0x2C:
            raise GifError("an unknown block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", raw, at + 1)
        at += 10
        colours = common
        if bits & 0x80:
            colours, at = _palette(raw, at, bits)
        if colours is None:
            raise GifError("no palette")
        least = raw[at]
        data, at = _sub_blocks(raw, at + 1)
        index = np.frombuffer(lzw_decode(data, least, w * h), np.uint8).reshape(h, w)
        if bits & 0x40:
            rows = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            straight = np.empty_like(index)
            straight[rows] = index
            index = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = index[: area.shape[0], : area.shape[1]]
        whole = clear is None and shown.shape == canvas.shape[:2] and index.shape == shown.shape
        if clear is None:
            # four bytes a pixel in one gather
            rgba = np.full((256, 4), 255, np.uint8)
            rgba[: len(colours), :3] = colours
            rgba[len(colours) :, :3] = colours[-1]
            canvas.view(np.uint32)[top : top + h, left : left + w, 0] = rgba.view(np.uint32)[:, 0][shown]
        else:
            drawn = shown != clear
            area[drawn, :3] = colours[np.minimum(shown, len(colours) - 1)][drawn]
            area[drawn, 3] = 255
        yield Frame(left, top, w, h, 10 * delay, disposal, clear, index.tobytes(), canvas.copy(), rgba[:, :3] if whole else None)
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        disposal, delay, clear = 0, 0, None


def histogram(frames: list[Frame]) -> np.ndarray:
    """Counts by channel (red, green, blue) and bin of all opaque pixels of the composed frames."""
    out = np.zeros((3, BINS), np.int64)
    for f in frames:
        if f.colours is not None:
            counts = np.bincount(np.frombuffer(f.samples, np.uint8), minlength=256)
            for k in range(3):
                out[k] += np.bincount(f.colours[:, k] >> 5, counts, BINS).astype(np.int64)
            continue
        shown = f.canvas[f.canvas[:, :, 3] > 0]
        for k in range(3):
            out[k] += np.bincount(shown[:, k] >> 5, minlength=BINS)
    return out


def payload_of(text: bytes) -> bytes:
    return text + bytes(WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a GIF."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                texts = batch.column("data").slice(i, 256).to_pylist()
                yield table({"doc_id": (batch.column("doc_id").slice(i, 256), pa.int64()), "n_bytes": ([len(x) for x in texts], pa.int64()), "media": ([encode(payload_of(x)) for x in texts], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FRAMES = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, frames array<struct<width: int, height: int, delay_ms: int, disposal: int, samples: binary>>, red array<long>, green array<long>, blue array<long>"


def decoded(stored: DataFrame) -> DataFrame:
    """Timed frames and colour histograms of (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                files = batch.column("media").slice(i, 256).to_pylist()
                frames = [decode(x) for x in files]
                colours = [histogram(x).tolist() for x in frames]
                kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("samples", pa.binary())]))
                yield table(
                    {
                        "doc_id": (batch.column("doc_id").slice(i, 256), pa.int64()),
                        "n_bytes": (batch.column("n_bytes").slice(i, 256), pa.int64()),
                        "media_bytes": ([len(x) for x in files], pa.int64()),
                        "media_sha256": ([hashlib.sha256(x).hexdigest() for x in files], pa.string()),
                        "frames": ([[{"width": f.width, "height": f.height, "delay_ms": f.delay_ms, "disposal": f.disposal, "samples": f.samples} for f in x] for x in frames], kind),
                        **{name: ([x[k] for x in colours], pa.list_(pa.int64())) for k, name in enumerate(("red", "green", "blue"))},
                    }
                )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FRAMES)


def op8_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decoded(media(load(spark, sf_dir, "documents")))
    samples = F.aggregate("frames", F.lit(b""), lambda all_, f: F.concat(all_, f["samples"]))
    tail = F.expr("substring(payload, -64, 64)")
    shown = F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames").cast("string")), *[F.concat(F.lit(f"{x}="), F.array_join(F.col(x).cast("array<string>"), ",")) for x in ("red", "green", "blue")])
    return read.withColumn("payload", samples).select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", shown.alias("feature"))
