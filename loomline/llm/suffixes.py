"""Suffix-array dedup over UTF-8 bytes: repeated strings of ``window`` bytes or more.

Only suffixes that can repeat are sorted: those under a winnowed anchor (``SEED`` bytes) with
several contexts, each context once; equal contexts collapse before (see ``repeats``). The
contexts are dealt by range of the suffix that begins at the anchor, so by its leading
tokens, with splitters that Spark samples for at most ``RANGES`` ranges. Spark sorts a range's contexts
and a task streams them in buckets of ``BUCKET``, so that equal suffixes in any number don't meet in memory. Each bucket sorts the suffixes of its windows by
multikey quicksort on 8-byte words: ties of one word go on to the next, single ones drop out.
A leading seed that several buckets hold is at the edge of each of them; its contexts are also
compared across boundaries: dealt by the bytes that all windows of a narrow band of offsets
share, so that a hot seed spreads, and sorted in the same way.

Suffixes are dealt by the anchor inside them and not by their own first bytes: equal windows
share both, but so a context travels once instead of once for each of its windows.

Nulls and empty texts: no bytes, nothing removed. A null id counts as the smallest. Rows equal
in id and text are one document and get equal results; rows that share an id only are ordered
by a hash of the text. The first occurrence in order of (id, that hash, start) stays. Extra columns are ignored.
An empty table gives an empty result. Memory: an Arrow batch, the longest text, or a bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import repeats
from loomline.llm.common import buffers, configure, emit, keyed, load, restored, slices, table, written

WINDOW, SEED = 100, 24
#: Contexts that a bucket takes (about 150 bytes each), and ranges at most: 100 of a range's suffixes go to the driver.
BUCKET, RANGES = 30_000, 4096
CONTEXT = "suffix binary, left binary, doc long, ord long, meta long"
SORTED = "doc long, ord long, meta long, edge binary"
#: Offsets of the anchor in its window that a band has.
BAND = 17
#: Seeds at bucket edges up to this many are broadcast (24 bytes each); beyond, they are joined by a shuffle.
FEW = 100_000
OUT = "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _contexts(joined: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            metas = batch.column("metas")
            counts = np.asarray(metas.value_lengths())
            meta = np.asarray(metas.flatten())
            d = np.repeat(np.arange(batch.num_rows), counts)
            lo, n, off = repeats.unpack(meta)
            start = offsets[d] + lo
            raw = data.tobytes()
            suffix = [raw[a:b] for a, b in zip((start + off).tolist(), (start + n - 1 + window).tolist(), strict=True)]
            left = [raw[a:b] for a, b in zip(start.tolist(), (start + off).tolist(), strict=True)]
            out = table({"suffix": (suffix, pa.binary()), "left": (left, pa.binary()), "doc": (batch.column("doc").to_numpy()[d], pa.int64()), "ord": (batch.column("ord").to_numpy()[d], pa.int64()), "meta": (meta, pa.int64())})
            yield from emit(out, 20_000)

    return joined.select("doc", "ord", "data", "metas").mapInArrow(run, CONTEXT)


def quicksort_ties(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal another: their numbers, sorted by content, and their class numbers.

    words[p]: the 8 bytes from p on, big-endian. Multikey: each pass orders ties by their next word.
    """
    live = np.arange(len(at))
    group = np.zeros(len(at), np.uint64)
    for depth in range(0, window, 8):
        if not len(live):
            break
        key = words[at[live] + depth]
        if window - depth < 8:
            key = key >> np.uint64(8 * (8 - window + depth))
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(len(live), np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1]))).astype(np.uint64)
        both = group << np.uint64(32) | rank
        order = np.argsort(both)
        both, live = both[order], live[order]
        new = np.concatenate(([True], both[1:] != both[:-1]))
        tied = ~(new & np.append(new[1:], True))
        live = live[tied]
        group = (np.cumsum(new) - 1)[tied].astype(np.uint64)
    return live, group.astype(np.int64)


def _bucket(suffix: pa.Array, left: pa.Array, doc: np.ndarray, ord_: np.ndarray, meta: np.ndarray, window: int) -> pa.RecordBatch:
    """Windows removed among those of a bucket's contexts."""
    s, s_at = buffers(suffix)
    l, l_at = buffers(left)
    s_len, l_len = np.diff(s_at), np.diff(l_at)
    begin = np.concatenate(([0], np.cumsum(s_len + l_len)))
    text = np.zeros(begin[-1] + 8, np.uint8)
    for source, at, length, base in ((l, l_at, l_len, begin[:-1]), (s, s_at, s_len, begin[:-1] + l_len)):
        text[np.arange(len(source)) + np.repeat(base - at[:-1], length)] = source
    words = np.zeros(begin[-1], np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | text[i : i + len(words)]
    lo, n, off = repeats.unpack(meta)
    row = np.repeat(np.arange(len(meta)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    live, group = quicksort_ties(words, begin[row] + step, window)
    place = lo[row] + step
    order = np.lexsort((place[live], ord_[row[live]], doc[row[live]], group))
    live, group = live[order], group[order]
    new = np.ones(len(live), bool)
    new[1:] = group[1:] != group[:-1]
    first = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))] if len(live) else live
    later = (doc[row[live]] != doc[row[first]]) | (ord_[row[live]] != ord_[row[first]]) | (place[live] != place[first])
    gone = np.zeros(len(row), bool)
    gone[live[later]] = True
    # removed windows, merged where they follow one another in a row
    edge = np.flatnonzero(gone & ~(np.concatenate(([False], gone[:-1])) & (step > 0)))
    stop = np.flatnonzero(gone & ~(np.append(gone[1:], False) & (np.append(step[1:], 0) > 0)))
    r = row[edge]
    removed = repeats.pack(lo[r] + step[edge], stop - edge + 1, np.zeros(len(r), np.int64))
    return table({"doc": (doc[r], pa.int64()), "ord": (ord_[r], pa.int64()), "meta": (removed, pa.int64()), "edge": (pa.nulls(len(r), pa.binary()), pa.binary())})


def _buckets(batches: Iterator[pa.RecordBatch], size: int, whole: str | None) -> Iterator[pa.Table]:
    """The rows in buckets of ``size``, in their order; with ``whole``, more where a run of equal values of that column goes on."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.arange(batch.num_rows)
        if whole:
            keys = batch.column(whole).to_pylist()
            cuts = np.array([i for i, (x, y) in enumerate(zip(keys, [last, *keys], strict=False)) if x != y], np.int64)
            last = keys[-1]
        start = 0
        while (k := int(np.searchsorted(cuts, start + max(0, size - rows)))) < len(cuts):
            held.append(batch.slice(start, int(cuts[k]) - start))
            if rows + held[-1].num_rows:
                yield pa.Table.from_batches(held)
            held, rows, start = [], 0, int(cuts[k])
        held.append(batch.slice(start))
        rows += batch.num_rows - start
    if rows:
        yield pa.Table.from_batches(held)


def _sorted(contexts: DataFrame, window: int, seed: int, bucket: int, whole: str | None = None) -> DataFrame:
    """(doc, meta, edge) of each bucket of contexts: windows removed; with edge, its first and last seeds and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for number, t in enumerate(_buckets(batches, bucket, whole), first):
            suffix = t["suffix"].combine_chunks()
            yield from emit(_bucket(suffix, t["left"].combine_chunks(), t["doc"].to_numpy(), t["ord"].to_numpy(), t["meta"].to_numpy(), window))
            seeds = [x[:seed] for x in suffix.to_pylist()]
            yield table({"doc": ([number] * 2, pa.int64()), "ord": ([0, 0], pa.int64()), "meta": ([0, 0], pa.int64()), "edge": ([min(seeds), max(seeds)], pa.binary())})

    return contexts.mapInArrow(run, SORTED)


def _bands(contexts: DataFrame, window: int, seed: int) -> DataFrame:
    """Each context cut to the windows of each band of offsets, with the bytes that these windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suffix, left = batch.column("suffix").to_pylist(), batch.column("left").to_pylist()
            doc, ord_, meta = (batch.column(x).to_numpy() for x in ("doc", "ord", "meta"))
            lo, n, off = repeats.unpack(meta)
            for least in range(0, window - seed + 1, BAND):
                most = min(least + BAND - 1, window - seed)
                far, near = np.minimum(off, most), np.maximum(off - n + 1, least)
                r = np.flatnonzero(near <= far)
                cut = list(zip(r.tolist(), far[r].tolist(), near[r].tolist(), strict=True))
                yield table(
                    {
                        "suffix": ([suffix[i][: window - d] for i, _, d in cut], pa.binary()),
                        "left": ([left[i][len(left[i]) - d :] for i, d, _ in cut], pa.binary()),
                        "doc": (doc[r], pa.int64()),
                        "ord": (ord_[r], pa.int64()),
                        "meta": (repeats.pack(lo[r] + off[r] - far[r], far[r] - near[r] + 1, far[r]), pa.int64()),
                        "core": ([left[i][len(left[i]) - least :] + suffix[i][: window - most] for i, _, _ in cut], pa.binary()),
                    }
                )

    return contexts.mapInArrow(run, CONTEXT + ", core binary")


def _apply(joined: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            cuts = batch.column("cuts")
            counts = np.asarray(cuts.value_lengths().fill_null(0))
            flat = np.asarray(cuts.flatten())
            where = np.concatenate(([0], np.cumsum(counts)))
            n_removed, n_spans, kept = [], [], []
            for i, j in slices(offsets, repeats.CHUNK):
                part, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
                begin = np.concatenate(([0], ends[:-1]))
                gone = repeats.covered(flat[where[i] : where[j]], np.repeat(np.arange(j - i), counts[i:j]), begin, len(part), window)
                whole = part.tobytes()
                for d, (a, b) in enumerate(zip(begin.tolist(), ends.tolist(), strict=True)):
                    if not counts[i + d]:
                        n_removed.append(0)
                        n_spans.append(0)
                        kept.append(whole[a:b])
                        continue
                    mask = gone[a:b]
                    n_removed.append(int(mask.sum()))
                    n_spans.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()))
                    kept.append(part[a:b][~mask].tobytes())
            yield table(
                {
                    "doc": (batch.column("doc"), pa.int64()),
                    "n_bytes": (np.diff(offsets), pa.int64()),
                    "n_removed": (n_removed, pa.int64()),
                    "n_spans": (n_spans, pa.int64()),
                    "kept": (kept, pa.binary()),
                    "kept_sha256": ([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                }
            )

    return joined.select("doc", "data", "cuts").mapInArrow(run, OUT)


def remove_suffix_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, bucket: int = BUCKET, ranges: int = RANGES, few_edges: int = FEW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256): bytes left after every repeat but the first is cut.

    ``kept`` is binary: a cut may fall inside a UTF-8 character.
    """
    configure(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    rows = written(repeats.anchor_rows(base, repeats.byte_tokens, window, seed, True), "anchors")
    found = written(repeats.classes(rows, True), "classes")
    compare = found.filter(F.col("kind") == repeats.CLOSE)
    buckets = max(1, math.ceil(compare.count() / bucket))
    close = compare.groupBy("doc", "ord").agg(F.collect_list("meta").alias("metas"))
    contexts = written(_contexts(base.join(close, ["doc", "ord"]), window), "contexts")
    ranged = contexts.repartitionByRange(min(buckets, ranges), "suffix").sortWithinPartitions("suffix")
    done = written(_sorted(ranged, window, seed, bucket), "buckets")
    edges = done.filter("edge IS NOT NULL").groupBy("edge").agg(F.count_distinct("doc").alias("n")).filter("n > 1").select("edge")
    edges = written(edges, "edges")
    few = edges.count() <= few_edges
    cut = contexts.join(F.broadcast(edges) if few else edges, F.substring("suffix", 1, seed) == F.col("edge"), "left_semi")
    banded = _bands(cut, window, seed).repartition(min(2 * buckets, ranges), "core").sortWithinPartitions("core")
    again = _sorted(banded, window, seed, bucket, "core")
    gone = F.col("kind") == repeats.GONE
    parts = [x.filter(gone) for x in (rows, found)] + [x.filter("edge IS NULL") for x in (done, again)]
    removed = repeats.gathered(reduce(DataFrame.unionByName, (x.select("doc", "ord", "meta") for x in parts)))
    return _apply(base.join(removed, ["doc", "ord"], "left"), window).withColumn("doc", restored("doc", "doc")).withColumnRenamed("doc", id_col)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_suffix_repeats(load(spark, sf_dir, "documents")).drop("kept")
