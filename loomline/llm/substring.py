"""Substring dedup by seed and extend: repeated passages of ``window`` words or more.

Seeds are winnowed anchors of ``SEED`` words; documents join on them. Each seed's context
reaches both ways over all windows that chose the seed: equal contexts match as a whole, and
where contexts of one seed differ, their windows are compared one by one by two 64-bit
hashes. Adjacent matches of a document merge into maximal repeats before removal.

Nulls and empty texts: no words, nothing removed. A null id counts as the smallest. Rows
equal in id and text are one document and get equal results; rows that share an id only are
several documents, none of which cuts another. Ties don't arise: the smallest document keeps a passage. Extra columns are
ignored. An empty table gives an empty result. Memory is bounded by an Arrow batch and by the
longest text; a hot seed is collapsed within each batch and then streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import anchors, repeats
from loomline.llm.common import buffers, configure, emit, keyed, load, restored, slices, table, word_spans, written

WINDOW, SEED = 13, 4
OUT = "doc long, n_words long, n_removed long, kept string, spans array<struct<start: int, end: int>>"


def _windows(joined: DataFrame, window: int) -> DataFrame:
    """One row for each window of the rows to compare; h and c are two hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            metas = batch.column("metas")
            counts = np.asarray(metas.value_lengths())
            meta = np.asarray(metas.flatten())
            doc, ord_ = batch.column("doc").to_numpy(), batch.column("ord").to_numpy()
            where = np.concatenate(([0], np.cumsum(counts)))
            for i, j in slices(offsets, repeats.CHUNK):
                part, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
                starts, stops, upto = word_spans(part, ends)
                words = anchors.word_hashes(part, starts, stops)
                one, two = anchors.RollingHash(words), anchors.RollingHash(anchors.mix(words ^ np.uint64(0x5851F42D4C957F2D)))
                m = meta[where[i] : where[j]]
                d = np.repeat(np.arange(j - i), counts[i:j])
                lo, n, _ = repeats.unpack(m)
                each = np.repeat(np.arange(len(m)), n)
                s = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = s + np.concatenate(([0], upto[:-1]))[d[each]]
                out = np.stack([one.of(at, at + window).view(np.int64), two.of(at, at + window).view(np.int64), doc[i:j][d[each]], ord_[i:j][d[each]], repeats.pack(s, np.ones(len(s), np.int64), np.zeros(len(s), np.int64)), np.zeros(len(s), np.int64)], 1)
                if len(out):
                    yield from emit(repeats.batch_of(repeats.firsts(out, False)))

    return joined.select("doc", "ord", "data", "metas").mapInArrow(run, repeats.ROWS)


def _apply(joined: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            cuts = batch.column("cuts")
            counts = np.asarray(cuts.value_lengths().fill_null(0))
            flat = np.asarray(cuts.flatten())
            where = np.concatenate(([0], np.cumsum(counts)))
            n_words, n_removed, kept, spans = [], [], [], []
            for i, j in slices(offsets, repeats.CHUNK):
                part, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
                _, _, upto = word_spans(part, ends)
                begin = np.concatenate(([0], upto[:-1]))
                gone = repeats.covered(flat[where[i] : where[j]], np.repeat(np.arange(j - i), counts[i:j]), begin, int(upto[-1]), window)
                whole, e0 = part.tobytes(), 0
                for d, e in enumerate(ends):
                    words, mask = whole[e0:e].split(), gone[begin[d] : upto[d]]
                    n_words.append(len(words))
                    n_removed.append(int(mask.sum()))
                    kept.append(b" ".join(compress(words, ~mask)) if n_removed[-1] else b" ".join(words))
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))).tolist()
                    spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    e0 = e
            yield table(
                {
                    "doc": (batch.column("doc"), pa.int64()),
                    "n_words": (n_words, pa.int64()),
                    "n_removed": (n_removed, pa.int64()),
                    "kept": (pa.array(kept, pa.binary()).cast(pa.string()), pa.string()),
                    "spans": (spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                }
            )

    return joined.select("doc", "data", "cuts").mapInArrow(run, OUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): the words left, joined by a space, and word spans removed.

    A word goes if some ``window`` words around it also start in a document with a smaller id.
    """
    configure(docs.sparkSession)
    base = keyed(docs, id_col, text_col)
    rows = written(repeats.anchor_rows(base, repeats.word_tokens, window, min(SEED, window), False), "seeds")
    found = written(repeats.classes(rows, False), "classes")
    close = found.filter(F.col("kind") == repeats.CLOSE).groupBy("doc", "ord").agg(F.collect_list("meta").alias("metas"))
    pieces = written(_windows(base.join(close, ["doc", "ord"]), window), "windows")
    more = repeats.classes(pieces, False)
    gone = F.col("kind") == repeats.GONE
    removed = repeats.gathered(rows.filter(gone).unionByName(found.filter(gone)).unionByName(pieces.filter(gone)).unionByName(more.filter(gone)).select("doc", "ord", "meta"))
    return _apply(base.join(removed, ["doc", "ord"], "left"), window).withColumn("doc", restored("doc", "doc")).withColumnRenamed("doc", id_col)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
