"""First stages that substring dedup (words) and suffix dedup (bytes) share.

``anchor_rows`` finds each document's winnowed anchors (see ``anchors``); rows of equal
anchor and equal context collapse to their first within every Arrow batch, so a passage
that a third of all documents hold sends a row per batch, not per document. ``classes``
then deals rows by anchor hash, sorts within the partition and walks it with constant
memory: of each class of equal contexts all but the first are removed as a whole, and
where one anchor has several contexts their first rows are kept for closer comparison.
``ends_table`` merges the removed windows of a document.

Rows carry ``meta = lo << 16 | n << 8 | off`` (see ``pack``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import anchors
from loomline.llm.common import buffers, emit, slices, table, word_spans

ROWS = "h long, c long, doc long, ord long, meta long, kind int"
CHUNK = 1 << 20
#: Kinds of rows: still to compare, whole class to compare closer, windows removed.
OPEN, CLOSE, GONE = 0, 1, 2


def pack(lo: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    return lo.astype(np.int64) << 16 | n.astype(np.int64) << 8 | off.astype(np.int64)


def unpack(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return meta >> 16, meta >> 8 & 0xFF, meta & 0xFF


def byte_tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, ends


def word_tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, counts = word_spans(data, ends)
    return anchors.word_hashes(data, starts, stops), counts


def blocks(tokens: np.ndarray, ends: np.ndarray, window: int, limit: int):
    """(tokens, ends, document, shift) in bounded pieces; a long document's pieces overlap by window - 1."""
    if len(tokens) <= 2 * limit:
        yield tokens, ends, np.arange(len(ends)), np.zeros(len(ends), np.int64)
        return
    start = 0
    for d, end in enumerate(ends):
        for at in range(start, max(start + 1, end), limit):
            piece = tokens[at : min(end, at + limit + window - 1)]
            if len(piece) >= window:
                yield piece, np.array([len(piece)]), np.array([d]), np.array([at - start])
        start = end


def later_than(rows: np.ndarray, first: np.ndarray, same_doc: bool) -> np.ndarray:
    """Which rows begin after the first of their class: in a larger document, or (same_doc) anywhere else."""
    later = rows[:, 2] > first[:, 2]
    if same_doc:
        later |= (rows[:, 2] == first[:, 2]) & ((rows[:, 3] != first[:, 3]) | (rows[:, 4] != first[:, 4]))
    return later


def firsts(rows: np.ndarray, same_doc: bool) -> Iterator[np.ndarray]:
    """Collapses equal (h, c) within a batch: kind GONE for rows that surely go, OPEN for the others."""
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 0] != rows[:-1, 0])
    first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    rows[:, 5] = np.where(later_than(rows, first, same_doc), GONE, OPEN)
    return rows


def batch_of(rows: np.ndarray) -> pa.RecordBatch:
    return table({**{k: (rows[:, i], pa.int64()) for i, k in enumerate(("h", "c", "doc", "ord", "meta"))}, "kind": (rows[:, 5].astype(np.int32), pa.int32())})


def anchor_rows(docs: DataFrame, tokens: Callable, window: int, k: int, same_doc: bool) -> DataFrame:
    """docs: (doc, ord, data). same_doc: an earlier window of the same document counts as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            doc, ord_ = batch.column("doc").to_numpy(), batch.column("ord").to_numpy()
            parts = []
            for i, j in slices(offsets, CHUNK):
                found, ends = tokens(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
                for piece, stops, which, shift in blocks(found, ends, window, CHUNK):
                    d, lo, n, off, h, c = anchors.runs(piece, stops, window, k)
                    at = which[d] + i
                    parts.append(np.stack([h.view(np.int64), c.view(np.int64), doc[at], ord_[at], pack(lo + shift[d], n, off), np.zeros(len(d), np.int64)], 1))
            if parts and (rows := np.concatenate(parts)).size:
                yield from emit(batch_of(firsts(rows, same_doc)))

    return docs.select("doc", "ord", "data").mapInArrow(run, ROWS)


def classes(rows: DataFrame, same_doc: bool) -> DataFrame:
    """Removed windows (kind GONE) and first rows of contexts that share an anchor with others (kind CLOSE).

    Rows of an anchor that has one context only, and so nothing to be compared with, end here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # first row of the current class
        held: list[np.ndarray] = []  # first class's rows of its own document, until a second class of the anchor comes
        several = False
        for batch in batches:
            rows = np.stack([batch.column(x).to_numpy() for x in ("h", "c", "doc", "ord", "meta")] + [np.zeros(batch.num_rows, np.int64)], 1)
            if not len(rows):
                continue
            ahead = rows if head is None else np.concatenate([head[None], rows])
            new = np.ones(len(ahead), bool)
            new[1:] = (ahead[1:, 0] != ahead[:-1, 0]) | (ahead[1:, 1] != ahead[:-1, 1])
            first = ahead[np.maximum.accumulate(np.where(new, np.arange(len(ahead)), 0))]
            group = np.ones(len(ahead), bool)
            group[1:] = ahead[1:, 0] != ahead[:-1, 0]
            skip = 0 if head is None else 1
            later = later_than(ahead, first, same_doc)
            gone = ahead[later]
            # a class's rows in its first document; repeats of one row say the same twice
            own = np.flatnonzero(~later)
            own = own[own >= skip]
            number = np.cumsum(group)  # anchor number within this batch
            classes_in = np.bincount(number, weights=new.astype(float), minlength=number[-1] + 1)
            many = classes_in[number] > 1
            if skip:
                same = number == 1
                if several:
                    many |= same
                elif classes_in[1] > 1 and held:
                    close = np.concatenate(held)
                    close[:, 5] = CLOSE
                    yield from emit(batch_of(close))
                    held, several = [], True
            out = ahead[own[many[own]]].copy()
            out[:, 5] = CLOSE
            gone[:, 5] = GONE
            if len(gone) + len(out):
                yield from emit(batch_of(np.concatenate([gone, out])))
            last = number == number[-1]
            if number[-1] > 1 or not skip:
                held, several = [], bool(classes_in[number[-1]] > 1)
            if not several:
                held.append(ahead[own[last[own]]].copy())
            head = first[-1].copy()

    partitioned = rows.filter(F.col("kind") == OPEN).drop("kind").repartition("h").sortWithinPartitions("h", "c", "doc", "ord", "meta")
    return partitioned.mapInArrow(run, ROWS)


def gathered(removed: DataFrame) -> DataFrame:
    """(doc, ord, cuts): a document's removed windows, each ``lo << 8 | n``, as one list; it is no longer than the document."""
    return removed.select("doc", "ord", F.shiftright("meta", 8).alias("cut")).groupBy("doc", "ord").agg(F.collect_list("cut").alias("cuts"))


def covered(cuts: np.ndarray, owner: np.ndarray, starts: np.ndarray, total: int, window: int) -> np.ndarray:
    """Which of ``total`` tokens lie in a removed window. cuts: ``lo << 8 | n``; owner: whose; starts: of documents."""
    delta = np.zeros(total + 1, np.int64)
    lo = starts[owner] + (cuts >> 8)
    np.add.at(delta, lo, 1)
    np.add.at(delta, lo + (cuts & 0xFF) - 1 + window, -1)
    return np.cumsum(delta[:-1]) > 0
