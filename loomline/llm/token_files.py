"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt by range of their id and sorted, so files and stripes hold ascending ids;
readers take stripes in parallel, and a filter on ids prunes files, stripes and row groups by
their statistics and Bloom filters before any ids are decoded.

Nulls and empty texts: just the end id. Null ids come first; rows that share an id are ordered by
text. Repeated rows are written each. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm import pieces
from loomline.llm.common import buffers, configure, load, scratch, slices, table, written

#: Bytes of text encoded at once; a worker holds arrays of several times as many bytes meanwhile.
CHUNK = 4 << 20
STORED = "doc_id long, row long, ids array<int>"
END_ID = 2


def encode_documents(docs: DataFrame, model: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, ids) in ascending order of id. model: a byte-level BPE file of the tokenizers library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, special = pieces.byte_level_encoder(model)
        row = 0
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            for i, j in slices(offsets, CHUNK):
                part, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
                at, drop = pieces.byte_level_cuts(part, ends)
                raw, begin = part.tobytes(), np.concatenate(([0], ends[:-1]))
                if pieces.WIDE_SPACE.search(raw) or any(x in raw for x in special):
                    whole = np.array([bool(pieces.WIDE_SPACE.search(raw, a, b)) or any(raw.find(x, a, b) >= 0 for x in special) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)])
                    owner = np.searchsorted(ends, at, side="right")
                    at = at[~whole[owner] | (at == begin[owner])]
                    drop = np.zeros(len(at), bool)
                number = pieces.encode_pieces(part, at, drop, known)
                ids, counts = pieces.gather(number, known.bounds, known.ids)
                tokens = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(at, ends)]
                all_ids = np.insert(ids, tokens, end_id).astype(np.int32)
                lists = np.concatenate(([0], tokens + np.arange(1, j - i + 1))).astype(np.int32)
                yield table(
                    {
                        "doc_id": (batch.column("doc_id").slice(i, j - i), pa.int64()),
                        "row": (np.arange(row, row + j - i), pa.int64()),
                        "ids": (pa.ListArray.from_arrays(pa.array(lists), pa.array(all_ids)), pa.list_(pa.int32())),
                    }
                )
                row += j - i

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "data").mapInArrow(run, STORED)


def write_tokens(docs: DataFrame, path: str, model: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    configure(docs.sparkSession)
    options = {
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.create.index": "true",
        "orc.row.index.stride": "10000",
        "orc.stripe.size": str(64 << 20),
        "compression": "zstd",
    }
    encode_documents(docs, model, end_id, id_col, text_col).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, ids); filters on doc_id are pushed to stripes and row groups."""
    return spark.read.schema(STORED).orc(path)


def describe(stored: DataFrame) -> DataFrame:
    """(doc_id, row, file, n_tokens, ids_crc32) of what is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values, at = np.asarray(lists.flatten()).astype("<u4"), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
            raw = memoryview(values.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield table({"doc_id": (batch.column("doc_id"), pa.int64()), "row": (batch.column("row"), pa.int64()), "file": (batch.column("file"), pa.string()), "n_tokens": (np.diff(at), pa.int64()), "ids_crc32": (crc, pa.int64())})

    return stored.select("doc_id", "row", F.col("_metadata.file_name").alias("file"), "ids").mapInArrow(run, "doc_id long, row long, file string, n_tokens long, ids_crc32 long")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def stored_tokens(docs: DataFrame, model: str, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' ids and describes them as read back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, model, end_id)
    rows = written(describe(read_tokens(spark, path)), "described")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("all"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("least"))
    # one row a file: the files' order needs no more than that
    before = files.select("file", (F.sum("all").over(Window.orderBy("least", "file")) - F.col("all")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row"))
    placed = rows.withColumn("upto", within).join(before, "file")
    return placed.select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
