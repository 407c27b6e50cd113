"""What the corpus operators share: scratch tables, document keys and Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the contracts have it: space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
NULL_ID = -(1 << 63)


def configure(spark: SparkSession) -> None:
    """Sets what the operators count on, in place of the session's own values: Arrow batches bound the workers' memory."""
    for key, value in {
        # A finished write needs its shuffle files no more; else they pile up until the driver's garbage goes.
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    }.items():
        spark.conf.set(key, value)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a local one only where that is unset and the master is local."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder: executors need a shared one")
        top = "file://" + os.path.join(tempfile.gettempdir(), f"loomline-{os.getuid()}")
    return f"{top.rstrip('/')}/loomline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared scratch folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_key(id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether several rows share an id; reads the ids only."""
    return not docs.groupBy(doc_key(id_col)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str, repeat: bool | None = None) -> DataFrame:
    """(doc, ord, data): id with null as the smallest, order among rows of one id, text as bytes (null: empty).

    Rows with one id and different texts are different documents, ordered by a hash of the text, so
    that no number of them meets in one task; rows equal in both are one document. Where no id repeats ord is 0, which takes
    no room in shuffles. repeat: what ``ids_repeat`` said, if it was asked.
    """
    repeat = ids_repeat(docs, id_col) if repeat is None else repeat
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    ord_ = F.xxhash64(data) if repeat else F.lit(0).cast("long")
    return docs.select(doc_key(id_col).alias("doc"), ord_.alias("ord"), data.alias("data"), *[F.col(x) for x in more])


def restored(col: str = "doc", name: str = "doc_id"):
    return F.nullif(F.col(col), F.lit(NULL_ID)).alias(name)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and the offsets (one more than rows).

    Also has Arrow return freed batches to the system: other pools keep them, beside the JVM's heap.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Rows in groups of about ``limit`` bytes; a longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words lie before each document's end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(ends), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = True
    cut[ends] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.append(solid[1:], False)
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    stops = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, stops, np.searchsorted(starts, ends)


def table(columns: dict[str, tuple[np.ndarray | list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def emit(batch: pa.RecordBatch, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
