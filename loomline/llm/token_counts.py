"""Token counts by prefix dynamic programming.

A text splits at positions that no token crosses (see ``pieces``), so the count of a prefix is
the count up to its last piece plus that of the piece's part, which ``pieces.PrefixCounts`` finds
for all parts at once, from the last token of each. The table holds the exact count at every
prefix of whole characters. It answers any prefix, truncation or budget question by itself:
``prefix_count`` and ``fitting_bytes`` encode nothing. Counts can fall where a character
completes a longer token.

Nulls and empty texts: no tokens and empty tables. Null ids stay null; every row gives a row,
repeated rows equal rows. Extra columns are ignored; an empty table gives an empty result.
A table takes 4 bytes a byte of text; memory is that of ``CHUNK`` bytes of text or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import pieces
from loomline.llm.common import buffers, configure, load, slices, table

CHUNK = 1 << 20
OUT = "doc_id long, n_bytes long, prefix_tokens array<int>"


def count_prefixes(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, prefix_tokens): tokens of the first 1, 2, 3 ... bytes, null inside a character. model: a SentencePiece BPE file with bytes to fall back to."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.sentencepiece_prefixes(model)
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            for i, j in slices(offsets, CHUNK):
                part, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
                at, drop = pieces.sentencepiece_cuts(part, ends)
                number = pieces.encode_pieces(part, at, drop, known)
                tokens = np.ones(len(part), np.int32)  # a piece's own space is one token until more follows
                own = np.ones(len(part), bool)
                own[at[drop]] = False
                tokens[own] = pieces.gather(number, known.bounds, known.ids)[0]
                inside = tokens < 0
                stops = np.append(at[1:], len(part))[: len(at)]
                total = np.concatenate(([0], np.cumsum(tokens[stops - 1])))
                upto = np.searchsorted(at, ends)
                begin = np.concatenate(([0], upto[:-1]))
                before = total[:-1] - np.repeat(total[begin], upto - begin)
                tokens += np.repeat(before, stops - at).astype(np.int32)
                lists = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield table(
                    {
                        "doc_id": (batch.column("doc_id").slice(i, j - i), pa.int64()),
                        "n_bytes": (np.diff(np.concatenate(([0], ends))), pa.int64()),
                        "prefix_tokens": (pa.ListArray.from_arrays(lists, pa.array(tokens, mask=inside)), pa.list_(pa.int32())),
                    }
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"))
    return rows.mapInArrow(run, OUT).withColumnRenamed("doc_id", id_col)


def total_tokens() -> Column:
    return F.when(F.size("prefix_tokens") > 0, F.element_at("prefix_tokens", -1)).otherwise(0).cast("long")


def fitting_bytes(budget: int) -> Column:
    """The longest prefix of whole characters with ``budget`` tokens at most, in bytes."""
    ends = F.transform("prefix_tokens", lambda x, i: F.when(x <= budget, i + 1))
    return F.coalesce(F.array_max(ends), F.lit(0))


def prefix_count(end: int | Column) -> Column:
    """Exact tokens of the first ``end`` bytes; null if they end inside a character or beyond the text."""
    end = F.lit(end) if isinstance(end, int) else end
    return F.when(end == 0, 0).when(end > 0, F.get("prefix_tokens", end - 1))


def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    counted = count_prefixes(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    out = counted.select("doc_id", "n_bytes", total_tokens().alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
