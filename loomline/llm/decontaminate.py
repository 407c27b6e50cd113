"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks; native functions only.

Texts are lower-cased words; shingles are ``SHINGLE`` words. A window has as many shingles as an item
(a shorter document is one window). Windows that can't reach the similarity are left out
first, without loss: a window of w shingles and an item of n must share
``similarity * (n + w) / (1 + similarity)`` of them, and sliding a window to its first shared
shingle loses none, so windows start at shared shingles and span enough of them.

The windows' 64-bit SimHashes (a shingle's weight is its count) meet those of items of the same
size in ``BLOCKS`` blocks: items are filed under all values within ``REACH`` bits of each block,
so every fingerprint within ``BLOCKS * (REACH + 1) - 1`` bits is found. A window at a
similarity of 0.8 is 9.7 bits away on average, and beyond 23 with a probability near 1e-5.
Weighted Jaccard on exact shingle counts then verifies each candidate.

Nulls, empty texts and empty items match nothing. Fewer words than a shingle are one shingle. A
null id counts as an id; rows that share an id are judged each by its own text, and an id and item give
one row with the best window, the first among equals. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import WORD, configure, doc_key, ids_repeat, keyed, load, restored, written

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, REACH = 8, 2
#: Shingles of items up to this many are broadcast; beyond, documents' shingles are shuffled to them.
FEW = 1_000_000
_LANES = 0x0001000100010001


def shingles(text: Column, size: int = SHINGLE) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))

    # the words once, as the only element of an array
    return F.element_at(F.transform(F.array(words), of), 1)


def lane_sums(h: str) -> list[Column]:
    """Sums that count each bit of the hashes: 16 sums of 4 lanes with 16 bits.

    Lanes are exact up to 32,767 hashes; beyond, bits are noise, the same for equal sets.
    """
    return [F.coalesce(F.try_sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES))), F.lit(0)).alias(f"lane{j}") for j in range(16)]


def fingerprint(count: str) -> Column:
    """Bits set in more than half of ``count`` hashes, two lanes at once.

    Adding 32,767 - count / 2 to a lane carries into its top bit if the lane is above half.
    """
    half = F.least(F.floor(F.col(count) / 2), F.lit(0x7FFF))
    above, pair = (F.lit(0x7FFF) - half) * F.lit(0x00010001), F.lit(0x00010001)
    out = F.lit(0).cast("long")
    for j in range(16):
        low = F.shiftright(F.col(f"lane{j}").bitwiseAND(F.lit(0xFFFFFFFF)) + above, 15).bitwiseAND(pair)
        high = F.shiftright(F.shiftrightunsigned(f"lane{j}", 32) + above, 15).bitwiseAND(pair)
        out = out.bitwiseOR(F.shiftleft(low.bitwiseOR(F.shiftleft(high, 32)), j))
    return out


def block_values() -> Column:
    width = 64 // BLOCKS
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", b * width).bitwiseAND((1 << width) - 1).alias("value")) for b in range(BLOCKS)])


def neighbours(reach: int) -> list[int]:
    """Masks that change at most ``reach`` bits of a block."""
    width = 64 // BLOCKS
    return [sum(1 << x for x in bits) for n in range(reach + 1) for bits in combinations(range(width), n)]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, repeat: bool | None = None) -> DataFrame:
    """(doc, ord, item, start, similarity): all windows as similar to an item, of documents by ``keyed``."""
    configure(docs.sparkSession)
    base = keyed(docs, id_col, text_col, repeat=repeat).select("doc", "ord", F.col("data").cast("string").alias("text"))
    item_rows = items.select(F.col("item_id").cast("long").alias("item"), F.explode(shingles(F.coalesce(F.col("text"), F.lit("")))).alias("h"))
    # items of one id and different texts are one item with all their shingles
    counts = written(item_rows.filter("item IS NOT NULL").groupBy("item", "h").agg(F.count(F.lit(1)).alias("c")), "items")
    sizes = counts.groupBy("item").agg(F.sum("c").alias("n"))
    small = counts.count() <= FEW
    hint = F.broadcast if small else (lambda x: x)
    lookup = counts.select("item", "h").join(hint(sizes), "item")

    placed = base.withColumn("all", shingles(F.col("text"))).select("doc", "ord", F.size("all").alias("long"), F.posexplode("all").alias("pos", "h"))
    hits = placed.join(hint(lookup), "h").select("doc", "ord", "long", "item", "n", "pos")
    per = hits.groupBy("doc", "ord", "item", "long", "n").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    w = F.least("n", "long").cast("int")
    need = F.ceil(F.lit(similarity) * (F.col("n") + F.col("w")) / (1 + similarity) - 1e-9).cast("int")
    per = per.withColumn("w", w).withColumn("need", need).filter(F.size("at") >= F.col("need"))
    enough = F.filter(
        F.transform(F.sequence(F.lit(1), F.size("at") - F.col("need") + 1), lambda i: F.when(F.element_at("at", i + F.col("need") - 1) - F.element_at("at", i) < F.col("w"), F.least(F.element_at("at", i), F.col("long") - F.col("w")))),
        lambda s: s.isNotNull(),
    )
    starts = per.select("doc", "ord", F.col("n").alias("size"), "w", F.explode(F.array_distinct(enough)).alias("start")).distinct()
    by_doc = starts.groupBy("doc", "ord").agg(F.collect_list(F.struct("size", "w", "start")).alias("windows"))
    # windows of contaminated documents only; the join doesn't depend on how many these are
    texts = by_doc.hint("merge").join(base, ["doc", "ord"])
    cut = texts.withColumn("all", shingles(F.col("text"))).select("doc", "ord", "all", F.explode("windows").alias("x"))
    cut = cut.select("doc", "ord", "x.size", "x.w", "x.start", F.explode(F.slice("all", F.col("x.start") + 1, F.col("x.w"))).alias("h"))
    window = ["doc", "ord", "size", "w", "start"]
    content = written(cut.groupBy(*window, "h").agg(F.count(F.lit(1)).alias("c")), "windows")

    weighed = lambda df, keys: df.withColumn("one", F.explode(F.expr("array_repeat(1, cast(c as int))"))).groupBy(*keys).agg(*lane_sums("h"), F.count(F.lit(1)).alias("k"))
    found = weighed(content, window).select(*window, fingerprint("k").alias("fp")).withColumn("b", F.explode(block_values()))
    filed = weighed(counts, ["item"]).join(hint(sizes), "item").select("item", F.col("n").alias("size"), fingerprint("k").alias("fp")).withColumn("b", F.explode(block_values()))
    filed = filed.withColumn("mask", F.explode(F.array(*map(F.lit, neighbours(REACH))))).select("item", "size", F.col("fp").alias("item_fp"), F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("mask")).alias("value"))
    radius = BLOCKS * (REACH + 1) - 1
    pairs = found.select(*window, "fp", F.col("b.block").alias("block"), F.col("b.value").alias("value")).join(filed, ["size", "block", "value"])
    pairs = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*window, "item").distinct()

    shared = pairs.join(content, window).join(counts.withColumnRenamed("c", "item_c"), ["item", "h"])
    verified = shared.groupBy(*window, "item").agg(F.sum(F.least("c", "item_c")).alias("both"))
    verified = verified.withColumn("similarity", F.col("both") / (F.col("size") + F.col("w") - F.col("both"))).filter(F.col("similarity") >= similarity - 1e-12)
    return verified.select("doc", "ord", "item", F.col("start").cast("long").alias("start"), "similarity")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, similarity): documents with a window as similar to an item, the best of each; start in shingles."""
    best = F.min(F.struct(F.negative("similarity").alias("minus"), "ord", "start")).alias("x")
    out = matches(docs, items, id_col, text_col, similarity).groupBy("doc", "item").agg(best)
    return out.select(restored("doc", id_col), F.col("item").alias("item_id"), F.col("x.start").alias("start"), (-F.col("x.minus")).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any contaminated window; of rows that share an id each is judged by its own text."""
    repeat = ids_repeat(docs, id_col)
    found = matches(docs, items, id_col, text_col, repeat=repeat).select(F.col("doc").alias("_doc"), F.col("ord").alias("_ord")).distinct()
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.join(found, (doc_key(id_col) == F.col("_doc")) & ((F.xxhash64(data) if repeat else F.lit(0).cast("long")) == F.col("_ord")), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
