"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source size`` times: a whole number of copies
and a fractional copy. Documents of a source meet in groups, largest first; a pair
transfers words from one fractional copy to the other, in a direction drawn so that each
expectation holds, until one is whole. The sum of words never moves, so a group
leaves one fraction; these residuals meet again in the next level of a reduction tree, and only
the last one of a source is drawn by itself. So a source's words differ from its
target by less than one copy of one document.

Draws depend on the id, the level and ``seed`` only, so reruns agree on any partitioning.
Nulls and empty texts: size 0, no words taken; they are repeated by the whole part of what their source is wanted. A null source is a source of its own, the last.
Null ids and rows that share an id are ordered by text; equal rows share one draw and go
separately. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.anchors import mix
from loomline.llm.common import WORD, configure, load, table, written

#: Rows of a group of the first level, and residuals of a group of the next ones.
GROUP, FAN_IN = 4096, 1024
#: Sources up to this many are broadcast; beyond, they are joined by a shuffle.
FEW = 100_000
STEP = "source string, group long, doc long, tie long, size long, share double, up long"


def words_of(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[float, ...], percent: float, most: float) -> DataFrame:
    """(source, n, source_size, target): ``percent`` of all sizes by weight, at most ``most`` times a source's size.

    One row a source: the excess above the stops goes to the others by weight until none is
    above, which is the level where the least stops in order of stop / weight are full.
    """
    sources = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("stop", F.col("source_size") * float(most))
    all_ = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(all_) * (percent / 100)
    s = s.withColumn("level", (wanted - F.coalesce(F.sum("stop").over(by_ratio), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    # from the first source that isn't full the levels fall, so it has the highest of those
    s = s.withColumn("level", F.max(F.when(F.col("stop") > F.col("level") * F.col("weight"), F.col("level"))).over(all_))
    return s.select("source", "n", "source_size", F.coalesce(F.least("stop", F.col("level") * F.col("weight")), F.col("stop")).alias("target"))


def draws(doc: np.ndarray, tie: np.ndarray, level: int, seed: int) -> np.ndarray:
    x = mix(doc.view(np.uint64) ^ mix(tie.view(np.uint64) + np.uint64(seed))) + np.uint64(level)
    return (mix(x) >> np.uint64(11)).astype(float) / (1 << 53)


def pivot(size: list[int], share: list[float], draw: list[float]) -> tuple[list[int], int, float]:
    """(copies, residual, its share): pairs in the given order; residual -1 if none is left fractional."""
    copies, held, a, p = [0] * len(size), -1, 0, 0.0
    for j, (b, q, u) in enumerate(zip(size, share, draw, strict=True)):
        if q >= 1 - 1e-12:
            copies[j] = 1
            continue
        if q <= 1e-12:
            continue
        if held < 0:
            held, a, p = j, b, q
            continue
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        move = up if u * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        if q > 1e-12 and q < 1 - 1e-12:  # so p is whole
            copies[held], held, a, p = round(p), j, b, q
        else:
            copies[j] = round(q)
            if p <= 1e-12 or p >= 1 - 1e-12:
                copies[held], held = round(p), -1
    return copies, held, p


def level_of(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """One level of the tree on (source, group, doc, tie, size, share): up is null for the group's residual."""

    def run(t: pa.Table) -> pa.Table:
        doc, tie, size, share = (t[x].to_numpy() for x in ("doc", "tie", "size", "share"))
        order = np.lexsort((tie, doc, -size))
        draw = draws(doc[order], tie[order], level, seed)
        copies, held, p = pivot(size[order].tolist(), share[order].tolist(), draw.tolist())
        up: list[int | None] = list(copies)
        left = share[order].copy()
        if held >= 0:
            left[held] = p
            alone = float(draws(doc[order][held : held + 1], tie[order][held : held + 1], level + 1000, seed)[0])
            up[held] = int(alone < p) if last else None
        t = t.take(pa.array(order))
        return t.set_column(t.schema.get_field_index("share"), "share", pa.array(left)).append_column("up", pa.array(up, pa.int64()))

    return rows.groupBy("source", "group").applyInArrow(run, STEP)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), percent: float = 150, most: float = 2, seed: int = 42, group: int = GROUP) -> DataFrame:
    """(doc_id, tie, size, source, source_size, target, copies): how often the mix takes each document."""
    spark = docs.sparkSession
    configure(spark)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(source_col).cast("string").alias("source"), words_of(text_col).alias("size"))
    sized = written(sized.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))), "sizes")
    targets = written(source_targets(sized, weights, percent, most), "targets")
    count, most_docs = targets.agg(F.count(F.lit(1)), F.max("n")).first()
    if count <= FEW:
        targets = F.broadcast(targets)
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("wanted", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.withColumn("whole", F.floor("wanted")).withColumn("share", F.when(F.col("size") > 0, F.col("wanted") - F.col("whole")).otherwise(0.0))
    # groups of about the same size within each source, whatever its share of all rows
    groups = F.ceil(F.col("n") / group)
    step = rows.withColumn("group", F.pmod(F.xxhash64("doc", "tie", F.lit(seed)), groups)).select("source", "group", "doc", "tie", "size", "share")
    levels = 1
    while math.ceil((most_docs or 0) / group) > FAN_IN ** (levels - 1):
        levels += 1
    done = None
    for level in range(levels):
        out = written(level_of(step, level, seed, level == levels - 1), "level")
        settled = out.filter("up IS NOT NULL").select("doc", "tie", "size", "up")
        done = settled if done is None else done.unionByName(settled)
        step = out.filter("up IS NULL").drop("up").withColumn("group", (F.col("group") / FAN_IN).cast("long"))
    # equal rows: as many settled rows as rows, matched by number
    number = F.row_number().over(Window.partitionBy("doc", "tie").orderBy("copies_order"))
    left = rows.withColumn("copies_order", F.col("whole")).withColumn("number", number)
    right = done.withColumn("copies_order", F.col("up")).withColumn("number", number).select("doc", "tie", "number", "up")
    joined = left.join(right, ["doc", "tie", "number"])
    return joined.select("doc_id", "tie", "size", "source", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents that a mixture takes, each as often as it does, with their own columns."""
    names = docs.columns
    keys = docs.select(*[F.col(x).alias(f"c{i}") for i, x in enumerate(names)])
    at = {x: f"c{i}" for i, x in enumerate(names)}
    own = keys.withColumn("_doc", F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(-(1 << 63)))).withColumn("_tie", F.xxhash64(at["text"]))
    times = mixed.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), F.col("tie").alias("_tie")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0")
    # equal rows share their copies: the first of them carry the remainder
    taken = own.join(times, ["_doc", "_tie"])
    plain = taken.filter("_rows = 1").withColumn("_n", F.col("_copies").cast("int"))
    number = F.row_number().over(Window.partitionBy("_doc", "_tie").orderBy(F.lit(1)))
    shared = taken.filter("_rows > 1").withColumn("_number", number).withColumn("_n", (F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_number") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)).cast("int")).drop("_number")
    both = plain.unionByName(shared).filter("_n > 0").withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("_n"))))
    return both.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(names)])
