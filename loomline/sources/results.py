"""Results that leave or enter the engine as files: ranked lists, weights, reports and digests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.operators import ranking

#: What a ranked row without a rank counts as.
LAST_RANK = 10**9


def ranked_predictions(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(user_id, item_id, rank) of a CSV: the first k distinct items of each user by given rank, then item. The rank column may be absent."""
    if k < 1:
        raise ValueError("k must be at least 1")
    raw = spark.read.option("header", True).csv(path)
    if missing := {"user_id", "item_id"} - set(raw.columns):
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    given = F.coalesce(F.expr("try_cast(trim(rank) AS double)").cast("long"), F.lit(LAST_RANK)) if "rank" in raw.columns else F.lit(LAST_RANK)
    rows = raw.select(expr.user_id(F.col("user_id")).alias("user_id"), expr.item_id(F.col("item_id")).alias("item_id"), given.alias("given"))
    best = rows.groupBy("user_id", "item_id").agg(F.min("given").alias("given"))
    order = Window.partitionBy("user_id").orderBy("given", "item_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("user_id", "item_id", F.col("rank").cast("long").alias("rank"))


def write_report(df: DataFrame, path: str) -> None:
    """A small table of aggregates as one JSON array, by Spark's file systems: a text file of one row in the folder ``path``."""
    row = F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns))))
    df.agg(row.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> list[dict]:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_weights(weights: dict[str, dict[str, float]], path: str, **more) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({**more, "best_weights": weights}, f, ensure_ascii=False, indent=2)


def load_weights(path: str) -> dict[str, dict[str, float]]:
    """Weights of all tiers: under ``best_weights`` or at the top. Channels that a tier lacks take their defaults; a missing tier raises."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    best = data.get("best_weights", data)
    if missing := [t for t in ranking.WEIGHTS if t not in best]:
        raise KeyError(f"{path} has no weights for {', '.join(missing)}")
    return {t: {c: float(best[t].get(c, w)) for c, w in by.items()} for t, by in ranking.WEIGHTS.items()}


def file_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, n_bytes, sha256) of files, read where the data are; files beyond 2 GB can't be one row and raise."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def sequence_channel(path: str) -> str:
    """The channel of an externally scored list, by its file's name."""
    return "sasrecf" if os.path.basename(path).lower().startswith("sasrecf") else "sasrec"
