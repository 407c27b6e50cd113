"""Readers of raw files and writers of results; schemas are fixed, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import expr

TRANSACTIONS = "t_dat date, customer_id string, article_id string, price double, sales_channel_id int"
INTERACTIONS = "user_id string, item_id string, timestamp double"
CANDIDATES = "user_id string, item_id string, channel string, score double, rank int, split string"
RANKED = "user_id string, item_id string, score double, rank int"


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Columns are taken by the header's names, in any order."""
    wanted = spark.createDataFrame([], schema).schema
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    have = {c.split(":")[0]: c for c in raw.columns}
    missing = [f.name for f in wanted if f.name not in have]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return raw.select(*[F.col(f"`{have[f.name]}`").cast(f.dataType).alias(f.name) for f in wanted])


def transactions(spark: SparkSession, path: str, weeks: int | None = None) -> DataFrame:
    """(user_id, item_id, date, price, channel); only the last ``weeks`` weeks if given."""
    raw = csv(spark, path, TRANSACTIONS)
    out = raw.select(expr.user_id(F.col("customer_id")).alias("user_id"), expr.item_id(F.col("article_id")).alias("item_id"), F.col("t_dat").alias("date"), "price", F.col("sales_channel_id").alias("channel"))
    if weeks is None:
        return out
    last = out.agg(F.max("date").alias("last"))
    return out.join(F.broadcast(last), F.col("date") >= expr.week_start(F.col("last"), weeks)).drop("last")


def catalogue(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """All columns as text, absent ones null, one row a key: the smallest of its rows."""
    raw = spark.read.option("header", True).csv(path)
    id_ = expr.item_id(F.col(key)) if key == "article_id" else expr.user_id(F.col(key))
    out = raw.select(id_.alias(key), *[(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in columns])
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in columns])
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def interactions(spark: SparkSession, *paths: str) -> DataFrame:
    """(user_id, item_id, timestamp, date) of tab-separated files with typed headers."""
    parts = [csv(spark, p, INTERACTIONS, "\t") for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(expr.user_id(F.col("user_id")).alias("user_id"), expr.item_id(F.col("item_id")).alias("item_id"), "timestamp", F.timestamp_seconds("timestamp").cast("date").alias("date"))


def channel_lists(spark: SparkSession, path: str) -> DataFrame:
    """Externally scored lists of a channel; absent scores are 0 and absent ranks the last."""
    return csv(spark, path, RANKED).select(expr.user_id(F.col("user_id")).alias("user_id"), expr.item_id(F.col("item_id")).alias("item_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rank", F.lit(999999)).alias("rank"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return checked_candidates(csv(spark, path, CANDIDATES))


def checked_candidates(df: DataFrame) -> DataFrame:
    """Canonical ids, lower-case channels; ranks below 1, empty channels and unknown splits raise."""
    channel, split = F.lower(expr.strip(F.col("channel"))), F.lower(expr.strip(F.col("split")))
    guard = lambda ok, value, what: F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(what)))
    return df.select(
        expr.user_id(F.col("user_id")).alias("user_id"),
        expr.item_id(F.col("item_id")).alias("item_id"),
        guard(channel != "", channel, "empty channel").alias("channel"),
        F.col("score").cast("double").alias("score"),
        guard(F.col("rank") >= 1, F.col("rank"), "rank below 1").cast("int").alias("rank"),
        guard(split.isin("train", "valid", "test"), split, "unknown split").alias("split"),
    )


def write_monthly(df: DataFrame, path: str, day: str = "date") -> None:
    df.withColumn("year_month", F.date_format(day, "yyyy-MM")).write.mode("overwrite").partitionBy("year_month").parquet(path)


def write_by_day(df: DataFrame, path: str, day: str = "as_of_date") -> None:
    df.write.mode("overwrite").partitionBy(day).parquet(path)


def write_tsv(df: DataFrame, path: str, types: dict[str, str]) -> None:
    """types: column -> suffix of the typed header; lists are joined by spaces."""
    cols: list[Column] = []
    for name, kind in types.items():
        value = F.array_join(name, " ") if kind == "token_seq" else F.col(name)
        cols.append(value.alias(f"{name}:{kind}"))
    df.select(*cols).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_csv(df: DataFrame, path: str, first: list[str]) -> None:
    """Key columns first; columns whose names begin with an underscore stay out."""
    rest = [c for c in df.columns if c not in first and not c.startswith("_")]
    df.select(*first, *rest).write.mode("overwrite").option("header", True).csv(path)
