"""Data profiles: counts, null rates, extremes, join coverage and provenance."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import expr


def _missing(c: str) -> Column:
    return F.round(F.avg(F.when(F.coalesce(expr.strip(F.col(c)), F.lit("")) == "", 1.0).otherwise(0.0)), 6).alias(f"{c}_missing_rate")


def transactions(tx: DataFrame) -> DataFrame:
    return tx.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("item_id").alias("n_items"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.count_if(F.col("price") <= 0).alias("n_not_positive"),
        F.count_if(F.col("item_id").rlike("^[0-9]+\\.0+$")).alias("n_float_like_ids"),
        _missing("price"),
    )


def customers(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), *[_missing(c) for c in ("age", "FN", "club_member_status", "postal_code")])


def articles(df: DataFrame) -> DataFrame:
    """With the number of styles, and items that have more than one style."""
    codes = df.groupBy("item_id").agg(F.count_distinct("product_code").alias("codes"), F.count(F.lit(1)).alias("n"))
    per = codes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("codes") > 1).alias("n_conflicting"))
    return per.crossJoin(F.broadcast(df.agg(F.count_distinct("product_code").alias("n_styles"), *[_missing(c) for c in ("prod_name", "detail_desc")])))


def join_coverage(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the facts, and how many of them the dimension has."""
    keys = fact.select(key).distinct().join(dimension.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return keys.agg(F.lit(key).alias("key"), F.count(F.lit(1)).alias("n_keys"), F.count("_in").alias("n_found"), F.round(F.count("_in") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("coverage"))


def inter_stats(inter: DataFrame) -> DataFrame:
    return inter.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def referenced(dimension: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Rows of a dimension that the facts refer to."""
    return dimension.join(fact.select(key).distinct(), key, "left_semi")


def dataset_version(parts: dict) -> str:
    """First 12 digits of the SHA-256 of the canonical JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:12]
