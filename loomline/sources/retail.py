"""The retail domain over the star-schema tables: orders are purchases, parts articles."""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import history
from loomline.operators.recall import by_user

#: Weeks of history, validation and test: long enough that every tier has users.
TRAIN_WEEKS, VALID_WEEKS, TEST_WEEKS = 104, 4, 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, date, price, channel), one row a line item."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.lpad(F.col("l_partkey").cast("string"), 10, "0").alias("item_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("price"),
        (1 + F.col("l_linenumber") % 2).cast("int").alias("channel"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    return read(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("item_id"),
        F.concat_ws("_", "p_brand", "p_type").alias("product_code"),
        word(1).alias("colour_group_name"),
        word(2).alias("product_type_name"),
        F.col("p_brand").alias("department_name"),
        F.col("p_type").alias("garment_group_name"),
        F.concat(F.lit("S"), (F.col("p_size") % 10).cast("string")).alias("section_name"),
        F.col("p_name").alias("prod_name"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("detail_desc"),
        F.col("p_size").cast("string").alias("department_no"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"),
        F.when(key % 17 != 0, 18 + key % 60).cast("string").alias("age"),
        F.col("c_mktsegment").alias("club_member_status"),
        F.when(key % 5 == 0, F.lit("NONE")).otherwise("Regularly").alias("fashion_news_frequency"),
        F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("postal_code"),
        F.when(key % 3 == 0, "1").alias("FN"),
        (F.col("c_acctbal") > 0).cast("int").cast("string").alias("Active"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense mapping: (user_id, item_id, date, price, channel) of the events table."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.lpad(F.get_json_object("props", "$.k"), 10, "0").alias("item_id"),
        F.col("ts").cast("date").alias("date"),
        F.col("value").alias("price"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(2).alias("channel"),
    )


def last_day(orders: DataFrame, lines: DataFrame, few: int = 100_000) -> date | None:
    """The last day of an order with lines. The newest days' orders are looked for among the lines; only if none has any, or there are more than ``few``, are all joined."""
    days = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    key = lines.select(F.col("l_orderkey").alias("o_orderkey"))
    newest = days.agg(F.max("day")).first()[0]
    if newest is None:
        return None
    some = days.filter(F.col("day") >= F.lit(newest - timedelta(days=6)))
    last = key.join(F.broadcast(some), "o_orderkey").agg(F.max("day")).first()[0] if some.limit(few + 1).count() <= few else None
    return last or days.join(key, "o_orderkey", "left_semi").agg(F.max("day")).first()[0]


class Retail:
    """Tables of one directory and the split dates, which are the only values on the driver."""

    def __init__(self, spark: SparkSession, sf_dir: str, weeks: tuple[int, int, int] = (TRAIN_WEEKS, VALID_WEEKS, TEST_WEEKS), source=transactions):
        self.spark, self.sf_dir, self.weeks, self.source = spark, sf_dir, weeks, source

    @cached_property
    def tx(self) -> DataFrame:
        return self.source(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return history.user_day_item_events(self.tx)

    @cached_property
    def articles(self) -> DataFrame:
        return articles(self.spark, self.sf_dir)

    @cached_property
    def customers(self) -> DataFrame:
        return customers(self.spark, self.sf_dir)

    @cached_property
    def bounds(self) -> history.SplitBounds:
        if self.source is transactions:  # the orders table has the dates; no join for one value
            last = last_day(read(self.spark, self.sf_dir, "orders"), read(self.spark, self.sf_dir, "lineitem"))
        else:
            last = self.tx.agg(F.max("date")).first()[0]
        return history.split_bounds(last, *self.weeks)

    @cached_property
    def inter(self) -> DataFrame:
        """Distinct (user_id, item_id, date) within the split's window."""
        b = self.bounds
        return self.tx.filter(F.col("date").between(b.window_start, b.test_end)).select("user_id", "item_id", "date").distinct()

    @cached_property
    def known(self) -> DataFrame:
        """Interactions up to the end of validation, each user's in one part; all channels and the targets read them, so they are kept."""
        b = self.bounds
        rows = self.tx.filter(F.col("date").between(b.window_start, b.valid_end)).select("user_id", "item_id", "date")
        return by_user(rows).distinct().persist()

    @cached_property
    def past(self) -> DataFrame:
        """Interactions up to the day before validation."""
        return self.known.filter(F.col("date") <= F.lit(self.bounds.train_end))

    @cached_property
    def valid(self) -> DataFrame:
        b = self.bounds
        return self.known.filter(F.col("date").between(b.valid_start, b.valid_end))

    @cached_property
    def targets(self) -> DataFrame:
        return self.valid.select("user_id", "item_id").distinct().persist()

    @cached_property
    def target_users(self) -> DataFrame:
        return self.targets.select("user_id").distinct()
