"""Events, baskets, splits, snapshots, labels and sequences."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitBounds:
    window_start: date
    train_end: date
    valid_start: date
    valid_end: date
    test_start: date
    test_end: date


def split_bounds(anchor: date | None, train_weeks: int, valid_weeks: int, test_weeks: int) -> SplitBounds:
    """Dates of a window that ends on ``anchor``; without data, a window before all data."""
    if min(train_weeks, valid_weeks, test_weeks) < 1:
        raise ValueError("weeks must be at least 1")
    anchor = anchor or date(1, 1, 1) + timedelta(weeks=train_weeks + valid_weeks + test_weeks)
    day = timedelta(days=1)
    test_start = anchor - timedelta(weeks=test_weeks) + day
    valid_start = test_start - timedelta(weeks=valid_weeks)
    start = anchor - timedelta(weeks=train_weeks + valid_weeks + test_weeks) + day
    return SplitBounds(start, valid_start - day, valid_start, test_start - day, test_start, anchor)


def backtest_windows(anchor: date, train_weeks: int, valid_weeks: int, test_weeks: int, n: int = 3) -> list[tuple[int, SplitBounds, bool]]:
    """(number, bounds, official) of windows that end a week before one another; only the first is official."""
    return [(i, split_bounds(anchor - timedelta(weeks=i), train_weeks, valid_weeks, test_weeks), i == 0) for i in range(n)]


def required_weeks(train_weeks: int, valid_weeks: int, test_weeks: int, n: int = 3) -> int:
    return train_weeks + valid_weeks + test_weeks + n - 1


def user_day_item_events(tx: DataFrame) -> DataFrame:
    """One row a user, item and day: quantity, price statistics, most frequent channel (ties: the smaller), channels.

    Channels are counted in the first aggregation, so lines shuffle once.
    """
    key = ["user_id", "item_id", "date"]
    per = tx.groupBy(*key, "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"), F.count("price").alias("k"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    return per.groupBy(*key).agg(
        F.sum("n").alias("quantity"),
        (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("mean_price"),
        F.min("lo").alias("min_price"),
        F.max("hi").alias("max_price"),
        F.max_by("channel", F.struct("n", F.negative("channel"))).alias("sales_channel_mode"),
        F.count("channel").alias("n_channels"),
    )


def daily_baskets(events: DataFrame) -> DataFrame:
    baskets = events.groupBy("user_id", "date").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.sum("quantity").alias("quantity_sum"))
    return baskets.withColumn("n_items", F.size("items").cast("long"))


def split_label(df: DataFrame, b: SplitBounds) -> DataFrame:
    d = F.col("date")
    inside = df.filter(d.between(b.window_start, b.test_end))
    return inside.withColumn("split", F.when(d < F.lit(b.valid_start), "train").when(d < F.lit(b.test_start), "valid").otherwise("test"))


def eligible_users(train: DataFrame, least: int) -> DataFrame:
    """Users with enough training rows; rows of validation and test never count."""
    return train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_purchases")).filter(F.col("n_purchases") >= least)


def model_train(train: DataFrame, least: int) -> DataFrame:
    return train.join(eligible_users(train, least).select("user_id"), "user_id", "left_semi")


def item_universe(train: DataFrame, n: int) -> DataFrame:
    return train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_purchases")).orderBy(F.desc("n_purchases"), "item_id").limit(n)


def popularity_before(df: DataFrame, day: date) -> DataFrame:
    """Item counts strictly before ``day``."""
    return df.filter(F.col("date") < F.lit(day)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def user_item_counts_before(df: DataFrame, day: date) -> DataFrame:
    return df.filter(F.col("date") < F.lit(day)).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


def snapshot_specs(spark: SparkSession, b: SplitBounds, horizon: int = 7) -> DataFrame:
    """(as_of_date, split, label_start, label_end): weekly training days backwards, then validation and test."""
    days, at = [], b.train_end - timedelta(days=horizon)
    while at >= b.window_start:
        days.append((at, "train"))
        at -= timedelta(days=7)
    rows = [*reversed(days), (b.train_end, "valid"), (b.valid_end, "test")]
    out = [(d, s, d + timedelta(days=1), d + timedelta(days=horizon)) for d, s in rows]
    return spark.createDataFrame(out, "as_of_date date, split string, label_start date, label_end date")


def latest(specs: DataFrame, split: str, n: int) -> DataFrame:
    """The last ``n`` days of a split."""
    return specs.filter(F.col("split") == split).orderBy(F.desc("as_of_date")).limit(n)


def in_label_window(events: DataFrame, specs: DataFrame) -> DataFrame:
    """Events with each snapshot whose label window has their day: an equi-join on days, of which the few windows have a bounded number."""
    days = specs.withColumn("date", F.explode(F.sequence("label_start", "label_end")))
    return events.join(F.broadcast(days), "date")


def next_basket_labels(events: DataFrame, specs: DataFrame, styles: DataFrame) -> DataFrame:
    """Purchases of each label window, and whether item and style were bought before.

    First purchases are computed once for all snapshots.
    """
    labels = in_label_window(events, specs).groupBy("user_id", "item_id", "as_of_date", "split").agg(F.sum("quantity").alias("label_quantity"))
    first = events.groupBy("user_id", "item_id").agg(F.min("date").alias("first_item"))
    code = styles.select("item_id", F.coalesce(F.trim("product_code"), F.lit("")).alias("code"))
    first_style = first.join(code, "item_id").filter("code <> ''").groupBy("user_id", "code").agg(F.min("first_item").alias("first_style"))
    out = labels.join(first, ["user_id", "item_id"], "left").join(code, "item_id", "left").join(first_style, ["user_id", "code"], "left")
    repeat = F.coalesce(F.col("first_item") <= F.col("as_of_date"), F.lit(False))
    style = F.coalesce(F.col("first_style") <= F.col("as_of_date"), F.lit(False))
    return out.select("user_id", "item_id", "as_of_date", "split", F.lit(True).alias("label_purchase"), repeat.alias("label_repeat"), (~repeat).alias("label_new_to_user"), (~repeat & style).alias("label_same_style_new_color"), "label_quantity")


def snapshot_index(events: DataFrame, specs: DataFrame) -> DataFrame:
    """Users with a label in each snapshot: distinct label items, distinct history items, cold flag."""
    first = events.groupBy("user_id", "item_id").agg(F.min("date").alias("first"))
    users = in_label_window(events, specs).groupBy("user_id", "as_of_date", "split", "label_start", "label_end").agg(F.count_distinct("item_id").alias("n_label_items"))
    # only users with a label meet their own first purchases
    past = users.select("user_id", "as_of_date").join(first, "user_id").filter(F.col("first") <= F.col("as_of_date")).groupBy("user_id", "as_of_date").agg(F.count(F.lit(1)).alias("n_history_items"))
    n = F.coalesce("n_history_items", F.lit(0).cast("long"))
    return users.join(past, ["user_id", "as_of_date"], "left").withColumn("n_history_items", n).withColumn("is_cold_start", F.col("n_history_items") == 0)


def last_items(inter: DataFrame, n: int, max_days: int | None = None) -> DataFrame:
    """(user_id, items): the last ``n`` of the items by day and id, of the last ``max_days`` days if given."""
    day_items = inter.select("user_id", "date", "item_id").distinct()
    if max_days is not None:
        by_day = Window.partitionBy("user_id").orderBy(F.desc("date"))
        day_items = day_items.withColumn("day", F.dense_rank().over(by_day)).filter(F.col("day") <= max_days)
    latest_first = Window.partitionBy("user_id").orderBy(F.desc("date"), F.desc("item_id"))
    kept = day_items.withColumn("n", F.row_number().over(latest_first)).filter(F.col("n") <= n)
    return kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "item_id"))), lambda x: x["item_id"]).alias("items"))


def last_lines(tx: DataFrame, n: int) -> DataFrame:
    """(user_id, items): the last ``n`` lines with repeats, by day and item."""
    latest_first = Window.partitionBy("user_id").orderBy(F.desc("date"), F.desc("item_id"))
    kept = tx.withColumn("n", F.row_number().over(latest_first)).filter(F.col("n") <= n)
    return kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "item_id"))), lambda x: x["item_id"]).alias("items"))


def whole_days(baskets: DataFrame, most: int, max_days: int | None = None) -> DataFrame:
    """(user_id, items): whole days from the newest while at most ``most`` items; a larger newest day gives its first ones."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("date"))
    ranked = baskets.withColumn("day", F.row_number().over(newest)).withColumn("upto", F.sum(F.size("items")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    if max_days is not None:
        ranked = ranked.filter(F.col("day") <= max_days)
    kept = ranked.filter((F.col("upto") <= most) | (F.col("day") == 1)).withColumn("items", F.when(F.col("upto") > most, F.slice("items", 1, most)).otherwise(F.col("items")))
    return kept.groupBy("user_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("date", "items"))), lambda x: x["items"])).alias("items"))


def _recent(days: Column, most: int) -> Column:
    """Whole-day truncation of an array of daily baskets, oldest first."""
    newest = F.reverse(days)
    start = F.struct(F.array().cast("array<string>").alias("items"), F.lit(True).alias("open"))

    def add(acc, day):
        fits = acc["open"] & (F.size(acc["items"]) + F.size(day) <= most)
        return F.struct(F.when(fits, F.concat(day, acc["items"])).otherwise(acc["items"]).alias("items"), fits.alias("open"))

    all_ = F.aggregate(newest, start, add, lambda acc: acc["items"])
    return F.when((F.size(days) > 0) & (F.size(F.element_at(newest, 1)) > most), F.slice(F.element_at(newest, 1), 1, most)).otherwise(all_)


def sequence_samples(inter: DataFrame, split: str, b: SplitBounds, users: DataFrame | None, most: int = 50, max_days: int = 200) -> DataFrame:
    """(user_id, history, item_length, item_id, date): one sample an item of a day, from what came before.

    Training rolls day by day over eligible users; validation and test keep the history up to the
    day before they begin. A user's days are bounded by ``max_days`` in the window frame.
    """
    rows = inter.select("user_id", "item_id", "date").distinct()
    if split == "train":
        rows = rows.filter(F.col("date") < F.lit(b.valid_start))
        if users is not None:
            rows = rows.join(users.select("user_id"), "user_id", "left_semi")
        days = rows.groupBy("user_id", "date").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        before = Window.partitionBy("user_id").orderBy("date").rowsBetween(-max_days, -1)
        days = days.withColumn("past", F.collect_list("items").over(before))
    else:
        start, end = (b.valid_start, b.valid_end) if split == "valid" else (b.test_start, b.test_end)
        past = rows.filter(F.col("date") < F.lit(start)).groupBy("user_id", "date").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        newest = Window.partitionBy("user_id").orderBy(F.desc("date"))
        past = past.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= max_days).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "items"))), lambda x: x["items"]).alias("past"))
        days = rows.filter(F.col("date").between(start, end)).groupBy("user_id", "date").agg(F.array_sort(F.collect_set("item_id")).alias("items")).join(past, "user_id")
    out = days.select("user_id", "date", _recent(F.col("past"), most).alias("history"), F.explode("items").alias("item_id"))
    return out.filter(F.size("history") > 0).select("user_id", F.array_join("history", " ").alias("history"), F.size("history").cast("long").alias("item_length"), "item_id", "date")


def next_basket_targets(labels: DataFrame, split: str) -> DataFrame:
    """(user_id, item_id): what users of a split bought in their label windows; raises if there is nothing."""
    out = labels.filter((F.lower("split") == split) & F.coalesce("label_purchase", F.lit(False))).select("user_id", "item_id").distinct()
    if out.isEmpty():
        raise ValueError(f"no next-basket targets of split {split}")
    return out


def snapshot_users(candidates: DataFrame, index: DataFrame, split: str) -> DataFrame:
    """Candidates of users that a split's snapshots have."""
    return candidates.join(index.filter(F.col("split") == split).select("user_id").distinct(), "user_id", "left_semi")


def sorted_interactions(inter: DataFrame) -> DataFrame:
    """By user, time and item: a range sort, for a sink that keeps the order."""
    return inter.orderBy("user_id", "timestamp", "item_id")


def decreasing_days(df: DataFrame, order: str, day: str = "date") -> DataFrame:
    """(n_decreasing): neighbours in the order of a unique column whose day falls; null days are passed over.

    Rows are dealt by range of the order; within a part neighbours meet in a window, and parts meet by their first and last rows.
    """
    rows = df.filter(F.col(day).isNotNull()).select(F.col(order).alias("at"), F.col(day).alias("day"))
    parts = rows.repartitionByRange("at").withColumn("part", F.spark_partition_id())
    in_part = Window.partitionBy("part").orderBy("at")
    per = parts.withColumn("fell", F.col("day") < F.lag("day").over(in_part)).groupBy("part").agg(F.count_if("fell").alias("n"), F.min_by("day", "at").alias("first"), F.max_by("day", "at").alias("last"))
    # one row a partition
    return per.withColumn("edge", F.col("first") < F.lag("last").over(Window.orderBy("part"))).agg((F.coalesce(F.sum("n"), F.lit(0)) + F.count_if("edge")).alias("n_decreasing"))


def check_split(df: DataFrame) -> None:
    """Raises unless all splits have rows and follow one another."""
    spans = {x.split: (x.a, x.b) for x in df.groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    if set(spans) != {"train", "valid", "test"} or not spans["train"][1] < spans["valid"][0] <= spans["valid"][1] < spans["test"][0]:
        raise ValueError(f"splits are empty or overlap: {spans}")


def no_future(df: DataFrame, day: date) -> DataFrame:
    """df, raising at run time on rows of ``day`` or later."""
    late = F.raise_error(F.concat(F.lit("a row of "), F.col("date").cast("string"), F.lit(f" in a history before {day}")))
    return df.withColumn("date", F.when(F.col("date") < F.lit(day), F.col("date")).otherwise(late.cast("date")))
