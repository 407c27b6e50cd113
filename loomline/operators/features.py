"""Feature tables: items, customers, users at a point in time, and user-item pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import expr

# Article columns by how they become features.
NUMERIC_IDS = ("product_code", "product_type_no", "graphical_appearance_no", "colour_group_code", "perceived_colour_value_id", "perceived_colour_master_id", "department_no", "index_group_no", "section_no", "garment_group_no")
NAMES = ("product_type_name", "product_group_name", "graphical_appearance_name", "colour_group_name", "perceived_colour_value_name", "perceived_colour_master_name", "department_name", "index_code", "index_name", "index_group_name", "section_name", "garment_group_name")
TEXTS = ("prod_name", "detail_desc")
# Days of the user windows and of the popularity windows.
USER_WINDOWS, POPULARITY_WINDOWS = (1, 7, 28, 84, 182, 365), (7, 28)

#: Added before prices are rounded: as decimals they often lie just between two rounded values.
EDGE = 1e-9


def item_features(articles: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """One row an article: numbers, tokens and missing flags; items of ``also`` without an article get unknown rows."""
    have = set(articles.columns)
    c = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    columns: list[Column] = [F.lit(0.0).alias("is_unknown_item")]
    for name in NUMERIC_IDS:
        number, token, missing = expr.numeric_id(c(name))
        columns += [number.alias(f"{name}_number"), token.alias(f"{name}_token"), missing.alias(f"{name}_missing")]
    columns += [expr.category(c(name)).alias(f"{name}_token") for name in NAMES]
    for name in TEXTS:
        token, chars, words, missing = expr.text_parts(c(name))
        columns += [token.alias(f"{name}_token"), chars.alias(f"{name}_n_chars"), words.alias(f"{name}_n_tokens"), missing.alias(f"{name}_missing")]
    for name, parts in {"colour": ("colour_group_name", "perceived_colour_master_name"), "pattern": ("graphical_appearance_name",), "shade": ("perceived_colour_value_name",), "material": ("product_group_name", "garment_group_name")}.items():
        columns.append(expr.combo(*map(c, parts)).alias(f"{name}_combo"))
    out = articles.select("item_id", *columns)
    variants = F.count(F.lit(1)).over(Window.partitionBy("product_code_token")).cast("double")
    out = out.withColumn("n_style_variants", F.when(F.col("product_code_token") == expr.UNKNOWN, 1.0).otherwise(variants))
    if also is None:
        return out
    extra = also.select("item_id").distinct().join(articles.select("item_id"), "item_id", "left_anti")
    value = lambda name, kind: F.lit(expr.UNKNOWN) if kind == "string" else F.lit(1.0 if name.endswith("_missing") or name == "is_unknown_item" else 0.0)
    return out.unionByName(extra.select("item_id", *[value(n, k).alias(n) for n, k in out.dtypes if n != "item_id"]))


# Categories of the items of a sequence model.
SEQUENCE_ITEM_FIELDS = ("product_type_name", "department_name", "section_name", "garment_group_name", "colour_group_name", "index_name", "product_group_name", "graphical_appearance_name")


def sequence_items(features: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(item_id, eight category tokens) of item features, or of the items of ``wanted``: those without features are unknown."""
    tokens = features.select("item_id", *[F.col(f"{c}_token").alias(c) for c in SEQUENCE_ITEM_FIELDS])
    one = tokens.groupBy("item_id").agg(F.min(F.struct(*SEQUENCE_ITEM_FIELDS)).alias("x")).select("item_id", "x.*")
    if wanted is None:
        return one
    return wanted.select("item_id").distinct().join(one, "item_id", "left").na.fill(expr.UNKNOWN, list(SEQUENCE_ITEM_FIELDS))


def customer_features(customers: DataFrame, also: DataFrame | None = None) -> DataFrame:
    age, bucket, age_missing = expr.age_parts(F.col("age"))
    postal = expr.strip(F.col("postal_code"))
    known = expr.present(F.col("postal_code"))
    often = F.count(F.when(known, 1)).over(Window.partitionBy(postal))
    token = lambda c: expr.category(F.col(c))
    flag = lambda c: F.when(token(c) == expr.UNKNOWN, 1.0).otherwise(0.0)
    out = customers.select(
        "user_id",
        F.lit(0.0).alias("is_unknown_customer"),
        age.alias("age"),
        bucket.alias("age_bucket"),
        age_missing.alias("age_missing"),
        expr.binary_flag(F.col("FN")).alias("FN"),
        F.lit(0.0).alias("FN_missing"),
        expr.binary_flag(F.col("Active")).alias("Active"),
        F.lit(0.0).alias("Active_missing"),
        token("club_member_status").alias("club_member_status"),
        flag("club_member_status").alias("club_member_status_missing"),
        token("fashion_news_frequency").alias("fashion_news_frequency"),
        flag("fashion_news_frequency").alias("fashion_news_frequency_missing"),
        F.when(known, expr.category(postal)).otherwise(expr.UNKNOWN).alias("postal_code"),
        F.when(known, expr.postal_hash(F.col("postal_code"))).otherwise(expr.UNKNOWN).alias("postal_code_hash_bucket"),
        F.when(known, expr.postal_frequency(often)).otherwise(expr.UNKNOWN).alias("postal_code_freq_bucket"),
        F.when(known, 0.0).otherwise(1.0).alias("postal_code_missing"),
    )
    if also is None:
        return out
    extra = also.select("user_id").distinct().join(customers.select("user_id"), "user_id", "left_anti")
    value = lambda name, kind: F.lit(expr.UNKNOWN) if kind == "string" else F.lit(1.0 if name.endswith("_missing") or name == "is_unknown_customer" else 0.0)
    return out.unionByName(extra.select("user_id", *[value(n, k).alias(n) for n, k in out.dtypes if n != "user_id"]))


#: Parts of the events for each shuffle partition of the session.
PARTS = 4


def enriched(events: DataFrame, articles: DataFrame, bands: tuple[float, float]) -> DataFrame:
    """Events with item attributes, price band, and whether item and style were bought on an earlier day.

    The earlier purchase is a matter of the event alone, so no snapshot repeats it. Rows are dealt by user into many small parts: sums by user
    and snapshot then need no shuffle, and a part's groups fit in memory.
    """
    meta = articles.select("item_id", F.coalesce(F.trim("product_code"), F.lit("")).alias("style"), *[expr.category(F.col(c)).alias(a) for c, a in (("department_name", "department"), ("colour_group_name", "colour"), ("product_type_name", "product_type"))])
    out = events.join(meta, "item_id", "left").na.fill("", ["style"]).na.fill(expr.UNKNOWN, ["department", "colour", "product_type"])
    out = out.withColumn("price_band", expr.price_band(F.col("mean_price"), *bands))
    out = out.repartition(PARTS * int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")
    first = lambda *keys: F.min("date").over(Window.partitionBy("user_id", *keys))
    return out.withColumn("is_repeat", F.col("date") > first("item_id")).withColumn("is_style_repeat", (F.col("style") != "") & (F.col("date") > first("style")))


def user_features(rich: DataFrame, specs: DataFrame, windows: tuple[int, ...] = USER_WINDOWS, entropies: bool = True) -> DataFrame:
    """One row a user and snapshot with history: recency, gaps, and 14 measures for each window of days.

    Events meet the snapshots once; all windows are conditional sums of one pass, and the
    entropies come from sums by attribute value: ln(total) - sum(q ln q) / total. Without them events aren't repeated by attribute.
    """
    past = rich.join(F.broadcast(specs.select("as_of_date")), F.col("date") <= F.col("as_of_date")).withColumn("age", F.date_diff("as_of_date", "date"))
    q, spent = F.col("quantity"), F.col("mean_price") * F.col("quantity")
    # sets of one user's days and styles; several count_distinct would multiply the rows instead
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    sums: list[Column] = [F.min("age").alias("recency_days"), F.min("date").alias("d0"), F.max("date").alias("d1"), distinct(F.col("date")).alias("days")]
    for n in windows:
        inside = F.col("age") < n
        when = lambda c, inside=inside: F.coalesce(F.sum(F.when(inside, c)), F.lit(0))
        sums += [
            when(q).alias(f"q_{n}"),
            distinct(F.when(inside, F.col("date"))).alias(f"active_{n}"),
            F.coalesce(F.sum(F.when(inside, spent)), F.lit(0.0)).alias(f"spent_{n}"),
            when(F.when(F.col("mean_price").isNotNull(), q)).alias(f"priced_{n}"),
            when(F.when(F.col("sales_channel_mode") == 1, q)).alias(f"ch1_{n}"),
            when(F.when(F.col("sales_channel_mode") == 2, q)).alias(f"ch2_{n}"),
            distinct(F.when(inside & (F.col("style") != ""), F.col("style"))).alias(f"styles_{n}"),
            when(F.when(F.col("is_repeat"), q)).alias(f"repeat_{n}"),
            when(F.when(F.col("is_style_repeat"), q)).alias(f"style_{n}"),
        ]
    key = ["user_id", "as_of_date"]
    base = past.groupBy(*key).agg(*sums)
    attributes = ("department", "colour", "price_band") if entropies else ()
    if entropies:
        melted = past.select(*key, "age", "quantity", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).alias("v")) for a in attributes])).alias("x")).select(*key, "age", "quantity", "x.a", "x.v")
        by_value = melted.groupBy(*key, "a", "v").agg(*[F.sum(F.when(F.col("age") < n, q)).alias(f"n_{n}") for n in windows])
        logs = by_value.groupBy(*key).agg(*[F.sum(F.when(F.col("a") == a, F.col(f"n_{n}") * F.log(F.col(f"n_{n}").cast("double")))).alias(f"log_{a}_{n}") for a in attributes for n in windows])
        # both have one row a key, and lie with their users; a join on both keys would shuffle them
        both = base.unionByName(logs, allowMissingColumns=True)
        base = both.groupBy(*key).agg(*[F.max(c).alias(c) for c in both.columns if c not in key])
    share = lambda c, n: F.when(F.col(f"q_{n}") > 0, F.round(F.col(c) / F.nullif(F.col(f"q_{n}"), F.lit(0)), 6)).otherwise(0.0)
    out = [F.col("recency_days").cast("long").alias("recency_days"), F.when(F.col("days") > 1, F.round(F.date_diff("d1", "d0") / F.nullif(F.col("days") - 1, F.lit(0)), 6)).otherwise(0.0).alias("avg_gap_days")]
    for n in windows:
        total = F.nullif(F.col(f"q_{n}"), F.lit(0)).cast("double")
        out += [
            F.col(f"q_{n}").alias(f"purchase_count_{n}d"),
            F.col(f"active_{n}").alias(f"active_days_{n}d"),
            F.when(F.col(f"active_{n}") > 0, F.round(F.col(f"q_{n}") / F.nullif(F.col(f"active_{n}"), F.lit(0)), 6)).otherwise(0.0).alias(f"basket_size_{n}d"),
            F.round(F.col(f"spent_{n}") + EDGE, 4).alias(f"monetary_sum_{n}d"),
            F.when(F.col(f"priced_{n}") > 0, F.round(F.col(f"spent_{n}") / F.nullif(F.col(f"priced_{n}"), F.lit(0)) + EDGE, 4)).otherwise(0.0).alias(f"monetary_mean_{n}d"),
            share(f"ch1_{n}", n).alias(f"channel_1_share_{n}d"),
            share(f"ch2_{n}", n).alias(f"channel_2_share_{n}d"),
            *[F.round(F.coalesce(F.abs(F.log(total) - F.col(f"log_{a}_{n}") / total), F.lit(0.0)), 6).alias(f"{a}_entropy_{n}d") for a in attributes],
            F.col(f"styles_{n}").alias(f"style_diversity_{n}d"),
            share(f"repeat_{n}", n).alias(f"repeat_rate_{n}d"),
            F.when(F.col(f"q_{n}") > 0, F.round(1 - F.col(f"repeat_{n}") / F.nullif(F.col(f"q_{n}"), F.lit(0)), 6)).otherwise(0.0).alias(f"new_item_rate_{n}d"),
            share(f"style_{n}", n).alias(f"same_style_rate_{n}d"),
        ]
    return base.select(*key, *out)


def cross_features(pairs: DataFrame, rich: DataFrame, articles: DataFrame, cohorts: DataFrame) -> DataFrame:
    """pairs (user_id, item_id, as_of_date): 24 measures of a user's history against an item, all up to that day."""
    meta = articles.select("item_id", F.coalesce(F.trim("product_code"), F.lit("")).alias("style"), *[expr.category(F.col(c)).alias(a) for c, a in (("department_name", "department"), ("colour_group_name", "colour"), ("product_type_name", "product_type"))])
    rows = pairs.join(meta, "item_id").join(cohorts, "user_id", "left").withColumn("cohort", F.coalesce("cohort", F.lit(expr.UNKNOWN)))
    users = pairs.select("user_id", "as_of_date").distinct()
    past = rich.join(users, "user_id").filter(F.col("date") <= F.col("as_of_date"))
    key = ["user_id", "as_of_date"]
    q, priced = F.col("quantity"), F.col("mean_price").isNotNull()
    mean_price = F.sum(F.col("mean_price") * q) / F.nullif(F.sum(F.when(priced, q)), F.lit(0))
    channel = past.groupBy(*key, "sales_channel_mode").agg(F.sum(q).alias("n")).groupBy(*key).agg(F.max_by("sales_channel_mode", F.struct("n", F.negative("sales_channel_mode"))).alias("channel"))
    whole = past.groupBy(*key).agg(F.sum(q).alias("total"), mean_price.alias("user_mean_price")).join(channel, key)
    rows = rows.join(whole, key, "left")
    for level in ("item_id", "style", "department", "colour", "product_type"):
        name = "item" if level == "item_id" else level
        agg = past.filter(F.col(level) != "").groupBy(*key, level).agg(F.sum(q).alias(f"{name}_n"), F.max("date").alias(f"{name}_last"))
        rows = rows.join(agg, [*key, level], "left")
    # events meet the days of their own item: dealt by item once, and summed where they are
    sold = rich.select("user_id", "item_id", "date", "quantity", "mean_price", "sales_channel_mode").join(cohorts, "user_id", "left").withColumn("cohort", F.coalesce("cohort", F.lit(expr.UNKNOWN))).drop("user_id")
    world = sold.join(pairs.select("item_id", "as_of_date").distinct(), "item_id").filter(F.col("date") <= F.col("as_of_date"))
    age = F.date_diff("as_of_date", "date")
    counts = lambda kind: [F.sum(F.when(age < n, q)).alias(f"{kind}_{n}") for n in POPULARITY_WINDOWS]
    item = ["item_id", "as_of_date"]
    rows = rows.join(world.groupBy(*item).agg(mean_price.alias("candidate_mean_price"), *counts("global")), item, "left")
    rows = rows.join(world.groupBy(*item, F.col("sales_channel_mode").alias("channel")).agg(*counts("channel")), [*item, "channel"], "left")
    rows = rows.join(world.groupBy(*item, "cohort").agg(*counts("cohort")), [*item, "cohort"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    since = lambda c: F.date_diff("as_of_date", c).cast("double")
    share = lambda c: F.round(F.coalesce(F.col(c) / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6)
    same_style, same_item = n(F.col("style_n")) > 0, n(F.col("item_n")) > 0
    return rows.select(
        "user_id",
        "item_id",
        "as_of_date",
        *[n(F.col(f"{x}_n")).alias(f"user_{x}_purchase_count") for x in ("item", "style", "department", "colour", "product_type")],
        *[since(f"{x}_last").alias(f"user_{x}_recency_days") for x in ("item", "style", "department", "colour")],
        F.round(F.col("user_mean_price") + EDGE, 4).alias("user_mean_price"),
        F.round(F.col("candidate_mean_price") + EDGE, 4).alias("candidate_mean_price"),
        F.round(F.col("candidate_mean_price") - F.col("user_mean_price") + EDGE, 4).alias("price_diff"),
        *[share(f"{x}_n").alias(f"{x}_preference_match") for x in ("department", "colour", "product_type")],
        F.when(same_style, 1.0).otherwise(0.0).alias("user_bought_same_style"),
        F.when(same_style & ~same_item, 1.0).otherwise(0.0).alias("candidate_same_style_new_color"),
        *[n(F.col(f"{k}_{d}")).alias(f"item_{k}_purchase_count_{d}d") for d in POPULARITY_WINDOWS for k in ("global", "channel", "cohort")],
    )
