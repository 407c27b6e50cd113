"""The registered queries over the retail mapping, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.operators import features, history, profile, ranking, recall
from loomline.plans import sql
from loomline.session import configure
from loomline.sources import retail

PER_CHANNEL, UNION, FINAL, HISTORY = 50, 500, 12, 200
#: Price bands of this table's unit prices.
BANDS = (1200.0, 1600.0)
CHANNELS = ("sequence", *recall.CHANNELS)


class Plan(retail.Retail):
    """Lazily composed plans that several queries share."""

    @cached_property
    def specs(self) -> DataFrame:
        return history.snapshot_specs(self.spark, self.bounds)

    @cached_property
    def labels(self) -> DataFrame:
        return history.next_basket_labels(self.events, self.specs, self.articles)

    @cached_property
    def history(self) -> DataFrame:
        return history.last_items(self.past, HISTORY)

    @cached_property
    def user_history(self) -> DataFrame:
        """Histories of the target users only, before any per-user join; most channels begin with them."""
        return history.last_items(self.past.join(self.target_users, "user_id", "left_semi"), HISTORY).persist()

    @cached_property
    def cohorts(self) -> DataFrame:
        c = features.customer_features(self.customers)
        return c.filter(F.col("age_bucket") != expr.UNKNOWN).select("user_id", F.col("age_bucket").alias("cohort"))

    @cached_property
    def tiers(self) -> DataFrame:
        return ranking.tiers(self.target_users, self.user_history)

    @cached_property
    def popularity(self) -> DataFrame:
        return recall.window_popularity(self.past).persist()

    @cached_property
    def popular(self) -> DataFrame:
        return recall.top(self.popularity, [], PER_CHANNEL).persist()

    @cached_property
    def sequences(self) -> DataFrame:
        """Users' items of the last weeks, which two channels read several times."""
        return recall.sequences(self.past).persist()

    @cached_property
    def tags(self) -> DataFrame:
        """Articles' category tokens, made once, after the articles' single file is dealt out."""
        return self.articles.repartition("item_id").select("item_id", *[expr.category(F.col(c)).alias(c) for c in recall.CATEGORY_FIELDS]).persist()

    @cached_property
    def buckets(self) -> DataFrame:
        return recall.segment_lists(self.past, self.tags, recall.CATEGORY_FIELDS, recall.BUCKET_TOP).persist()

    @cached_property
    def vectors(self) -> DataFrame:
        return recall.content_vectors(self.articles).persist()

    @cached_property
    def content_classes(self) -> tuple[DataFrame, DataFrame]:
        members, kinds = recall.content_classes(self.articles.repartition("item_id"))  # its single file is dealt out before texts are hashed
        kinds = kinds.persist()  # first, so that the members' plan, which is made when they are kept, reads the kept classes
        return members.persist(), kinds

    def channel(self, name: str) -> DataFrame:
        h, k = self.user_history, PER_CHANNEL
        builders = {
            # stands in for an external sequence model: transitions between neighbouring purchases
            "sequence": lambda: recall.recall_item2item(h, recall.neighbours(self.sequences, "sequential"), k),
            "popular": lambda: recall.recall_popular(self.target_users, h, self.popular, recall.cohort_lists(self.past, self.cohorts, k), self.cohorts, k),
            "category_popular": lambda: recall.recall_category(h, self.tags, self.buckets, k),
            "item2item": lambda: recall.recall_item2item(h, recall.neighbours(self.sequences, "cosine_iuf"), k),
            "repurchase": lambda: recall.recall_repurchase(self.past.join(self.target_users, "user_id", "left_semi"), F.lit(self.bounds.train_end), k),
            "style": lambda: recall.recall_style(h, recall.popular_siblings(self.popularity, self.articles), k),
            "content": lambda: recall.recall_classes(self.target_users, h, *self.content_classes, self.popular, k),
        }
        return recall.registry((name,), builders)[name]

    @cached_property
    def candidates(self) -> DataFrame:
        """The channels' lists: what all later steps start from, so they are kept (at most ``PER_CHANNEL`` rows a user and channel)."""
        return recall.candidates({c: self.channel(c) for c in CHANNELS}, "valid").persist()

    @cached_property
    def union(self) -> DataFrame:
        return ranking.union_candidates(self.candidates, UNION, dealt=True)

    @cached_property
    def weights(self) -> DataFrame:
        return ranking.weight_table(self.spark, ranking.WEIGHTS)

    @cached_property
    def fused(self) -> DataFrame:
        return ranking.fuse(self.union, self.tiers, self.weights, FINAL)

    @cached_property
    def per_user(self) -> DataFrame:
        return ranking.user_metrics(self.targets, self.fused, FINAL)

    @cached_property
    def strata(self) -> DataFrame:
        return ranking.strata(self.targets, self.user_history, self.tiers)

    @cached_property
    def rich(self) -> DataFrame:
        """Kept: feature tables read it up to ten times each."""
        return features.enriched(self.events, self.articles, BANDS).persist()

    @cached_property
    def ranking_rows(self) -> DataFrame:
        rows = ranking.union_evidence(self.candidates, CHANNELS, UNION, dealt=True).join(self.tiers.select("user_id", "history_len"), "user_id")
        day = F.lit(self.bounds.train_end)
        return rows.withColumn("snapshot_date", day).withColumn("group_id", expr.group_id(F.col("user_id"), F.col("snapshot_date")))

    @cached_property
    def ranking_dataset(self) -> DataFrame:
        labelled = ranking.with_labels(self.ranking_rows, self.targets, ["user_id", "item_id"])
        items = features.item_features(self.articles).select("item_id", "n_style_variants", "department_name_token")
        users = features.customer_features(self.customers).select("user_id", "age", "age_bucket")
        # rows lie by user, so customers come first, and all that is shuffled by item is shuffled once
        rows = ranking.with_features(ranking.with_features(labelled, users, ["user_id"], "customer_"), items, ["item_id"], "item_")
        added = [c for prefix in ("item_", "customer_") for c in rows.columns if c.startswith(prefix) and c not in labelled.columns]
        return rows.select(*labelled.columns, *added)

    @cached_property
    def pairs(self) -> DataFrame:
        return self.labels.select("user_id", "item_id", "as_of_date").distinct()


_PLANS: dict[tuple, Plan] = {}


def plan(spark: SparkSession, sf_dir: str, source) -> Plan:
    """One plan a session, directory and mapping, so that queries share what it has persisted."""
    key = (spark.sparkContext.applicationId, sf_dir, source.__name__)
    if key not in _PLANS:
        for old in [k for k in _PLANS if k[0] != key[0]]:
            del _PLANS[old]
        configure(spark)
        _PLANS[key] = Plan(spark, sf_dir, source=source)
    return _PLANS[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(body: str | None = None, name: str = "", source=retail.transactions, **extra: str):
    """Registers fn(plan) under its name, with SQL made of ``body`` and the sub-queries it reads."""

    def register(fn: Callable[[Plan], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(plan(spark, sf_dir, source))
        if body is not None:
            SQL[key] = sql.statement(body, **extra)
        return fn

    return register


R = lambda c, n=6: F.round(c, n).alias(c)
#: Prices are decimals, often just between two rounded values; the offset takes them off that edge.
PRICE = lambda c: F.round(F.col(c) + 1e-9, 4).alias(c)
EVENT_ROWS = "user_id, item_id, date, quantity, round(mean_price + 1e-9, 4) AS mean_price, round(min_price + 1e-9, 4) AS min_price, round(max_price + 1e-9, 4) AS max_price, sales_channel_mode, n_channels"


# ---- events, baskets, splits


@query(f"SELECT {EVENT_ROWS} FROM ev")
def events_user_day_item(p: Plan) -> DataFrame:
    return p.events.select("user_id", "item_id", "date", "quantity", PRICE("mean_price"), PRICE("min_price"), PRICE("max_price"), "sales_channel_mode", "n_channels")


@query("SELECT user_id, date, string_agg(item_id, ' ' ORDER BY item_id) AS items, count(*) AS n_items, CAST(sum(quantity) AS BIGINT) AS quantity_sum FROM ev GROUP BY ALL")
def baskets_daily(p: Plan) -> DataFrame:
    return history.daily_baskets(p.events).withColumn("items", F.array_join("items", " "))


@query("SELECT user_id, item_id, date, epoch(date) AS timestamp FROM tx, b WHERE date >= test_end - 181", name="interactions_window")
def interactions_window(p: Plan) -> DataFrame:
    recent = p.tx.filter(F.col("date") >= F.lit(p.bounds.test_end - timedelta(days=7 * 26 - 1)))
    return recent.select("user_id", "item_id", "date", F.unix_timestamp(F.col("date").cast("timestamp")).cast("double").alias("timestamp"))


SPLIT = "CASE WHEN date < valid_start THEN 'train' WHEN date < test_start THEN 'valid' ELSE 'test' END"


@query(f"SELECT user_id, item_id, date, {SPLIT} AS split FROM inter, b")
def time_split(p: Plan) -> DataFrame:
    return history.split_label(p.inter, p.bounds)


@query("SELECT window_start, train_end, valid_start, valid_end, test_start, test_end FROM b")
def split_bounds(p: Plan) -> DataFrame:
    b = p.bounds
    return p.spark.createDataFrame([(b.window_start, b.train_end, b.valid_start, b.valid_end, b.test_start, b.test_end)], "window_start date, train_end date, valid_start date, valid_end date, test_start date, test_end date")


@query("SELECT user_id, count(*) AS n_purchases FROM past GROUP BY user_id HAVING count(*) >= 5")
def model_train_eligible(p: Plan) -> DataFrame:
    return history.eligible_users(p.past, 5)


@query("SELECT item_id, count(*) AS n_purchases FROM past GROUP BY item_id ORDER BY 2 DESC, 1 LIMIT 500")
def item_universe_topn(p: Plan) -> DataFrame:
    return history.item_universe(p.past, 500)


@query("SELECT item_id, count(*) AS n FROM inter, b WHERE date < valid_start GROUP BY item_id")
def item_popularity_as_of(p: Plan) -> DataFrame:
    return history.popularity_before(p.inter, p.bounds.valid_start)


@query("SELECT user_id, item_id, count(*) AS n FROM inter, b WHERE date < valid_start GROUP BY ALL")
def user_item_counts_as_of(p: Plan) -> DataFrame:
    return history.user_item_counts_before(p.inter, p.bounds.valid_start)


@query(f"""SELECT window_id, split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, window_id = 0 AS official FROM (
  SELECT i.user_id, i.date, CAST(k AS INTEGER) AS window_id, CASE WHEN date < valid_start - CAST(7 * k AS INTEGER) THEN 'train' WHEN date < test_start - CAST(7 * k AS INTEGER) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT DISTINCT user_id, item_id, date FROM tx) i, b, generate_series(0, 2) AS g(k) WHERE date BETWEEN window_start - CAST(7 * k AS INTEGER) AND test_end - CAST(7 * k AS INTEGER)) GROUP BY ALL""")
def backtest_windows(p: Plan) -> DataFrame:
    windows = history.backtest_windows(p.bounds.test_end, *p.weeks)
    spec = p.spark.createDataFrame([(i, b.window_start, b.valid_start, b.test_start, b.test_end, official) for i, b, official in windows], "window_id int, a date, v date, t date, z date, official boolean")
    rows = p.tx.select("user_id", "item_id", "date").distinct().join(F.broadcast(spec), F.col("date").between(F.col("a"), F.col("z")))
    split = F.when(F.col("date") < F.col("v"), "train").when(F.col("date") < F.col("t"), "valid").otherwise("test")
    return rows.withColumn("split", split).groupBy("window_id", "split", "official").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT as_of_date, split, label_start, label_end FROM specs")
def snapshot_specs(p: Plan) -> DataFrame:
    return p.specs


@query("""SELECT user_id, as_of_date, split, label_start, label_end, count(DISTINCT item_id) AS n_label_items, coalesce(any_value(n), 0) AS n_history_items, coalesce(any_value(n), 0) = 0 AS is_cold_start
FROM ev JOIN specs ON date BETWEEN label_start AND label_end LEFT JOIN (SELECT user_id, as_of_date, count(DISTINCT item_id) AS n FROM ev JOIN specs ON date <= as_of_date GROUP BY ALL) USING (user_id, as_of_date) GROUP BY ALL""")
def snapshot_index(p: Plan) -> DataFrame:
    return history.snapshot_index(p.events, p.specs)


@query("SELECT * FROM lab")
def next_basket_labels(p: Plan) -> DataFrame:
    return p.labels


@query("SELECT user_id, array_to_string(items, ' ') AS items, CAST(len(items) AS INTEGER) AS n FROM hist")
def user_history_last_n(p: Plan) -> DataFrame:
    return p.history.select("user_id", F.array_join("items", " ").alias("items"), F.size("items").alias("n"))


WHOLE = """SELECT user_id, string_agg(item_id, ' ' ORDER BY date, item_id) AS items FROM (SELECT user_id, date, item_id, row_number() OVER (PARTITION BY user_id, date ORDER BY item_id) AS pos, day, upto FROM {0} JOIN
  (SELECT user_id, date, row_number() OVER w AS day, sum(c) OVER w AS upto FROM (SELECT user_id, date, count(*) AS c FROM {0} GROUP BY ALL) WINDOW w AS (PARTITION BY user_id ORDER BY date DESC)) USING (user_id, date))
  WHERE day <= 200 AND (upto <= 10 OR day = 1 AND pos <= 10) GROUP BY user_id"""


@query(WHOLE.format("past"))
def basket_history_whole_day(p: Plan) -> DataFrame:
    baskets = p.past.groupBy("user_id", "date").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return history.whole_days(baskets, 10, 200).withColumn("items", F.array_join("items", " "))


def samples_sql(split: str) -> str:
    """Days with their past days; the newest whole days within 20 items."""
    if split == "train":
        days = "SELECT past.* FROM past WHERE user_id IN (SELECT user_id FROM past GROUP BY 1 HAVING count(*) >= 5)"
        source, link = "tday", "h.date < t.date"
    else:
        days = "SELECT valid.* FROM valid" if split == "valid" else "SELECT inter.* FROM inter, b WHERE date >= test_start"
        source, link = ("past", "true") if split == "valid" else ("before", "true")
    return f"""WITH tday AS ({days}), hd AS (SELECT t.user_id, t.date, h.date AS hdate, count(*) AS c FROM (SELECT DISTINCT user_id, date FROM tday) t JOIN {source} h ON h.user_id = t.user_id AND {link} GROUP BY ALL),
  cum AS (SELECT *, row_number() OVER w AS day, sum(c) OVER w AS upto FROM hd WINDOW w AS (PARTITION BY user_id, date ORDER BY hdate DESC)),
  kept AS (SELECT cum.user_id, cum.date, h.item_id, hdate, row_number() OVER (PARTITION BY cum.user_id, cum.date, hdate ORDER BY h.item_id) AS pos, upto, day FROM cum JOIN {source} h ON h.user_id = cum.user_id AND h.date = hdate WHERE day <= 200 AND (upto <= 20 OR day = 1)),
  hs AS (SELECT user_id, date, string_agg(item_id, ' ' ORDER BY hdate, item_id) AS history, count(*) AS item_length FROM kept WHERE upto <= 20 OR pos <= 20 GROUP BY ALL)
  SELECT user_id, history, item_length, item_id, date FROM hs JOIN tday USING (user_id, date)"""


def _samples(split: str):
    extra = {"before": "SELECT inter.* FROM inter, b WHERE date < test_start"}

    @query(name=f"sequence_samples_{split}")
    def run(p: Plan) -> DataFrame:
        users = history.eligible_users(p.past, 5) if split == "train" else None
        return history.sequence_samples(p.inter, split, p.bounds, users, 20)

    head, _, tail = samples_sql(split).partition("WITH tday AS (")
    full = sql.statement("WITH tday AS (" + tail, **extra)
    # the local sub-queries join the shared ones in one WITH clause
    SQL[f"sequence_samples_{split}"] = full.replace("\nWITH tday AS (", ",\ntday AS (", 1)


for _split in ("train", "valid", "test"):
    _samples(_split)


# ---- retrieval


@query("SELECT item_id, score FROM pop")
def window_popularity(p: Plan) -> DataFrame:
    return recall.window_popularity(p.past)


@query("SELECT cohort, item_id, score, rank FROM cohort_list")
def popular_cohort(p: Plan) -> DataFrame:
    return recall.cohort_lists(p.past, p.cohorts, PER_CHANNEL)


@query("SELECT field, value, item_id, score, rank FROM seg", past_seg=sql.melted("past", ("garment_group_name", "section_name")), seg=sql.top(sql.popularity("past_seg", "field, value"), "field, value", 50))
def popular_segment(p: Plan) -> DataFrame:
    return recall.segment_lists(p.past, p.articles, ("garment_group_name", "section_name"), PER_CHANNEL)


@query("SELECT field, value, item_id, score, rank FROM bucket")
def category_popular_index(p: Plan) -> DataFrame:
    return p.buckets


@query("SELECT item_id, score FROM lines_pop", lines="SELECT tx.* FROM tx, b WHERE date BETWEEN window_start AND train_end", lines_pop=sql.popularity("lines"))
def baseline_popularity_lines(p: Plan) -> DataFrame:
    b = p.bounds
    return recall.window_popularity(p.tx.filter(F.col("date").between(b.window_start, b.train_end)))


@query("""SELECT user_id, string_agg(item_id, ' ' ORDER BY date, item_id) AS items FROM (SELECT tx.*, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, item_id DESC) AS n FROM tx, b WHERE date BETWEEN window_start AND train_end) WHERE n <= 20 GROUP BY user_id""")
def baseline_history_lines(p: Plan) -> DataFrame:
    b = p.bounds
    return history.last_lines(p.tx.filter(F.col("date").between(b.window_start, b.train_end)), 20).withColumn("items", F.array_join("items", " "))


_RECALL = {"popular": "r_popular", "category_popular": "r_category", "item2item": "r_item", "repurchase": "r_repurchase", "style": "r_style", "content": "r_content"}
for _name, _cte in _RECALL.items():

    @query(f"SELECT user_id, item_id, score, rank FROM {_cte}", name=f"recall_{_name}")
    def _recall(p: Plan, _name: str = _name) -> DataFrame:
        return p.channel(_name).select("user_id", "item_id", "score", "rank")


for _mode in ("raw_cooccur", "cosine_iuf", "time_decay", "sequential", "swing"):

    @query("SELECT item_a, item_id, score, rank FROM i2i", name=f"i2i_{_mode}", i2i=sql.neighbours(_mode))
    def _i2i(p: Plan, _mode: str = _mode) -> DataFrame:
        return recall.item_neighbours(p.past, _mode)


@query("SELECT item_id, token, round(w, 9) AS w FROM vec")
def content_tfidf(p: Plan) -> DataFrame:
    return p.vectors.select("item_id", "token", R("w", 9))


@query("SELECT user_id, item_id, channel, score, rank, split FROM un")
def candidate_union(p: Plan) -> DataFrame:
    return p.union.select("user_id", "item_id", "channel", "score", "rank", "split")


_EVIDENCE = ", ".join(f"CAST(count(*) FILTER (channel = '{c}') AS BIGINT) AS {c}_present, coalesce(max(score) FILTER (channel = '{c}'), 0.0) AS {c}_score, coalesce(max(rank) FILTER (channel = '{c}'), 0) AS {c}_rank" for c in CHANNELS)
_EVID = f"SELECT user_id, item_id, split, count(*) AS channel_count, min(rank) AS best_channel_rank, max(score) AS max_channel_score, {_EVIDENCE} FROM un GROUP BY ALL"


@query(_EVID)
def union_evidence(p: Plan) -> DataFrame:
    return ranking.union_evidence(p.candidates, CHANNELS, UNION, dealt=True)


# ---- fusion and metrics


@query("SELECT user_id, history_len, tier FROM tiers")
def activity_tier(p: Plan) -> DataFrame:
    return p.tiers


def fused_sql(weights: str = "wt", rows: str = "un") -> str:
    return sql.CTE["fused"].replace("FROM un ", f"FROM {rows} ").replace("JOIN wt ", f"JOIN {weights} ")


@query("SELECT user_id, item_id, score, rank FROM fused")
def rrf_default(p: Plan) -> DataFrame:
    return p.fused


@query("SELECT user_id, item_id, score, rank FROM f2", fresh="SELECT un.* FROM un ANTI JOIN seen USING (user_id, item_id)", f2=fused_sql(rows="fresh"))
def rrf_exclude_seen(p: Plan) -> DataFrame:
    return ranking.fuse(p.union, p.tiers, p.weights, FINAL, p.user_history)


_FIXED = {t: ranking.FIXED for t in ranking.WEIGHTS}


@query("SELECT user_id, item_id, score, rank FROM f2", w2=f"SELECT * FROM (VALUES {sql.values((t, c, w) for t, by in _FIXED.items() for c, w in by.items())}) AS t(tier, channel, weight)", f2=fused_sql("w2"))
def rrf_fixed_weights(p: Plan) -> DataFrame:
    return ranking.fuse(p.union, p.tiers, ranking.weight_table(p.spark, _FIXED), FINAL)


_MEANS = "count(*) AS n_users, round(avg(ap), 6) AS ap, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit"


@query("SELECT user_id, n_actual, round(ap, 6) AS ap, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, hit FROM per_user")
def metrics_per_user(p: Plan) -> DataFrame:
    return p.per_user.select("user_id", "n_actual", R("ap"), R("recall"), R("ndcg"), "hit")


@query(f"SELECT {_MEANS} FROM per_user")
def metrics_overall(p: Plan) -> DataFrame:
    return ranking.mean_metrics(p.per_user)


@query("SELECT t.tier, coalesce(n_users, 0) AS n_users, coalesce(ap, 0.0) AS ap, coalesce(recall, 0.0) AS recall, coalesce(ndcg, 0.0) AS ndcg, coalesce(hit, 0.0) AS hit FROM (VALUES ('cold_start'), ('low'), ('medium'), ('high')) AS t(tier) LEFT JOIN m USING (tier)", m=f"SELECT tier, {_MEANS} FROM per_user JOIN tiers USING (user_id) GROUP BY tier")
def metrics_by_tier(p: Plan) -> DataFrame:
    return ranking.metrics_by_tier(p.per_user, p.tiers)


@query("SELECT user_id, item_id, rank, ap, n_actual FROM poplist JOIN m ON true WHERE rank <= 12", m=f"SELECT user_id, n_actual, round(ap, 6) AS ap FROM ({sql.metrics('pp')})", pp="SELECT user_id, item_id, rank FROM users, poplist")
def popular_top12_map(p: Plan) -> DataFrame:
    """Every validation buyer gets the twelve most popular items; rows carry the user's average precision."""
    rows = p.target_users.crossJoin(F.broadcast(p.popular.filter(F.col("rank") <= FINAL).select("item_id", "rank")))
    return rows.join(ranking.user_metrics(p.targets, rows, FINAL).select("user_id", R("ap"), "n_actual"), "user_id")


# ---- diagnostics


_SCOPES = "SELECT {0}, unnest(['overall', 'activity:' || tier, 'warm_cold:' || warm_cold, 'purchase:' || stratum]) AS scope, recall, hit FROM {1} JOIN strata USING (user_id)"


@query("SELECT channel, scope, count(*) AS n_users, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM s GROUP BY ALL", ranked="SELECT user_id, channel, item_id, row_number() OVER (PARTITION BY user_id, channel ORDER BY score DESC, item_id) AS rank FROM cand", base="SELECT * FROM nact, (SELECT DISTINCT channel FROM cand)", m=sql.metrics("ranked", "channel, user_id", 50, "base"), s=_SCOPES.format("channel", "m"))
def diag_channel_recall(p: Plan) -> DataFrame:
    m = ranking.user_metrics(p.targets, ranking.top_per_channel(p.candidates, 50), 50, ("channel", "user_id"))
    return ranking.scoped(m, p.strata, ["channel"])


_UNION = "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, max(score) AS score FROM cand GROUP BY ALL)"


@query("SELECT k, scope, count(*) AS n_users, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit FROM s GROUP BY ALL", byscore=_UNION, m100=sql.metrics("byscore", k=100), m300=sql.metrics("byscore", k=300), m500=sql.metrics("byscore", k=500), m="SELECT 100 AS k, * FROM m100 UNION ALL SELECT 300, * FROM m300 UNION ALL SELECT 500, * FROM m500", s=_SCOPES.format("k", "m"))
def diag_union_recall(p: Plan) -> DataFrame:
    best = ranking.union_by_score(p.candidates, UNION)
    m = [ranking.user_metrics(p.targets, best, k).withColumn("k", F.lit(k)) for k in (100, 300, UNION)]
    return ranking.scoped(m[0].unionByName(m[1]).unionByName(m[2]), p.strata, ["k"])


@query("""SELECT a.c AS left, b2.c AS right, round(avg(CASE WHEN len(a.s) + len(b2.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b2.s)) / len(list_distinct(list_concat(a.s, b2.s))) END), 6) AS jaccard FROM sets a JOIN sets b2 ON a.user_id = b2.user_id AND a.n < b2.n GROUP BY ALL""", sets="SELECT user_id, c, n, list(item_id) FILTER (item_id IS NOT NULL) AS s0, coalesce(s0, []) AS s FROM (SELECT user_id, c, n FROM users, (SELECT unnest(" + repr(list(CHANNELS)) + ") AS c, unnest(range(7)) AS n)) LEFT JOIN (SELECT user_id, channel AS c, item_id FROM cand) USING (user_id, c) GROUP BY user_id, c, n")
def diag_jaccard(p: Plan) -> DataFrame:
    return ranking.channel_jaccard(p.candidates, p.target_users, CHANNELS, 50)


@query("SELECT channel, count(*) AS n_hits, count(*) FILTER (n = 1) AS n_exclusive, round(count(*) FILTER (n = 1) / count(*), 6) AS rate FROM (SELECT cand.*, count(*) OVER (PARTITION BY user_id, item_id) AS n FROM cand JOIN targets USING (user_id, item_id)) GROUP BY channel")
def diag_exclusive_hits(p: Plan) -> DataFrame:
    return ranking.exclusive_hits(p.candidates, p.targets, 50)


@query("SELECT count(*) AS n_users, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95 FROM (SELECT user_id, CAST(least(100, count(DISTINCT item_id)) AS DOUBLE) AS n FROM users LEFT JOIN cand USING (user_id) GROUP BY user_id)")
def diag_coverage(p: Plan) -> DataFrame:
    return ranking.coverage(p.candidates, p.target_users, 100)


# ---- features


_ITEM = [f"{c}_{x}" for c in ("product_code", "department_no") for x in ("number", "token", "missing")] + [f"{c}_token" for c in ("product_type_name", "colour_group_name", "department_name", "section_name", "garment_group_name", "index_name")]
_ITEM += [f"{c}_{x}" for c in ("prod_name", "detail_desc") for x in ("token", "n_chars", "n_tokens", "missing")] + ["colour_combo", "material_combo", "shade_combo", "n_style_variants", "is_unknown_item"]


def item_sql() -> str:
    cols = []
    for c in ("product_code", "department_no"):
        cols += [f"coalesce(TRY_CAST({c} AS DOUBLE), 0.0) AS {c}_number", f"{sql.category(c)} AS {c}_token", f"0.0::DOUBLE AS {c}_missing"]
    cols += [f"{sql.category(c)} AS {c}_token" for c in ("product_type_name", "colour_group_name", "department_name", "section_name", "garment_group_name")]
    cols += ["'unknown' AS index_name_token"]
    for c in ("prod_name", "detail_desc"):
        cols += [f"lower({c}) AS {c}_token", f"CAST(length({c}) AS DOUBLE) AS {c}_n_chars", f"CAST(len(string_split({c}, ' ')) AS DOUBLE) AS {c}_n_tokens", f"0.0::DOUBLE AS {c}_missing"]
    cols += [f"{sql.category('colour_group_name')} AS colour_combo", f"{sql.category('garment_group_name')} AS material_combo", "'unknown' AS shade_combo"]
    return f"SELECT item_id, {', '.join(cols)}, CAST(count(*) OVER (PARTITION BY product_code) AS DOUBLE) AS n_style_variants, 0.0::DOUBLE AS is_unknown_item FROM art"


@query(item_sql())
def item_features(p: Plan) -> DataFrame:
    return features.item_features(p.articles).select("item_id", *_ITEM)


_CUST = f"""SELECT user_id, 0.0::DOUBLE AS is_unknown_customer, coalesce(CAST(c.age AS DOUBLE), 0.0) AS age, coalesce(cohort, 'unknown') AS age_bucket, CASE WHEN c.age IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS age_missing,
  CASE WHEN fn = '1' THEN 1.0 ELSE 0.0 END::DOUBLE AS FN, 0.0::DOUBLE AS FN_missing, CASE WHEN active = '1' THEN 1.0 ELSE 0.0 END::DOUBLE AS Active, 0.0::DOUBLE AS Active_missing,
  {sql.category('club_member_status')} AS club_member_status, 0.0::DOUBLE AS club_member_status_missing, {sql.category('fashion_news_frequency')} AS fashion_news_frequency,
  CASE WHEN {sql.category('fashion_news_frequency')} = 'unknown' THEN 1.0 ELSE 0.0 END::DOUBLE AS fashion_news_frequency_missing, {sql.category('postal_code')} AS postal_code,
  printf('h%02d', CAST('0x' || substr(sha256(postal_code), 1, 8) AS BIGINT) % 100) AS postal_code_hash_bucket,
  CASE WHEN n <= 1 THEN 'singleton' WHEN n <= 5 THEN 'rare' WHEN n <= 50 THEN 'medium' ELSE 'common' END AS postal_code_freq_bucket, 0.0::DOUBLE AS postal_code_missing
  FROM (SELECT *, count(*) OVER (PARTITION BY postal_code) AS n FROM cust) c LEFT JOIN cohorts USING (user_id)"""


@query(_CUST)
def customer_features(p: Plan) -> DataFrame:
    return features.customer_features(p.customers)


@query("SELECT postal_code_freq_bucket, count(DISTINCT postal_code) AS n_codes, count(*) AS n_users FROM cf GROUP BY 1", cf=_CUST)
def postal_buckets(p: Plan) -> DataFrame:
    return features.customer_features(p.customers).groupBy("postal_code_freq_bucket").agg(F.count_distinct("postal_code").alias("n_codes"), F.count(F.lit(1)).alias("n_users"))


def user_sql() -> str:
    cols = ["CAST(min(age) AS BIGINT) AS recency_days", "CASE WHEN count(DISTINCT date) > 1 THEN round((max(date) - min(date)) / (count(DISTINCT date) - 1), 6) ELSE 0.0 END AS avg_gap_days"]
    for n in features.USER_WINDOWS:
        f = f"FILTER (age < {n})"
        q = f"coalesce(sum(quantity) {f}, 0)"
        share = lambda cond, n=n, q=q: f"CASE WHEN {q} > 0 THEN round(coalesce(sum(quantity) FILTER (age < {n} AND {cond}), 0) / {q}, 6) ELSE 0.0 END"
        spent, priced = f"coalesce(sum(mean_price * quantity) {f}, 0.0)", f"sum(quantity) FILTER (age < {n} AND mean_price IS NOT NULL)"
        cols += [
            f"CAST({q} AS BIGINT) AS purchase_count_{n}d",
            f"count(DISTINCT date) {f} AS active_days_{n}d",
            f"CASE WHEN count(DISTINCT date) {f} > 0 THEN round({q} / count(DISTINCT date) {f}, 6) ELSE 0.0 END AS basket_size_{n}d",
            f"round({spent} + 1e-9, 4) AS monetary_sum_{n}d",
            f"CASE WHEN {priced} > 0 THEN round({spent} / {priced} + 1e-9, 4) ELSE 0.0 END AS monetary_mean_{n}d",
            f"{share('sales_channel_mode = 1')} AS channel_1_share_{n}d",
            f"{share('sales_channel_mode = 2')} AS channel_2_share_{n}d",
            f"count(DISTINCT style) FILTER (age < {n} AND style <> '') AS style_diversity_{n}d",
            f"{share('is_repeat')} AS repeat_rate_{n}d",
            f"CASE WHEN {q} > 0 THEN round(1 - coalesce(sum(quantity) FILTER (age < {n} AND is_repeat), 0) / {q}, 6) ELSE 0.0 END AS new_item_rate_{n}d",
            f"{share('is_style_repeat')} AS same_style_rate_{n}d",
        ]
    ents = []
    for a in ("department", "colour", "price_band"):
        each = ", ".join(f"round(coalesce(abs(sum(-q{n} / t{n} * ln(q{n} / t{n})) FILTER (q{n} > 0)), 0.0), 6) AS {a}_entropy_{n}d" for n in features.USER_WINDOWS)
        sums = ", ".join(f"CAST(sum(quantity) FILTER (age < {n}) AS DOUBLE) AS q{n}, sum(sum(quantity) FILTER (age < {n})) OVER (PARTITION BY user_id, as_of_date) AS t{n}" for n in features.USER_WINDOWS)
        ents.append(f"JOIN (SELECT user_id, as_of_date, {each} FROM (SELECT user_id, as_of_date, {a}, {sums} FROM pit GROUP BY user_id, as_of_date, {a}) GROUP BY ALL) USING (user_id, as_of_date)")
    return f"SELECT * FROM (SELECT user_id, as_of_date, {', '.join(cols)} FROM pit GROUP BY user_id, as_of_date) {' '.join(ents)}"


_PIT = "SELECT rich.*, as_of_date, as_of_date - date AS age FROM rich JOIN specs ON date <= as_of_date"


@query(user_sql(), pit=_PIT)
def user_features_pit(p: Plan) -> DataFrame:
    return features.user_features(p.rich, p.specs)


@query(f"SELECT user_id, as_of_date, {', '.join(f'repeat_rate_{n}d, new_item_rate_{n}d, same_style_rate_{n}d' for n in (28, 365))} FROM uf", pit=_PIT, uf=user_sql())
def repeat_rates(p: Plan) -> DataFrame:
    names = [f"{x}_{n}d" for n in (28, 365) for x in ("repeat_rate", "new_item_rate", "same_style_rate")]
    return features.user_features(p.rich, p.specs, (28, 365), entropies=False).select("user_id", "as_of_date", *names)


@query(f"SELECT user_id, as_of_date, {', '.join(f'{a}_entropy_{n}d' for a in ('department', 'colour', 'price_band') for n in (84, 365))} FROM uf", pit=_PIT, uf=user_sql())
def entropy_features(p: Plan) -> DataFrame:
    names = [f"{a}_entropy_{n}d" for a in ("department", "colour", "price_band") for n in (84, 365)]
    return features.user_features(p.rich, p.specs, (84, 365)).select("user_id", "as_of_date", *names)


def cross_sql() -> str:
    levels = {"item": "item_id", "style": "style", "department": "department", "colour": "colour", "product_type": "product_type"}
    cols = [f"CAST(coalesce(sum(h.quantity) FILTER (h.{c} = p.{c} AND h.{c} <> ''), 0) AS DOUBLE) AS user_{x}_purchase_count" for x, c in levels.items()]
    cols += [f"CAST(any_value(p.as_of_date) - max(h.date) FILTER (h.{c} = p.{c} AND h.{c} <> '') AS DOUBLE) AS user_{x}_recency_days" for x, c in levels.items() if x != "product_type"]
    cols += ["sum(h.mean_price * h.quantity) / sum(h.quantity) FILTER (h.mean_price IS NOT NULL) AS ump"]
    cols += [f"round(coalesce(coalesce(sum(h.quantity) FILTER (h.{c} = p.{c}), 0) / sum(h.quantity), 0.0), 6) AS {c}_preference_match" for c in ("department", "colour", "product_type")]
    mine = f"SELECT p.user_id, p.item_id, p.as_of_date, {', '.join(cols)} FROM prs p LEFT JOIN rich h ON h.user_id = p.user_id AND h.date <= p.as_of_date GROUP BY p.user_id, p.item_id, p.as_of_date"
    wins = ", ".join(f"CAST(coalesce(sum(w.quantity) FILTER (p.as_of_date - w.date < {d}{cond}), 0) AS DOUBLE) AS item_{k}_purchase_count_{d}d" for d in features.POPULARITY_WINDOWS for k, cond in (("global", ""), ("channel", " AND w.sales_channel_mode = p.channel"), ("cohort", " AND coalesce(wc.cohort, 'unknown') = p.cohort")))
    world = f"SELECT p.user_id, p.item_id, p.as_of_date, sum(w.mean_price * w.quantity) / sum(w.quantity) FILTER (w.mean_price IS NOT NULL) AS cmp, {wins} FROM prs p LEFT JOIN rich w ON w.item_id = p.item_id AND w.date <= p.as_of_date LEFT JOIN cohorts wc ON wc.user_id = w.user_id GROUP BY p.user_id, p.item_id, p.as_of_date"
    names = [f"user_{x}_purchase_count" for x in levels] + [f"user_{x}_recency_days" for x in levels if x != "product_type"]
    return f"""SELECT user_id, item_id, as_of_date, {', '.join(names)}, round(ump + 1e-9, 4) AS user_mean_price, round(cmp + 1e-9, 4) AS candidate_mean_price, round(cmp - ump + 1e-9, 4) AS price_diff,
  department_preference_match, colour_preference_match, product_type_preference_match, CASE WHEN user_style_purchase_count > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS user_bought_same_style,
  CASE WHEN user_style_purchase_count > 0 AND user_item_purchase_count = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS candidate_same_style_new_color,
  {', '.join(f'item_{k}_purchase_count_{d}d' for d in features.POPULARITY_WINDOWS for k in ('global', 'channel', 'cohort'))} FROM ({mine}) JOIN ({world}) USING (user_id, item_id, as_of_date)"""


@query(
    cross_sql(),
    prs=f"""SELECT x.user_id, x.item_id, as_of_date, product_code AS style, {sql.category('department_name')} AS department, {sql.category('colour_group_name')} AS colour, {sql.category('product_type_name')} AS product_type,
  coalesce(cohort, 'unknown') AS cohort, channel FROM (SELECT DISTINCT user_id, item_id, as_of_date FROM lab) x JOIN art USING (item_id) LEFT JOIN cohorts USING (user_id) LEFT JOIN dominant USING (user_id, as_of_date)""",
    dominant="SELECT user_id, as_of_date, (list(sales_channel_mode ORDER BY n DESC, sales_channel_mode))[1] AS channel FROM (SELECT user_id, as_of_date, sales_channel_mode, sum(quantity) AS n FROM ev JOIN specs ON date <= as_of_date GROUP BY ALL) GROUP BY ALL",
)
def cross_features(p: Plan) -> DataFrame:
    return features.cross_features(p.pairs, p.rich, p.articles, p.cohorts)


# ---- ranking tables


_RANK = "SELECT e.*, history_len, train_end AS snapshot_date, user_id || '@' || strftime(train_end, '%Y-%m-%d') AS group_id FROM evidence e JOIN tiers USING (user_id) JOIN b ON true"


@query("SELECT * FROM rr", evidence=_EVID, rr=_RANK)
def ranking_features(p: Plan) -> DataFrame:
    return p.ranking_rows


_DATA = f"""SELECT rr.*, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS label, CAST(v.n AS DOUBLE) AS item_n_style_variants, v.department AS item_department_name_token, 0.0::DOUBLE AS item_missing,
  coalesce(c.age, 0.0)::DOUBLE AS customer_age, coalesce(cohort, 'unknown') AS customer_age_bucket, CASE WHEN c.user_id IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS customer_missing FROM rr LEFT JOIN targets t USING (user_id, item_id)
  JOIN (SELECT item_id, count(*) OVER (PARTITION BY product_code) AS n, {sql.category('department_name')} AS department FROM art) v USING (item_id) LEFT JOIN cust c USING (user_id) LEFT JOIN cohorts USING (user_id)"""
_RD = {"evidence": _EVID, "rr": _RANK, "rd": _DATA}


@query("SELECT * FROM rd", **_RD)
def ranking_dataset(p: Plan) -> DataFrame:
    return p.ranking_dataset


@query("SELECT count(*) AS n_uncovered FROM targets ANTI JOIN q USING (user_id, item_id)", q="SELECT DISTINCT user_id, item_id FROM un")
def uncovered_labels(p: Plan) -> DataFrame:
    return ranking.uncovered(p.targets, p.union, ["user_id", "item_id"])


@query("SELECT user_id, item_id, CAST(coalesce(k1.n, 0) AS DOUBLE) AS item_department_name_token_code, CAST(coalesce(k2.n, 0) AS DOUBLE) AS customer_age_bucket_code FROM rd LEFT JOIN k1 ON item_department_name_token = k1.v LEFT JOIN k2 ON customer_age_bucket = k2.v", **_RD, k1="SELECT v, row_number() OVER (ORDER BY v) AS n FROM (SELECT DISTINCT item_department_name_token AS v FROM rd WHERE v <> 'unknown')", k2="SELECT v, row_number() OVER (ORDER BY v) AS n FROM (SELECT DISTINCT customer_age_bucket AS v FROM rd WHERE v <> 'unknown')")
def rank_matrix_encoding(p: Plan) -> DataFrame:
    cols = ["item_department_name_token", "customer_age_bucket"]
    rows = p.ranking_dataset.select("user_id", "item_id", *cols)
    return ranking.encoded(rows, rows, cols).select("user_id", "item_id", *[f"{c}_code" for c in cols])


@query("SELECT group_id, item_id, label FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n, sum(label) OVER (PARTITION BY group_id) AS pos FROM rd) WHERE n >= 2 AND pos > 0", **_RD)
def group_filter(p: Plan) -> DataFrame:
    return ranking.learnable(p.ranking_dataset.select("group_id", "item_id", "label"))


@query("SELECT user_id, item_id FROM lab WHERE split = 'valid' GROUP BY ALL")
def next_basket_targets(p: Plan) -> DataFrame:
    return history.next_basket_targets(p.labels, "valid")


@query("SELECT group_id, count(*) AS n_rows FROM rr GROUP BY group_id", evidence=_EVID, rr=_RANK)
def ranking_group_sizes(p: Plan) -> DataFrame:
    return ranking.group_sizes(p.ranking_rows)


@query("SELECT group_id, item_id, max_channel_score, row_number() OVER (PARTITION BY group_id ORDER BY max_channel_score DESC, item_id) AS pred_rank FROM rr", evidence=_EVID, rr=_RANK)
def rank_within_group(p: Plan) -> DataFrame:
    return ranking.rank_in_group(p.ranking_rows.select("group_id", "item_id", "max_channel_score"), "group_id", "max_channel_score")


# ---- weight search and variants


_GRIDS = {t: ranking.weight_grid(t, 0.05) for t in ranking.RANGES}
_GRID_SQL = """SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY s, p, c, i) - 1 AS grid_id, s / 100 AS sequence, p / 100 AS popular, c / 100 AS category_popular, i / 100 AS item2item FROM
  (VALUES ('high', 45, 70, 5, 25, 5, 25, 10, 30), ('medium', 30, 55, 15, 40, 10, 30, 10, 30), ('low', 0, 25, 40, 75, 10, 35, 0, 20), ('cold_start', 0, 0, 60, 90, 10, 40, 0, 0)) AS r(tier, s0, s1, p0, p1, c0, c1, i0, i1),
  generate_series(0, 100, 5) AS gs(s), generate_series(0, 100, 5) AS gp(p), generate_series(0, 100, 5) AS gc(c), generate_series(0, 100, 5) AS gi(i)
  WHERE s BETWEEN s0 AND s1 AND p BETWEEN p0 AND p1 AND c BETWEEN c0 AND c1 AND i BETWEEN i0 AND i1 AND s + p + c + i = 100"""


@query(f"SELECT tier, CAST(grid_id AS INTEGER) AS grid_id, sequence, popular, category_popular, item2item FROM ({_GRID_SQL})")
def weight_grid(p: Plan) -> DataFrame:
    rows = [(t, i, *(by[c] for c in ranking.BASE)) for t, grid in _GRIDS.items() for i, by in enumerate(grid)]
    return p.spark.createDataFrame(rows, "tier string, grid_id int, sequence double, popular double, category_popular double, item2item double")


_GRID_ROWS = f"SELECT tier, grid_id, channel, weight FROM ({_GRID_SQL}) UNPIVOT (weight FOR channel IN (sequence, popular, category_popular, item2item))"


@query(
    "SELECT g.tier, CAST(g.grid_id AS INTEGER) AS grid_id, n_users, round(coalesce(s, 0.0) / n_users, 9) AS map FROM (SELECT DISTINCT tier, grid_id FROM grid) g JOIN sizes USING (tier) LEFT JOIN (SELECT tier, grid_id, sum(p / least(n_actual, 12)) AS s FROM gap JOIN nact USING (user_id) GROUP BY ALL) USING (tier, grid_id)",
    grid=_GRID_ROWS,
    sizes="SELECT tier, count(*) AS n_users FROM tiers GROUP BY tier",
    gs="SELECT tier, grid_id, user_id, item_id, row_number() OVER (PARTITION BY tier, grid_id, user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT tier, grid_id, user_id, item_id, round(sum(weight / rank), 9) AS score FROM un JOIN tiers USING (user_id) JOIN grid USING (tier, channel) WHERE weight > 0 GROUP BY ALL)",
    gap="SELECT tier, grid_id, user_id, sum(c / rank) AS p FROM (SELECT gs.*, count(*) OVER (PARTITION BY tier, grid_id, user_id ORDER BY rank) AS c FROM gs JOIN targets USING (user_id, item_id) WHERE rank <= 12) GROUP BY ALL",
)
def weight_grid_scores(p: Plan) -> DataFrame:
    return ranking.grid_scores(p.union, p.targets, p.tiers, _GRIDS, FINAL)


def _variants(p: Plan) -> DataFrame:
    fixed = ranking.fuse(p.union, p.tiers, ranking.weight_table(p.spark, _FIXED), FINAL)
    out = None
    for name, fused in (("default", p.fused), ("fixed", fixed)):
        m = ranking.user_metrics(p.targets, fused, FINAL).join(p.tiers, "user_id")
        rows = m.groupingSets([[], ["tier"]], "tier").agg(F.avg("ap").alias("map")).select(F.lit(name).alias("variant"), F.coalesce("tier", F.lit("overall")).alias("tier"), "map")
        out = rows if out is None else out.unionByName(rows)
    return out


_VAR = {
    "w2": f"SELECT * FROM (VALUES {sql.values((t, c, w) for t, by in _FIXED.items() for c, w in by.items())}) AS t(tier, channel, weight)",
    "f2": fused_sql("w2"),
    "m1": sql.metrics("fused"),
    "m2": sql.metrics("f2"),
    "vv": "SELECT variant, coalesce(tier, 'overall') AS tier, avg(ap) AS map FROM (SELECT 'default' AS variant, user_id, ap FROM m1 UNION ALL SELECT 'fixed', user_id, ap FROM m2) JOIN tiers USING (user_id) GROUP BY GROUPING SETS ((variant), (variant, tier))",
}


@query("SELECT variant, tier, round(map, 6) AS map FROM vv", **_VAR)
def checkpoint_map(p: Plan) -> DataFrame:
    return _variants(p).select("variant", "tier", R("map"))


@query("""SELECT variant, round(delta, 6) AS delta, round(worst, 6) AS worst_drop, delta > 0 AND worst <= 0.05 AS replace FROM (SELECT v.variant, max(v.map - b2.map) FILTER (v.tier = 'overall') AS delta,
  max(CASE WHEN v.tier <> 'overall' AND b2.map > 0 THEN (b2.map - v.map) / b2.map ELSE 0.0 END) AS worst FROM vv v JOIN vv b2 ON b2.tier = v.tier AND b2.variant = 'default' WHERE v.variant <> 'default' GROUP BY v.variant)""", **_VAR)
def variant_gate(p: Plan) -> DataFrame:
    return ranking.variant_gate(_variants(p), "default")


@query()
def weight_search(p: Plan) -> DataFrame:
    best = ranking.search_weights(p.union, p.targets, p.tiers, FINAL)
    return ranking.weight_table(p.spark, best)


# ---- profiles


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, min(date) AS first_date, max(date) AS last_date, min(price) AS min_price, max(price) AS max_price, count(*) FILTER (price <= 0) AS n_not_positive, count(*) FILTER (regexp_matches(item_id, '^[0-9]+\\.0+$')) AS n_float_like_ids, round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 6) AS price_missing_rate FROM tx")
def profile_transactions(p: Plan) -> DataFrame:
    return profile.transactions(p.tx)


def _rate(c: str, alias: str = "") -> str:
    return f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {alias or c}_missing_rate"


@query(f"SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, {_rate('age')}, {_rate('fn', 'FN')}, {_rate('club_member_status')}, {_rate('postal_code')} FROM cust")
def profile_customers(p: Plan) -> DataFrame:
    return profile.customers(p.customers)


@query(f"SELECT count(*) AS n_rows, count(DISTINCT item_id) AS n_items, count(*) - count(DISTINCT item_id) AS n_conflicting, count(DISTINCT product_code) AS n_styles, {_rate('prod_name')}, {_rate('detail_desc')} FROM art")
def profile_articles(p: Plan) -> DataFrame:
    return profile.articles(p.articles)


@query("SELECT 'item_id' AS key, count(*) AS n_keys, count(a.item_id) AS n_found, round(count(a.item_id) / count(*), 6) AS coverage FROM (SELECT DISTINCT item_id FROM tx) t LEFT JOIN art a USING (item_id) UNION ALL SELECT 'user_id', count(*), count(c.user_id), round(count(c.user_id) / count(*), 6) FROM (SELECT DISTINCT user_id FROM tx) t LEFT JOIN cust c USING (user_id)")
def join_coverage(p: Plan) -> DataFrame:
    return profile.join_coverage(p.tx, p.articles, "item_id").unionByName(profile.join_coverage(p.tx, p.customers, "user_id"))


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, min(date) AS first_date, max(date) AS last_date FROM inter")
def inter_stats(p: Plan) -> DataFrame:
    return profile.inter_stats(p.inter)


@query("SELECT 'articles' AS dimension, count(*) AS n_rows FROM art SEMI JOIN past USING (item_id) UNION ALL SELECT 'customers', count(*) FROM cust SEMI JOIN past USING (user_id)")
def filtered_dimensions(p: Plan) -> DataFrame:
    count = lambda df, name: df.agg(F.lit(name).alias("dimension"), F.count(F.lit(1)).alias("n_rows"))
    return count(profile.referenced(p.articles, p.past, "item_id"), "articles").unionByName(count(profile.referenced(p.customers, p.past, "user_id"), "customers"))


# ---- the dense mapping


@query(f"SELECT {EVENT_ROWS} FROM aev", source=retail.activity, aev=sql.CTE["ev"].replace("FROM tx", "FROM act"))
def activity_events(p: Plan) -> DataFrame:
    return events_user_day_item(p)


@query("SELECT user_id, array_to_string(items, ' ') AS items FROM ah", source=retail.activity, ad="SELECT DISTINCT user_id, item_id, date FROM act", ah="SELECT user_id, list(item_id ORDER BY date, item_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, item_id DESC) AS n FROM ad) WHERE n <= 50 GROUP BY user_id")
def activity_history(p: Plan) -> DataFrame:
    return history.last_items(p.tx.select("user_id", "item_id", "date"), 50).withColumn("items", F.array_join("items", " "))


@query(WHOLE.format("ad"), source=retail.activity, ad="SELECT DISTINCT user_id, item_id, date FROM act")
def activity_whole_days(p: Plan) -> DataFrame:
    baskets = p.tx.groupBy("user_id", "date").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return history.whole_days(baskets, 10, 200).withColumn("items", F.array_join("items", " "))


@query("SELECT user_id, item_id, score, rank FROM ar", source=retail.activity, ad="SELECT DISTINCT user_id, item_id, date FROM act", ar=sql.top("SELECT user_id, item_id, round(count(DISTINCT date) * exp(-ln(2.0) * greatest(0, any_value(m) - max(date)) / 28.0), 9) AS score FROM ad, (SELECT max(date) AS m FROM ad) GROUP BY ALL", "user_id", 50))
def activity_repurchase(p: Plan) -> DataFrame:
    inter = p.tx.select("user_id", "item_id", "date").distinct()
    last = p.tx.agg(F.max("date")).first()[0]
    return recall.recall_repurchase(inter, F.lit(last), PER_CHANNEL).select("user_id", "item_id", "score", "rank")
