"""Registered queries cover their whole input."""

import os
import re

import pytest
from pyspark.sql import functions as F

from loomline.operators import ranking
from loomline.plans import queries as plans
from loomline.sources import retail

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture
def plan(spark):
    return plans.plan(spark, SF, retail.transactions)


@pytest.mark.parametrize("name", ["user_features_pit", "repeat_rates", "entropy_features"])
def test_all_snapshots(spark, plan, name):
    first = plan.rich.agg(F.min("date")).first()[0]
    want = {x.as_of_date for x in plan.specs.collect() if x.as_of_date >= first}
    assert len(want) > 100
    assert {x.as_of_date for x in plans.QUERIES[name](spark, SF).select("as_of_date").distinct().collect()} == want


def test_all_customers(spark, plan):
    rows, known = plan.ranking_dataset, plan.customers.select("user_id").distinct()
    assert rows.join(known, "user_id").filter("customer_missing <> 0").count() == 0
    assert rows.filter("user_id % 7 = 0 AND customer_missing = 0").count() > 0


def test_whole_grid(spark, plan):
    got = {x.tier: x.n for x in plans.QUERIES["weight_grid_scores"](spark, SF).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and got == {t: len(ranking.weight_grid(t)) for t in got}


def test_search_keeps_defaults_unless_beaten(spark):
    c = spark.createDataFrame([("u", "1", "valid", "popular", 1.0, 1)], "user_id string, item_id string, split string, channel string, score double, rank int")
    t = spark.createDataFrame([("u", 0, "cold_start")], "user_id string, history_len int, tier string")
    assert ranking.search_weights(c, spark.createDataFrame([("u", "2")], "user_id string, item_id string"), t, 12) == ranking.WEIGHTS


def test_all_label_pairs(spark, plan):
    key = ["user_id", "item_id", "as_of_date"]
    want = plan.labels.join(plan.articles, "item_id", "left_semi").select(*key).distinct()
    got = plans.QUERIES["cross_features"](spark, SF).select(*key)
    assert got.select("as_of_date").distinct().count() > 50
    assert got.count() == want.count() and want.join(got, key, "left_anti").count() == 0


def test_union_drops_no_item(spark, plan):
    items = ["user_id", "item_id"]
    want = plan.candidates.select(*items).distinct()
    assert want.groupBy("user_id").count().agg(F.max("count")).first()[0] > 100
    assert plans.QUERIES["candidate_union"](spark, SF).select(*items).distinct().count() == want.count()
    assert {x.k for x in plans.QUERIES["diag_union_recall"](spark, SF).select("k").distinct().collect()} == {100, 300, 500}


def exchanged(df):
    """Shuffles above what is kept."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0].count("hashpartitioning")


@pytest.mark.parametrize("name", ["candidate_union", "union_evidence", "rrf_default"])
def test_union_is_not_shuffled_again(spark, plan, name):
    assert exchanged(plans.QUERIES[name](spark, SF)) == 0


def test_entropies_stay_with_their_users(spark, plan):
    assert exchanged(plans.QUERIES["entropy_features"](spark, SF)) == 0


def test_events_meet_their_own_items_only(spark, plan):
    assert "NestedLoop" not in plans.QUERIES["cross_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_members_read_the_kept_classes(plan):
    members, kinds = plan.content_classes
    read = members._jdf.queryExecution().executedPlan().toString()
    assert kinds.is_cached and read.count("InMemoryRelation") == 2 and members.count() == plan.articles.count()


def test_plan_text_is_bounded(spark, plan):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    assert len(plans.QUERIES["metrics_by_tier"](spark, SF)._jdf.queryExecution().explainString(mode)) < 60_000


def test_ranking_rows_are_shuffled_once(plan):
    """Customers meet the rows where they lie; the join by item is the last one."""
    joins = re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join \[(\w+?)#", plan.ranking_dataset._jdf.queryExecution().sparkPlan().toString())
    assert joins[:2] == ["item_id", "user_id"]
    assert plan.ranking_dataset.columns[:2] == ["user_id", "item_id"]
    assert plan.ranking_dataset.columns[-6:] == ["item_n_style_variants", "item_department_name_token", "item_missing", "customer_age", "customer_age_bucket", "customer_missing"]
