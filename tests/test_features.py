import math

import pytest
from frames import articles, day, tx

from loomline.operators import features, history

BANDS = (0.05, 0.15)


def specs(spark, *days):
    return spark.createDataFrame([(day(d),) for d in days], "as_of_date date")


def rich(spark, rows, cat):
    return features.enriched(history.user_day_item_events(tx(spark, rows)), cat, BANDS)


ROWS = [("u1", 1, "09-01", 0.02, 1), ("u1", 1, "09-01", 0.02, 1), ("u1", 2, "09-08", 0.04, 2), ("u1", 3, "09-15", 0.20, 2)]


@pytest.fixture
def cat(spark):
    return articles(spark, [(1, "100", "red", "Jersey", "t"), (2, "100", "blue", "Jersey", "t"), (3, "200", "red", "Denim", "p")])


def test_user_features(spark, cat):
    x = features.user_features(rich(spark, ROWS, cat), specs(spark, "09-15")).first()
    assert x.recency_days == 0 and x.avg_gap_days == 7.0
    assert (x.purchase_count_7d, x.active_days_7d, x.basket_size_7d, x.channel_1_share_7d, x.channel_2_share_7d, x.style_diversity_7d, x.repeat_rate_7d) == (1, 1, 1.0, 0.0, 1.0, 1, 0.0)
    assert x.purchase_count_28d == 4 and x.same_style_rate_28d == 0.25 and x.new_item_rate_28d == 1.0
    want = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert x.department_entropy_28d == pytest.approx(want, abs=1e-6) and x.department_entropy_7d == 0.0
    assert x.monetary_sum_28d == pytest.approx(0.28) and x.monetary_mean_28d == pytest.approx(0.07)
    assert features.user_features(rich(spark, ROWS, cat), specs(spark, "08-01")).count() == 0


def test_cross_features(spark, cat):
    rows = [("u1", 1, "09-01", 0.02, 1), ("u1", 1, "09-01", 0.02, 1), ("u1", 2, "09-15", 0.04, 2), ("u2", 2, "09-14", 0.04, 2)]
    pairs = spark.createDataFrame([("u1", "0000000002", day("09-15")), ("u1", "0000000003", day("09-15")), ("new", "0000000002", day("09-15"))], "user_id string, item_id string, as_of_date date")
    cohorts = spark.createDataFrame([("u1", "25_34"), ("u2", "35_44")], "user_id string, cohort string")
    got = {(x.user_id, int(x.item_id)): x for x in features.cross_features(pairs, rich(spark, rows, cat), cat, cohorts).collect()}
    b = got["u1", 2]
    assert (b.user_item_purchase_count, b.user_style_purchase_count, b.user_item_recency_days, b.user_style_recency_days) == (1, 3, 0, 0)
    assert (b.user_bought_same_style, b.candidate_same_style_new_color, b.department_preference_match) == (1.0, 0.0, 1.0)
    assert b.price_diff == pytest.approx(0.04 - 0.08 / 3, abs=1e-4)
    assert (b.item_global_purchase_count_7d, b.item_channel_purchase_count_7d, b.item_cohort_purchase_count_7d) == (2, 0, 1)
    c = got["u1", 3]
    assert c.user_item_recency_days is None and c.candidate_mean_price is None and c.price_diff is None and c.item_global_purchase_count_28d == 0
    n = got["new", 2]
    assert n.user_mean_price is None and n.user_style_purchase_count == 0 and n.department_preference_match == 0.0
    only = features.cross_features(pairs.limit(1), rich(spark, rows[:2], cat), cat, cohorts).first()
    assert (only.candidate_same_style_new_color, only.user_item_purchase_count) == (1.0, 0)


def test_no_leakage(spark, cat):
    future = ROWS + [("u1", 1, "10-01", 0.9, 1), ("u2", 2, "10-02", 0.9, 2)]
    old, new = rich(spark, ROWS, cat), rich(spark, future, cat)
    at = specs(spark, "09-08", "09-15")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(features.user_features(old, at, (7, 28))) == rows(features.user_features(new, at, (7, 28)))
    pairs = spark.createDataFrame([("u1", "0000000002", day("09-15"))], "user_id string, item_id string, as_of_date date")
    none = spark.createDataFrame([], "user_id string, cohort string")
    assert rows(features.cross_features(pairs, old, cat, none)) == rows(features.cross_features(pairs, new, cat, none))


def test_catalogues(spark, cat):
    also = spark.createDataFrame([("0000000009",), ("0000000001",)], "item_id string")
    got = {int(x.item_id): x for x in features.item_features(cat, also).collect()}
    assert got[1].n_style_variants == 2.0 and got[3].n_style_variants == 1.0 and got[1].colour_combo == "red"
    assert got[1].product_code_number == 100.0 and got[1].index_name_token == "unknown" and got[1].department_no_missing == 1.0
    assert got[9].is_unknown_item == 1.0 and got[9].n_style_variants == 0.0 and got[9].prod_name_missing == 1.0 and got[9].prod_name_token == "unknown"
    people = spark.createDataFrame([("a", "30", "1", None, "ACTIVE", "NONE", "P1"), ("b", None, None, "1", None, "x", ""), ("c", "30", "1", "1", "y", "x", "P1")], "user_id string, age string, FN string, Active string, club_member_status string, fashion_news_frequency string, postal_code string")
    users = {x.user_id: x for x in features.customer_features(people, spark.createDataFrame([("z",)], "user_id string")).collect()}
    assert (users["a"].age_bucket, users["a"].FN, users["a"].Active, users["a"].postal_code_freq_bucket, users["a"].fashion_news_frequency_missing) == ("25_34", 1.0, 0.0, "rare", 1.0)
    assert (users["b"].age_missing, users["b"].postal_code, users["b"].postal_code_missing) == (1.0, "unknown", 1.0)
    assert users["z"].is_unknown_customer == 1.0 and users["z"].age_bucket == "unknown" and users["z"].age_missing == 1.0


def test_rates_without_entropies(spark, cat):
    """The same columns, and events aren't repeated by attribute."""
    r, at = rich(spark, ROWS, cat), specs(spark, "09-15")
    whole, rates = features.user_features(r, at, (28,)), features.user_features(r, at, (28,), entropies=False)
    assert [tuple(x) for x in whole.select(*rates.columns).collect()] == [tuple(x) for x in rates.collect()]
    assert "Generate" not in rates._jdf.queryExecution().optimizedPlan().toString() and not [c for c in rates.columns if "entropy" in c]
