from datetime import date

import pytest
from frames import articles, day, inter, item, tx
from pyspark.sql import functions as F

from loomline.operators import history


def test_events(spark):
    rows = [("u", 1, "09-01", 0.02, 2), ("u", 1, "09-01", 0.04, 2), ("u", 2, "09-01", 0.1, 2), ("u", 2, "09-01", 0.1, 1), ("u", 3, "09-01", 0.1, 2), ("u", 3, "09-01", 0.1, 2), ("u", 3, "09-01", 0.1, 1), ("u", 4, "09-01", None, 1), ("u", 4, "09-01", 0.0, 1)]
    got = {int(x.item_id): x for x in history.user_day_item_events(tx(spark, rows)).collect()}
    a, b, c, d = (got[i] for i in (1, 2, 3, 4))
    assert (a.quantity, round(a.mean_price, 9), a.min_price, a.max_price, a.sales_channel_mode, a.n_channels) == (2, 0.03, 0.02, 0.04, 2, 1)
    assert (b.quantity, b.sales_channel_mode, b.n_channels) == (2, 1, 2)
    assert (c.quantity, c.sales_channel_mode) == (3, 2)
    assert (d.quantity, d.mean_price) == (2, 0.0)
    baskets = history.daily_baskets(history.user_day_item_events(tx(spark, rows))).first()
    assert baskets["items"] == [item(i) for i in (1, 2, 3, 4)] and baskets.quantity_sum == 9


def test_dates():
    b = history.split_bounds(date(2020, 9, 22), 4, 1, 1)
    assert (b.window_start, b.train_end, b.valid_start, b.test_start) == (date(2020, 8, 12), date(2020, 9, 8), date(2020, 9, 9), date(2020, 9, 16))
    windows = history.backtest_windows(date(2020, 9, 22), 4, 1, 1)
    assert [w.test_end for _, w, _ in windows] == [date(2020, 9, 22), date(2020, 9, 15), date(2020, 9, 8)]
    assert [o for _, _, o in windows] == [True, False, False] and windows[1][1].test_start == b.valid_start
    assert history.required_weeks(4, 1, 1) == 8
    with pytest.raises(ValueError):
        history.split_bounds(date(2020, 9, 22), 0, 1, 1)


def test_snapshots_and_labels(spark):
    b = history.split_bounds(date(2020, 9, 22), 4, 1, 1)
    specs = history.snapshot_specs(spark, b)
    days = {s: sorted(x.as_of_date for x in specs.collect() if x.split == s) for s in ("train", "valid", "test")}
    assert (days["train"][0], days["train"][-1]) == (date(2020, 8, 18), date(2020, 9, 1))
    assert days["valid"] == [date(2020, 9, 8)] and days["test"] == [date(2020, 9, 15)]
    assert [x.as_of_date for x in history.latest(specs, "train", 2).collect()] == [date(2020, 9, 1), date(2020, 8, 25)]
    rows = [("u", 1, "09-15", 0.1, 1), ("u", 1, "09-16", 0.1, 1), ("u", 2, "09-16", 0.1, 1), ("u", 2, "09-18", 0.1, 1), ("u", 2, "09-18", 0.1, 1), ("u", 3, "09-23", 0.1, 1), ("cold", 9, "09-17", 0.1, 1), ("idle", 1, "09-01", 0.1, 1)]
    ev = history.user_day_item_events(tx(spark, rows))
    style = articles(spark, [(1, "100", "red", "d", "t"), (2, "100", "blue", "d", "t"), (3, "", "blue", "d", "t"), (9, "200", "red", "d", "t")])
    test = specs.filter("split = 'test'")
    labels = {(x.user_id, int(x.item_id)): x for x in history.next_basket_labels(ev, test, style).collect()}
    assert set(labels) == {("u", 1), ("u", 2), ("cold", 9)}
    assert labels["u", 2].label_quantity == 3 and labels["u", 2].label_new_to_user and labels["u", 2].label_same_style_new_color
    assert labels["u", 1].label_repeat and not labels["u", 1].label_same_style_new_color
    assert not labels["cold", 9].label_same_style_new_color
    users = {x.user_id: (x.n_history_items, x.is_cold_start) for x in history.snapshot_index(ev, test).collect()}
    assert users == {"u": (1, False), "cold": (0, True)}
    later = history.user_day_item_events(tx(spark, rows + [("u", 2, "10-09", 0.1, 1), ("new", 1, "10-09", 0.1, 1)]))
    assert sorted(map(tuple, history.next_basket_labels(later, test, style).collect())) == sorted(map(tuple, history.next_basket_labels(ev, test, style).collect()))


def test_histories(spark):
    two = inter(spark, [("u", 1, "09-01"), ("u", 2, "09-01"), ("u", 3, "09-01"), ("u", 4, "09-02")])
    baskets = two.groupBy("user_id", "date").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    whole = lambda most, days=None: [int(i) for i in history.whole_days(baskets, most, days).first()["items"]]
    assert whole(3) == [4] and whole(4) == [1, 2, 3, 4] and whole(10, 1) == [4]
    big = inter(spark, [("u", i, "09-02") for i in (5, 6, 7, 8)] + [("u", 1, "09-01")]).groupBy("user_id", "date").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    assert [int(i) for i in history.whole_days(big, 3).first()["items"]] == [5, 6, 7]
    assert [int(i) for i in history.last_items(two, 2).first()["items"]] == [3, 4]
    assert [int(i) for i in history.last_items(two, 9, 1).first()["items"]] == [4]
    assert [int(i) for i in history.last_lines(two.union(two), 3).first()["items"]] == [3, 4, 4]


def samples(df):
    return sorted((" ".join(str(int(i)) for i in x.history.split()), int(x.item_id)) for x in df.collect())


def test_sequences(spark):
    b = history.split_bounds(date(2020, 9, 22), 4, 1, 1)
    rows = [("u", 1, "09-01"), ("u", 2, "09-02"), ("u", 3, "09-09"), ("u", 4, "09-10"), ("u", 5, "09-16")]
    df = inter(spark, rows)
    assert samples(history.sequence_samples(df, "train", b, None, 3)) == [("1", 2)]
    assert samples(history.sequence_samples(df, "valid", b, None, 3)) == [("1 2", 3), ("1 2", 4)]
    assert samples(history.sequence_samples(df, "test", b, None, 3)) == [("2 3 4", 5)]
    same = inter(spark, [("u", 9, "09-01"), ("u", 1, "09-02"), ("u", 2, "09-02"), ("u", 3, "09-02"), ("u", 4, "09-03")])
    assert samples(history.sequence_samples(same, "train", b, None, 10)) == [("9", 1), ("9", 2), ("9", 3), ("9 1 2 3", 4)]
    long = inter(spark, [("u", 1, "09-01"), ("u", 2, "09-01"), ("u", 3, "09-01"), ("u", 4, "09-02"), ("u", 5, "09-03")])
    assert ("4", 5) in samples(history.sequence_samples(long, "train", b, None, 3))
    nobody = inter(spark, [("x", 1, "09-01")]).select("user_id")
    assert samples(history.sequence_samples(df, "train", b, nobody, 3)) == [] and samples(history.sequence_samples(df, "valid", b, nobody, 3)) == [("1 2", 3), ("1 2", 4)]


def test_splits(spark):
    b = history.split_bounds(date(2020, 9, 22), 4, 1, 1)
    df = inter(spark, [("u", 1, "09-01"), ("u", 2, "09-09"), ("u", 3, "09-16"), ("u", 4, "07-01"), ("v", 1, "09-01"), ("v", 2, "09-02")])
    labelled = history.split_label(df, b)
    assert sorted((int(x.item_id), x.split) for x in labelled.filter("user_id = 'u'").collect()) == [(1, "train"), (2, "valid"), (3, "test")]
    history.check_split(labelled)
    with pytest.raises(ValueError):
        history.check_split(labelled.filter("split <> 'test'"))
    train = labelled.filter("split = 'train'")
    assert [x.user_id for x in history.eligible_users(train, 2).collect()] == ["v"] and history.model_train(train, 2).count() == 2
    assert [x.item_id for x in history.item_universe(train, 1).collect()] == [item(1)]
    assert {int(x.item_id): x.n for x in history.popularity_before(df, day("09-02")).collect()} == {1: 2, 4: 1}
    assert history.user_item_counts_before(df, day("09-02")).count() == 3
    assert history.no_future(df, day("12-01")).count() == 6
    with pytest.raises(Exception, match="in a history before"):
        history.no_future(df, day("09-02")).collect()
