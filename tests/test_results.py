"""Ranked lists, weights, reports, digests and the smaller ranking operators."""

import hashlib
import json

import pytest
from frames import day, item

from loomline.operators import features, history, ranking
from loomline.sources import results


def test_ranked_predictions(spark, tmp_path):
    path = str(tmp_path / "ranked.csv")
    with open(path, "w") as f:
        f.write("user_id,item_id,rank\nu,3,2\nu,1,2\nu,3,1\nu,9,\nv,5,x\n")
    got = sorted((r.user_id, r.item_id, r["rank"]) for r in results.ranked_predictions(spark, path, 3).collect())
    assert got == [("u", item(1), 2), ("u", item(3), 1), ("u", item(9), 3), ("v", item(5), 1)]
    with pytest.raises(ValueError):
        results.ranked_predictions(spark, path, 0)


def test_weights_report_digest(spark, tmp_path):
    path = str(tmp_path / "out" / "w.json")
    given = {t: {"popular": 0.5} for t in ranking.WEIGHTS}
    results.save_weights(given, path, score=1)
    got = results.load_weights(path)
    assert got["high"]["popular"] == 0.5 and got["high"]["sequence"] == ranking.WEIGHTS["high"]["sequence"]
    with open(path, "w") as f:
        json.dump({"high": {}}, f)
    with pytest.raises(KeyError):
        results.load_weights(path)
    results.write_report(spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int"), str(tmp_path / "report"))
    assert results.read_report(spark, str(tmp_path / "report")) == [{"k": "a", "n": 1}, {"k": "b", "n": 2}]
    row = results.file_digests(spark, path).first()
    with open(path, "rb") as f:
        assert row.sha256 == hashlib.sha256(f.read()).hexdigest()
    assert results.sequence_channel("/x/SASRecF_valid.csv") == "sasrecf" and results.sequence_channel("y.csv") == "sasrec"


def test_snapshot_dates(spark):
    rows = spark.createDataFrame([("u", "Valid"), ("u", "test"), ("w", "test")], "user_id string, split string")
    days = spark.createDataFrame([("u", "valid", day("01-01")), ("u", None, day("01-02")), (None, None, day("01-03"))], "user_id string, split string, snapshot_date date")
    assert sorted((r.user_id, r.split, r.snapshot_date) for r in ranking.with_snapshot(rows, days).collect()) == [("u", "Valid", day("01-01")), ("u", "test", day("01-02")), ("w", "test", day("01-03"))]
    with pytest.raises(Exception, match="no snapshot date"):
        ranking.with_snapshot(rows, days.filter("user_id IS NOT NULL")).collect()


def test_small_operators(spark):
    c = spark.createDataFrame([("a", 0.5, 1), ("b", 0.7, 2), ("c", 0.7, 3)], "checkpoint string, score double, validation_index int")
    assert [r.checkpoint for r in ranking.shortlist(c, 2).collect()] == ["b", "c"] and [r.checkpoint for r in ranking.shortlist(c, 1, bigger=False).collect()] == ["a"]
    m = ranking.miss_rates(spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "item_missing double, user_missing double"), ("item_", "user_"))
    assert sorted(map(tuple, m.collect())) == [("item", 2, 0, 0.0), ("user", 2, 1, 0.5)]
    sizes = ranking.group_sizes(spark.createDataFrame([("g",), ("g",), ("h",)], "group_id string"))
    assert sorted(map(tuple, sizes.collect())) == [("g", 2), ("h", 1)]
    days = [5, 3, None, 4, 4, 1, 9] * 40
    rows = spark.createDataFrame([(i, None if d is None else day(f"01-0{d}")) for i, d in enumerate(days)], "at int, date date")
    known = [d for d in days if d is not None]
    assert history.decreasing_days(rows, "at").first()[0] == sum(b < a for a, b in zip(known, known[1:], strict=False))
    assert history.decreasing_days(rows.filter("at < 0"), "at").first()[0] == 0
    art = spark.createDataFrame([(item(1), "T"), (item(2), "U")], "item_id string, product_type_name string").selectExpr("*", "'P' as product_code", "'x' as prod_name", "'y' as detail_desc")
    got = features.sequence_items(features.item_features(art), spark.createDataFrame([(item(2),), (item(3),)], "item_id string"))
    assert sorted((r.item_id, r.product_type_name) for r in got.collect()) == [(item(2), "U"), (item(3), "unknown")] and len(got.columns) == 9
    table = spark.createDataFrame([("k", 2), ("k", 1)], "user_id string, v int")
    assert ranking.with_features(spark.createDataFrame([("k",), ("l",)], "user_id string"), table, ["user_id"], "t_").orderBy("user_id").collect()[0].t_v == 1


def test_next_basket_targets(spark):
    labels = spark.createDataFrame([("u", item(1), "valid", True), ("u", item(1), "valid", True), ("u", item(2), "valid", None), ("v", item(3), "test", True)], "user_id string, item_id string, split string, label_purchase boolean")
    assert [tuple(r) for r in history.next_basket_targets(labels, "valid").collect()] == [("u", item(1))]
    with pytest.raises(ValueError):
        history.next_basket_targets(labels, "train")
