import hashlib

import pytest
from pyspark.sql import functions as F

from loomline.functions import expr
from loomline.operators import profile
from loomline.sources import readers


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("x")).first().x


def test_item_ids(spark):
    for text in ("706016001", "0706016001", "706016001.0", " 706016001 "):
        assert one(spark, text, expr.item_id) == "0706016001"
    assert one(spark, " ab-1 ", expr.item_id) == "ab-1"
    for bad in ("", "  ", None, "12345678901"):
        with pytest.raises(Exception, match="item id"):
            one(spark, bad, expr.item_id)
    with pytest.raises(Exception, match="user id"):
        one(spark, " ", expr.user_id)


def test_tokens(spark):
    for text, token in ((" Light  Blue/Grey\\x ", "Light_Blue_Grey_x"), (None, "unknown"), ("NaN", "unknown"), ("__", "unknown"), ("A__b", "A_b")):
        assert one(spark, text, expr.category) == token
    assert one(spark, "  A\t B ", expr.text) == "a b" and one(spark, None, expr.text) == ""
    assert one(spark, "x", lambda c: expr.combo(c, F.lit(None), F.lit("y z"))) == "x__y_z"
    assert one(spark, "T-shirt 2x", expr.word_tokens) == ["t", "shirt", "2x"]
    assert one(spark, "12.0", lambda c: F.struct(*expr.numeric_id(c))) == (12.0, "12", 0.0)
    assert one(spark, "abc", lambda c: F.struct(*expr.numeric_id(c))) == (0.0, "abc", 0.0)
    assert one(spark, None, lambda c: F.struct(*expr.numeric_id(c))) == (0.0, "unknown", 1.0)
    assert one(spark, "A b", lambda c: F.struct(*expr.text_parts(c))) == ("a b", 3.0, 2.0, 0.0)


def test_customers(spark):
    for value, flag in (("1", 1.0), ("", 0.0), ("0", 0.0), (None, 0.0), ("yes", 1.0)):
        assert one(spark, value, expr.binary_flag) == flag
    for value, want in (("30", (30.0, "25_34", 0.0)), ("45", (45.0, "45_54", 0.0)), (None, (0.0, "unknown", 1.0)), ("17", (17.0, "under_18", 0.0)), ("65", (65.0, "65_plus", 0.0)), ("24.5", (24.5, "18_24", 0.0)), ("130", (0.0, "unknown", 1.0))):
        assert tuple(one(spark, value, lambda c: F.struct(*expr.age_parts(c)))) == want
    assert [one(spark, n, expr.postal_frequency, "int") for n in (1, 3, 20, 100)] == ["singleton", "rare", "medium", "common"]
    assert one(spark, "P1", expr.postal_hash) == f"h{int(hashlib.sha256(b'P1').hexdigest()[:8], 16) % 100:02d}"
    assert [one(spark, n, expr.tier, "int") for n in (0, 1, 2, 3, 9, 10)] == ["cold_start", "low", "low", "medium", "medium", "high"]
    assert [one(spark, p, expr.price_band, "double") for p in (0.01, 0.05, 0.2, None)] == ["low", "mid", "high", "unknown"]
    assert abs(one(spark, 28, lambda c: expr.decay(c, 28.0), "int") - 0.5) < 1e-12 and one(spark, -3, lambda c: expr.decay(c, 28.0), "int") == 1.0
    assert one(spark, 5, lambda c: expr.decay(c, 0.0), "int") == 1.0


def test_files(spark, tmp_path):
    raw = tmp_path / "t.csv"
    raw.write_text("customer_id,t_dat,article_id,sales_channel_id,price\nu1,2020-09-01,706016001,2,0.1\nu1,2020-09-20,706016001.0,1,\n")
    rows = readers.transactions(spark, str(raw)).collect()
    assert {x.item_id for x in rows} == {"0706016001"} and sorted(x.channel for x in rows) == [1, 2]
    assert readers.transactions(spark, str(raw), weeks=1).count() == 1
    with pytest.raises(ValueError, match="rank"):
        readers.candidates(spark, str(raw))
    inter = tmp_path / "i.inter"
    inter.write_text("user_id:token\titem_id:token\ttimestamp:float\nu1\t7\t1599998400.0\n")
    assert str(readers.interactions(spark, str(inter)).first().date) == "2020-09-13"
    cat = tmp_path / "a.csv"
    cat.write_text("article_id,prod_name\n7,b\n7,a\n8,\n")
    got = {x.article_id: (x.prod_name, x.colour) for x in readers.catalogue(spark, str(cat), "article_id", ["prod_name", "colour"]).collect()}
    assert got == {"0000000007": ("a", None), "0000000008": (None, None)}
    df = spark.createDataFrame([("u", ["1", "2"], 1.5)], "user_id string, items array<string>, _x double")
    readers.write_tsv(df, str(tmp_path / "s"), {"user_id": "token", "items": "token_seq"})
    assert "1 2" in "".join(p.read_text() for p in (tmp_path / "s").glob("*.csv"))
    readers.write_csv(df.drop("items"), str(tmp_path / "c"), ["user_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["user_id"]
    good = spark.createDataFrame([("u", "7", " Popular", 1.0, 1, "VALID")], readers.CANDIDATES)
    assert readers.checked_candidates(good).first() == ("u", "0000000007", "popular", 1.0, 1, "valid")
    for bad in (("u", "7", "", 1.0, 1, "valid"), ("u", "7", "x", 1.0, 0, "valid"), ("u", "7", "x", 1.0, 1, "dev")):
        with pytest.raises(Exception):
            readers.checked_candidates(spark.createDataFrame([bad], readers.CANDIDATES)).collect()
    dated = df.selectExpr("user_id", "date'2020-09-01' as date", "date'2020-09-02' as as_of_date")
    readers.write_monthly(dated, str(tmp_path / "m"))
    readers.write_by_day(dated, str(tmp_path / "d"))
    assert (tmp_path / "m" / "year_month=2020-09").is_dir() and (tmp_path / "d" / "as_of_date=2020-09-02").is_dir()
    assert profile.dataset_version({"b": 1, "a": 2}) == profile.dataset_version({"a": 2, "b": 1}) and len(profile.dataset_version({})) == 12


def test_category_of_plain_and_other_names(spark):
    names = ["Tee", "a b", " a", "a_b", "a__b", "_a", "a_", "a/b", "a\\b", "a\tb", "NaN", "none", "", " ", "_", "<NA>", None, "é x", "a b"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(expr.category(F.col("n")).alias("t")).collect()
    assert [x.t for x in got] == ["Tee", "a_b", "a", "a_b", "a_b", "a", "a", "a_b", "a_b", "a_b", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "é_x", "a b"]
