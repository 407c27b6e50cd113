"""The classifier on held-out labels, its shrinkage, and odd rows."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fit_on, held = labels.filter("pmod(xxhash64(doc_id), 3) > 0"), labels.filter("pmod(xxhash64(doc_id), 3) = 0")
    got = quality.classify(docs, fit_on, *quality.sites_of_documents())
    assert got.count() == docs.count()
    rows = got.join(held, "doc_id").collect()
    good = [x for x in rows if x.quality == 1 and x.toxic == 0]
    low = [x for x in rows if x.quality == 0]
    assert len(good) > 50 and sum(x.kept for x in good) >= 0.97 * len(good)
    assert sum(not x.kept for x in low) >= 0.9 * len(low)


def shares(spark, rows):
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    sums = quality.site_sums(scored).drop("host").withColumnRenamed("path", "_path")
    got = scored.join(sums, scored["path"].eqNullSafe(sums["_path"])).withColumn("share", quality.share_without(F.col("p"))).collect()
    return [((x.host, x.path, x.p), x.share) for x in got]


def test_shrinkage(spark):
    rows = [("big", "big/a", 1.0)] * 300 + [("big", "big/b", 0.0)] + [("bad", "bad/a", 0.0)] * 200 + [(None, None, 0.0)]
    got = {path: share for (_, path, _), share in shares(spark, rows)}
    assert got["big/a"] > 0.95 and got["bad/a"] < 0.1
    assert 0.5 < got["big/b"] < got["big/a"] and 0.3 < got[None] < 0.8
    assert shares(spark, [("x", "x/y", 0.25)]) == [(("x", "x/y", 0.25), 0.5)]


def prior_weight(sites):
    """sites (share, parent, n): the method of moments."""
    n = sum(x[2] for x in sites)
    spread = sum(c * (s - q) ** 2 for s, q, c in sites) / n
    noise = [q * (1 - q) for _, q, _ in sites]
    return min(1e4, max(1.0, sum(noise) / len(noise) / max(spread - sum(noise) / n, 1e-6) - 1))


def test_shares_by_brute_force(spark):
    r = random.Random(3)
    rows = []
    for h in range(9):
        lean = r.random()
        rows += [(f"h{h}", f"h{h}/{r.randint(0, 3)}", min(1.0, max(0.0, r.gauss(lean, 0.3)))) for _ in range(r.choice((1, 2, 5, 60)))]
    rows += [(None, None, 0.4), (None, None, 0.9)]

    def mean(of):
        return sum(of) / len(of)

    hosts = {h: [p for x, _, p in rows if x == h] for h in {x[0] for x in rows}}
    paths = {(h, s): [p for x, y, p in rows if (x, y) == (h, s)] for h, s in {x[:2] for x in rows}}
    g = mean([p for _, _, p in rows])
    k = prior_weight([(mean(v), g, len(v)) for v in hosts.values()])
    up = {h: (sum(v) + k * g) / (len(v) + k) for h, v in hosts.items()}
    m = prior_weight([(mean(v), up[h], len(v)) for (h, _), v in paths.items()])
    got = sorted(shares(spark, rows), key=str)
    want = []
    for i, (h, s, p) in enumerate(rows):
        rest = [x for j, x in enumerate(rows) if j != i]
        of_host, of_path = [x[2] for x in rest if x[0] == h], [x[2] for x in rest if x[:2] == (h, s)]
        share = (sum(of_host) + k * mean([x[2] for x in rest])) / (len(of_host) + k)
        want.append(((h, s, p), (sum(of_path) + m * share) / (len(of_path) + m)))
    want.sort(key=str)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want], abs=1e-9)


def test_many_rows_of_a_labelled_id(spark):
    docs = spark.createDataFrame([(1, "good plain words"), (2, "BAD!! !! ??")], "doc_id long, text string")
    many = docs.unionByName(spark.range(500).selectExpr("1L AS doc_id", "concat('another text ', id) AS text"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    weights, _ = quality.fit(many, labels)
    assert len(weights) == len(quality.FEATURES) and quality.fit(many.repartition(7), labels)[0] == weights


def test_words():
    bad = frozenset({"vequ*", "clown"})
    assert quality.word_features("vequdu,", bad)[-1] == quality.word_features("Clown!", bad)[-1] == 1
    assert quality.word_features("veque"[:3], bad)[-1] == 0
    assert quality.word_features("ABC!!", bad)[:3] == (1.0, 0.0, 1.0)
    assert quality.word_features("abc***", bad)[1] == 1 and quality.word_features("|", bad)[3] == 1


def test_odd_rows(spark):
    rows = [(1, "fine words here", "s", "en"), (2, None, None, None), (None, "", "s", "en"), (3, "BAD!! BAD!!", "s", "en"), (3, "BAD!! BAD!!", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("share", F.lit(1)).withColumn("host", F.lit(2))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, None), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    sites = quality.sites_of_documents()
    got = quality.classify(docs, labels, *sites).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "2", "3", "3", "None"]
    assert all(math.isfinite(x.posterior) for x in got)
    assert {x.kept for x in got if x.doc_id == 3} == {False} and [x.kept for x in got if x.doc_id == 1] == [True]
    kept = quality.keep_good(docs, labels, *sites)
    assert kept.columns == docs.columns
    assert quality.keep_good(docs, labels.filter("quality = 7"), *sites).count() == 5
    assert quality.classify(docs.filter("doc_id = 9"), labels, *sites).count() == 0
