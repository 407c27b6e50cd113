"""Colliding words, and many rows that share an id."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomline.llm.minhash import near_duplicates, without_duplicates
from loomline.llm.substring import remove_repeats
from loomline.llm.suffixes import remove_suffix_repeats


def thue_morse(n):
    """Words of a and b that a polynomial of bytes modulo 2**64 can't tell from each other, for any base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_colliding_words(spark):
    x, y = thue_morse(1024)
    twelve = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{x} {twelve}"), (2, f"{y} {twelve}")], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(docs).collect()] == [0, 0]
    pair = spark.createDataFrame([(1, f"{x} same"), (2, f"{y} same"), (3, f"{x} same")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(pair, size=2).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.fixture(scope="module")
def nulls(spark):
    """80,000 null ids with different texts of 14 words, and pairs of equal and near-equal ones."""
    word = lambda k: F.concat(F.lit("w"), F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 256), 1, 8))
    rows = spark.range(0, 80_000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *[word(k) for k in range(30)]).alias("text"))
    own = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:8] for i in range(200))
    more = spark.createDataFrame([(None, own), (None, own), (5, own), (6, own + " end")], "doc_id long, text string")
    return rows.unionByName(more).cache()


def test_many_null_ids(spark, nulls):
    out = remove_repeats(nulls).cache()
    assert out.count() == 80_004
    # rows of one id don't cut one another, and both others are cut by the null ones
    assert sorted((r.doc_id, r.n_words - r.n_removed) for r in out.filter("n_removed > 0").collect()) == [(5, 0), (6, 1)]
    groups = near_duplicates(nulls).cache()
    assert groups.count() == 80_004 and groups.filter("kept").count() == 80_002
    assert [(r.doc_id, r.component_id) for r in groups.filter("NOT kept").orderBy("doc_id").collect()] == [(5, None), (6, None)]
    kept = without_duplicates(nulls)
    assert kept.count() == 80_002 and kept.filter("doc_id IS NOT NULL").count() == 0


def test_many_null_ids_as_bytes(spark, nulls):
    out = remove_suffix_repeats(nulls).filter("n_removed > 0").collect()
    assert sorted((r.doc_id, r.n_bytes - r.n_removed) for r in out) == [(5, 0), (6, 4)]


def test_rows_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False)]
    assert sorted(r.text for r in without_duplicates(docs).collect()) == [a, b]
