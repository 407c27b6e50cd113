"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from loomline.llm.substring import remove_repeats
from loomline.llm.suffixes import _buckets, remove_suffix_repeats


def brute_words(docs, window):
    first = {}
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def brute_bytes(docs, window):
    first, out = {}, {}
    raw = sorted((d, (t or "").encode()) for d, t in docs)
    for d, b in raw:
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], (d, i))
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (d, i):
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["the", "of", "an", "é", "quick", "brown", "fox", "ñandú", "x"] + [f"w{i}" for i in range(40)]
    sentence = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [sentence(r.randint(5, 60)) for _ in range(6)]
    docs = []
    for d in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(shared) if r.random() < 0.5 else sentence(r.randint(0, 40)))
            if r.random() < 0.2:
                cut = r.choice(shared)
                parts.append(cut[r.randint(0, len(cut)) :])
        docs.append((d * 3, r.choice([" ", "\n", "  ", ""]).join(parts)))
    docs += [(1000, None), (1001, ""), (1002, "a" * 700), (1003, "ab" * 300 + shared[0]), (1004, "a a " * 100)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,window", [(1, 13), (2, 13), (3, 5)])
def test_words(spark, seed, window):
    docs = corpus(seed)
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), window=window).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in got} == brute_words(docs, window)


@pytest.mark.parametrize("seed,window,bucket,ranges,few", [(1, 100, 30_000, 4096, 100_000), (2, 100, 20, 4096, 100_000), (3, 40, 15, 2, 0)])
def test_bytes(spark, seed, window, bucket, ranges, few):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = remove_suffix_repeats(frame, window=window, seed=12, bucket=bucket, ranges=ranges, few_edges=few).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == brute_bytes(docs, window)


@pytest.mark.parametrize("bucket", [7, 64])
def test_one_passage_in_every_document(spark, bucket):
    r = random.Random(6)
    noise = lambda k: " ".join(str(r.randint(0, 9999)) for _ in range(k))
    passage = noise(40)
    docs = [(d, f"{noise(r.randint(1, 30))} {passage}{' ' + noise(5) if d % 3 else ''}") for d in range(150)]
    got = remove_suffix_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bucket=bucket, ranges=3).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == brute_bytes(docs, 100)


def test_buckets():
    keys = [b"a", b"a", b"b", b"b", b"b", b"b", b"c", b"d", b"d"]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.binary())], names=["k"]) for i, j in ((0, 3), (3, 3), (3, 4), (4, 9))]
    assert [x["k"].to_pylist() for x in _buckets(iter(batches), 4, None)] == [keys[0:4], keys[4:8], keys[8:]]
    assert [x["k"].to_pylist() for x in _buckets(iter(batches), 1, "k")] == [keys[0:2], keys[2:6], keys[6:7], keys[7:]]
    assert [x["k"].to_pylist() for x in _buckets(iter(batches), 3, "k")] == [keys[0:6], keys[6:]]
    assert list(_buckets(iter(batches[1:2]), 3, "k")) == []


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [(None, long, "s"), (1, long, None), (1, long, None), (1, long + " z", "h"), (2, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, x.n_removed) for x in remove_repeats(docs).collect())
    assert got == [(-1, 30, 0), (1, 30, 30), (1, 30, 30), (1, 31, 30), (2, 0, 0)]
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_bytes, x.n_removed) for x in remove_suffix_repeats(docs).collect())
    n = len(long)
    assert got == [(-1, n, 0), (1, n, n), (1, n, n), (1, n + 2, n), (2, 0, 0)]
    empty = docs.filter("doc_id > 99")
    assert remove_repeats(empty).count() == 0 and remove_suffix_repeats(empty).count() == 0
