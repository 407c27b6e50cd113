"""Near-duplicates against all pairs."""

import random
import re

import pytest

from loomline.llm.graph import components
from loomline.llm.minhash import near_duplicates


def brute(docs, size):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"Wörd{i}" for i in range(300)] + ["the", "of"] * 30
    docs = []
    for family in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 60, 150]))]
        for _ in range(r.choice([1, 2, 25])):
            rate = r.choice([0, 0.01, 0.03, 0.06, 0.1])
            docs.append([r.choice(vocab) if r.random() < rate else w for w in base])
    rows = [" ".join(x).upper() if r.random() < 0.2 else "  ".join(x) for x in docs] + [None, "", " ", "one", "ONE", "one two", "two"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,size,block", [(1, 2, 4096), (2, 2, 6), (3, 5, 4096)])
def test_against_all_pairs(spark, seed, size, block):
    docs = corpus(seed)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), size=size, block=block).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == brute(docs, size)


def test_odd_rows(spark):
    rows = [(None, "a b c", 1), (5, "a b c", 1), (5, "a b c", 1), (7, None, 1), (8, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v int")
    got = sorted(map(tuple, near_duplicates(docs, size=2).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 2, None, False), (5, 2, None, False), (7, 0, 7, True), (8, 1, 8, True)], key=str)
    assert near_duplicates(docs.filter("v = 2"), size=2).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {x.v: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 201: 200}
