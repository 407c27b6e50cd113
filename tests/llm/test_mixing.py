"""The mixture against its contract."""

import random

import numpy as np

from loomline.llm.mixing import mixture, pivot, repeated, source_targets


def brute_targets(sizes):
    """sizes by source in order; (5, 2, 1) repeating, 150 %, stop at 2 times."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    target, full = [0.0] * len(sizes), set()
    left = 1.5 * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        unit = (left - sum(2 * sizes[i] for i in full)) / sum(w[i] for i in free)
        over = [i for i in free if unit * w[i] >= 2 * sizes[i]]
        for i in range(len(sizes)):
            target[i] = 2 * sizes[i] if i in full else unit * w[i]
        if not over:
            return target
        full |= set(over)


def test_pivot_keeps_words_and_chances():
    r = random.Random(0)
    size = sorted((r.randint(1, 500) for _ in range(60)), reverse=True)
    total = np.zeros(60)
    for _ in range(3000):
        copies, held, p = pivot(size, [0.3] * 60, [r.random() for _ in range(60)])
        assert abs(sum(a * c for a, c in zip(size, copies)) + (size[held] * p if held >= 0 else 0) - 0.3 * sum(size)) < 1e-6
        if held >= 0:
            copies[held] = p
        total += copies
    assert abs(total / 3000 - 0.3).max() < 0.06


def test_mixture(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randint(1, 60) for _ in range(r.choice([0, 3, 50, 200]))) or None, r.choice(["b", "a", "ä", None, "Z", "b", "b"]), 1) for i in range(900)]
    rows += [(None, "x y", "a", 1), (5, "again", "a", 1), (5, "again", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(7)
    got = mixture(docs, group=16).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixture(docs.repartition(2), group=16).collect()))
    order = sorted({x.source for x in got}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(x.size for x in got if x.source == s) for s in order]
    for s, n, t in zip(order, sizes, brute_targets(sizes)):
        own = [x for x in got if x.source == s]
        assert all(x.source_size == n and abs(x.target - t) < 1e-6 * max(1, t) and 0 <= x.copies <= 2 for x in own)
        assert abs(sum(x.size * x.copies for x in own) - t) <= max(x.size for x in own)
    taken = repeated(docs, mixture(docs, group=16))
    assert taken.columns == docs.columns
    count = lambda xs: sorted((str(d), n) for d, n in xs)
    from collections import Counter

    want = Counter()
    for x in got:
        want[x.doc_id] += x.copies
    assert count(Counter(x.doc_id for x in taken.collect()).items()) == count((d, n) for d, n in want.items() if n)
    assert mixture(docs.filter("doc_id < 0")).count() == 0 and repeated(docs.filter("doc_id < 0"), mixture(docs.filter("doc_id < 0"))).count() == 0


def test_targets_without_words(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0)], "source string, size long")
    assert [x.target for x in source_targets(rows, (5, 2, 1), 150, 2).collect()] == [0.0, 0.0]


def test_targets(spark):
    r = random.Random(4)
    for n in (1, 2, 3, 20, 50):
        sizes = [round(10 ** r.uniform(0, 5)) for _ in range(n)]
        rows = spark.createDataFrame([(f"s{i:03}", x) for i, x in enumerate(sizes)], "source string, size long")
        got = {x.source: x.target for x in source_targets(rows, (5, 2, 1), 150, 2).collect()}
        assert np.allclose([got[f"s{i:03}"] for i in range(n)], brute_targets(sizes))
        assert abs(sum(got.values()) / (1.5 * sum(sizes)) - 1) < 1e-9
