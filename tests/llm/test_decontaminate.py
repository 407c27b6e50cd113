"""Decontamination against all windows of all documents."""

import random
import re
from collections import Counter

from loomline.llm.decontaminate import clean, contaminated


def grams(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def brute(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        g = grams(t)
        for i, it in items:
            want = Counter(grams(it))
            n = sum(want.values())
            if not n or not g:
                continue
            w = min(n, len(g))
            best = max((sum((Counter(g[s : s + w]) & want).values()) / (n + w - sum((Counter(g[s : s + w]) & want).values())), -s) for s in range(len(g) - w + 1))
            if best[0] >= least:
                out[d, i] = best[0]
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["the", "of", "É"] * 10
    sentence = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [(i, " ".join(sentence(r.choice([3, 6, 15, 30, 30, 57])))) for i in range(25)] + [(90, None), (91, " ")]
    docs = []
    for d in range(120):
        words = sentence(r.choice([0, 2, 30, 200]))
        if r.random() < 0.6:
            cut = r.choice(items[:25])[1].split()
            kind = r.random()
            if kind < 0.3 and len(cut) > 10:
                cut[len(cut) // 2] = "changed"
            elif kind < 0.5:
                cut = cut[: round(len(cut) * r.choice([0.5, 0.85, 0.95]))]
            elif kind < 0.6:
                cut = cut + cut
            at = r.randint(0, len(words))
            words = words[:at] + [w.upper() if r.random() < 0.3 else w for w in cut] + words[at:]
        docs.append((d, " \n".join(words)))
    return docs + [(500, None), (501, ""), (502, items[3][1])], items


def test_against_all_windows(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        want = brute(docs, items)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        i = spark.createDataFrame(items, "item_id long, text string")
        got = {(x.doc_id, x.item_id): x.similarity for x in contaminated(d, i).collect()}
        assert len(want) > 20 and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
        left = {x.doc_id for x in clean(d, i).collect()}
        assert left == {x for x, _ in docs} - {k[0] for k in want}


def test_odd_rows(spark):
    passage = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(None, passage), (1, "a " + passage), (1, "b"), (1, "b"), (2, None)], "doc_id long, text string").selectExpr("*", "1 as item", "2 as size")
    items = spark.createDataFrame([(7, passage), (None, passage), (8, passage)], "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = sorted((str(x.doc_id), x.item_id, x.start, x.similarity) for x in contaminated(docs, items).collect())
    assert got == [("1", 7, 1, 1.0), ("1", 8, 1, 1.0), ("None", 7, 0, 1.0), ("None", 8, 0, 1.0)]
    # of the rows with id 1 the one with the passage goes, both clean ones stay
    assert sorted((x.doc_id, x.text) for x in clean(docs, items).collect()) == [(1, "b"), (1, "b"), (2, None)] and clean(docs, items).columns == docs.columns
    assert contaminated(docs.filter("doc_id = 9"), items).count() == 0 and contaminated(docs, items.filter("item_id = 9")).count() == 0
