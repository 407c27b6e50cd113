"""Quality classifier with hierarchical empirical Bayes over sites.

Document evidence: a logistic classifier on shape features and learned bad stems gives the log
likelihood ratio of a good document (quality 1 and not toxic). It is fitted on at most
``FIT_ROWS`` labelled rows, those with the smallest hashed ids, each with one document (of several with that id the one
whose text has the smallest hash); only their features and at most ``STEMS`` stems reach the driver. A stem is a word, or its first 4, 5 or 6 letters; it is bad if
labelled toxic documents have it at least ``RATIO`` times as often as others and more often
than chance allows for that many stems.

Sites: grouped sums of all documents' evidence give each host and each path a share of good
documents. A host shrinks toward the global share and a path toward its host by beta priors,
whose weights are estimated from the spread between sites (method of moments), so sparse
sites stay near their parents. A document is judged by the shares of the others: its own
evidence is taken out of its path's, its host's and the global sums first, so that it counts once. Its
posterior adds the log odds of that share, within ``site_limit`` (no limit: ``math.inf``), to its
own evidence: a site tips unclear documents and can't condemn clear ones.

Nulls and empty texts: neutral evidence, so the site decides. A null host or path is a site of
its own. Labels may be null or repeat: rows that say neither good nor bad are left out. Without
labels of both kinds evidence is neutral and all documents are kept. Every row gives a row,
repeated rows equal rows, null ids stay null. Extra columns are ignored by ``classify`` and kept
by ``keep_good``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import buffers, configure, load, slices, table, word_spans, written

FIT_ROWS, STEMS, RATIO = 6000, 2000, 20.0
SITE_LIMIT, KEEP = 2.0, 0.5
#: Paths up to this many are broadcast; beyond, they are joined by a shuffle.
FEW = 100_000
CHUNK = 1 << 20
#: Words whose features a Python worker remembers; beyond that it starts anew.
REMEMBERED = 150_000
_SEEN: dict[frozenset, tuple[dict[bytes, int], np.ndarray]] = {}
FEATURES = ("bias", "shout", "marks", "bangs", "lone", "again", "letters", "hits", "hit")
_STRIP = ".,;:?!\"'()[]"


def stems_of(word: str) -> list[str]:
    w = word.lower().strip(_STRIP)
    return [w, *(f"{w[:n]}*" for n in (4, 5, 6) if len(w) >= n)] if w else []


def word_features(word: str, bad: frozenset[str]) -> tuple[float, ...]:
    end = word.rstrip(".,;:")[-2:]
    n = len(word)
    return (
        float(n > 1 and word.isupper()),
        float(n > 3 and not (word[-1].isalnum() or word[-2].isalnum() or word[-3].isalnum())),
        float(end in ("!!", "??")),
        float(n == 1 and not word.isalnum()),
        float(n if word.isalpha() else sum(map(str.isalpha, word))),
        float(n),
        float(bool(bad) and not bad.isdisjoint(stems_of(word))),
    )


def known_features(words: list[bytes], bad: frozenset[str]) -> np.ndarray:
    """word_features of distinct words; a worker keeps those of one set of bad stems."""
    if bad not in _SEEN or len(_SEEN[bad][0]) > REMEMBERED:
        _SEEN.clear()
        _SEEN[bad] = {}, np.zeros((0, 7), np.float32)
    number, rows = _SEEN[bad]
    fresh = [w for w in words if w not in number]
    if fresh:
        number.update(zip(fresh, range(len(rows), len(rows) + len(fresh)), strict=True))
        rows = np.concatenate((rows, np.array([word_features(w.decode(), bad) for w in fresh], np.float32)))
        _SEEN[bad] = number, rows
    return rows[np.fromiter((number[w] for w in words), np.int64, len(words))]


def features(data: np.ndarray, ends: np.ndarray, bad: frozenset[str]) -> np.ndarray:
    """One row of FEATURES for each document; each distinct word is looked at once."""
    starts, stops, upto = word_spans(data, ends)
    out = np.zeros((len(ends), len(FEATURES)))
    out[:, 0] = 1.0
    if not len(starts):
        return out
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int32)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[solid]))]).dictionary_encode()
    number = coded.indices.to_numpy()
    each = known_features(coded.dictionary.to_pylist(), bad)
    again = np.concatenate(([False], number[1:] == number[:-1]))
    begin = np.concatenate(([0], upto[:-1]))
    again[begin[begin < len(number)]] = False
    totals = np.concatenate((np.zeros((1, 8)), np.cumsum(np.column_stack((each[number], again)), axis=0, dtype=np.float64)))
    shout, marks, bangs, lone, letters, chars, hits, same = (totals[upto] - totals[begin]).T
    n = np.maximum(1, upto - begin)
    for k, x in enumerate((shout / n, marks / n, bangs / n, lone / n, same / n, 1 - letters / np.maximum(1, chars), np.log1p(hits), hits > 0)):
        out[:, k + 1] = x
    out[upto == begin, 1:] = 0.0
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Newton's method with a ridge penalty; both classes weigh the same, so the result is a likelihood ratio."""
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[float], frozenset[str]]:
    """(weights of FEATURES, bad stems)."""
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.select(F.col("doc_id").alias("_id"), "quality", "toxic").filter(F.col("_id").isNotNull()).distinct()
    known = known.withColumn("good", F.when(toxic | (F.col("quality") == 0), 0).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1))
    sample = known.filter("good IS NOT NULL").select("_id", "good", toxic.cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "good", "toxic").limit(FIT_ROWS)
    texts = docs.select(F.col(id_col).alias("_id"), _text(text_col).alias("data")).join(F.broadcast(sample), "_id")
    one = texts.groupBy("_id", "good", "toxic").agg(F.min_by("data", F.xxhash64("data")).alias("data"))
    rows = written(one.drop("_id"), "labelled")

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, toxic in zip(batch.column("data").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = sorted({s for w in set(raw.decode().split()) for s in stems_of(w)})
                yield table({"stem": (found, pa.string()), "toxic": ([toxic] * len(found), pa.int32())})

    good, tox, n = rows.agg(F.sum("good"), F.sum("toxic"), F.count(F.lit(1))).first()
    if not n or not good or good == n:
        return [0.0] * len(FEATURES), frozenset()
    bad: frozenset[str] = frozenset()
    if tox and tox < n:
        counts = written(rows.select("data", "toxic").mapInArrow(stems, "stem string, toxic int").groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "stems")
        need = math.ceil(math.log(100 * max(2, counts.count())) / math.log(n / tox))
        ratio = (F.col("a") / tox) / ((F.col("b") + 0.5) / (n - tox))
        bad = frozenset(x.stem for x in counts.filter((F.col("a") >= need) & (ratio >= RATIO)).orderBy(F.desc("a"), "stem").limit(STEMS).collect())

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            x = features(data, offsets[1:], bad)
            yield table({"x": (x.tolist(), pa.list_(pa.float64())), "good": (batch.column("good"), pa.int32())})

    got = rows.select("data", "good").mapInArrow(shapes, "x array<double>, good int").collect()
    got.sort(key=lambda r: (r.good, r.x))
    return fit_logistic(np.array([r.x for r in got]), np.array([float(r.good) for r in got])).tolist(), bad


def evidence(text_col: Column, weights: list[float], bad: frozenset[str]) -> Column:
    """Log likelihood ratio of a good document, of text as bytes."""
    w = np.array(weights)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, offsets = buffers(text)
        parts = [features(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], bad) @ w for i, j in slices(offsets, CHUNK)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text_col)


def _prior_weight(sites: DataFrame, share: str, parent: str, n: str) -> float:
    """Documents that a parent's share counts for, from the spread of the sites around their parents."""
    v, noise, all_ = sites.agg(F.sum(F.col(n) * (F.col(share) - F.col(parent)) ** 2), F.sum(F.col(parent) * (1 - F.col(parent))), F.sum(n)).first()
    if not all_:
        return 1.0
    spread, chance, mean = v / all_, noise / all_, noise / max(1, sites.count())
    return min(1e4, max(1.0, mean / max(spread - chance, 1e-6) - 1))


def site_sums(scored: DataFrame) -> DataFrame:
    """scored (host, path, p). One row a path: sums and counts of p of the path, the host and all, and both prior weights."""
    paths = written(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    hosts = paths.groupBy(F.col("host").alias("_of")).agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    hosts = hosts.withColumns({"all_good": F.lit(float(total.good or 0)), "all_n": F.lit(int(total.n or 0))})
    g = F.lit(float(total.good / total.n) if total.n else 0.5)
    k = _prior_weight(hosts.withColumns({"raw": F.col("host_good") / F.col("host_n"), "g": g}), "raw", "g", "host_n")
    hosts = written(hosts.withColumn("host_weight", F.lit(k)), "hosts")
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["_of"])).drop("_of")
    host_share = (F.col("host_good") + k * g) / (F.col("host_n") + k)
    k = _prior_weight(both.withColumns({"raw": F.col("good") / F.col("n"), "host_share": host_share}), "raw", "host_share", "n")
    return both.withColumn("path_weight", F.lit(k))


def share_without(p: Column) -> Column:
    """The shrunk share of a path's good documents but one with p; without any other document 0.5 stands for the global share."""
    n = F.col("all_n") - 1
    share = F.when(n > 0, (F.col("all_good") - p) / n).otherwise(0.5)
    for good, count, weight in (("host_good", "host_n", "host_weight"), ("good", "n", "path_weight")):
        share = (F.col(good) - p + F.col(weight) * share) / (F.col(count) - 1 + F.col(weight))
    # sums of floating numbers may leave a trace when p is taken out
    return F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), share))


def _judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str, keep: list[str], site_limit: float) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of docs under safe names with _evidence, _share, _posterior. Names: original -> safe.

    Evidence is computed once and written; texts aren't shuffled.
    """
    configure(docs.sparkSession)
    weights, bad = fit(docs, labels, id_col, text_col)
    at = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{x}`").alias(y) for x, y in at.items()], host.cast("string").alias("_host"), path.cast("string").alias("_path"))
    scored = safe.withColumn("_evidence", evidence(_text(at[text_col]), weights, bad))
    scored = written(scored.select(*[at[x] for x in keep], "_host", "_path", "_evidence"), "evidence")
    p = 1 / (1 + F.exp(-F.col("_evidence")))
    sums = written(site_sums(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), p.alias("p"))), "sites")
    few = sums.count() <= FEW
    joined = scored.join(F.broadcast(sums) if few else sums, scored["_host"].eqNullSafe(sums["host"]) & scored["_path"].eqNullSafe(sums["path"]))
    joined = joined.withColumn("_share", share_without(p))
    # without labels of both kinds there is nothing to judge by
    odds = F.log(F.col("_share") / (1 - F.col("_share"))) if any(weights) else F.lit(1.0)
    at = {x: at[x] for x in keep}
    site = F.greatest(F.lit(-site_limit), F.least(F.lit(site_limit), odds))
    return joined.withColumn("_posterior", 1 / (1 + F.exp(-(F.col("_evidence") + site)))), at


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", site_limit: float = SITE_LIMIT) -> DataFrame:
    """(doc_id, evidence, site_share, posterior, kept)."""
    judged, at = _judged(docs, labels, host, path, id_col, text_col, [id_col], site_limit)
    return judged.select(F.col(at[id_col]).alias(id_col), F.col("_evidence").alias("evidence"), F.col("_share").alias("site_share"), F.col("_posterior").alias("posterior"), (F.col("_posterior") >= KEEP).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", site_limit: float = SITE_LIMIT) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    judged, at = _judged(docs, labels, host, path, id_col, text_col, docs.columns, site_limit)
    return judged.filter(F.col("_posterior") >= KEEP).select(*[F.col(y).alias(x) for x, y in at.items()])


def sites_of_documents() -> tuple[Column, Column]:
    """documents carry no address: a source stands for the host, its languages for the paths."""
    return F.col("source"), F.concat_ws("/", F.col("source"), F.coalesce("lang", F.lit("")))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), *sites_of_documents())
