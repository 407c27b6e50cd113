"""MinHash near-dedup by a signature-coordinate inverted join.

Documents with one shingle set are one class. Each class is posted under its (coordinate,
value) pairs, the rarest first: two signatures that agree in ``MATCHES`` of ``COORDINATES``
places share one of the first ``COORDINATES - MATCHES + 1``, the prefix; values that no other
class has are skipped. Within a posting list collisions are counted over whole signatures;
classes that reach the threshold form families, written as spanning links, never as all
pairs. Exact Jaccard on full shingle sets then links within families: one scan of the family
for a class, skipping classes that are linked already, until every pair across components
has been compared. Families larger than ``BLOCK`` are dealt in blocks with a shared pilot;
classes outside the family's main component are compared with all its blocks.

A pair at a similarity of 0.8 agrees in 25.6 of 32 places on average and in fewer than 13
with a probability below 1e-6.

Nulls, empty texts: no shingles, linked with nothing. A null id counts as the smallest. Rows
with one id and different texts are different documents, ordered by a hash of the text, of which a group keeps the
first; rows equal in both are one document and get equal rows. Extra columns are ignored; an
empty table gives an empty result. Words and shingles are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.anchors import RollingHash, mix, word_hashes
from loomline.llm.common import buffers, configure, doc_key, emit, ids_repeat, keyed, load, restored, slices, table, word_spans, written
from loomline.llm.graph import components

COORDINATES, MATCHES = 32, 13
BLOCK = 4096
CHUNK = 1 << 20
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, end to end; and how many each has."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    starts, stops, upto = word_spans(data, ends)
    hashes = RollingHash(word_hashes(data, starts, stops))
    begin = np.concatenate(([0], upto[:-1]))
    count = upto - begin
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    d = np.repeat(np.arange(len(ends)), n)
    at = begin[d] + np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
    h = hashes.of(at, np.minimum(at + size, upto[d]))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=len(ends))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc, ord, n, s1, s2, sig): set size, two hashes of the set, signature of 32-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("data"))
            for i, j in slices(offsets, CHUNK):
                h, n = shingle_sets(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], size)
                some = np.flatnonzero(n)
                sums = np.zeros((2, j - i), np.uint64)
                sig = np.zeros((j - i, COORDINATES), np.uint32)
                if len(some):
                    at = (np.cumsum(n) - n)[some]
                    sums[0, some] = np.add.reduceat(mix(h), at)
                    sums[1, some] = np.add.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), at)
                    for k, seed in enumerate(_SEEDS):
                        z = h * seed
                        sig[some, k] = np.minimum.reduceat(((z ^ (z >> np.uint64(29))) * seed) >> np.uint64(32), at)
                raw = sig.tobytes()
                yield table(
                    {
                        "doc": (batch.column("doc").slice(i, j - i), pa.int64()),
                        "ord": (batch.column("ord").slice(i, j - i), pa.int64()),
                        "n": (n, pa.int64()),
                        "s1": (sums[0].view(np.int64), pa.int64()),
                        "s2": (sums[1].view(np.int64), pa.int64()),
                        "sig": ([raw[4 * COORDINATES * x : 4 * COORDINATES * (x + 1)] for x in range(j - i)], pa.binary()),
                    }
                )

    return docs.select("doc", "ord", "data").mapInArrow(run, "doc long, ord long, n long, s1 long, s2 long, sig binary")


def tokens(classes: DataFrame) -> DataFrame:
    """(v, token) for each coordinate: coordinate << 32 | value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            token = sig.astype(np.int64) | np.arange(COORDINATES, dtype=np.int64)[None] << 32
            yield from emit(table({"v": (np.repeat(batch.column("v").to_numpy(), COORDINATES), pa.int64()), "token": (token.ravel(), pa.int64())}))

    return classes.select("v", "sig").mapInArrow(run, "v long, token long")


def prefixes(classes: DataFrame) -> DataFrame:
    """(v, token): the prefix's tokens that some other class has as well."""
    all_ = tokens(classes)
    often = all_.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = all_.join(often, "token")
    of_v = Window.partitionBy("v")
    ranked = shared.withColumn("rank", F.row_number().over(of_v.orderBy("often", "token"))).withColumn("have", F.count(F.lit(1)).over(of_v))
    # tokens that only this class has come first in the order and take their places in the prefix
    return ranked.filter(F.col("rank") <= F.col("have") - (MATCHES - 1)).select("v", "token")


def _families(sig: np.ndarray, n: np.ndarray, low: float) -> np.ndarray:
    """Head of each row's family: rows reached through pairs with enough collisions and near sizes."""
    head = np.full(len(n), -1)
    for i in range(len(n)):
        if head[i] >= 0:
            continue
        head[i] = i
        todo = [i]
        while todo:
            x = todo.pop()
            left = np.flatnonzero(head < 0)
            if not len(left):
                return head
            near = left[(np.minimum(n[left], n[x]) >= low * np.maximum(n[left], n[x])) & ((sig[left] == sig[x]).sum(1) >= MATCHES)]
            head[near] = i
            todo += near.tolist()
    return head


def candidate_links(postings: DataFrame, low: float) -> DataFrame:
    """(a, b): spanning links of the families within each posting list; a list beyond BLOCK is one family."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        v, n, sig = (np.concatenate(x) for x in zip(*rows, strict=True))
        head = _families(sig, n, low)
        out = np.flatnonzero(head != np.arange(len(head)))
        return table({"a": (v[out], pa.int64()), "b": (v[head[out]], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, current, first = 0, None, 0
        for batch in batches:
            token, v, n = (batch.column(x).to_numpy() for x in ("token", "v", "n"))
            if not len(token):
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            cut = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)])).tolist()
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if token[i] != current:
                    if held and size > 1:
                        yield flush(held)
                    held, size, current, first = [], 0, token[i], v[i]
                size += j - i
                held.append((v[i:j], n[i:j], sig[i:j]))
                if size > BLOCK:
                    out = np.concatenate([x[0] for x in held])
                    held = [(v[j:j], n[j:j], sig[j:j])]
                    yield from emit(table({"a": (out, pa.int64()), "b": (np.full(len(out), first), pa.int64())}))
        if held and size > 1:
            yield flush(held)

    return postings.repartition("token").sortWithinPartitions("token", "v").mapInArrow(run, "a long, b long")


def link_sets(ids: np.ndarray, n: np.ndarray, v: np.ndarray, queries: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that give the exact components among sets (ids end to end, n each).

    queries None: among all sets, skipping scans that can't join components; else every link of
    the rows marked in queries.
    """
    _, local = np.unique(ids, return_inverse=True)
    at = np.cumsum(n) - n
    flag = np.zeros(local.max() + 1, np.int64)
    root = np.arange(len(n))
    scanned = np.zeros(len(n), bool)
    links: list[tuple[int, int]] = []

    def scan(x: int) -> None:
        own = local[at[x] : at[x] + n[x]]
        flag[own] = 1
        both = np.add.reduceat(flag[local], at)
        flag[own] = 0
        near = np.flatnonzero((100 * both >= percent * (n + n[x] - both)) & (root != root[x]))
        for r in np.unique(root[near]):
            links.append((int(v[x]), int(v[near[root[near] == r][0]])))
            root[root == r] = root[x]
        scanned[x] = True

    if queries is not None:
        for x in np.flatnonzero(queries):
            scan(x)
        return links
    alone = np.ones(len(n), bool)
    for x in range(len(n)):  # one scan for each set that no scan has linked yet
        if alone[x]:
            scan(x)
            alone &= root != root[x]
    while True:  # then all sets outside the largest component
        main = np.bincount(root).argmax()
        left = np.flatnonzero((root != main) & ~scanned)
        if not len(left):
            return links
        scan(left[0])


def exact_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """members (family, block, v, asked, data) dealt by family and block. asked null: link all; true: a query; false: the rest."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        v, asked, data = (sum((list(x) for x in part), []) for part in zip(*rows, strict=True))
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(x) for x in data])
        h, n = shingle_sets(raw, ends, size)
        queries = None if asked[0] is None else np.array(asked, bool)
        links = link_sets(h, n, np.array(v), queries, percent) if len(v) > 1 and len(h) else []
        return table({"a": ([x for x, _ in links], pa.int64()), "b": ([x for _, x in links], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for batch in batches:
            keys = list(zip(batch.column("family").to_pylist(), batch.column("block").to_pylist(), strict=True))
            v, asked, data = (batch.column(x).to_pylist() for x in ("v", "asked", "data"))
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != current:
                    if held:
                        yield flush(held)
                    held, current = [], keys[i]
                held.append((v[i:j], asked[i:j], data[i:j]))
                i = j
        if held:
            yield flush(held)

    dealt = members.select("family", "block", "v", "asked", "data").repartition("family", "block").sortWithinPartitions("family", "block", "v")
    return dealt.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = BLOCK, repeat: bool | None = None) -> DataFrame:
    """(doc, ord, n_shingles, component, kept): documents by ``keyed``, the first id of the group, and whether the row is the group's first."""
    configure(docs.sparkSession)
    repeat = ids_repeat(docs, id_col) if repeat is None else repeat
    base = keyed(docs, id_col, text_col, repeat=repeat)
    signed = written(signatures(base, size), "signatures")
    first = F.struct("doc", "ord")
    classes = signed.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(first).alias("first"), F.min("sig").alias("sig"))
    classes = written(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    postings = prefixes(classes).join(classes.select("v", "n", "sig"), "v")
    families = written(components(candidate_links(postings, percent / 100)), "families")
    roots = families.select(F.col("root").alias("v"), "root").distinct()
    families = families.unionByName(roots)
    sizes = families.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    placed = families.join(sizes, "root").select("v", F.col("root").alias("family"), "blocks", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"))
    placed = placed.join(classes.select("v", "first.doc", "first.ord"), "v")
    # the families grow with the corpus, so they are never broadcast
    texts = placed.join(base.select("doc", "ord", "data").hint("merge"), ["doc", "ord"]).drop("doc", "ord")
    if repeat:  # rows equal in id and text
        texts = texts.dropDuplicates(["v"])
    texts = written(texts.withColumn("asked", F.lit(None).cast("boolean")), "members")
    wide = texts.filter("blocks > 1")
    pilots = wide.filter("v = family").select("v", "family", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "block", "data", "asked").filter("at <> block").drop("block").withColumnRenamed("at", "block")
    links = written(exact_links(texts.unionByName(pilots), size, percent), "links")
    if not wide.isEmpty():
        linked = components(links)
        labelled = wide.join(linked, "v", "left").withColumn("root", F.coalesce("root", "v"))
        counts = labelled.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
        main = counts.groupBy("family").agg(F.max_by("root", F.struct("n", F.negative("root"))).alias("main"))
        asked = labelled.join(main, "family").filter("root <> main").select("v", "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "block", "data")
        # a query meets its own block as well: there it was compared only as far as components needed
        rest = wide.withColumn("asked", F.lit(False)).drop("blocks")
        queries = asked.filter("at <> block").select("v", "family", F.col("at").alias("block"), F.lit(True).alias("asked"), "data")
        links = links.unionByName(written(exact_links(rest.unionByName(queries), size, percent), "links"))
    # the first document of each component of classes, then of each class, then of each row
    named = classes.select("s1", "s2", "n", "v", "first").join(components(links), "v", "left").withColumn("root", F.coalesce("root", "v"))
    heads = named.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("root", "head")
    named = named.join(heads, "root", "left").select("s1", "s2", "n", F.coalesce("head", "first").alias("head"))
    member = signed.select("doc", "ord", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").withColumn("head", F.coalesce("head", first))
    return member.select("doc", "ord", F.col("n").alias("n_shingles"), F.col("head.doc").alias("component"), (F.col("head") == first).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of links with 100 * shared >= percent * union."""
    out = grouped(docs, id_col, text_col, size, percent, block)
    return out.select(restored("doc", id_col), "n_shingles", restored("component", "component_id"), "kept")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The first document of each group, with all rows that equal it in id and text, and their own columns."""
    repeat = ids_repeat(docs, id_col)
    gone = grouped(docs, id_col, text_col, size, percent, repeat=repeat).filter("NOT kept").select(F.col("doc").alias("_doc"), F.col("ord").alias("_ord")).distinct()
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.join(gone, (doc_key(id_col) == F.col("_doc")) & ((F.xxhash64(data) if repeat else F.lit(0).cast("long")) == F.col("_ord")), "left_anti")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), size=2)
