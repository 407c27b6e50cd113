"""The pipeline's stages on a small table, each against a plain version of itself."""

import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import brute as leaks
from test_minhash import brute as near
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept.append([(x.doc_id, x.text) for x in out.collect()])
        docs = spark.createDataFrame(out.collect(), docs.schema)
    good, distinct, clean, mixed = kept
    labels = {x.doc_id: x for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [d for d, _ in good if d in labels]
    assert sum(labels[d].quality == 1 for d in known) >= 0.95 * len(known)
    assert {d for d, _ in distinct} == {d for d, x in near(good, 5).items() if x[2]}
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {d for d, _ in clean} == {d for d, _ in distinct} - {d for d, _ in leaks(distinct, items)}
    assert set(Counter(d for d, _ in mixed).values()) <= {1, 2} and {d for d, _ in mixed} <= {d for d, _ in clean}
    words = lambda rows: sum(len((t or "").split()) for _, t in rows)
    assert abs(words(mixed) / words(clean) - 1.5) < 0.25
    got = sorted(map(tuple, pipeline.STAGES[-1][1](spark, docs, SF).collect()), key=lambda x: x[1])
    model, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for (doc, begin, n, crc), (d, t) in zip(got, sorted(mixed), strict=True):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert (doc, begin, n, crc) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
