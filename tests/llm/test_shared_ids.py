"""The pipeline's stages on null and repeated ids, repeated rows and clashing columns."""

import hashlib

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_odd_rows(spark):
    text = lambda i: " ".join(hashlib.sha256(f"{i}-{k}".encode()).hexdigest()[:6] for k in range(30))
    rows = [(None, text(i), "en", "web") for i in range(40)] + [(1, text(1), "en", None), (1, text(100), "en", "web"), (2, text(100), None, "web"), (3, None, "en", "web"), (4, "", "en", "web"), (4, "", "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as ord", "'x' as data", "2 as v", "3 as component")
    distinct = pipeline.STAGES[1][1](spark, docs, SF)
    assert distinct.columns == docs.columns
    got = sorted((x.doc_id or 0, x.text or "") for x in distinct.collect())
    # text(1) stays with the null id, text(100) with id 1; texts without words are no duplicates
    assert got == sorted([(0, text(i)) for i in range(40)] + [(1, text(100)), (3, ""), (4, ""), (4, "")])
    out = docs
    for _, stage in pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, out, SF).collect(), stage(spark, out, SF).schema)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
