"""Every registered query: its contract's columns and types, one row a document where it says so."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_": {"doc_id": "bigint", "evidence": "double", "site_share": "double", "posterior": "double", "kept": "boolean"},
    "op3_": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "removed": "array<int>"},
    "op8_": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op9_": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("prefix", CONTRACT)
def test_columns(spark, prefix):
    found = entry.queries()
    (name,) = [n for n in found if n.startswith(prefix)]
    out = found[name](spark, SF)
    assert dict(out.dtypes) == CONTRACT[prefix]
    assert sorted(x.doc_id for x in out.collect()) == sorted(x.doc_id for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
