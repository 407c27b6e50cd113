"""Registered queries against their SQL, and the driver's entry points."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from loomline.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind here; the driver compares all of them.
CHOSEN = ("events_user_day_item", "time_split", "next_basket_labels", "basket_history_whole_day", "sequence_samples_train", "category_popular_index", "i2i_swing", "candidate_union", "rrf_default", "metrics_by_tier", "diag_channel_recall", "diag_jaccard", "user_features_pit", "cross_features", "ranking_dataset", "weight_grid", "popular_top12_map", "activity_repurchase")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(frame):
    cell = lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00")
    return sorted(tuple(cell(r[c]) for c in sorted(frame.columns)) for r in frame.to_dict("records"))


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["user_id", "item_id", "rank", "ap", "n_actual"] and out.count() % 12 == 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(plans.QUERIES) - len(plans.SQL) == 1


def test_works_without_the_corpus_operators(tmp_path):
    top = os.path.dirname(os.path.abspath(entry.__file__))
    os.symlink(f"{top}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    (tmp_path / "loomline").mkdir()
    for name in os.listdir(f"{top}/loomline"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{top}/loomline/{name}", tmp_path / "loomline" / name)
    code = "import __spark_entry__ as e; names = list(e.queries()); assert names and not any(n.startswith('op') or n == 'pipeline' for n in names); print(len(names))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) == len(plans.QUERIES), done.stderr
