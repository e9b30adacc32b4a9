"""Session helpers, and shapes of plans that matter at scale."""

import os
import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomdex import runtime
from loomdex.operators.postings import counting_postings
from loomdex.operators.slices import running_total, with_slice
from loomdex.plans.skew import dictionary_conflicts
from loomdex.runtime import CHECKPOINT_KEY, cut, shared_dir, shuffle_width, spread, table
from tests.conftest import SF_DIR, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_session_names_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "_configured", lambda _: f"file://{tmp_path}/shared")
    assert shared_dir(spark) == f"file://{tmp_path}/shared"
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    again = cut(df)
    assert rows(again) == rows(df) and again.schema == df.schema
    assert any((tmp_path / "shared").iterdir())
    assert cut(df.limit(0)).count() == 0


def test_intermediate_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "_configured", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(runtime, "_TABLES", {})
    cut(spark.range(3)), cut(spark.range(4))
    assert len(os.listdir(tmp_path)) == 2
    assert runtime.clear(spark) == 2 and os.listdir(tmp_path) == [] and runtime.clear(spark) == 0


def test_a_local_session_without_the_setting_gets_one_folder(spark, monkeypatch):
    monkeypatch.setattr(runtime, "_configured", lambda _: None)
    assert shared_dir(spark) == shared_dir(spark) != ""
    assert rows(cut(spark.range(3))) == [(0,), (1,), (2,)]


def test_a_cluster_without_the_setting_is_refused(monkeypatch):
    monkeypatch.setattr(runtime, "_configured", lambda _: None)
    context = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})
    with pytest.raises(RuntimeError, match=CHECKPOINT_KEY):
        shared_dir(type("Session", (), {"sparkContext": context}))


def test_workers_get_the_package_wherever_they_run(tmp_path):
    """A session of its own, started elsewhere, without the repository on its path."""
    root = pathlib.Path(__file__).parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from loomdex.functions.codec import decoded_postings
df = spark.createDataFrame([(1, "a", 1, bytearray(b"\\x00\\x01"))], "segment_id bigint, term string, document_frequency bigint, encoded binary")
assert decoded_postings(df).count() == 1 and decoded_postings(df).first()["term_frequency"] == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_only_scans_that_leave_cores_idle_are_dealt_out(spark):
    documents = table(spark, SF_DIR, "documents")
    assert "RoundRobinPartitioning" in plan(spread(documents))
    assert spread(spark.range(100, numPartitions=9).where("id > 3"))._jdf.queryExecution().toRdd().getNumPartitions() == 9
    grouped = documents.groupBy("lang").count()
    assert spread(grouped) is grouped
    assert shuffle_width(spark) == 4


def test_counting_postings_shuffles_once_and_reads_four_columns(spark):
    text = plan(counting_postings(table(spark, SF_DIR, "postings")))
    assert text.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<segment_id:bigint,term:string,document_id:bigint,term_frequency:bigint>" in text
    assert "partial_max(term_frequency" in text


def test_conflicts_join_nothing_but_the_few_heavy_keys(spark):
    text = plan(dictionary_conflicts(table(spark, SF_DIR, "postings"), table(spark, SF_DIR, "dictionary")))
    assert text.count("Join") == text.count("BroadcastHashJoin") > 0
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_running_totals_move_rows_once(spark):
    df = with_slice(spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.lit(1).alias("n")), F.col("id"), [250, 500, 750])
    text = plan(running_total(df, ["g"], ["id"], "n", "t", 4))
    assert text.count("shufflepartitionidpassthrough") == 1
    # The other shuffles carry one row per group and slice.
    assert all("_slice" in line or "g#" in line for line in text.splitlines() if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("value", [None, "", "file:/nowhere"])
def test_tables_have_no_schema_surprises(spark, value):
    df = spark.createDataFrame([(value,)], "v string")
    assert rows(cut(df)) == [(value,)]
