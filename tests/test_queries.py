"""Every core query against its SQL over small tables."""

import pytest

from loomdex.plans import catalog
from tests.conftest import SF_DIR, rows, same_as_sql

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    same_as_sql(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_points_agree(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_varints_of_dictionary_read_back(spark):
    assert all(r["n"] == r["again"] for r in QUERIES["codec_varint"](spark, SF_DIR).collect())


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "postings")
    QUERIES["postings"](spark, SF_DIR).write.parquet(path)
    from loomdex.plans.snapshot import lookup_rows

    found = lookup_rows(spark.read.parquet(path), "the")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,the)" in plan
    assert rows(found) == rows(QUERIES["lookup_common"](spark, SF_DIR))
