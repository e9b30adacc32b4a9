"""Every corpus query against its SQL, or at least its columns."""

import pytest

from loomdex.llm import catalog
from tests.conftest import SF_DIR, same_as_sql

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
COLUMNS = {
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("mix_name", "string"), ("source", "string")],
    "p8_found": [("doc_id", "bigint"), ("lang", "string")],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    same_as_sql(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0
    assert df.dtypes == COLUMNS.get(name, df.dtypes)
