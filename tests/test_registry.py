"""Every registered query against its SQL form on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_queries import compare, connect  # noqa: E402

from shelfspark.plans.registry import entries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@needs_tables
@pytest.mark.parametrize("name", sorted(entries()))
def test_query_equals_sql(spark, con, name):
    fn, sql = entries()[name]
    state, n, _, note = compare(spark, con, FOLDER, fn, sql)
    assert state in ("ok", "rows-only"), note


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(entries()) <= set(contract.queries())


@needs_tables
def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0
