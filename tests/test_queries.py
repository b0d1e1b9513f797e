"""Every registered query with a SQL form gives the same rows on DuckDB."""

import os

import pytest

import __spark_entry__ as entry_file
from matchlake.catalog import QUERIES
from matchlake.comparison import COMPARISON_SQL
from tests.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_sql_forms_belong_to_queries():
    assert set(COMPARISON_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(COMPARISON_SQL))
def test_same_rows(spark, con, name):
    rows, differences = compare(QUERIES[name](spark, SF), con, COMPARISON_SQL[name])
    assert differences == []
    assert rows > 0


def test_entry(spark):
    table = entry_file.entry(spark)
    rows = table.collect()
    assert [r["Rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(r["PartialPoints"] <= r["PredictedFinalPoints"] <= r["MaxFinalPoints"] for r in rows)
