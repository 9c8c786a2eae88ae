"""Every catalogue query with SQL must equal its DuckDB oracle (sf0.001)."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF, name, con)
    assert res["status"] == "ok", res


def test_every_query_has_rows_and_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 4
    assert df.columns == ["model", "accuracy", "precision", "recall", "f1", "roc_auc", "ord"]
