"""Every registered query with a statement equals it on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry_point
from oracle import connect, mismatch

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_matches_statement(spark, duck, name):
    problem = mismatch(entry_point.queries()[name](spark, FOLDER), duck, entry_point.oracle_sql()[name])
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bootstrap_cell_ci", "ml_elastic_net", "ml_gbt_regressor", "top_k_importance"])
def test_iterative_queries_give_rows(spark, name):
    assert entry_point.queries()[name](spark, FOLDER).count() > 0
