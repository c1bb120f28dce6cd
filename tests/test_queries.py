"""Every core query with SQL gives the rows of its twin; the others run and have stable columns."""

import importlib

import oracle
import pytest

import __spark_entry__ as entry

SF = f"{oracle.DATA}/sf0.001"
CORE = [importlib.import_module(f"retentia.plans.{name}").registry for name in entry.CORE]
WITH_SQL = [name for r in CORE for name in r.sql]
WITHOUT = [name for r in CORE for name in r.queries if name not in r.sql]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows(spark, con, name):
    columns, rows = oracle.rows_of_spark(entry.queries()[name](spark, SF))
    sql_columns, sql_rows = oracle.rows_of_sql(con, entry.oracle_sql()[name])
    assert columns == sql_columns
    assert rows == sql_rows


@pytest.mark.parametrize("name", WITHOUT)
def test_repeatable(spark, name):
    f = entry.queries()[name]
    first, again = oracle.rows_of_spark(f(spark, SF)), oracle.rows_of_spark(f(spark, SF))
    assert first == again and sum(first[1].values())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_query_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
