import oracle
import pytest

from retentia.llm import queries as Q

SF = f"{oracle.DATA}/sf0.001"


@pytest.mark.parametrize("name", list(Q.registry.sql))
def test_same_rows(spark, name):
    assert oracle.rows_of_spark(Q.registry.queries[name](spark, SF)) == oracle.rows_of_sql(oracle.connect(SF), Q.registry.sql[name])


@pytest.mark.parametrize("name", [n for n in Q.registry.queries if n not in Q.registry.sql])
def test_runs(spark, name):
    assert Q.registry.queries[name](spark, SF).count() > 0
