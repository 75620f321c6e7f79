import pytest
from oracle import rows_of_spark, rows_of_sql

from waymark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows_of_spark(queries.queries()[name](spark, SF)) == rows_of_sql(queries.oracle_sql()[name], SF)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
