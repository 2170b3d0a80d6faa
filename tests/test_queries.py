import pytest
from oracle import spark_rows, sql_rows

from foliant.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert (names, rows) == sql_rows(ORACLES[name], sf_dir)
