import pytest
from compare import check_rows, connect, spark_rows

from curioledger.llm import registered

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.CHECKS))
def test_query_matches_sql(spark, name):
    found = spark_rows(registered.QUERIES[name](spark, FOLDER))
    assert found == check_rows(connect(FOLDER), registered.CHECKS[name])
