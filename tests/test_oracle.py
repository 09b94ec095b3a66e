import pytest
from oracle import assert_same

from tideflow.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, data_dir, name):
    assert_same(spark, data_dir, catalogue.queries()[name], catalogue.oracle_sql()[name])
