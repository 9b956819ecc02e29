import pytest

from haplospark.plans import more, queries as plans  # noqa: F401  (more registers queries too)
from tests.oracle import DATA, connect, differ


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql_twin(spark, name):
    assert differ(plans.QUERIES[name](spark, DATA), plans.SQL[name], connect()) is None
