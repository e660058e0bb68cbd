import pytest

from larkspur import plans
from tests.compare import same


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    same(plans.QUERIES[name](spark, sf), duck.execute(plans.SQL[name]))


def test_entry_registers_all():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
