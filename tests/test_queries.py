import pytest

from backtrail.plans.queries import ORACLES, QUERIES
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, DATA), ORACLES[name])


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["variable", "stem", "setters", "first_line"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
