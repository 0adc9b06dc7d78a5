"""Queries cover all rows of their tables: each is held against its SQL without the cut that the SQL still has."""

import pytest

from backtrail.plans.queries import ORACLES, QUERIES
from tests.oracle import same

LARGER = "/root/testdata/sf0.01"


def whole(name, *changes):
    """The query's SQL with changes (from, to) made in it, as far as it has them."""
    sql = ORACLES[name]
    for old, new in changes:
        sql = sql.replace(old, new)
    return sql


@pytest.mark.parametrize("name", ["dominators", "necessary_guards"])
def test_all_groups_are_covered(spark, name):
    got = QUERIES[name](spark, LARGER)
    same(got, whole(name, (" AND src // 8 < 12", "")), LARGER)
    if name == "dominators":
        assert got.where("file >= 12").count() > 0


def test_all_parts_own_names(spark):
    got = QUERIES["audit_orphans"](spark, LARGER)
    same(got, whole("audit_orphans", (" WHERE p_partkey < 60", ""), ("upper(p_name) AS name", "upper(p_name) || '_' || (p_partkey % n) // 4 AS name")), LARGER)
    assert got.count() > 0


def test_all_parts_own_callees(spark):
    got = QUERIES["hop_callee"](spark, LARGER)
    same(got, whole("hop_callee", (" WHERE p_partkey < 60", ""), ("p_brand AS", "p_brand || '_' || p_partkey % 3 AS")), LARGER)
    assert got.select("callee").distinct().count() > 25


def test_all_parts_have_guards(spark):
    same(QUERIES["edge_guards"](spark, LARGER), whole("edge_guards", (" WHERE p_partkey % 9 = 0 AND p_partkey < 400", "")), LARGER)


def test_all_texts_are_resolved(spark):
    same(QUERIES["const_lookup"](spark, LARGER), whole("const_lookup", (" WHERE o_orderkey % 3 = 0", "")), LARGER)
