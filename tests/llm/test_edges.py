"""Every query over nulls, empty and long texts, ties, repeated rows, clashing columns, and over empty tables."""

import pytest

from backtrail.llm.queries import queries
from tests.llm.conftest import EDGES

TABLE = {"op1": "pages", "op10": "pages", "op8": "conversations"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, nothing, name):
    assert queries()[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_edge_rows(spark, edges, name):
    got = queries()[name](spark, edges).collect()
    if name.startswith("op") and not name.startswith("op7"):
        assert len(got) == len(EDGES[TABLE.get(name.split("_")[0], "documents")])
