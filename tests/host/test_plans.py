"""Plans: no Cartesian products, no row-at-a-time Python, pruned scans."""

import os

import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

#: Joins without keys whose broadcast side is one row, a constant or a closed list of categories.
BOUNDED = {"aligned_layout", "adjacent_ranges_merge", "transport_split", "canonical_ordinals", "ordinal_span", "request_overlap", "coverage_matrix", "ownership_delta", "import_closure"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_pair_explosion(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert name in BOUNDED or "NestedLoopJoin" not in text


def test_scans_read_what_they_need(spark):
    text = plan(catalog.QUERIES["latency_summary"](spark, DATA))
    assert text.count("ReadSchema: struct<event_type:string,value:double>") == text.count("ReadSchema")
    assert "PushedFilters: [IsNotNull(value)" in text
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan(catalog.QUERIES["next_purchase_after_click"](spark, DATA))
