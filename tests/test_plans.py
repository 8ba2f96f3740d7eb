"""The plans are the ones wanted: no nested loops, filters and columns at the scan, no Python where expressions do."""

import pytest

from inkgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "MapInArrow" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.QUERIES["promotion"](spark, SF))
    assert "EqualTo(l_linenumber,7)" in text and "l_extendedprice" not in text
    text = plan(catalogue.QUERIES["text_search"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
