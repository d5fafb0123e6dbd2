"""Every registered query against its SQL on the smallest tables, and its plan: no product or nested-loop joins.

Queries without SQL must run.
"""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    result = compare(df, SQL.get(name), FOLDER)
    assert result.startswith(("ok", "rows")), result
    if name.startswith(("A", "J", "P", "T", "U", "W")):
        text = physical_plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filtered(spark):
    text = physical_plan(entry.queries()["J30_left_antijoin_pending"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in text and "o_totalprice" not in text
    text = physical_plan(entry.queries()["A1_frame_stats"](spark, FOLDER))
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(entry.queries())
