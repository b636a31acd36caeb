"""Shape of the plans: pruned scans, bounded shuffles, no Python on the way."""

import re

import pytest

import __spark_entry__ as entry
from bench import HEADLINE

QUERIES = entry.queries()

#: Python is used for matrix products only.
VECTOR_KEYS = {
    "vector_topk", "vector_topk_blocks", "vector_topk_filtered", "vector_ann", "vector_ann_exact", "vector_ann_recall", "retrieve_dual",
    "retrieval_context", "retrieval_summary", "history_match", "history_context",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


KEYS = (
    "monthly_net_flow", "count_by_dim", "value_discovery", "vector_topk", "history_match",
    "governed_limit", "log_recent", "top_entities_internal", "log_update",
)


def check_rules(key, df):
    """Rules every registered query obeys."""
    physical = plan(df)
    if key not in VECTOR_KEYS:
        assert not re.search(r"Python|InPandas|InArrow", physical)
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    for line in physical.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\](,|$)", line), line[:200]


@pytest.fixture(scope="module")
def plans(spark, folder):
    return {k: plan(QUERIES[k](spark, folder)) for k in KEYS}


def test_headline_keys_exist():
    assert set(HEADLINE) <= set(QUERIES)


def test_flagship_prunes_and_pushes(plans):
    physical = plans["monthly_net_flow"]
    schema = re.search(r"ReadSchema: struct<([^>]*)", physical).group(1)
    assert "o_orderkey" not in schema and "o_custkey" in schema
    assert physical.count("Exchange hashpartitioning") == 2  # (dims, entity), then dims


def test_plain_aggregate_has_one_shuffle(plans):
    assert plans["count_by_dim"].count("Exchange hashpartitioning") == 1


def test_top_rows_are_cut_before_the_shuffle(plans):
    for key in ("value_discovery", "vector_topk", "history_match"):
        assert "WindowGroupLimit" in plans[key] and "Partial" in plans[key], key
    for key in ("governed_limit", "log_recent", "top_entities_internal"):
        assert "TakeOrderedAndProject" in plans[key], key


def test_log_is_not_shuffled_by_small_changes(plans):
    for key in ("log_update", "history_match"):
        assert "SortMergeJoin" not in plans[key], key


def test_constant_filters_reach_the_scan(spark, folder):
    from quorumlens.plans.definition import Definition, Filter, Measure, run
    from quorumlens.plans.schema import EventSchema

    orders = spark.read.parquet(f"{folder}/orders.parquet")
    schema = EventSchema(account="o_custkey", date="o_orderdate")
    made = Definition((Measure("COUNT"),), ("o_orderstatus",), (Filter("o_totalprice", ">", 1000.0),))
    text = plan(run(orders, made, schema=schema))
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in text
