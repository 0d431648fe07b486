"""What the plans must and must not contain, whatever the size of the tables."""

import pytest

import __spark_entry__ as entry
from tests.helpers import DATA

QUERIES = entry._queries()
# These write tables before they return a plan.
EAGER = {n for n in QUERIES if n.startswith("stream_") or "snapshot" in n or n in ("avg_stats", "reset_metrics")}
EAGER -= {"snapshot_series"}
ONE_SCAN = [
    "fold_metrics", "experiment_stats", "latency_percentiles", "nearest_rank_percentiles", "snapshot_series",
    "duplicates", "latency_distributions", "throughput_per_second", "message_metrics",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_slow_operators(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate", "Python", "Coalesce 1"):
        assert operator not in plan


@pytest.mark.parametrize("name", ONE_SCAN)
def test_one_scan(spark, name):
    assert plan_of(QUERIES[name](spark, DATA)).count("FileScan parquet") == 1


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["row_count"](spark, DATA))
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
    assert "EqualTo(event_type,click)" in plan


def test_arrivals_are_a_filter_on_the_stored_metrics(spark):
    plan = plan_of(QUERIES["arrivals_between"](spark, DATA))
    assert "LessThanOrEqual(first_out_time" in plan and plan.count("Exchange") == 1 and "msg_id" not in plan


def test_messages_are_parsed_once_per_stage(spark):
    assert plan_of(QUERIES["parsed_messages"](spark, DATA)).count("from_json") == 1
    # Once to enrich and once to collect; besides, what has the added fields already is written anew.
    assert plan_of(QUERIES["message_metrics"](spark, DATA)).count("from_json(StructField(v") == 2


def test_top_lists_do_not_sort_everything(spark):
    for name in ("duplicates", "throughput_per_second"):
        assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, DATA))
