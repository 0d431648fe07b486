import random

import pytest
from pyspark.sql import functions as F

from oncemore.operators.fold import fold
from oncemore.plans import stats
from tests.helpers import DELIVERY, POSITION, rows


def test_event_time_from_first_latency_from_last(spark):
    log = spark.createDataFrame([("a", 1, 100, 150), ("a", 1, 120, 400), ("a", 2, 7, 9)], DELIVERY)
    assert sorted(rows(fold(log).drop("first_out_time"))) == [("a", 1, 100, 400, 280, 2), ("a", 2, 7, 9, 2, 1)]


def test_first_arrival_is_kept(spark):
    log = spark.createDataFrame([("a", 1, 0, 400), ("a", 1, 0, 150), ("a", 1, 0, 900)], DELIVERY)
    assert [(r.first_out_time, r.out_time) for r in fold(log).collect()] == [(150, 900)]


def test_position_decides_within_a_millisecond(spark):
    log = spark.createDataFrame(
        [("a", 1, 30, 100, 0, 2), ("a", 1, 10, 100, 0, 1), ("a", 1, 20, 100, 1, 0), ("a", 1, 99, 99, 5, 9)], POSITION
    )
    assert rows(fold(log).drop("first_out_time")) == [("a", 1, 99, 100, 80, 4)]
    tied = log.where("out_time = 100")
    assert rows(fold(tied).drop("first_out_time")) == [("a", 1, 10, 100, 80, 3)]


def test_without_position_ties_do_not_depend_on_partitions(spark):
    data = [("a", 1, c, 100) for c in range(-5, 20)]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        log = spark.createDataFrame(data, DELIVERY).repartition(seed + 2)
        assert rows(fold(log).drop("first_out_time")) == [("a", 1, -5, 100, 81, 25)]


def test_position_out_of_range_fails(spark):
    log = spark.createDataFrame([("a", 1, 0, 1, 2**20, 0)], POSITION)
    with pytest.raises(Exception, match="topic position out of range"):
        fold(log).collect()


def test_largest_position(spark):
    top = 2**43 - 1
    log = spark.createDataFrame([("a", 1, 5, 1, 2**20 - 1, top), ("a", 1, 6, 1, 2**20 - 1, top - 1)], POSITION)
    assert rows(fold(log).drop("first_out_time")) == [("a", 1, 6, 1, -4, 2)]


def test_hot_message_is_combined_before_the_shuffle(spark):
    log = spark.range(0, 300_000, numPartitions=8).select(
        F.lit("a").alias("job_type"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("msg_id"),
        F.col("id").alias("create_time"),
        (F.col("id") + 10).alias("out_time"),
    )
    folded = fold(log)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_max_by" in plan
    hot = folded.where("msg_id = 0").first()
    assert (hot.process_count, hot.event_time, hot.latency) == (100_000, 0, 10)


def test_full_replay_doubles_every_count(spark):
    log = spark.createDataFrame([("a", i, i, i + 5) for i in range(50)], DELIVERY)
    replayed = log.unionByName(log.withColumn("out_time", F.col("out_time") + 3_600_000))
    assert {r.process_count for r in fold(replayed).collect()} == {2}
    assert fold(replayed).count() == 50


def test_run_column_keeps_runs_apart(spark):
    log = spark.createDataFrame([("a", 1, 0, 5), ("a", 1, 0, 6)], DELIVERY)
    runs = log.withColumn("run_id", F.col("out_time").cast("string"))
    by_run = fold(runs, ("run_id", "job_type", "msg_id"))
    assert by_run.count() == 2
    counted = stats.duplicate_stats(by_run, ("run_id", "job_type"))
    assert {(r.run_id, r.duplicate_messages) for r in counted.collect()} == {("5", 0), ("6", 0)}


def test_counts_add_up_to_the_deliveries(spark):
    rng = random.Random(7)
    data = [(rng.choice("ab"), rng.randrange(40), rng.randrange(100), rng.randrange(1000)) for _ in range(500)]
    log = spark.createDataFrame(data, DELIVERY)
    assert fold(log).agg(F.sum("process_count")).first()[0] == 500


def test_no_deliveries(spark):
    empty = fold(spark.createDataFrame([], DELIVERY))
    assert empty.collect() == []
    assert stats.latency_stats(empty).collect() == []
    assert stats.experiment_stats(empty).collect() == []
    assert rows(stats.monitor_stats(empty, "a")) == [(0, None, 0)]
