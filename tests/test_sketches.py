import random

import pytest
from pyspark.sql import functions as F

from oncemore.operators import sketches
from oncemore.operators.percentiles import nearest_rank_percentiles
from oncemore.plans import stats
from oncemore.sinks.tables import read_sketches, write_sketches
from tests.helpers import METRIC, rows


@pytest.fixture(scope="module")
def metrics(spark):
    """A job that holds most messages, with long tails and repeated values, spread over 300 seconds."""
    rng = random.Random(7)
    data = []
    for i in range(30_000):
        job = "big" if i % 10 else rng.choice("ab")
        latency = rng.choice([int(rng.expovariate(1 / 800)), int(rng.paretovariate(0.7) * 10), 250])
        out = rng.randrange(300_000)
        data.append((job, i, out - latency, out, latency, 1))
    return spark.createDataFrame(data, METRIC)


PCTS = (1, 50, 90, 99, "99.9")


def test_rank_error_is_measured_and_small(spark, metrics):
    near = sketches.sketch_percentiles(sketches.latency_sketches(metrics), pcts=PCTS)
    errors = sketches.rank_errors(near, metrics, pcts=PCTS).collect()
    assert len(errors) == 3 * len(PCTS)
    assert max(r.rank_error for r in errors) <= sketches.RANK_ERROR
    exact = {r.job_type: r for r in nearest_rank_percentiles(metrics, ["job_type"], "latency", PCTS).collect()}
    names = {float(p): sketches.name_of(p) for p in PCTS}
    assert all(r.exact == exact[r.job_type][names[r.pct]] for r in errors)


def test_the_measure_sees_a_wrong_percentile(spark):
    rows_ = spark.createDataFrame([("a", i, 0, 0, i, 1) for i in range(1, 101)], METRIC)
    near = spark.createDataFrame([("a", 50, 80, 100)], "job_type string, p50_latency_ms long, p95_latency_ms long, p99_latency_ms long")
    got = {r.pct: (r.exact, r.near, round(r.rank_error, 6)) for r in sketches.rank_errors(near, rows_).collect()}
    assert got == {50.0: (50, 50, 0.0), 95.0: (95, 80, 0.15), 99.0: (99, 100, 0.01)}


def test_counts_and_extremes_are_exact(spark, metrics):
    got = sketches.sketch_percentiles(sketches.latency_sketches(metrics)).drop("p50_latency_ms", "p95_latency_ms", "p99_latency_ms")
    want = stats.latency_percentiles(metrics).drop("p50_latency_ms", "p95_latency_ms", "p99_latency_ms")
    assert sorted(rows(got)) == sorted(rows(want))


def test_few_values_are_exact(spark):
    data = [("a", i, 0, 1000 * i, v, 1) for i, v in enumerate([5, 1, 9, 9, 3])] + [("b", 9, 0, 0, 7, 1)]
    near = sketches.sketch_percentiles(sketches.latency_sketches(spark.createDataFrame(data, METRIC)), pcts=(50, 99))
    assert sorted((r.job_type, r.p50_latency_ms, r.p99_latency_ms) for r in near.collect()) == [("a", 5, 9), ("b", 7, 7)]


def test_any_merge_of_stored_sketches(spark, metrics, tmp_path):
    """By job, over all jobs, and over some seconds, which only reads sketches."""
    write_sketches(sketches.latency_sketches(metrics), str(tmp_path))
    stored = read_sketches(spark, str(tmp_path))
    late = stored.where("second >= 200")
    every = metrics.withColumn("all", F.lit("all"))
    near = sketches.sketch_percentiles(stored.withColumn("all", F.lit("all")), ["all"])
    assert all(r.rank_error <= sketches.RANK_ERROR for r in sketches.rank_errors(near, every, ["all"]).collect())
    window = metrics.where("out_time >= 200000")
    errors = sketches.rank_errors(sketches.sketch_percentiles(late), window).collect()
    assert len(errors) == 9 and all(r.rank_error <= sketches.RANK_ERROR for r in errors)


def test_missing_latencies_and_no_rows(spark):
    data = [("a", 1, None, 0, None, 1), ("a", 2, 0, 10, 10, 1)]
    metrics = spark.createDataFrame(data, METRIC)
    got = sketches.sketch_percentiles(sketches.latency_sketches(metrics)).first()
    assert got.total_messages == 2 and got.p99_latency_ms == 10
    assert sketches.sketch_percentiles(sketches.latency_sketches(metrics.limit(0))).count() == 0
