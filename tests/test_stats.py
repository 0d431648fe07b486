from pyspark.sql import functions as F

from oncemore.operators.fold import fold
from oncemore.plans import stats
from tests.helpers import DELIVERY, METRIC, metrics_with_latencies, rows

SAMPLE = [("a", 1, 1702444800000, 1702444800050, 50, 1), ("b", 1, 1702444800000, 1702444800055, 55, 1)]


def test_sample_rows(spark):
    metrics = spark.createDataFrame(SAMPLE, METRIC)
    assert sorted(rows(stats.latency_stats(metrics))) == [
        ("a", 1, 50.0, 50, 50, 0.0, 0.05),
        ("b", 1, 55.0, 55, 55, 0.0, 0.06),
    ]
    got = {r.job_type: r for r in stats.experiment_stats(metrics).collect()}
    assert got["a"].p95_latency_ms is None and got["a"].throughput_msg_s is None
    assert (got["b"].total_messages, got["b"].duplicate_rate_pct) == (1, 0.0)


def test_stddev_is_of_the_population(spark):
    metrics = metrics_with_latencies(spark, [2, 4, 4, 4, 5, 5, 7, 9])
    assert stats.latency_stats(metrics).first().stddev_latency_ms == 2.0
    assert stats.full_stats(metrics).first().stddev == 2.0


def test_full_stats_agree_with_plain_aggregates(spark):
    metrics = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("job_type"),
        F.col("id").alias("msg_id"),
        F.col("id").alias("event_time"),
        (F.col("id") * 7).alias("out_time"),
        (F.xxhash64("id") % 900_000).alias("latency"),
        (F.col("id") % 4 + 1).alias("process_count"),
    )
    plain = metrics.groupBy("job_type").agg(
        F.count("*"), F.avg("latency"), F.min("latency"), F.max("latency"), F.stddev_pop("latency"),
        F.count_if(F.col("process_count") > 1), F.max("process_count"), F.sum(F.col("process_count") - 1),
        F.min("event_time"), F.min("out_time"), F.max("out_time"),
    )
    full = stats.full_stats(metrics).drop("p50", "p95", "p99")
    for got, want in zip(sorted(rows(full)), sorted(rows(plain))):
        assert got[0] == want[0]
        assert all(abs(g - w) <= 1e-9 * max(1, abs(w)) for g, w in zip(got[1:], want[1:]))


def test_latency_without_create_time_does_not_overflow(spark):
    now = 1_704_067_200_000
    log = spark.range(4000).select(
        F.lit("a").alias("job_type"), F.col("id").alias("msg_id"), F.lit(0).cast("long").alias("create_time"),
        (F.lit(now) + F.col("id")).alias("out_time"),
    )
    got = stats.latency_percentiles(fold(log)).first()
    assert (got.p50_latency_ms, got.avg_latency_ms) == (now + 1999, now + 1999.5)
    # The sum of many such latencies exceeds 64 bits.
    counted = spark.createDataFrame([("a", now, 10_000_000)], "job_type string, latency long, k long")
    riders = {c: F.count("*") for c in ("duplicates", "most", "again", "first_event", "first_out", "last_out")}
    assert stats.full_stats(counted, extras=riders, weight="k").first().mean == now


def test_range_edges_belong_to_the_upper_range(spark):
    metrics = metrics_with_latencies(spark, [99, 100, 499, 500, 999, 1000, 1999, 2000, 4999, 5000])
    assert rows(stats.latency_distribution(metrics, "a")) == [
        ("0-100ms", 1, 10.0),
        ("100-500ms", 2, 20.0),
        ("500-1000ms", 2, 20.0),
        ("1-2s", 2, 20.0),
        ("2-5s", 2, 20.0),
        (">5s", 1, 10.0),
    ]
    assert rows(stats.latency_distribution(metrics, "b")) == []


def test_prefix_does_not_reach_behind_the_newest_seconds(spark):
    data = [("new", i, 0, 1_000_000 + i * 1000, 1, 1) for i in range(100)] + [("old", 1, 0, 5000, 1, 1)]
    metrics = spark.createDataFrame(data, METRIC)
    assert stats.throughput_per_second(metrics).count() == 100
    assert stats.throughput_per_second(metrics, job_prefix="old").collect() == []
    assert stats.throughput_per_second(metrics, n=101, job_prefix="old").count() == 1
    last = stats.throughput_per_second(metrics, last=2).select("second").collect()
    assert [r.second for r in last] == [1099, 1098]


def test_duplicates_order_and_prefix(spark):
    data = [("ab", 5, 0, 9, 9, 2), ("ab", 3, 0, 9, 9, 2), ("ac", 1, 1500, 9, 9, 4), ("ab", 4, 0, 9, 9, 1)]
    metrics = spark.createDataFrame(data, METRIC)
    assert [r.msg_id for r in stats.duplicates(metrics, "ab").collect()] == [3, 5]
    both = stats.duplicates(metrics, job_prefix="a", n=2).collect()
    assert [(r.job_type, r.msg_id) for r in both] == [("ac", 1), ("ab", 3)]
    assert both[0].created_at.timestamp() == 1.5


def test_arrivals_count_first_deliveries_only(spark):
    log = spark.createDataFrame([("a", 1, 0, 10), ("a", 1, 0, 25), ("a", 2, 0, 22), ("b", 1, 0, 5), ("b", 2, 0, 99)], DELIVERY)
    assert sorted(rows(stats.arrivals_between(fold(log), 20, 30))) == [("a", 1, True), ("b", 0, False)]


def test_seconds_round_down(spark):
    metrics = spark.createDataFrame([("a", i, 0, t, 1, 1) for i, t in enumerate([-1, 0, 999, 1000])], METRIC)
    assert sorted(rows(stats.second_counts(metrics))) == [("a", -1, 1), ("a", 0, 2), ("a", 1, 1)]


def test_numbers_of_the_larger_fixture(spark):
    """Figures that were computed independently of this library."""
    import __spark_entry__ as entry

    got = {r.job_type: r for r in stats.full_stats(entry._metrics(spark, "/root/testdata/sf0.01")).collect()}
    click = got["click"]
    assert (click.total, click.duplicates, click.again) == (2006, 108, 125)
    assert (click.shortest, click.longest, click.p50, click.p95, click.p99) == (1, 54002, 3806, 16035, 22433)
    assert (round(click.mean, 2), round(click.stddev, 2)) == (5393.87, 5266.38)
    assert (got["view"].total, got["view"].p99) == (1982, 21058)
