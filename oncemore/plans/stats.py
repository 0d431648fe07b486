"""Statistics over the metrics table.

Each function takes a metrics DataFrame (see ``fold``) and returns a DataFrame.
``by`` names the grouping columns; add a run column to keep runs apart.
``job_prefix`` keeps the jobs whose name starts with it.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oncemore.functions.columns import per_second, percent, second_of
from oncemore.operators.percentiles import mean, percentile, ranked_histogram, stddev_pop
from oncemore.schemas import METRICS

JOB = ("job_type",)

# Upper bounds (exclusive, ms) and names of the latency ranges.
LATENCY_RANGES = (
    (100, "0-100ms"),
    (500, "100-500ms"),
    (1000, "500-1000ms"),
    (2000, "1-2s"),
    (5000, "2-5s"),
)
LAST_RANGE = ">5s"


def _duplicated() -> Column:
    return F.count_if(F.col("process_count") > 1)


def _of(metrics: DataFrame, job_prefix: str | None) -> DataFrame:
    return metrics if job_prefix is None else metrics.where(F.col("job_type").startswith(job_prefix))


def latency_stats(metrics: DataFrame, by: Sequence[str] = JOB, job_prefix: str | None = None) -> DataFrame:
    """Count, mean, extremes and population standard deviation of the latency."""
    return _of(metrics, job_prefix).groupBy(*by).agg(
        F.count("*").alias("total_messages"),
        F.round(F.avg("latency"), 2).alias("avg_latency_ms"),
        F.min("latency").alias("min_latency_ms"),
        F.max("latency").alias("max_latency_ms"),
        F.round(F.stddev_pop("latency"), 2).alias("stddev_latency_ms"),
        F.round(F.avg("latency") / 1000, 2).alias("avg_latency_s"),
    )


def duplicate_stats(metrics: DataFrame, by: Sequence[str] = JOB, job_prefix: str | None = None) -> DataFrame:
    """How many messages arrived more than once, and how often."""
    return _of(metrics, job_prefix).groupBy(*by).agg(
        F.count("*").alias("total_messages"),
        _duplicated().alias("duplicate_messages"),
        percent(_duplicated(), F.count("*"), 2).alias("duplicate_rate_pct"),
        F.max("process_count").alias("max_process_count"),
        F.sum(F.col("process_count") - 1).alias("total_reprocess_count"),
    )


def comparison(metrics: DataFrame, by: Sequence[str] = JOB, job_prefix: str | None = None) -> DataFrame:
    """Latency and duplicates of the jobs side by side."""
    return _of(metrics, job_prefix).groupBy(*by).agg(
        F.count("*").alias("total_messages"),
        F.round(F.avg("latency"), 2).alias("avg_latency_ms"),
        percent(_duplicated(), F.count("*"), 2).alias("duplicate_rate_pct"),
        F.max("process_count").alias("max_process_count"),
    )


def latency_percentiles(metrics: DataFrame, by: Sequence[str] = JOB, job_prefix: str | None = None) -> DataFrame:
    """Latency summary with exact P50, P95 and P99."""
    return ranked_histogram(_of(metrics, job_prefix), by, "latency").groupBy(*by).agg(
        F.sum("n").alias("total_messages"),
        F.round(mean(), 2).alias("avg_latency_ms"),
        F.min("latency").alias("min_latency_ms"),
        F.max("latency").alias("max_latency_ms"),
        *[percentile(p, "latency").alias(f"p{p}_latency_ms") for p in (50, 95, 99)],
    )


def full_stats(
    metrics: DataFrame, by: Sequence[str] = JOB, extras: dict[str, Column] | None = None, weight: str | None = None
) -> DataFrame:
    """Every statistic of a group in one pass, not rounded.

    The figures that are not about latency ride along in the latency histogram,
    so the metrics are read (or folded) once.
    """
    riders = extras or {
        "duplicates": _duplicated(),
        "most": F.max("process_count"),
        "again": F.sum(F.col("process_count") - 1),
        "first_event": F.min("event_time"),
        "first_out": F.min("out_time"),
        "last_out": F.max("out_time"),
    }
    return ranked_histogram(metrics, by, "latency", riders, weight).groupBy(*by).agg(
        F.sum("n").alias("total"),
        mean().alias("mean"),
        F.min("latency").alias("shortest"),
        F.max("latency").alias("longest"),
        stddev_pop("latency").alias("stddev"),
        *[percentile(p, "latency").alias(f"p{p}") for p in (50, 95, 99)],
        F.sum("duplicates").alias("duplicates"),
        F.max("most").alias("most"),
        F.sum("again").alias("again"),
        F.min("first_event").alias("first_event"),
        F.min("first_out").alias("first_out"),
        F.max("last_out").alias("last_out"),
    )


def with_unique(report: DataFrame, metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """``report`` with the number of distinct messages of each group as ``unique``.

    A metrics row is one message of its key. So messages and distinct messages
    agree, unless the metrics have more key columns (a run, say) than ``by``:
    then the ids are counted.
    """
    runs = [c for c in metrics.columns if c not in METRICS.names and c not in by]
    if not runs and "job_type" in by:
        return report.withColumn("unique", F.col("total"))
    return report.join(metrics.groupBy(*by).agg(F.count_distinct("msg_id").alias("unique")), list(by))


def experiment_stats(metrics: DataFrame, by: Sequence[str] = JOB, job_prefix: str | None = None) -> DataFrame:
    """The full report of a job: volume, latency, duplicates and throughput."""
    metrics = _of(metrics, job_prefix)
    return with_unique(full_stats(metrics, by), metrics, by).select(
        *by,
        F.col("total").alias("total_messages"),
        F.col("unique").alias("unique_messages"),
        percent(F.col("duplicates"), F.col("total"), 2).alias("duplicate_share_pct"),
        F.round("mean", 2).alias("avg_latency_ms"),
        F.col("shortest").alias("min_latency_ms"),
        F.col("longest").alias("max_latency_ms"),
        F.col("p95").alias("p95_latency_ms"),
        F.col("p99").alias("p99_latency_ms"),
        F.col("duplicates").alias("duplicate_messages"),
        percent(F.col("duplicates"), F.col("total"), 4).alias("duplicate_rate_pct"),
        F.col("most").alias("max_process_count"),
        F.col("again").alias("total_reprocess_count"),
        per_second(F.col("total"), F.col("last_out") - F.col("first_out")).alias("throughput_msg_s"),
    )


def second_counts(metrics: DataFrame, by: Sequence[str] = JOB) -> DataFrame:
    """Messages per job and second of ``out_time``; seconds without any are absent."""
    return metrics.groupBy(*by, second_of("out_time").alias("second")).agg(F.count("*").alias("messages"))


def throughput_per_second(
    metrics: DataFrame, n: int = 100, job_prefix: str | None = None, last: int | None = None
) -> DataFrame:
    """The ``n`` newest seconds over all jobs, newest first.

    ``job_prefix`` and then ``last`` narrow down these ``n`` rows; they do not
    reach further back.
    """
    order = (F.col("second").desc(), F.col("job_type"))
    newest = second_counts(metrics).orderBy(*order).limit(n)
    if job_prefix is not None:
        newest = newest.where(F.col("job_type").startswith(job_prefix))
    if last is not None:
        newest = newest.orderBy(*order).limit(last)
    return newest.select("job_type", "second", F.timestamp_seconds("second").alias("ts"), "messages")


def _named(metrics: DataFrame, job_type: str | None, job_prefix: str | None) -> DataFrame:
    if job_type is not None:
        metrics = metrics.where(F.col("job_type") == job_type)
    return _of(metrics, job_prefix)


def duplicates(
    metrics: DataFrame, job_type: str | None = None, n: int = 100, job_prefix: str | None = None
) -> DataFrame:
    """The ``n`` messages of a job (or of all jobs with a prefix) that arrived
    most often, among those that arrived more than once."""
    tie = ["msg_id"] if job_type is not None else ["msg_id", "job_type"]
    lead = [] if job_type is not None else ["job_type"]
    return (
        _named(metrics, job_type, job_prefix)
        .where(F.col("process_count") > 1)
        .orderBy(F.col("process_count").desc(), *tie)
        .limit(n)
        .select(
            *lead,
            "msg_id",
            "process_count",
            F.col("latency").alias("latency_ms"),
            F.timestamp_millis("event_time").alias("created_at"),
        )
    )


def latency_range() -> Column:
    """Name of the latency range a row falls in; upper bounds are exclusive."""
    bound, name = LATENCY_RANGES[0]
    case = F.when(F.col("latency") < bound, name)
    for bound, name in LATENCY_RANGES[1:]:
        case = case.when(F.col("latency") < bound, name)
    return case.otherwise(LAST_RANGE)


def latency_distributions(
    metrics: DataFrame, job_prefix: str | None = None, by: Sequence[str] = JOB
) -> DataFrame:
    """Messages per job and latency range, with the share of the job's total."""
    counts = (
        _of(metrics, job_prefix)
        .groupBy(*by, latency_range().alias("bucket"))
        .agg(F.count("*").alias("messages"), F.min("latency").alias("_least"))
    )
    # At most six rows per job reach the window.
    total = F.sum("messages").over(Window.partitionBy(*by))
    return (
        counts.withColumn("share_pct", percent(F.col("messages"), total, 2))
        .orderBy(*by, "_least")
        .select(*by, "bucket", "messages", "share_pct")
    )


def latency_distribution(metrics: DataFrame, job_type: str) -> DataFrame:
    """Latency ranges of one job, lowest first."""
    return latency_distributions(metrics.where(F.col("job_type") == job_type)).drop("job_type")


def monitor_stats(metrics: DataFrame, job_type: str) -> DataFrame:
    """One line on a job: messages, mean latency, duplicated messages."""
    return metrics.where(F.col("job_type") == job_type).agg(
        F.count("*").alias("messages"),
        F.round(F.avg("latency"), 2).alias("avg_latency_ms"),
        _duplicated().alias("duplicates"),
    )


def row_count(metrics: DataFrame, job_type: str | None = None) -> DataFrame:
    """Number of messages, of one job or of all."""
    return _named(metrics, job_type, None).agg(F.count("*").alias("n"))


def arrivals_between(metrics: DataFrame, after_ms: int, until_ms: int) -> DataFrame:
    """Per job that has a message first delivered until ``until_ms``: the messages
    first delivered in ``(after_ms, until_ms]``, and whether there were any."""
    new = F.count_if(F.col("first_out_time") > after_ms)
    return (
        metrics.where(F.col("first_out_time") <= until_ms)
        .groupBy("job_type")
        .agg(new.alias("new_messages"), (new > 0).alias("flowing"))
    )


def delivery_stats(deliveries: DataFrame, by: Sequence[str] = JOB) -> DataFrame:
    """Running figures of a collector: every delivery counts. Works on streams."""
    latency = F.col("out_time") - F.col("create_time")
    return deliveries.groupBy(*by).agg(
        F.count("*").alias("deliveries"),
        F.round(F.avg(latency), 2).alias("avg_latency_ms"),
        F.min(latency).alias("min_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
    )
