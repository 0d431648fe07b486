"""Snapshots of the statistics: taking, listing, comparing, averaging.

A snapshot is one row per job over everything delivered so far. The functions
that read snapshots take a snapshot DataFrame (see ``read_snapshots``).
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oncemore.functions.columns import arrival_order, percent, per_second
from oncemore.plans.stats import full_stats, with_unique
from oncemore.schemas import SNAPSHOTS
from oncemore.sinks.tables import read_snapshots, write_snapshots


def _snapshot_columns(stats: DataFrame, time: Column, note: Column, numbering: list[str], first_id: int) -> DataFrame:
    span = F.col("last_out") - F.col("first_out")
    columns = {
        # One row per job and snapshot gets here, so one task can number them.
        "id": F.row_number().over(Window.orderBy(*numbering)) + (first_id - 1),
        "snapshot_time": time,
        "total_messages": F.col("total"),
        "unique_messages": F.col("unique"),
        "avg_latency": F.round("mean", 2),
        "min_latency": F.col("shortest"),
        "max_latency": F.col("longest"),
        "p50_latency": F.col("p50"),
        "p95_latency": F.col("p95"),
        "p99_latency": F.col("p99"),
        "stddev_latency": F.round("stddev", 2),
        "duplicate_messages": F.col("duplicates"),
        "duplicate_rate": percent(F.col("duplicates"), F.col("total"), 4),
        "max_process_count": F.col("most"),
        "total_reprocess_count": F.col("again"),
        "throughput_per_sec": per_second(F.col("total"), span),
        "time_window_sec": F.round(span / F.lit(1000.0), 0),
        "data_range_start": F.col("first_event"),
        "data_range_end": F.col("last_out"),
        "note": note,
    }
    rows = stats.withColumns(columns)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SNAPSHOTS])


def snapshot_rows(
    metrics: DataFrame, note: str, snapshot_time: Column | None = None, first_id: int = 1
) -> DataFrame:
    """The rows of one snapshot, numbered by job from ``first_id``."""
    stats = with_unique(full_stats(metrics), metrics, ["job_type"])
    return snapshot_of_figures(stats, note, snapshot_time, first_id)


def snapshot_of_figures(stats: DataFrame, note: str, snapshot_time: Column | None = None, first_id: int = 1) -> DataFrame:
    """The rows of one snapshot from the jobs' ``full_stats`` and ``unique``."""
    time = F.date_trunc("second", F.current_timestamp()) if snapshot_time is None else snapshot_time
    return _snapshot_columns(stats, time, F.lit(note), ["job_type"], first_id)


def last_id(spark: SparkSession, path: str, before: tuple[int, int] | None = None) -> int:
    """Highest snapshot id in the table, 0 when there is none. ``before``: only
    those of earlier generations and, in that one, of earlier batches."""
    try:
        stored = read_snapshots(spark, path, before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def create_snapshot(
    spark: SparkSession, metrics: DataFrame, path: str, note: str, snapshot_time: Column | None = None
) -> DataFrame:
    """Append a snapshot to the table at ``path`` (one writer at a time) and
    return the summary of the newest snapshot."""
    write_snapshots(snapshot_rows(metrics, note, snapshot_time, last_id(spark, path) + 1), path)
    return latest_snapshot(read_snapshots(spark, path))


def snapshot_series(
    deliveries: DataFrame, start_ms: int, width_s: int, duration_s: int, note: str = "window", first_id: int = 1
) -> DataFrame:
    """The snapshots a monitor takes at ``start_ms`` and then every ``width_s``
    seconds for ``duration_s`` seconds, each over all deliveries up to its time.

    The deliveries are read once, not once per snapshot. Each message yields one
    version per interval it was delivered in, valid until its next version.
    Equal versions are counted first; only the counts are repeated for every
    snapshot they are valid in.
    """
    cuts = -(-duration_s // width_s)
    width = width_s * 1000
    last_cut = start_ms + (cuts - 1) * width
    since = F.expr(f"greatest(0L, (out_time - {start_ms}L + {width - 1}L) div {width}L)")
    by_interval = (
        deliveries.where(F.col("out_time") <= last_cut)
        .withColumn("since", since)
        .groupBy("job_type", "msg_id", "since")
        .agg(
            F.min_by("create_time", arrival_order(deliveries)).alias("created"),
            F.max("out_time").alias("out_time"),
            F.max_by(F.col("out_time") - F.col("create_time"), arrival_order(deliveries)).alias("latency"),
            F.count("*").alias("arrivals"),
        )
    )
    # At most one row per snapshot in each partition of the window.
    message = Window.partitionBy("job_type", "msg_id").orderBy("since")
    versions = by_interval.select(
        "job_type",
        "since",
        F.coalesce(F.lead("since").over(message), F.lit(cuts).cast("bigint")).alias("until"),
        F.first("created").over(message).alias("event_time"),
        "out_time",
        "latency",
        F.sum("arrivals").over(message).alias("process_count"),
    )
    counted = versions.groupBy("job_type", "since", "until", "latency").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("process_count") > 1).alias("duplicates"),
        F.max("process_count").alias("most"),
        F.sum(F.col("process_count") - 1).alias("again"),
        F.min("event_time").alias("first_event"),
        F.min("out_time").alias("first_out"),
        F.max("out_time").alias("last_out"),
    )
    at_cut = counted.withColumn("cut", F.explode(F.sequence("since", F.col("until") - 1))).drop("since", "until")
    riders = {
        "duplicates": F.sum("duplicates"),
        "most": F.max("most"),
        "again": F.sum("again"),
        "first_event": F.min("first_event"),
        "first_out": F.min("first_out"),
        "last_out": F.max("last_out"),
    }
    stats = full_stats(at_cut, ("cut", "job_type"), riders, weight="messages").withColumn("unique", F.col("total"))
    time = F.timestamp_millis(F.lit(start_ms) + F.col("cut") * width)
    label = F.concat(F.lit(note + " "), (F.col("cut") + 1).cast("string"))
    return _snapshot_columns(stats, time, label, ["cut", "job_type"], first_id)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Summary of the newest snapshot, by job. Of several taken in one second the last counts."""
    newest = snapshots.select(F.max("snapshot_time")).scalar()
    last = snapshots.where(F.col("snapshot_time") == newest).groupBy("job_type")
    rows = last.agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != "job_type"]), "id").alias("row"))
    return (
        rows.select("job_type", "row.*")
        .orderBy("job_type", "id")
        .select(
            "job_type",
            "total_messages",
            F.col("avg_latency").alias("avg_latency_ms"),
            F.col("min_latency").alias("min_latency_ms"),
            F.col("max_latency").alias("max_latency_ms"),
            F.col("p95_latency").alias("p95_latency_ms"),
            F.col("p99_latency").alias("p99_latency_ms"),
            F.col("duplicate_rate").alias("duplicate_rate_pct"),
            "max_process_count",
            F.col("throughput_per_sec").alias("throughput_msg_s"),
        )
    )


def snapshot_history(
    snapshots: DataFrame, limit: int | None = None, note_contains: str | None = None
) -> DataFrame:
    """Snapshots, newest first; optionally those with a text in their note, and
    the first ``limit`` of them."""
    if note_contains is not None:
        snapshots = snapshots.where(F.col("note").contains(note_contains))
    history = snapshots.orderBy(F.col("snapshot_time").desc(), F.col("id").desc())
    if limit is not None:
        history = history.limit(limit)
    return history.select(
        "id",
        "snapshot_time",
        "job_type",
        "total_messages",
        F.col("avg_latency").alias("avg_latency_ms"),
        F.col("min_latency").alias("min_latency_ms"),
        F.col("max_latency").alias("max_latency_ms"),
        F.col("p95_latency").alias("p95_latency_ms"),
        F.col("p99_latency").alias("p99_latency_ms"),
        F.col("duplicate_rate").alias("duplicate_rate_pct"),
        "max_process_count",
        F.col("throughput_per_sec").alias("throughput_msg_s"),
        F.col("time_window_sec").alias("time_window_s"),
        "note",
    )


def compare_snapshots(snapshots: DataFrame, id1: int, id2: int) -> DataFrame:
    """Two snapshot rows of one job side by side; no row if the jobs differ."""
    compared = ("snapshot_time", "total_messages", "avg_latency", "p99_latency", "duplicate_rate", "throughput_per_sec")

    def side(n: int, snapshot_id: int) -> DataFrame:
        return snapshots.where(F.col("id") == snapshot_id).select(
            "job_type", *[F.col(c).alias(f"{c}_{n}") for c in compared]
        )

    def change(c: str) -> Column:
        return F.col(f"{c}_2") - F.col(f"{c}_1")

    return side(1, id1).join(side(2, id2), "job_type").select(
        "job_type",
        "snapshot_time_1",
        "snapshot_time_2",
        "total_messages_1",
        "total_messages_2",
        change("total_messages").alias("total_messages_change"),
        "avg_latency_1",
        "avg_latency_2",
        F.round(change("avg_latency"), 2).alias("avg_latency_change"),
        "p99_latency_1",
        "p99_latency_2",
        "duplicate_rate_1",
        "duplicate_rate_2",
        F.round(change("duplicate_rate"), 4).alias("duplicate_rate_change"),
        "throughput_per_sec_1",
        "throughput_per_sec_2",
    )


def avg_stats(snapshots: DataFrame, job_type: str, last_n: int) -> DataFrame:
    """Means over the newest ``last_n`` snapshots of a job; one row even if none."""
    newest = (
        snapshots.where(F.col("job_type") == job_type)
        .orderBy(F.col("snapshot_time").desc(), F.col("id").desc())
        .limit(last_n)
    )

    def average(c: str, digits: int) -> Column:
        return F.round(F.avg(F.col(c).cast("double")), digits)

    return newest.agg(
        F.count("*").alias("snapshots"),
        average("avg_latency", 2).alias("avg_latency_ms"),
        average("p99_latency", 2).alias("p99_latency_ms"),
        average("duplicate_rate", 4).alias("duplicate_rate_pct"),
        average("throughput_per_sec", 2).alias("throughput_msg_s"),
        F.min("snapshot_time").alias("first_snapshot"),
        F.max("snapshot_time").alias("last_snapshot"),
    ).select(F.lit(job_type).alias("job_type"), "*")


def snapshot_counts(snapshots: DataFrame) -> DataFrame:
    """Number of snapshots per job."""
    return snapshots.groupBy("job_type").agg(F.count("*").alias("snapshots"))
