"""

All queries read the whole ``events`` table. It stands for a delivery log as
described in ``oncemore.sources.eventlog``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from oncemore.functions import messages as msg
from oncemore.operators import sketches
from oncemore.operators.fold import KEY, fold
from oncemore.operators.percentiles import nearest_rank_percentiles
from oncemore.plans import faults, snapshots, stats, views
from oncemore.sinks.tables import (
    read_metrics,
    read_runs,
    read_sketches,
    read_snapshots,
    reset_metrics,
    reset_run,
    write_metrics,
    write_runs,
    write_sketches,
    write_snapshots,
)
from oncemore.sources import eventlog, faultlog
from oncemore.streaming import counts, first, progress
from oncemore.streaming import delivery as streams
from oncemore.streaming.state import latest_rows, shared_dir, start_table

try:
    import corpus_pipeline
    from oncemore.llm import queries as llm
except ModuleNotFoundError as missing:
    # The rest of the library stands without the operators on training text.
    if missing.name not in ("corpus_pipeline", "oncemore.llm"):
        raise
    corpus_pipeline = llm = None

T0 = eventlog.START_MS
SERIES = {"start_ms": T0, "width_s": 600, "duration_s": 3600}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _events(spark, sf_dir).schema
    # A stream takes a single file only by pattern.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def _log_stream(spark: SparkSession, sf_dir: str, files: str | None = None) -> DataFrame:
    """The log as a stream of four micro-batches, none in order of time: a
    message's deliveries are dealt over files by a hash."""
    path = files or _log_files(spark, sf_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reader = spark.readStream.schema(_log(spark, sf_dir).schema).option("maxFilesPerTrigger", max(1, n // 4))
    return reader.parquet(path)


def _log_files(spark: SparkSession, sf_dir: str, where: str = "true") -> str:
    path = shared_dir(spark, "log")
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = _log(spark, sf_dir).where(where).repartition(n, F.xxhash64("msg_id", "out_time"))
    dealt.write.parquet(path)
    return path


def _dealt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of four micro-batches whose deliveries are known: each takes a share dealt by id and second."""
    path = shared_dir(spark, "dealt")
    log = _log(spark, sf_dir)
    for deal in range(4):
        share = log.where(f"(msg_id * 7 + out_time div 1000) % 4 = {deal}")
        share.repartition(2).write.mode("append").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.redelivered_log(_events(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(_log(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_series(_log(spark, sf_dir), **SERIES)


# Snapshot tables by application and input folder: the queries on snapshots share one.
_TABLES: dict[tuple[str, str], str] = {}


def _snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored snapshot table, as the queries on snapshots expect it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        path = shared_dir(spark, "snapshots")
        write_snapshots(_series(spark, sf_dir), path)
        _TABLES[key] = path
    return read_snapshots(spark, _TABLES[key])


def _doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines return the same type."""
    decimals = [f.name for f in df.schema if isinstance(f.dataType, DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals})


def _of_metrics(query: Callable[..., DataFrame], *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(_metrics(spark, sf_dir), *args, **kwargs)


def _of_log(query: Callable[..., DataFrame], *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(_log(spark, sf_dir), *args, **kwargs)


def _of_snapshots(query: Callable[..., DataFrame], *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _doubles(query(_snapshot_table(spark, sf_dir), *args, **kwargs))


def _user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(eventlog.user_log(_events(spark, sf_dir)))


def _stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written to a table and read back."""
    path = shared_dir(spark, "metrics")
    write_metrics(_metrics(spark, sf_dir), path)
    return read_metrics(spark, path)


def _wide_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values spread over 10**15, nearly all of them different."""
    wide = _metrics(spark, sf_dir).withColumn("wide", F.expr("(msg_id * 7919L % 1000003L) * 1000000007L - latency"))
    return nearest_rank_percentiles(wide, ["job_type"], "wide", (1, 25, 50, 75, 99))


def _stats_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics keyed by run as well; redeliveries fall into the other run."""
    log = _log(spark, sf_dir).withColumn("run", F.expr("out_time div 5000L % 2L"))
    report = stats.experiment_stats(fold(log, ["job_type", "run", "msg_id"]))
    return report.select("job_type", "total_messages", "unique_messages", "duplicate_messages", "p95_latency_ms")


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored metrics: the filter on the first arrival reaches the scan."""
    path = shared_dir(spark, "metrics")
    write_metrics(_metrics(spark, sf_dir), path)
    return stats.arrivals_between(read_metrics(spark, path), T0 + 600_000, T0 + 603_000)


def _reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after emptying a metrics table."""
    path = shared_dir(spark, "metrics")
    write_metrics(_metrics(spark, sf_dir), path)
    before = stats.row_count(read_metrics(spark, path)).first()["n"]
    reset_metrics(spark, path)
    return stats.row_count(read_metrics(spark, path)).select(F.lit(before).cast("bigint").alias("n_before"), "n")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All views of a stored table joined in SQL."""
    path, taken = shared_dir(spark, "metrics"), shared_dir(spark, "snapshots")
    write_metrics(_metrics(spark, sf_dir), path)
    metrics = read_metrics(spark, path)
    snapshots.create_snapshot(spark, metrics, taken, "view", F.timestamp_millis(F.lit(T0)))
    views.create_views(metrics, read_snapshots(spark, taken))
    return spark.sql("""
        SELECT job_type, p.p99_latency_ms, c.duplicate_rate_pct, c.max_process_count, l.stddev_latency_ms,
               d.total_reprocess_count, e.throughput_msg_s, h.total_messages, t.messages AS newest_messages
        FROM v_latency_percentiles p
        JOIN v_comparison c USING (job_type)
        JOIN v_latency_stats l USING (job_type)
        JOIN v_duplicate_stats d USING (job_type)
        JOIN v_experiment_stats e USING (job_type)
        JOIN v_snapshot_history h USING (job_type)
        LEFT JOIN (SELECT job_type, sum(messages) AS messages FROM v_throughput_per_second GROUP BY job_type) t USING (job_type)
    """)


def _create_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "snapshots")
    time = F.timestamp_millis(F.lit(T0 + 3_000_000))
    snapshots.create_snapshot(spark, _metrics(spark, sf_dir), path, "final", time)
    return _doubles(read_snapshots(spark, path))


def _parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = eventlog.message_topic(_events(spark, sf_dir))
    return msg.parse(topic).select("job_type", "offset", "msg_id", "create_time", "malformed")


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = msg.split_malformed(eventlog.message_topic(_events(spark, sf_dir)))
    return bad.select("job_type", "offset", F.length("value").cast("bigint").alias("chars"))


def _enriched_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = eventlog.message_topic(_events(spark, sf_dir))
    out = msg.enrich(topic, "spark", at=F.col("out_time"))
    return _fields_of_enriched(out, "offset")


def _fields_of_enriched(messages: DataFrame, *keep: str) -> DataFrame:
    schema = (
        "msg_id STRING, create_time STRING, payload STRING, props STRUCT<k: STRING>, "
        "process_time STRING, processor STRING"
    )
    fields = messages.select(*keep, F.inline_outer(F.array(F.from_json("value", schema))))
    return fields.withColumn("k", F.col("props.k")).drop("props")


def _message_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From messages to metrics: enrich, collect, fold."""
    topic = eventlog.message_topic(_events(spark, sf_dir))
    result = msg.enrich(topic, "spark", at=F.col("out_time"))
    return fold(msg.deliveries_of(result, F.col("job_type"), out_time=F.col("process_time")))


def _fault_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faultlog.parse_fault_lines(eventlog.fault_lines(_events(spark, sf_dir)))


def _fault_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.fault_recovery(_fault_log(spark, sf_dir), stats.second_counts(_metrics(spark, sf_dir)))


def _duplicate_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job as a run of one fault type with a fault per redelivery."""
    fault_type = (
        F.when(F.col("job_type") == "click", "spout")
        .when(F.col("job_type") == "error", "bolt-after")
        .when(F.col("job_type") == "purchase", "bolt-before")
        .when(F.col("job_type") == "signup", "after")
        .otherwise("none")
    )
    counted = stats.duplicate_stats(_metrics(spark, sf_dir))
    runs = counted.select(
        "job_type", fault_type.alias("fault_type"), F.col("duplicate_messages").alias("faults")
    )
    return faults.duplicate_expectation(runs, counted)


def _stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "metrics")
    streams.start_fold(
        _log_stream(spark, sf_dir), path, shared_dir(spark, "checkpoint"), every=None
    ).awaitTermination()
    return streams.current_metrics(spark, path)


def _stream_restarted_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold of part of the log, then of all of it, with a new checkpoint into the same table."""
    path = shared_dir(spark, "metrics")
    for where in ("msg_id % 3 > 0", "true"):
        log = _log_stream(spark, sf_dir, _log_files(spark, sf_dir, where))
        streams.start_fold(log, path, shared_dir(spark, "checkpoint"), every=None).awaitTermination()
    return streams.current_metrics(spark, path)


def _stream_delivery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log_stream(spark, sf_dir)
    path = shared_dir(spark, "running")
    streams.start_delivery_stats(log, path, shared_dir(spark, "checkpoint"), every=None).awaitTermination()
    return latest_rows(spark, path, stats.delivery_stats(_log(spark, sf_dir)).schema, ["job_type"])


def _stream_second_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "seconds")
    counts.start_second_counts(
        _log_stream(spark, sf_dir), path, shared_dir(spark, "checkpoint"), every=None
    ).awaitTermination()
    return counts.current_second_totals(spark, path)


def _stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every micro-batch reports, from the log of a listener."""
    path = shared_dir(spark, "progress")
    log = progress.observed(_dealt_stream(spark, sf_dir))
    with progress.ProgressLog(spark, path) as kept:
        query = streams.start_delivery_stats(log, shared_dir(spark, "running"), shared_dir(spark, "checkpoint"), every=None)
        query.awaitTermination()
        kept.wait(query)
    batches = progress.read_progress(spark, path)
    return batches.select("batch_id", "input_rows", "deliveries", "sum_latency", "min_latency", "max_latency")


def _measured(near: DataFrame, rows: DataFrame) -> DataFrame:
    """Percentiles of sketches beside the exact ones, with the bound on their ranks as a statement."""
    errors = sketches.rank_errors(near, rows)
    return errors.select("job_type", "pct", "total_messages", "exact", (F.col("rank_error") <= sketches.RANK_ERROR).alias("within"))


def _sketch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged from sketches stored per job and second."""
    path = shared_dir(spark, "sketches")
    metrics = _metrics(spark, sf_dir)
    write_sketches(sketches.latency_sketches(metrics), path)
    return _measured(sketches.sketch_percentiles(read_sketches(spark, path)), metrics)


def _stream_sketch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all deliveries, kept by a stream and merged."""
    path = shared_dir(spark, "sketches")
    latency = F.col("out_time") - F.col("create_time")
    kept = sketches.latency_sketches(_log_stream(spark, sf_dir), value=latency)
    key = ["job_type", "second"]
    start_table(kept, path, shared_dir(spark, "checkpoint"), every=None, keys=key).awaitTermination()
    near = sketches.sketch_percentiles(latest_rows(spark, path, kept.schema, key))
    return _measured(near, _log(spark, sf_dir).withColumn("latency", latency))


def _reset_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs in one table: one is emptied, one written again from half of its messages."""
    path = shared_dir(spark, "runs")
    log = _log(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run "), (F.col("msg_id") % 3).cast("string")))
    key = ("run_id", *KEY)
    write_runs(fold(log, key), path)
    reset_run(spark, path, "run 1")
    write_runs(fold(log.where("run_id = 'run 2' AND msg_id % 2 = 0"), key), path)
    return stats.duplicate_stats(read_runs(spark, path), by=("run_id", "job_type"))


def _stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log_stream(spark, sf_dir)
    path = shared_dir(spark, "first")
    streams.start_first_deliveries(log, path, shared_dir(spark, "checkpoint"), every=None).awaitTermination()
    return latest_rows(spark, path, log.schema, ["job_type", "msg_id"])


def _stream_first_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats are looked up a minute back; later ones are outvoted."""
    log = _log_stream(spark, sf_dir)
    path = shared_dir(spark, "first")
    first.start_first_within(log, path, shared_dir(spark, "checkpoint"), 60_000, every=None).awaitTermination()
    return first.current_firsts(spark, path, log.schema)


def _stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = eventlog.message_topic(_events_stream(spark, sf_dir))
    path = shared_dir(spark, "enriched")
    streams.start_enrich_to_files(
        topic, "spark", path, shared_dir(spark, "checkpoint"), every=None, at=F.col("out_time")
    ).awaitTermination()
    return _fields_of_enriched(spark.read.text(path).where("NOT malformed"))


def _stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots after each of the micro-batches."""
    path = shared_dir(spark, "snapshots")
    streams.start_snapshots(
        _dealt_stream(spark, sf_dir), shared_dir(spark, "metrics"), path, shared_dir(spark, "checkpoint"), every=None
    ).awaitTermination()
    return _doubles(read_snapshots(spark, path).drop("snapshot_time"))


def entry(spark: SparkSession) -> DataFrame:
    """The full report per job over the smallest delivery log."""
    return stats.experiment_stats(_metrics(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}
    return _queries() | more


def oracle_sql() -> dict[str, str]:
    more = dict(llm.SQL) if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        more["pipeline"] = corpus_pipeline.ORACLE_SQL
    return _oracle_sql() | more


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # The fold and the statistics over it.
        "fold_metrics": _metrics,
        "fold_user_messages": _user_messages,
        "latency_stats": _of_metrics(stats.latency_stats),
        "duplicate_stats": _of_metrics(stats.duplicate_stats),
        "comparison": _of_metrics(stats.comparison),
        "comparison_of_prefix": _of_metrics(stats.comparison, job_prefix="s"),
        "experiment_stats": _of_metrics(stats.experiment_stats),
        "experiment_stats_of_runs": _stats_of_runs,
        "latency_percentiles": _of_metrics(stats.latency_percentiles),
        "nearest_rank_percentiles": _of_metrics(
            nearest_rank_percentiles, ["job_type"], "latency", (1, 25, 50, 75, 90, "99.9")
        ),
        "wide_percentiles": _wide_percentiles,
        "throughput_per_second": _of_metrics(stats.throughput_per_second),
        "throughput_of_prefix": _of_metrics(stats.throughput_per_second, job_prefix="s", last=10),
        "second_counts": _of_metrics(stats.second_counts),
        "duplicates": _of_metrics(stats.duplicates, "click"),
        "duplicates_of_prefix": _of_metrics(stats.duplicates, n=20, job_prefix="s"),
        "latency_distribution": _of_metrics(stats.latency_distribution, "click"),
        "latency_distributions": _of_metrics(stats.latency_distributions),
        "monitor_stats": _of_metrics(stats.monitor_stats, "click"),
        "row_count": _of_metrics(stats.row_count, "click"),
        "arrivals_between": _arrivals,
        "delivery_stats": _of_log(stats.delivery_stats),
        "stored_metrics": _stored_metrics,
        "reset_metrics": _reset,
        "reset_of_run": _reset_of_run,
        "sketch_percentiles": _sketch_percentiles,
        "views_in_sql": _views,
        # Snapshots.
        "create_snapshot": _create_snapshot,
        "snapshot_series": lambda spark, sf_dir: _doubles(_series(spark, sf_dir)),
        "latest_snapshot": _of_snapshots(snapshots.latest_snapshot),
        "snapshot_history": _of_snapshots(snapshots.snapshot_history),
        "snapshot_history_of_note": _of_snapshots(snapshots.snapshot_history, limit=5, note_contains="dow 3"),
        "compare_snapshots": _of_snapshots(snapshots.compare_snapshots, 1, 21),
        "avg_stats": _of_snapshots(snapshots.avg_stats, "click", 3),
        "snapshot_counts": _of_snapshots(snapshots.snapshot_counts),
        # Faults.
        "fault_log": _fault_log,
        "fault_recovery": _fault_recovery,
        "duplicate_expectation": _duplicate_expectation,
        # Messages.
        "parsed_messages": _parsed_messages,
        "quarantined_messages": _quarantined,
        "enriched_messages": _enriched_messages,
        "message_metrics": _message_metrics,
        # Streams, run over the whole input.
        "stream_fold_metrics": _stream_fold,
        "stream_restarted_fold": _stream_restarted_fold,
        "stream_delivery_stats": _stream_delivery_stats,
        "stream_second_counts": _stream_second_counts,
        "stream_first_deliveries": _stream_first_deliveries,
        "stream_first_within": _stream_first_within,
        "stream_enriched_messages": _stream_enriched,
        "stream_snapshots": _stream_snapshots,
        "stream_progress": _stream_progress,
        "stream_sketch_percentiles": _stream_sketch_percentiles,
    }


_LOG = f"""
base AS (
  SELECT event_type AS job_type, event_id AS msg_id,
         {T0} + (epoch_us(ts) // 1000 - {T0}) // 1000 AS out_time,
         CAST(round(value * 100) AS BIGINT) AS took
  FROM events
),
deliveries AS (
  SELECT job_type, msg_id, out_time - took AS create_time, out_time FROM base
  UNION ALL
  SELECT job_type, msg_id, out_time - took, out_time + 5000 FROM base WHERE msg_id % 20 = 0
  UNION ALL
  SELECT job_type, msg_id, out_time - took, out_time + 10000 FROM base WHERE msg_id % 100 = 0
)"""

_METRICS = f"""{_LOG},
metrics AS (
  SELECT job_type, msg_id, arg_min(create_time, out_time) AS event_time, max(out_time) AS out_time,
         arg_max(out_time - create_time, out_time) AS latency, count(*) AS process_count,
         min(out_time) AS first_out_time
  FROM deliveries GROUP BY job_type, msg_id
)"""


def _ranked(source: str, by: str, pcts: dict[str, tuple[int, int]]) -> str:
    """CTEs that take the row at each percentile's rank, by sorting the rows."""
    picks = ", ".join(
        f"max(CASE WHEN rn = (total * {num}) // {den} THEN latency END) AS {name}"
        for name, (num, den) in pcts.items()
    )
    return f"""
ranked AS (
  SELECT {by}, latency, row_number() OVER (PARTITION BY {by} ORDER BY latency) AS rn,
         count(*) OVER (PARTITION BY {by}) AS total
  FROM {source}
),
pcts AS (SELECT {by}, {picks} FROM ranked GROUP BY {by})"""


_P = {"p50": (50, 100), "p95": (95, 100), "p99": (99, 100)}

_SECONDS = """
seconds AS (
  SELECT job_type, out_time // 1000 AS second, count(*) AS messages FROM metrics GROUP BY ALL
)"""

# The micro-batch of `_dealt_stream` that a delivery comes in.
_DEAL = "(msg_id * 7 + out_time // 1000) % 4"


def _snapshots_at(cuts: int, seen: str) -> str:
    """Snapshots after each of some cuts, over the deliveries seen by then."""
    return f"""
WITH {_LOG},
cuts AS (SELECT range AS cut, {T0} + range * 600000 AS cut_time FROM range({cuts})),
metrics AS (
  SELECT cut, job_type, msg_id, arg_min(create_time, out_time) AS event_time, max(out_time) AS out_time,
         arg_max(out_time - create_time, out_time) AS latency, count(*) AS process_count
  FROM deliveries JOIN cuts ON {seen} GROUP BY cut, job_type, msg_id
),
{_ranked("metrics", "cut, job_type", _P)},
snapshots AS (
  SELECT row_number() OVER (ORDER BY cut, job_type) AS id,
         make_timestamp(({T0} + cut * 600000) * 1000) AS snapshot_time, job_type,
         count(*) AS total_messages, count(DISTINCT msg_id) AS unique_messages,
         round(avg(latency), 2) AS avg_latency,
         min(latency) AS min_latency, max(latency) AS max_latency,
         CAST(max(p50) AS DOUBLE) AS p50_latency, CAST(max(p95) AS DOUBLE) AS p95_latency,
         CAST(max(p99) AS DOUBLE) AS p99_latency,
         round(stddev_pop(latency), 2) AS stddev_latency,
         count(*) FILTER (process_count > 1) AS duplicate_messages,
         round(count(*) FILTER (process_count > 1) / count(*) * 100, 4) AS duplicate_rate,
         CAST(max(process_count) AS INTEGER) AS max_process_count,
         CAST(sum(process_count - 1) AS BIGINT) AS total_reprocess_count,
         round(count(*) / nullif((max(out_time) - min(out_time)) / 1000.0, 0), 2) AS throughput_per_sec,
         CAST(round((max(out_time) - min(out_time)) / 1000.0, 0) AS BIGINT) AS time_window_sec,
         min(event_time) AS data_range_start, max(out_time) AS data_range_end,
         'window ' || CAST(cut + 1 AS VARCHAR) AS note
  FROM metrics JOIN pcts USING (cut, job_type) GROUP BY cut, job_type
)"""


_SERIES = _snapshots_at(6, "out_time <= cut_time")

def _sketch_check(source: str) -> str:
    """The exact percentiles, and that those of the sketches are near them."""
    rows = " UNION ALL ".join(
        f"SELECT job_type, {p}::DOUBLE AS pct, count(*) AS total_messages, max(CASE WHEN rn = total * {p} // 100 THEN latency END) AS exact,"
        " true AS within FROM ranked GROUP BY job_type"
        for p in sketches.PCTS
    )
    return f"""
WITH {_METRICS},
arrivals AS (SELECT job_type, out_time - create_time AS latency FROM deliveries),
ranked AS (
  SELECT job_type, latency, row_number() OVER (PARTITION BY job_type ORDER BY latency) AS rn,
         count(*) OVER (PARTITION BY job_type) AS total
  FROM {source}
)
{rows}"""


_SUMMARY = """job_type, total_messages, avg_latency AS avg_latency_ms, min_latency AS min_latency_ms,
  max_latency AS max_latency_ms, p95_latency AS p95_latency_ms, p99_latency AS p99_latency_ms,
  duplicate_rate AS duplicate_rate_pct, max_process_count, throughput_per_sec AS throughput_msg_s"""

_HISTORY = """id, snapshot_time, job_type, total_messages, avg_latency AS avg_latency_ms,
  min_latency AS min_latency_ms, max_latency AS max_latency_ms, p95_latency AS p95_latency_ms,
  p99_latency AS p99_latency_ms, duplicate_rate AS duplicate_rate_pct, max_process_count,
  throughput_per_sec AS throughput_msg_s, time_window_sec AS time_window_s, note"""

_COMPARISON = f"""
WITH {_METRICS}
SELECT job_type, count(*) AS total_messages, round(avg(latency), 2) AS avg_latency_ms,
       round(count(*) FILTER (process_count > 1) / count(*) * 100, 2) AS duplicate_rate_pct,
       max(process_count) AS max_process_count
FROM metrics"""

# Ranges as rows to join with: name, lower bound, upper bound.
_BOUNDS = [-(2**62), *(bound for bound, _ in stats.LATENCY_RANGES), 2**62]
_NAMES = [*(name for _, name in stats.LATENCY_RANGES), stats.LAST_RANGE]
_RANGES = f"""
ranges(bucket, low, high) AS (
  VALUES {", ".join(str(r) for r in zip(_NAMES, _BOUNDS, _BOUNDS[1:]))}
)"""

_DUPLICATE_ROWS = "msg_id, process_count, latency AS latency_ms, make_timestamp(event_time * 1000) AS created_at"

_DUPLICATES = """
SELECT job_type, count(*) AS total_messages,
       count(*) FILTER (process_count > 1) AS duplicate_messages,
       round(count(*) FILTER (process_count > 1) / count(*) * 100, 2) AS duplicate_rate_pct,
       max(process_count) AS max_process_count,
       CAST(sum(process_count - 1) AS BIGINT) AS total_reprocess_count
FROM metrics GROUP BY job_type"""

_TOPIC = f"""
topic AS (
  SELECT event_type AS job_type, event_id AS "offset", value, props,
         {T0} + (epoch_us(ts) // 1000 - {T0}) // 1000 AS out_time,
         {T0} + (epoch_us(ts) // 1000 - {T0}) // 1000 - CAST(round(value * 100) AS BIGINT) AS create_time,
         value < 1 AS cut_short
  FROM events
)"""

_ENRICHED = """CASE WHEN value > 300 THEN NULL ELSE CAST("offset" AS VARCHAR) END AS msg_id,
  CAST(create_time AS VARCHAR) AS create_time, 'x' AS payload, json_extract_string(props, '$.k') AS k,
  CAST(out_time AS VARCHAR) AS process_time, 'spark' AS processor
FROM topic WHERE NOT cut_short"""

_FAULTS = f"""
faults AS (
  SELECT make_timestamp(({T0} + (epoch_us(ts) // 1000 - {T0}) // 1000) // 1000 * 1000000) AS inject_time,
         CASE event_type WHEN 'click' THEN 'kill-worker' WHEN 'view' THEN 'kill-tm' WHEN 'error' THEN 'kill-jm'
           WHEN 'signup' THEN 'checkpoint' ELSE 'network-tm' END AS fault_type,
         CASE WHEN event_type NOT IN ('error', 'signup') THEN 'node' || CAST(user_id AS VARCHAR) END AS node,
         CASE WHEN event_type IN ('click', 'view', 'error') THEN CAST(event_id AS VARCHAR)
           WHEN event_type = 'signup' THEN 'job-' || CAST(event_id AS VARCHAR) END AS target
  FROM events
)"""

_DELIVERY_STATS = f"""
WITH {_LOG}
SELECT job_type, count(*) AS deliveries, round(avg(out_time - create_time), 2) AS avg_latency_ms,
       min(out_time - create_time) AS min_latency_ms, max(out_time - create_time) AS max_latency_ms
FROM deliveries GROUP BY job_type"""

_FIRST = f"""
WITH {_LOG}
SELECT job_type, msg_id, arg_min(create_time, out_time) AS create_time, min(out_time) AS out_time
FROM deliveries GROUP BY job_type, msg_id"""

_MONITOR = f"""
WITH {_METRICS}
SELECT count(*) AS messages, round(avg(latency), 2) AS avg_latency_ms,
       count(*) FILTER (process_count > 1) AS duplicates
FROM metrics WHERE job_type = 'click'"""


def _oracle_sql() -> dict[str, str]:
    fold_sql = f"WITH {_METRICS} SELECT * FROM metrics"
    final = _SERIES + f" SELECT {_SUMMARY} FROM snapshots WHERE snapshot_time = (SELECT max(snapshot_time) FROM snapshots)"
    return {
        "fold_metrics": fold_sql,
        "fold_user_messages": f"""
WITH log AS (
  SELECT event_type AS job_type, user_id AS msg_id, event_id,
         {T0} + (epoch_us(ts) // 1000 - {T0}) // 1000000 * 1000 AS out_time,
         CAST(round(value * 100) AS BIGINT) AS took
  FROM events
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY job_type, msg_id ORDER BY out_time, event_id) AS nth,
         count(*) OVER (PARTITION BY job_type, msg_id) AS process_count
  FROM log
)
SELECT job_type, msg_id, max(CASE WHEN nth = 1 THEN out_time - took END) AS event_time,
       max(out_time) AS out_time, max(CASE WHEN nth = process_count THEN took END) AS latency,
       max(process_count) AS process_count, min(out_time) AS first_out_time
FROM numbered GROUP BY job_type, msg_id""",
        "latency_stats": f"""
WITH {_METRICS}
SELECT job_type, count(*) AS total_messages, round(avg(latency), 2) AS avg_latency_ms,
       min(latency) AS min_latency_ms, max(latency) AS max_latency_ms,
       round(stddev_pop(latency), 2) AS stddev_latency_ms, round(avg(latency) / 1000, 2) AS avg_latency_s
FROM metrics GROUP BY job_type""",
        "duplicate_stats": f"WITH {_METRICS} {_DUPLICATES}",
        "comparison": f"{_COMPARISON} GROUP BY job_type",
        "comparison_of_prefix": f"{_COMPARISON} WHERE job_type LIKE 's%' GROUP BY job_type",
        "experiment_stats": f"""
WITH {_METRICS},
{_ranked("metrics", "job_type", _P)}
SELECT job_type, count(*) AS total_messages, count(DISTINCT msg_id) AS unique_messages,
       round(count(DISTINCT msg_id) FILTER (process_count > 1) / count(DISTINCT msg_id) * 100, 2)
         AS duplicate_share_pct,
       round(avg(latency), 2) AS avg_latency_ms, min(latency) AS min_latency_ms, max(latency) AS max_latency_ms,
       max(p95) AS p95_latency_ms, max(p99) AS p99_latency_ms,
       count(DISTINCT msg_id) FILTER (process_count > 1) AS duplicate_messages,
       round(count(DISTINCT msg_id) FILTER (process_count > 1) / count(DISTINCT msg_id) * 100, 4)
         AS duplicate_rate_pct,
       max(process_count) AS max_process_count, CAST(sum(process_count - 1) AS BIGINT) AS total_reprocess_count,
       round(count(*) / nullif((max(out_time) - min(out_time)) / 1000.0, 0), 2) AS throughput_msg_s
FROM metrics JOIN pcts USING (job_type) GROUP BY job_type""",
        "latency_percentiles": f"""
WITH {_METRICS},
{_ranked("metrics", "job_type", _P)}
SELECT job_type, count(*) AS total_messages, round(avg(latency), 2) AS avg_latency_ms,
       min(latency) AS min_latency_ms, max(latency) AS max_latency_ms,
       max(p50) AS p50_latency_ms, max(p95) AS p95_latency_ms, max(p99) AS p99_latency_ms
FROM metrics JOIN pcts USING (job_type) GROUP BY job_type""",
        "nearest_rank_percentiles": "WITH "
        + _METRICS
        + ","
        + _ranked(
            "metrics",
            "job_type",
            {
                "p1": (1, 100),
                "p25": (25, 100),
                "p50": (50, 100),
                "p75": (75, 100),
                "p90": (90, 100),
                "p99_9": (999, 1000),
            },
        )
        + " SELECT * FROM pcts",
        "throughput_per_second": f"""
WITH {_METRICS}, {_SECONDS}
SELECT job_type, second, make_timestamp(second * 1000000) AS ts, messages
FROM seconds ORDER BY second DESC, job_type LIMIT 100""",
        "throughput_of_prefix": f"""
WITH {_METRICS}, {_SECONDS},
newest AS (SELECT * FROM seconds ORDER BY second DESC, job_type LIMIT 100)
SELECT job_type, second, make_timestamp(second * 1000000) AS ts, messages
FROM newest WHERE job_type LIKE 's%' ORDER BY second DESC, job_type LIMIT 10""",
        "wide_percentiles": f"""
WITH {_METRICS},
wide AS (SELECT * REPLACE ((msg_id * 7919 % 1000003) * 1000000007 - latency AS latency) FROM metrics),
{_ranked("wide", "job_type", {f"p{p}": (p, 100) for p in (1, 25, 50, 75, 99)})}
SELECT * FROM pcts""",
        "experiment_stats_of_runs": f"""
WITH {_LOG},
metrics AS (
  SELECT job_type, out_time // 5000 % 2 AS run, msg_id, arg_max(out_time - create_time, out_time) AS latency,
         count(*) AS process_count
  FROM deliveries GROUP BY ALL
),
{_ranked("metrics", "job_type", {"p95_latency_ms": (95, 100)})}
SELECT job_type, count(*) AS total_messages, count(DISTINCT msg_id) AS unique_messages,
       count(*) FILTER (process_count > 1) AS duplicate_messages, max(p95_latency_ms) AS p95_latency_ms
FROM metrics JOIN pcts USING (job_type) GROUP BY job_type""",
        "second_counts": f"WITH {_METRICS}, {_SECONDS} SELECT * FROM seconds",
        "duplicates": f"""
WITH {_METRICS}
SELECT {_DUPLICATE_ROWS} FROM metrics WHERE job_type = 'click' AND process_count > 1
ORDER BY process_count DESC, msg_id LIMIT 100""",
        "duplicates_of_prefix": f"""
WITH {_METRICS}
SELECT job_type, {_DUPLICATE_ROWS} FROM metrics WHERE job_type LIKE 's%' AND process_count > 1
ORDER BY process_count DESC, msg_id, job_type LIMIT 20""",
        "latency_distribution": f"""
WITH {_METRICS}, {_RANGES}
SELECT bucket, count(*) AS messages, round(count(*) / sum(count(*)) OVER () * 100, 2) AS share_pct
FROM metrics JOIN ranges ON latency >= low AND latency < high
WHERE job_type = 'click' GROUP BY bucket ORDER BY min(latency)""",
        "latency_distributions": f"""
WITH {_METRICS}, {_RANGES}
SELECT job_type, bucket, count(*) AS messages,
       round(count(*) / sum(count(*)) OVER (PARTITION BY job_type) * 100, 2) AS share_pct
FROM metrics JOIN ranges ON latency >= low AND latency < high
GROUP BY job_type, bucket ORDER BY job_type, min(latency)""",
        "monitor_stats": _MONITOR,
        "row_count": f"WITH {_METRICS} SELECT count(*) AS n FROM metrics WHERE job_type = 'click'",
        "arrivals_between": f"""
WITH {_LOG},
first AS (SELECT job_type, msg_id, min(out_time) AS first_out FROM deliveries GROUP BY ALL),
known AS (SELECT * FROM first WHERE first_out <= {T0 + 603_000})
SELECT job_type, count(*) FILTER (first_out > {T0 + 600_000}) AS new_messages,
       count(*) FILTER (first_out > {T0 + 600_000}) > 0 AS flowing
FROM known GROUP BY job_type""",
        "delivery_stats": _DELIVERY_STATS,
        "stored_metrics": fold_sql,
        "reset_metrics": f"WITH {_METRICS} SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n FROM metrics",
        "reset_of_run": f"""
WITH {_METRICS},
runs AS (SELECT *, 'run ' || CAST(msg_id % 3 AS VARCHAR) AS run_id FROM metrics)
SELECT run_id, job_type, count(*) AS total_messages, count(*) FILTER (process_count > 1) AS duplicate_messages,
       round(count(*) FILTER (process_count > 1) / count(*) * 100, 2) AS duplicate_rate_pct,
       max(process_count) AS max_process_count, CAST(sum(process_count - 1) AS BIGINT) AS total_reprocess_count
FROM runs WHERE run_id = 'run 0' OR run_id = 'run 2' AND msg_id % 2 = 0 GROUP BY run_id, job_type""",
        "sketch_percentiles": _sketch_check("metrics"),
        "views_in_sql": f"""
WITH {_METRICS},
{_ranked("metrics", "job_type", _P)}
SELECT job_type, max(p99) AS p99_latency_ms,
       round(count(*) FILTER (process_count > 1) / count(*) * 100, 2) AS duplicate_rate_pct,
       max(process_count) AS max_process_count, round(stddev_pop(latency), 2) AS stddev_latency_ms,
       CAST(sum(process_count - 1) AS BIGINT) AS total_reprocess_count,
       round(count(*) / nullif((max(out_time) - min(out_time)) / 1000.0, 0), 2) AS throughput_msg_s,
       count(*) AS total_messages, max(newest) AS newest_messages
FROM metrics JOIN pcts USING (job_type) LEFT JOIN (
  SELECT job_type, CAST(sum(messages) AS BIGINT) AS newest
  FROM (
    SELECT job_type, out_time // 1000 AS second, count(*) AS messages FROM metrics
    GROUP BY ALL ORDER BY second DESC, job_type LIMIT 100
  ) GROUP BY job_type
) USING (job_type) GROUP BY job_type""",
        "create_snapshot": _SERIES
        + f""", last AS (SELECT * FROM snapshots WHERE note = 'window 6')
SELECT * REPLACE (row_number() OVER (ORDER BY job_type) AS id, make_timestamp({T0 + 3_000_000} * 1000) AS snapshot_time,
                  'final' AS note) FROM last""",
        "snapshot_series": f"{_SERIES} SELECT * FROM snapshots",
        "latest_snapshot": f"{final} ORDER BY job_type",
        "snapshot_history": f"{_SERIES} SELECT {_HISTORY} FROM snapshots ORDER BY snapshot_time DESC, id DESC",
        "snapshot_history_of_note": f"""{_SERIES} SELECT {_HISTORY} FROM snapshots WHERE note LIKE '%dow 3%'
ORDER BY snapshot_time DESC, id DESC LIMIT 5""",
        "compare_snapshots": _SERIES
        + """
SELECT s1.job_type, s1.snapshot_time AS snapshot_time_1, s2.snapshot_time AS snapshot_time_2,
       s1.total_messages AS total_messages_1, s2.total_messages AS total_messages_2,
       s2.total_messages - s1.total_messages AS total_messages_change,
       s1.avg_latency AS avg_latency_1, s2.avg_latency AS avg_latency_2,
       round(s2.avg_latency - s1.avg_latency, 2) AS avg_latency_change,
       s1.p99_latency AS p99_latency_1, s2.p99_latency AS p99_latency_2,
       s1.duplicate_rate AS duplicate_rate_1, s2.duplicate_rate AS duplicate_rate_2,
       round(s2.duplicate_rate - s1.duplicate_rate, 4) AS duplicate_rate_change,
       s1.throughput_per_sec AS throughput_per_sec_1, s2.throughput_per_sec AS throughput_per_sec_2
FROM snapshots s1 JOIN snapshots s2 USING (job_type) WHERE s1.id = 1 AND s2.id = 21""",
        "avg_stats": _SERIES
        + """,
newest AS (SELECT * FROM snapshots WHERE job_type = 'click' ORDER BY snapshot_time DESC, id DESC LIMIT 3)
SELECT 'click' AS job_type, count(*) AS snapshots, round(avg(avg_latency), 2) AS avg_latency_ms,
       round(avg(p99_latency), 2) AS p99_latency_ms, round(avg(duplicate_rate), 4) AS duplicate_rate_pct,
       round(avg(throughput_per_sec), 2) AS throughput_msg_s,
       min(snapshot_time) AS first_snapshot, max(snapshot_time) AS last_snapshot
FROM newest""",
        "snapshot_counts": f"{_SERIES} SELECT job_type, count(*) AS snapshots FROM snapshots GROUP BY job_type",
        "fault_log": f"WITH {_FAULTS} SELECT * FROM faults",
        "fault_recovery": f"""
WITH {_METRICS}, {_SECONDS}, {_FAULTS},
hits AS (SELECT DISTINCT epoch_us(inject_time) // 1000000 AS hit FROM faults),
baselines AS (
  SELECT hit, job_type, sum(messages) / 60 AS baseline
  FROM hits JOIN seconds ON second >= hit - 60 AND second < hit GROUP BY ALL
),
recoveries AS (
  SELECT hit, b.job_type, baseline, min(second) AS back
  FROM baselines b LEFT JOIN seconds s ON b.job_type = s.job_type AND second > hit
    AND messages >= baseline * 0.9::DOUBLE
  GROUP BY ALL
)
SELECT inject_time, fault_type, node, target, j.job_type, round(baseline, 2) AS baseline_msg_s,
       make_timestamp(back * 1000000) AS recovered_at, back - epoch_us(inject_time) // 1000000 AS recovery_s
FROM (SELECT DISTINCT * FROM faults) f, (SELECT DISTINCT job_type FROM seconds) j
LEFT JOIN recoveries r ON r.job_type = j.job_type AND r.hit = epoch_us(f.inject_time) // 1000000""",
        "duplicate_expectation": f"""
WITH {_METRICS}, counted AS ({_DUPLICATES}),
runs AS (
  SELECT *, CASE job_type WHEN 'click' THEN 'spout' WHEN 'error' THEN 'bolt-after' WHEN 'purchase' THEN 'bolt-before'
           WHEN 'signup' THEN 'after' ELSE 'none' END AS fault_type
  FROM counted
),
expected AS (
  SELECT job_type, fault_type, duplicate_messages AS faults,
         CAST(CASE fault_type WHEN 'spout' THEN 30 WHEN 'bolt-before' THEN 10 WHEN 'bolt-after' THEN 10 END AS BIGINT)
           AS expected_recovery_s,
         duplicate_messages * CASE WHEN fault_type = 'spout' THEN 1000
           WHEN fault_type IN ('bolt-after', 'after') THEN 1 ELSE 0 END AS expected_duplicates,
         total_reprocess_count AS observed
  FROM runs
)
SELECT *, round(observed / nullif(expected_duplicates, 0), 4) AS ratio FROM expected""",
        "parsed_messages": f"""
WITH {_TOPIC}
SELECT job_type, "offset", CASE WHEN cut_short OR value > 300 THEN 0 ELSE "offset" END AS msg_id,
       CASE WHEN cut_short THEN 0 ELSE create_time END AS create_time, cut_short AS malformed FROM topic""",
        "quarantined_messages": f"""
WITH {_TOPIC}
SELECT job_type, "offset", length('{{"msg_id":' || "offset" || ',"create_time":' || create_time
       || ',"payload":"x","props":' || props) AS chars
FROM topic WHERE cut_short""",
        "enriched_messages": f'WITH {_TOPIC} SELECT "offset", {_ENRICHED}',
        "message_metrics": f"""
WITH {_TOPIC},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY job_type, msg_id ORDER BY out_time, "offset") AS nth,
         count(*) OVER (PARTITION BY job_type, msg_id) AS process_count
  FROM (SELECT *, CASE WHEN value > 300 THEN 0 ELSE "offset" END AS msg_id FROM topic WHERE NOT cut_short)
)
SELECT job_type, msg_id, max(CASE WHEN nth = 1 THEN create_time END) AS event_time, max(out_time) AS out_time,
       max(CASE WHEN nth = process_count THEN out_time - create_time END) AS latency,
       max(process_count) AS process_count, min(out_time) AS first_out_time
FROM numbered GROUP BY job_type, msg_id""",
        "stream_fold_metrics": fold_sql,
        "stream_restarted_fold": fold_sql,
        "stream_delivery_stats": _DELIVERY_STATS,
        "stream_second_counts": f"WITH {_METRICS}, {_SECONDS} SELECT * FROM seconds",
        "stream_first_deliveries": _FIRST,
        "stream_first_within": _FIRST,
        "stream_enriched_messages": f"WITH {_TOPIC} SELECT {_ENRICHED}",
        "stream_snapshots": _snapshots_at(4, f"{_DEAL} <= cut") + " SELECT * EXCLUDE (snapshot_time) FROM snapshots",
        "stream_progress": f"""
WITH {_LOG}
SELECT {_DEAL} AS batch_id, count(*) AS input_rows, count(*) AS deliveries,
       CAST(sum(out_time - create_time) AS BIGINT) AS sum_latency, min(out_time - create_time) AS min_latency,
       max(out_time - create_time) AS max_latency
FROM deliveries GROUP BY ALL""",
        "stream_sketch_percentiles": _sketch_check("arrivals"),
    }
