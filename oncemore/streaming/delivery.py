"""The streaming jobs: enrich messages, fold deliveries, count, take snapshots."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oncemore.functions.messages import enrich_or_flag
from oncemore.operators.fold import KEY, fold
from oncemore.plans.snapshots import last_id
from oncemore.plans.stats import delivery_stats, second_counts
from oncemore.schemas import COUNTS, METRICS
from oncemore.sinks.topics import to_topic
from oncemore.streaming.counts import add_counts, changes, snapshot_of_counts, write_changes
from oncemore.streaming.first import first_deliveries
from oncemore.streaming.state import (
    CHECKPOINT_EVERY,
    generation_of,
    keep_state_on_disk,
    latest_rows,
    newest,
    published,
    read_parts,
    start_table,
    trigger,
    write_batch,
)


def start_enrich_to_topic(
    messages: DataFrame,
    processor: str,
    servers: str,
    topic: str,
    checkpoint: str,
    every: str | None = CHECKPOINT_EVERY,
    quarantine_topic: str | None = None,
) -> StreamingQuery:
    """Enrich a message stream into a result topic, without keys. Malformed
    messages go to ``quarantine_topic``, or nowhere without one."""
    out = route(enrich_or_flag(messages, processor), topic, quarantine_topic)
    return to_topic(out, servers, None, checkpoint).trigger(**trigger(every)).start()


def route(flagged: DataFrame, topic: str, quarantine_topic: str | None = None) -> DataFrame:
    """The topic each message belongs on."""
    if quarantine_topic is None:
        return flagged.where(~F.col("malformed")).select("value", F.lit(topic).alias("topic"))
    target = F.when(F.col("malformed"), quarantine_topic).otherwise(topic)
    return flagged.select("value", target.alias("topic"))


def start_enrich_to_files(
    messages: DataFrame,
    processor: str,
    path: str,
    checkpoint: str,
    every: str | None = CHECKPOINT_EVERY,
    at: Column | None = None,
) -> StreamingQuery:
    """Enrich a message stream into files with one message per line, below
    ``malformed=false``; malformed messages are kept below ``malformed=true``."""
    return (
        enrich_or_flag(messages, processor, at)
        .select("value", "malformed")
        .writeStream.format("text")
        .partitionBy("malformed")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(every))
        .start(path)
    )


def start_fold(
    deliveries: DataFrame, path: str, checkpoint: str, every: str | None = CHECKPOINT_EVERY
) -> StreamingQuery:
    """Keep the metrics of a delivery stream up to date at ``path``."""
    return start_table(fold(deliveries).select(*METRICS.names), path, checkpoint, every, KEY)


def current_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics a fold stream has reached."""
    return latest_rows(spark, path, METRICS, KEY)


def start_delivery_stats(
    deliveries: DataFrame, path: str, checkpoint: str, every: str | None = CHECKPOINT_EVERY
) -> StreamingQuery:
    """Keep the running figures per job up to date at ``path``."""
    return start_table(delivery_stats(deliveries), path, checkpoint, every, ["job_type"])


def current_second_counts(spark: SparkSession, path: str) -> DataFrame:
    """Messages per job and second, from the metrics a fold stream has reached:
    a message counts in the second of its last delivery, however late that came."""
    return second_counts(current_metrics(spark, path))


def second_deliveries_stream(deliveries: DataFrame, lateness: str | None = None) -> DataFrame:
    """Deliveries (not messages; see ``start_second_counts``) per job and second.
    Nothing is dropped, and the state has a row per second. With ``lateness`` the state stays bounded instead: a second
    is forgotten once it is that old, and deliveries that come later are
    dropped; only then is there an append mode."""
    at = deliveries.withColumn("_at", F.timestamp_millis("out_time"))
    if lateness is not None:
        at = at.withWatermark("_at", lateness)
    return (
        at.groupBy("job_type", F.window("_at", "1 second").alias("_second"))
        .agg(F.count("*").alias("deliveries"))
        .select("job_type", F.unix_seconds("_second.start").alias("second"), "deliveries")
    )


def start_first_deliveries(
    deliveries: DataFrame, path: str, checkpoint: str, every: str | None = CHECKPOINT_EVERY
) -> StreamingQuery:
    """Keep the first delivery of every message at ``path``; read it with ``latest_rows``."""
    return start_table(first_deliveries(deliveries), path, checkpoint, every, KEY)


def deliveries_within(deliveries: DataFrame, horizon: str) -> DataFrame:
    """One delivery per message, for an append-only sink with bounded state (see
    ``first.start_first_within`` for the exact one): which of those in a micro-batch is left open, a message that comes again later than
    ``horizon`` counts as new, and a message whose first delivery is itself that
    late is dropped."""
    return (
        deliveries.withColumn("_at", F.timestamp_millis("out_time"))
        .withWatermark("_at", horizon)
        .dropDuplicatesWithinWatermark(list(KEY))
        .drop("_at")
    )


def start_snapshots(
    deliveries: DataFrame,
    metrics_path: str,
    snapshots_path: str,
    checkpoint: str,
    every: str | None = "60 seconds",
    note: str = "window",
    counts_path: str | None = None,
) -> StreamingQuery:
    """Fold a delivery stream and take a snapshot after every micro-batch.

    A snapshot is made from counts by value (``streaming.counts``), which are kept
    by differences at ``counts_path`` (beside the metrics by default). So a
    trigger reads its own deliveries, the rows that they change and the counts,
    and never the metrics of earlier batches.
    """
    spark = deliveries.sparkSession
    keep_state_on_disk(spark)
    counts_path = counts_path or f"{metrics_path.rstrip('/')}_counts"
    generation = generation_of(spark, metrics_path, checkpoint)

    def take(changed: DataFrame, batch_id: int) -> None:
        write_changes(changed, metrics_path, counts_path, batch_id, generation, lambda rows: newest(rows, METRICS, KEY))
        counts = add_counts(read_parts(spark, counts_path, COUNTS, generation, published(spark, counts_path, generation)))
        first = last_id(spark, snapshots_path, before=(generation, batch_id)) + 1
        rows = snapshot_of_counts(counts, f"{note} {batch_id + 1}", first_id=first)
        write_batch(rows.coalesce(1), snapshots_path, batch_id, generation, lambda old: old.drop("batch_id").coalesce(1))

    return (
        changes(deliveries)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(every))
        .foreachBatch(take)
        .start()
    )
