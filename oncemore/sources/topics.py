"""Message topics as streaming DataFrames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    *,
    group: str | None = None,
    starting: str = "earliest",
    max_per_trigger: int | None = None,
    min_partitions: int | None = None,
    streaming: bool = True,
) -> DataFrame:
    """Columns ``topic``, ``key``, ``value`` (text), ``partition``, ``offset``, ``timestamp``.

    Needs Spark's Kafka connector on the class path. ``max_per_trigger`` bounds
    a micro-batch (back-pressure); ``min_partitions`` splits large topic
    partitions over more tasks.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    )
    if group:
        reader = reader.option("kafka.group.id", group)
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    if min_partitions:
        reader = reader.option("minPartitions", min_partitions)
    return reader.load().select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "partition",
        "offset",
        "timestamp",
    )


def read_message_files(
    spark: SparkSession, path: str | list[str], *, max_files_per_trigger: int | None = None, streaming: bool = True
) -> DataFrame:
    """Files with one JSON message per line, as a column ``value``."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)
