"""Synthetic source messages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_messages(
    spark: SparkSession, count: int, *, rate: int = 1000, start_ms: int, payload_chars: int = 1000
) -> DataFrame:
    """``count`` messages with dense ids from 1, ``rate`` of them per second."""
    return spark.range(1, count + 1).select(
        F.col("id").alias("msg_id"),
        F.expr(f"{start_ms}L + (id - 1) * 1000L div {rate}L").alias("create_time"),
        F.repeat(F.lit("x"), payload_chars).alias("payload"),
    )


def source_message_stream(spark: SparkSession, *, rate: int = 1000, payload_chars: int = 1000) -> DataFrame:
    """The same as an endless stream, timed by Spark's rate source."""
    return (
        spark.readStream.format("rate")
        .option("rowsPerSecond", rate)
        .load()
        .select(
            (F.col("value") + 1).alias("msg_id"),
            F.unix_millis("timestamp").alias("create_time"),
            F.repeat(F.lit("x"), payload_chars).alias("payload"),
        )
    )
