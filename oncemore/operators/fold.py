"""Fold deliveries to one row per message, counting redeliveries."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oncemore.functions.columns import arrival_order

KEY = ("job_type", "msg_id")


def fold(deliveries: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """One row per key: ``event_time`` of the first delivery, ``out_time`` and
    ``latency`` of the last, how many deliveries there were, and the ``out_time``
    of the first as ``first_out_time``.

    Every aggregate combines before the shuffle, so a message redelivered any
    number of times costs one row per task. Runs whose message ids restart are
    kept apart by adding a run column to ``by``. Works on streams too.
    """
    order = arrival_order(deliveries)
    return deliveries.groupBy(*by).agg(
        F.min_by("create_time", order).alias("event_time"),
        F.max("out_time").alias("out_time"),
        F.max_by(F.col("out_time") - F.col("create_time"), order).alias("latency"),
        F.count("*").alias("process_count"),
        F.min("out_time").alias("first_out_time"),
    )
