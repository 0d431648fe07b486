"""Delivery logs made from an events table (event_id, ts, user_id, event_type, value).

Both fixtures keep every event. Times are compressed a thousandfold from
``START_MS`` so that many messages share a second.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START_MS = 1704067200000


def _compressed(ts: str) -> Column:
    return F.lit(START_MS) + F.expr(f"(unix_millis(cast({ts} as timestamp)) - {START_MS}L) div 1000L")


def redelivered_log(events: DataFrame) -> DataFrame:
    """Every event as a message of its event type, with redeliveries on top.

    Each event is delivered once. In addition every 20th message comes again
    after 5 s and every 100th once more after 10 s.
    """
    delays = (
        F.when(F.col("event_id") % 100 == 0, F.array(F.lit(0), F.lit(5000), F.lit(10000)))
        .when(F.col("event_id") % 20 == 0, F.array(F.lit(0), F.lit(5000)))
        .otherwise(F.array(F.lit(0)))
    )
    first = events.select(
        F.col("event_type").alias("job_type"),
        F.col("event_id").alias("msg_id"),
        _compressed("ts").alias("out_time"),
        F.round(F.col("value") * 100).cast("bigint").alias("took"),
        delays.alias("delays"),
    )
    return first.select(
        "job_type",
        "msg_id",
        (F.col("out_time") - F.col("took")).alias("create_time"),
        "out_time",
        F.explode("delays").alias("delay"),
    ).select("job_type", "msg_id", "create_time", (F.col("out_time") + F.col("delay")).alias("out_time"))


def user_log(events: DataFrame) -> DataFrame:
    """Every event as a delivery of its user's one message per event type.

    Redelivery counts follow the activity of the users, and the event id is the
    topic offset. Times are whole seconds, so deliveries may tie.
    """
    out_time = F.expr(f"{START_MS}L + (unix_millis(cast(ts as timestamp)) - {START_MS}L) div 1000000L * 1000L")
    return events.select(
        F.col("event_type").alias("job_type"),
        F.col("user_id").alias("msg_id"),
        (out_time - F.round(F.col("value") * 100).cast("bigint")).alias("create_time"),
        out_time.alias("out_time"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
    )


def message_topic(events: DataFrame) -> DataFrame:
    """Every event as a JSON message on a topic: ``job_type``, ``value``,
    ``partition``, ``offset`` and ``out_time``.

    The message carries the event's ``props`` as a nested field. As on a real
    topic some messages are damaged: below a value of 1 the text is cut short,
    above 290 the id is in quotes, and above 300 it is missing.
    """
    create_time = F.col("out_time") - F.round(F.col("value") * 100).cast("bigint")
    msg_id = F.col("event_id").cast("string")
    id_field = (
        F.when(F.col("value") > 300, F.lit(""))
        .when(F.col("value") > 290, F.concat(F.lit('"msg_id":"'), msg_id, F.lit('",')))
        .otherwise(F.concat(F.lit('"msg_id":'), msg_id, F.lit(",")))
    )
    text = F.concat(
        F.lit("{"), id_field, F.lit('"create_time":'), create_time.cast("string"),
        F.lit(',"payload":"x","props":'), F.col("props"), F.lit("}"),
    )
    cut = F.when(F.col("value") < 1, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return events.withColumn("out_time", _compressed("ts")).select(
        F.col("event_type").alias("job_type"),
        cut.alias("value"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        "out_time",
    )


def fault_lines(events: DataFrame) -> DataFrame:
    """Every event as a line of a fault log."""
    time = F.date_format(F.timestamp_millis(_compressed("ts")), "yyyy-MM-dd HH:mm:ss")
    node = F.concat(F.lit("node"), F.col("user_id").cast("string"))
    pid = F.col("event_id").cast("string")
    job = F.concat(F.lit("job-"), pid)
    line = (
        F.when(F.col("event_type") == "click", F.concat_ws(",", time, F.lit("kill-worker"), node, pid))
        .when(F.col("event_type") == "view", F.concat_ws(",", time, F.lit("kill-tm"), node, pid))
        .when(F.col("event_type") == "error", F.concat_ws(",", time, F.lit("kill-jm"), pid))
        .when(F.col("event_type") == "signup", F.concat_ws(",", time, F.lit("checkpoint"), job))
        .otherwise(F.concat_ws(",", time, F.lit("network-tm"), node))
    )
    return events.select(line.alias("value"))
