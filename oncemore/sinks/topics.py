"""Writing message streams to a topic."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

# Producer settings of the message topics.
PRODUCER_OPTIONS = {
    "kafka.acks": "1",
    "kafka.batch.size": "16384",
    "kafka.linger.ms": "10",
    "kafka.compression.type": "snappy",
}


def to_topic(
    messages: DataFrame, servers: str, topic: str | None, checkpoint: str, **producer: str
) -> DataStreamWriter:
    """A writer (not yet started) for the ``value`` and, if present, ``key`` of a
    message stream, to ``topic`` or to the topic each row names in its column
    ``topic``. At-least-once, as Spark's Kafka sink is."""
    columns = [c for c in ("key", "value", "topic") if c in messages.columns]
    options = PRODUCER_OPTIONS | {f"kafka.{k.replace('_', '.')}": v for k, v in producer.items()}
    writer = (
        messages.select(*columns)
        .writeStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "checkpointLocation": checkpoint})
        .options(**options)
    )
    return writer if topic is None else writer.option("topic", topic)
