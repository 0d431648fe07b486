"""First deliveries without a state store: repeats are looked up among recent rows.

Every batch keeps, of each of its messages, the delivery that arrived first, and
drops those that the table already has in as early a form. It looks for them only
among rows within a horizon, which the order of the files narrows down to a few
row groups; so neither memory nor a batch's work grows with the table.

What comes again after the horizon is written a second time, as a row that
reading and merging outvote: of several rows of a message the one that arrived
first is the message's. So the horizon decides what a batch reads, and not what
is right.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from oncemore.functions.columns import arrival_order
from oncemore.operators.fold import KEY
from oncemore.streaming.state import (
    CHECKPOINT_EVERY,
    generation_of,
    newest_generation,
    published,
    read_parts,
    trigger,
    write_batch,
)


def first_deliveries(deliveries: DataFrame) -> DataFrame:
    """The first delivery of every message, with all its columns, in the order of
    arrival and whatever the order of the files. Works on streams, in update
    mode: a delivery that turns out to be earlier replaces the row. The state
    has a row per message; repeats combine before the shuffle."""
    order = arrival_order(deliveries)
    rest = [c for c in deliveries.columns if c not in KEY]
    first = deliveries.groupBy(*KEY).agg(*[F.min_by(c, order).alias(c) for c in rest])
    return first.select(*deliveries.columns)


def _in_order(rows: DataFrame) -> DataFrame:
    """By time, so that a look at the recent rows passes over the files and row groups of older ones."""
    return rows.repartitionByRange("out_time").sortWithinPartitions("out_time")


def fresh(batch: DataFrame, known: DataFrame, horizon_ms: int) -> DataFrame:
    """The first deliveries of ``batch`` that ``known`` has not, or has only later ones of, within the horizon."""
    firsts = first_deliveries(batch)
    since = firsts.agg(F.min("out_time")).first()[0]
    if since is None:
        return firsts
    recent = known.where(F.col("out_time") >= since - horizon_ms)
    keys = {k: f"_{k}" for k in KEY}
    known_order = recent.groupBy(*[F.col(k).alias(n) for k, n in keys.items()]).agg(F.min(arrival_order(recent)).alias("_known"))
    own = firsts.withColumn("_order", arrival_order(firsts))
    both = own.join(known_order, [F.col(k).eqNullSafe(F.col(n)) for k, n in keys.items()], "left")
    return both.where(F.col("_known").isNull() | (F.col("_order") < F.col("_known"))).select(*firsts.columns)


def start_first_within(
    deliveries: DataFrame, path: str, checkpoint: str, horizon_ms: int, every: str | None = CHECKPOINT_EVERY
) -> StreamingQuery:
    """Keep the first delivery of every message at ``path``; read it with ``current_firsts``."""
    spark = deliveries.sparkSession
    generation = generation_of(spark, path, checkpoint)
    schema = deliveries.schema

    def take(batch: DataFrame, batch_id: int) -> None:
        known = read_parts(spark, path, schema, generation, published(spark, path, generation, before=batch_id))
        rows = _in_order(fresh(batch, known.drop("batch_id"), horizon_ms))
        write_batch(rows, path, batch_id, generation, lambda old: _in_order(first_deliveries(old.drop("batch_id"))))

    return (
        deliveries.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger(every))
        .foreachBatch(take)
        .start()
    )


def current_firsts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The first delivery of every message, as of the last batch."""
    generation = max(newest_generation(spark, path), 1)
    parts = read_parts(spark, path, schema, generation, published(spark, path, generation))
    return first_deliveries(parts.drop("batch_id"))
