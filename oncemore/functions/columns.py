"""Column helpers shared by the statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds that let (partition, offset) share one 64-bit position.
PARTITION_BITS = 20
OFFSET_BITS = 43


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part`` as a percentage of ``whole``; null when ``whole`` is 0."""
    return F.round(F.try_divide(part, whole) * 100, digits)


def per_second(count: Column, span_ms: Column) -> Column:
    """Messages per second over a span of milliseconds; null for an empty span."""
    return F.round(F.try_divide(count.cast("double"), span_ms / F.lit(1000.0)), 2)


def second_of(millis: str) -> Column:
    """Whole epoch second of an epoch-millisecond column, rounded down."""
    return F.expr(f"({millis} - pmod({millis}, 1000L)) div 1000L")


def arrival_order(deliveries: DataFrame) -> Column:
    """A key that sorts the deliveries of one message by arrival.

    Arrival order is ``out_time``, then topic position when the log has one,
    else ``create_time``, so that it never depends on task order. The parts are
    packed in one decimal because decimals, unlike structs, are updated in place
    by the hash aggregate: ``min_by`` on a struct would sort all rows instead.
    """
    out_time = F.col("out_time").cast("decimal(18,0)")
    if {"partition", "offset"} <= set(deliveries.columns):
        fits = (F.col("partition") < 2**PARTITION_BITS) & (F.col("offset") < 2**OFFSET_BITS)
        position = F.shiftleft(F.col("partition").cast("long"), OFFSET_BITS) + F.col("offset")
        tie = F.when(fits, position).otherwise(
            F.raise_error(F.lit("topic position out of range")).cast("long")
        )
    else:
        tie = F.col("create_time")
    # 10^20 exceeds the distance between any two 64-bit ties.
    return out_time * F.expr("100000000000000000000BD") + tie.cast("decimal(19,0)")
