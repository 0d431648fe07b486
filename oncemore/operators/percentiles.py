"""Exact nearest-rank percentiles without sorting the rows."""

from collections.abc import Iterable, Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values in a bucket, buckets in a bucket of buckets, and so on; three levels of
# buckets leave at most 20,000 of the largest for 64-bit values.
FAN = 100_000
LEVELS = 3


def ranked_histogram(
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    extras: Mapping[str, Column] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group and distinct value, with its cumulative count.

    Columns: ``by``, ``value``, ``n`` (rows with this value), the ``extras``
    aggregates over them, ``upto`` (rows of the group with this value or a
    smaller one), ``total`` (rows of the group) and ``mean`` (of the group).
    ``weight`` names a count column when the rows are already counted. Missing
    values rank first, as in an ascending sort, and do not enter the mean.

    A group may hold a third of all rows, and its values may lie anywhere, so no
    task sees a whole group. Rows are first counted by value. The counts are
    added up in a tree of buckets; running counts are taken among the children
    of a bucket, at most some 200,000, and handed down level by level.
    """
    by = list(by)
    keys = [f"_b{k}" for k in range(LEVELS, 0, -1)] + [value]
    count = F.count("*") if weight is None else F.sum(weight)
    riders = dict(extras or {})
    number = F.col(value).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    counted = rows.groupBy(*by, value).agg(count.alias("n"), *[c.alias(name) for name, c in riders.items()])
    counted = counted.withColumns(
        {f"_b{k}": F.expr(f"{value} div {FAN**k}L") for k in range(1, LEVELS + 1)}
        | {"_sum": number, "_valued": F.when(F.col(value).isNotNull(), F.col("n"))}
    )
    # Level 0 are the values, level LEVELS the largest buckets.
    level = sum((F.grouping(k).cast("int") for k in keys[2:]), F.grouping(keys[1]).cast("int"))
    sets = [[*by, *keys[: k + 1]] for k in range(LEVELS + 1)]
    tree = counted.groupingSets(sets, *by, *keys).agg(
        level.alias("_level"),
        F.sum("n").alias("n"),
        F.sum("_sum").alias("_sum"),
        F.sum("_valued").alias("_valued"),
        *[F.max(name).alias(name) for name in riders],
    )

    # The children of one bucket.
    parent = [F.when(F.col("_level") < LEVELS - j, F.col(k)) for j, k in enumerate(keys[:-1])]
    family = Window.partitionBy(*by, "_level", *parent)
    running = family.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tree = tree.withColumns({
        "_before": F.sum("n").over(running) - F.col("n"),
        "total": F.sum("n").over(family),
        "mean": F.try_divide(F.sum("_sum").over(family).cast("double"), F.sum("_valued").over(family)),
    })
    for upper in range(LEVELS, 0, -1):
        # A bucket together with its children; all other rows stay by themselves.
        own = F.col("_level").isin(upper, upper - 1)
        held = [F.col(k) if j <= LEVELS - upper else F.when(~own, F.col(k)) for j, k in enumerate(keys)]
        bucket = Window.partitionBy(*by, F.when(~own, F.col("_level")), *held)
        child = F.col("_level") == upper - 1

        def from_bucket(c: str, upper: int = upper, bucket=bucket) -> Column:
            return F.max(F.when(F.col("_level") == upper, F.col(c))).over(bucket)

        tree = tree.withColumns({
            "_before": F.when(child, F.col("_before") + from_bucket("_before")).otherwise(F.col("_before")),
            "total": F.when(child, from_bucket("total")).otherwise(F.col("total")),
            "mean": F.when(child, from_bucket("mean")).otherwise(F.col("mean")),
        })
    return (
        tree.where(F.col("_level") == 0)
        .withColumn("upto", F.col("_before") + F.col("n"))
        .select(*by, value, "n", *riders, "upto", "total", "mean")
    )


def percentile(pct: int | float | str, value: str) -> Column:
    """Aggregate over a ranked histogram: the value at the percentile's rank,
    null when that rank is 0."""
    share = Fraction(str(pct)) / 100
    rank = F.expr(f"(total * {share.numerator}L) div {share.denominator}L")
    return F.min(F.when((rank > 0) & (F.col("upto") >= rank), F.col(value)))


def mean() -> Column:
    """Aggregate over a ranked histogram: the group's mean."""
    return F.max("mean")


def stddev_pop(value: str) -> Column:
    """Aggregate over a ranked histogram: population standard deviation."""
    off = F.col(value) - F.col("mean")
    valued = F.sum(F.when(F.col(value).isNotNull(), F.col("n")))
    return F.sqrt(F.try_divide(F.sum(F.col("n") * off * off), valued))


def nearest_rank_percentiles(
    rows: DataFrame, by: Sequence[str], value: str, pcts: Iterable[int | float | str] = (50, 95, 99)
) -> DataFrame:
    """Percentiles of ``value`` per group: the row at rank ``floor(n * p)``.

    Column names are ``p50`` and the like, with a point written as ``_``.
    """
    ranked = ranked_histogram(rows, by, value)
    return ranked.groupBy(*by).agg(
        *[percentile(p, value).alias("p" + str(p).replace(".", "_")) for p in pcts]
    )
