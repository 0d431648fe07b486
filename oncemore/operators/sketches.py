"""Mergeable quantile sketches of the latency, one per job and second.

The exact percentiles need the values of a job counted together. A sketch needs
not: it has a bounded size, any two merge, and a report over any seconds, jobs or
runs merges stored sketches without touching the messages. Its percentiles are
off by some ranks; ``rank_errors`` measures by how many.
"""

from collections.abc import Iterable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oncemore.functions.columns import second_of
from oncemore.operators.percentiles import ranked_histogram

#: Size parameter of the sketches: some 8 kB times ``K`` / 400 when full, and smaller with few values.
K = 1000
#: Share of all ranks by which a percentile of sketches of this size is off, with a wide margin.
RANK_ERROR = 0.01
PCTS = (50, 95, 99)


def name_of(pct: int | float | str) -> str:
    return "p" + str(pct).replace(".", "_")


def latency_sketches(rows: DataFrame, by: Sequence[str] = ("job_type",), value: Column | None = None, k: int = K) -> DataFrame:
    """A row for each group and second of ``out_time``: ``messages``, the sum and extremes of the latency, and its ``sketch``.

    ``rows`` are metrics, or deliveries with their latency as ``value``. Works on
    streams in update mode. Rows without a latency count as messages only.
    """
    latency = F.col("latency") if value is None else value
    return rows.groupBy(*by, second_of("out_time").alias("second")).agg(
        F.count("*").alias("messages"),
        F.sum(latency).alias("sum_latency"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
        F.kll_sketch_agg_bigint(latency, F.lit(k)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("job_type",)) -> DataFrame:
    """One row per group of any coarser grouping, with the same columns but ``second``."""
    return sketches.groupBy(*by).agg(
        F.sum("messages").alias("messages"),
        F.sum("sum_latency").alias("sum_latency"),
        F.min("min_latency").alias("min_latency"),
        F.max("max_latency").alias("max_latency"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    )


def sketch_percentiles(
    sketches: DataFrame, by: Sequence[str] = ("job_type",), pcts: Iterable[int | float | str] = PCTS
) -> DataFrame:
    """The latency summary of each group, from its sketches: count, mean and extremes are exact, the percentiles near."""
    ranks = {name_of(p): float(Fraction(str(p)) / 100) for p in pcts}
    return merge_sketches(sketches, by).select(
        *by,
        F.col("messages").alias("total_messages"),
        F.round(F.try_divide("sum_latency", "messages"), 2).alias("avg_latency_ms"),
        F.col("min_latency").alias("min_latency_ms"),
        F.col("max_latency").alias("max_latency_ms"),
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(r)).alias(f"{n}_latency_ms") for n, r in ranks.items()],
    )


def rank_errors(
    near: DataFrame,
    rows: DataFrame,
    by: Sequence[str] = ("job_type",),
    value: str = "latency",
    pcts: Iterable[int | float | str] = PCTS,
) -> DataFrame:
    """How far the percentiles ``near`` (columns as of ``sketch_percentiles``) are from those of ``rows``.

    A row for each group and percentile: ``pct``, ``total_messages``, ``exact``
    (the value at rank ``floor(n * p)``, null for rank 0), ``near`` and
    ``rank_error``, the ranks between that rank and those of ``near``, as a share
    of all. The rows are counted by value once, whatever the percentiles.
    """
    shares = {name_of(p): Fraction(str(p)) / 100 for p in pcts}
    counted = ranked_histogram(rows, by, value)
    columns = [F.col(f"{n}_latency_ms").alias(f"_{n}") for n in shares]
    both = counted.join(near.select(*by, *columns), list(by))
    aggregates, results = [F.max("total").alias("total_messages")], []
    for (name, share), pct in zip(shares.items(), pcts, strict=True):
        rank = F.expr(f"(total * {share.numerator}L) div {share.denominator}L")
        aggregates += [
            F.first(f"_{name}").alias(f"_{name}"),
            F.coalesce(F.sum(F.when(F.col(value) < F.col(f"_{name}"), F.col("n"))), F.lit(0)).alias(f"_{name}_below"),
            F.coalesce(F.sum(F.when(F.col(value) <= F.col(f"_{name}"), F.col("n"))), F.lit(0)).alias(f"_{name}_upto"),
            F.min(F.when((rank > 0) & (F.col("upto") >= rank), F.col(value))).alias(f"_{name}_exact"),
        ]
        target = F.expr(f"(total_messages * {share.numerator}L) div {share.denominator}L")
        off = F.greatest(F.lit(0), F.col(f"_{name}_below") + 1 - target, target - F.col(f"_{name}_upto"))
        results.append(
            F.struct(
                F.lit(float(pct)).alias("pct"),
                "total_messages",
                F.col(f"_{name}_exact").alias("exact"),
                F.col(f"_{name}").alias("near"),
                (off / F.col("total_messages")).alias("rank_error"),
            )
        )
    return both.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*results)))
