"""Mixing sources to target sizes by pivotal, dependent rounding.

Every document is owed a fraction of copies (its source's target over its
source's size). Whole copies are certain; the fractions left are rounded by
pairs: a random transfer of mass, without bias, that keeps the sum of words and
makes one of the two integral. Each bucket of a source leaves at most one
fraction; those meet in a tree of further rounds until a source has one, which
is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oncemore.llm.common import WORD, stored

#: Rows that one task rounds together, and fractions that meet in a node of the tree.
BUCKET_ROWS, FAN_IN = 20_000, 1_000
#: A fraction this near to a whole number is one.
NEAR = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source``, ``source_size`` and ``target``: water-filling of ``share`` of all words by the weights.

    The weights repeat over the sources by code point, null last. A target
    stops at ``most`` times its source's size; the rest is shared by weight
    among the others until none is above. Sources are numbered by a range sort
    and its partitions' counts, and each round of sharing is one aggregate, so
    no task sees all of them.
    """
    spark = sources.sparkSession
    at = F.col("source").asc_nulls_last()
    ordered = stored(
        sources.repartitionByRange(at).sortWithinPartitions(at).withColumn("nr", F.monotonically_increasing_id()), "sources"
    )
    part = F.shiftright("nr", 33)
    counts = sorted(ordered.groupBy(part.alias("part")).count().collect())
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    offset = spark.createDataFrame(offsets, "part bigint, before bigint")
    place = F.col("nr").bitwiseAND((1 << 33) - 1) + F.col("before")
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), (place % len(weights) + 1).cast("int"))
    weighed = ordered.withColumn("part", part).join(offset, "part").select("source", "source_size", weight.alias("weight"))
    weighed = stored(weighed, "weights")
    cap = F.col("source_size") * most
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        now, capped, open_weight = weighed.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if now == full or not open_weight:
            break
        full, level = now, (total - capped) / open_weight
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap.cast("double")).alias("target"))


def pivot(size: np.ndarray, part: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Fractions ``part``, all but one at most moved to 0 or 1, with the sum of ``size * part`` kept."""
    part = part.copy()
    held = -1
    for k in range(len(part)):
        if not NEAR < part[k] < 1 - NEAR:
            continue
        if held < 0:
            held = k
            continue
        i, j = held, k
        up = min((1 - part[i]) * size[i], part[j] * size[j])
        down = min(part[i] * size[i], (1 - part[j]) * size[j])
        move = up if draws[k] * (up + down) < down else -down
        part[i] += move / size[i]
        part[j] -= move / size[j]
        for x in (i, j):
            if part[x] <= NEAR or part[x] >= 1 - NEAR:
                part[x] = round(part[x])
        held = i if NEAR < part[i] < 1 - NEAR else j if NEAR < part[j] < 1 - NEAR else -1
    return part


def _round(fractions: DataFrame, seed: int) -> DataFrame:
    """One level: the rows of each ``source`` and ``bucket``, with ``part`` rounded."""

    def of(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["key"].to_numpy(), -table["size"].to_numpy()))
        table = table.take(pa.array(order))
        key = table["key"].to_numpy().view(np.uint64)
        rng = np.random.default_rng([seed, int(key[0]) if len(key) else 0])
        part = pivot(table["size"].to_numpy().astype(float), table["part"].to_numpy(), rng.random(len(key)))
        return table.set_column(table.schema.get_field_index("part"), "part", pa.array(part))

    return fractions.groupBy("source", "bucket").applyInArrow(of, fractions.schema)


def mixture(
    docs: DataFrame,
    row: str | None = None,
    seed: int = 0,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    bucket_rows: int = BUCKET_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``row``, ``doc_id``, ``size``, ``source_size``, ``target`` and ``copies`` for every row of ``docs``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are not looked at.
    ``row`` names a column with a unique number, if there is one. A null or empty text has size 0 and gets no copies. Null is a source of its own. The
    draws depend on seed, doc_id, text and source alone, so that reruns agree on any
    cluster. The words taken differ from a source's target by less than one
    document, a small one. An empty table gives an empty table.
    """
    sizes = stored(
        docs.select(
            (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
            "doc_id",
            "source",
            n_words(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text", "source", F.lit(seed)).alias("key"),
        ),
        "sizes",
    )
    of_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "totals")
    goal = targets(of_source.select("source", "source_size"), weights, share, most)
    goal = stored(goal.join(of_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    owed = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(owed + NEAR)
    each = sizes.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    each = each.withColumns({
        "copies": F.when(F.col("size") > 0, whole).otherwise(0),
        "part": F.when(F.col("size") > 0, F.greatest(owed - whole, F.lit(0.0))).otherwise(0.0),
        "bucket": F.pmod("key", F.ceil(F.col("n") / bucket_rows)),
    })
    fraction = (F.col("part") > NEAR) & (F.col("part") < 1 - NEAR)
    left = stored(_round(each.where(fraction).select("source", "bucket", "row", "size", "key", "part"), seed), "level0")
    done = [left.where(~fraction)]
    level = 0
    # A source's buckets are below its rows over bucket_rows, so the levels grow with the logarithm of that.
    while (buckets := left.where(fraction).agg(F.max("bucket")).first()[0]) is not None and buckets > 0:
        level += 1
        up = left.where(fraction).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        left = stored(_round(up, seed + level), f"level{level}")
        done.append(left.where(~fraction))
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    done.append(left.where(fraction).withColumn("part", F.when(draw < F.col("part"), 1.0).otherwise(0.0)))
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.union(more)
    rounded = rounded.where("part >= 0.5").select("row", F.lit(1).alias("one"))
    return each.join(rounded, "row", "left").select(
        "row", "doc_id", "size", "source_size", "target", (F.col("copies") + F.coalesce("one", F.lit(0))).cast("int").alias("copies")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
