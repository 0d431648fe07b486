"""Counts per job and value, kept by differences while a stream runs.

A message's row changes with every delivery: it moves to another second, to
another latency. A stream that counts rows by such values must take a changed row
back out of its old value. ``changes`` yields every changed row with what it was
before, and a batch of it becomes +1 at the new values and -1 at the old ones.
The differences of all batches add up to the counts of the current rows.

Four counts hold all that a snapshot reports: of latencies, of last and first
times, and of redeliveries. They have a row per distinct value, however many
messages there are, so a report reads neither the messages nor their history.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, StructField, StructType

from oncemore.functions.columns import second_of
from oncemore.operators.fold import KEY
from oncemore.plans.snapshots import snapshot_of_figures
from oncemore.plans.stats import full_stats
from oncemore.schemas import CHANGES, COUNTS, MEASURES, METRICS, SECOND_COUNTS
from oncemore.streaming.state import (
    CHECKPOINT_EVERY,
    generation_of,
    keep_state_on_disk,
    newest_generation,
    published,
    read_parts,
    trigger,
    write_batch,
)

#: Groups of messages of a job, by a hash of the id, that are folded together: one call of Python and one row of
#: state each. A batch writes anew the state of the groups that it meets. A checkpoint holds for one number of groups.
GROUPS = 256

# What is kept of a message: its figures, and the order of its first and last delivery. A group's messages are
# the rows of an array of these columns, in order of their ids.
_KEPT = ("msg_id", "event_time", "out_time", "latency", "process_count", "first_out_time")
_KEPT += ("first_partition", "first_tie", "last_partition", "last_tie")
_AT = {c: k for k, c in enumerate(_KEPT)}
_OF_FIRST = [_AT[c] for c in ("event_time", "first_out_time", "first_partition", "first_tie")]
_STATE = StructType([StructField("rows", BinaryType())])

_VALUES = ["msg_id", "create_time", "out_time", "_partition", "_tie"]


def _folded(rows: np.ndarray) -> np.ndarray:
    """One row (``_KEPT``) per message of several parts of its deliveries, each of them folded."""
    if not len(rows):
        return rows

    def ordered(*by: str) -> np.ndarray:
        return np.lexsort([rows[:, _AT[c]] for c in (*by, "msg_id")])

    up = ordered("first_tie", "first_partition", "first_out_time")
    ids = rows[up, 0]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    ends = np.concatenate((starts[1:], [len(ids)])) - 1
    out = rows[ordered("last_tie", "last_partition", "out_time")[ends]]
    out[:, _OF_FIRST] = rows[np.ix_(up[starts], _OF_FIRST)]
    n = _AT["process_count"]
    out[:, n] = np.add.reduceat(rows[up, n], starts)
    return out


def _fold_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The fold of a group's deliveries into its state, as of ``operators.fold``; a row for every message that has some."""
    new = np.zeros((0, len(_KEPT)), np.int64)
    for part in batches:
        if not len(part):
            continue
        msg, created, out, partition, tie = (part[c].to_numpy(np.int64) for c in _VALUES)
        one = np.ones_like(msg)
        rows = np.stack([msg, created, out, out - created, one, out, partition, tie, partition, tie], axis=1)
        new = _folded(np.concatenate((new, rows)))
    old = np.frombuffer(state.get[0], np.int64).reshape(-1, len(_KEPT)) if state.exists else new[:0]
    place = np.searchsorted(old[:, 0], new[:, 0])
    known = place < len(old)
    known[known] = old[place[known], 0] == new[known, 0]
    was = np.zeros_like(new)
    was[known] = old[place[known]]
    # Only rows of messages that came again are folded; all others stay as they are, and new ones go between them.
    now = new.copy()
    now[known] = _folded(np.concatenate((was[known], new[known])))
    every = old.copy()
    every[place[known]] = now[known]
    state.update((np.insert(every, place[~known], now[~known], axis=0).tobytes(),))
    columns = {"job_type": pd.Series([key[0]] * len(new), dtype=object)}
    for c in CHANGES.names[1:]:
        if c.startswith("was_"):
            columns[c] = pd.arrays.IntegerArray(was[:, _AT[c.removeprefix("was_")]].copy(), ~known)
        else:
            columns[c] = now[:, _AT[c]]
    yield pd.DataFrame(columns)


def changes(deliveries: DataFrame) -> DataFrame:
    """The fold of a delivery stream, with every changed row's former values.

    Columns: those of the metrics, and ``was_event_time``, ``was_out_time``,
    ``was_latency`` and ``was_process_count``, null for a new message. Update mode.
    A missing number counts as 0, as in messages. Messages are folded in ``GROUPS``.
    """
    position = {"partition", "offset"} <= set(deliveries.columns)
    tie = {
        "_partition": F.col("partition").cast("long") if position else F.lit(0).cast("long"),
        "_tie": F.col("offset") if position else F.col("create_time"),
    }
    rows = deliveries.select(*KEY, "create_time", "out_time", *[c.alias(n) for n, c in tie.items()]).fillna(0)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("msg_id"), F.lit(GROUPS)))
    return rows.groupBy("job_type", "_group").applyInPandasWithState(
        _fold_group, CHANGES, _STATE, "update", GroupStateTimeout.NoTimeout
    )


def count_changes(changed: DataFrame) -> DataFrame:
    """Differences per job, measure and value: +1 for what a row is now, -1 for what it was."""

    def of(prefix: str, n: int) -> list[Column]:
        one = F.lit(n).cast("long").alias("n")
        return [F.struct(F.lit(m).alias("measure"), F.col(prefix + m).alias("value"), one) for m in MEASURES]

    each = changed.select("job_type", F.inline(F.array(*of("", 1), *of("was_", -1)))).where("value IS NOT NULL")
    return add_counts(each)


def add_counts(counts: DataFrame) -> DataFrame:
    """Counts and differences added up; what cancels out is left out."""
    by = [c for c in counts.columns if c not in ("n", "batch_id")]
    return counts.groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")


def second_changes(changed: DataFrame) -> DataFrame:
    """Differences per job and second of the last delivery. A row that stays in its second makes none."""
    now, was = (F.struct(second_of(c).alias("second"), F.lit(n).cast("long").alias("n")) for c, n in (("out_time", 1), ("was_out_time", -1)))
    return add_counts(changed.select("job_type", F.inline(F.array(now, was))).where("second IS NOT NULL"))


def current_counts(spark: SparkSession, path: str, schema: StructType = COUNTS) -> DataFrame:
    """The counts that the differences at ``path`` add up to."""
    generation = max(newest_generation(spark, path), 1)
    return add_counts(read_parts(spark, path, schema, generation, published(spark, path, generation)))


def current_second_totals(spark: SparkSession, path: str) -> DataFrame:
    """Messages per job and second, as of the last batch of ``start_second_counts``."""
    return current_counts(spark, path, SECOND_COUNTS).withColumnRenamed("n", "messages")


def start_second_counts(
    deliveries: DataFrame, path: str, checkpoint: str, every: str | None = CHECKPOINT_EVERY
) -> StreamingQuery:
    """Keep the messages per job and second of a delivery stream, as differences under each batch's number.

    A message counts in the second of its last delivery, and moves when it is
    delivered again, however late; nothing is dropped. No table of messages is
    written or read.
    """
    spark = deliveries.sparkSession
    keep_state_on_disk(spark)
    generation = generation_of(spark, path, checkpoint)
    return (
        changes(deliveries)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(every))
        .foreachBatch(lambda rows, n: write_batch(second_changes(rows), path, n, generation, add_counts) and None)
        .start()
    )


def figures(counts: DataFrame) -> DataFrame:
    """All that a snapshot reports of each job, not rounded, from its counts (``current_counts``)."""
    value, n = F.col("value"), F.col("n")

    def of(measure: str, column: Column) -> Column:
        return F.when(F.col("measure") == measure, column)

    again = (F.col("measure") == "process_count") & (value > 1)
    others = counts.groupBy("job_type").agg(
        F.coalesce(F.sum(F.when(again, n)), F.lit(0)).alias("duplicates"),
        F.max(of("process_count", value)).alias("most"),
        F.sum(of("process_count", n * (value - 1))).alias("again"),
        F.min(of("event_time", value)).alias("first_event"),
        F.min(of("out_time", value)).alias("first_out"),
        F.max(of("out_time", value)).alias("last_out"),
    )
    none = F.max(F.lit(None).cast("long"))
    riders = dict.fromkeys([c for c in others.columns if c != "job_type"], none)
    latencies = counts.where("measure = 'latency'").select("job_type", value.alias("latency"), n.alias("messages"))
    stats = full_stats(latencies, extras=riders, weight="messages").drop(*riders)
    return stats.join(others, "job_type").withColumn("unique", F.col("total"))


def snapshot_of_counts(counts: DataFrame, note: str, snapshot_time: Column | None = None, first_id: int = 1) -> DataFrame:
    """The rows of one snapshot, numbered by job from ``first_id``."""
    return snapshot_of_figures(figures(counts), note, snapshot_time, first_id)


def write_changes(
    changed: DataFrame, metrics_path: str, counts_path: str, batch_id: int, generation: int, merge_metrics
) -> None:
    """Publish a batch's metrics, and the differences that they make."""
    spark = changed.sparkSession
    part = write_batch(changed, metrics_path, batch_id, generation, merge_metrics)
    # The rows as written: the stateful operator runs once a batch.
    written = read_parts(spark, metrics_path, CHANGES, generation, [part])
    write_batch(count_changes(written), counts_path, batch_id, generation, add_counts)
