"""Keeping the result of a stateful stream in a table that survives replays.

Every micro-batch writes the full new rows of the keys it changed, as a part
under its own batch number. Nothing is ever incremented in place, so repeating a
batch changes nothing.

A part counts once a manifest names it. A batch writes its part into a folder of
its own attempt, and then one small file, the batch's manifest, which lists all
parts of the table as of that batch. The file appears whole or not at all, so a
reader meets the table before a batch or after it, and what a failed attempt
left behind is in no manifest. A repeated batch starts from the manifest before
its own.

When there are ``FAN`` parts of a level, the batch that completes them merges
them to one of the next level. So a table has few parts after any number of
batches, and a row is rewritten once per level, while the stream runs. Parts that
were merged are deleted ``KEEP`` batches later, when nobody reads them any more.

Batch numbers start again with a new checkpoint. So the batches of a checkpoint
stand below a generation, numbered on its first start and noted beside it; the
newest generation is the table.
"""

import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

CHECKPOINT_EVERY = "5 seconds"

# Batch number of rows copied by `compact`.
COMPACTED = -1

GENERATION = "generation"

# Parts of one level that are merged, and batches for which a merged part stays readable.
FAN, KEEP = 8, 10

# Folder of the manifests; readers of files pass over its name.
MANIFESTS = "_manifests"

Merge = Callable[[DataFrame], DataFrame]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` below ``spark.checkpoint.dir``, or, where that is
    unset, below the warehouse, which all executors share as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Use the RocksDB state store, unless the session sets another provider:
    the state has a row per message and outgrows the heap. A checkpoint then
    holds the changes of a batch, not the whole state again."""
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    if spark.conf.get(PROVIDER, default) == default:
        spark.conf.set(PROVIDER, ROCKSDB)
    if spark.conf.get(CHANGELOG, None) is None:
        spark.conf.set(CHANGELOG, "true")


def trigger(every: str | None = CHECKPOINT_EVERY) -> dict:
    """A micro-batch ``every`` so often, or, for None, until the input is used up."""
    return {"processingTime": every} if every else {"availableNow": True}


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies below ``path``; none if there is no such folder."""
    _, folder, files = _hadoop(spark, path)
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def _numbers(names: list[str], key: str) -> list[int]:
    return sorted(int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}="))


def newest_generation(spark: SparkSession, path: str) -> int:
    """Number of the table's newest generation, 0 when there is none."""
    return max(_numbers(_folders(spark, path), GENERATION), default=0)


def generation_of(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The generation of the table at ``path`` that ``checkpoint`` writes: a new
    one on the checkpoint's first start, the same ever after."""
    note = f"{checkpoint.rstrip('/')}/table"
    known = _numbers(_folders(spark, note), GENERATION)
    if known:
        return known[-1]
    number = newest_generation(spark, path) + 1
    # An empty folder is the note; it is made before the first batch.
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{note}/{GENERATION}={number}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return number


class Part(NamedTuple):
    """Rows of one batch, or of the batches up to it where ``level`` is above 0."""

    batch: int
    level: int
    attempt: str

    def folder(self) -> str:
        return f"batch_id={self.batch}/attempt={self.attempt}"


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _table(path: str, generation: int) -> str:
    return f"{path.rstrip('/')}/{GENERATION}={generation}"


def _manifest_name(batch_id: int) -> str:
    return f"{batch_id + 1:012d}"


def _manifests(spark: SparkSession, table: str) -> list[str]:
    """Names of the manifests, in the order of their batches."""
    return sorted(n for n in _folders(spark, f"{table}/{MANIFESTS}") if n.isdigit())


def _read_manifest(spark: SparkSession, table: str, name: str) -> dict[str, list[Part]]:
    jvm, file, files = _hadoop(spark, f"{table}/{MANIFESTS}/{name}")
    stream = files.open(file)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {k: [Part(*p) for p in v] for k, v in json.loads(text).items()}


def _publish(spark: SparkSession, table: str, batch_id: int, parts: list[Part], dropped: list[Part]) -> None:
    """Let the manifest of a batch appear, in one step, in place of that of an earlier attempt."""
    folder = f"{table}/{MANIFESTS}"
    jvm, draft, files = _hadoop(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(bytearray(json.dumps({"parts": parts, "dropped": dropped}).encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    draft = files.makeQualified(draft)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), files.getConf())
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(draft.getParent(), _manifest_name(batch_id)), options)


def _forget(spark: SparkSession, table: str) -> None:
    """Delete the manifests of older batches, and the parts that they were the first to do without."""
    for name in _manifests(spark, table)[:-KEEP]:
        for part in _read_manifest(spark, table, name).get("dropped", []):
            _, folder, files = _hadoop(spark, f"{table}/{part.folder()}")
            files.delete(folder, True)
        _, file, files = _hadoop(spark, f"{table}/{MANIFESTS}/{name}")
        files.delete(file, False)


def published(spark: SparkSession, path: str, generation: int, before: int | None = None) -> list[Part]:
    """The parts of the table as of its newest batch, or the newest one ``before`` a batch."""
    table = _table(path, generation)
    names = _manifests(spark, table)
    if before is not None:
        names = [n for n in names if n < _manifest_name(before)]
    return _read_manifest(spark, table, names[-1])["parts"] if names else []


def read_parts(spark: SparkSession, path: str, schema: StructType, generation: int, parts: Sequence[Part]) -> DataFrame:
    """The rows of the parts, with the number of the batch that each is as of in ``batch_id``."""
    if not parts:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0))
    table = _table(path, generation)
    reader = spark.read.schema(schema).option("basePath", table)
    return reader.parquet(*[f"{table}/{p.folder()}" for p in parts]).drop("attempt")


def write_batch(rows: DataFrame, path: str, batch_id: int, generation: int = 1, merge: Merge | None = None) -> Part:
    """Write a batch as a part of the table and publish it. With ``merge`` (from the
    rows of several parts, with ``batch_id``, to those of one) full levels are merged first."""
    spark = rows.sparkSession
    table = _table(path, generation)

    def write(part_rows: DataFrame, level: int) -> Part:
        part = Part(batch_id, level, "a" + uuid.uuid4().hex)
        part_rows.write.parquet(f"{table}/{part.folder()}")
        return part

    # What earlier attempts of this batch left, published or not. A later batch may build on it.
    last = all(n <= _manifest_name(batch_id) for n in _manifests(spark, table))
    left = _folders(spark, f"{table}/batch_id={batch_id}") if last else []
    dropped = [Part(batch_id, 0, n.removeprefix("attempt=")) for n in left]
    own = write(rows, 0)
    parts = [*published(spark, path, generation, before=batch_id), own]
    while merge and len(parts) >= FAN and len({p.level for p in parts[-FAN:]}) == 1:
        full, parts = parts[-FAN:], parts[:-FAN]
        schema = spark.read.parquet(f"{table}/{full[-1].folder()}").schema
        parts.append(write(merge(read_parts(spark, path, schema, generation, full)), full[0].level + 1))
        dropped += full
    _publish(spark, table, batch_id, parts, dropped)
    _forget(spark, table)
    return own


def start_table(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = CHECKPOINT_EVERY,
    keys: Sequence[str] | None = None,
) -> StreamingQuery:
    """Keep the rows of an updating stream in the table at ``path``. With a new
    checkpoint the stream fills a new generation of the table, from all input it is
    given. With ``keys`` (those of the rows) older batches are merged on the way."""
    spark = changes.sparkSession
    keep_state_on_disk(spark)
    generation = generation_of(spark, path, checkpoint)
    schema = changes.schema
    merge = (lambda rows: newest(rows, schema, keys)) if keys else None
    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger(every))
        .foreachBatch(lambda rows, batch_id: write_batch(rows, path, batch_id, generation, merge) and None)
        .start()
    )


def compact(spark: SparkSession, path: str, new_path: str, schema: StructType, keys: Sequence[str]) -> None:
    """Copy the current rows to ``new_path``, as one part. To go on there, stop the
    stream first and start it again with the same checkpoint. A batch repeated on
    that start still counts once, because the copy ranks below every batch."""
    current = latest_rows(spark, path, schema, keys)
    write_batch(current.hint("rebalance"), new_path, COMPACTED, max(newest_generation(spark, path), 1))


def newest(rows: DataFrame, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """Of the rows of each key, the one of the last batch."""
    values = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values]).select(*schema.names)


def latest_rows(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The current row of every key: the one of its last batch in the newest generation."""
    generation = max(newest_generation(spark, path), 1)
    return newest(read_parts(spark, path, schema, generation, published(spark, path, generation)), schema, keys)
