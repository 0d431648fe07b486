"""The stored tables: metrics, of one run or of several, their sketches, and snapshots."""

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oncemore.schemas import METRICS, RUN_METRICS, SKETCHES, SNAPSHOTS
from oncemore.streaming.state import newest_generation, published, read_parts


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store folded metrics by ``job_type``, so that a job filter reads only its
    own files, and within a job by ``first_out_time``, so that a filter on time
    passes over the files and row groups of other times. The ranges over both
    split the few, uneven jobs into even files. Metrics without that column
    (of a source that has no first times) are in the order of ``out_time``."""
    order = ("job_type", "first_out_time" if "first_out_time" in metrics.columns else "out_time")
    (
        metrics.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "static")
        .partitionBy("job_type")
        .parquet(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path).select(*METRICS.names)


def reset_metrics(spark: SparkSession, path: str) -> None:
    """Empty the metrics table. Snapshots live elsewhere and stay."""
    write_metrics(spark.createDataFrame([], METRICS), path)


def write_runs(metrics: DataFrame, path: str) -> None:
    """Store metrics with a ``run_id``, by run and job. A run that is written again
    replaces what the table has of it (job by job), and leaves the other runs alone."""
    (
        metrics.select(*RUN_METRICS.names)
        .hint("rebalance", "run_id", "job_type")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "job_type")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of all runs. A filter on ``run_id`` reads the files of that run only."""
    return spark.read.schema(RUN_METRICS).parquet(path).select(*RUN_METRICS.names)


def reset_run(spark: SparkSession, path: str, run_id: str) -> bool:
    """Empty the metrics of one run, whatever jobs it has; false if there are none. The files of other runs are not touched."""
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in files.listStatus(table):
        if unquote(entry.getPath().getName()) == f"run_id={run_id}":
            return files.delete(entry.getPath(), True)
    return False


def write_sketches(sketches: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store latency sketches (``operators.sketches``) by job, in the order of the seconds."""
    rows = sketches.select(*SKETCHES.names).hint("rebalance", "job_type").sortWithinPartitions("job_type", "second")
    rows.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("job_type").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKETCHES).parquet(path).select(*SKETCHES.names)


def write_snapshots(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append the rows of one or more snapshots; a few rows, hence one file."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in SNAPSHOTS]).coalesce(1).write.mode(mode).parquet(path)


def read_snapshots(spark: SparkSession, path: str, before: tuple[int, int] | None = None) -> DataFrame:
    """The snapshots at ``path``, of a stream too. ``before``: of a stream's table
    only those of earlier generations and, in that one, of earlier batches."""
    last = newest_generation(spark, path) if before is None else before[0]
    if not last:
        return spark.read.schema(SNAPSHOTS).parquet(path).select(*SNAPSHOTS.names)
    rows = spark.createDataFrame([], SNAPSHOTS)
    for g in range(1, last + 1):
        parts = published(spark, path, g, before[1] if before and g == before[0] else None)
        if parts:
            rows = rows.union(read_parts(spark, path, SNAPSHOTS, g, parts).select(*SNAPSHOTS.names))
    return rows
