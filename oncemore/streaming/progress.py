"""The progress of streams as a table.

``observed`` adds the collector's running figures to a stream, counted on the way
and without a shuffle. A ``ProgressLog`` listens to the session's streams and
keeps what every micro-batch reports, one small file per batch under the batch's
number, so a repeated batch counts once.
"""

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from oncemore.schemas import PROGRESS

OBSERVED = "deliveries"


def observed(deliveries: DataFrame) -> DataFrame:
    """The same deliveries, whose number and latency every micro-batch reports."""
    latency = F.col("out_time") - F.col("create_time")
    return deliveries.observe(
        OBSERVED,
        F.count(F.lit(1)).alias("deliveries"),
        F.sum(latency).alias("sum_latency"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
    )


class ProgressLog(StreamingQueryListener):
    """Keeps the progress of all streams of a session at ``path``.

    Use it as a context: it listens within. ``wait`` returns once all batches of
    an ended stream are kept; reports arrive after the batches they are about.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self.spark, self.path = spark, path.rstrip("/")
        self._ended: dict[str, threading.Event] = {}

    def __enter__(self) -> "ProgressLog":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        return self._event(str(query.runId)).wait(seconds)

    def _event(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._event(str(event.runId)).set()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        figures = progress.observedMetrics.get(OBSERVED)
        if figures is None:
            # A trigger without a batch.
            return
        row = {
            "query": progress.name or str(progress.id),
            "batch_id": progress.batchId,
            "at": progress.timestamp,
            "input_rows": progress.numInputRows,
            "duration_ms": progress.batchDuration,
            **figures.asDict(),
        }
        self._keep(f"{progress.id}-{progress.batchId:012d}.json", json.dumps(row) + "\n")

    def _keep(self, name: str, line: str) -> None:
        file = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = file.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        stream = files.create(file, True)
        stream.write(bytearray(line.encode()))
        stream.close()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A row per query and micro-batch."""
    return spark.read.schema(PROGRESS).json(path)


def progress_totals(progress: DataFrame) -> DataFrame:
    """The running figures of each query as of its last batch: those of a collector since its start."""
    return progress.groupBy("query").agg(
        F.count("*").alias("batches"),
        F.sum("deliveries").alias("deliveries"),
        F.round(F.try_divide(F.sum("sum_latency"), F.sum("deliveries")), 2).alias("avg_latency_ms"),
        F.min("min_latency").alias("min_latency_ms"),
        F.max("max_latency").alias("max_latency_ms"),
        F.sum("duration_ms").alias("duration_ms"),
    )
