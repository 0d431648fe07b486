import json

import pytest
from pyspark.sql import functions as F

from oncemore.plans import stats
from oncemore.sources import eventlog
from oncemore.streaming import delivery
from oncemore.streaming.progress import ProgressLog, observed, progress_totals, read_progress
from tests.helpers import DATA, rows


@pytest.fixture(scope="module")
def log(spark):
    return eventlog.redelivered_log(spark.read.parquet(f"{DATA}/events.parquet"))


def test_batches_sum_up_to_the_deliveries(spark, log, tmp_path):
    files, kept = str(tmp_path / "log"), str(tmp_path / "progress")
    log.repartition(3).write.parquet(files)

    def run():
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(files)
        query = delivery.start_delivery_stats(observed(stream), str(tmp_path / "t"), str(tmp_path / "checkpoint"), every=None)
        query.awaitTermination()
        return query

    with ProgressLog(spark, kept) as listener:
        assert listener.wait(run())
        batches = read_progress(spark, kept)
        assert sorted(r.batch_id for r in batches.collect()) == [0, 1, 2]
        assert batches.where("deliveries = input_rows").count() == 3
        want = log.withColumn("job_type", F.lit("all"))
        want = stats.delivery_stats(want).drop("job_type")
        total = progress_totals(batches)
        assert rows(total.select("deliveries", "avg_latency_ms", "min_latency_ms", "max_latency_ms")) == rows(want)

        # Started again without anything new, and then with one more file: only that adds a batch.
        assert listener.wait(run())
        assert read_progress(spark, kept).count() == 3
        log.limit(5).coalesce(1).write.mode("append").parquet(files)
        assert listener.wait(run())
    batches = read_progress(spark, kept)
    assert batches.count() == 4 and batches.where("batch_id = 3").first()["deliveries"] == 5
    # Nothing is kept of streams outside.
    log.limit(1).coalesce(1).write.mode("append").parquet(files)
    run()
    assert read_progress(spark, kept).count() == 4


def test_a_repeated_batch_counts_once(spark, tmp_path):
    kept = ProgressLog(spark, str(tmp_path))
    for deliveries in (7, 9):
        line = {"query": "q", "batch_id": 3, "deliveries": deliveries, "sum_latency": 18, "min_latency": 1, "max_latency": 5, "duration_ms": 2}
        kept._keep("q-000000000003.json", json.dumps(line))
    assert rows(progress_totals(read_progress(spark, str(tmp_path)))) == [("q", 1, 9, 2.0, 1, 5, 2)]
