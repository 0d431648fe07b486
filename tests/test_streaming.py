import json

import pytest
from pyspark.sql import functions as F

from oncemore.functions import messages as msg
from oncemore.operators.fold import KEY, fold
from oncemore.plans import snapshots, stats
from oncemore.schemas import METRICS
from oncemore.sinks.tables import read_snapshots
from oncemore.sources import eventlog
from oncemore.sources.topics import read_message_files
from oncemore.streaming import delivery, state
from tests.helpers import DATA, DELIVERY, rows


@pytest.fixture(scope="module")
def log(spark):
    return eventlog.redelivered_log(spark.read.parquet(f"{DATA}/events.parquet"))


@pytest.fixture(scope="module")
def message_files(spark, log, tmp_path_factory):
    """The delivery log as files of result messages, split by time."""
    path = str(tmp_path_factory.mktemp("messages"))
    result = log.withColumn("process_time", F.col("out_time")).withColumn("value", F.to_json(F.struct(
        "msg_id", "create_time", "process_time", F.col("job_type").alias("job"))))
    result.select("out_time", "value").repartitionByRange(4, "out_time").select("value").write.mode("append").text(path)
    return path


def stream_of(spark, path):
    files = read_message_files(spark, path, max_files_per_trigger=1)
    job = F.get_json_object("value", "$.job")
    return msg.deliveries_of(files, job, out_time=F.get_json_object("value", "$.process_time").cast("long"))


def folded(df):
    return sorted(rows(df.select("job_type", "msg_id", "event_time", "out_time", "latency", "process_count")))


def test_stream_fold_equals_batch_fold(spark, log, message_files, tmp_path):
    table, checkpoint = str(tmp_path / "metrics"), str(tmp_path / "checkpoint")
    query = delivery.start_fold(stream_of(spark, message_files), table, checkpoint, every=None)
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) == 4
    want = folded(fold(log))
    assert folded(delivery.current_metrics(spark, table)) == want
    assert spark.conf.get(state.PROVIDER) == state.ROCKSDB

    # The same checkpoint again: nothing new.
    delivery.start_fold(stream_of(spark, message_files), table, checkpoint, every=None).awaitTermination()
    assert folded(delivery.current_metrics(spark, table)) == want

    # A batch written a second time, as after a failure.
    again = spark.read.parquet(f"{table}/generation=1/batch_id=2").collect()
    state.write_batch(spark.createDataFrame(again, spark.read.parquet(f"{table}/generation=1/batch_id=2").schema), table, 2)
    assert folded(delivery.current_metrics(spark, table)) == want


def test_compacted_table_goes_on(spark, log, message_files, tmp_path):
    table, compacted, checkpoint = (str(tmp_path / n) for n in ("metrics", "compacted", "checkpoint"))
    delivery.start_fold(stream_of(spark, message_files), table, checkpoint, every=None).awaitTermination()
    state.compact(spark, table, compacted, METRICS, KEY)
    want = folded(fold(log))
    assert folded(delivery.current_metrics(spark, compacted)) == want
    # The last batch again, and then one that changes a single message.
    state.write_batch(spark.read.parquet(f"{table}/generation=1/batch_id=3"), compacted, 3)
    assert folded(delivery.current_metrics(spark, compacted)) == want
    one = fold(log).limit(1).withColumn("process_count", F.lit(99).cast("long"))
    state.write_batch(one.select(*METRICS.names), compacted, 4)
    assert [r[5] for r in folded(delivery.current_metrics(spark, compacted)) if r not in want] == [99]


def test_restart_without_checkpoint_delivers_everything_again(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("".join(f'{{"msg_id":{i},"create_time":{i}}}\n' for i in range(30)))
    outs = [str(tmp_path / f"out{run}") for run in range(2)]
    for run, out in enumerate(outs):
        delivery.start_enrich_to_files(
            read_message_files(spark, str(source)), "spark", out, str(tmp_path / f"checkpoint{run}"), every=None
        ).awaitTermination()
    files = [f"{out}/malformed=false" for out in outs]
    collected = fold(msg.deliveries_of(read_message_files(spark, files, streaming=False), "a"))
    assert collected.count() == 30
    assert {r.process_count for r in collected.collect()} == {2}
    # With the first checkpoint there is nothing left to deliver.
    again = delivery.start_enrich_to_files(
        read_message_files(spark, str(source)), "spark", outs[0], str(tmp_path / "checkpoint0"), every=None
    )
    again.awaitTermination()
    assert sum(p["numInputRows"] for p in again.recentProgress) == 0


def test_running_figures(spark, log, message_files, tmp_path):
    table = str(tmp_path / "running")
    delivery.start_delivery_stats(
        stream_of(spark, message_files), table, str(tmp_path / "checkpoint"), every=None
    ).awaitTermination()
    want = stats.delivery_stats(log)
    assert sorted(rows(state.latest_rows(spark, table, want.schema, ["job_type"]))) == sorted(rows(want))


def test_second_counts_in_append_mode(spark, log, tmp_path):
    """A row far ahead in time closes all seconds before it."""
    ahead = log.limit(1).withColumn("out_time", F.lit(eventlog.START_MS + 10**9))
    files = str(tmp_path / "log")
    log.unionByName(ahead).coalesce(1).write.parquet(files)
    stream = spark.readStream.schema(log.schema).parquet(files)
    out = str(tmp_path / "seconds")
    (
        delivery.second_deliveries_stream(stream, lateness="10 seconds")
        .writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    want = stats.second_counts(log).select("job_type", "second", "messages")
    assert sorted(rows(spark.read.parquet(out))) == sorted(rows(want))


def out_of_order(spark, tmp_path, data, schema):
    """A stream of the rows, one per micro-batch, in the order given."""
    path = str(tmp_path / "rows")
    for row in data:
        spark.createDataFrame([row], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


LATE = [("a", 1, 0, 90_000, "x"), ("a", 2, 0, 5_000, "y"), ("a", 1, 0, 2_000, "first"), ("a", 1, 0, 300_000, "z")]
LATE_SCHEMA = DELIVERY + ", note string"


def test_first_deliveries_whatever_the_order(spark, tmp_path):
    stream = out_of_order(spark, tmp_path, LATE, LATE_SCHEMA)
    table = str(tmp_path / "first")
    delivery.start_first_deliveries(stream, table, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    got = state.latest_rows(spark, table, stream.schema, KEY)
    assert sorted(rows(got)) == [("a", 1, 0, 2_000, "first"), ("a", 2, 0, 5_000, "y")]


def test_late_deliveries_count(spark, tmp_path):
    """Deliveries far behind the newest, and a message that moves to a later second."""
    stream = out_of_order(spark, tmp_path, LATE, LATE_SCHEMA)
    table = str(tmp_path / "metrics")
    delivery.start_fold(stream, table, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    got = delivery.current_second_counts(spark, table).select("job_type", "second", "messages")
    assert sorted(rows(got)) == [("a", 5, 1), ("a", 300, 1)]

    counts = delivery.second_deliveries_stream(stream)
    seconds = str(tmp_path / "seconds")
    state.start_table(counts, seconds, str(tmp_path / "checkpoint2"), every=None).awaitTermination()
    got = state.latest_rows(spark, seconds, counts.schema, ["job_type", "second"])
    assert sorted(rows(got)) == [("a", 2, 1), ("a", 5, 1), ("a", 90, 1), ("a", 300, 1)]


def test_new_checkpoint_fills_a_new_generation(spark, log, message_files, tmp_path):
    table = str(tmp_path / "metrics")
    part = str(tmp_path / "part")
    log.where("msg_id % 2 = 0").write.parquet(part)
    delivery.start_fold(
        spark.readStream.schema(log.schema).parquet(part), table, str(tmp_path / "one"), every=None
    ).awaitTermination()
    delivery.start_fold(stream_of(spark, message_files), table, str(tmp_path / "two"), every=None).awaitTermination()
    assert folded(delivery.current_metrics(spark, table)) == folded(fold(log))
    assert state.newest_generation(spark, table) == 2
    # Each checkpoint keeps its own.
    assert state.generation_of(spark, table, str(tmp_path / "one")) == 1
    assert state.generation_of(spark, table, str(tmp_path / "two")) == 2


def test_bounded_state_is_a_choice(spark, tmp_path):
    stream = out_of_order(spark, tmp_path, LATE[:2], LATE_SCHEMA)
    out = str(tmp_path / "out")
    (
        delivery.deliveries_within(stream, "1 hour")
        .writeStream.option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    assert spark.read.parquet(out).count() == 2


def test_enrich_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"msg_id":1,"x":true}\n{"broken"\n{"msg_id":2}\n')
    out = str(tmp_path / "out")
    delivery.start_enrich_to_files(
        read_message_files(spark, str(source)), "spark", out, str(tmp_path / "checkpoint"), every=None
    ).awaitTermination()
    written = spark.read.text(out).collect()
    assert [r.value for r in written if r.malformed == "true"] == ['{"broken"']
    got = sorted((json.loads(r.value) for r in written if r.malformed == "false"), key=lambda m: m["msg_id"])
    assert [m["msg_id"] for m in got] == [1, 2]
    assert got[0]["x"] is True and all(m["processor"] == "spark" and m["process_time"] > 0 for m in got)


def test_snapshot_per_batch(spark, log, message_files, tmp_path):
    metrics, table = str(tmp_path / "metrics"), str(tmp_path / "snapshots")
    delivery.start_snapshots(
        stream_of(spark, message_files), metrics, table, str(tmp_path / "checkpoint"), every=None
    ).awaitTermination()
    taken = read_snapshots(spark, table)
    assert [r.id for r in taken.orderBy("id").collect()] == list(range(1, taken.count() + 1))
    assert {r.note for r in taken.collect()} == {f"window {n}" for n in range(1, 5)}
    final = taken.where("note = 'window 4'").drop("id", "snapshot_time", "note")
    want = snapshots.snapshot_rows(fold(log), "").drop("id", "snapshot_time", "note")
    assert sorted(rows(final)) == sorted(rows(want))
    # Numbering a batch again starts where it did before.
    assert snapshots.last_id(spark, table, before=(1, 2)) == taken.where("note in ('window 1', 'window 2')").count()


def test_shared_dir_follows_the_session(spark):
    one, two = state.shared_dir(spark, "x"), state.shared_dir(spark, "x")
    assert one != two
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or one.startswith(base)


def test_trigger():
    assert state.trigger() == {"processingTime": "5 seconds"}
    assert state.trigger(None) == {"availableNow": True}
