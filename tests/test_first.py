"""First deliveries by lookups within a horizon."""

import random

from oncemore.schemas import METRICS
from oncemore.sinks.tables import read_metrics, write_metrics
from oncemore.streaming import first, state
from tests.helpers import POSITION, rows


def stream_of(spark, tmp_path, data):
    path = str(tmp_path / "log")
    for one in data:
        spark.createDataFrame(one, POSITION).coalesce(1).write.mode("append").parquet(path)
    schema = spark.createDataFrame([], POSITION).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_exact_whatever_the_order_and_the_horizon(spark, tmp_path, monkeypatch):
    """Ties of time, deliveries that turn out to be earlier, repeats within the horizon and long after it."""
    monkeypatch.setattr(state, "FAN", 3)
    rng = random.Random(3)
    data = []
    for k in range(5):
        now = 100_000 * k
        times = [now, now + 500, now - 90_000, now - 400_000]
        data.append([("a", rng.randint(1, 60), 0, rng.choice(times), 0, 1000 * k + i) for i in range(40)])
    data[3].append((None, None, 5, 7, 0, 9_999))
    table = str(tmp_path / "first")
    stream = stream_of(spark, tmp_path, data)
    first.start_first_within(stream, table, str(tmp_path / "checkpoint"), 50_000, every=None).awaitTermination()
    want = {}
    for r in sorted((r for one in data for r in one), key=lambda r: (r[3], r[4], r[5]), reverse=True):
        want[r[:2]] = r
    assert sorted(rows(first.current_firsts(spark, table, stream.schema)), key=repr) == sorted(want.values(), key=repr)


def test_repeats_are_not_written_again(spark, tmp_path):
    data = [[("a", i, 0, 1_000 + i, 0, i) for i in range(50)], [("a", i, 0, 9_000 + i, 0, 100 + i) for i in range(51)], []]
    table = str(tmp_path / "first")
    stream = stream_of(spark, tmp_path, data[:2])
    first.start_first_within(stream, table, str(tmp_path / "checkpoint"), 60_000, every=None).awaitTermination()
    parts = state.published(spark, table, 1)
    written = [state.read_parts(spark, table, stream.schema, 1, [p]).count() for p in parts]
    assert written == [50, 1]


def rows_read(df):
    """Rows that the scan yields, before any filter."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_a_time_filter_passes_over_stored_metrics(spark, tmp_path):
    """One job holds nearly all messages; a second of them is read out of a few thousand."""
    path = str(tmp_path)
    metrics = spark.range(200_000).selectExpr(
        "if(id % 50 = 0, 'b', 'a') job_type", "id msg_id", "(id * 7919) % 4000000 event_time", "(id * 7919) % 4000000 + 9 out_time",
        "9L latency", "1L process_count", "(id * 7919) % 4000000 first_out_time",
    ).select(*METRICS.names)
    write_metrics(metrics, path)
    stored = read_metrics(spark, path)
    assert rows_read(stored.select("msg_id")) == 200_000
    window = stored.where("first_out_time > 2000000 AND first_out_time <= 2001000").select("first_out_time")
    assert rows_read(window) < 60_000
    one = stored.where("job_type = 'b' AND first_out_time > 2000000 AND first_out_time <= 2001000")
    assert rows_read(one.select("first_out_time")) <= 4_000
    assert window.count() == metrics.where("first_out_time > 2000000 AND first_out_time <= 2001000").count()
