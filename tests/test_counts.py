"""Counts kept by differences, and the snapshots made from them, after every batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oncemore.operators.fold import fold
from oncemore.plans import snapshots, stats
from oncemore.schemas import CHANGES, METRICS
from oncemore.sinks.tables import read_snapshots
from oncemore.streaming import counts, delivery, state
from tests.helpers import DELIVERY, POSITION, rows


def batches(seed, n=4, size=60):
    """Redeliveries in any order, ties of time, and a message that makes up a third of all."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        one = []
        for _ in range(size):
            msg = 1 if rng.random() < 0.33 else rng.randint(2, 40)
            arrived = rng.choice([1_000, 1_500, 2_000, 90_000]) * rng.randint(1, 3)
            one.append((rng.choice("ab"), msg, arrived - rng.randint(0, 900), arrived))
        out.append(one)
    return out


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    def stream(data, schema=DELIVERY):
        path = str(tmp_path_factory.mktemp("dealt"))
        for one in data:
            spark.createDataFrame(one, schema).coalesce(1).write.mode("append").parquet(path)
        parsed = spark.createDataFrame([], schema).schema
        return spark.readStream.schema(parsed).option("maxFilesPerTrigger", 1).parquet(path)

    return stream


def seconds(df):
    return sorted(rows(df.select("job_type", "second", "messages")))


def test_second_counts_follow_the_messages(spark, dealt, tmp_path):
    data = batches(1)
    path = str(tmp_path / "seconds")
    counts.start_second_counts(dealt(data), path, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    log = spark.createDataFrame([r for one in data for r in one], DELIVERY)
    assert seconds(counts.current_second_totals(spark, path)) == seconds(stats.second_counts(fold(log)))
    # A batch takes back what it moves: there are differences below zero, and nothing but differences is stored.
    parts = state.published(spark, path, 1)
    assert len(parts) == 4
    second = state.read_parts(spark, path, counts.SECOND_COUNTS, 1, parts[1:2])
    assert second.where("n < 0").count() > 0


def test_changes_are_the_fold_with_former_values(spark, dealt, tmp_path):
    """Also by topic position, which decides among deliveries of one time."""
    data = [[(*r[:3], r[3] // 90_000 * 90_000, 0, 1000 * k + i) for i, r in enumerate(one)] for k, one in enumerate(batches(2, 3))]
    table = str(tmp_path / "t")
    query = counts.changes(dealt(data, POSITION))
    state.start_table(query, table, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    seen, was = [], {}
    for n, one in enumerate(data):
        seen += one
        now = {(r.job_type, r.msg_id): r for r in fold(spark.createDataFrame(seen, POSITION)).select(*METRICS.names).collect()}
        part = [p for p in state.published(spark, table, 1) if p.batch == n]
        got = state.read_parts(spark, table, CHANGES, 1, part).collect()
        assert {(r.job_type, r.msg_id) for r in got} == {r[:2] for r in one}
        for r in got:
            key = (r.job_type, r.msg_id)
            assert tuple(r)[: len(METRICS)] == tuple(now[key])
            old = was.get(key)
            assert (r.was_event_time, r.was_out_time, r.was_latency, r.was_process_count) == (
                (old.event_time, old.out_time, old.latency, old.process_count) if old else (None,) * 4
            )
        was = now


def test_snapshots_of_every_batch(spark, dealt, tmp_path, monkeypatch):
    """Each as if taken over all deliveries so far; and a trigger reads no metrics but its own."""
    data = batches(3, 5)
    monkeypatch.setattr(state, "FAN", 3)
    read = []

    def spy(spark_, path, schema, generation, parts):
        read.append((path, list(parts)))
        return state.read_parts(spark_, path, schema, generation, parts)

    monkeypatch.setattr(counts, "read_parts", spy)
    metrics, table = str(tmp_path / "metrics"), str(tmp_path / "snapshots")
    delivery.start_snapshots(dealt(data), metrics, table, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    taken = read_snapshots(spark, table).cache()
    own = [parts for path, parts in read if path == metrics]
    assert [[p.batch for p in parts] for parts in own] == [[n] for n in range(5)]
    drop = ("id", "snapshot_time", "note")
    for n in range(len(data)):
        log = spark.createDataFrame([r for one in data[: n + 1] for r in one], DELIVERY)
        want = sorted(rows(snapshots.snapshot_rows(fold(log), "").drop(*drop)))
        assert sorted(rows(taken.where(F.col("note") == f"window {n + 1}").drop(*drop))) == want
    assert sorted(r.id for r in taken.collect()) == list(range(1, taken.count() + 1))
    assert sorted(rows(delivery.current_metrics(spark, metrics))) == sorted(rows(fold(log).select(*METRICS.names)))


def test_missing_numbers_count_as_zero(spark, dealt, tmp_path):
    data = [[("a", 1, None, 5_000), (None, 2, 100, 2_000)], [("a", 1, 4_000, 9_000), ("a", None, 0, 1_000)]]
    path = str(tmp_path / "seconds")
    counts.start_second_counts(dealt(data), path, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    got = sorted(rows(counts.current_second_totals(spark, path).select("job_type", "second", "messages")), key=repr)
    assert got == sorted([("a", 9, 1), ("a", 1, 1), (None, 2, 1)], key=repr)


def test_no_counts_no_figures(spark):
    empty = spark.createDataFrame([], counts.COUNTS)
    assert counts.snapshot_of_counts(empty, "x").count() == 0


def test_messages_are_folded_in_groups():
    """One call for many messages, and every part of its deliveries at once."""
    rng = random.Random(7)
    seen, state_ = {}, FakeState()
    for n in range(4):
        data = [[rng.randint(1, 30), rng.randint(0, 9), rng.randint(1, 5), rng.randint(0, 1), 50 * n + k] for k in range(50)]
        parts = [pd.DataFrame(data[k : k + 20], columns=counts._VALUES) for k in range(0, 50, 20)]
        was = {m: folded_plainly(d) for m, d in seen.items()}
        for m, *rest in data:
            seen.setdefault(m, []).append((rest[1], rest[2], rest[3], rest[0]))
        got = pd.concat(counts._fold_group(("a", 3), iter(parts), state_))
        assert list(got.columns) == CHANGES.names and set(got.msg_id) == {r[0] for r in data}
        for r in got.astype(object).where(got.notna(), None).itertuples(index=False):
            assert tuple(r[2:7]) == folded_plainly(seen[r.msg_id])
            assert tuple(r[7:]) == (was[r.msg_id][:4] if r.msg_id in was else (None,) * 4)


class FakeState:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def folded_plainly(deliveries):
    """Event time, out time, latency, count and first out time of (out, partition, tie, created)."""
    first, last = min(deliveries, key=lambda d: d[:3]), max(deliveries, key=lambda d: d[:3])
    return first[3], last[0], last[0] - last[3], len(deliveries), first[0]


def test_only_messages_that_came_again_are_folded_anew(monkeypatch):
    """Others keep their rows: a batch's folding does not grow with the messages of its groups."""
    state_, sizes, fold_rows = FakeState(), [], counts._folded
    monkeypatch.setattr(counts, "_folded", lambda rows: sizes.append(len(rows)) or fold_rows(rows))

    def put(ids, out):
        part = pd.DataFrame([[m, 0, out, 0, 0] for m in ids], columns=counts._VALUES)
        return pd.concat(counts._fold_group(("a", 3), iter([part]), state_))

    put(range(0, 2000, 2), 10)
    sizes.clear()
    got = put([1, 4, 5000, -3], 20)
    assert max(sizes) <= 4
    assert dict(zip(got.msg_id, got.process_count)) == {-3: 1, 1: 1, 4: 2, 5000: 1}
    again = put(range(-3, 2000), 30)
    assert list(again.process_count) == [2, *[1] * 2, *[3 if m == 4 else 2 if m % 2 == 0 or m == 1 else 1 for m in range(2000)]]
