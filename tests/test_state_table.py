"""The table behind a stream: whole batches only, replays, merged levels, and what is cleaned up."""

import random

import pytest
from pyspark.sql import functions as F

from oncemore.streaming import state
from tests.helpers import rows

SCHEMA = "k long, v string"


def batch(spark, data):
    return spark.createDataFrame(data, SCHEMA).coalesce(1)


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def current(spark, path, schema):
    return sorted(rows(state.latest_rows(spark, path, schema, ["k"])))


def merge_of(schema):
    return lambda r: state.newest(r, schema, ["k"])


def files_below(tmp_path):
    return [f for f in tmp_path.rglob("*.parquet")]


def test_a_reader_never_meets_half_a_batch(spark, schema, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    state.write_batch(batch(spark, [(1, "a"), (2, "a")]), path, 0)
    seen = []
    publish = state._publish

    def look_first(*args):
        seen.append(current(spark, path, schema))
        publish(*args)

    monkeypatch.setattr(state, "_publish", look_first)
    state.write_batch(batch(spark, [(2, "b"), (3, "b")]), path, 1)
    assert seen == [[(1, "a"), (2, "a")]]
    assert current(spark, path, schema) == [(1, "a"), (2, "b"), (3, "b")]

    # The same batch again: until it is published anew, its first attempt stands.
    state.write_batch(batch(spark, [(2, "c")]), path, 1)
    assert seen[1] == [(1, "a"), (2, "b"), (3, "b")]
    assert current(spark, path, schema) == [(1, "a"), (2, "c")]


def test_a_failed_attempt_leaves_nothing_behind(spark, schema, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    state.write_batch(batch(spark, [(1, "a")]), path, 0)
    with monkeypatch.context() as m:
        m.setattr(state, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.write_batch(batch(spark, [(1, "half")]), path, 1)
    assert current(spark, path, schema) == [(1, "a")]
    monkeypatch.setattr(state, "KEEP", 1)
    for n in (1, 2, 3):
        state.write_batch(batch(spark, [(n, f"b{n}")]), path, n)
    assert current(spark, path, schema) == [(1, "b1"), (2, "b2"), (3, "b3")]
    # The failed attempt's files went with the manifest that did without them.
    assert len(files_below(tmp_path)) == 4


def test_levels_keep_the_table_small(spark, schema, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FAN", 4)
    monkeypatch.setattr(state, "KEEP", 2)
    path, rng, want = str(tmp_path / "t"), random.Random(1), {}
    most = 0
    for n in range(70):
        data = [(k, f"{n}") for k in rng.sample(range(40), 3)]
        want |= dict(data)
        state.write_batch(batch(spark, data), path, n, merge=merge_of(schema))
        parts = state.published(spark, path, 1)
        most = max(most, len(parts))
        if n % 7 == 0:
            assert current(spark, path, schema) == sorted(want.items())
    assert current(spark, path, schema) == sorted(want.items())
    # 70 batches are 1012 to the base of four: one, none, one and two parts of the levels.
    assert sorted(p.level for p in parts) == [0, 0, 1, 3] and most <= 3 * 4
    # Files of the parts, and of those that the last manifests did without.
    assert len(files_below(tmp_path)) <= 20
    assert len(state._manifests(spark, state._table(path, 1))) == 2


def test_repeating_the_batch_that_merged(spark, schema, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FAN", 2)
    path = str(tmp_path / "t")
    for n in range(4):
        state.write_batch(batch(spark, [(n, f"{n}"), (9, f"{n}")]), path, n, merge=merge_of(schema))
    once = current(spark, path, schema)
    assert len(state.published(spark, path, 1)) == 1
    state.write_batch(batch(spark, [(3, "3"), (9, "3")]), path, 3, merge=merge_of(schema))
    assert current(spark, path, schema) == once == [(0, "0"), (1, "1"), (2, "2"), (3, "3"), (9, "3")]
    assert len(state.published(spark, path, 1)) == 1


def test_a_table_that_is_not_there(spark, schema, tmp_path):
    assert current(spark, str(tmp_path / "none"), schema) == []


def test_sums_merge_as_well(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FAN", 3)
    path = str(tmp_path / "t")
    schema = spark.createDataFrame([], "k long, n long").schema

    def add(r):
        return r.groupBy("k").agg(F.sum("n").alias("n"))

    for n in range(10):
        state.write_batch(spark.createDataFrame([(n % 3, 1), (7, n)], schema), path, n, merge=add)
    parts = state.read_parts(spark, path, schema, 1, state.published(spark, path, 1))
    assert sorted(rows(add(parts))) == [(0, 4), (1, 3), (2, 3), (7, 45)]
