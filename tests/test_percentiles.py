import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from oncemore.operators.percentiles import FAN, LEVELS, nearest_rank_percentiles, ranked_histogram
from tests.helpers import METRIC, metrics_with_latencies, rows

PCTS = (1, 50, 95, 99, "99.9", 100)


def by_sorting(values, pct):
    rank = len(values) * int(float(pct) * 10) // 1000
    return sorted(values)[rank - 1] if rank else None


@pytest.mark.parametrize("n, p50, p95", [(19, 9, 18), (20, 10, 19), (21, 10, 19), (100, 50, 95)])
def test_rank_is_rounded_down(spark, n, p50, p95):
    metrics = metrics_with_latencies(spark, range(1, n + 1))
    got = nearest_rank_percentiles(metrics, ["job_type"], "latency", (50, 95)).first()
    assert (got.p50, got.p95) == (p50, p95)


def test_one_row_has_no_percentiles(spark):
    got = nearest_rank_percentiles(metrics_with_latencies(spark, [50]), ["job_type"], "latency")
    assert rows(got) == [("a", None, None, None)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.one_of(st.integers(-3000, 3000), st.integers(-(2**40), 2**40))),
        min_size=1,
        max_size=80,
    )
)
def test_equals_sorting(spark, data):
    metrics = spark.createDataFrame([(j, i, 0, 0, v, 1) for i, (j, v) in enumerate(data)], METRIC)
    got = nearest_rank_percentiles(metrics, ["job_type"], "latency", PCTS)
    for row in got.collect():
        values = [v for j, v in data if j == row.job_type]
        assert list(row)[1:] == [by_sorting(values, p) for p in PCTS]


def test_histogram_runs_up_to_the_total(spark):
    rng = random.Random(3)
    values = [rng.randrange(0, 20_000) for _ in range(5000)]
    got = ranked_histogram(metrics_with_latencies(spark, values), ["job_type"], "latency").orderBy("latency").collect()
    assert [r.latency for r in got] == sorted(set(values))
    ordered = sorted(values)
    for r in got[::97]:
        assert ordered[r.upto - 1] == r.latency
        assert r.upto == len(ordered) or ordered[r.upto] > r.latency
    assert {r.total for r in got} == {5000}
    assert got[0].mean == pytest.approx(sum(values) / 5000, rel=1e-12)


def test_no_task_sees_all_values_of_a_group(spark):
    """Spread over 10**15, as many values as rows: still no family of more than a few values."""
    rng = random.Random(5)
    values = sorted({rng.randrange(-(10**15), 10**15) for _ in range(3000)})
    got = ranked_histogram(metrics_with_latencies(spark, values), ["job_type"], "latency").orderBy("latency").collect()
    assert [(r.latency, r.upto) for r in got] == [(v, k + 1) for k, v in enumerate(values)]
    for levels in range(1, LEVELS + 1):
        # Children of a bucket of this level: distinct buckets of the level below.
        below = {int(v / FAN ** (levels - 1)) for v in values}
        families = Counter(int(b / FAN) for b in below)
        assert max(families.values()) <= 2 * FAN
    extremes = [-(2**63), -1, 0, 1, 2**63 - 1]
    got = ranked_histogram(metrics_with_latencies(spark, extremes), ["job_type"], "latency").collect()
    assert sorted((r.latency, r.upto) for r in got) == [(v, k + 1) for k, v in enumerate(extremes)]


def test_weighted_rows(spark):
    plain = metrics_with_latencies(spark, [5] * 7 + [2000] * 2 + [2001] * 4)
    counted = spark.createDataFrame([("a", 5, 7), ("a", 2000, 2), ("a", 2001, 4)], "job_type string, latency long, k long")
    one = ranked_histogram(plain, ["job_type"], "latency")
    other = ranked_histogram(counted, ["job_type"], "latency", weight="k")
    assert sorted(rows(one)) == sorted(rows(other))


def test_missing_values_rank_first(spark):
    data = [("a", i, 0, 0, v, 1) for i, v in enumerate([None, None, 10, 20, 3000])] + [("b", 1, 0, 0, None, 1)]
    ranked = ranked_histogram(spark.createDataFrame(data, METRIC), ["job_type"], "latency").collect()
    assert {(r.job_type, r.latency, r.upto, r.total, r.mean) for r in ranked} == {
        ("a", None, 2, 5, 1010.0),
        ("a", 10, 3, 5, 1010.0),
        ("a", 20, 4, 5, 1010.0),
        ("a", 3000, 5, 5, 1010.0),
        ("b", None, 1, 1, None),
    }
