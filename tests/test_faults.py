import datetime as dt

from pyspark.sql import functions as F

from oncemore.plans import faults
from oncemore.schemas import FAULTS
from oncemore.sources import faultlog

LINES = """2024-01-01 00:01:00,kill-tm,node2,4711
2024-01-01 00:02:00,kill-jm,815
2024-01-01 00:03:00,network-tm,node3
2024-01-01 00:04:00,checkpoint,a1b2c3
2024-01-01 00:05:00,kill-worker,99
not a time,kill-tm,node1,1
"""
WANT = [
    ("kill-tm", "node1", "1"),
    ("kill-tm", "node2", "4711"),
    ("kill-jm", None, "815"),
    ("network-tm", "node3", None),
    ("checkpoint", None, "a1b2c3"),
    ("kill-worker", None, "99"),
]


def test_fault_log(spark, tmp_path):
    (tmp_path / "faults.csv").write_text(LINES)
    got = faultlog.read_fault_log(spark, str(tmp_path / "faults.csv")).orderBy("inject_time")
    assert [tuple(r)[1:] for r in got.collect()] == WANT
    assert [r.inject_time for r in got.collect()][:2] == [None, dt.datetime(2024, 1, 1, 0, 1)]
    lines = spark.read.text(str(tmp_path / "faults.csv"))
    assert [tuple(r)[1:] for r in faultlog.parse_fault_lines(lines).orderBy("inject_time").collect()] == WANT


def fault(spark, *seconds):
    data = [(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s), "kill-tm", "n", str(s)) for s in seconds]
    return spark.createDataFrame(data, FAULTS)


def seconds(spark, counts, job="a"):
    return spark.createDataFrame([(job, s, n) for s, n in counts.items()], "job_type string, second long, messages long")


def test_recovery(spark):
    # 100 messages a second, an outage from 1000 to 1019, slow until 1029.
    counts = {s: 100 for s in range(900, 1000)} | {s: 50 for s in range(1020, 1030)} | {s: 95 for s in range(1030, 1100)}
    got = faults.fault_recovery(fault(spark, 1000), seconds(spark, counts)).collect()
    assert len(got) == 1
    assert (got[0].baseline_msg_s, got[0].recovery_s) == (100.0, 30)
    assert got[0].recovered_at.timestamp() == 1030
    half = faults.fault_recovery(fault(spark, 1000), seconds(spark, counts), threshold=0.5).first()
    assert half.recovery_s == 20


def test_no_recovery_and_no_baseline(spark):
    dead = seconds(spark, {s: 10 for s in range(900, 1000)})
    late = seconds(spark, {s: 10 for s in range(1001, 1100)}, "late")
    got = faults.fault_recovery(fault(spark, 1000), dead.unionByName(late)).collect()
    assert sorted((r.job_type, r.baseline_msg_s, r.recovery_s) for r in got) == [("a", 10.0, None), ("late", None, None)]


def test_recovery_however_late_and_no_fault_is_lost(spark):
    times = {s: 10 for s in range(0, 100)} | {1_000_000: 9, 70_000_000: 8, 300_000_000: 50, 300_000_001: 60}
    lost = fault(spark, 100).withColumn("inject_time", F.lit(None).cast("timestamp"))
    got = faults.fault_recovery(fault(spark, 100, 200).unionByName(lost), seconds(spark, times), threshold=0.95)
    found = {r.inject_time and int(r.inject_time.timestamp()): (r.job_type, r.baseline_msg_s, r.recovery_s) for r in got.collect()}
    assert found == {100: ("a", 10.0, 300_000_000 - 100), 200: ("a", None, None), None: ("a", None, None)}
    soon = faults.fault_recovery(fault(spark, 100), seconds(spark, times), threshold=0.8).first()
    assert soon.recovery_s == 1_000_000 - 100


def test_repeated_fault_lines_count_once_and_stretches_do_not_matter(spark):
    counts = seconds(spark, {s: 10 for s in range(0, 6000)})
    for s in range(100, 5000, 331):
        twice = fault(spark, s, s)
        got = faults.fault_recovery(twice, counts, baseline_s=60).collect()
        assert [(r.baseline_msg_s, r.recovery_s) for r in got] == [(10.0, 1)]


def test_expected_duplicates(spark):
    kinds = ["none", "bolt-before", "bolt-after", "spout", "acker", "after", "before", "unheard-of"]
    runs = spark.createDataFrame([(k, k, 3) for k in kinds], "job_type string, fault_type string, faults long")
    observed = spark.createDataFrame([(k, 6) for k in kinds[:-1]], "job_type string, total_reprocess_count long")
    got = {r.fault_type: tuple(r)[3:] for r in faults.duplicate_expectation(runs, observed, max_pending=500).collect()}
    assert got == {
        "none": (None, 0, 6, None),
        "bolt-before": (10, 0, 6, None),
        "bolt-after": (10, 3, 6, 2.0),
        "spout": (30, 1500, 6, 0.004),
        "acker": (60, 1500, 6, 0.004),
        "after": (None, 3, 6, 2.0),
        "before": (None, None, 6, None),
        "unheard-of": (None, None, 0, None),
    }
