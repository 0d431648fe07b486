import pytest

from oncemore.operators.fold import KEY, fold
from oncemore.sinks.tables import read_runs, reset_run, write_runs
from tests.helpers import DELIVERY

LOG = [
    ("r/1 ü", "a", 1, 0, 10), ("r/1 ü", "a", 1, 0, 20), ("r/1 ü", "b", 2, 0, 30),
    ("r2", "a", 1, 0, 40), ("r2", "c", 3, 0, 50), ("r3", "a", 1, 0, 60),
]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "runs")
    log = spark.createDataFrame(LOG, "run_id string, " + DELIVERY)
    write_runs(fold(log, ("run_id", *KEY)), path)
    return path


def kept(spark, path):
    return sorted((r.run_id, r.job_type, r.msg_id, r.process_count) for r in read_runs(spark, path).collect())


ALL = [("r/1 ü", "a", 1, 2), ("r/1 ü", "b", 2, 1), ("r2", "a", 1, 1), ("r2", "c", 3, 1), ("r3", "a", 1, 1)]


def test_runs_with_equal_ids_stay_apart(spark, table):
    assert kept(spark, table) == ALL


def test_reset_of_one_run(spark, table, tmp_path):
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet") if "run_id=r2" not in str(f)}
    assert reset_run(spark, table, "r2")
    assert kept(spark, table) == [r for r in ALL if r[0] != "r2"]
    assert {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")} == before
    assert not reset_run(spark, table, "r2") and not reset_run(spark, table, "r")
    assert reset_run(spark, table, "r/1 ü")
    assert kept(spark, table) == [("r3", "a", 1, 1)]


def test_a_run_written_again_leaves_the_others(spark, table):
    again = spark.createDataFrame([("r2", "a", 7, 0, 1)], "run_id string, " + DELIVERY)
    reset_run(spark, table, "r2")
    write_runs(fold(again, ("run_id", *KEY)), table)
    assert kept(spark, table) == sorted([r for r in ALL if r[0] != "r2"] + [("r2", "a", 7, 1)])
    # Without a reset its other jobs stay, too.
    write_runs(fold(again.selectExpr("'r/1 ü' run_id", "job_type", "msg_id", "create_time", "out_time"), ("run_id", *KEY)), table)
    assert ("r/1 ü", "b", 2, 1) in kept(spark, table) and ("r/1 ü", "a", 1, 2) not in kept(spark, table)


def test_a_filter_reads_one_run(spark, table):
    plan = read_runs(spark, table).where("run_id = 'r2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
