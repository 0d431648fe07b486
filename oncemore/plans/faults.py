"""What faults did to a job: recovery time and expected duplicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = ("inject_time", "fault_type", "node", "target")

# Expected duplicates per fault, by fault type. PENDING stands for
# the number of messages in flight; None where there is no expectation.
PENDING = "pending"
EXPECTED_PER_FAULT = {
    "none": 0,
    "bolt-before": 0,
    "bolt-after": 1,
    "spout": PENDING,
    "acker": PENDING,
    "after": 1,
    "before": None,
}

# Seconds within which a job is expected to be back, by fault type.
EXPECTED_RECOVERY_S = {"spout": 30, "bolt-before": 10, "bolt-after": 10, "acker": 60}

# Children of a node, and levels, of the tree that recoveries are searched in: 256**4 seconds.
FAN, LEVELS = 256, 4


def fault_recovery(
    faults: DataFrame, seconds: DataFrame, threshold: float = 0.9, baseline_s: int = 60
) -> DataFrame:
    """When each job was back at speed after each fault: a row for every fault and job.

    ``seconds`` holds messages per job and second (see ``second_counts``). The
    baseline is the mean rate over the ``baseline_s`` seconds before the fault,
    null if the job was silent then or the fault's time is unknown. A job has
    recovered in the first second after the fault, however late, that reaches
    ``threshold`` times the baseline; null when there is none.

    Recovery depends on the second of a fault only, so it is found once per such
    second however many faults share it.
    """
    listed = faults.select(*FAULT).distinct().withColumn("fault_second", F.unix_seconds("inject_time"))
    found = _back_at_speed(_baselines(listed, seconds, baseline_s), seconds, threshold)
    jobs = seconds.select(F.collect_set("job_type")).scalar()
    each = listed.withColumn("job_type", F.explode_outer(jobs))
    return each.join(found, ["fault_second", "job_type"], "left").select(
        *FAULT,
        "job_type",
        F.round("baseline", 2).alias("baseline_msg_s"),
        F.timestamp_seconds("back").alias("recovered_at"),
        (F.col("back") - F.col("fault_second")).alias("recovery_s"),
    )


def _baselines(listed: DataFrame, seconds: DataFrame, baseline_s: int) -> DataFrame:
    """``fault_second``, ``job_type`` and ``baseline`` where there is one.

    Seconds and faults meet on stretches of ``baseline_s`` seconds, of which the
    time before a fault touches two: an ordinary equi-join.
    """
    hits = listed.where(F.col("fault_second").isNotNull()).select("fault_second").distinct()
    stretches = F.sequence(
        F.expr(f"(fault_second - {baseline_s}L) div {baseline_s}L"), F.expr(f"(fault_second - 1L) div {baseline_s}L")
    )
    views = hits.withColumn("stretch", F.explode(stretches))
    before = F.col("second").between(F.col("fault_second") - baseline_s, F.col("fault_second") - 1)
    seen = seconds.withColumn("stretch", F.expr(f"second div {baseline_s}L")).join(views, "stretch").where(before)
    return seen.groupBy("fault_second", "job_type").agg((F.sum("messages") / baseline_s).alias("baseline"))


def _back_at_speed(baselines: DataFrame, seconds: DataFrame, threshold: float) -> DataFrame:
    """``baselines`` with ``back``, the first second after the fault that is fast enough.

    The best rates of stretches of 256 seconds, of 256 such stretches and so on
    form a tree. The search climbs from the fault until a later neighbour is
    fast enough, then descends to its first second. A step compares a fault with
    at most 255 neighbours, and the tree has four levels.
    """
    best = [seconds.select(F.col("job_type").alias("job"), F.col("second").alias("key"), F.col("messages").alias("most"))]
    for _ in range(LEVELS - 1):
        up = best[-1].groupBy("job", F.expr(f"key div {FAN}L").alias("key"))
        best.append(up.agg(F.max("most").alias("most")))
    state = ["fault_second", "job_type", "baseline", "at", "hit", "level"]
    search = baselines.select(
        "fault_second", "job_type", "baseline", F.col("fault_second").alias("at"),
        F.lit(None).cast("bigint").alias("hit"), F.lit(None).cast("int").alias("level"),
    )

    def step(level: int, rows: DataFrame, parent: Column, wanted: Column) -> DataFrame:
        same = (
            wanted
            & (F.col("job_type") == F.col("job"))
            & (parent == F.expr(f"key div {FAN}L"))
            & (F.col("most") >= F.col("baseline") * threshold)
        )
        return rows.join(best[level], same, "left").groupBy(*state).agg(F.min("key").alias("next"))

    for level in range(LEVELS):
        met = step(level, search, F.expr(f"at div {FAN}L"), F.col("hit").isNull() & (F.col("key") > F.col("at")))
        new = F.col("hit").isNull() & F.col("next").isNotNull()
        search = met.withColumns({
            "level": F.when(new, level).otherwise(F.col("level")),
            "hit": F.coalesce("hit", "next"),
            "at": F.expr(f"at div {FAN}L"),
        }).drop("next")
    for level in range(LEVELS - 1, 0, -1):
        met = step(level - 1, search, F.col("hit"), F.col("level") == level)
        down = F.col("level") == level
        search = met.withColumns({
            "hit": F.when(down, F.col("next")).otherwise(F.col("hit")),
            "level": F.when(down, level - 1).otherwise(F.col("level")),
        }).drop("next")
    return search.select("fault_second", "job_type", "baseline", F.col("hit").alias("back"))


def duplicate_expectation(runs: DataFrame, duplicate_stats: DataFrame, max_pending: int = 1000) -> DataFrame:
    """Expected against observed duplicates of fault runs.

    ``runs`` has ``job_type``, ``fault_type`` and ``faults``. Observed are the
    reprocessed deliveries of ``duplicate_stats``, because a message repeated by
    two faults counts twice in the expectation. ``expected_recovery_s`` is to be
    compared with the runs' recoveries (see ``fault_recovery``).
    """
    per_fault = F.lit(None).cast("bigint")
    for fault_type, n in EXPECTED_PER_FAULT.items():
        count = max_pending if n == PENDING else n
        per_fault = F.when(F.col("fault_type") == fault_type, F.lit(count).cast("bigint")).otherwise(per_fault)
    expected = F.col("faults") * per_fault
    within = F.lit(None).cast("bigint")
    for fault_type, n in EXPECTED_RECOVERY_S.items():
        within = F.when(F.col("fault_type") == fault_type, F.lit(n).cast("bigint")).otherwise(within)
    return (
        runs.join(duplicate_stats, "job_type", "left")
        .select(
            "job_type",
            "fault_type",
            "faults",
            within.alias("expected_recovery_s"),
            expected.alias("expected_duplicates"),
            F.coalesce("total_reprocess_count", F.lit(0)).cast("bigint").alias("observed"),
        )
        .withColumn("ratio", F.round(F.try_divide("observed", "expected_duplicates"), 4))
    )
