"""The fault log: comma-separated lines without a header and of uneven length.

    time,type,node,pid      a worker was killed on a node
    time,type,node          a node was cut off the network
    time,type,pid           a master or worker process was killed
    time,type,job           a checkpoint of a job was forced
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oncemore.schemas import FAULT_LINES, FAULT_LINES_DDL

# Time format of the log, and the types whose third field is a job.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
JOB_FAULTS = ("checkpoint",)


def normalise(lines: DataFrame) -> DataFrame:
    """Sort the third and fourth field into ``node`` and ``target`` (pid or job).

    With four fields the third is the node. With three it is the target when it
    is a number or the fault concerns a job, else the node.
    """
    a3, a4 = F.trim("a3"), F.trim("a4")
    is_target = a4.isNull() & (a3.rlike("^[0-9]+$") | F.col("fault_type").isin(*JOB_FAULTS))
    return lines.select(
        "inject_time",
        F.trim("fault_type").alias("fault_type"),
        F.when(~is_target, a3).alias("node"),
        F.when(is_target, a3).otherwise(a4).alias("target"),
    )


def read_fault_log(spark: SparkSession, path: str) -> DataFrame:
    """Normalised faults from log files; missing trailing fields are null, and
    so is a time that cannot be read."""
    lines = (
        spark.read.schema(FAULT_LINES)
        .option("mode", "PERMISSIVE")
        .option("timestampFormat", TIME_FORMAT)
        .csv(path)
    )
    return normalise(lines)


def parse_fault_lines(lines: DataFrame) -> DataFrame:
    """Normalised faults from a column ``value`` of log lines."""
    options = {"mode": "PERMISSIVE", "timestampFormat": TIME_FORMAT}
    parsed = lines.select(F.from_csv("value", FAULT_LINES_DDL, options).alias("f"))
    return normalise(parsed.select("f.*"))
