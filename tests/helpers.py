from pyspark.sql import DataFrame, SparkSession

DELIVERY = "job_type string, msg_id long, create_time long, out_time long"
POSITION = DELIVERY + ", partition int, offset long"
METRIC = "job_type string, msg_id long, event_time long, out_time long, latency long, process_count long"

DATA = "/root/testdata/sf0.001"


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def metrics_with_latencies(spark: SparkSession, latencies, job: str = "a") -> DataFrame:
    data = [(job, i, 0, latency, latency, 1) for i, latency in enumerate(latencies)]
    return spark.createDataFrame(data, METRIC)
