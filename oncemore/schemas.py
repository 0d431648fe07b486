"""Schemas of the tables and messages this library reads and writes."""

from pyspark.sql.types import (
    BinaryType,
    DataType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields: type[DataType] | DataType) -> StructType:
    return StructType([StructField(n, t if isinstance(t, DataType) else t()) for n, t in fields.items()])


# One message as produced, and the fields the processing stage adds to it.
SOURCE_MESSAGE = _struct(msg_id=LongType, create_time=LongType, payload=StringType)
RESULT_MESSAGE = _struct(
    msg_id=LongType, create_time=LongType, payload=StringType, process_time=LongType, processor=StringType
)

# One consumed record. `partition` and `offset` are the topic position; logs
# without a position leave both columns out.
DELIVERIES = _struct(
    job_type=StringType,
    msg_id=LongType,
    create_time=LongType,
    out_time=LongType,
    partition=IntegerType,
    offset=LongType,
)

# One row per message and job: the deliveries folded.
METRICS = _struct(
    job_type=StringType,
    msg_id=LongType,
    event_time=LongType,
    out_time=LongType,
    latency=LongType,
    process_count=LongType,
    first_out_time=LongType,
)

# A changed metrics row and its former values, which are null for a new message.
CHANGES = StructType(
    METRICS.fields
    + _struct(was_event_time=LongType, was_out_time=LongType, was_latency=LongType, was_process_count=LongType).fields
)

# Messages by the values of four of their columns, and messages per second; or differences of such counts.
MEASURES = ("latency", "out_time", "event_time", "process_count")
COUNTS = _struct(job_type=StringType, measure=StringType, value=LongType, n=LongType)
SECOND_COUNTS = _struct(job_type=StringType, second=LongType, n=LongType)

# One row per query and micro-batch: what the batch reported.
PROGRESS = _struct(
    query=StringType,
    batch_id=LongType,
    at=TimestampType,
    input_rows=LongType,
    duration_ms=LongType,
    deliveries=LongType,
    sum_latency=LongType,
    min_latency=LongType,
    max_latency=LongType,
)

# Metrics of several runs, and latency sketches, as stored.
RUN_METRICS = StructType([StructField("run_id", StringType()), *METRICS.fields])
SKETCHES = StructType(
    _struct(
        job_type=StringType, second=LongType, messages=LongType, sum_latency=LongType, min_latency=LongType, max_latency=LongType
    ).fields
    + [StructField("sketch", BinaryType())]
)

# One row per job in every snapshot of the statistics.
SNAPSHOTS = _struct(
    id=LongType,
    snapshot_time=TimestampType,
    job_type=StringType,
    total_messages=LongType,
    unique_messages=LongType,
    avg_latency=DecimalType(20, 2),
    min_latency=LongType,
    max_latency=LongType,
    p50_latency=DecimalType(20, 2),
    p95_latency=DecimalType(20, 2),
    p99_latency=DecimalType(20, 2),
    stddev_latency=DecimalType(20, 2),
    duplicate_messages=LongType,
    duplicate_rate=DecimalType(20, 4),
    max_process_count=IntegerType,
    total_reprocess_count=LongType,
    throughput_per_sec=DecimalType(20, 2),
    time_window_sec=LongType,
    data_range_start=LongType,
    data_range_end=LongType,
    note=StringType,
)

# A fault log line as written (three or four fields), and after normalising.
FAULT_LINES = _struct(inject_time=TimestampType, fault_type=StringType, a3=StringType, a4=StringType)
FAULTS = _struct(inject_time=TimestampType, fault_type=StringType, node=StringType, target=StringType)
FAULT_LINES_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FAULT_LINES)
