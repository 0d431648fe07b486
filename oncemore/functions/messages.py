"""Column expressions for JSON messages.

A message is a JSON object in a string column ``value``. Numbers are read as
text first, so a number in quotes counts as a number and a wrong type in one
field does not make the whole message unreadable.

Parsed fields come out of a generator of one row. A filter on a plain column is
pushed below it and computes it once more, which would parse every message
twice; a filter on a generated column stays above the generator.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC_FIELDS = ("msg_id", "create_time", "process_time")
ADDED_FIELDS = ("process_time", "processor")


def _as_long(text: Column) -> Column:
    # Fractions lose their fraction, as in a narrowing number conversion.
    return F.coalesce(text.try_cast("bigint"), text.try_cast("decimal(38,10)").try_cast("bigint"))


def _whole(kind: str) -> Column:
    """``value`` read as ``kind``, and a mark that is null unless the value is all
    there is: a parser stops at the end of an object and takes no notice of
    text behind it, so the mark is put there."""
    return F.from_json(F.concat(F.lit('{"v":'), "value", F.lit(',"w":0}')), f"v {kind}, w INT")


def _is_object() -> Column:
    """Whether ``value`` is one JSON object, from the generated column ``_whole``."""
    return F.coalesce(F.col("value").rlike(r"^\s*\{") & F.col("_whole").isNotNull(), F.lit(False))


def parse(messages: DataFrame) -> DataFrame:
    """Add the typed fields of ``value`` and a flag ``malformed``.

    Missing, null and empty numeric fields become 0. A message is malformed when
    it is not a JSON object or when a numeric field holds something else.
    """
    text_fields = [*NUMERIC_FIELDS, "processor"]
    record = _whole("STRUCT<" + ", ".join(f"{f}: STRING" for f in text_fields) + ">")
    rows = messages.select("*", F.inline_outer(F.array(record)).alias("_fields", "_whole"))
    malformed = ~_is_object()
    typed = {}
    for field in NUMERIC_FIELDS:
        given = F.trim(F.col(f"_fields.{field}"))
        number = _as_long(given)
        malformed = malformed | ((given != "") & number.isNull())
        typed[field] = F.coalesce(number, F.lit(0).cast("bigint"))
    return rows.select(
        *messages.columns,
        *[c.alias(name) for name, c in typed.items()],
        F.col("_fields.processor").alias("processor"),
        F.coalesce(malformed, F.lit(False)).alias("malformed"),
    )


def split_malformed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good messages with typed fields, and the malformed ones as they came."""
    parsed = parse(messages)
    good = parsed.where(~F.col("malformed")).drop("malformed")
    bad = parsed.where("malformed").select(*messages.columns)
    return good, bad


def enrich_or_flag(messages: DataFrame, processor: str, at: Column | None = None) -> DataFrame:
    """Add or replace ``process_time`` and ``processor`` in the JSON of ``value``.

    ``at`` is the processing time in epoch milliseconds; by default the time of
    the batch. The two fields are put before the closing brace, and the rest of the text stays as it
    is, numbers of any length and repeated names included. Only a message that has one of the
    fields already is written anew. Where ``value`` is not a JSON object it
    stays as it is and the added column ``malformed`` is true, as in ``parse``.
    """
    at = F.unix_millis(F.current_timestamp()) if at is None else at
    name = F.to_json(F.struct(F.lit(processor).alias("processor")))
    fields = F.concat(F.lit('"process_time":'), at.cast("string"), F.lit(","), F.substring(name, 2, 2**31 - 1))
    open_ = F.regexp_replace("value", r"\s*\}\s*$", "")
    comma = F.when(F.trim(open_) == "{", F.lit("")).otherwise(F.lit(","))
    has = F.exists(F.map_keys("_fields"), lambda key: key.isin(*ADDED_FIELDS))
    value = F.when(has, _rewritten(at, processor)).otherwise(F.concat(open_, comma, fields))
    return (
        messages.select("*", F.inline_outer(F.array(_whole("MAP<STRING, STRING>"))).alias("_fields", "_whole"))
        .withColumn("malformed", ~_is_object())
        .withColumn("value", F.when(F.col("malformed"), F.col("value")).otherwise(F.coalesce(value, "value")))
        .drop("_fields", "_whole")
    )


def _rewritten(at: Column, processor: str) -> Column:
    """``value`` with the added fields in place of its own. A name repeated in the object: its last value counts."""
    own = F.from_json("value", "map<string,variant>")
    added = F.create_map(
        F.lit("process_time"), at.cast("variant"), F.lit("processor"), F.lit(processor).cast("variant")
    )
    names = F.map_keys(own)
    last_of_each = F.filter(
        F.map_entries(own),
        lambda field, i: ~field["key"].isin(*ADDED_FIELDS)
        & ~F.array_contains(F.slice(names, i + 2, F.size(names)), field["key"]),
    )
    return F.to_json(F.map_concat(F.map_from_entries(last_of_each), added))


def enrich(messages: DataFrame, processor: str, at: Column | None = None) -> DataFrame:
    """The enriched messages without the malformed ones (see ``enrich_or_flag``)."""
    return enrich_or_flag(messages, processor, at).where(~F.col("malformed")).drop("malformed")


def serialise(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows as messages: string ``key`` (the message id) and JSON ``value``."""
    return rows.select(
        F.col("msg_id").cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value")
    )


def deliveries_of(messages: DataFrame, job_type: str | Column, out_time: Column | None = None) -> DataFrame:
    """Deliveries from the good result messages of one topic.

    ``out_time`` is when the collector saw the record, in epoch milliseconds; by
    default the time of the batch. Topic positions are kept when present.
    """
    out_time = F.unix_millis(F.current_timestamp()) if out_time is None else out_time
    job = job_type if isinstance(job_type, Column) else F.lit(job_type)
    good, _ = split_malformed(messages)
    position = [c for c in ("partition", "offset") if c in messages.columns]
    return good.select(
        job.alias("job_type"), "msg_id", "create_time", out_time.cast("bigint").alias("out_time"), *position
    )
