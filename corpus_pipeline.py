"""A corpus pipeline: each stage works on what the one before it kept, as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oncemore.llm.common import perhaps_in, shared_path, stored, unused
from oncemore.llm.decontaminate import contaminated
from oncemore.llm.mixing import mixture
from oncemore.llm.secrets import redacted
from oncemore.llm.simhash import near_duplicates
from oncemore.llm.toxicity import add_scores, learn


def _numbered(spark: SparkSession, docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a unique number ``row``, written so that the numbers hold."""
    path = shared_path(spark, "numbered")
    docs.withColumn(row, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go.

    Null and empty texts hold no toxic word and stay. Repeated rows go or stay
    together. Without labels nothing goes; an empty table stays empty.
    """
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "__score")
    return add_scores(docs, model, name=score).where(F.col(score) < 0.7).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays.

    Rows without doc_id stay only where nobody in the group has one. Of repeated
    rows one stays, and of texts without words (null, empty, blank) as well. An
    empty table stays empty.
    """
    row = unused(docs, "__row")
    rows = _numbered(spark, docs, row)
    groups = near_duplicates(rows.select(F.col(row).alias("row"), "doc_id", "text"))
    gone = stored(groups.where(~F.col("keep")).select(F.col("row").alias(row)), "gone")
    # Only rows that may go travel to the join.
    doubtful = perhaps_in(row, gone)
    kept = rows.where(~doubtful).union(rows.where(doubtful).join(gone, row, "left_anti").select(rows.columns))
    return kept.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Null and empty texts overlap nothing and stay, and so does everything where
    the benchmark is empty. Repeated rows go or stay together; a row without
    doc_id goes by its own text. An empty table stays empty.
    """
    own, text = unused(docs, "__id"), unused(docs, "__txt")
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "txt").distinct()
    leaks = leaks.toDF(own, text)
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text))
    return docs.join(leaks, same, "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` is counted anew for changed texts.

    No row goes. Null and empty texts stay as they are; repeated rows change
    alike. An empty table stays empty.
    """
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with ``copies``, in place of a column of that name; those with none go.

    Null and wordless texts have no size and go. Repeated rows draw each for
    itself; a null source is one more source, the last. An empty table stays empty.
    """
    row, copies = unused(docs, "__row"), unused(docs, "__copies")
    rows = _numbered(spark, docs, row)
    mixed = mixture(rows, row=row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(copies))
    others = [c for c in docs.columns if c.lower() != "copies"]
    return rows.join(mixed, row).select(*others, F.col(copies).alias("copies"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
]

#: No stage but the scan can be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
