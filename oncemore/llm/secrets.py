"""Secret scan with an incremental ledger of blobs, in DataFrame functions only.

Texts are addressed by their SHA-256. A ledger remembers which rules, in which
version, have seen which blob; a run scans only the pairs that are missing and
appends its findings, then joins all findings of a blob back to every path
(row) that holds it. Copies and versions that come back are scanned once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oncemore.llm.common import shared_path, unused


@dataclass(frozen=True)
class Rule:
    """``value``: the group of ``pattern`` that needs ``least`` characters. ``hint``: texts that every match has one of."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    hint: tuple[str, ...] = ()
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base patterns are given, the others are public token formats. A run of
#: the least length takes the whole run, so a lower bound in the pattern equals a check after it.
RULES = (
    Rule(
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        value=2,
        least=6,
        hint=(":", "="),
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint=("AKIA",), base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint=("xox",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint=("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint=("eyJ",)),
)

_SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Array of the rule's matches in ``text``: leftmost, not overlapping, in code points, end exclusive.

    Matches are put between two control characters, the text is split there,
    and the lengths of the pieces give the positions. The control characters'
    own occurrences are first replaced by another that no rule knows.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    safe = F.translate(text, "\x01\x02", "\x03\x03")
    pieces = F.split(F.regexp_replace(safe, rule.pattern, "\x01$0\x02"), "[\x01\x02]", -1)
    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("match"), none.alias("found")
    )

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        value = F.regexp_extract(piece, rule.pattern, rule.value) if rule.value else piece
        good = state["match"] & (F.length(value) >= rule.least)
        span = F.struct(
            state["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")
        )
        found = F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), (~state["match"]).alias("match"), found.alias("found"))

    may = F.lit(True)
    if rule.hint:
        may = F.contains(text, F.lit(rule.hint[0]))
        for hint in rule.hint[1:]:
            may = may | F.contains(text, F.lit(hint))
    return F.when(may & text.rlike(rule.pattern), F.aggregate(pieces, start, step, lambda s: s["found"])).otherwise(none)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every blob of ``docs``: ``sha`` and ``spans`` (by start, then rule), blobs without any left out.

    Scans what the ledger at the path ``ledger`` lacks and appends to it. The
    ledger is two tables, ``seen`` (sha, rules) and ``found`` (sha, name, spans).
    A run that fails between the two leaves pairs to scan again, and a finding
    that is there twice counts once.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("sha"), text.alias("blob")).groupBy("sha").agg(F.first("blob").alias("blob"))
    names = F.array(*(F.lit(r.name) for r in rules))
    seen = _read(spark, f"{ledger}/seen", "sha string, rules array<string>")
    if seen is None:
        pending = blobs.withColumn("todo", names)
    else:
        known = seen.groupBy("sha").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("known"))
        todo = F.array_except(names, F.coalesce("known", F.array().cast("array<string>")))
        pending = blobs.join(known, "sha", "left").withColumn("todo", todo).where(F.size("todo") > 0)
    none = F.array().cast(f"array<{_SPAN}>")
    each = [
        F.struct(
            F.lit(r.name).alias("name"),
            F.when(F.array_contains("todo", r.name), spans_of(F.col("blob"), r, k)).otherwise(none).alias("spans"),
        )
        for k, r in enumerate(rules)
    ]
    batch = shared_path(spark, "scanned")
    pending.select("sha", "todo", F.filter(F.array(*each), lambda x: F.size(x["spans"]) > 0).alias("hits")).write.parquet(batch)
    done = spark.read.schema(
        f"sha string, todo array<string>, hits array<struct<name: string, spans: array<{_SPAN}>>>"
    ).parquet(batch)
    done.select("sha", F.inline("hits")).write.mode("append").parquet(f"{ledger}/found")
    done.select("sha", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/seen")
    found = _read(spark, f"{ledger}/found", f"sha string, name string, spans array<{_SPAN}>")
    now = found.where(F.col("name").isin([r.name for r in rules])).join(docs.select(F.sha2(text, 256).alias("sha")).distinct(), "sha", "left_semi")
    return now.groupBy("sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else None


def secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``sha`` and ``spans`` for every row of ``docs``.

    A null text counts as empty and has no spans; repeated rows come out as
    often as they went in; an empty table gives an empty table; other columns
    are not looked at. Without ``ledger`` a new one is begun in the shared folder.
    """
    found = scan(docs, ledger or shared_path(docs.sparkSession, "ledger"), rules)
    paths = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    none = F.array().cast(f"array<{_SPAN}>")
    return paths.join(found, "sha", "left").select("doc_id", "sha", F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span (overlapping ones together) replaced by ``mark`` in ``text``; null texts stay null.

    All columns stay; ``n_chars``, where there is one, is counted anew for changed texts.
    """
    sha, own, changed_text = (unused(docs, n) for n in ("__sha", "__spans", "__text"))
    found = scan(docs, ledger or shared_path(docs.sparkSession, "ledger")).toDF(sha, own)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        fresh = span["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    def end(state: Column) -> Column:
        return F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, sha, "left")
    changed = F.col(own).isNotNull()
    text = F.when(changed, F.aggregate(own, start, step, end)).otherwise(F.col("text"))
    # The new text stands beside the old one until it is counted.
    keyed = keyed.withColumn(changed_text, text)
    new = {"text": F.col(changed_text)}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(changed, F.length(changed_text).cast(kind)).otherwise(F.col("n_chars"))
    return keyed.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rank"] < sum(r.base for r in RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *(count(r.kind) for r in RULES if r.base),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
