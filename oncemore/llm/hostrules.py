"""Quality rules by host.

Each document is held against a few rules. A host's failures of a rule are a
binomial count; a beta distribution fitted to all hosts' rates is the prior that
its rate is shrunk by, so that a host of three pages is judged mildly and one of
three million by its own record. A document stays if it passes the base rule
and its host passes all rules.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oncemore.llm.common import as_bytes, chunks, stored

WINDOW = 8
#: Signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: A host is rejected if its shrunk rate of failures of any rule is above this.
MOST_FAILURES = 0.5
#: Rows of a host's verdict; a host's documents are dealt over them.
SALTS = 32

#: Name of each rule and its failure, from the counts of ``measures``.
RULES: dict[str, str] = {
    "short": "n_words < 20",
    "repeated": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}


def repeated_words(words: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words in windows that occur twice or more in it; ``words`` are numbers of words, equal for equal words.

    A window's number is the rank of its halves' numbers, so windows are
    compared exactly. ``window`` is a power of two.
    """
    rank, width = words, 1
    while width < window and len(rank) > width:
        rank = np.unique(rank[:-width] * (int(rank.max()) + 1) + rank[width:], return_inverse=True)[1]
        width *= 2
    out = np.zeros(len(ends), np.int64)
    n = len(words) - window + 1
    if n <= 0:
        return out
    at = np.arange(n)
    text = np.searchsorted(ends, at, side="right")
    inside = at + window <= ends[text]
    at, text = at[inside], text[inside]
    _, of, times = np.unique(text * (int(rank.max()) + 1) + rank[at], return_inverse=True, return_counts=True)
    twice = at[times[of] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    covered = np.flatnonzero(np.cumsum(cover)[:-1])
    np.add.at(out, np.searchsorted(ends, covered, side="right"), 1)
    return out


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts ``n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words`` of each text."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            number: dict = defaultdict(count().__next__)
            words, rows = [], []
            for text in as_bytes(part.column("text")):
                own = text.split()  # bytes.split() knows just the six white-space characters
                words.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
                # Continuation bytes of UTF-8 are not code points.
                joined = np.frombuffer(b"".join(own), np.uint8)
                lines = [line for line in text.split(b"\n") if line.strip()]
                rows.append((
                    len(own),
                    int(np.count_nonzero((joined & 0xC0) != 0x80)),
                    sum(text.count(c) for c in SYMBOLS),
                    len(lines),
                    len(lines) - len(set(lines)),
                ))
            ends = np.cumsum([len(w) for w in words])
            repeats = repeated_words(np.concatenate(words), ends)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + [pa.array(repeats)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns], [*keep, *names])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{n} bigint" for n in names)])
    return docs.select(*keep, "text").mapInArrow(of, schema)


def priors(hosts: DataFrame, rules: dict[str, str]) -> dict[str, tuple[float, float]]:
    """Alpha and beta of each rule, by moments of the hosts' rates, a host weighing its documents.

    Their sum is at least 2 (a uniform prior's) and at most 1,000; it is 2 where the rates do not
    differ enough to tell or there are fewer than two hosts.
    """
    total = F.sum("n")
    aggs = [total.alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("hosts")]
    for r in rules:
        aggs += [F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq")]
    row = hosts.agg(*aggs).first()
    out = {}
    for r in rules:
        if not row["n"]:
            out[r] = (1.0, 1.0)
            continue
        n, mean = row["n"], row[r] / row["n"]
        # Between-host sum of squares, and what binomial noise alone would give.
        between = row[f"{r}_sq"] - n * mean * mean
        noise = mean * (1 - mean)
        spread = n - row["nn"] / n
        variance = (between - (row["hosts"] - 1) * noise) / spread if spread > 0 else 0.0
        size = noise / variance - 1 if variance > 0 else (1000.0 if row["hosts"] > 1 and noise > 0 else 2.0)
        size = min(max(size, 2.0), 1000.0)
        mean = min(max(mean, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
        out[r] = (mean * size, (1 - mean) * size)
    return out


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; what is no URL is its own host; null stays null."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host == "", url).otherwise(host)


def host_verdicts(
    measured: DataFrame, host: str, rules: dict[str, str] = RULES, most: float = MOST_FAILURES
) -> DataFrame:
    """``host``, ``n``, the failures and ``<rule>_rate`` (shrunk) of each rule, and ``passes``."""
    failed = [F.sum(F.expr(f"CASE WHEN {sql} THEN 1 ELSE 0 END")).alias(r) for r, sql in rules.items()]
    hosts = stored(measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *failed), "hosts")
    fitted = priors(hosts, rules)
    rates = {f"{r}_rate": (F.col(r) + a) / (F.col("n") + a + b) for r, (a, b) in fitted.items()}
    return hosts.withColumns(rates).withColumn("passes", F.greatest(*(F.lit(0.0), *(F.col(r) for r in rates))) <= most)


def host_rules(docs: DataFrame, host: str = "source", rules: dict[str, str] = RULES, most: float = MOST_FAILURES) -> DataFrame:
    """The counts of every row of ``docs`` with ``base_failed``, ``host_passes`` and ``kept``.

    Null, empty and wordless texts have zero words and fail the base rule. Rows
    without a host form a host of their own. Repeated rows come out as often as they went
    in and count each. An empty table gives an empty table. Columns other than doc_id, text
    and ``host`` are not looked at.
    """
    rows = docs.select("doc_id", "text", F.col(host).alias("host"))
    measured = stored(measures(rows, ["doc_id", "host"]), "measures")
    verdicts = host_verdicts(measured, "host", rules, most).select(F.col("host").alias("h"), "passes")
    # A host may hold a third of all rows: its rows are dealt over copies of the verdict.
    dealt = verdicts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(dealt, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")))
    base = F.expr(f"({RULES['short']}) OR ({RULES['repeated']})")
    return joined.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        F.col("passes").alias("host_passes"),
        (~base & F.col("passes")).alias("kept"),
    )


def op3_host_rules(spark, sf_dir: str) -> DataFrame:
    rules = host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rules.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_passes"
    )
