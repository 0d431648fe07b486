"""Benchmark passages in documents, found by spaced seeds.

A mask such as ``1001110111`` is laid over every run of words; the words under
its ones are hashed, those under its zeros are free to differ. Documents and
benchmark items that share a hash are compared word by word along the diagonal
of the hit, which tolerates substitutions anywhere.

The hashes of all documents are never shuffled. The items' hashes first go into
a Bloom filter of fixed size (8 MB); only documents that touch it are kept, and
only their touching hashes are joined with the items. A fuller filter lets more
hashes through to the join and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oncemore.llm.common import as_bytes, chunks, filter_of, in_filter, mixed, stored, word_hashes

#: Masks of seven words. Every run of 13 words or more of which four fifths are equal has one of them, wherever the
#: others are: all ways for 2 others in 13 words, 3 in 15, 4 in 20 and 5 in 25 are covered, and a longer run has such a part.
MASKS = ("11101111", "11010010111", "111110011", "101100010111", "111010001011", "1111111", "1001110111")
#: An overlap has as many words at least ...
MIN_TOKENS = 13
#: ... of which as large a share is equal.
SIMILARITY = 0.8


def seeds(hashes: np.ndarray, ends: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word (counted over all texts) of every placement of ``mask`` within a text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.full(n, len(mask) * 0x1F3 + int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += hashes[k : k + n] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)
    text = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.flatnonzero(np.arange(n) + len(mask) <= ends[text])
    return mixed(total[inside]), text[inside], inside


def _row_ids(start: int, n: int) -> pa.Array:
    return pa.array((TaskContext.get().partitionId() << 33) + np.arange(start, start + n), pa.int64())


def _seeded(df: DataFrame, key: str, masks: tuple[str, ...], filter_bits=None) -> DataFrame:
    """``row``, ``key``, ``txt`` (hash of the text), ``tokens`` and ``hits`` of the texts that have a seed.

    With ``filter_bits`` only seeds in the filter count.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filter_bits is None else filter_bits.value
        done = 0
        for part in chunks(batches, "text"):
            hashes, ends = word_hashes(as_bytes(part.column("text")))
            found = []
            for m, mask in enumerate(masks):
                h, text, at = seeds(hashes, ends, mask)
                if bits is not None:
                    ok = np.flatnonzero(in_filter(bits, h))
                    h, text, at = h[ok], text[ok], at[ok]
                found.append((h, text, at, np.full(len(h), m)))
            h, text, at, m = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(text, kind="stable")
            h, text, at, m = h[order], text[order], at[order], m[order]
            starts = np.concatenate(([0], ends[:-1]))
            rows, cuts = np.unique(text, return_index=True)
            hits = pa.StructArray.from_arrays(
                [pa.array(m, pa.int32()), pa.array(h.view(np.int64)), pa.array(at - starts[text], pa.int32())],
                ["mask", "hash", "pos"],
            )
            tokens = [hashes[starts[r] : ends[r]].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    _row_ids(done, part.num_rows).take(pa.array(rows)),
                    part.column(key).take(pa.array(rows)),
                    part.column("txt").take(pa.array(rows)),
                    pa.array(tokens, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(cuts, len(h)), pa.int32()), hits),
                ],
                ["row", key, "txt", "tokens", "hits"],
            )
            done += part.num_rows

    kind = dict(df.dtypes)[key]
    schema = f"row bigint, `{key}` {kind}, txt bigint, tokens binary, hits array<struct<mask: int, hash: bigint, pos: int>>"
    return df.select(key, "text", F.xxhash64("text").alias("txt")).mapInArrow(of, schema)


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, similarity: float) -> tuple[int, int, int]:
    """Start in the document, length and equal words of the longest run with document word ``shift + i`` under item word ``i``.

    Of all runs of which at least the share ``similarity`` is equal, this is the longest, and the first of those.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[low + shift : high + shift] == item[low:high]
    if not same.any():
        return low + shift, 0, 0
    # A run has the share if its sum of (equal - share) is not negative.
    sums = np.concatenate(([0.0], np.cumsum(same) - similarity * np.arange(1, len(same) + 1)))
    # For each start the last stop whose sum is as great: the greatest sum from a stop on falls as stops go up.
    later = np.maximum.accumulate(sums[::-1])[::-1]
    stops = np.searchsorted(-later, 1e-9 - sums, side="right") - 1
    start = int((stops - np.arange(len(sums))).argmax())
    stop = int(stops[start])
    return low + shift + start, stop - start, int(same[start:stop].sum())


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_tokens: int = MIN_TOKENS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """One row per document row and benchmark item that overlap.

    Columns: ``doc_id``, ``txt`` (xxhash64 of the document's text), ``item_id``,
    ``doc_start`` (word), ``n_tokens``, ``n_same``, and ``coverage``, the part of
    the item's words that is equal. Words are compared with A-Z in lower case. An overlap
    has ``min_tokens`` words or more, of which the share ``similarity`` is equal.
    Texts and items that are null, empty or shorter than that overlap nothing.
    Repeated rows are reported as often as they occur. An empty document or
    benchmark table gives an empty table; other columns are not looked at.
    """
    spark = docs.sparkSession
    items = stored(_seeded(benchmark, "item_id", masks), "items")
    item_seeds = items.select("row", F.explode("hits").alias("hit")).select(F.col("row").alias("item_row"), "hit.*")
    bits = spark.sparkContext.broadcast(filter_of(item_seeds))
    flagged = stored(_seeded(docs, "doc_id", masks, bits), "flagged")
    doc_seeds = flagged.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    hits = doc_seeds.join(item_seeds.withColumnRenamed("pos", "item_pos"), ["mask", "hash"])
    diagonals = hits.select("row", "item_row", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    pairs = diagonals.join(
        items.select(F.col("row").alias("item_row"), "item_id", F.col("tokens").alias("item_tokens")), "item_row"
    ).join(flagged.select("row", "doc_id", "txt", "tokens"), "row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cells = (part.column(c).to_pylist() for c in ("tokens", "item_tokens", "diagonal"))
            out = []
            for doc, item, shift in zip(*cells, strict=True):
                item = np.frombuffer(item, np.uint64)
                out.append((*best_overlap(np.frombuffer(doc, np.uint64), item, shift, similarity), len(item)))
            start, n, same, size = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
            ok = pa.array((n >= min_tokens) & (same >= similarity * n - 1e-9))
            columns = [part.column(c) for c in ("row", "doc_id", "txt", "item_row", "item_id")]
            columns += [pa.array(x) for x in (start, n, same)] + [pa.array(same / np.maximum(size, 1))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(ok)

    names = ["row", "doc_id", "txt", "item_row", "item_id", "doc_start", "n_tokens", "n_same", "coverage"]
    kinds = dict(docs.dtypes) | {"item_id": dict(benchmark.dtypes)["item_id"], "coverage": "double"}
    kinds = {n: kinds[n] if n in ("doc_id", "item_id", "coverage") else "bigint" for n in names}
    found = pairs.select("row", "doc_id", "txt", "item_row", "item_id", "tokens", "item_tokens", "diagonal").mapInArrow(
        verify, ", ".join(f"{n} {k}" for n, k in kinds.items())
    )
    best = F.max(F.struct("n_same", "n_tokens", (-F.col("doc_start")).alias("before"), "coverage")).alias("best")
    per_pair = found.groupBy("row", "doc_id", "txt", "item_row", "item_id").agg(best)
    return per_pair.select(
        "doc_id",
        "txt",
        "item_id",
        (-F.col("best.before")).alias("doc_start"),
        "best.n_tokens",
        "best.n_same",
        "best.coverage",
    )


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ).drop("txt")
