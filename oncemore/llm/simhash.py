"""Near duplicates by SimHash, with multi-index hashing.

A text's fingerprint has one or more words of 64 bits. Every word is cut into
segments. A table holds each fingerprint under each of its segments' values; a
probe walks the Hamming ball of small radius around its own value, and whatever
it meets there is compared over all bits.

Rows work on distinct fingerprints, so copies cost one row however many there
are. A flip of bits is probed from one side only (the side whose lowest flipped
bit is 0), and a pair is reported by its first matching segment only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oncemore.llm.common import as_bytes, chunks, mixed, perhaps_in, stored


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True))
    return np.fromiter(hashes, np.uint64, len(starts))


def simhash(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` signed 64-bit integers; the first uses the hashes as they are, each other a mix of them."""
    out = []
    for k in range(words):
        h = mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) if k else hashes
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(h)).view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1, keep: str = "doc_id") -> DataFrame:
    """``keep`` and ``fp``, an array of ``words`` integers. Null and wordless texts have fingerprint zero."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            fps = [simhash(shingle_hashes(text, width), words) for text in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column(keep), pa.array(fps, pa.list_(pa.int64()))], [keep, "fp"])

    kind = dict(docs.dtypes)[keep]
    return docs.select(keep, "text").mapInArrow(of, f"`{keep}` {kind}, fp array<bigint>")


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _segments(words: int, per_word: int) -> list[tuple[int, int, int]]:
    """(word, offset, width) of each segment."""
    edges = [64 * i // per_word for i in range(per_word + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(edges, edges[1:], strict=False)]


def _value(fp: Column, part: tuple[int, int, int]) -> Column:
    word, offset, width = part
    return F.shiftrightunsigned(fp[word], offset).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _table(fps: DataFrame, parts: list[tuple[int, int, int]], *keep: str) -> DataFrame:
    """A row for each segment of each fingerprint."""
    values = F.array(*(_value(F.col("fp"), p) for p in parts))
    return fps.select("fp", *keep, F.posexplode(values).alias("seg", "val"))


def _distance(a: Column, b: Column, words: int) -> Column:
    differ = [F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(words)]
    return sum(differ[1:], differ[0])


def hamming_links(
    fps: DataFrame,
    distance: int,
    words: int = 1,
    segments: int = 3,
    radius: int | None = None,
    apart: str | None = None,
    name: str = "fp",
) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``) that differ in at most ``distance`` bits.

    ``a`` and ``b`` are the fingerprints, or their values of the column ``name``.

    ``radius`` is the ball's radius in a segment. By default it is the smallest
    with which no pair can be missed (``distance // number of segments``). With
    ``apart`` only pairs that differ in that column count.
    """
    parts = _segments(words, segments)
    radius = distance // len(parts) if radius is None else radius
    keep = [c for c in (apart, name) if c not in (None, "fp")]
    table = _table(fps, parts, *keep)
    masks = F.array(*(F.lit(m).cast("bigint") for m in ball(max(p[2] for p in parts), radius)))
    own = F.filter(masks, lambda m: F.col("val").bitwiseAND(m).bitwiseAND(-m) == 0)
    probes = table.select(
        F.col("fp").alias("fp_a"),
        F.col("seg").alias("seg_a"),
        "val",
        *(F.col(k).alias(f"{k}_a") for k in keep),
        F.explode(own).alias("mask"),
    )
    probes = probes.withColumns({"val_a": F.col("val").bitwiseXOR(F.col("mask")), "same": F.col("mask") == 0}).drop("val", "mask")
    a, b = F.col("fp_a"), F.col("fp")
    first = F.lit(len(parts))
    for k, p in reversed(list(enumerate(parts))):
        first = F.when(F.bit_count(_value(a, p).bitwiseXOR(_value(b, p))) <= radius, k).otherwise(first)
    met = (
        (F.col("seg_a") == F.col("seg"))
        & (F.col("val_a") == F.col("val"))
        & (_distance(a, b, words) <= distance)
        & (~F.col("same") | (a < b))
        & (first == F.col("seg"))
    )
    if apart:
        met = met & (F.col(f"{apart}_a") != F.col(apart))
    return probes.join(table, met).select(F.col(f"{name}_a").alias("a"), F.col(name).alias("b"))


def star_links(fps: DataFrame, distance: int, words: int, segments: int) -> DataFrame:
    """Pairs ``a``, ``b`` (values of ``row``) of each fingerprint and two of those with which it shares a segment's value, within ``distance``.

    The two have the least and the greatest hash there. A group of any size
    gives twice as many pairs as it has members and segments, at most.
    """
    parts = _segments(words, segments)
    table = _table(fps, parts, "row")
    own = F.struct(F.xxhash64("fp", "row").alias("h"), F.col("fp").alias("fp_b"), F.col("row").alias("row_b"))
    ends = table.groupBy("seg", "val").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi")
    met = table.join(ends, ["seg", "val"]).select("fp", "row", F.inline(F.array("lo", "hi")))
    met = met.where((F.col("row") != F.col("row_b")) & (_distance(F.col("fp"), F.col("fp_b"), words) <= distance))
    return met.select(F.least("row", "row_b").alias("a"), F.greatest("row", "row_b").alias("b")).distinct()


def _cells_of(fp: np.ndarray, parts: list[tuple[int, int, int]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's value of the fingerprints (rows of ``fp``), and a function of value and segment to a cell."""
    values = [fp[:, w].view(np.uint64) >> np.uint64(a) & np.uint64((1 << n) - 1) for w, a, n in parts]

    def cell(value: np.ndarray, seg: int) -> np.ndarray:
        return (mixed(value + np.uint64((seg + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    return values, cell


def _fps_of(batch: pa.RecordBatch, words: int) -> np.ndarray:
    return batch.column("fp").flatten().to_numpy(zero_copy_only=False).reshape(-1, words)


def met_cells(fps: DataFrame, parts: list[tuple[int, int, int]], words: int, bits: int) -> np.ndarray:
    """For each of ``1 << bits`` cells, how many segment values of ``fps`` fall there: 0, 1, or 2 for more."""
    piece = 1 << 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            values, cell = _cells_of(_fps_of(batch, words), parts, bits)
            for seg, value in enumerate(values):
                cells, n = np.unique(cell(value, seg), return_counts=True)
                counts[cells] = np.minimum(counts[cells] + n, 2)
        for k, part in enumerate(counts.reshape(-1, piece)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "cells": [part.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column("piece").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                part = np.frombuffer(cells, np.uint8)
                total[k] = np.minimum(total[k] + part, 2) if k in total else part
        for k, part in total.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "cells": [part.tobytes()]})

    schema = "piece int, cells binary"
    out = np.zeros((max((1 << bits) // piece, 1), piece), np.uint8)
    for k, cells in fps.select("fp").mapInArrow(fill, schema).repartition("piece").mapInArrow(add, schema).collect():
        out[k] = np.frombuffer(cells, np.uint8)
    return out.ravel()


def ball_links(sets: DataFrame, distance: int, words: int, segments: int, radius: int) -> DataFrame:
    """Pairs ``a``, ``b`` (values of ``row``) of fingerprints of different ``root`` that the Hamming balls of their segments' values join, within ``distance``.

    With s segments in all, every two fingerprints that differ in fewer than s * (``radius`` + 1) bits meet. Of the members
    of a root that meet others under one value, the first row is compared. A task walks
    the balls against a table of cells that say which values are there at all; only what hits one is shuffled.
    """
    parts = _segments(words, segments)
    bits = min(max((16 * len(parts) * sets.count()).bit_length(), 16), MOST_BITS)
    cells = sets.sparkSession.sparkContext.broadcast(met_cells(sets, parts, words, bits))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = cells.value
        for batch in batches:
            values, cell = _cells_of(_fps_of(batch, words), parts, bits)
            for seg, value in enumerate(values):
                for mask in map(np.uint64, ball(parts[seg][2], radius)):
                    lowest = mask & (~mask + np.uint64(1))
                    other = value ^ mask
                    # A flip is probed by the side whose lowest flipped bit is 0; a value's own cell needs another in it.
                    hit = np.flatnonzero((value & lowest == 0) & (there[cell(other, seg)] > (0 if mask else 1)))
                    if len(hit):
                        at = pa.array(hit)
                        columns = [batch.column(c).take(at) for c in ("row", "root")]
                        own = pa.array(np.full(len(hit), seg, np.int32))
                        yield pa.RecordBatch.from_arrays([*columns, own, pa.array(other[hit].view(np.int64))], ["row", "root", "seg", "val"])

    def one_a_root(rows: DataFrame) -> DataFrame:
        return rows.groupBy("seg", "val", "root").agg(F.min("row").alias("row"))

    probes = one_a_root(sets.select("row", "root", "fp").mapInArrow(walk, "row bigint, root bigint, seg int, val bigint"))
    table = one_a_root(_table(sets, parts, "row", "root")).toDF("seg", "val", "root_b", "row_b")
    met = probes.join(table, ["seg", "val"]).where("root <> root_b")
    met = met.select(F.least("row", "row_b").alias("a"), F.greatest("row", "row_b").alias("b")).distinct()
    fps = sets.select("row", "fp")
    both = met.join(fps.toDF("a", "fp_a"), "a").join(fps.toDF("b", "fp_b"), "b")
    return both.where(_distance(F.col("fp_a"), F.col("fp_b"), words) <= distance).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of the pairs ``a``, ``b``.

    Alternates large-star and small-star steps until the edges stay as they
    are; each round is a written table.
    """
    spark = links.sparkSession
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        ends = F.explode(F.array("hi", "lo")).alias("end")
        small = large.join(roots, "hi").select(ends, "m").where("end <> m").distinct()
        edges = stored(small.toDF("hi", "lo"), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    pairs = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return pairs.union(edges.select("lo", "lo")).distinct()


def grouped_by_links(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``ids`` (doc_id, fp) with ``component_id``: the smallest doc_id of all fingerprints linked, over any way.

    Rows without doc_id get their group's id, null if nobody there has one.
    """
    root = components(links)
    per_fp = ids.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = per_fp.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = comp.groupBy("root").agg(F.min("least").alias("component_id"))
    return ids.join(comp.select("fp", "root").join(least, "root").drop("root"), "fp")


def simhash_components(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``.

    Null, empty and wordless texts share fingerprint zero and are linked like
    any other. Repeated rows come out as often as they went in. Other columns
    are not looked at. An empty table gives an empty table.
    """
    ids = stored(fingerprints(docs, width), "fingerprints")
    links = stored(hamming_links(ids.select("fp").distinct(), distance), "links")
    grouped = grouped_by_links(ids, links)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: Stars of near duplicates by five-word shingles: 256 bits, of which 60 may differ before the shingles are compared.
WORDS, DISTANCE, SEGMENTS = 4, 60, 3
#: Segments of a word, and the radius of the balls that are walked in each, after the stars: fingerprints that differ in
#: 15 bits or less meet there.
WALKED, RADIUS = 2, 1
#: Cells of the table that balls are walked against, as a power of two, at most (a byte each); a fuller one lets more through.
MOST_BITS = 26
#: Words of 64 parities of a set of shingles.
PARITIES = 16
#: Shingles whose frequency is known to the search, at most; the others count as rare. Only the speed depends on it.
COMMON = 250_000


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that recur most among texts looked at together, in order, and how often they do. At most ``COMMON``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = [np.unique(shingle_hashes(text, width)) for text in as_bytes(part.column("text"))]
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            many = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many])], ["h", "n"])

    each = docs.select("text").mapInArrow(of, "h bigint, n bigint")
    top = each.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["n"].to_numpy(np.int64)[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest of a set of ``shingles``, so many that a set as similar has one of its own among them."""
    if not len(shingles):
        return shingles
    known, counts = common
    times = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        times = np.where(known[at] == shingles, counts[at], 0)
    n = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    return shingles[np.lexsort((shingles, times))[:n]]


def parities(shingles: np.ndarray) -> list[int]:
    """Whether the number of ``shingles`` is odd in each of ``64 * PARITIES`` cells, as signed integers."""
    counts = np.bincount((shingles % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits(counts % 2 == 1).view(np.int64).tolist()


def prefixes(docs: DataFrame, width: int, similarity: float, common) -> DataFrame:
    """``row``, ``same``, ``fp``, ``size`` (different shingles), ``odd`` and ``prefix`` of every text. ``common`` is a broadcast.

    ``same`` is a hash of 128 bits of the set of shingles, ``odd`` its parities.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            same, fps, sizes, odd, rare = [], [], [], [], []
            for text in as_bytes(part.column("text")):
                different = np.unique(shingle_hashes(text, width))
                same.append(xxhash.xxh3_128_digest(different.tobytes()))
                fps.append(simhash(different, WORDS))
                sizes.append(len(different))
                odd.append(parities(different))
                rare.append(prefix(different, common.value, similarity).view(np.int64))
            longs = pa.list_(pa.int64())
            columns = [pa.array(same, pa.binary()), pa.array(fps, longs), pa.array(sizes, pa.int32())]
            columns += [pa.array(odd, longs), pa.array(rare, longs)]
            yield pa.RecordBatch.from_arrays([part.column("row"), *columns], ["row", "same", "fp", "size", "odd", "prefix"])

    schema = "row bigint, same binary, fp array<bigint>, size int, odd array<bigint>, prefix array<bigint>"
    return docs.select("row", "text").mapInArrow(of, schema)


def contested(sets: DataFrame) -> DataFrame:
    """``row``, ``pos`` and ``shingle`` of every shingle that prefixes of several ``sets`` have.

    The others meet nobody. All shingles are shuffled once for it.
    """
    each = sets.select("row", F.posexplode("prefix").alias("pos", "shingle"))
    several = F.count("*").over(Window.partitionBy("shingle"))
    return each.withColumn("n", several).where("n > 1").drop("n")


def one_per_root(met: DataFrame) -> DataFrame:
    """Of the rows of ``met`` that a root has under one shingle, that where it is rarest."""
    first = F.min(F.struct("pos", "row", "size")).alias("first")
    return met.groupBy("shingle", "root").agg(first).select("shingle", "root", "first.*")


def prefix_links(met: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``a``, ``b`` (``row``) of different ``root`` whose sets may be as similar; each pair once.

    ``met`` has ``shingle``, ``row``, ``root``, ``size`` and ``pos``, the place in the row's prefix. Two such sets share a
    shingle of their prefixes. Where two meet, their places bound what they can share if it is their first
    shingle; at the first, the bound holds. Under each shingle the rows of the root that has most there do not meet each other.
    """
    roots = met.groupBy("shingle", "root").agg(F.struct(F.count("*").alias("n"), "root").alias("own"))
    most = roots.groupBy("shingle").agg(F.max("own")["root"].alias("most"), F.count("*").alias("n")).where("n > 1").drop("n")
    less = met.join(most, "shingle").where("root <> most").drop("most")
    one, two = (of.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("row", "root", "size", "pos"))) for of, x in ((less, "a"), (met, "b")))
    left = [F.col(f"size_{x}") - F.col(f"pos_{x}") for x in "ab"]
    least = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-9
    both = one.join(two, "shingle").where(
        (F.col("root_a") != F.col("root_b"))
        & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9)
        & (F.least(*left) >= least)
    )
    return both.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    """Each row of the ``pairs`` once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct()


def possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` without those whose ``size`` and ``odd`` rule the similarity out; none that has it goes.

    A shingle that only one of two sets has turns one parity, so as many parities as differ, as many such shingles
    there are, and they may be no more than a share of both sizes. ``pairs`` is read twice.
    """
    sets = sets.select("row", "size", "odd").where(perhaps_in("row", ends(pairs)))
    both = pairs.join(sets.toDF("a", "size_a", "odd_a"), "a").join(sets.toDF("b", "size_b", "odd_b"), "b")
    differ = _distance(F.col("odd_a"), F.col("odd_b"), PARITIES)
    most = (1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-9
    return both.where(differ <= most).select("a", "b")


def similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those ``pairs`` (``a``, ``b``: rows of ``texts``) whose sets of shingles are as similar.

    Only the texts of pairs are shuffled. ``pairs`` is read twice.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(as_bytes(part.column("text_a")), as_bytes(part.column("text_b")), strict=True):
                one, two = (np.unique(shingle_hashes(t, width)) for t in (x, y))
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(common > 0 and common >= similarity * (len(one) + len(two) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = texts.where(perhaps_in("row", ends(pairs)))
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(of, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``row``, ``doc_id``, ``group`` (a row number of the group) and ``keep`` for every row of ``docs``.

    ``docs`` needs ``row``, a unique number. Texts count as near duplicates if
    the Jaccard similarity of their sets of ``width``-word shingles reaches
    ``similarity``. All such pairs are found: any two share one of their rarest
    shingles (``prefix_links``). Of each group the smallest doc_id stays (null last), and of
    its rows the one with the smallest number. Texts without words (null, empty
    or blank) are copies of each other.

    A first round compares every text with two of each of its segments'
    tables (256-bit fingerprints); a large group of variants mostly falls together there, with as many
    comparisons as it has members. A second round is multi-index hashing with Hamming balls between
    the groups (``ball_links``). No radius that can be walked reaches all texts of the similarity, so
    the exact search then takes the pairs that are in different groups still: first one row a group under each shingle,
    as one link joins two groups, then all pairs of what is apart after that.
    """
    texts = docs.select("row", "text")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    ids = stored(prefixes(texts, width, similarity, common), "prefixes")
    # Rows of one set of shingles are one group; all others are compared.
    per_set = stored(ids.groupBy("same").agg(F.min("row").alias("row")), "per_set")
    sets = ids.join(per_set.select("row"), "row", "left_semi").drop("same")

    def verified(links: DataFrame, name: str) -> DataFrame:
        likely = stored(possible(links, ids, similarity), "likely")
        return stored(similar(likely, texts, width, similarity), name)

    stars = verified(stored(star_links(sets.select("fp", "row"), DISTANCE, WORDS, SEGMENTS), "links"), "star_pairs")
    roots = stored(components(stars), "star_groups")

    def grouped(groups: DataFrame, *columns: str) -> DataFrame:
        rows = sets.select("row", *columns).join(groups.toDF("row", "root"), "row", "left")
        return rows.withColumn("root", F.coalesce("root", "row"))

    own = stored(grouped(roots, "fp"), "fingerprints")
    walked = verified(stored(ball_links(own, DISTANCE, WORDS, WALKED, RADIUS), "links"), "ball_pairs")
    roots = stored(components(walked.union(roots.toDF("a", "b"))), "ball_groups")
    # A copy that the filter lets through drops out when its row finds no group.
    met = stored(contested(ids.where(perhaps_in("row", per_set.select("row")))), "contested")
    between = stored(prefix_links(one_per_root(met.join(grouped(roots, "size"), "row")), similarity), "links")
    linked = verified(between, "group_pairs")
    roots = stored(components(linked.union(roots.toDF("a", "b"))), "linked_groups")
    apart = prefix_links(met.join(grouped(roots, "size"), "row"), similarity)
    pairs = verified(stored(apart.join(between, ["a", "b"], "left_anti"), "links"), "pairs")
    root = components(pairs.union(roots.toDF("a", "b"))).toDF("least", "root")
    comp = per_set.withColumnRenamed("row", "least").join(root, "least", "left")
    comp = comp.select("same", F.coalesce("root", "least").alias("group"))
    members = ids.join(comp, "same").select("row", "group").join(docs.select("row", "doc_id"), "row")
    best = members.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "row")).alias("best"))
    return members.join(best, "group").select("row", "doc_id", "group", (F.col("row") == F.col("best")["row"]).alias("keep"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
