"""Near duplicates by MinHash, with tensored banding.

Two small collections of keys, each key made of a few minhashes, stand for all
their pairs: a table has the key (i, j) of every key i of the one collection and
j of the other. So 22 + 22 keys of 4 minhashes give 484 tables of 8 minhashes,
from 176 minhashes instead of 3,872. Two texts that share no key of the one or of
the other collection meet in no table, which settles most texts before any table
is filled.

Equal sets of shingles are one entry. First the tables (i, i) are used: in each
bucket one centre is compared with the others, which contracts large groups.
Then all tables are filled for entries that share keys with another group, and
entries of different groups are compared. Wherever two meet, the parities of
their shingles' hashes bound from below in how many shingles they differ. Two
that share many tables are a pair in the first few only. Pairs that pass are
compared by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oncemore.llm.common import as_bytes, chunks, mixed, stored, word_hashes
from oncemore.llm.simhash import components

#: Keys of a collection, and minhashes of a key. A pair with a similarity of 0.8 shares no table
#: with a probability of at most 2 * (1 - 0.8 ** DEPTH) ** SIDE, that is 1 in 50,000; of 0.85, 1 in 1,000,000.
SIDE, DEPTH = 22, 4
#: Words of 64 parities.
PARITIES = 8
#: A pair counts in tables before whose key fewer keys of either collection are equal, by 8 bits each. That those
#: of so many different keys are, before the first key that is equal, has a probability below 1 in 1,000,000.
FIRST = 3
#: Words of 8 keys' bits, for each collection.
LANES = -(-SIDE // 8)
#: Rounds in which the entries of a bucket are compared with one centre only.
STARS = 2
#: A centre's text is joined in so many copies at most.
COPIES = 64

_ODD = mixed(np.arange(1, 2 * SIDE * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACES = mixed(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text (of all its words where there are fewer), repeats included, and where each text's end."""
    words, stops = word_hashes(texts)
    starts = np.concatenate(([0], stops[:-1]))
    counts = stops - starts
    at = np.arange(max(len(words) - width + 1, 0))
    of = np.searchsorted(stops, at, side="right")
    at = at[at + width <= stops[of]] if len(at) else at
    runs = np.zeros(len(at), np.uint64)
    for k in range(width):
        runs += words[at + k] * _PLACES[k]
    runs, short = mixed(runs), (counts > 0) & (counts < width)
    if short.any():
        own = [mixed(np.sum(words[a:b] * _PLACES[: b - a], keepdims=True) + np.uint64(b - a))[0] for a, b in zip(starts[short], stops[short], strict=True)]
        at, runs = np.concatenate((at, starts[short])), np.concatenate((runs, np.array(own, np.uint64)))
        order = np.argsort(at, kind="stable")
        at, runs = at[order], runs[order]
    return runs, np.searchsorted(at, stops)


def minhash_keys(hashes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """2 * ``SIDE`` keys of each non-empty set; a row for each, in order. A key tells its collection and place."""
    first = np.concatenate(([0], stops[:-1]))
    first = first[first < stops]
    keys = np.zeros((len(first), 2 * SIDE), np.uint64)
    if not len(first):
        return keys
    for k, odd in enumerate(_ODD):
        key = k // DEPTH
        keys[:, key] = mixed(keys[:, key] + np.minimum.reduceat(hashes * odd, first) + odd)
    return keys


def lanes(keys: np.ndarray) -> np.ndarray:
    """Eight bits of each key, as 2 * ``LANES`` numbers."""
    bits = np.zeros((len(keys), 2, 8 * LANES), np.uint8)
    bits[:, :, :SIDE] = (keys & np.uint64(255)).reshape(-1, 2, SIDE)
    return bits.reshape(-1, 16 * LANES).view(np.int64)


def parities(hashes: np.ndarray) -> list[int]:
    """For each of 64 * ``PARITIES`` classes of hashes, whether the set has an odd number in it."""
    odd = np.bincount((hashes % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``row``, ``doc_id``, ``same`` (128 bits of the set), ``size``, ``keys``, ``lanes`` and ``odd`` (parities) of every text; no keys where the set is empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            hashes, stops = shingles(as_bytes(part.column("text")), width)
            keys = minhash_keys(hashes, stops)
            each = zip(keys.view(np.int64).tolist(), lanes(keys).tolist(), strict=True)
            same, sizes, own, short, odd, start = [], [], [], [], [], 0
            for stop in stops.tolist():
                whole = np.unique(hashes[start:stop])
                same.append(xxhash.xxh3_128_digest(whole.tobytes()))
                sizes.append(len(whole))
                key, lane = next(each) if stop > start else (None, None)
                own.append(key)
                short.append(lane)
                odd.append(parities(whole))
                start = stop
            longs = pa.list_(pa.int64())
            columns = [pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(x, longs) for x in (own, short, odd))]
            names = ["row", "doc_id", "same", "size", "keys", "lanes", "odd"]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *columns], names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row bigint, doc_id {kind}, same binary, size bigint, keys array<bigint>, lanes array<bigint>, odd array<bigint>"
    return docs.select("row", "doc_id", "text").mapInArrow(of, schema)


def _contested(rows: DataFrame, key: str) -> DataFrame:
    """Those ``rows`` (with ``root``) under whose ``key`` there are two roots."""
    ends = rows.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return rows.join(ends.where("lo <> hi").select(key), key, "left_semi")


def first_tables(entries: DataFrame) -> DataFrame:
    """``bucket``, ``row`` and ``root`` where an entry meets one of another root in a table (i, i)."""
    pairs = F.array(*(F.xxhash64(F.col("keys")[k], F.col("keys")[SIDE + k]) for k in range(SIDE)))
    return _contested(entries.select("row", "root", F.explode(pairs).alias("bucket")), "bucket")


def all_tables(entries: DataFrame) -> DataFrame:
    """``bucket``, ``i``, ``j``, ``row`` and ``root`` where an entry meets one of another root in any table (i, j).

    Keys that nobody of another root has are left out before the pairs are formed.
    """
    met = _contested(entries.select("row", "root", F.posexplode("keys").alias("place", "key")), "key")
    # At most 2 * SIDE keys an entry.
    key = F.struct("place", "key")
    sides = met.groupBy("row").agg(
        F.min("root").alias("root"),
        F.collect_list(F.when(F.col("place") < SIDE, key)).alias("one"),
        F.collect_list(F.when(F.col("place") >= SIDE, key)).alias("two"),
    )
    pairs = sides.select("row", "root", F.explode("one").alias("a"), "two").select("row", "root", "a", F.explode("two").alias("b"))
    bucket = F.xxhash64("a.key", "b.key").alias("bucket")
    filled = pairs.select(bucket, F.col("a.place").alias("i"), (F.col("b.place") - SIDE).alias("j"), "row", "root")
    return _contested(stored(filled, "tables"), "bucket")


def _may(a: str, b: str, percent: int) -> Column:
    """Whether two sets (prefixes of ``size`` and ``odd``) may share ``percent`` of their union.

    Every shingle of one set only turns one parity, so as many parities as
    differ, as many shingles do; and they may be no more than this share of both.
    """
    size = F.col(f"{a}size"), F.col(f"{b}size")
    differ = [F.bit_count(F.col(f"{a}odd")[k].bitwiseXOR(F.col(f"{b}odd")[k])) for k in range(PARITIES)]
    near = 100 * F.least(*size) >= percent * F.greatest(*size)
    return near & ((100 + percent) * sum(differ[1:], differ[0]) <= (100 - percent) * (size[0] + size[1]))


def _is_first(a: str, b: str) -> Column:
    """Whether fewer than ``FIRST`` keys of either collection are equal before those of the table (i, j), by their lanes."""
    upto = F.array(*(F.lit((1 << 8 * n) - 1 if n < 8 else -1) for n in range(9)))

    def folded(x: Column) -> Column:
        # The lowest bit of every byte: whether the byte has any.
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)))
        return x.bitwiseAND(F.lit(0x0101010101010101))

    def equal_before(side: int, place: Column) -> Column:
        n = place
        for w in range(LANES):
            differ = folded(F.col(f"{a}lanes")[side * LANES + w].bitwiseXOR(F.col(f"{b}lanes")[side * LANES + w]))
            before = F.element_at(upto, F.least(F.greatest(place - 8 * w, F.lit(0)), F.lit(8)) + 1)
            n = n - F.bit_count(differ.bitwiseAND(before))
        return n

    return (equal_before(0, F.col("i")) < FIRST) & (equal_before(1, F.col("j")) < FIRST)


def star_pairs(buckets: DataFrame, nth: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b``: the entry of least hash of every bucket, and each other one of another root. Hashes differ by ``nth``."""
    hashed = buckets.withColumn("h", F.xxhash64("row", F.lit(nth)))
    centre = hashed.join(hashed.groupBy("bucket").agg(F.min("h").alias("h")), ["bucket", "h"])
    centre = centre.select("bucket", *(F.col(c).alias(f"c_{c}") for c in ("row", "root", "size", "odd")))
    met = buckets.join(centre, "bucket").where((F.col("c_root") != F.col("root")) & _may("c_", "", percent))
    return met.select(F.col("c_row").alias("a"), F.col("row").alias("b")).distinct()


def all_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of entries of one bucket and different roots.

    Entries of a bucket's most frequent root need no comparison among
    themselves, so one of each pair is not of that root.
    """
    counted = buckets.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    major = counted.groupBy("bucket").agg(F.max_by("root", "n").alias("major"))
    few = buckets.join(major, "bucket").where("root <> major")
    few = few.select("bucket", "major", *(F.col(c).alias(f"c_{c}") for c in ("row", "root", "size", "lanes", "odd")))
    once = (F.col("root") == F.col("major")) | (F.col("c_row") < F.col("row"))
    may = (F.col("c_root") != F.col("root")) & once & _may("c_", "", percent) & _is_first("c_", "")
    met = few.join(buckets, "bucket").where(may)
    return met.select(F.col("c_row").alias("a"), F.col("row").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those ``pairs`` (``a``, ``b``: rows of ``texts``) whose sets of shingles share ``percent`` of their union.

    A centre of very many pairs meets them in several tasks, by a hash of the other row.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, one = None, None
        for batch in batches:
            for part in chunks(iter([batch]), "text_b"):
                a, text = part.column("a").to_pylist(), part.column("text_a")
                hashes, stops = shingles(as_bytes(part.column("text_b")), width)
                keep, start = [], 0
                for k, stop in enumerate(stops.tolist()):
                    if a[k] != held:
                        held, one = a[k], np.unique(shingles([text[k].as_py().encode()], width)[0])
                    two = np.unique(hashes[start:stop])
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(one) + len(two) - shared))
                    start = stop
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(COPIES)))
    centres = salted.select("a", "salt").distinct().join(texts.toDF("a", "text_a"), "a")
    both = salted.join(texts.toDF("b", "text_b"), "b").join(centres, ["a", "salt"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(of, "a bigint, b bigint")


def minhash_components(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Texts are linked if their sets of ``width``-word shingles share ``percent``
    of their union; ``component_id`` is the smallest doc_id reachable over
    links. Texts without words (null, empty, blank) have an empty set and are
    linked with nothing. Repeated rows come out as often as they went in. A row
    without doc_id gets its group's smallest, null if nobody there has one; it is
    kept only then. An empty table gives an empty table; other columns are not
    looked at.
    """
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    texts = numbered.select("row", "text")
    ids = stored(signatures(numbered, width), "signatures")
    worded = ids.where("size > 0")
    sets = stored(worded.groupBy("same").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), "sets")
    entries = stored(ids.join(sets.select("row"), "row", "left_semi").select("row", "size", "keys", "lanes", "odd"), "entries")
    roots = entries.select("row", F.col("row").alias("root")).limit(0)
    for nth in range(STARS + 1):
        rooted = entries.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
        met = first_tables(rooted) if nth < STARS else all_tables(rooted)
        buckets = stored(met.join(entries.drop("keys") if nth == STARS else entries.drop("keys", "lanes"), "row"), "buckets")
        met = star_pairs(buckets, nth, percent) if nth < STARS else all_pairs(buckets, percent)
        links = stored(confirmed(stored(met, "candidates"), texts, width, percent), "links")
        roots = stored(components(links.union(roots.toDF("a", "b"))).toDF("row", "root"), "roots")
    rooted = sets.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = rooted.join(least, "root").select("same", "component_id")
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = ids.join(named, "same", "left").select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
