"""Helpers shared by the operators: shared folder, text batches, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes a task looks at together, unless one text is longer.
CHUNK_BYTES = 4 << 20
#: Words of 64 bits of a Bloom filter; a power of two.
FILTER_WORDS = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    That is ``spark.checkpoint.dir``; where it is unset, the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder. Lost executors recompute nothing above it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def remainder(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % mod


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a piece have some ``limit`` bytes, or it has one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.uint64(FILTER_WORDS * 64 - 1)
    return h & size, (h >> np.uint64(32)) & size


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    a, b = _places(h)
    ok = (bits[a >> np.uint64(6)] >> (a & np.uint64(63))) & one
    return (ok & (bits[b >> np.uint64(6)] >> (b & np.uint64(63)))).astype(bool)


def filter_of(hashes: DataFrame) -> np.ndarray:
    """The Bloom filter of all of the column ``hash``; what comes to the driver is at most its own 2**20 words."""
    size = FILTER_WORDS * 64 - 1
    places = hashes.select(
        F.explode(
            F.array(F.col("hash").bitwiseAND(size), F.shiftrightunsigned("hash", 32).bitwiseAND(size))
        ).alias("p")
    )
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")
    )
    got = words.toPandas()
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def perhaps_in(column: str, values: DataFrame) -> Column:
    """Whether ``column`` is among the numbers that are the only column of ``values``: true where it is, and rarely elsewhere.

    A Bloom filter decides, so that rows with long texts which meet nothing need not be shuffled for a join that is
    exact. A fuller filter lets more through, and loses none.
    """
    hashes = values.select(F.xxhash64(F.col(values.columns[0]).cast("bigint")).alias("hash"))
    bits = values.sparkSession.sparkContext.broadcast(filter_of(hashes))

    @F.arrow_udf("boolean")
    def found(h: pa.Array) -> pa.Array:
        return pa.array(in_filter(bits.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return found(F.xxhash64(F.col(column).cast("bigint")))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_ROOT = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ROOT))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.multiply.accumulate(steps)
    return have[:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and the position after each text's last word.

    Vectorised: one running sum of byte values times powers of an odd number
    gives every word's polynomial by a difference.
    """
    joined = b" ".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0], before[1:] = True, space[:-1]
    starts, stops = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inverse = pow(_ROOT, -1, 1 << 64)
    values = _BYTE[_LOWER[raw] if lower else raw] * _powers("up", _ROOT, len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    h = (sums[stops] - sums[starts]) * _powers("down", inverse, len(raw))[starts]
    return mixed(h + (stops - starts).astype(np.uint64)), np.searchsorted(starts, ends)
