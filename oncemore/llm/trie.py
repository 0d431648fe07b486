"""The prefix trie of conversations, with count-min screening of prefix digests.

A prefix is known by its depth and 128 bits: the XOR of a hash of each turn with
its place, a running value that adds up in any order. A count-min sketch of all
prefixes never counts too few. Where it says one, the prefix occurs once, and so
does all that follows: such a tail is finished where it stands. Only prefixes
that may be shared are shuffled and counted exactly.

Figures over subtrees need no walk over the trie. The smallest member of a node
owns it. What a conversation owns is the end of its path, so a node's subtree is
the rest of its owner's path and everything that its other members own: sums
over the members, by the same grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oncemore.llm.common import mixed, stored

#: Rows of the sketch, and cells of a row: four for each prefix, within these bounds. A sketch that is
#: too small lets more prefixes through to the exact count, and changes no figure.
ROWS, LEAST_CELLS, MOST_CELLS = 3, 1 << 16, 1 << 22
#: Cells of a piece of the sketch.
PIECE = 1 << 16
#: Turns of a conversation that one task adds up.
BLOCK = 4096
#: Tasks that look up one node, at most.
COPIES = 64
#: Characters of conversation ids that are joined before they are hashed.
JOINED = 1 << 16

NODE = ["depth", "x1", "x2"]
_SEEDS = mixed(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1, by turn, null first), ``one``, ``two`` (hashes of role and text), ``chars``.

    Turns of one number are ordered by hash. Rows without conv_id belong to no
    conversation. The rows are dealt by a range of all their order, so a
    conversation of any length is spread over tasks.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        F.xxhash64(role, text).alias("one"),
        F.xxhash64(F.lit(2), text, role).alias("two"),
        F.length(text).cast("bigint").alias("chars"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "one", "two"]
    dealt = stored(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    within = Window.partitionBy("part", "conv_id").orderBy(*order[1:])
    parts = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part", "conv_id").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(parts))
    # One conversation a part, at most, has turns in an earlier part.
    before = before.where("before > 0").select("part", "conv_id", "before")
    placed = dealt.withColumn("place", F.row_number().over(within)).join(F.broadcast(before), ["part", "conv_id"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "one", "two", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with their heads replaced: the turns (columns as of ``numbered``), and ``conv_id`` and ``len`` of each.

    The first h turns of conversation c are those of c - c % ``group`` (as many
    as it has), with h the crc32 of c modulo ``most``. As in SQL, the remainder
    has the sign of c.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    lengths = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    convs = lengths.select("conv_id", "n", h, base).join(lengths.toDF("base", "base_n"), "base", "left")
    convs = convs.withColumn("got", F.least("h", F.coalesce("base_n", F.lit(0))))
    # A base has ``group`` conversations and ``most`` turns to give, at most.
    given = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    heads = convs.select("conv_id", "base", "got").join(given, "base").where("place <= got")
    tails = turns.join(convs.select("conv_id", "h", "got"), "conv_id").where("place > h")
    tails = tails.withColumn("place", F.col("place") - F.col("h") + F.col("got"))
    columns = ["conv_id", "place", "one", "two", "chars"]
    length = (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")
    return heads.select(columns).union(tails.select(columns)), convs.select("conv_id", length)


def running(rows: DataFrame, key: str, place: Column, values: dict[str, Column], add: Callable[[str], Column], plus) -> DataFrame:
    """``rows`` with running figures of ``values`` by ``place`` within ``key``; long keys are cut into blocks of ``BLOCK`` places."""
    rows = rows.withColumns({"_place": place, **values}).withColumn("_block", F.expr(f"_place div {BLOCK}L"))
    upto = Window.partitionBy(key, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy(key, "_block").agg(*(add(c).alias(f"_{c}") for c in values))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.withColumns({f"_{c}": add(f"_{c}").over(earlier) for c in values} | {"_nth": F.row_number().over(Window.partitionBy(key).orderBy("_block"))})
    carry = carry.where("_nth > 1").drop("_nth")
    both = rows.withColumns({c: add(c).over(upto) for c in values}).join(carry, [key, "_block"], "left")
    total = {c: plus(F.col(c), F.coalesce(f"_{c}", F.lit(0))) for c in values}
    return both.withColumns(total).drop("_place", "_block", *(f"_{c}" for c in values))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every conversation and depth from 0 to its length: ``conv_id``, ``depth``, ``x1``, ``x2``, those of the prefix before (``p1``, ``p2``), ``chars``, ``len``."""
    own = {"x1": F.xxhash64("place", "one"), "x2": F.xxhash64("two", "place")}
    hashed = turns.withColumns({"p1": own["x1"], "p2": own["x2"]})
    at = running(hashed, "conv_id", F.col("place"), own, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    before = {"p1": F.col("p1").bitwiseXOR(F.col("x1")), "p2": F.col("p2").bitwiseXOR(F.col("x2"))}
    at = at.withColumns(before).join(convs, "conv_id")
    zero = F.lit(0).cast("bigint")
    columns = ["conv_id", "depth", "x1", "x2", "p1", "p2", "chars", "len"]
    root = convs.select("conv_id", zero, zero, zero, zero, zero, zero, "len").toDF(*columns)
    return at.withColumnRenamed("place", "depth").select(columns).union(root)


def _cells(x1: np.ndarray, x2: np.ndarray, width: int) -> np.ndarray:
    """The cells of each prefix, a row for each row of the sketch."""
    key = x1.view(np.uint64) + mixed(x2.view(np.uint64))
    return (mixed(key[None] + _SEEDS[:, None]) % np.uint64(width)).astype(np.int64) + np.arange(ROWS)[:, None] * width


def lone_cells(rows: DataFrame, width: int) -> np.ndarray:
    """For each cell of the sketch of the prefixes (``x1``, ``x2``), whether it counts one.

    A cell counts to two. Every task fills a sketch; pieces of equal place are
    added up by the task that they meet in, one after the other, and come to the
    driver as bits, all in one job: a job for each partition takes longer than the rest.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            x1, x2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x1", "x2"))
            cells, n = np.unique(_cells(x1, x2, width), return_counts=True)
            counts[cells] = np.minimum(counts[cells] + n, 2)
        for piece, part in enumerate(counts.reshape(-1, PIECE)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "cells": [part.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, cells in zip(batch.column("piece").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                part = np.frombuffer(cells, np.uint8)
                total[piece] = np.minimum(total[piece] + part, 2) if piece in total else part
        for piece, part in total.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "cells": [np.packbits(part == 1).tobytes()]})

    schema = "piece int, cells binary"
    merged = rows.select("x1", "x2").mapInArrow(fill, schema).repartition("piece").mapInArrow(add, schema)
    lone = np.zeros((ROWS * width // PIECE, PIECE), bool)
    # ROWS * MOST_CELLS bits, at most.
    for piece, cells in merged.collect():
        lone[piece] = np.unpackbits(np.frombuffer(cells, np.uint8))
    return lone.ravel()


def screened(rows: DataFrame) -> DataFrame:
    """The prefixes with ``single`` (certainly nobody else's) and ``p_single`` (the one before is)."""
    inner = rows.where("depth > 0")
    width = 1 << min(max(4 * inner.count() - 1, LEAST_CELLS - 1).bit_length(), MOST_CELLS.bit_length() - 1)
    bits = rows.sparkSession.sparkContext.broadcast(np.packbits(lone_cells(inner, width)))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = batch.column("depth").to_numpy(zero_copy_only=False)
            for name, pair, least in (("single", ("x1", "x2"), 1), ("p_single", ("p1", "p2"), 2)):
                cells = _cells(*(batch.column(c).to_numpy(zero_copy_only=False) for c in pair), width)
                one = (bits.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).any(0)
                batch = batch.append_column(name, pa.array(one & (depth >= least)))
            yield batch

    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(screen, f"{fields}, single boolean, p_single boolean")


def id_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ``conv_id`` of each node, ascending, as ``ends_sha256``.

    The ids are sorted by range over all tasks and joined there to long pieces;
    the task that hashes a node reads its few pieces one after the other.
    """
    kind = dict(ends.dtypes)["conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0

        def piece() -> pa.RecordBatch:
            columns = [pa.array([v], pa.int64()) for v in node]
            return pa.RecordBatch.from_arrays([*columns, first, pa.array([",".join(ids)])], [*NODE, "first", "ids"])

        for batch in batches:
            ids_of = batch.column("conv_id")
            texts = pc.cast(ids_of, pa.string()).to_pylist()
            for k, own in enumerate(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True)):
                if own != node or size > JOINED:
                    if ids:
                        yield piece()
                    node, first, ids, size = own, ids_of.slice(k, 1), [], 0
                ids.append(texts[k])
                size += len(texts[k]) + 1
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, None

        def done() -> pa.RecordBatch:
            columns = [pa.array([v], pa.int64()) for v in node]
            return pa.RecordBatch.from_arrays([*columns, pa.array([hashed.hexdigest()])], [*NODE, "ends_sha256"])

        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if own != node:
                    if node is not None:
                        yield done()
                    node, hashed = own, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
        if node is not None:
            yield done()

    keys = ", ".join(f"{c} bigint" for c in NODE)
    order = [*NODE, "conv_id"]
    dealt = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(dealt.mapInArrow(join, f"{keys}, first {kind}, ids string"), "pieces")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, f"{keys}, ends_sha256 string")


def with_parents(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with the owner of the node (``depth`` - 1, ``p1``, ``p2``) as ``parent_conv_id``, null for the root.

    What follows a single prefix (``p_single``) is its own conversation's, also where the sketch lets it through.

    Of a parent with very many children every task looks up a share, by a hash of the child.
    """
    up = {"up": F.col("depth") - 1, "salt": F.pmod(F.xxhash64("conv_id"), F.lit(COPIES))}
    spread = rows.withColumns(up)
    key = ["up", "p1", "p2"]
    owners = nodes.select(*NODE, "conv_id").toDF(*key, "parent_conv_id")
    known = spread.select(*key, "salt").distinct().join(owners, key)
    found = spread.join(known, [*key, "salt"], "left").drop("up", "salt")
    return found.withColumn("parent_conv_id", F.when(F.col("p_single"), F.col("conv_id")).otherwise(F.col("parent_conv_id")))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations, the empty one included.

    ``turns`` as of ``numbered``, ``convs`` with ``conv_id`` and ``len`` (turns
    that it has, 0 allowed). Columns: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. No conversation, no row.
    """
    rows = stored(screened(stored(prefixes(turns, convs), "prefixes")), "screened")
    single, shared = rows.where("single"), rows.where("NOT single")
    empty = hashlib.sha256(b"").hexdigest()
    no = F.lit(0).cast("bigint")
    last = F.col("depth") == F.col("len")

    # The exact count.
    counted = shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("p1").alias("p1"),
        F.max("p2").alias("p2"),
        F.max("p_single").alias("p_single"),
        F.max("chars").alias("chars"),
        F.count_if(last).alias("n_ends"),
    )
    nodes = stored(counted, "nodes")

    # What each conversation owns: from which depth on, whether a leaf, and what its path saves.
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    owned = [
        nodes.select("conv_id", "depth", (F.col("n_ends") == F.col("n_convs")).cast("int").alias("leaf"), saved),
        single.where(last | ~F.col("p_single")).select("conv_id", "depth", last.cast("int").alias("leaf"), no.alias("saved")),
    ]
    info = owned[0].union(owned[1]).groupBy("conv_id")
    info = info.agg(F.min("depth").alias("top"), F.max("leaf").alias("leaf"), F.sum("saved").alias("total"))
    members = shared.select("conv_id", *NODE, "len").join(info, "conv_id", "left")
    below = F.col("depth") + 1
    sums = members.groupBy(*NODE).agg(
        F.count_if((F.col("top") <= below) & (below <= F.col("len"))).alias("n_children"),
        F.coalesce(F.sum("leaf"), F.lit(0)).cast("bigint").alias("n_leaves"),
        F.coalesce(F.sum(F.when(F.col("depth") < F.col("top"), F.col("total"))), F.lit(0)).alias("others"),
    )
    paths = running(nodes, "conv_id", -F.col("depth"), {"path": saved}, F.sum, lambda a, b: a + b)
    known = paths.join(sums, NODE).join(id_hashes(shared.where(last)), NODE, "left")
    known = known.withColumns({
        "saved_tokens": F.col("path") + F.col("others"),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(empty)),
    })

    # A node of one conversation. Below another such one all is known.
    ends = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty)
    alone = single.withColumns({
        "n_convs": no + 1,
        "n_children": F.when(last, 0).otherwise(1).cast("bigint"),
        "n_leaves": no + 1,
        "saved_tokens": no,
        "ends_sha256": ends,
    })
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    columns = ["conv_id", "depth", "parent_conv_id", *figures]
    tops = ["conv_id", "depth", "p1", "p2", "p_single", *figures]
    inner = alone.where("p_single").withColumn("parent_conv_id", F.col("conv_id")).select(columns)
    rest = known.select(tops).union(alone.where("NOT p_single").select(tops))
    return inner.union(with_parents(rest, nodes).select(columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations (``rebuilt``).

    A null role or text counts as empty, a null turn comes first, repeated rows
    are turns of their own, rows without conv_id are left out, and an empty table
    gives an empty table. Other columns are not looked at.
    """
    turns = stored(numbered(conversations), "numbered")
    made, convs = rebuilt(turns)
    return prefix_trie(made, stored(convs, "conversations"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
