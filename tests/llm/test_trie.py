"""The conversation trie against a plain one, the sketch, long conversations, and the edges."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oncemore.llm import trie
from tests.helpers import DATA

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_version(paths):
    """The rows of the trie of ``paths`` (id to list of turns)."""
    nodes = {}
    for c in sorted(paths):
        path = tuple(paths[c])
        for d in range(len(path) + 1):
            node = nodes.setdefault(path[:d], {"members": [], "ends": [], "children": set()})
            node["members"].append(c)
            if d:
                nodes[path[: d - 1]]["children"].add(path[:d])
        nodes[path]["ends"].append(c)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for key, node in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not node["children"]
            saved[key[:d]] += (len(node["members"]) - 1) * (len(key[-1][1]) if key else 0)
    rows = []
    for key, node in nodes.items():
        parent = nodes[key[:-1]]["members"][0] if key else None
        digest = hashlib.sha256(",".join(map(str, node["ends"])).encode()).hexdigest()
        rows.append((node["members"][0], len(key), parent, len(node["members"]), len(node["children"]), leaves[key], saved[key], digest))
    return sorted(rows)


def heads_replaced(rows):
    turns = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return made


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark):
    conversations = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = plain_version(heads_replaced([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]))
    assert found(trie.conversation_trie(conversations)) == want


@pytest.fixture(scope="module")
def branching():
    """Conversations that share heads of any length, many equal ones, some that end within others."""
    rng = random.Random(11)
    rows = []
    for c in range(400):
        n = rng.choice([1, 1, 2, 3, 5, 9, 14])
        first = rng.choice(["a", "a", "a", "b", f"own {c}"])
        texts = [first, *(rng.choice(["x", "yy"]) for _ in range(n - 1))]
        rows += [(c * rng.choice([1, 1, 3]), k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    return rows


def test_branching(spark, branching):
    df = spark.createDataFrame(branching, SCHEMA)
    # Ids that occur twice have turns of equal number, whose order is by hash: only the others can be compared.
    once = df.groupBy("conv_id").agg((F.count("*") == F.count_distinct("turn")).alias("ok")).where("ok")
    df = df.join(once, "conv_id").select("conv_id", "turn", "role", "text")
    want = plain_version(heads_replaced([tuple(r) for r in df.collect()]))
    assert max(r[1] for r in want) > 9 and max(r[3] for r in want if r[1] == 1) > 50
    assert found(trie.conversation_trie(df)) == want


def paths_of(spark, paths):
    rows = [(c, k + 1, role, text) for c, path in paths.items() for k, (role, text) in enumerate(path)]
    turns = spark.createDataFrame(rows, "conv_id long, place long, role string, text string").select(
        "conv_id", "place", F.xxhash64("role", "text").alias("one"), F.xxhash64(F.lit(2), "text", "role").alias("two"),
        F.length("text").cast("bigint").alias("chars"),
    )
    return turns, spark.createDataFrame([(c, len(p)) for c, p in paths.items()], "conv_id long, len int")


def test_trie_of_given_paths(spark):
    """The general form: turnless conversations, chains, equal turns at other places."""
    a, b = ("user", "hello"), ("assistant", "hi")
    paths = {7: [], 3: [a, b, a, b], 5: [a, b], 9: [b, a], 4: [a, b, a, b], 11: [a, a], 12: [("user", ""), ("", "hello")], 2: []}
    assert found(trie.prefix_trie(*paths_of(spark, paths))) == plain_version(paths)
    assert found(trie.prefix_trie(*paths_of(spark, {1: [a]}))) == plain_version({1: [a]})


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "JOINED", 20)
    rng = random.Random(2)
    head = [("user", rng.choice("ab") * rng.randint(0, 3)) for _ in range(90)]
    paths = {c: head[: rng.randint(0, 90)] + [("user", f"{c % 7}")] * rng.randint(0, 40) for c in range(60)}
    paths |= {c: list(head) for c in range(100, 160)}
    assert found(trie.prefix_trie(*paths_of(spark, paths))) == plain_version(paths)


def test_a_full_sketch_changes_nothing(spark, branching, monkeypatch):
    turns, convs = trie.rebuilt(trie.numbered(spark.createDataFrame(branching, SCHEMA)))
    want = found(trie.prefix_trie(turns, convs))
    monkeypatch.setattr(trie, "LEAST_CELLS", 1 << 16)
    monkeypatch.setattr(trie, "lone_cells", lambda rows, width: np.zeros(trie.ROWS * width, bool))
    assert found(trie.prefix_trie(turns, convs)) == want


def test_the_sketch_counts_too_few_of_nothing(spark):
    """What it calls single occurs once, and of such prefixes it finds nearly all."""
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (20_000, 2))
    times = rng.choice([1, 1, 1, 2, 30], len(keys))
    rows = [(*map(int, k), int(n)) for k, n in zip(keys, times, strict=True)]
    df = spark.createDataFrame(rows, "x1 long, x2 long, n int").withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    df = df.select(F.lit(1).cast("long").alias("depth"), "x1", "x2", F.col("x1").alias("p1"), "n").toDF("depth", "x1", "x2", "p1", "n")
    out = trie.screened(df.withColumn("p2", F.col("x2"))).groupBy("n").agg(F.sum(F.col("single").cast("int")).alias("k"), F.count("*").alias("all"))
    got = {r["n"]: (r["k"], r["all"]) for r in out.collect()}
    assert got[2][0] == got[30][0] == 0 and got[1][0] > 0.95 * got[1][1]


EDGES = [
    (0, None, "user", "first"), (0, 0, "user", "zero"), (0, 1, None, "one"), (0, 2, "user", None), (0, 3, "", ""),
    (1, 5, "user", "only"), (100, 0, "user", "é\U0001f600"), (100, 0, "user", "é\U0001f600"), (None, 1, "user", "nobody"),
    (101, 0, "user", "w " * 200_000), (-5, 0, "user", "minus"), (-5, 1, "user", "minus"),
    *((c, k, "user", "same") for c in (201, 202, 203) for k in range(3)),
]


def test_edges(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in EDGES], SCHEMA + ", place string, depth int, len int")
    fixed = [r for r in EDGES if r[0] is not None]
    assert found(trie.conversation_trie(df)) == plain_version(heads_replaced(fixed))
    assert trie.conversation_trie(df.limit(0)).count() == 0
    assert trie.conversation_trie(df.where("conv_id IS NULL")).count() == 0


def test_a_sketch_with_collisions_changes_nothing(spark, branching, monkeypatch):
    """A prefix that it lets through may follow one that it calls single."""
    turns, convs = trie.rebuilt(trie.numbered(spark.createDataFrame(branching, SCHEMA)))
    want = found(trie.prefix_trie(turns, convs))
    exact = trie.lone_cells
    some = np.random.default_rng(5)
    monkeypatch.setattr(trie, "lone_cells", lambda rows, width: exact(rows, width) & (some.random(trie.ROWS * width) < 0.2))
    assert found(trie.prefix_trie(turns, convs)) == want


def test_sketch_comes_in_one_job(spark):
    """Whatever the number of partitions; and its bits say which cells count one."""
    rows = spark.range(5000).selectExpr("id % 3000 AS x1", "(id % 3000) * 7 AS x2").repartition(5)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("sketch", "sketch")
        lone = trie.lone_cells(rows, trie.LEAST_CELLS)
        assert len(context.statusTracker().getJobIdsForGroup("sketch")) < 10
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    x = np.array([i % 3000 for i in range(5000)], np.int64)
    cells = trie._cells(x, x * 7, trie.LEAST_CELLS)
    assert (lone == (np.bincount(cells.ravel(), minlength=len(lone)) == 1)).all()
