"""MinHash: every pair against all pairs, the bound on what tables miss, and the edges."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from oncemore.llm import minhash
from tests.helpers import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width=4):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < width:
        return {" ".join(words)} if words else set()
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)}


def plain_version(rows, percent=80):
    """Components by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in {p for h in holders.values() for p in itertools.combinations(h, 2)}:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return [(i, len(sets[k]), min(ids[find(k)], default=None)) for k, (i, _) in enumerate(rows)]


def found(df):
    out = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_version([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert found(minhash.minhash_components(docs)) == sorted(want, key=repr)


def test_hot_groups(spark):
    """A large group of variants, many variants of one text near the limit, a passage and a line that a third of the texts have."""
    rng = random.Random(5)

    def gibberish(n):
        return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]

    base, passage, line = gibberish(120), gibberish(40), gibberish(5)
    texts = []
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.choice([1, 1, 2, 3])):
            own[at] = rng.choice("xyz") * 4
        texts.append(own)
    for _ in range(40):
        one = gibberish(rng.randint(20, 200))
        texts += [one, one[: int(len(one) * rng.uniform(0.8, 1)) + 1], one + gibberish(rng.randint(1, len(one) // 5))]
    texts += [passage + gibberish(rng.randint(1, 120)) for _ in range(150)]
    texts += [line * rng.randint(1, 9) + gibberish(rng.randint(0, 60)) for _ in range(60)]
    texts += [base] * 100
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.minhash_components(docs)) == sorted(plain_version(rows), key=repr)


def test_tables_miss_no_pair_of_the_similarity(spark):
    """Of 4,000 pairs with a similarity of just 0.8 none is missed, and less similar ones seldom meet."""
    rng = np.random.default_rng(3)

    def meeting(shared, own, n=4_000):
        a = rng.integers(1, 1 << 62, (n, shared + own), dtype=np.uint64)
        b = np.concatenate((a[:, :shared], rng.integers(1, 1 << 62, (n, own), dtype=np.uint64)), 1)
        stops = np.arange(1, n + 1) * (shared + own)
        same = minhash.minhash_keys(a.ravel(), stops) == minhash.minhash_keys(b.ravel(), stops)
        return (same[:, : minhash.SIDE].any(1) & same[:, minhash.SIDE :].any(1)).mean()

    assert meeting(80, 10) == 1
    assert meeting(20, 40) < 0.01


def test_parities_bound_the_difference():
    """No pair is refused for fewer shingles than differ."""
    rng = np.random.default_rng(4)
    for shared, one, two in [(0, 1, 1), (50, 0, 0), (100, 13, 12), (300, 40, 35), (2000, 200, 240), (5, 900, 0)]:
        h = rng.integers(0, 1 << 63, shared + one + two, dtype=np.uint64)
        a, b = (np.array(minhash.parities(x)).view(np.uint64) for x in (h[: shared + one], np.concatenate((h[:shared], h[shared + one :]))))
        assert np.bitwise_count(a ^ b).sum() <= one + two


def test_a_pair_counts_in_its_first_tables(spark):
    """Wherever keys are equal, the first table of both collections is among those that count, and few others are."""
    rng = np.random.default_rng(6)
    one = rng.integers(0, 1 << 63, (300, 2 * minhash.SIDE), dtype=np.uint64)
    two = np.where(rng.random(one.shape) < 0.45, one, rng.integers(0, 1 << 63, one.shape, dtype=np.uint64))
    rows, want = [], []
    for k, (a, b, x, y) in enumerate(zip(one, two, minhash.lanes(one), minhash.lanes(two), strict=True)):
        same = [np.flatnonzero((a == b)[: minhash.SIDE]), np.flatnonzero((a == b)[minhash.SIDE :])]
        rows += [(k, int(i), int(j), x.tolist(), y.tolist()) for i in same[0] for j in same[1]]
        if len(same[0]) and len(same[1]):
            want.append((k, same[0][0], same[1][0]))
    df = spark.createDataFrame(rows, "k int, i int, j int, c_lanes array<bigint>, lanes array<bigint>")
    got = {tuple(r) for r in df.where(minhash._is_first("c_", "")).select("k", "i", "j").collect()}
    assert set(want) <= got
    assert max(sum(g[0] == k for g in got) for k in range(300)) == minhash.FIRST**2 < len(rows) / 300


EDGES = [
    (1, "the Quick brown fox jumps over the lazy dog"),
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, ""),
    (3, None),
    (None, "a b"),
    (4, "A\tB"),
    (None, "one of a kind without any id"),
    (5, " \n "),
    (6, "a b c"),
    (7, "lorem ipsum dolor sit amet " * 30_000),
    (8, "lorem ipsum dolor sit amet " * 20_000),
    (9, "É b c d e"),
    (10, "é b c d e"),
]


def test_edges(spark):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in EDGES], "doc_id long, text string, row string, same string, size int")
    got = found(minhash.minhash_components(docs))
    assert got == sorted(plain_version(EDGES), key=repr)
    assert (None, 1, 4) in got and (None, 4, None) in got and (8, 5, 7) in got and (2, 0, 2) in got and (10, 2, 10) in got
    assert minhash.minhash_components(docs.limit(0)).count() == 0
    text_ids = docs.selectExpr("cast(doc_id as string) doc_id", "text")
    assert minhash.minhash_components(text_ids).where("doc_id = '8'").first()["component_id"] == "7"


@pytest.mark.parametrize("width", [1, 4])
def test_shingles(width):
    texts = ["", "a", "a B c", "b a c d e a b c d e", " \t x\n"]
    hashes, stops = minhash.shingles([t.encode() for t in texts], width)
    parts = np.split(hashes, stops[:-1])
    assert [len(set(p.tolist())) for p in parts] == [len(shingle_set(t, width)) for t in texts]
