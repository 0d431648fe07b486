"""Fill-in-middle: the boundary set, the cuts, the round trip, and the edges."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oncemore.llm import fim
from tests.helpers import DATA

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted(h % (len(tokens) + 1) for h in (h1, h2))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(values, kinds=None):
    held = fim.BoundarySet(np.array(values))
    assert len(held) == len(values)
    if kinds is not None:
        assert [kind for kind, _ in held.containers] == kinds
    assert [held.select(k) for k in range(0, len(values), max(1, len(values) // 500))] == values[:: max(1, len(values) // 500)]
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            held.select(k)


def test_all_three_containers():
    check([], [])
    check([0, 5, 70_000, 10**12], ["array", "array", "array"])
    check(list(range(0, 60_000, 2)), ["bitmap"])
    check(list(range(100, 50_000)) + list(range(50_002, 65_536)), ["run"])
    mixed = list(range(3, 65_536, 3)) + list(range(65_536, 131_072)) + [131_073, 140_000] + list(range(400_000, 400_100))
    check(mixed, ["bitmap", "run", "array", "run"])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 300), st.integers(0, 1 << 18))))
def test_any_set(values):
    check(sorted(values))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\U0001f600\t\n\x0b<P>"), max_size=6))
def test_token_ends(texts):
    got = fim.token_ends([t.encode() for t in texts])
    assert [e.tolist() for e in got] == [[m.end() for m in TOKEN.finditer(t)] for t in texts]


EDGES = [
    (1, "one two  three\nfour "),
    (1, "one two  three\nfour "),
    (2, ""),
    (3, None),
    (None, " \t led by white space é \U0001f600 \x00 end"),
    (4, " \t\n "),
    (5, "has a <M> mark"),
    *((k, f"a<P b<S c >< {k} <") for k in range(10, 40)),
    *((k, "wörd \U0001f600\n" * 60_000) for k in range(50, 54)),
]


def test_edges_and_round_trip(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in EDGES], "doc_id long, text string, form string, n int")
    out = fim.rearranged(docs)
    back = fim.restored(out.output, out.form).alias("back")
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect()]
    want = [(i, *plain_version(i, t), t or "") for i, t in EDGES]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.rearranged(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = [(r.doc_id, *plain_version(r.doc_id, r.text)) for r in docs.collect()]
    assert sorted(map(tuple, fim.rearranged(docs).collect())) == sorted(want)
