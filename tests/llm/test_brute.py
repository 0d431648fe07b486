"""Every operator against a plain version, on whole small tables."""

import collections
import hashlib
import html
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from oncemore.llm import boilerplate, common, decontaminate, hmm, hostrules, langid, mixing, secrets, simhash, suffixdedup, toxicity
from tests.helpers import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


def test_language(docs, texts):
    """Held-out accuracy, and the classifier against the definition."""
    found = by_id(langid.language_id(docs))
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(i for i, r in found.items() if r["held_out"]) == sorted(held)
    assert sum(found[i]["lang_pred"] == texts[i]["lang"] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    counts = collections.defaultdict(collections.Counter)
    grams = {}
    for i, r in texts.items():
        grams[i] = collections.Counter()
        spaced = " " + " ".join(re.findall(r"[^\W\d_]+", r["text"].lower())) + " "
        for n in (1, 2, 3):
            grams[i].update(g for k in range(len(spaced) - n + 1) if (g := spaced[k : k + n]).strip())
        if i not in held:
            counts[r["lang"]].update(grams[i])

    def top(c):
        # Ties go to the smaller number of an n-gram: its last letter counts least.
        number = lambda g: sum(ord(x) << (21 * (len(g) - 1 - k)) for k, x in enumerate(g))
        return {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[: langid.PROFILE])}

    profiles = {lang: top(c) for lang, c in counts.items()}
    for i in sorted(texts)[:40]:
        own = top(grams[i])
        apart = {lang: sum(abs(k - p[g]) if g in p else langid.PROFILE for g, k in own.items()) for lang, p in profiles.items()}
        assert found[i]["lang_pred"] == min(sorted(apart), key=apart.get)


def test_toxicity(spark, docs, texts):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    planted = [(10_000 + k, f"{w} of the {w} and {w} in it") for k, w in enumerate(["clean", "1d10t", "s.t.u.p.i.d", "m0r0n", "looooser", "p a t h e t i c"])]
    # Enough labelled rows to learn from: each text under many ids, with words of its own.
    rows = [(k, f"word{k % 7} common text number {k} " + ("idiot stupid moron loser pathetic" if k % 5 == 0 else "nothing")) for k in range(400)]
    more = spark.createDataFrame([*rows, *planted], "doc_id long, text string")
    marked = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(more, marked))
    assert all(got[k]["predicted"] == (k % 5 == 0) for k in range(400))
    assert [got[10_000 + k]["predicted"] for k in range(6)] == [0, 1, 1, 1, 1, 1]
    assert by_id(toxicity.toxicity(docs, labels)).keys() == texts.keys()


def test_viterbi_is_exact():
    """The restored letters against all ways through the lattice."""
    rng = np.random.default_rng(1)
    chars = np.log(rng.dirichlet(np.ones(27), (27, 27)))
    scorer = toxicity.Scorer(toxicity.Model(["x"], chars))
    code = {c: k + 1 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    for token in ("a1b", "4@s", "bb0", "s5-s", "1!|"):
        best = None
        options = []
        for k, c in enumerate(token):
            likes = c if c in code else toxicity.LOOKALIKES.get(c, "")
            ways = [(x, -0.05 if c in code else math.log(0.95 / len(likes))) for x in likes]
            if c in code:
                ways += [("", -0.5)] if k and token[k - 1] == c else []
            else:
                ways.append(("", math.log(0.05) if likes else -0.05))
                ways += [("", -0.5)] if k and token[k - 1] == c else []
            options.append(ways)
        for way in itertools.product(*options):
            word = "".join(x for x, _ in way)
            ids = [0, 0, *(code[x] for x in word), 0]
            score = sum(s for _, s in way) + sum(chars[ids[k], ids[k + 1], ids[k + 2]] for k in range(len(ids) - 2))
            best = max(best or (score, word), (score, word))
        assert scorer.restored(token) == best[1]


def test_host_rules(docs, texts):
    found = by_id(hostrules.host_rules(docs))
    for i, r in texts.items():
        w = WORD.findall(r["text"])
        seen, repeated = set(), 0
        for line in r["text"].split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        times = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(8)}
        symbols = sum(r["text"].count(c) for c in "#*$%&|<>")
        got = found[i]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (
            len(w), sum(map(len, w)), symbols, repeated, len(covered)
        )
        assert got["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert got["kept"] == (not got["base_failed"] and got["host_passes"])


def test_host_verdicts(spark):
    """A bad host goes with its good pages; a small bad host is given the benefit of the others."""
    good = "one sentence of quite ordinary words that is long enough to pass the base rule of twenty words without any trouble at all"
    bad = good + " $ # % & | < > * $ # % &"
    rows = [("good", good)] * 300 + [("bad", bad)] * 200 + [("bad", good)] * 20 + [("small", bad)] + [("mixed", good)] * 50 + [("mixed", bad)] * 10
    docs = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = hostrules.host_rules(docs).groupBy("host").agg(F.min("host_passes").alias("p"), F.sum(F.col("kept").cast("int")).alias("n"))
    assert {r["host"]: (r["p"], r["n"]) for r in got.collect()}["bad"] == (False, 0)
    assert {r["host"]: r["n"] for r in got.collect()}["good"] == 300
    assert {r["host"]: r["n"] for r in got.collect()}["mixed"] == 60
    # Alpha and beta of identical hosts are a strong prior around the mean; those of extreme hosts a weak one.
    same = spark.createDataFrame([("a", 100, 50), ("b", 100, 50)], "host string, n long, r long")
    apart = spark.createDataFrame([("a", 100, 0), ("b", 100, 100)], "host string, n long, r long")
    a, b = hostrules.priors(same, {"r": ""})["r"]
    assert a == b == 500
    a, b = hostrules.priors(apart, {"r": ""})["r"]
    assert a == b == 1


def test_forward_and_baum_welch():
    """Likelihood and expected counts against the sum over all paths of states."""
    rng = np.random.default_rng(0)
    p = hmm.Parameters(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2))
    parts = [np.array(x, np.uint16) for x in ([0, 3, 1], [2], [1, 1, 0, 2, 3])]
    lattice = hmm.Lattice(parts)
    first, moves, kinds = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    for x, log in zip(parts, lattice.log10(p), strict=True):
        weights = {}
        for path in itertools.product(range(2), repeat=len(x)):
            w = p.start[path[0]] * p.emit[path[0], x[0]]
            for k in range(1, len(x)):
                w *= p.step[path[k - 1], path[k]] * p.emit[path[k], x[k]]
            weights[path] = w
        total = sum(weights.values())
        assert log == pytest.approx(math.log10(total))
        for path, w in weights.items():
            first[path[0]] += w / total
            for k, s in enumerate(path):
                kinds[s, x[k]] += w / total
                if k:
                    moves[path[k - 1], s] += w / total
    for got, want in zip(lattice.expected(p), (first, moves, kinds), strict=True):
        assert np.allclose(got, want)


@pytest.mark.parametrize("head,own", [(250_000, 8_000), (300, 100)])
def test_language_model(docs, texts, head, own):
    found = by_id(hmm.language_model(docs, head=head, own=own))
    tokens = {i: [*words(r["text"]), ""] for i, r in texts.items()}
    training = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = training.total(), len(training)
    for i, t in tokens.items():
        base = sum(math.log10((training[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        r = found[i]
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(w in training for w in t))
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_is_a_distribution(spark):
    """The probabilities of all one-word texts, known or of an unknown kind, add up to less than one."""
    seen = ["a b c d", "b c d e", "c d e f g"] * 10
    rows = [(k, t) for k, t in enumerate(seen)] + [(1000 + k, w) for k, w in enumerate("abcdefg")]
    got = by_id(hmm.language_model(spark.createDataFrame(rows, "doc_id long, text string"), states=2, passes=1, head=4, own=2))
    assert sum(10 ** got[1000 + k]["score"] for k in range(7)) < 1


def overlaps(doc, item, shift, least=13, percent=80):
    """Whether any run of ``least`` words or more on the diagonal has the share of equal words, by trying all."""
    ends = range(max(0, -shift), min(len(item), len(doc) - shift) + 1)
    upto = [0]
    for i in ends[:-1]:
        upto.append(upto[-1] + (doc[i + shift] == item[i]))
    return any(100 * (upto[b] - upto[a]) >= percent * (b - a) for a in range(len(upto)) for b in range(a + least, len(upto)))


def test_decontamination(spark, docs, texts):
    items = {r["item_id"]: words(r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()}
    base = [r["text"] for r in texts.values()][:30]
    planted = []
    for k, (i, w) in enumerate(list(items.items())[:30]):
        w = list(w)
        for at in range(4, len(w), 9):  # every ninth word is another
            w[at] = "changed"
        planted.append((5000 + k, f"{base[k][:300]} {' '.join(w).upper()} {base[-k][:200]}"))
    some = spark.createDataFrame(planted, "doc_id long, text string")
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs.select("doc_id", "text").union(some), benchmark).collect()}
    want = set()
    texts_of = {**{i: r["text"] for i, r in texts.items()}, **dict(planted)}
    for i, text in texts_of.items():
        doc = words(text)
        at = collections.defaultdict(list)
        for k, w in enumerate(doc):
            at[w].append(k)
        for item, w in items.items():
            shifts = collections.Counter(k - j for j, x in enumerate(w) for k in at[x])
            for shift, same in shifts.items():
                if same >= 0.8 * decontaminate.MIN_TOKENS and overlaps(doc, w, shift):
                    want.add((i, item))
    assert len({x for x in want if x[0] >= 5000}) >= 15
    assert got == want


PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def test_secrets(spark, docs, texts):
    hard = [
        "é\U0001f600 password: 'abcdef' token=token=abcdef secret : x1 API_KEY=\"A.b-c_d+/=\" AKIA" + "A" * 15 + " AKIA" + "B" * 16,
        "password: token: abcdefgh " + "0123456789abcdef" * 3 + "\x01\x02 apikey=\x01abcdef Passwd=zzzzzz",
        "AKIAAKIA" + "C" * 11 + " and ghp_" + "a" * 36,
    ]
    more = spark.createDataFrame([(9000 + k, t) for k, t in enumerate(hard)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").union(more)
    got = by_id(secrets.secrets(frame))
    for i, text in {**{i: r["text"] for i, r in texts.items()}, **{9000 + k: t for k, t in enumerate(hard)}}.items():
        base = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i]["spans"] if s["rank"] < 3)
        assert base == base_spans(text), text
    assert "github" in [s["kind"] for s in got[9002]["spans"]]


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, "password=abcdef"), (2, "nothing")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "password=abcdef"), (4, "token=ghijkl")], "doc_id long, text string")
    secrets.secrets(one, ledger, secrets.RULES[:2]).collect()
    seen = lambda: spark.read.parquet(f"{ledger}/seen")
    assert seen().count() == 2
    got = by_id(secrets.secrets(two, ledger, secrets.RULES[:2]))
    assert seen().count() == 3 and len(got[3]["spans"]) == len(got[4]["spans"]) == 1
    # Another rule: each blob is scanned for that alone.
    secrets.secrets(two, ledger, secrets.RULES[:3]).collect()
    assert sorted(len(r["rules"]) for r in seen().collect()) == [1, 1, 2, 2, 2]
    assert len(by_id(secrets.secrets(one, ledger, secrets.RULES[:3]))[1]["spans"]) == 1


def test_redacted_texts_have_no_spans(spark, docs):
    secret = "é token=abcdef0123456789abcdef0123 and AKIA" + "Z" * 16 + "."
    more = spark.createDataFrame([(9000, secret, "en", "s", len(secret))], docs.schema)
    clean = secrets.redacted(docs.union(more))
    assert clean.columns == docs.columns and clean.count() == docs.count() + 1
    assert all(not r["spans"] for r in secrets.secrets(clean).collect())
    row = clean.where("doc_id = 9000").first()
    assert row["text"] == "é [SECRET] and [SECRET]." and row["n_chars"] == len(row["text"])


def test_mixing(docs, texts):
    found = mixing.mixture(docs, bucket_rows=7, fan_in=3).collect()
    size = {i: len(WORD.findall(r["text"])) for i, r in texts.items()}
    source = {i: r["source"] for i, r in texts.items()}
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    open_, target = sorted(total), {}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    rest = 1.5 * sum(total.values())
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > 2 * total[s]]
        if not full:
            target.update({s: weight[s] * share for s in open_})
            break
        target.update({s: 2 * total[s] for s in full})
        rest -= sum(2 * total[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    taken = collections.Counter()
    for r in found:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]])
        assert r["target"] == pytest.approx(target[source[i]])
        assert abs(r["copies"] - target[source[i]] / total[source[i]]) < 1
        taken[source[i]] += r["size"] * r["copies"]
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in total)
    again = mixing.mixture(docs.repartition(5), bucket_rows=7, fan_in=3).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in found) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_pivot_is_unbiased_and_keeps_the_sum():
    rng = np.random.default_rng(0)
    size, part = np.array([5.0, 1.0, 3.0, 8.0, 2.0]), np.array([0.3, 0.9, 0.5, 0.2, 0.4])
    sums = np.zeros(5)
    for _ in range(4000):
        out = mixing.pivot(size, part, rng.random(5))
        assert np.count_nonzero((out > 0) & (out < 1)) <= 1
        assert (size * out).sum() == pytest.approx((size * part).sum())
        sums += out
    assert np.allclose(sums / 4000, part, atol=0.04)


@pytest.mark.parametrize("shard", [30_000, 15])
def test_suffix_dedup(spark, docs, texts, shard):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh é"), 260))
    planted = [(7000 + k, "".join(rng.choice(list("xyzw "), 150)) + passage[k % 3 : 250 + k % 5] + "q" * (k * 40)) for k in range(40)]
    some = docs.where("doc_id < 60").select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = by_id(suffixdedup.dedup_spans(some, shard=shard))
    known = set()
    for i, text in sorted({**{i: r["text"] for i, r in texts.items() if i < 60}, **dict(planted)}.items()):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in known:
                gone[k : k + 100] = True
            known.add(raw[k : k + 100])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), int(gone.sum()), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_only_repeated_windows_are_sorted():
    """The stretches left are exactly the windows that occur twice, each at its place."""
    rng = np.random.default_rng(9)
    for length in (5, 40):
        parts = [bytes(rng.choice(list(b"ab"), int(rng.integers(0, 90)))) for _ in range(30)] + [b"", b"ab" * 30, b"x" * length]
        times = collections.Counter(p[k : k + length] for p in parts for k in range(len(p) - length + 1))
        stretches, owner, begin = suffixdedup.repeated_parts(parts, length)
        got = [(o, b + k) for t, o, b in zip(stretches, owner.tolist(), begin.tolist(), strict=True) for k in range(len(t) - length + 1)]
        assert got == [(i, k) for i, p in enumerate(parts) for k in range(len(p) - length + 1) if times[p[k : k + length]] > 1]
        assert all(parts[o][b : b + len(t)] == t for t, o, b in zip(stretches, owner.tolist(), begin.tolist(), strict=True))
    assert [len(x) for x in suffixdedup.repeated_parts([], 100)] == [len(x) for x in suffixdedup.repeated_parts([b"ab"], 100)] == [0, 0, 0]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(4)
    parts = [bytes(rng.choice(list(b"ab\x00"), n).astype(np.uint8)) for n in (0, 1, 40, 40, 90)] + [b"ab" * 30] * 2
    parts = [p for p in parts if p]
    symbols, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    order = suffixdedup.larsson_sadakane(symbols, ends, 90)
    suffix = [p[k:] for p in parts for k in range(len(p))]
    assert [suffix[i] for i in order] == sorted(suffix)
    common = suffixdedup.kasai(symbols, ends, order, 25)
    for a, b in itertools.pairwise(order.tolist()):
        shared = next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))
        assert common[b] == min(shared, 25)


def test_simhash(docs, texts):
    got = by_id(simhash.simhash_components(docs))
    prints = {}
    for i, r in texts.items():
        w = words(r["text"])
        runs = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
    root = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    assert {i: r["component_id"] for i, r in got.items()} == root


@pytest.mark.parametrize("distance,segments", [(4, 3), (7, 4), (8, 3)])
def test_all_links_of_random_fingerprints(spark, distance, segments):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 10), replace=False)
            fps.add(int(np.int64(b) ^ np.bitwise_xor.reduce(np.left_shift(np.int64(1), flips))))
    frame = spark.createDataFrame([([f],) for f in fps], "fp array<long>")
    got = [tuple(sorted((r["a"][0], r["b"][0]))) for r in simhash.hamming_links(frame, distance, segments=segments).collect()]
    mask = 2**64 - 1
    want = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if ((a ^ b) & mask).bit_count() <= distance}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (200, 150), (300, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100}


def test_near_duplicates(spark):
    """Pairs of known similarity: those above 0.9 are found, those below 0.8 are not, and chains join."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, want, row = [], {}, 0
    for g in range(60):
        text = list(rng.choice(vocabulary, 300))
        rows.append((row, 1000 - row, " ".join(text)))
        row += 1
        edits = (2, 5, 40)[g % 3]  # Similarity about 0.94, 0.85 and under 0.35.
        for at in rng.choice(290, edits, replace=False):
            text[at] = "other"
        rows.append((row, 1000 - row, " ".join(text)))
        want[g] = edits
        row += 1
    docs = spark.createDataFrame(rows, "row long, doc_id long, text string")
    got = {r["row"]: r for r in simhash.near_duplicates(docs).collect()}
    together = {g: got[2 * g]["group"] == got[2 * g + 1]["group"] for g in want}
    assert all(together[g] for g, e in want.items() if e == 2)
    assert not any(together[g] for g, e in want.items() if e == 40)
    assert sum(together[g] for g, e in want.items() if e == 5) >= 15
    # The smaller doc_id stays.
    assert all(got[2 * g + 1]["keep"] and not got[2 * g]["keep"] for g in want if together[g])


def test_article_texts(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r for r in boilerplate.extract(pages).collect()}
    for r in pq.read_table(f"{DATA}/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.DOTALL)[1]
        inner = re.sub(r"<[a-z0-9/]*\Z", "", re.sub(r"</?b>", "", inner))
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (text, len(text))


@pytest.mark.parametrize("shard_words", [200_000, 20])
def test_pages_without_an_article(spark, shard_words):
    """Repeated runs go, unique runs stay, a copy of a whole page stays, and all that the markup rules out goes."""
    rng = np.random.default_rng(7)
    menu = "welcome to our lovely site of the many old things you find here every day"
    unique = {k: " ".join(rng.choice([f"w{x}" for x in range(500)], 60)) for k in range(6)}
    body = "<body><div>{}</div><p>{} &eacute;<br>x</p><div class='cookie-notice'>a</div><ul id=comments><li>nice</ul><form>f</form><script>1<2</script>"
    rows = [(k, f"http://h.example/{k}", body.format(menu, t)) for k, t in unique.items()]
    rows += [(100 + k, f"http://copy.example/{k}", f"<p>{unique[0]}") for k in range(2)]
    got = {r["page_id"]: r["text"] for r in boilerplate.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_words).collect()}
    assert got == {**{k: f"{t} é x" for k, t in unique.items()}, 100: unique[0], 101: unique[0]}


def test_articles_that_are_none(spark):
    """A comment or a teaser in an article element is not the main text; an article beside a menu is, and so are several long ones."""
    story = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, f"<div>{story}</div><section class=comments><article>nice comment here</article></section>", story),
        (2, f"<article>one teaser</article><article>another teaser</article><div>{story}</div>", story),
        (3, f"<div>a menu that nobody names</div><article>{story}</article>", story),
        (4, f"<article>{story}</article><p>beside</p><article>two {story}</article>", f"{story} two {story}"),
        (5, f"<main><article>{story}</article><article>inner</article></main><p>{story}", f"{story} inner"),
        (6, "<div class=comments><article>only a comment</article></div>", ""),
    ]
    pages = spark.createDataFrame([(k, f"http://h{k}.example/", h) for k, h, _ in rows], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in boilerplate.extract(pages).collect()} == {k: t for k, _, t in rows}


def test_pipeline(spark):
    """The run is its stages one after the other, and each decision takes effect."""
    out = corpus_pipeline.run(spark, DATA)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    assert 0 < len(rows) < 200 and all(r["copies"] > 0 for r in rows.values())
    assert not any(base_spans(r["text"]) for r in rows.values())
    insults = re.compile(r"\b(idiot|moron|stupid)\b", re.I)
    assert sum(len(insults.findall(r["text"])) > 2 for r in rows.values()) == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "mixing"]


def shingle_set(text, width=5):
    w = text.split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}


def test_all_near_duplicates(spark):
    """Every isolated pair of a similarity of 0.8 or a little more is found, and none below."""
    rng = np.random.default_rng(16)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, want = [], []
    for _ in range(150):
        one = list(rng.choice(vocabulary, int(rng.integers(30, 300))))
        two = one.copy()
        # A run replaced at one end: shingles leave one by one, until the next would bring the pair below 0.8.
        below = len(want) % 4 == 0
        for k in range(len(two)):
            last = two.copy()
            two[k] = f"other{k}"
            a, b = shingle_set(" ".join(one)), shingle_set(" ".join(two))
            if len(a & b) < 0.8 * len(a | b):
                break
        want.append(not below)
        texts += [" ".join(one), " ".join(two if below else last)]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    got = {r["row"]: r["group"] for r in simhash.near_duplicates(docs).collect()}
    assert [got[2 * g] == got[2 * g + 1] for g in range(len(want))] == want


def test_one_line_does_not_make_a_group(spark):
    """Texts whose fingerprints are equal because one line makes up most of them are compared like any other."""
    line = "this very line is in nearly all of them "
    texts = [line * 20 + " ".join(f"own{k}x{j}" for j in range(20)) for k in range(12)]
    texts += [texts[0], texts[0].upper()]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    got = {r["row"]: r for r in simhash.near_duplicates(docs).collect()}
    assert sorted(k for k, r in got.items() if r["keep"]) == list(range(12))
    assert got[0]["group"] == got[12]["group"] == got[13]["group"]


def test_repeats_do_not_hide_near_duplicates(spark):
    """Texts that differ only in how often a line repeats are near duplicates, and have one fingerprint for the stars."""
    rng = np.random.default_rng(19)
    texts = []
    for g in range(20):
        text = [f"w{k}" for k in rng.integers(0, 3000, 209)]
        # From the second time on, repeating the line adds no shingle.
        line = [f"line{g}x{k}" for k in range(9)]
        texts += [" ".join(text + line * 2), " ".join(text + line * 12)]
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    got = {r["row"]: r["group"] for r in simhash.near_duplicates(docs).collect()}
    assert all(got[2 * g] == got[2 * g + 1] for g in range(20)) and len(set(got.values())) == 20
    one, two = (simhash.shingle_hashes(t.encode(), 5) for t in texts[:2])
    common = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sent = simhash.prefixes(docs.where("row < 2"), 5, 0.8, spark.sparkContext.broadcast(common)).orderBy("row").collect()
    assert set(one.tolist()) == set(two.tolist()) and sent[0]["fp"] == sent[1]["fp"]


def test_longest_overlap():
    """Against all runs, counted one by one: a shorter run of equal words does not hide a longer one with the share."""
    rng = np.random.default_rng(21)
    share = decontaminate.SIMILARITY
    hidden = np.array([1] * 10 + [0] + [1] * 2, bool)
    for case in [hidden, *(rng.random(int(rng.integers(1, 40))) < rng.uniform(0.5, 1) for _ in range(400))]:
        before, after = rng.integers(0, 4, 2)
        item = np.arange(1, len(case) + 1)
        doc = np.concatenate((np.zeros(before, int), np.where(case, item, 0), np.zeros(after, int)))
        runs = [(b - a) for a in range(len(case)) for b in range(a + 1, len(case) + 1) if 10 * case[a:b].sum() >= 8 * (b - a)]
        start, n, equal = decontaminate.best_overlap(doc, item, int(before), share)
        assert n == max(runs, default=0)
        assert equal == case[start - before : start - before + n].sum()


def test_contaminated_near_the_ends(spark):
    """Substitutions near an end leave 13 words or more of which four fifths are equal."""
    items, docs = [], []
    for k, changed in enumerate([(10,), (2,), (2, 12), (11, 13), (1, 3, 17)]):
        w = [f"i{k}x{j}" for j in range((13, 13, 15, 15, 20)[k])]
        items.append((k, " ".join(w)))
        docs.append((k, "before " * 5 + " ".join("other" if j in changed else x for j, x in enumerate(w)) + " after" * 5))
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k, k) for k in range(len(items))]


def test_masks_miss_no_overlap():
    """Every way to have 2 other words in 13, 3 in 15, 4 in 20 and 5 in 25 leaves a place for a mask."""
    for length, others in ((13, 2), (15, 3), (20, 4), (25, 5)):
        odd = np.array([sum(1 << k for k in c) for c in itertools.combinations(range(length), others)])
        met = np.zeros(len(odd), bool)
        for mask in decontaminate.MASKS:
            for shift in range(length - len(mask) + 1):
                met |= odd & (int(mask, 2) << shift) == 0
        assert met.all()


def test_balls_join_all_near_fingerprints(spark):
    """Between groups, all pairs of groups that differ in 15 of 256 bits or fewer; within one none; none beyond the distance."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        base = rng.integers(-(2**63), 2**63 - 1, 4)
        for _ in range(5):
            fp = base.copy()
            for bit in rng.choice(256, rng.integers(0, 12), replace=False):
                fp[bit // 64] ^= np.int64(np.uint64(1 << int(bit) % 64).view(np.int64))
            rows.append((len(rows), [int(x) for x in fp]))
    # Two rows of every five are one group.
    roots = {r: r - 1 if r % 5 == 1 else r for r, _ in rows}
    frame = spark.createDataFrame([(r, roots[r], fp) for r, fp in rows], "row long, root long, fp array<long>").repartition(4)
    far = {(a, b): sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(f, g, strict=True)) for (a, f), (b, g) in itertools.combinations(rows, 2)}
    got = {(r["a"], r["b"]) for r in simhash.ball_links(frame, 20, 4, 2, 1).collect()}
    assert all(far[p] <= 20 and roots[p[0]] != roots[p[1]] for p in got)
    groups = {tuple(sorted((roots[a], roots[b]))) for a, b in got}
    near = {tuple(sorted((roots[a], roots[b]))) for (a, b), n in far.items() if n <= 15 and roots[a] != roots[b]}
    assert len(near) > 100 and near <= groups


def test_near_duplicates_walk_balls(spark, monkeypatch):
    """The pairs that the balls find are links, also where the exact search finds none."""
    rng = np.random.default_rng(9)
    text = list(rng.choice([f"w{k}" for k in range(3000)], 400))
    rows = [(k, k, " ".join([*text[: 60 * k], "other", *text[60 * k + 1 :]])) for k in range(6)]
    docs = spark.createDataFrame(rows, "row long, doc_id long, text string")
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "prefix_links", lambda sets, similarity: none)
    monkeypatch.setattr(simhash, "star_links", lambda *of: none)
    assert [r["row"] for r in simhash.near_duplicates(docs).where("keep").collect()] == [0]


def test_only_texts_of_pairs_travel(spark):
    """Of 2,000 texts the three that pairs name pass the filter, with next to no other, and are compared."""
    words = [f"w{k}" for k in range(60)]
    own = [" ".join(f"own{k}x{j}" for j in range(30)) for k in range(2000)]
    own[5], own[900], own[901] = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[:30])
    texts = spark.createDataFrame(list(enumerate(own)), "row long, text string")
    pairs = spark.createDataFrame([(5, 900), (900, 901)], "a long, b long")
    through = {r["row"] for r in texts.where(common.perhaps_in("row", pairs.select(F.explode(F.array("a", "b"))))).collect()}
    assert {5, 900, 901} <= through and len(through) < 10
    assert [tuple(r) for r in simhash.similar(pairs, texts, 5, 0.8).collect()] == [(5, 900)]
    assert texts.where(common.perhaps_in("row", pairs.limit(0).select("a"))).count() == 0


def groups_of(texts):
    """The smallest index that each of ``texts`` reaches over pairs of a similarity of 0.8."""
    sets, least = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            least[y] = x
    return [find(k) for k in range(len(texts))]


def test_a_large_group_is_not_compared_in_full(spark, monkeypatch):
    """Variants of one text, and some too far from it: all links, with a number of candidates that follows the rows, not the pairs."""
    rng = np.random.default_rng(23)
    text = [f"w{k}" for k in rng.integers(0, 3000, 150)]
    texts = [" ".join(text)]
    for k in range(400):
        edits = 1 if k % 10 else 6  # Of 146 shingles some 5 differ, or 30: then it is similar to next to none.
        own = text.copy()
        for at in rng.choice(150, edits, replace=False):
            own[at] = f"own{k}x{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    filtered, read, compared = [], [], []
    real_ends, real_similar = common.filter_of, simhash.similar

    def filter_of(hashes):
        filtered.append(hashes.count())
        return real_ends(hashes)

    def similar(pairs, *others):
        compared.append(pairs.count())
        return real_similar(pairs, *others)

    monkeypatch.setattr(common, "filter_of", filter_of)
    monkeypatch.setattr(simhash, "similar", similar)
    real_links = simhash.prefix_links

    def prefix_links(*of):
        out = real_links(*of)
        read.append(out.count())
        return out

    monkeypatch.setattr(simhash, "prefix_links", prefix_links)
    # What the stars find in a larger group: nearly all are together, and the exact search has the others.
    stars = spark.createDataFrame([(0, k) for k in range(1, 401) if k % 10], "a long, b long")
    monkeypatch.setattr(simhash, "star_links", lambda *of: stars)
    monkeypatch.setattr(simhash, "ball_links", lambda *of: stars.limit(0))
    got = {r["row"]: r["group"] for r in simhash.near_duplicates(docs).collect()}
    n, want = len(texts), groups_of(texts)
    assert [got[k] for k in range(n)] == want and 20 < len(set(want)) < 60
    assert sum(read) < 10 * n and sum(compared) < 5 * n and max(filtered) <= n


def test_parities_refuse_no_similar_pair(spark):
    """Against all shingles, for sets of 3 to 3,000: no similar pair goes, and most that are far from it do."""
    rng = np.random.default_rng(24)
    rows, pairs = [], {}
    for k in range(300):
        n = int(rng.choice([3, 30, 300, 3000]))
        one = rng.integers(0, 2**63, n, dtype=np.uint64)
        two = one.copy()
        at = rng.choice(n, int(n * rng.uniform(0, 0.3)), replace=False)
        two[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        for row, of in ((2 * k, one), (2 * k + 1, two)):
            rows.append((row, n, simhash.parities(of)))
        same = n - len(at)
        pairs[2 * k, 2 * k + 1] = same / (2 * n - same), n
    sets = spark.createDataFrame(rows, "row long, size int, odd array<long>")
    got = {tuple(r) for r in simhash.possible(spark.createDataFrame(list(pairs), "a long, b long"), sets, 0.8).collect()}
    alike = {p for p, (j, _) in pairs.items() if j >= 0.8}
    far = {p for p, (j, n) in pairs.items() if j < 0.7 and 30 <= n <= 300}
    assert len(alike) > 50 and alike <= got
    assert len(far) > 20 and len(far & got) < 0.1 * len(far)


@pytest.mark.parametrize("shard_words", [200_000, 60])
def test_site_wide_blocks_in_articles(spark, shard_words):
    """A block that nearly all articles of a host have goes; what fewer have, copies and parts of blocks stay."""
    rng = np.random.default_rng(41)
    notice = "get all of our stories once a week by mail and never miss one of them"
    shared = "this sentence is in half of the articles of the host and belongs to them"
    rows, want = [], {}
    for k in range(20):
        own = [" ".join(rng.choice([f"w{x}" for x in range(500)], 40)) for _ in range(2)]
        some = [shared] if k % 2 else []
        # The notice is missing once, and once it is a part of a longer block.
        last = [] if k == 3 else [f"{notice} says word{k}"] if k == 4 else [notice]
        kept = [own[0], *some, own[1], *(last if k == 4 else [])]
        rows.append((k, "http://h.example/x", "<nav>menu</nav><article>" + "".join(f"<p>{t}</p>" for t in [own[0], *last, *some, own[1]]) + "</article>"))
        want[k] = " ".join(kept if k != 4 else [own[0], *last, own[1]])
    rows += [(100 + k, "http://copy.example/x", f"<article><p>{shared}</p><p>{notice}</p></article>") for k in range(12)]
    rows += [(200 + k, "http://small.example/x", f"<article><p>{notice}</p><p>{'own ' * 30}{k}</p></article>") for k in range(5)]
    want |= {100 + k: f"{shared} {notice}" for k in range(12)} | {200 + k: f"{notice} {'own ' * 30}{k}" for k in range(5)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r for r in boilerplate.extract(pages, shard_words).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["n_repeated"] == (16 if k < 100 and k not in (3, 4) else 0) for k, r in got.items())
