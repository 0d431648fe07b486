"""Toxicity after deobfuscation through a noisy channel.

Written words pass a channel that swaps letters for look-alikes, repeats them
and puts signs or spaces between them. Every token becomes a lattice (for each
character the letters it may stand for, or nothing); Viterbi finds the likeliest
letters under a character model of the corpus and the learned words. So does
every run of single characters, whatever separates them, and what two neighbours
that are no words of the corpus make together. Documents are scored by the toxic
words in the restored text.

A token of letters without a repeat has one path through its lattice, itself,
and one with repeats has no other letters on any path than itself; both are
compared without repeats, and need no search.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oncemore.llm.common import chunks, remainder, stored, word_hashes

#: Letters that a character is used for in place of its own.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
#: A toxic word occurs in toxic documents so many times as often as in others; and in this share of them and in three,
#: or so often that of all words this many, at most, would by chance.
LIFT, SUPPORT, LEAST, CHANCE = 10.0, 0.05, 3, 0.01
#: Toxic words kept, at most; and other words of the corpus, those of at least so many kinds of text.
MAX_WORDS, MAX_KNOWN, KNOWN = 1_000, 50_000, 2
#: Tokens that a task keeps in mind, at most.
MAX_CACHED = 200_000
#: Hits are counted up to this many.
BUCKETS = 4

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\W\d_]+")
_REPEAT = re.compile(r"(.)\1+", re.S)
#: Signs that stand for letters; every other sign is a separator.
_SIGNS = "".join(re.escape(c) for c in LOOKALIKES if not c.isalnum())
_STRIP = re.compile(rf"^(?:[\W_](?<![{_SIGNS}]))+|(?:[\W_](?<![{_SIGNS}]))+$")
#: A token of single characters, repeated or not, and signs.
_SINGLES = re.compile(rf"[{_SIGNS}]?(?:[\W_]*(?:([a-z0-9])\1*(?![^\W_])|[{_SIGNS}]))[\W_]*(?:([a-z0-9])\2*(?![^\W_])[\W_]*)*")
_NO_LETTER = re.compile(r"[\W_]")
_PLAIN_EDGES = ".,;:?\"'"
_SEPARATED = re.compile(rf"[\W_](?<![{_SIGNS}])")


@dataclass
class Model:
    """``words``: toxic words. ``chars``: log probability of a letter after two (0 is the edge of a word). ``rates``: of label 1 by hits.

    ``common``: words of the corpus, of which two neighbours are not read as one.
    """

    words: list[str] = field(default_factory=list)
    chars: np.ndarray | None = None
    rates: list[float] = field(default_factory=lambda: [0.0] * (BUCKETS + 1))
    common: list[str] = field(default_factory=list)


class Scorer:
    def __init__(self, model: Model):
        self.words = frozenset(model.words)
        # Restored words are compared without doubled letters: repetition is one of the disguises.
        self.single = frozenset(map(_single, model.words))
        self.inside = [w for w in self.single if len(w) >= 5]
        self.rates = model.rates
        self.common = frozenset(model.common)
        # Every first part of a toxic word, with the parts that complete it.
        self.parts: dict[str, set[str]] = {}
        for w in {*self.words, *self.single}:
            for at in range(1, len(w)):
                self.parts.setdefault(w[:at], set()).add(w[at:])
        self.chars = None if model.chars is None else model.chars.tolist()
        # Hits of tokens looked at, and which of these are single characters.
        self.known: dict[str, int] = {}
        self.short: set[str] = set()

    def restored(self, token: str) -> str:
        """The likeliest letters behind ``token`` (lower case)."""
        return self._viterbi(token)

    def _viterbi(self, token: str) -> str:
        # State: the last two letters. Value: log probability and the letters so far, as a chain.
        states = {(0, 0): (0.0, None)}
        previous = ""
        for c in token:
            if c in _LETTERS:
                choices = [(_LETTERS.index(c) + 1, -0.05)]
                if c == previous:
                    choices.append((0, -0.5))
            else:
                likes = LOOKALIKES.get(c, "")
                choices = [(_LETTERS.index(x) + 1, math.log(0.95 / len(likes))) for x in likes]
                choices.append((0, math.log(0.05) if likes else -0.05))
                if c == previous:
                    choices.append((0, -0.5))
            previous = c
            after: dict = {}
            for (a, b), (score, chain) in states.items():
                for letter, cost in choices:
                    if letter:
                        key, value = (b, letter), (score + cost + self.chars[a][b][letter], (chain, letter))
                    else:
                        key, value = (a, b), (score + cost, chain)
                    if key not in after or after[key][0] < value[0]:
                        after[key] = value
            states = after
        chain = max(((s + self.chars[a][b][0], c) for (a, b), (s, c) in states.items()), key=lambda x: x[0])[1]
        letters = []
        while chain:
            chain, letter = chain
            letters.append(_LETTERS[letter - 1])
        return "".join(reversed(letters))

    def hits(self, text: str) -> int:
        """Toxic words of the restored text. A place counts once."""
        if not self.words:
            return 0
        tokens = text.lower().split()
        own = set(tokens)
        if len(self.known) > MAX_CACHED:
            self.known.clear()
            self.short.clear()
        for token in own.difference(self.known):
            self.known[token] = self._in_token(token)
            if _SINGLES.fullmatch(token):
                self.short.add(token)
        n = sum(map(self.known.__getitem__, tokens))
        if not own.isdisjoint(self.parts):
            n += sum(map(self._joined, tokens, tokens[1:]))
        if not own.isdisjoint(self.short):
            n += sum(map(self._in_run, self._runs(tokens)))
        return n

    def _runs(self, tokens: list[str]) -> Iterator[str]:
        """Neighbours of single characters, joined by spaces."""
        start = None
        for k, token in enumerate([*tokens, ""]):
            if token in self.short:
                start = k if start is None else start
            elif start is not None:
                if k - start > 1:
                    yield " ".join(tokens[start:k])
                start = None

    def _in_run(self, run: str) -> int:
        if len(re.findall(r"[^\W_]+", run)) < 3:
            return 0
        word = _single(self.restored(_SEPARATED.sub("", run)))
        return sum(w in word for w in self.single)

    def _in_token(self, token: str) -> int:
        word = token.strip(_PLAIN_EDGES)
        if word.isalpha():
            # The only letters that a word alone can have.
            return int(word in self.words or _single(word) in self.single)
        words = _WORD.findall(token)
        n = sum(w in self.words or _single(w) in self.single for w in words)
        core = _STRIP.sub("", token)
        if n or not words:
            return n
        if all(w in self.common for w in words) and not any(c in LOOKALIKES for c in core):
            return 0
        n = self._within(self.restored(core))
        if not n and len(words) > 2 and _SINGLES.fullmatch(token):
            # Between single characters a sign may also be no letter.
            n = self._within(self.restored(_NO_LETTER.sub("", core)))
        return n

    def _joined(self, one: str, two: str) -> bool:
        rest = self.parts.get(one)
        if rest is None or one in self.common:
            return False
        two = _STRIP.sub("", two)
        return two in rest and two not in self.common and two not in self.words

    def _within(self, word: str) -> int:
        word = _single(word)
        return int(word in self.single) or sum(w in word for w in self.inside)

    def score(self, text: str | None) -> float:
        return self.rates[min(self.hits(text or ""), BUCKETS)]


def _single(word: str) -> str:
    return _REPEAT.sub(r"\1", word)


def learn(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> Model:
    """The model from all labelled documents, with ``held_out`` only from those whose crc32 of the id is not 1 modulo 3.

    Words are counted once per kind of text: of near copies (same smallest
    hash of three words) all but one are ignored. The joins sort: labels grow with the texts.
    """
    labelled = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if held_out:
        labelled = labelled.where(remainder("doc_id", 3) != 1)
    sample = docs.where("text IS NOT NULL").select("doc_id", "text").join(labelled.hint("merge"), "doc_id")

    def kinds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            kinds = [_kind(t) for t in part.column("text").to_pylist()]
            yield part.append_column("kind", pa.array(kinds, pa.int64()))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            words, of = [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                own = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
                words.extend(own)
                of.extend([k] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), part.column("toxic").take(pa.array(of, pa.int32()))], ["word", "toxic"])

    kinds = sample.select("text", "toxic").mapInArrow(kinds_of, "text string, toxic int, kind bigint")
    sample = stored(kinds.withColumn("row", F.monotonically_increasing_id()), "labelled")
    first = stored(sample.groupBy("kind", "toxic").agg(F.min("row").alias("row")), "kinds")
    each = sample.join(first.select("row").hint("merge"), "row", "left_semi").select("text", "toxic").mapInArrow(words_of, "word string, toxic int")
    once = stored(each.groupBy("word", "toxic").agg(F.count("*").alias("n")), "words")
    totals = dict(first.groupBy("toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    count = {y: F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0)) for y in (0, 1)}
    table = once.groupBy("word").agg(count[1].alias("bad"), count[0].alias("good"))
    lift = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))
    often = F.col("bad") >= max(LEAST, SUPPORT * bad)
    toxic = table.where((lift >= LIFT) & (often | (_evidence((bad + 1) / (bad + good + 2)) >= math.log(max(table.count(), 1) / CHANCE))))
    words = [r["word"] for r in toxic.orderBy(F.desc("bad"), "word").limit(MAX_WORDS).collect()]
    model = Model(words, _char_model(once, words))
    often = once.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= KNOWN)
    model.common = [r["word"] for r in often.orderBy(F.desc("n"), "word").limit(MAX_KNOWN).collect() if r["word"] not in words]
    rate = (
        add_scores(sample, model, hits_only=True)
        .groupBy(F.least(F.col("__hits"), F.lit(BUCKETS)).alias("hits"))
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
        .collect()
    )
    got = {r["hits"]: (r["n"], r["bad"]) for r in rate}
    hit_n, hit_bad = (sum(v[k] for h, v in got.items() if h) for k in (0, 1))
    prior = (hit_bad + 1) / (hit_n + 2)
    for h in range(1, BUCKETS + 1):
        n, y = got.get(h, (0, 0))
        model.rates[h] = (y + 2 * prior) / (n + 2)
    n, y = got.get(0, (0, 0))
    model.rates[0] = (y + 0.1) / (n + 1) if n else 0.0
    # More hits never score lower.
    model.rates = np.maximum.accumulate(model.rates).tolist()
    return model


def _evidence(share: float) -> Column:
    """Minus the log of a bound on the chance that of ``bad`` + ``good`` texts that many are ``bad``, where each is with probability ``share``."""
    n = F.col("bad") + F.col("good")
    parts = ((F.col(c), p) for c, p in (("bad", share), ("good", 1 - share)))
    return sum((F.when(c > 0, c * F.log(c / (n * p))).otherwise(0.0) for c, p in parts), F.lit(0.0))


def _kind(text: str) -> int:
    h, _ = word_hashes([text.encode()])
    if len(h) < 3:
        return int(h.sum().view(np.int64)) if len(h) else 0
    return int((h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)).min().view(np.int64))


def _char_model(words: DataFrame, toxic: list[str]) -> np.ndarray:
    """Interpolated trigrams of the corpus' words, and as much weight on the toxic words. 27**3 counts come to the driver."""
    padded = F.concat(F.lit("^^"), F.col("word"), F.lit("^"))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(3)))
    counts = (
        words.where(F.col("word").rlike("^[a-z]+$"))
        .select(F.explode(grams).alias("gram"), "n")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    code = {"^": 0} | {c: i + 1 for i, c in enumerate(_LETTERS)}
    corpus, own = np.zeros((27, 27, 27)), np.zeros((27, 27, 27))
    for gram, n in counts:
        corpus[tuple(code[c] for c in gram)] += n
    for w in toxic:
        if all(c in code for c in w):
            for k in range(len(w) + 1):
                own[tuple(code[c] for c in f"^^{w}^"[k : k + 3])] += 1
    total = corpus / max(corpus.sum(), 1) + own / max(own.sum(), 1)

    def given(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.sum(-1, keepdims=True), 1e-12)

    p = 0.85 * given(total) + 0.1 * given(total.sum(0))[None] + 0.04 * given(total.sum((0, 1)))[None, None] + 0.01 / 27
    return np.log(p)


def add_scores(docs: DataFrame, model: Model, hits_only: bool = False, name: str | None = None) -> DataFrame:
    """All columns of ``docs``, and ``__score`` (with ``hits_only``: ``__hits``, the number of toxic words), or ``name`` in its place."""
    own, kind = ("__hits", T.IntegerType()) if hits_only else ("__score", T.DoubleType())
    name = name or own

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        rate = scorer.hits if hits_only else scorer.score
        for part in batches:
            found = [rate(t or "") for t in part.column("text").to_pylist()]
            yield part.append_column(name, pa.array(found, pa.int32() if hits_only else pa.float64()))

    return docs.mapInArrow(of, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    Null and empty texts score as texts without toxic words do. Repeated rows
    come out as often as they went in, an empty table gives an empty table, and
    without labels every score is 0. Other columns are not looked at.
    """
    model = learn(docs, labels)
    scored = add_scores(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.7).cast("int").alias("predicted"),
    )


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
