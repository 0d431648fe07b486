"""A hidden Markov language model over word classes.

Frequent words are classes of their own, all others share a class by their last
bytes; a word's probability is its class's in the hidden state times its own
share of the class. Latent states are trained by Baum-Welch: every pass over
the training texts adds up expected counts in each partition, and Spark adds up
the partitions'. A text's probability is that of the scaled forward recursion
over the whole text.

The counts of the most frequent words (a bounded table) are at hand in every
task; those of all other words meet the texts in a join.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oncemore.llm.common import as_bytes, chunks, remainder, stored

STATES = 6
#: Passes of Baum-Welch over all training texts.
PASSES = 2
#: Words that are classes of their own, and classes of all others.
OWN, SHARED = 8_000, 1_024
#: Words whose counts every task holds, at most.
HEAD = 250_000
#: Training texts on which the first parameters are found, at most, and passes over them.
START_TEXTS, START_PASSES = 400, 20
#: Weight of the classes' corpus shares in a state's.
PRIOR = 50.0
#: Tokens that a task handles together, unless one text is longer.
TOKENS = 1_000_000
#: Tokens whose transitions are added up at once.
BLOCK = 100_000
#: The token at the end of a text. No word is empty.
END = ""


@dataclass
class Vocabulary:
    """``head``: class and count by word. ``norm``: log10 of each class's denominator, 0 for a word's own class. ``share``: of the classes."""

    head: dict[bytes, tuple[int, int]]
    norm: np.ndarray
    share: np.ndarray
    total: int
    distinct: int
    own: int
    cutoff: int


@dataclass
class Parameters:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def shared_class(word: Column) -> Column:
    """Class of a word that has none of its own, counted from 0: by its last three bytes."""
    return F.crc32(F.substring(word.cast("binary"), -3, 3)) % SHARED


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``c`` of all tokens of ``docs``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "c"])

        for part in chunks(batches, "text"):
            for text in as_bytes(part.column("text")):
                counts.update(text.lower().split())
            counts[b""] += part.num_rows
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    return docs.select("text").mapInArrow(of, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD, own: int = OWN) -> Vocabulary:
    """The frequent words of ``counts`` (all with the same count or none), and the classes' totals."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    cutoff, room = None, head
    for c, n in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        if n > room:
            break
        cutoff, room = c, room - n
    cutoff = cutoff or total + 1
    frequent = sorted(((-r["c"], r["word"]) for r in counts.where(F.col("c") >= cutoff).collect()))
    words = [END, *(w for _, w in frequent if w != END)][: own]
    known = {w: -c for c, w in frequent}
    if END not in known:
        known[END] = next((r["c"] for r in counts.where(F.col("word") == END).collect()), 0)
    place = {w: k for k, w in enumerate(words)}
    # Totals of the shared classes: all words less those that have their own.
    c_of, v_of = np.zeros(SHARED), np.zeros(SHARED)
    rest = counts.where(F.col("word") != END).groupBy(shared_class(F.col("word")).alias("k"))
    for k, c, v in rest.agg(F.sum("c"), F.count("*")).collect():
        c_of[k], v_of[k] = c, v
    for w in words:
        if w != END:
            k = crc32(w.encode()[-3:]) % SHARED
            c_of[k] -= known[w]
            v_of[k] -= 1
    mass = np.concatenate(([known[w] + 0.1 for w in words], c_of + 0.1 * (v_of + 1)))
    table = {
        w.encode(): (place[w] if w in place else len(words) + crc32(w.encode()[-3:]) % SHARED, c) for w, c in known.items()
    }
    norm = np.concatenate((np.zeros(len(words)), np.log10(c_of + 0.1 * (v_of + 1))))
    return Vocabulary(table, norm, mass / mass.sum(), total, distinct, len(words), cutoff)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Per row: ``row``, ``doc_id``, ``held_out``, the tokens' ``classes`` (16 bits each), sums over head words and the other ``words``.

    ``base_log`` and ``word_log`` sum log10(count + 0.1) of head words: of all,
    and of those without a class of their own. ``n_head`` counts those known.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        done = TaskContext.get().partitionId() << 33
        for part in chunks(batches, "text"):
            number: dict = defaultdict(count().__next__)
            ids = []
            for text in as_bytes(part.column("text")):
                own = text.lower().split()
                own.append(b"")
                ids.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
            words = list(number)
            found = [v.head.get(w) for w in words]
            tail = np.array([f is None for f in found], bool)
            kind = np.array(
                [f[0] if f else v.own + crc32(w[-3:]) % SHARED for w, f in zip(words, found, strict=True)], np.uint16
            )
            c = np.array([f[1] if f else 0 for f in found], np.float64)
            log = np.where(tail, 0.0, np.log10(c + 0.1))
            ends = np.cumsum([len(x) for x in ids])
            flat = np.concatenate(ids)
            text = np.repeat(np.arange(len(ids)), np.diff(np.concatenate(([0], ends))))
            sums = [
                np.bincount(text, weights=w[flat], minlength=len(ids))
                for w in (log, np.where(kind >= v.own, log, 0.0), (~tail & (c > 0)).astype(float))
            ]
            rare = np.flatnonzero(tail[flat])
            pair, times = np.unique(text[rare] * len(words) + flat[rare], return_counts=True)
            rows = pair // max(len(words), 1)
            spelled = pa.array([words[k] for k in (pair % max(len(words), 1)).tolist()], pa.binary()).cast(pa.string())
            items = pa.StructArray.from_arrays([spelled, pa.array(times, pa.int64())], ["word", "n"])
            cuts = pa.array(np.searchsorted(rows, np.arange(len(ids) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(done + np.arange(len(ids)), pa.int64()),
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array([kind[x].tobytes() for x in ids], pa.binary()),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.array(sums[2].astype(np.int64)),
                    pa.ListArray.from_arrays(cuts, items),
                ],
                ["row", "doc_id", "held_out", "classes", "base_log", "word_log", "n_head", "words"],
            )
            done += len(ids)

    schema = (
        f"row bigint, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, classes binary, base_log double, "
        "word_log double, n_head bigint, words array<struct<word: string, n: bigint>>"
    )
    return docs.select("doc_id", "held_out", "text").mapInArrow(of, schema)


class Lattice:
    """Texts side by side, the longest first: token ``t`` of all of them in a row, so that a step is one operation."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(x) for x in texts], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        # Texts that reach each step.
        self.active = np.searchsorted(-ordered, -np.arange(steps), side="left")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        t = np.repeat(np.arange(steps), self.active)
        self.text = (np.arange(len(t)) - self.offset[t]).astype(np.int32)
        begins = (np.cumsum(lengths) - lengths)[self.order]
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint16)
        self.classes = flat[begins[self.text] + t]
        self.later = np.arange(self.active[0] if steps else 0, len(t))
        self.before = self.offset[t[self.later] - 1] + self.text[self.later]
        del t, flat

    def forward(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward probabilities, the scales, and the emissions, token by token."""
        emit = np.ascontiguousarray(p.emit.T)[self.classes]
        alpha, scale = np.empty_like(emit), np.empty(len(emit), emit.dtype)
        step = p.step.astype(emit.dtype)
        for t, n in enumerate(self.active):
            now = slice(self.offset[t], self.offset[t] + n)
            if t:
                a = alpha[self.offset[t - 1] : self.offset[t - 1] + n] @ step
                a *= emit[now]
            else:
                a = emit[now] * p.start.astype(emit.dtype)
            s = a.sum(1)
            a /= s[:, None]
            alpha[now], scale[now] = a, s
        return alpha, scale, emit

    def log10(self, p: Parameters) -> np.ndarray:
        """log10 probability of each text's classes, in the order given."""
        _, scale, _ = self.forward(p)
        out = np.zeros(len(self.order))
        if len(scale):
            out[self.order] = np.bincount(self.text, weights=np.log10(scale), minlength=len(self.order))
        return out

    def expected(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, transitions, and states with classes."""
        alpha, scale, emit = self.forward(p)
        step = p.step.astype(emit.dtype)
        beta = np.ones_like(alpha)
        back = np.ascontiguousarray(step.T)
        for t in range(len(self.active) - 1, 0, -1):
            n = self.active[t]
            now = slice(self.offset[t], self.offset[t] + n)
            b = emit[now] * beta[now]
            b /= scale[now][:, None]
            beta[self.offset[t - 1] : self.offset[t - 1] + n] = b @ back
        moves = np.zeros_like(p.step)
        for at in range(0, len(self.later), BLOCK):
            here, left = self.later[at : at + BLOCK], self.before[at : at + BLOCK]
            right = emit[here] * beta[here]
            right /= scale[here][:, None]
            moves += alpha[left].T @ right
        moves *= p.step
        gamma = alpha
        gamma *= beta
        first = gamma[: self.active[0]].sum(0, dtype=np.float64) if len(self.active) else np.zeros(len(p.start))
        kinds = np.array(
            [np.bincount(self.classes, weights=gamma[:, k], minlength=p.emit.shape[1]) for k in range(len(p.start))]
        )
        return first, moves, kinds


def maximised(first: np.ndarray, moves: np.ndarray, kinds: np.ndarray, share: np.ndarray) -> Parameters:
    """Parameters from expected counts; each count starts from a little more than nothing."""
    start = first + 1.0
    step = moves + 1.0
    emit = kinds + PRIOR * share
    return Parameters(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _lattices(batches: Iterator[pa.RecordBatch], limit: int = TOKENS) -> Iterator[tuple[pa.RecordBatch, Lattice]]:
    for part in chunks(batches, "classes", 2 * limit):
        yield part, Lattice([np.frombuffer(x, np.uint16) for x in part.column("classes").to_pylist()])


def first_parameters(texts: list[bytes], share: np.ndarray, states: int, passes: int, seed: int = 0) -> Parameters:
    """Parameters fitted to a few texts, from texts dealt to states at random and states that seldom change."""
    rng = np.random.default_rng(seed)
    parts = [np.frombuffer(x, np.uint16) for x in texts]
    kinds = np.zeros((states, len(share)))
    for x in parts:
        kinds[rng.integers(states)] += np.bincount(x, minlength=len(share))
    moves = np.full((states, states), 5.0) + np.eye(states) * 500
    p = maximised(np.ones(states), moves, kinds, share)
    lattice = Lattice(parts)
    for _ in range(passes if parts else 0):
        p = maximised(*lattice.expected(p), share)
    return p


def baum_welch(encoded: DataFrame, p: Parameters, share: np.ndarray) -> Parameters:
    """One pass over all texts of ``encoded``. States times (classes + states + 1) sums come to the driver."""
    states, kinds = p.emit.shape
    single = Parameters(p.start, p.step, p.emit.astype(np.float32))
    shared = encoded.sparkSession.sparkContext.broadcast(single)
    width = kinds + states + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((states, width))
        for _, lattice in _lattices(batches):
            first, moves, emit = lattice.expected(shared.value)
            total += np.hstack((emit, moves, first[:, None]))
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], ["at", "n"])

    sums = encoded.select("classes").mapInArrow(of, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(states * width)
    total[sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
    total = total.reshape(states, width)
    return maximised(total[:, -1], total[:, kinds : kinds + states], total[:, :kinds], share)


def language_model(docs: DataFrame, states: int = STATES, passes: int = PASSES, head: int = HEAD, own: int = OWN) -> DataFrame:
    """Scores of every row of ``docs``, learned from rows whose crc32 of the id is not 0 modulo 10.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A
    null text counts as empty: one token, the end. Repeated rows come out as
    often as they went in. Without training rows every token is unknown and the
    model is uniform. An empty table gives an empty table. Columns other than doc_id
    and text are not looked at.
    """
    rows = docs.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "text")
    counts = stored(word_counts(rows.where(~F.col("held_out"))), "counts")
    vocab = vocabulary(counts.where("c > 0"), head, own)
    encoded = stored(encode(rows, vocab), "encoded")
    training = encoded.where(~F.col("held_out"))
    chosen = training.select("classes").orderBy(F.xxhash64("classes"), "classes").limit(START_TEXTS)
    p = first_parameters([bytes(r["classes"]) for r in chosen.collect()], vocab.share, states, START_PASSES)
    for _ in range(passes):
        p = baum_welch(training, p, vocab.share)
    model = docs.sparkSession.sparkContext.broadcast((p, vocab.norm))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, norm = model.value
        for part, lattice in _lattices(batches):
            texts = [np.frombuffer(x, np.uint16) for x in part.column("classes").to_pylist()]
            found = lattice.log10(p) - np.array([norm[x].sum() for x in texts])
            columns = [part.column(c) for c in ("row", "doc_id", "held_out", "base_log", "word_log", "n_head")]
            columns += [pa.array([len(x) for x in texts], pa.int64()), pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["row", "doc_id", "held_out", "base_log", "word_log", "n_head", "n_tokens", "path_log"]
    schema = (
        f"row bigint, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, base_log double, word_log double, "
        "n_head bigint, n_tokens bigint, path_log double"
    )
    scored = encoded.select("row", "doc_id", "held_out", "classes", "base_log", "word_log", "n_head").mapInArrow(of, schema)
    rare = encoded.select("row", F.inline("words")).join(counts.where(F.col("c") < vocab.cutoff), "word", "left")
    log = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    rest = rare.groupBy("row").agg(F.sum(log).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_tail"))
    tail = F.coalesce("tail_log", F.lit(0.0))
    all_words = F.lit(float(np.log10(vocab.total + 0.1 * (vocab.distinct + 1))))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("base_log") + tail - F.col("n_tokens") * all_words).alias("base_score"),
        (F.col("path_log") + F.col("word_log") + tail).alias("score"),
    )


def op4_hmm(spark, sf_dir: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
