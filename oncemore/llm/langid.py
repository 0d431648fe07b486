"""Language by rank-order profiles of n-grams.

A profile is a list of the most frequent n-grams of one to three characters. A
text's profile is compared to each language's: every n-gram counts the
difference of its two ranks, one that the language lacks counts the length of
the profile. The least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oncemore.llm.common import chunks, remainder

#: N-grams in a profile.
PROFILE = 300
#: Languages at most, so that the profiles sent to all tasks are bounded; more are an error.
MAX_LANGUAGES = 2_000
#: Text bytes counted together.
CHUNK = 1 << 20
_SPACE = 32
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        points = np.arange(0x110000)
        known = np.zeros(0x110000, bool)
        known[: 0xD800] = [chr(x).isalpha() for x in points[:0xD800]]
        known[0xE000:] = [chr(x).isalpha() for x in points[0xE000:]]
        _letter = known
    return _letter


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram and its count in the text, sorted by text and n-gram.

    Letters count in lower case, what is between words as one space, which
    alone does not count. An n-gram of three code points is a number of 63 bits.
    """
    padded = [" " if t is None else f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(texts)))
    # What touches a letter stays, as a space; of two such in a row one goes.
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    points, text, letter = points[keep], text[keep], letter[keep]
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1] | (text[1:] != text[:-1])
    points, text, letter = points[keep], text[keep], letter[keep]
    symbols, code = np.unique(np.where(letter, points, _SPACE), return_inverse=True)
    code = code.astype(np.int64)
    base = len(symbols)
    found = []
    blank = int(np.searchsorted(symbols, _SPACE))
    for n in (1, 2, 3):
        m = len(code) - n + 1
        if m <= 0:
            continue
        gram = code[:m].copy()
        for k in range(1, n):
            gram = gram * base + code[k : k + m]
        ok = text[:m] == text[n - 1 :]
        if n == 1:
            ok &= code != blank
        elif n == 2:
            ok &= ~((code[:m] == blank) & (code[1:] == blank))
        key, times = np.unique(text[:m][ok] * base**n + gram[ok], return_counts=True)
        owner, gram = key // base**n, key % base**n
        spelled = np.zeros(len(gram), np.int64)
        for k in range(n):
            spelled |= symbols[gram // base**k % base].astype(np.int64) << (21 * k)
        found.append((owner, spelled, times))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    owner, gram, times = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((gram, owner))
    return owner[order], gram[order], times[order]


def ranked(owner: np.ndarray, gram: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` most frequent n-grams of each owner, with their rank from 0; ties go to the smaller n-gram."""
    order = np.lexsort((gram, -times, owner))
    owner, gram = owner[order], gram[order]
    first = np.searchsorted(owner, owner, side="left")
    rank = np.arange(len(owner)) - first
    top = rank < most
    return owner[top], gram[top], rank[top]


def profiles(docs: DataFrame, most: int = PROFILE) -> DataFrame:
    """``lang``, ``gram``, ``rank`` of the most frequent n-grams over all texts of each language (null: none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            langs = part.column("lang").dictionary_encode()
            owner, gram, times = ngrams(part.column("text").to_pylist())
            lang = langs.indices.to_numpy()[owner].astype(np.int64)
            order = np.lexsort((gram, lang))
            lang, gram, times = lang[order], gram[order], times[order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(lang) != 0) | (np.diff(gram) != 0)))) if len(lang) else []
            sums = np.add.reduceat(times, new) if len(new) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang[new] if len(new) else [], pa.int64())), pa.array(gram[new] if len(new) else [], pa.int64()), pa.array(sums, pa.int64())],
                ["lang", "gram", "n"],
            )

    texts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = texts.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First within slices of a language, then among the slices' best.
    part = Window.partitionBy("lang", "slice").orderBy(F.desc("n"), "gram")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("slice", F.pmod(F.hash("gram"), F.lit(64))).withColumn("r", F.row_number().over(part))
    best = best.where(F.col("r") <= most).withColumn("rank", F.row_number().over(whole) - 1)
    return best.where(F.col("rank") < most).select("lang", "gram", "rank")


class Classifier:
    def __init__(self, rows: list[tuple[str, int, int]], most: int = PROFILE):
        self.most = most
        self.langs = sorted({lang for lang, _, _ in rows})
        at = {lang: k for k, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), at[lang]] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the lead of the best over the second, as a part of the second's distance."""
        owner, gram, rank = ranked(*ngrams(texts), self.most)
        far = np.zeros((len(texts), max(len(self.langs), 1)))
        sizes = np.bincount(owner, minlength=len(texts))
        at = np.searchsorted(self.grams, gram)
        if len(self.grams):
            at[self.grams[np.minimum(at, len(self.grams) - 1)] != gram] = len(self.grams)
        for k in range(len(self.langs)):
            theirs = self.ranks[at, k]
            apart = np.where(theirs < 0, self.most, np.abs(theirs - rank))
            far[:, k] = np.bincount(owner, weights=apart, minlength=len(texts))
        best = far.argmin(1)
        least = far.min(1)
        # Without a second language the second distance is that to an empty profile.
        second = np.partition(far, 1, 1)[:, 1] if far.shape[1] > 1 else (sizes * self.most).astype(float)
        score = np.where(second > 0, (second - least) / np.maximum(second, 1e-9), 0.0)
        known = (sizes > 0) & bool(self.langs)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            langs, score = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def learn(docs: DataFrame, most: int = PROFILE) -> Classifier:
    """A classifier from the whole texts of all rows with a language. ``most`` rows a language come to the driver."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang")).distinct()
    if known.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Classifier([tuple(r) for r in profiles(docs, most).collect()], most)


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for every row, learned from rows whose crc32 of the id is not 1 modulo 3.

    ``und`` with score 0 are null, empty and letterless texts, and all texts where there is nothing
    to learn from. Ties go to the language that comes first. Repeated rows come
    out as often as they went in; an empty table gives an empty table; columns other than doc_id, text
    and (for learning) lang are not looked at.
    """
    model = learn(docs.where(remainder("doc_id", 3) != 1))
    found = predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
