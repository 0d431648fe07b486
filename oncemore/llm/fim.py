"""Fill-in-middle texts, cut at places chosen from a compressed set of token ends.

The ends of a text's tokens form a sorted set of positions. It is kept as
containers of 65,536 positions each, every one in the smallest of three forms
(a list, a bitmap, or runs), with the number of positions before each container.
The k-th end is found by searching these numbers for its container, and by
counting within that one; no text is cut into pieces to count them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oncemore.llm.common import as_bytes, chunks

#: Percent of the texts that are rearranged, and of those, percent with the suffix first.
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

ARRAY, BITMAP, RUN = "array", "bitmap", "run"
#: Positions of a container, and its bytes as a bitmap.
SPAN, BITMAP_BYTES = 1 << 16, 1 << 13


class BoundarySet:
    """A set of non-negative integers, made from a sorted array without repeats."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        keys, starts = np.unique(values >> 16, return_index=True)
        self.keys = keys
        #: How many values come before each container, and all of them.
        self.before = np.append(starts, len(values)).astype(np.int64)
        low = values & (SPAN - 1)
        self.containers = [_container(low[a:b]) for a, b in zip(self.before, self.before[1:], strict=False)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The value that has ``k`` smaller ones."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        kind, data = self.containers[at]
        return int(self.keys[at]) * SPAN + _SELECT[kind](data, k - int(self.before[at]))


def _container(low: np.ndarray) -> tuple[str, object]:
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    sizes = {ARRAY: 2 * len(low), BITMAP: BITMAP_BYTES, RUN: 2 + 4 * (len(breaks) + 1)}
    kind = min(sizes, key=sizes.get)
    if kind == ARRAY:
        return kind, low.astype(np.uint16)
    if kind == RUN:
        first = np.concatenate(([0], breaks))
        # Where the runs start, and how many values come before each.
        return kind, (low[first].astype(np.uint16), first.astype(np.uint32))
    bits = np.zeros(SPAN, np.uint8)
    bits[low] = 1
    return kind, np.packbits(bits, bitorder="little").view(np.uint64)


def _select_in_run(data: tuple[np.ndarray, np.ndarray], k: int) -> int:
    starts, before = data
    run = int(np.searchsorted(before, k, side="right")) - 1
    return int(starts[run]) + k - int(before[run])


def _select_in_bitmap(words: np.ndarray, k: int) -> int:
    upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)
    at = int(np.searchsorted(upto, k, side="right"))
    bits = np.unpackbits(words[at : at + 1].view(np.uint8), bitorder="little")
    return 64 * at + int(np.flatnonzero(bits)[k - (int(upto[at - 1]) if at else 0)])


_SELECT = {ARRAY: lambda data, k: int(data[k]), BITMAP: _select_in_bitmap, RUN: _select_in_run}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def token_ends(texts: list[bytes]) -> list[np.ndarray]:
    """Where the tokens of each text end, in code points: after every word, and at the end of a text that ends in white space."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if not len(raw):
        return [np.zeros(0, np.int64)] * len(texts)
    space = _SPACE[raw]
    last = np.zeros(len(raw), bool)
    last[stops[np.diff(stops, prepend=0) > 0] - 1] = True
    end = last.copy()
    end[:-1] |= ~space[:-1] & space[1:]
    upto = np.cumsum((raw & 0xC0) != 0x80)
    at = np.flatnonzero(end)
    cuts = np.searchsorted(at, stops)
    out, start, first = [], 0, 0
    for cut, stop in zip(cuts.tolist(), stops.tolist(), strict=True):
        out.append(upto[at[first:cut]] - (int(upto[start - 1]) if start else 0))
        first, start = cut, stop
    return out


def _draw(digest: Column, nth: int) -> Column:
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("bigint")


def rearranged(
    docs: DataFrame, seed: int = 42, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """``doc_id``, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` for every row of ``docs``.

    The form is ``plain`` (the text as it is; both lengths null), ``psm``
    (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). Form and cuts
    follow from the SHA-256 of ``seed`` and doc_id, so reruns agree and equal
    rows come out equal, as often as they went in. A null text counts as empty;
    an empty text, and one that contains a mark, is plain. A null doc_id draws
    like an empty one. An empty table gives an empty table; other columns are
    not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (_draw(digest, 3) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(_draw(digest, 4) % 100 < spm_percent, "spm").otherwise("psm")
    drawn = docs.select("doc_id", text.alias("text"), form.alias("form"), _draw(digest, 1).alias("h1"), _draw(digest, 2).alias("h2"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts = as_bytes(part.column("text"))
            draws = [part.column(c).to_pylist() for c in ("form", "h1", "h2")]
            counts, prefixes, middles, outputs = [], [], [], []
            for raw, ends, kind, h1, h2 in zip(texts, token_ends(texts), *draws, strict=True):
                counts.append(len(ends))
                if kind == "plain":
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(raw)
                    continue
                ranks = sorted(h % (len(ends) + 1) for h in (h1, h2))
                tokens = BoundarySet(ends)
                a, b = (tokens.select(r - 1) if r else 0 for r in ranks)
                whole = raw.decode("utf-8", "surrogateescape")
                pieces = {PREFIX: whole[:a], MIDDLE: whole[a:b], SUFFIX: whole[b:]}
                order = (PREFIX, SUFFIX, MIDDLE) if kind == "psm" else (SUFFIX, PREFIX, MIDDLE)
                prefixes.append(a)
                middles.append(b - a)
                outputs.append("".join(m + pieces[m] for m in order).encode("utf-8", "surrogateescape"))
            columns = [
                part.column("doc_id"),
                pa.array(counts, pa.int64()),
                part.column("form"),
                pa.array(prefixes, pa.int64()),
                pa.array(middles, pa.int64()),
                pa.array(outputs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(docs.dtypes)["doc_id"]
    out = drawn.mapInArrow(
        cut, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"
    )
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text behind a rearranged one. Without marks of its own in it, each mark is found once."""

    def after(mark: str, x: Column) -> Column:
        return F.split_part(x, F.lit(mark), F.lit(2))

    def until(mark: str, x: Column) -> Column:
        return F.split_part(x, F.lit(mark), F.lit(1))

    psm = F.concat(until(SUFFIX, after(PREFIX, output)), after(MIDDLE, output), until(MIDDLE, after(SUFFIX, output)))
    spm = F.concat(until(MIDDLE, after(PREFIX, output)), after(MIDDLE, output), until(PREFIX, after(SUFFIX, output)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rearranged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
