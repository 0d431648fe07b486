"""Repeated byte strings, by suffix arrays over shards.

Two equal strings of ``LENGTH`` bytes contain the same anchor: the ``GRAM``-byte
string with the least hash in them. Windows are therefore grouped by anchor,
neighbouring windows with one anchor travel as one segment, and anchors that
occur once in the corpus drop out before any text moves. A shard holds all
segments of some anchors; its suffix array (Larsson-Sadakane) and common
prefixes (Kasai) give the equal windows, of which the earliest stays. Where a
shard has all segments of its anchors, windows with a hash of their own have no
equal, and only the other stretches are sorted.

An anchor with very many segments is cut into several shards. Each of those
hands on its distinct windows, sorted, and the shards' lists are merged by
binary search within ranges of the sort key.

Whole copies of a text are recognised by their SHA-256 and never enter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oncemore.llm.common import _BYTE, _ROOT, _powers, as_bytes, chunks, mixed, shared_path, stored

LENGTH = 100
#: Bytes of an anchor.
GRAM = 24
#: Segments in a shard, about; an anchor with more is cut.
SHARD = 30_000
#: Bytes that a task looks at together.
CHUNK = 2 << 20
_PLACE_BITS = 24
#: A byte and the end of a segment take nine bits, so that many fit the first key.
_FIRST = 7


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor, text, start and number of windows of every run of windows that have one anchor (leftmost of the least)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
    inverse = pow(_ROOT, -1, 1 << 64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers("up", _ROOT, len(raw)), out=sums[1:])
    h = mixed((sums[gram:] - sums[:-gram]) * _powers("down", inverse, len(raw))[: len(raw) - gram + 1])
    # The upper bits of the hash, then the place: the least is the leftmost of the least.
    low = (1 << _PLACE_BITS) - 1
    key = (h & np.uint64(~low & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    place = (key & np.uint64(low)).astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    text = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + length <= ends[text]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new & inside)
    # Windows past a text's end follow its last run, so a run stops at the next change or there.
    edge = np.append(np.flatnonzero(new | ~inside), n)
    stop = edge[np.searchsorted(edge, at, side="right")]
    begin = np.concatenate(([0], ends[:-1]))
    return h[place[at]].view(np.int64), text[at], at - begin[text[at]], stop - at


def _pieces(part: pa.RecordBatch, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of the rows of ``part``; a very long text is taken in overlapping pieces."""
    limit = 1 << (_PLACE_BITS - 1)
    texts = as_bytes(part.column("text"))
    if sum(map(len, texts)) <= limit:
        yield texts, *segments(texts, length)
        return
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 1), limit):
            anchor, _, start, n = segments([text[at : at + limit + length - 1]], length)
            yield texts, anchor, np.full(len(anchor), row), start + at, n


def larsson_sadakane(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of the segments that end at ``ends``, by their first ``depth`` symbols at least.

    Symbols are bytes; the end of a segment sorts before all. Groups of suffixes
    that are not told apart yet are refined by the ranks ``width`` symbols on;
    ties keep their order in the text.
    """
    n = len(symbols)
    end = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
    left = end - np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(_FIRST):
        own = np.zeros(n, np.int64)
        own[: n - k] = symbols[k:].astype(np.int64) + 1
        key = (key << 9) | np.where(left > k, own, 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.diff(key[order]) != 0
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = _FIRST
    while width < depth:
        first = np.append(np.flatnonzero(new), n)
        open_ = np.repeat(np.diff(first) > 1, np.diff(first))
        slots = np.flatnonzero(open_)
        if not len(slots):
            break
        here = order[slots]
        ahead = np.where(left[here] > width, rank[np.minimum(here + width, n - 1)] + 1, 0)
        both = rank[here] * (n + 1) + ahead
        by = np.argsort(both, kind="stable")
        here, both = here[by], both[by]
        order[slots] = here
        change = np.ones(len(slots), bool)
        change[1:] = np.diff(both) != 0
        new[slots] = change
        rank[here] = slots[np.flatnonzero(change)[np.cumsum(change) - 1]]
        width *= 2
    return order


def kasai(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix with the one before it in ``order``; indexed by suffix.

    A suffix shares at most one symbol less than the suffix one to its left did.
    All segments are walked side by side, a place of each at a time.
    """
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    begins = np.concatenate(([0], ends[:-1]))
    sizes = ends - begins
    end = np.repeat(ends, sizes)
    by_size = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[by_size], sizes[by_size]
    out = np.zeros(n, np.int64)
    h = np.zeros(len(begins), np.int64)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        active = int(np.searchsorted(-sizes, -k, side="left"))
        i = begins[:active] + k
        j = before[i]
        now = np.maximum(h[:active] - 1, 0)
        now[j < 0] = 0
        room = np.minimum(np.minimum(end[i] - i, np.where(j >= 0, end[j] - j, 0)), most)
        going = np.flatnonzero(now < room)
        while len(going):
            same = symbols[i[going] + now[going]] == symbols[j[going] + now[going]]
            going = going[same]
            now[going] += 1
            going = going[now[going] < room[going]]
        h[:active] = now
        out[i] = now
    return out


def equal_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, part and offset of every window of the (distinct) ``parts``; windows of a group are equal."""
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    symbols = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    # Sorted to the end of every segment: the step from one suffix to the next below needs the true order.
    order = larsson_sadakane(symbols, ends, max(map(len, parts), default=0))
    common = kasai(symbols, ends, order, length)
    part = np.searchsorted(ends, order, side="right")
    whole = ends[part] - order >= length
    group = np.cumsum(common[order] < length)
    begins = np.concatenate(([0], ends[:-1]))
    return group[whole], part[whole], (order - begins[part])[whole]


def repeated_parts(parts: list[bytes], length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The stretches of ``parts`` whose windows have a hash that another window has, with the number of their part and where they begin in it.

    Equal windows have equal hashes, so what is left out has no equal among ``parts``.
    """
    raw = np.frombuffer(b"".join(parts), np.uint8)
    n = len(raw) - length + 1
    if n <= 0:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    part = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.flatnonzero(np.arange(n) + length <= ends[part])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers("up", _ROOT, len(raw)), out=sums[1:])
    h = (sums[inside + length] - sums[inside]) * _powers("down", pow(_ROOT, -1, 1 << 64), len(raw))[inside]
    order = np.argsort(h, kind="stable")
    same = np.diff(h[order]) == 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = inside[twice]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(part[at]) != 0)
    begin, stop = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + length if len(at) else at
    whole = raw.tobytes()
    owner = part[begin]
    return [whole[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], owner, begin - np.concatenate(([0], ends))[owner]


def _shard_repeats(length: int):
    """For one shard: rows of what to remove, and, of a cut anchor, rows of its distinct windows."""

    def of(table: pa.Table) -> pa.Table:
        seg = table["seg"].to_pylist()
        doc, k1, k2, start = (table[c].to_numpy() for c in ("doc", "k1", "k2", "start"))
        by = np.lexsort((start, k2, k1, doc))
        first: dict[bytes, int] = {}
        gone_row, gone_at, gone_n = [], [], []
        for i in by.tolist():
            if first.setdefault(seg[i], i) != i:
                gone_row.append(i)
                gone_at.append(0)
                gone_n.append(len(seg[i]) - length + 1)
        # The distinct segments are in order of place, so the least (part, offset) is the earliest window.
        rows = np.fromiter(first.values(), np.int64, len(first))
        distinct, cut = list(first), table["cut"][0].as_py()
        if cut:
            group, part, offset = equal_windows(distinct, length)
        else:
            # All windows of these anchors are here: what none of them repeats need not be sorted.
            stretches, owner, begin = repeated_parts(distinct, length)
            group, part, offset = equal_windows(stretches, length)
            part, offset = owner[part], offset + begin[part]
        sort = np.lexsort((offset, part, group))
        group, part, offset = group[sort], part[sort], offset[sort]
        lead = np.ones(len(group), bool)
        lead[1:] = np.diff(group) != 0
        r, o = rows[part[~lead]], offset[~lead]
        sort = np.lexsort((o, r))
        r, o = r[sort], o[sort]
        new = np.ones(len(r), bool)
        new[1:] = (np.diff(r) != 0) | (np.diff(o) != 1)
        at = np.flatnonzero(new)
        gone_row = np.concatenate((np.array(gone_row, np.int64), r[at]))
        gone_at = np.concatenate((np.array(gone_at, np.int64), o[at]))
        gone_n = np.concatenate((np.array(gone_n, np.int64), np.diff(np.append(at, len(r)))))
        begin = start[gone_row] + gone_at
        out = [doc[gone_row], k1[gone_row], k2[gone_row], begin, begin + gone_n + length - 1]
        digest = [None] * len(gone_row)
        if cut:
            r, o = rows[part[lead]], offset[lead]
            digest += [
                hashlib.blake2b(seg[i][k : k + length], digest_size=16).digest() for i, k in zip(r.tolist(), o.tolist(), strict=True)
            ]
            begin = start[r] + o
            more = [doc[r], k1[r], k2[r], begin, begin + length]
            out = [np.concatenate(x) for x in zip(out, more, strict=True)]
        return pa.table([*map(pa.array, out), pa.array(digest, pa.binary())], names=["doc", "k1", "k2", "start", "stop", "digest"])

    return of


def _merge(table: pa.Table) -> pa.Table:
    """One range of the cut anchors' windows: the sorted lists are merged by binary search; all but the earliest go."""
    doc, k1, k2, start = (table[c].to_numpy() for c in ("doc", "k1", "k2", "start"))
    digest = np.frombuffer(b"".join(table["digest"].to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    by = np.lexsort((start, k2, k1, doc))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    keys = np.sort(digest.copy().view([("a", np.uint64), ("b", np.uint64)]).ravel())
    slot = np.searchsorted(keys, digest.copy().view(keys.dtype).ravel())
    least = np.full(len(keys), len(by), np.int64)
    np.minimum.at(least, slot, place)
    gone = pa.array(np.flatnonzero(least[slot] != place))
    return table.select(["doc", "k1", "k2", "start", "stop"]).take(gone)


def _blobs(docs: DataFrame) -> DataFrame:
    """Distinct texts under the first 16 bytes of their SHA-256, each with its least doc_id, bucketed by that key.

    The table is written once; joins on the key then move only the other side.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(_doc(F.col("doc_id")).alias("doc"), text.alias("text"), *_key(text))
    blobs = keyed.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    name = f"blobs_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "blobs")
    blobs.write.bucketBy(n, "k1", "k2").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _doc(doc_id):
    """Order of documents: by id, null last."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(2**63 - 1))


def _key(text) -> list:
    sha = F.sha2(text, 256)
    return [F.conv(F.substring(sha, at, 16), 16, -10).cast("bigint").alias(k) for at, k in ((1, "k1"), (17, "k2"))]


def dedup_spans(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row of ``docs``.

    A null text counts as empty. A null doc_id comes after all others. Rows with the
    same doc_id and text are one document and get the same result; of rows with the same doc_id
    and different texts, the one with the smaller SHA-256 is the earlier. An empty table
    gives an empty table; columns other than doc_id and text are not looked at.
    """
    blobs = _blobs(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            for _, anchor, *_ in _pieces(part, length):
                h, n = np.unique(anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["anchor", "n"])

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            for _, anchor, text, *_ in _pieces(part, length):
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                new = np.ones(len(text), bool)
                new[1:] = (np.diff(text) != 0) | (np.diff(anchor) != 0)
                row = pa.array(text[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new]), part.column("k1").take(row), part.column("k2").take(row)], ["anchor", "k1", "k2"]
                )

    often = blobs.select("text").mapInArrow(anchors, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    often = stored(often.where("n > 1"), "anchors")
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = total // shard + 1
    own = blobs.select("k1", "k2", "text").mapInArrow(owners, "anchor bigint, k1 bigint, k2 bigint")
    wanted = own.join(often, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "n")).alias("wanted"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            known = part.column("wanted")
            listed = known.flatten()
            rows_of = np.repeat(np.arange(part.num_rows), np.diff(known.offsets.to_numpy()))
            want = {}
            for r, a, c in zip(rows_of.tolist(), listed.field("anchor").to_pylist(), listed.field("n").to_pylist(), strict=True):
                want[r, a] = c
            for texts, anchor, text, start, n in _pieces(part, length):
                times = np.array([want.get(x, 0) for x in zip(text.tolist(), anchor.tolist(), strict=True)], np.int64)
                ok = np.flatnonzero(times)
                row = text[ok]
                seg = [texts[r][s : s + k + length - 1] for r, s, k in zip(row.tolist(), start[ok].tolist(), n[ok].tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[ok]),
                        pa.array(times[ok]),
                        part.column("doc").take(take),
                        part.column("k1").take(take),
                        part.column("k2").take(take),
                        pa.array(start[ok]),
                        pa.array(seg, pa.binary()),
                    ],
                    ["anchor", "n", "doc", "k1", "k2", "start", "seg"],
                )

    segs = blobs.join(wanted, ["k1", "k2"]).select("doc", "k1", "k2", "text", "wanted").mapInArrow(
        cut_out, "anchor bigint, n bigint, doc bigint, k1 bigint, k2 bigint, start bigint, seg binary"
    )
    cut = F.col("n") > shard
    # A cut anchor's segments are dealt by document; all others go where their anchor goes.
    segs = segs.select(
        F.when(cut, F.col("anchor")).otherwise(F.pmod("anchor", F.lit(shards))).alias("shard"),
        F.when(cut, F.pmod(F.xxhash64("k1", "k2"), F.ceil(F.col("n") / shard))).otherwise(-1).alias("part"),
        cut.alias("cut"), "doc", "k1", "k2", "start", "seg",
    )
    found = stored(
        segs.groupBy("shard", "part", "cut").applyInArrow(
            _shard_repeats(length), "doc bigint, k1 bigint, k2 bigint, start bigint, stop bigint, digest binary"
        ),
        "repeats",
    )
    windows = found.where("digest IS NOT NULL")
    ranges = windows.count() // (shard * 10) + 1
    at = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    merged = windows.withColumn("range", F.floor(at * ranges / 2**32)).groupBy("range").applyInArrow(
        _merge, "doc bigint, k1 bigint, k2 bigint, start bigint, stop bigint"
    )
    gone = found.where("digest IS NULL").drop("digest").union(merged)
    spans = gone.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", CHUNK):
            rows = []
            for text, spans in zip(as_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                cover = np.zeros(len(text) + 1, np.int32)
                for s in spans:
                    cover[s["start"]] += 1
                    cover[s["stop"]] -= 1
                away = np.cumsum(cover[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~away].tobytes()
                n_spans = int(np.count_nonzero(away[1:] & ~away[:-1])) + int(len(away) > 0 and away[0])
                rows.append((len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
            n, k, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column("k1"), part.column("k2"), part.column("doc"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())],
                ["k1", "k2", "doc", "n_removed", "n_spans", "kept_sha256"],
            )

    cleaned = blobs.join(spans, ["k1", "k2"]).select("k1", "k2", "doc", "text", "spans").mapInArrow(
        remove, "k1 bigint, k2 bigint, doc bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", _doc(F.col("doc_id")).alias("own"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha"), *_key(text)
    )
    # A narrow table: unlike the bucketed one it lets Spark split the rows of a text with very many copies.
    cleaned = stored(
        blobs.select("k1", "k2", F.col("doc").alias("least")).join(cleaned.drop("doc"), ["k1", "k2"], "left"), "cleaned"
    )
    joined = rows.join(cleaned, ["k1", "k2"])
    copy = (F.col("own") > F.col("least")) & (F.col("n_bytes") >= length)
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
