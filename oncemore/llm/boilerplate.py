"""Main text of web pages, with a suffix array per host for what the markup leaves open.

The words of a page outside its article form its token stream. Streams of a host
are concatenated, and a suffix array finds the long runs that distinct pages
share; those runs are removed and the unique runs stay. The markup then rules
out what is unique and still no main text (menus, footers, forms, adverts,
comments and the like). In an article element sentences recur that belong to it, so there
only what is nearly everywhere goes: whole blocks of runs that ``SITE`` of the host's articles share,
as of a notice that no name marks. A word that fewer articles have is in no such run; what is left
goes through the suffix arrays like any stream. An article that mostly consists of such runs is a copy and stays.
An article that is itself ruled out (a comment, say) is none, and neither are
several articles that have fewer words than the text beside them (teasers).

Hosts are cut into shards of bounded size. A shard reports its distinct runs of
``RUN`` words with the number of pages that have them (two are enough), and
Spark adds the shards up, so that a run that two shards have once each is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oncemore.llm.common import as_bytes, chunks, filter_of, in_filter, mixed, perhaps_in, stored, word_hashes
from oncemore.llm.hostrules import host_of

#: Words of a run that counts as repeated; a power of two.
RUN = 8
#: A run is no boilerplate on a page of which it is more than this part: the page is a copy.
MOST = 0.5
#: Stream words in a shard of a host, about.
SHARD_WORDS = 20_000
#: A run in articles goes if this part of the host's articles have it at least, ...
SITE = 0.9
#: ... and the host has as many articles at least.
SITE_PAGES = 10

# Elements and names of what is not main text.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "head", "math", "canvas")
DROPPED = {"nav", "footer", "aside", "form", "button", "menu", "dialog"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "sponsor", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "comment", "comments", "disqus", "replies", "reply", "respond", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "share", "sharing", "social", "related",
    "recommended", "toolbar", "pagination", "pager", "copyright", "contentinfo", "complementary", "search", "form",
}
NEUTRAL = {
    "site", "page", "main", "top", "bottom", "left", "right", "box", "block", "container", "wrapper", "wrap", "list", "section",
    "area", "bar", "global", "primary", "secondary", "item", "items", "link", "links", "inner", "row", "post", "reader", "user",
    "widget", "panel", "unit", "slot", "thread", "body", "text", "google",
}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def _named_away(attributes: str, in_article: bool) -> bool:
    for match in _NAMED.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").split():
            words = [re.sub(r"\d+$", "", w) for w in re.split(r"[-_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())]
            hit = NAMES.intersection(words) - ({"header"} if in_article else set())
            if hit and all(w in NAMES or w in NEUTRAL or not w for w in words):
                return True
    return False


def blocks(html: str) -> list[tuple[str, int, bool]]:
    """Text, in which article (or main) element it is (0 for none), and whether its surroundings rule it out, of each block."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []
    text: list[str] = []
    articles = 0

    def flush() -> None:
        words = unescape("".join(text)).split()
        text.clear()
        if words:
            _, article, gone = stack[-1] if stack else ("", 0, False)
            out.append((" ".join(words), article, gone))

    at = 0
    for match in _MARKUP.finditer(html):
        if match.start() > at:
            text.append(html[at : match.start()])
        at = match.end()
        tag = (match[3] or match[6] or "").lower()
        if not tag:
            continue
        closing = bool(match[2] or match[5])
        inline = tag in INLINE
        attributes = match[4] or match[7] or ""
        _, article, gone = stack[-1] if stack else ("", 0, False)
        if not inline:
            flush()
            while stack and stack[-1][0] == "p" and tag not in VOID and not closing:
                stack.pop()
            _, article, gone = stack[-1] if stack else ("", 0, False)
        if tag in VOID:
            continue
        if closing:
            if any(s[0] == tag for s in stack):
                if inline:
                    flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        away = tag not in ("html", "body") and (
            tag in DROPPED or (tag == "header" and not article) or (bool(attributes) and _named_away(attributes, article))
        )
        if inline and not away:
            continue
        if inline:
            flush()
        main = tag in ("article", "main") or bool(attributes) and bool(re.search(r"role\s*=\s*[\"']?main\b", attributes))
        if main and not article:
            articles += 1
            article = articles
        stack.append((tag, article, gone or away))
    text.append(html[at:])
    flush()
    return out


def main_text(found: list[tuple[str, int, bool]]) -> tuple[str | None, list[tuple[str, bool]]]:
    """The article's blocks, a line each (None where the markup names no article), and the blocks outside, with whether they are ruled out."""
    main = [(t, article) for t, article, gone in found if article and not gone]
    outside = [(t, gone) for t, article, gone in found if not article]
    if len({article for _, article in main}) > 1:
        beside = sum(len(t.split()) for t, gone in outside if not gone)
        if beside > sum(len(t.split()) for t, _ in main):
            return None, outside
    return "\n".join(t for t, _ in main) if main else None, outside


def streams(pages: DataFrame) -> DataFrame:
    """Per page: ``row, page_id, url, main`` (null: none named), the ``outside`` blocks and their words' hashes, ``tokens``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for part in chunks(batches, "html"):
            main, outside = zip(*(main_text(blocks(h or "")) for h in part.column("html").to_pylist()), strict=True)
            hashes, ends = word_hashes([" ".join(t for t, _ in o).encode() for o in outside], lower=False)
            tokens = [hashes[a:b].tobytes() for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(part.num_rows), pa.int64()),
                    part.column("page_id"),
                    part.column("url"),
                    pa.array(main, pa.string()),
                    pa.array([[{"text": t, "gone": g} for t, g in o] for o in outside], pa.list_(_BLOCK)),
                    pa.array(tokens, pa.binary()),
                ],
                ["row", "page_id", "url", "main", "outside", "tokens"],
            )
            row += part.num_rows

    kinds = dict(pages.dtypes)
    schema = (
        f"row bigint, page_id {kinds['page_id']}, url {kinds['url']}, main string, "
        "outside array<struct<text: string, gone: boolean>>, tokens binary"
    )
    return pages.select("page_id", "url", "html").mapInArrow(of, schema)


_BLOCK = pa.struct([("text", pa.string()), ("gone", pa.bool_())])


def gram_hashes(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """A hash of every ``run`` words in a row."""
    n = max(len(tokens) - run + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(run if n else 0):
        total = (total + tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(total).view(np.int64)


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``tokens`` by prefix doubling down to ``depth`` words, and each suffix's rank; equal ranks share ``depth`` words."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < depth and len(rank):
        after = np.full(len(rank), -1, np.int64)
        after[:-width] = rank[width:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1]
        width *= 2
    return np.argsort(rank, kind="stable"), rank


def _shard_runs(table: pa.Table) -> pa.Table:
    """The distinct runs of a shard of a host, with the number of pages that have it."""
    parts = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    pages = np.unique(table["row"].to_numpy(), return_inverse=True)[1]
    # A word of its own after each part keeps runs within parts.
    ends = np.cumsum([len(x) + 1 for x in parts])
    flat = np.concatenate([y for k, x in enumerate(parts) for y in (x, np.array([k], np.uint64))])
    part = np.searchsorted(ends, np.arange(len(flat)), side="right")
    order, rank = suffix_order(flat, RUN)
    order = order[order + RUN < ends[part[order]]]
    if not len(order):
        return _RUNS.empty_table()
    ranks = rank[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(ranks) != 0)))
    # Each page of a run counts once.
    once = np.unique(ranks * len(pages) + pages[part[order]])
    n = np.unique(once // len(pages), return_counts=True)[1]
    grams = gram_hashes(flat)[order[first]]
    host = table["host"][0].as_py()
    return pa.table([pa.array([host] * len(first), pa.string()), grams, n], schema=_RUNS)


_RUNS = pa.schema([("host", pa.string()), ("gram", pa.int64()), ("pages", pa.int64())])


def host_runs(found: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``host``, ``gram`` and number of ``pages`` of the runs in the ``tokens`` of a host's rows; a page may have several rows."""
    words = F.length("tokens") / 8
    hosts = found.groupBy("host").agg(F.sum(words).alias("words"))
    shards = F.greatest(F.ceil(F.col("words") / shard_words), F.lit(1))
    dealt = found.select("row", "host", "tokens").join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    dealt = dealt.select("row", "host", "tokens", F.pmod(F.xxhash64("row"), shards).alias("shard"))
    runs = dealt.groupBy("host", "shard").applyInArrow(_shard_runs, "host string, gram bigint, pages bigint")
    return runs.groupBy("host", "gram").agg(F.sum("pages").alias("pages"))


def repeated_runs(found: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``host`` and ``gram`` of the runs that two pages of a host or more share."""
    return host_runs(found, shard_words).where("pages >= 2").select("host", "gram")


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of articles, hashes of word and host, and where each article starts and ends."""
    hashes, ends = word_hashes(as_bytes(part.column("main")), lower=False)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    hosts = part.column("hh").to_numpy(zero_copy_only=False).view(np.uint64)
    return hashes, mixed(hashes + np.repeat(hosts, ends - starts)), starts, ends


def site_streams(articles: DataFrame) -> DataFrame:
    """Of each article (``row``, ``host``, ``main``) the stretches of ``RUN`` words or more that ``SITE`` of its host's articles have each.

    ``base`` is a stretch's first word and ``tokens`` its words' hashes. A Bloom filter holds the words; it lets
    others through at times, and loses none.
    """
    rows = articles.select("row", "host", "main", F.xxhash64("host").alias("hh"))

    def words(batches: Iterator[pa.RecordBatch], known=None) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "main"):
            _, keys, starts, ends = _keys(part)
            each = [np.unique(keys[a:b]) for a, b in zip(starts, ends, strict=True)]
            page = np.repeat(np.arange(len(each)), [len(x) for x in each])
            key, first, n = np.unique(np.concatenate(each), return_index=True, return_counts=True)
            hosts = part.column("hh").to_numpy(zero_copy_only=False)
            if known is None:
                _, at, articles = np.unique(hosts, return_inverse=True, return_counts=True)
                ok = n >= SITE * articles[at[page[first]]] - 1e-9
            else:
                ok = in_filter(known.value, key)
            columns = [pa.array(key[ok].view(np.int64)), pa.array(hosts[page[first[ok]]]), pa.array(n[ok])]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "hh", "n"])

    # What this part of a host's articles have, this part of those in some piece of the input have as well.
    schema, spark = "hash bigint, hh bigint, n bigint", articles.sparkSession
    known = spark.sparkContext.broadcast(filter_of(rows.mapInArrow(words, schema).select("hash")))
    counts = rows.mapInArrow(lambda batches: words(batches, known), schema).groupBy("hash", "hh").agg(F.sum("n").alias("n"))
    sizes = rows.groupBy("hh").agg(F.count("*").alias("articles")).where(F.col("articles") >= SITE_PAGES)
    often = counts.join(sizes, "hh").where(F.col("n") >= SITE * F.col("articles"))
    bits = spark.sparkContext.broadcast(filter_of(often.select("hash")))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "main"):
            hashes, keys, starts, ends = _keys(part)
            ok = in_filter(bits.value, keys).view(np.int8)
            page, base, tokens = [], [], []
            for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
                edges = np.flatnonzero(np.diff(np.concatenate(([0], ok[a:b], [0]))))
                for start, stop in zip(edges[::2], edges[1::2], strict=True):
                    if stop - start >= RUN:
                        page.append(k)
                        base.append(start)
                        tokens.append(hashes[a + start : a + stop].tobytes())
            own = pa.array(page, pa.int64())
            columns = [part.column("row").take(own), part.column("host").take(own), pa.array(base, pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "host", "base", "tokens"])

    return rows.mapInArrow(stretches, "row bigint, host string, base bigint, tokens binary")


def site_runs(articles: DataFrame, found: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``host`` and ``gram`` of the runs in ``found`` (stretches of ``articles``) that ``SITE`` of a host's articles share."""
    sizes = articles.groupBy("host").agg(F.count("*").alias("articles")).where(F.col("articles") >= SITE_PAGES)
    runs = host_runs(found, shard_words).join(sizes.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return runs.where(F.col("pages") >= SITE * F.col("articles")).select("host", "gram")


def covered(n: int, repeated: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are in runs that start at ``repeated``; a run that is most of the words is not covered."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + RUN, -1)
    out = np.cumsum(cover)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
    for start, stop in zip(edges[::2], edges[1::2], strict=True):
        if stop - start > MOST * n:
            out[start:stop] = False
    return out


def extract(pages: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` and ``n_repeated`` of every page.

    ``n_repeated`` are the words that go as parts of runs which other pages of the host share. A null or
    empty page has an empty text. Pages with a null url form a host of their own. Repeated rows
    come out as often as they went in and count as distinct pages. An empty table gives an empty
    table; other columns are not looked at.
    """
    found = stored(streams(pages).withColumn("host", host_of(F.col("url").cast("string"))), "streams")

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            grams = [gram_hashes(np.frombuffer(x, np.uint64)) for x in part.column("tokens").to_pylist()]
            sizes = np.array([len(g) for g in grams], np.int64)
            page = pa.array(np.repeat(np.arange(len(grams)), sizes))
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gram = np.concatenate(grams) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(page), part.column("host").take(page), pa.array(gram), pc.add(pa.array(at), part.column("base").take(page))],
                ["row", "host", "gram", "at"],
            )

    def met(rows: DataFrame, runs: DataFrame) -> DataFrame:
        """Per row of which parts are in ``runs``: where these start."""
        placed = rows.select("row", "host", "base", "tokens").mapInArrow(starts, "row bigint, host string, gram bigint, at bigint")
        runs = runs.select(F.col("host").alias("h"), F.col("gram").alias("g"))
        hits = placed.join(runs, F.col("host").eqNullSafe(F.col("h")) & (F.col("gram") == F.col("g")), "left_semi")
        return hits.groupBy("row").agg(F.collect_list("at").alias("starts"))

    named = F.col("main").isNotNull()
    outside = found.where(~named).withColumn("base", F.lit(0).cast("bigint"))
    per_page = met(outside, stored(repeated_runs(found, shard_words), "runs"))
    own = found.where(named)
    stretches = stored(site_streams(own), "stretches")
    per_article = stored(met(stretches, stored(site_runs(own, stretches, shard_words), "site_runs")), "per_article")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, n = [], []
            columns = (part.column(c).to_pylist() for c in ("outside", "starts"))
            for outside, at in zip(*columns, strict=True):
                words = [(w, b["gone"]) for b in outside for w in b["text"].split()]
                away = covered(len(words), np.array(at or [], np.int64))
                texts.append(" ".join(w for (w, gone), a in zip(words, away, strict=True) if not a and not gone))
                n.append(int(away.sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(n, pa.int64())],
                ["page_id", "url", "text", "n_repeated"],
            )

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, n = [], []
            for main, at in zip(part.column("main").to_pylist(), part.column("starts").to_pylist(), strict=True):
                lines = main.split("\n")
                ends = np.cumsum([len(t.split()) for t in lines])
                away = covered(int(ends[-1]), np.array(at or [], np.int64))
                whole = np.logical_and.reduceat(away, np.concatenate(([0], ends[:-1])))
                gone = int(np.diff(ends, prepend=0)[whole].sum())
                whole &= gone <= MOST * len(away)
                texts.append(" ".join(t for t, w in zip(lines, whole, strict=True) if not w))
                n.append(gone if whole.any() else 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(n, pa.int64())],
                ["page_id", "url", "text", "n_repeated"],
            )

    kinds = dict(pages.dtypes)
    # Pages without an article travel to their runs.
    open_ = found.where(~named).select("row", "page_id", "url", "outside").join(per_page, "row", "left")
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_repeated bigint"
    text = open_.select("page_id", "url", "outside", "starts").mapInArrow(rest, schema)
    # Of those with one, only articles that may have runs of the site.
    perhaps = perhaps_in("row", per_article.select("row"))
    fewer = own.where(perhaps).select("row", "page_id", "url", "main").join(per_article, "row", "left")
    fewer = fewer.select("page_id", "url", "main", "starts").mapInArrow(less, schema)
    whole = own.where(~perhaps).select("page_id", "url", F.translate("main", "\n", " "), F.lit(0).cast("bigint"))
    return text.union(fewer).union(whole).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_repeated")


def op10_boilerplate(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
