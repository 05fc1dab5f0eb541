"""HTML extraction with host suffix arrays.

A page is read as a stream of blocks. Markup says what is chrome by nature (menus,
headers, footers, sidebars, forms, notices, adverts, comments, scripts); of a header inside an article its headings stay. The pages' other
token streams, those outside of articles, are concatenated by host: a suffix array finds the long substrings that repeat across distinct contents, and
blocks that these cover are boilerplate, but for the unique runs in them, however short. On pages without an article element every block is
decided so; inside an article only a block of RUN tokens or more goes that such substrings cover whole, a notice that stands in the chrome of other pages. A substring counts as repeated
if it stands in LEAST contents of its host and in SHARE of them, or in all if there are fewer than LEAST; copies of a page are one content. What articles repeat
among themselves, as quotes or copies, stays.

The suffix arrays are built over the pages of one Arrow batch and host; each hands on the
number of contents of every substring of RUN tokens, and a shuffle by substring adds
them up. Contents that stand on several pages are counted apart, each once. So repeats count across all pages of a host, and no task ever holds a host.

Defined results: null html is an empty page; a page without text gives an empty string; very long pages are read whole, and tasks take few pages at once; a null
url is a host of its own; pages that repeat give rows each (one page_id twice doesn't make
its own text boilerplate), and ties don't arise, as no order decides anything; an unclosed article runs to the end of the page; an empty
table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, with_membership, written

#: Tokens of a substring that counts as long, and the share of a block's tokens that makes it boilerplate.
RUN = 8
COVERED = 0.5
#: Distinct contents of a host in which a repeated substring stands at least, and their share.
LEAST, SHARE = 3, 0.1

#: Pages that a worker holds at once.
PAGES = 64

#: Tags whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "title", "annotation", "annotation-xml"}
#: Those of them that may stand within a line and don't end a block.
WITHIN = {"script", "style", "svg", "annotation", "annotation-xml"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "head", "fieldset"}
ARTICLE = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mpadded", "mfenced", "mtable", "mtr", "mtd",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of a class, id or role that name chrome.
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies",
    "consent", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup",
    "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words beside them in compounds that still name chrome, as in site-footer; other compounds, as related-work, are left to the host's evidence.
BESIDE = {"", "site", "global", "container", "wrapper", "wrap", "bar", "box", "area", "buttons", "links", "inner", "link", "button", "list"}
#: Names that start so speak of the page around, as in has-sidebar.
LAYOUT = ("has-", "no-", "with-", "without-")

#: Attribute values may be quoted; unquoted ones end at white space or the tag's end, and quotes inside them mean nothing.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?+)*+)>""", re.S)
ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
HEADING = re.compile(r"h[1-6]$")
#: Elements of an article that no name makes chrome: a heading's id is its anchor, a quote's class its looks.
OWN = {"h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figure", "figcaption", "pre", "table", "dl"}


def is_chrome(tag: str, attrs: str, article: bool = False) -> bool:
    """By element, by a hidden attribute, or by a class, id or role; inside an article ids are anchors and decide nothing."""
    if tag in CHROME:
        return True
    if tag in ("body", "html") or len(attrs) < 4:
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return True
        named = name in ("class", "role") and not (article and tag in OWN) or name == "id" and not article and not HEADING.match(tag)
        if named and tag not in ARTICLE and any(map(names_chrome, value.lower().split())):
            return True
    return False


def names_chrome(name: str) -> bool:
    """Whether a class, id or role is a chrome word or a compound of such words alone."""
    if name.startswith(LAYOUT):
        return False
    words = set(re.split(r"[^a-z]+", name))
    return bool(words & CHROME_WORDS) and words <= CHROME_WORDS | BESIDE


def blocks_of(page: str) -> tuple[list[str], list[str], bool]:
    """(blocks of the article, or those that are open), (blocks outside it), whether the page has an article."""
    inside: list[str] = []
    outside: list[str] = []
    chrome: list[str] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, chrome, article: as they hold inside it
    hidden, article, found, at = False, False, False, 0

    def close() -> None:
        if text:
            # references are decoded once per block, and only then is white space folded
            block = SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            text.clear()
            if block:
                (chrome if hidden else inside if article else outside).append(block)

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(html_lib.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                if tag not in WITHIN:
                    close()
                shut = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = shut.end() if shut else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            # inline markup matters only where it names chrome, and for what is nested in that
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag or stack[k][0] not in INLINE), -1)
            held = depth >= 0 and stack[depth][0] == tag
            if closing and held:
                close()
                del stack[depth:]
                hidden, article = stack[-1][1:] if stack else (False, False)
            elif not closing and tag not in VOID and not m[3].endswith("/") and (held or is_chrome(tag, m[3], article)):
                close()
                hidden = True
                stack.append((tag, hidden, article))
            continue
        close()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            hidden, article = stack[-1][1:] if stack else (False, False)
        elif tag not in VOID and not m[3].endswith("/"):
            if tag == "p" or tag == "li" or HEADING.match(tag):  # these can't hold themselves: an open one ends here
                while stack and stack[-1][0] == tag:
                    stack.pop()
                hidden, article = stack[-1][1:] if stack else (False, False)
            if hidden and HEADING.match(tag) and stack and stack[-1][0] == "header" and article and not any(h for _, h, _ in stack[:-1]):
                hidden = is_chrome(tag, m[3], article)  # the title of an article in its own header
            else:
                hidden = hidden or is_chrome(tag, m[3], article)
            if tag in ARTICLE and not hidden:
                article = found = True
            stack.append((tag, hidden, article))
    close()
    return (inside, outside + chrome, True) if found else (outside, chrome, False)


def host_of(url: str | None) -> str:
    if url is None:
        return "\x00"
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
    return (m[1] if m else "").lower()


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``tokens`` ordered by their first ``depth`` tokens at least (prefix doubling)."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and n:
        after = np.full(n, -1, dtype=np.int64)
        if k < n:
            after[:-k] = rank[k:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def _token_hashes(block: str) -> list[int]:
    import zlib

    return [zlib.crc32(w.encode()) for w in block.split()]


def run_keys(streams: list[list[list[int]]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """From pages, as blocks of token hashes: a 64-bit key for every substring of ``run`` tokens, with the number of pages it stands on.

    Blocks are separated by tokens of their own, so no substring leaves its block. Shorter blocks
    count as one substring, padded by the separator.
    """
    tokens: list[int] = []
    pages: list[int] = []
    starts: list[bool] = []
    for page, blocks in enumerate(streams):
        for block in blocks:
            n = len(block)
            if not n:
                continue
            padded = [*block, *[1 << 33] * max(1, run - n)]
            tokens += padded
            pages += [page] * len(padded)
            starts += [k <= max(0, n - run) for k in range(len(padded))]
    t = np.asarray(tokens, dtype=np.int64)
    if not len(t):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    order = suffix_array(t, run)
    order = order[np.asarray(starts)[order]]
    width = np.minimum(order[:, None] + np.arange(run)[None, :], len(t) - 1)
    grams = t[width]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)])  # LCP below run: another substring
    group = np.cumsum(new) - 1
    page = np.asarray(pages, dtype=np.int64)[order]
    stands = np.unique(group * len(streams) + page) // len(streams)  # each page once a substring
    return gram_keys(grams[new]), np.bincount(stands, minlength=group[-1] + 1)


def gram_keys(grams: np.ndarray) -> np.ndarray:
    key = np.zeros(len(grams), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):
            key = (key ^ grams[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the article, or all that are open, and the blocks outside; content: a hash of the page."""
    for batch in lean(batches, PAGES):
        blocks, others, found, hosts = [], [], [], []
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
            inside, outside, has = blocks_of(page.as_py() or "")
            blocks.append(inside)
            others.append(outside if has else [])
            found.append(has)
            hosts.append(host_of(url))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), batch.column("content"), pa.array(hosts, pa.string()), pa.array(found, pa.bool_()), pa.array(blocks, pa.list_(pa.string())), pa.array(others, pa.list_(pa.string()))],
            names=["page_id", "url", "content", "host", "article", "blocks", "outside"],
        )


def _evidence(batches: Iterator[pa.RecordBatch], each: bool) -> Iterator[pa.RecordBatch]:
    """Substrings of blocks outside of articles by host with their number of pages; key 0 and part 1 count the pages. With ``each``, page by page, and the page's content."""
    for batch in lean(batches):
        hosts: dict[tuple[str, int | None], list] = {}
        for host, content, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            streams = hosts.setdefault((host, content if each else None), [])
            if not each or not streams:
                streams.append([_token_hashes(b) for b in blocks.as_py()])
        for (host, content), streams in hosts.items():
            keys, n = run_keys(streams, RUN)
            k = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([host] * (k + 1)), pa.array([*[0] * k, 1], pa.int8()), pa.array(np.append(keys, 0), pa.int64()), pa.array(np.append(n, len(streams)), pa.int64()), pa.array([content] * (k + 1), pa.int64())],
                names=["host", "part", "run_key", "n", "content"],
            )


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """(host, run_key) of the substrings of RUN tokens that repeat in distinct contents of a host, outside of articles."""
    copied = written(parsed.groupBy("content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("content"), "html-copied")
    rows = parsed.select("host", "content", F.when(F.col("article"), F.col("outside")).otherwise(F.col("blocks")).alias("streams"))
    schema = "host string, part byte, run_key long, n long, content long"
    if copied.isEmpty():
        found = rows.mapInArrow(lambda b: _evidence(b, False), schema).drop("content")
    else:
        rows = with_membership(rows, F.col("content"), copied, "maybe")
        single = rows.filter("not maybe").drop("maybe").mapInArrow(lambda b: _evidence(b, False), schema).drop("content")
        several = rows.filter("maybe").drop("maybe").mapInArrow(lambda b: _evidence(b, True), schema).distinct().drop("content")
        found = single.unionByName(several)
    counts = written(found.groupBy("host", "part", "run_key").agg(F.sum("n").alias("n")).filter("n > 1 or part = 1"), "html-counts")
    hosts = counts.filter("part = 1").select("host", F.col("n").alias("contents"))
    least = F.least("contents", F.greatest(F.lit(LEAST), F.ceil(SHARE * F.col("contents"))))
    return counts.filter("part = 0").join(hosts, "host").filter(F.col("n") >= least).select("host", "run_key")


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, run_key) of the first RUN tokens of each block that has so many."""
    import zlib

    for batch in lean(batches):
        rows, hosts, grams = [], [], []
        for row, host, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            for block in blocks.as_py():
                words = block.split(None, RUN)[:RUN]
                if len(words) == RUN:
                    rows.append(row)
                    hosts.append(host)
                    grams.append([zlib.crc32(w.encode()) for w in words])
        keys = gram_keys(np.asarray(grams, dtype=np.int64).reshape(-1, RUN))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(hosts, pa.string()), pa.array(keys, pa.int64())], names=["row", "host", "run_key"])


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per substring of each block: row, block, at, n_tokens, host, run_key."""
    for batch in lean(batches):
        for row, host, blocks in zip(batch.column("row").to_pylist(), batch.column("host").to_pylist(), batch.column("blocks"), strict=True):
            for b, block in enumerate(blocks.as_py()):
                hashes = _token_hashes(block)
                n = len(hashes)
                padded = np.asarray([*hashes, *[1 << 33] * max(0, RUN - n)], dtype=np.int64)
                grams = np.lib.stride_tricks.sliding_window_view(padded, RUN)
                k = len(grams)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * k), pa.array([b] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int32()), pa.array([host] * k), pa.array(gram_keys(grams))],
                    names=["row", "block", "at", "n_tokens", "host", "run_key"],
                )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks as text; of those with repeated runs only the tokens that aren't covered."""
    for batch in lean(batches, PAGES):
        texts = []
        for blocks, cuts in zip(batch.column("blocks").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            for cut in cuts or ():
                words = blocks[cut["block"]].split()
                ends = [a + RUN for a in cut["ats"]]
                free = [words[a:b] for a, b in zip([0, *ends], [*cut["ats"], len(words)], strict=True) if b > a]
                blocks[cut["block"]] = " ".join(w for run in free for w in run)
            texts.append("\n\n".join(b for b in blocks if b))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages. A page is parsed once; its blocks move only if a repeated run may stand in them."""
    kind = dict(pages.dtypes)["page_id"]
    parsed = pages.select("page_id", "url", "html", F.xxhash64("html").alias("content")).mapInArrow(_parse, f"page_id {kind}, url string, content long, host string, article boolean, blocks array<string>, outside array<string>")
    parsed = written(parsed.withColumn("row", F.expr("uuid()")), "html-parsed")
    runs = written(repeated_runs(parsed), "html-runs")
    if runs.isEmpty():  # nothing repeats, so nothing is cut
        return parsed.select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"))

    # articles with a block that starts with a repeated run are looked at again, and all pages without an article
    first = parsed.filter("article").select("row", "host", "blocks").mapInArrow(_first_runs, "row string, host string, run_key long")
    known = runs.select(F.xxhash64("host", "run_key").alias("h"))
    first = with_membership(first, F.xxhash64("host", "run_key"), known, "maybe").filter("maybe").join(runs, ["host", "run_key"], "left_semi")
    suspects = written(first.select("row").distinct(), "html-suspects")
    again = with_membership(parsed.filter("article"), F.xxhash64("row"), suspects.select(F.xxhash64("row").alias("h")), "maybe").filter("maybe").join(suspects, "row", "left_semi")
    looked = parsed.filter("not article and size(blocks) > 0").select("row", "host", "blocks").unionByName(again.select("row", "host", "blocks"))
    at = looked.mapInArrow(_open_runs, "row string, block int, at int, n_tokens int, host string, run_key long")
    at = with_membership(at, F.xxhash64("host", "run_key"), known, "maybe").filter("maybe").drop("maybe")
    hits = at.join(runs, ["host", "run_key"]).groupBy("row", "block").agg(F.collect_set("at").alias("ats"), F.max("n_tokens").alias("n"))
    # tokens under at least one repeated substring, from the sorted starts
    hits = hits.withColumn("ats", F.array_sort("ats"))
    cover = F.aggregate("ats", F.struct(F.lit(0).alias("c"), F.lit(0).alias("e")), lambda a, s: F.struct((a["c"] + F.least(s + RUN, F.col("n")) - F.greatest(a["e"], s)).alias("c"), F.least(s + RUN, F.col("n")).alias("e")))["c"]
    bad = hits.withColumn("cover", cover).filter(F.col("cover") >= COVERED * F.col("n"))
    cuts = written(bad.groupBy("row").agg(F.collect_list(F.struct("block", "ats", ((F.col("cover") == F.col("n")) & (F.col("n") >= RUN)).alias("whole"))).alias("cuts")), "html-cuts")

    rows = with_membership(parsed, F.xxhash64("row"), cuts.select(F.xxhash64("row").alias("h")), "maybe")
    sure = rows.filter("not maybe").select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"))
    applied = F.when(F.col("article"), F.filter("cuts", lambda c: c["whole"])).otherwise(F.col("cuts"))
    rest = rows.filter("maybe").join(cuts, "row", "left").select("page_id", "url", "blocks", applied.alias("cuts"))
    return sure.unionByName(rest.mapInArrow(_cut, f"page_id {kind}, url string, text string"))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
