"""Main text of web pages: block structure, and a suffix array per host for repeated boilerplate.

A page is parsed into blocks. Blocks of the article (or main) element may be its text, apart from parts
marked as menus, notices, adverts, forms or reader comments; without that markup all other blocks may.
The whole token streams of a host's pages are put into one suffix array: suffixes of all pages sorted by
host and leading tokens. Neighbours that agree on at least ``run`` tokens and come from distinct pages are
repeated substrings. What they cover is boilerplate, unless it is a copy of an article, and the rest is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import broadcast_if_small, stored

# Element names, kept as fixed values of the HTML standard.
SILENT = {"script", "style", "template", "noscript", "svg", "math", "head", "title", "iframe", "object", "canvas", "select", "textarea", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form"}
#: Words that name a part that is no text, and words that may stand beside one in a class or id token.
MARKERS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|social|"
    r"nav|navbar|navi|navigation|navmenu|menu|breadcrumbs?|sidebar|footer|header|masthead|comments?|disqus|replies|related|"
    r"recommend\w*|widgets?|pagination|login|search",
    re.I,
)
BESIDE = re.compile(
    r"site|page|main|primary|secondary|global|top|bottom|left|right|side|sub|box|wrapper|wrap|container|block|list|items?|section|area|"
    r"bar|panel|buttons?|btn|links?|posts?|articles?|stories|form|inner|outer|content|slot|unit|entry|thread|\d+",
    re.I,
)
#: Parts whose articles are comments or teasers of other pages.
OTHERS = re.compile(r"(?:comment|repl|disqus|related|recommend)", re.I)
MAIN, OPEN, PART = "main", "open", "chrome"
#: Inside a marked element around which no article stands: as ``chrome``, but an article in it is one.
WRAPPED = "wrapped"
#: An opened paragraph ends where one of these starts.
CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "main", "header", "footer", "nav", "aside", "form", "pre",
            "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "address", "figure", "fieldset", "details"}


class Blocks(HTMLParser):
    """Collects (kind, text) of the blocks of a page in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.stack: list[tuple[str, str, bool]] = []  # element, kind inside it, silent
        self.text: list[str] = []
        self.kind, self.silent = OPEN, False

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.found.append((PART if self.kind == WRAPPED else self.kind, words))

    def push(self, tag: str, kind: str, silent: bool) -> None:
        self.stack.append((tag, self.kind, self.silent))
        self.kind, self.silent = kind, silent

    def pop(self) -> str:
        tag, self.kind, self.silent = self.stack.pop()
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag not in INLINE and not self.silent:
                self.text.append(" ")
            return
        if tag == "body" or tag in CLOSES_P:  # a head left open ends here
            while self.stack and self.stack[-1][0] in ("head", "title"):
                self.pop()
        if tag in CLOSES_P and any(t == "p" for t, _, _ in self.stack):
            self.leave("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for scope in range(len(self.stack) - 1, -1, -1):
                name = self.stack[scope][0]
                if name in ("ul", "ol", "dl", "table", "select", "tr") and name != tag:
                    break
                if name == tag:
                    self.leave(tag)
                    break
        known = dict(attrs)
        label = f"{known.get('class') or ''} {known.get('id') or ''}"
        kind = self.kind
        if kind != PART:
            role = (known.get("role") or "").lower()
            head = tag == "header" and kind != MAIN
            names = self.marked(tag, label)
            if tag in CHROME or head or role in ROLES or any(OTHERS.match(n) for n in names):
                kind = PART
            elif names:
                kind = PART if kind == MAIN else WRAPPED
            elif tag in ("article", "main") or role in ("main", "article"):
                kind = MAIN
        hidden = "hidden" in known or (known.get("aria-hidden") or "").lower() == "true"
        if tag not in INLINE and tag not in SILENT or kind != self.kind:
            self.flush()
        self.push(tag, kind, self.silent or tag in SILENT or hidden)

    def marked(self, tag: str, label: str) -> list[str]:
        """Markers by which class or id name a part that is no text; an article's own header is.

        A token names one if it is a marker, or markers with words such as ``site`` or ``box`` around them:
        ``site-footer`` does, ``has-sidebar`` and ``market-share`` do not.
        """
        if tag in ("html", "body", "main"):
            return []
        names = []
        for token in label.lower().replace("side-bar", "sidebar").split():
            words = [w for w in re.split("[_-]+", token) if w]
            own = [w for w in words if MARKERS.fullmatch(w)]
            if all(w in own or BESIDE.fullmatch(w) for w in words):
                names += own
        if tag == "article":
            names = [n for n in names if n.startswith(("comment", "repl", "disqus"))]
        return [n for n in names if n != "header" or self.kind != MAIN]

    def leave(self, tag: str) -> None:
        if tag not in SILENT:
            self.flush()
        while self.stack and self.pop() != tag:
            pass

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" and not self.silent:
            self.text.append(" ")
        if not any(t == tag for t, _, _ in self.stack):
            return
        if tag in INLINE:  # may cross blocks: only drop it if nothing but inline elements is above
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    before, kind, silent = self.stack[k]
                    if kind != self.kind:
                        self.flush()
                    rest = self.stack[k + 1 :]
                    del self.stack[k:]
                    if rest:
                        self.stack += rest
                    else:
                        self.kind, self.silent = kind, silent
                    return
                if self.stack[k][0] not in INLINE:
                    return
        self.leave(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """An unknown declaration is a comment that ends at the next ``>``, as in the HTML standard."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, 0)

    def finish(self) -> None:
        HTMLParser.close(self)  # hands on what is still buffered
        self.flush()


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of each block with text; without an article or main element nothing is ``main``."""
    parser = Blocks()
    parser.feed(html or "")
    parser.finish()
    return parser.found


def host_of(url: Column) -> Column:
    """Host of a URL in lower case without port; null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def parsed(html: Column) -> Column:
    """Blocks of each page."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": k, "text": t} for k, t in blocks(page)] for page in batch], dtype=object)

    return run(html)


def mixed(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens that start at each place."""
    out = np.zeros(max(0, len(tokens) - size + 1), np.uint64)
    for k in range(size if len(out) else 0):
        out = (out ^ tokens[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def marks(tokens: np.ndarray, run: int) -> np.ndarray:
    """For each place the smallest hash of half runs inside its run: equal runs have equal marks."""
    half = (run + 1) // 2
    inner = mixed(tokens, half)
    if len(tokens) < run:
        return inner[:0]
    return np.lib.stride_tricks.sliding_window_view(inner, run - half + 1).min(axis=1)


def pieces(batch: pa.RecordBatch, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut where the texts of a piece pass ``chars``: what a task holds as words stays small."""
    size = np.cumsum([len(t.as_buffer()) for t in batch.column("text")]) // chars
    cuts = np.flatnonzero(np.diff(size)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def token_hashes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(page, token hashes) of each page of a batch of host, page and text; copies in the batch come once."""
    rows = {p: (h, t) for h, p, t in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "text")))}
    words = [t.lower().split(" ") for _, t in rows.values()]
    hosts = pd.util.hash_array(np.array([h for h, _ in rows.values()], object))
    every = pd.util.hash_array(np.array([w for own in words for w in own], object))
    at = 0
    for page, own, host in zip(rows, words, hosts):
        yield page, every[at : at + len(own)] ^ host
        at += len(own)


def repeated(streams: DataFrame, run: int) -> DataFrame:
    """(page, at, pages): starts of ``run`` tokens that another page of the host has too, and how many have them.

    ``streams`` has host, page and text; rows of one page are copies. Suffixes are held by the hash of their
    host and leading tokens: those that agree on it stand together in the array. So that not every suffix has
    to move, a first pass looks at marks, the smallest hash of the half runs inside a run: there is one
    for about four places, equal runs have equal marks, and each task hands on a mark twice at most. Only
    suffixes whose mark was met twice are shuffled.
    """
    chars = streams.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(64, chars >> 24)  # about 6 MB of marks in each

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list({p: np.unique(marks(x, run)) for piece in pieces(batch) for p, x in token_hashes(piece)}.values())
            value, n = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_counts=True)
            value = np.repeat(value, np.minimum(n, 2))
            bucket = (value % np.uint64(buckets)).astype(np.int32)
            value = value[np.argsort(bucket, kind="stable")]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            found = [(k, v.tobytes()) for k, v in enumerate(np.split(value, ends[:-1])) if len(v)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.binary())], ["bucket", "marks"])

    def twice(some: pd.DataFrame) -> pd.DataFrame:
        value, n = np.unique(np.frombuffer(b"".join(some["marks"]), np.uint64), return_counts=True)
        return pd.DataFrame({"mark": value[n > 1].view(np.int64)})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            pages, found, firsts, leads, ends = [], [], [], [], [np.zeros(1, np.int32)]
            for page, x in token_hashes(batch):
                mark = marks(x, run)
                if not len(mark):
                    continue
                first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])).astype(np.int32)
                pages.append(np.full(len(first), page, np.int64))
                found.append(mark[first].view(np.int64))
                firsts.append(first)
                leads.append(mixed(x, run).view(np.int64))
                ends.append(np.append(first[1:], np.int32(len(mark))) + ends[-1][-1])
            if pages:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(leads)))
                columns = [pa.array(np.concatenate(c)) for c in (pages, found, firsts)]
                yield pa.RecordBatch.from_arrays([*columns, lists], ["page", "mark", "first", "leads"])

    own = streams.select("host", "page", "text")
    met = own.mapInArrow(hand_on, "bucket int, marks binary").groupBy("bucket").applyInPandas(twice, "mark long")
    met = broadcast_if_small(stored(met, "page-marks"))
    some = own.mapInArrow(places, "page long, mark long, first int, leads array<long>").join(met, "mark", "left_semi")
    some = some.select("page", "first", F.posexplode("leads").alias("k", "lead"))
    some = stored(some.select("page", (F.col("first") + F.col("k")).alias("at"), "lead"), "page-runs", "zstd")
    ends = some.groupBy("lead").agg(F.count_distinct("page").alias("pages")).where("pages > 1")
    ends = broadcast_if_small(stored(ends, "page-leads"))
    return some.join(ends, "lead").select("page", "at", F.col("pages").cast("int").alias("pages")).distinct()


def spans(starts: Column) -> Column:
    """Stretches of neighbouring starts that equally many pages have."""

    @F.pandas_udf("array<struct<first:int,last:int,pages:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for own in batch:
                found: list[dict] = []
                for x in sorted(own, key=lambda x: x["at"]):
                    if found and found[-1]["last"] == x["at"] - 1 and found[-1]["pages"] == x["pages"]:
                        found[-1]["last"] = x["at"]
                    else:
                        found.append({"first": x["at"], "last": x["at"], "pages": x["pages"]})
                rows.append(found)
            yield pd.Series(rows, dtype=object)

    return run(starts)


def kept(parts: list[dict], found: list[dict], run: int, host_pages: int = 0) -> str:
    """Text of a page without what repeated runs of its tokens cover: of its article or else its open blocks.

    A run counts only where all its tokens are of one kind: words of the text next to a footer or a menu that
    repeats are no part of the repetition. Each token stands in as many pages as the run over it that most have.

    Open blocks lose every token that other pages have. An article loses whole blocks only, never part of
    one: those of which every token stands in at least three pages, in more than half of the host's pages, and in more pages than
    half of the article's tokens do. The last guards copies: that many copies of the article there are.
    """
    kind = MAIN if any(x["kind"] == MAIN for x in parts) else OPEN
    floor = max(2, host_pages // 2) if kind == MAIN else 1
    ends = list(accumulate(x["text"].count(" ") + 1 for x in parts))
    own = [(x["text"], lo, hi) for x, lo, hi in zip(parts, [0, *ends], ends) if x["kind"] == kind]
    stretches: list[list[int]] = []  # of tokens of the kind, over neighbouring blocks
    for _, lo, hi in own:
        if stretches and stretches[-1][1] == lo:
            stretches[-1][1] = hi
        else:
            stretches.append([lo, hi])
    hits = [
        (max(x["first"], lo), min(x["last"] + run, hi), x["pages"])
        for x in found if x["pages"] > floor  # fewer pages can neither remove a token nor move the median past the floor
        for lo, hi in stretches if max(x["first"], lo) <= min(x["last"], hi - run)
    ]
    if not hits:
        return " ".join(text for text, _, _ in own)
    pages = np.ones(ends[-1], np.int64)
    for lo, hi, n in hits:
        np.maximum(pages[lo:hi], n, out=pages[lo:hi])
    if kind == OPEN:
        return " ".join(w for text, lo, _ in own for w, n in zip(text.split(" "), pages[lo:].tolist()) if n == 1)
    usual = np.sort(np.concatenate([pages[lo:hi] for lo, hi in stretches]))
    bar = max(floor, int(usual[(len(usual) - 1) // 2]))
    return " ".join(text for text, lo, hi in own if pages[lo:hi].min() <= bar)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = 12
) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    Null or empty html has an empty text; pages without a host form one group; pages of a host with
    equal streams count once, so that copies do not erase each other; repeated rows each come out; an
    empty table gives an empty result; other columns are not read. Of an article only whole blocks are left
    out that most pages of its host repeat, see ``kept``; an article that is boilerplate for the greater part stays whole.
    """
    own = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"),
        parsed(F.coalesce(html_col, F.lit(""))).alias("blocks"),
    )
    stream = F.array_join(F.transform("blocks", lambda x: x["text"]), " ")
    own = stored(own.withColumn("page", F.xxhash64("host", stream)), "page-blocks", "zstd")
    found = repeated(own.select("host", "page", stream.alias("text")), run)
    found = found.groupBy("page").agg(F.collect_list(F.struct("at", "pages")).alias("starts"))
    hosts = own.select("host", "page").distinct()
    counts = hosts.groupBy("host").agg(F.count(F.lit(1)).cast("int").alias("host_pages"))
    found = found.select("page", spans("starts").alias("found"))
    found = stored(found.join(hosts.join(counts, "host").drop("host"), "page"), "page-spans", "zstd")
    if (found.agg(F.sum(F.size("found"))).first()[0] or 0) <= 1_000_000:
        found = F.broadcast(found)  # page texts stay where they are

    @F.pandas_udf("string")
    def finish(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for parts, some, counted in batches:
            rows = zip(parts, some, counted)
            yield pd.Series([kept(list(x), [] if s is None else list(s), run, n) for x, s, n in rows], dtype=object)

    count = F.coalesce("host_pages", F.lit(0))
    both = own.join(found, "page", "left").select("id", "url", finish("blocks", "found", count).alias("text"))
    return both.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars")
    )
