"""Main text of web pages: page structure, and substrings that the pages of a host repeat.

The tokens of all pages of a host form one stream, whose suffixes are ordered by their first tokens: equal prefixes meet by host
and hash in a partially aggregated group, so no host is gathered in one place. A prefix of RUN tokens on two unlike pages marks a
repeated substring, and longer repeats are unions of such prefixes. Covered tokens are boilerplate, unique runs are kept.

Where a page's own text (inside article or main) says what the main text is, suffixes begin at its blocks and end with them: a block of RUN
tokens or more is boilerplate if at least half of the host's pages have it, so that what a few articles share stays. Pages without enough
own text are cut at every token, against all pages of their host; hosts without such a page need none of this work.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments go by their elements in either case.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, written

#: Tokens of the least repeated substring that counts as boilerplate.
RUN = 8
#: A host needs so many pages before a block inside articles can be its boilerplate.
MIN_PAGES = 8
#: Repeats of all hosts are sent to the executors up to so many hashes, else joined by host.
MAX_SENT = 2_000_000
#: Characters of the pages of a host that are worked together beyond that.
PART = 64 << 20
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S
)
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROP = {
    "nav", "footer", "aside", "form", "head", "template", "svg", "math", "canvas", "object", "button", "select", "dialog", "menu",
    "video", "audio", "map", "datalist", "fieldset",
}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An opening tag ends an open one of these, up to the element that holds them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Classes, ids and roles, whole, that mark what isn't main text. Those of a layout (has-sidebar) or of a longer name (share-price) don't.
_MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "notification", "alert", "sidebar", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments",
    "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "popup", "modal",
    "overlay", "widget", "pagination", "pager", "toolbar", "copyright", "disclaimer", "contentinfo", "complementary", "form",
}
#: Those that also count inside an article: on any element, and on containers.
_OWN_MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion"}
_HOLDER_MARKS = _OWN_MARKS | {
    "cookie", "cookies", "consent", "gdpr", "sidebar", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "comment", "comments", "disqus", "replies",
    "sharing", "social", "recommended", "newsletter", "subscribe", "signup", "login", "popup", "modal", "pagination", "pager", "toolbar", "contentinfo", "complementary",
}
_HOLDERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details"}
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_OWN = {"article", "main"}


def _marks(attrs: str) -> tuple[set[str], bool]:
    """Class, id and role tokens in lower case; whether the role is main."""
    words: set[str] = set()
    main = False
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        words.update(value.lower().split())
        main |= m[1].lower() == "role" and value.strip().lower() == "main"
    return words, main


def decoded(piece: str) -> str:
    """One text node; a reference doesn't reach over a tag."""
    return html.unescape(piece) if "&" in piece else piece


def parse(page: str | None) -> tuple[list[tuple[str, bool, bool]], bool]:
    """Blocks (text, own, chrome) in page order, and whether the page has an article or main element.

    Marks don't count on an element that is or holds a main element, nor on one that is or holds an article where the page has no other.

    own: inside such an element and no boilerplate element; chrome: inside a boilerplate element. Character references are decoded, white space
    is one space. Unclosed and stray tags are borne; an unclosed comment, script or style runs to the end of the page.
    """
    page = page or ""
    blocks, found, marked, mains, articles = _walk(page, frozenset())
    free = marked & mains
    if free:
        blocks, found, *_ = _walk(page, free)
    if not found and marked & articles:
        blocks, found, *_ = _walk(page, free | marked & articles)
    return blocks, found


def _walk(page: str, free: frozenset[int] | set[int]) -> tuple[list[tuple[str, bool, bool]], bool, set[int], set[int], set[int]]:
    """Blocks; whether there is an own element; where the tags of marked elements, and of those that are or hold a main or an article, begin.

    Elements of ``free`` aren't marked.
    """
    marked: set[int] = set()
    mains: set[int] = set()
    articles: set[int] = set()
    blocks: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, own, chrome, place of its tag
    own = chrome = found = False

    def close_block() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                blocks.append((text, own and not chrome, chrome))
            held.clear()

    def pop_to(k: int) -> None:
        nonlocal own, chrome
        del stack[k:]
        own, chrome = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            held.append(decoded(page[at:]))
            break
        if m.start() > at:
            held.append(decoded(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _BLOCK or name in _DROP:
            close_block()
        elif name == "br":
            held.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        if name in _RAW:
            stop = _RAW_END[name].search(page, at)
            at = stop.end() if stop else end
            continue
        if name in _VOID or attrs.endswith("/") and name not in _BLOCK:
            continue
        if name in _BLOCK:  # a paragraph ends where a block begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        if name in _ENDS:
            same, holders = _ENDS[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in holders:
                    break
                if stack[k][0] in same:
                    pop_to(k)
                    if not (name == "tr" and k and stack[k - 1][0] in same):
                        break
        words, main = _marks(attrs) if "=" in attrs else (set(), False)
        out = chrome
        if name in _DROP or (name == "header" or "header" in words) and not own:
            out = True
        elif name not in ("html", "body", "main") and m.start() not in free and words & ((_HOLDER_MARKS if name in _HOLDERS else _OWN_MARKS) if own else _MARKS):
            marked.add(m.start())
            out = True
        inside = own or name in _OWN or main
        found |= inside and not out
        stack.append((name, inside, out, m.start()))
        if main or name in _OWN:
            (mains if main or name == "main" else articles).update(x[3] for x in stack)
        own, chrome = inside, out
    close_block()
    return blocks, found, marked, mains, articles


_HOST = r"^[a-zA-Z][A-Za-z0-9_+.-]*://(?:[^/@?#]*@)?([^/:?#]*)"


def host_of(url: str | None) -> str:
    m = re.match(_HOST, url or "")
    return m[1].lower() if m else ""


def _few(own: int, rest: int) -> bool:
    """Whether so many own tokens are few beside those of the rest."""
    return own < RUN or 4 * own < rest


def _signed(data: str) -> int:
    return int.from_bytes(blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _prefixes(tokens: list[str], run: int) -> np.ndarray:
    """A 64-bit hash of the first ``run`` tokens of each suffix that has as many."""
    n = len(tokens) - run + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_signed, tokens), np.int64, len(tokens)).view(np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(run):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29)))
    return out.view(np.int64)


class Page:
    """A parsed page: blocks, those that are its own, and the tokens of the others with the block of each."""

    def __init__(self, page: str | None) -> None:
        self.blocks, self.found = parse(page)
        self.own = [k for k, b in enumerate(self.blocks) if b[1]]
        others = [k for k, b in enumerate(self.blocks) if not b[1]]
        shown = sum(self.blocks[k][0].count(" ") + 1 for k in others if not self.blocks[k][2])
        #: Whether the text depends on what the host repeats outside of articles.
        self.open = shown > 0 and (not self.found or _few(sum(self.blocks[k][0].count(" ") + 1 for k in self.own), shown))

    def rest(self) -> tuple[list[str], list[int]]:
        tokens: list[str] = []
        of: list[int] = []
        for k, (text, own, _) in enumerate(self.blocks):
            if not own:
                words = text.split(" ")
                tokens += words
                of += [k] * len(words)
        return tokens, of

    def long_blocks(self, run: int) -> dict[int, int]:
        """Own blocks of at least ``run`` tokens, and the hash of each."""
        return {k: _signed(self.blocks[k][0]) for k in self.own if self.blocks[k][0].count(" ") + 1 >= run}

    def text(self, run: int = RUN, common: set[int] | frozenset[int] = frozenset(), shared: set[int] | frozenset[int] = frozenset()) -> str:
        """Own blocks but for those in ``common``; where these are few, also what no prefix in ``shared`` covers of the rest.

        Where blocks in ``common`` are over half of the own text, it is a copy of other pages' and stays. Where nothing
        is left of a page by this, its text is kept as it was.
        """
        blocks = self.blocks
        gone = {k for k, h in self.long_blocks(run).items() if h in common} if common else set()
        if gone and 2 * sum(len(blocks[k][0]) for k in gone) > sum(len(blocks[k][0]) for k in self.own):
            gone = set()
        kept = {k: blocks[k][0] for k in self.own if k not in gone}
        if self.open:
            tokens, of = self.rest()
            covered = np.zeros(len(tokens) + 1, np.int64)
            if shared:
                for k in np.flatnonzero(np.isin(_prefixes(tokens, run), np.fromiter(shared, np.int64, len(shared)))).tolist():
                    covered[k] += 1
                    covered[k + run] -= 1
            lost = np.cumsum(covered)[: len(tokens)] > 0
            # What a repeat only reaches into, short of a run's length and of the whole block, stays with its block.
            places = np.array(of)
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(lost) != 0)) + 1 if len(tokens) else []
            for a, b in zip([0, *cuts], [*cuts, len(tokens)], strict=True):
                if b - a < run and lost[a:b].any() and ((a and places[a - 1] == places[a]) or (b < len(tokens) and places[b] == places[a])):
                    lost[a:b] = False
            shown = ~np.array([blocks[k][2] for k in of], bool)
            unique = shown & ~lost
            if not self.found or _few(sum(t.count(" ") + 1 for t in kept.values()), int(unique.sum())):
                kept |= _lines(tokens, of, unique)
            if not kept:
                kept = _lines(tokens, of, shown)
        return "\n".join(kept[k] for k in sorted(kept))


def _lines(tokens: list[str], of: list[int], kept: np.ndarray) -> dict[int, str]:
    lines: dict[int, list[str]] = {}
    for token, k, x in zip(tokens, of, kept, strict=True):
        if x:
            lines.setdefault(k, []).append(token)
    return {k: " ".join(words) for k, words in lines.items()}


def _read(pages: DataFrame) -> DataFrame:
    return in_small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))


def common_blocks(pages: DataFrame, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """pages -> (host, prefix) of own blocks on at least half of a host's pages, and (host) of hosts with a page whose text depends on repeats.

    Pages count once for each distinct html, so a group of copies is one page.
    """

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts, prefixes, opens, streams = [], [], [], []
            for url, page in zip(batch["url"], batch["html"], strict=True):
                parsed, host = Page(page), host_of(url)
                found = {*parsed.long_blocks(run).values()}
                hosts += [host] * (len(found) + 1)
                prefixes += [None, *found]
                opens += [parsed.open] * (len(found) + 1)
                streams += [_signed(page or "")] * (len(found) + 1)
            yield pd.DataFrame({"host": hosts, "prefix": pd.array(prefixes, "Int64"), "open": opens, "stream": streams})

    rows = _read(pages).mapInPandas(run_all, "host string, prefix long, open boolean, stream long")
    # Distinct streams are counted in two steps, both partial before their shuffle; a block's first step is by stream, so no host or block gathers in a task.
    seen = rows.groupBy("host", "prefix", "stream").agg(F.max("open").alias("open"))
    counts = written(seen.groupBy("host", "prefix").agg(F.count("*").alias("n"), F.max("open").alias("open")).filter(f"prefix is null or n >= {(MIN_PAGES + 1) // 2}"), "blocks")
    totals = counts.filter("prefix is null").select("host", F.col("n").alias("pages"), "open")
    common = counts.filter("prefix is not null").select("host", "prefix", "n").join(totals.filter(f"pages >= {MIN_PAGES}"), "host").filter("2 * n >= pages").select("host", "prefix")
    return common, totals.filter("open").select("host")


def shared_prefixes(pages: DataFrame, hosts: DataFrame, run: int = RUN) -> DataFrame:
    """(host, prefix): the suffix prefixes of the rest of pages that two unlike pages of one of ``hosts`` have."""

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                tokens, _ = Page(page).rest()
                found = np.unique(_prefixes(tokens, run))
                yield pd.DataFrame({"host": np.full(len(found), host, object), "prefix": found, "stream": _signed("\n".join(tokens))})

    rows = _with_host(pages).join(hosts, "host", "left_semi").select("host", "html").mapInPandas(suffixes, "host string, prefix long, stream long")
    # Ends of the range of streams show whether there are two; copies of one page's stream count as one.
    return rows.groupBy("host", "prefix").agg(F.min("stream").alias("a"), F.max("stream").alias("b")).filter("a <> b").select("host", "prefix")


def _with_host(pages: DataFrame) -> DataFrame:
    """Adds the host in SQL, as ``host_of`` finds it."""
    return _read(pages).withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))


def extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """pages -> (page_id, url, text, n_chars), one row for each row.

    A null html counts as empty and gives an empty text. Pages whose host is unknown share a host named ''. Rows without
    page_id and repeated rows are extracted like others. An empty table gives none.
    """
    common, hosts = common_blocks(pages, run)
    marked = common.select("host", "prefix", F.lit(True).alias("own"))
    if not hosts.isEmpty():
        marked = marked.unionByName(shared_prefixes(pages, hosts, run).select("host", "prefix", F.lit(False).alias("own")))
    marked = written(marked, "repeats")
    rows = _with_host(pages)
    n = marked.count()
    if n > MAX_SENT:
        return _by_host(rows, marked, run)
    found = marked.toArrow().to_pandas()
    sent = rows.sparkSession.sparkContext.broadcast({host: _split(x) for host, x in found.groupby("host")})

    def run_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = {host: _sets(x) for host, x in sent.value.items()}
        for batch in batches:
            yield _texts(batch, [sets.get(host, (frozenset(), frozenset())) for host in batch["host"]], run)

    return rows.mapInPandas(run_all, RESULT)


RESULT = "page_id long, url string, text string, n_chars long"


def _split(marked: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    own = marked["own"].to_numpy(bool)
    prefix = marked["prefix"].to_numpy(np.int64)
    return prefix[own], prefix[~own]


def _sets(arrays: tuple[np.ndarray, np.ndarray]) -> tuple[frozenset[int], frozenset[int]]:
    return frozenset(arrays[0].tolist()), frozenset(arrays[1].tolist())


def _texts(batch: pd.DataFrame, sets: list[tuple[frozenset[int], frozenset[int]]], run: int) -> pd.DataFrame:
    texts = [Page(page).text(run, *both) for page, both in zip(batch["html"], sets, strict=True)]
    return pd.DataFrame({"page_id": batch["page_id"].array, "url": batch["url"].astype(object).array, "text": pd.Series(texts, dtype=object).array, "n_chars": np.array([len(t) for t in texts], np.int64)})


def _by_host(rows: DataFrame, marked: DataFrame, run: int) -> DataFrame:
    """The way for any number of repeats: a host's pages are dealt out in parts of PART characters, each of which meets the host's repeats once."""
    parts = written(rows.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.length("html"), F.lit(0)) + 1) / PART).cast("int").alias("parts")), "parts")
    dealt = rows.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("parts")).cast("int")).drop("parts")
    sent = marked.join(parts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "prefix", "own")

    def run_part(pages: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return _texts(pages, [_sets(_split(found))] * len(pages), run)

    return dealt.groupBy("host", "part").cogroup(sent.groupBy("host", "part")).applyInPandas(run_part, RESULT)
