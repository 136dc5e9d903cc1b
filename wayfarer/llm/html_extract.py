"""Main text of pages: a suffix array over each host's text outside of articles finds the boilerplate that its pages share, on every page; the markup is the check that follows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import bounded, small, values
from wayfarer.llm.url_filter import host

#: Tokens of a substring that counts as shared when it stands on two pages of a host.
SHARED = 8

#: Elements without an end tag, and those that begin and end a block. A line break is white space inside a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead title tr ul".split())
_SPACED = frozenset(("br", "td", "th", "img", "input", "wbr"))
#: Elements whose text is never part of an article, and those that are not outside of one.
_NEVER = frozenset("head nav footer aside form button select option datalist dialog menu search object audio video canvas map label legend fieldset".split())
#: Words of class, id and role values that name something else than the article, where the value consists of such words, of
#: those that tell nothing, and of numbers; "header" names it only outside of an article.
_OTHER = frozenset("ad ads adv advert adverts advertisement advertising adslot adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav complementary footer contentinfo comment comments commentlist disqus respond replies reply share sharing social related recommended newsletter subscribe signup login popup modal overlay widget widgets pagination pager toolbar search skip".split())
_PLAIN = frozenset("slot box list bar button buttons post posts link links container wrapper wrap inner outer form section block unit area panel top bottom left right main page site item items icon icons primary secondary global mobile desktop first last".split())
_HEADERS = frozenset(("header", "masthead", "banner", "topbar"))
_CONTENT = frozenset("articlebody entry-content post-content article-content article-body post-body story-body main-content page-content".split())
_PERHAPS = frozenset("content article post entry story main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title|xmp|math)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[\s_-]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Kinds of a block: in an article, in a main part, in what a weaker name calls content, left open, or named as something else by its markup.
ARTICLE, MAIN, PART, OPEN, OTHER = 0, 1, 2, 3, 4


def _else(name: str) -> bool:
    """Whether a whole value names something else: "related-posts" does, "related-work" does not."""
    parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
    return any(p in _OTHER for p in parts) and all(p in _OTHER or p in _PLAIN for p in parts)


def _traits(attributes: str) -> tuple[bool, bool, bool, bool]:
    """(names something else, names a header, names the content, may name the content) of an element's attributes."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")).lower()
    parts = set(_PARTS.split(names))
    content = not _CONTENT.isdisjoint(names.split()) or found.get("role", "").lower() in ("main", "article")
    other = any(map(_else, names.split())) and not content
    return other or bool(_HIDDEN.search(attributes)), not parts.isdisjoint(_HEADERS), content, not _PERHAPS.isdisjoint(names.split())


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of each block of a page in order: character references decoded, white space made one space and trimmed.

    An element's kind is that of what it stands in unless its own tag or attributes say otherwise. An article within an
    article is a comment. Unclosed elements end where an end tag of an outer one, or a paragraph, list item or row that
    cannot hold them, comes.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, kind inside, within an article
    kind, inside = OPEN, False
    parts: list[str] = []
    at = 0

    def flush():
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((kind, text))

    def close_to(place: int):
        nonlocal kind, inside
        del stack[place:]
        kind, inside = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag = tag.lower()
        closing = m[2] or m[5]
        if tag in _SPACED:
            parts.append(" ")
        block = tag in _BLOCKS
        if block:
            flush()
        if closing:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == tag:
                    if not block and any(x[0] in _BLOCKS for x in stack[place:]):
                        break  # an inline end tag does not end blocks
                    flush() if any(x[1] != kind for x in stack[place:]) or (place and stack[place - 1][1] != kind) else None
                    close_to(place)
                    break
            continue
        if block and tag not in ("body", "html"):
            for place in range(len(stack) - 1, -1, -1):
                name = stack[place][0]
                if name == "p" or (name == tag and tag in ("li", "tr", "option", "dt", "dd")):
                    close_to(place)
                    break
                if name in _BLOCKS:
                    break
        if tag in _VOID:
            continue
        attributes = m[4] or m[7] or ""
        new, in_article = kind, inside
        if kind != OTHER:
            other, header, content, perhaps = _traits(attributes) if attributes else (False, False, False, False)
            if tag in _NEVER or other or (not inside and (tag == "header" or header)) or (tag == "article" and any(x[0] == "article" for x in stack)):
                new = OTHER
            elif tag == "article":
                new, in_article = ARTICLE, True
            elif (tag == "main" or content) and kind in (OPEN, PART):
                new, in_article = MAIN, True
            elif perhaps and kind == OPEN:
                new, in_article = PART, True
        if new != kind:
            flush()
        stack.append((tag, new, in_article))
        kind, inside = new, in_article
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z/!?][^<>]*\Z", rest)  # a tag that the page's end cuts off
        parts.append(rest[: cut.start()] if cut else rest)
    flush()
    return out


def stream(found: list[tuple[int, str]]) -> list[str]:
    """The tokens of a page's blocks outside of articles and main parts, in order."""
    return [w for kind, text in found if kind >= OPEN for w in text.split(" ")]


def shared_windows(tokens: np.ndarray, width: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of a suffix array: suffixes of ``tokens`` sorted by their first ``width`` tokens, and the rank of each; equal ranks share them.

    Prefix doubling; the last round overlaps, so any width is met exactly.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    known = 1
    while known < width:
        step = min(known, width - known)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        known += step
    return np.argsort(rank, kind="stable"), rank


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) >> 1


def _windows(batch):
    """Rows (host, window, low, high) of a batch: the windows of each host's streams, each once, and the least and greatest page that has it."""
    streams = defaultdict(list)
    for name, key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if name is not None and html:
            words = stream(blocks(html))
            if len(words) >= SHARED:
                streams[name].append((key, np.array([_hash(w) for w in words], np.int64)))
    out = []
    for name, pages in streams.items():
        # a separator of its own ends each page, so that no shared substring reaches over two
        tokens = np.concatenate([np.append(t, -1 - i) for i, (_, t) in enumerate(pages)])
        page = np.repeat(np.arange(len(pages)), [len(t) + 1 for _, t in pages])
        whole = np.zeros(len(tokens), bool)
        whole[: len(tokens) - SHARED + 1] = page[SHARED - 1 :] == page[: len(tokens) - SHARED + 1]
        whole[: len(tokens) - SHARED + 1] &= tokens[SHARED - 1 :] >= 0
        order, rank = shared_windows(tokens)
        order = order[whole[order]]
        keys = np.array([k for k, _ in pages], np.int64)[page[order]]
        starts = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        if len(starts):
            low, high = np.minimum.reduceat(keys, starts), np.maximum.reduceat(keys, starts)
            first = order[starts]
            out += [(name, window_key(tokens[i : i + SHARED]), int(a), int(b)) for i, a, b in zip(first.tolist(), low.tolist(), high.tolist(), strict=True)]
    return out


def window_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _record(rows, schema):
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def shared_boilerplate(pages: DataFrame) -> DataFrame:
    """host, window: hashes of the SHARED-token substrings of text outside of articles that stand on two distinct pages of a host.

    Every batch of pages sorts the suffixes of each of its hosts; what they share is merged over batches by host and
    window, so a host of any size is spread over all tasks and nothing of a host is gathered. Equal rows are one page.
    """
    schema = [("host", pa.string()), ("window", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]

    def run(batches):
        for batch in batches:
            yield _record(_windows(batch), schema)

    found = pages.select("host", "key", "html").mapInArrow(run, "host string, window long, low long, high long")
    merged = found.groupBy("host", "window").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.filter("low <> high").select("host", "window")


def _open_windows(pages: DataFrame) -> DataFrame:
    """host, window, key, at: every window of the pages."""
    schema = [("host", pa.string()), ("window", pa.int64()), ("key", pa.int64()), ("at", pa.int32())]

    def run(batches):
        for batch in batches:
            rows = []
            for name, key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name is not None and html:
                    t = np.array([_hash(w) for w in stream(blocks(html))], np.int64)
                    rows += [(name, window_key(t[i : i + SHARED]), key, i) for i in range(len(t) - SHARED + 1)]
            yield _record(rows, schema)

    return pages.select("host", "key", "html").mapInArrow(run, "host string, window long, key long, at int")


def unshared(found: list[tuple[int, str]], covered=()) -> tuple[list[tuple[int, str]], int]:
    """Blocks without the runs of ``stream`` that shared windows (by their first tokens) cover, and how many tokens these are.

    What the markup names is not in the stream and stays whole, as articles share passages; a block that is covered whole goes.
    """
    gone = {i for a in covered or () for i in range(a, a + SHARED)}
    if not gone:
        return found, 0
    at, out = 0, []
    for kind, text in found:
        if kind >= OPEN:
            words = text.split(" ")
            text = " ".join(w for i, w in enumerate(words, at) if i not in gone)
            at += len(words)
        if text:
            out.append((kind, text))
    return out, len(gone)


def checked(left: list[tuple[int, str]]) -> str:
    """The text of what the suffix arrays leave, by its markup: main parts whole, with their articles, where they have text of
    their own; else the articles; else what a weaker name calls content; else what it leaves open."""
    size = Counter()
    for kind, text in left:
        size[kind] += len(text)
    if size[MAIN]:
        return "\n".join(text for kind, text in left if kind <= MAIN)
    kept = next((k for k in (ARTICLE, PART) if size[k]), OPEN)
    return "\n".join(text for kind, text in left if kind == kept)


def page_text(html: str, covered=()) -> str:
    """Main text of a page."""
    return checked(unshared(blocks(html), covered)[0])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_shared of the main text of every whole page.

    The suffix arrays of a host run over the text outside of articles of all its pages, and every page loses the runs that
    they show on another page (n_shared: their tokens). Of what is left the markup keeps what it names an article (or main),
    or, where it names nothing, what it does not name as something else: an advert of one page alone goes by its markup,
    repeated passages of articles stay. Null and empty pages give an empty text; pages without a host share with none;
    repeated rows give repeated rows; other columns are ignored.
    """
    bounded(pages)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("key", F.xxhash64("page_id", "url", "html"))

    def run(batches):
        for batch in batches:
            text, shared = [], []
            for html, covered in zip(values(batch.column(2)), values(batch.column(3)), strict=True):
                left, n = unshared(blocks(html), covered)
                text.append(checked(left))
                shared.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(shared, pa.int64())], ["page_id", "url", "text", "n_shared"])

    shared = small(shared_boilerplate(rows))
    met = _open_windows(rows).join(shared, ["host", "window"]).groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("covered"))
    out = rows.join(met, "key", "left").select("page_id", "url", "html", "covered").mapInArrow(run, "page_id long, url string, text string, n_shared long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
