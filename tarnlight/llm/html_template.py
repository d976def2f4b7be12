"""Main text of web pages: site templates are found by hashing element subtrees and counting them for each host.

1. In Arrow batches every page is read once: each block element outside articles, and each container inside them, gets
   a hash of its subtree (tags, classes, text). A page gives its hashes and a digest of its main text.
2. Spark counts for each (host, hash) the different main texts beside which it stands, so copies of one page count once.
   A subtree on at least LEAST_PAGES of them is a template of that host, however many pages the host has.
3. In a second reading every page's templates are deleted first. What is left of menus, headers, footers, sidebars,
   notices, adverts, forms, comments and code, because it recurs too little to be counted, goes by its markup; the
   rest of the article (or main part, or body) is the text. template_chars and markup_chars say what either deleted.

Paragraphs and headings inside an article are never taken for templates: passages that recur in articles are content.
The (page, hashes) rows of the second reading are broadcast up to a counted bound and otherwise joined by a hash of the
page's id and html. Templates that stand on a large share of all pages are few, and are broadcast to meet the pages.

Defined results: null and empty html give the empty text; null url is the host ''; repeated pages count once for
templates and give a row each; broken markup is read as browsers do in the main (implied ends, stray ends ignored,
unclosed elements end with the page); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import met, released, saved

LEAST_PAGES = 5
#: Rows of (page key, hashes) that are broadcast at most.
BROADCAST_ROWS = 100_000

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot blockquote pre figcaption hgroup caption summary".split())
#: A start tag ends an open element of these kinds, looked for up to those.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
#: What isn't main text: elements, roles, and words of a class or id.
DROPPED = frozenset("head script style template noscript nav footer aside form button select textarea input iframe svg canvas object audio video dialog menu search xmp noembed noframes title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus reply replies footer masthead".split())
OF_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies".split())

NOT_P = BLOCK - {"p"}
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
WORDS = re.compile(r"[a-z0-9]+")


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _hash(pieces: list[str]) -> int:
    return int.from_bytes(blake2b("\x01".join(pieces).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "main"):
        return False
    words = frozenset(WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())) if attributes else frozenset()
    if tag == "article" and not in_article:
        return bool(words & OF_ARTICLES)
    if tag == "header" or attributes.get("role", "") in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return tag != "header" or not in_article
    return bool(words & NAMES)


def parse(html: str, templates: frozenset[int] = frozenset()) -> tuple[str, list[int], int, int]:
    """The main text; the hashes of the subtrees that may be templates; the characters that templates and markup deleted."""
    out: list[str] = []
    canon: list[str] = []
    roots: list[tuple[int, int, str]] = []  # of article and main: from, to in out
    hashes: list[int] = []
    deleted = [0, 0]  # characters, by templates and by markup
    # of an open element: tag, places in out and canon, whether its text goes, articles around it
    stack: list[tuple[str, int, int, bool, int]] = []
    opened: dict[str, int] = {}
    articles = 0

    def close() -> None:
        nonlocal articles
        tag, at, c, drop, inside = stack.pop()
        opened[tag] -= 1
        articles -= tag in ("article", "main")
        empty = len(canon) == c + 1
        h = _hash(canon[c:])
        canon[c:] = [str(h)]
        countable = tag in BLOCK and tag not in ("html", "body", "head", "article", "main") and not empty and not (inside and tag in PROSE)
        if countable:
            hashes.append(h)
        counted = countable and h in templates
        if drop or counted:
            deleted[not counted] += len(" ".join("".join(out[at:]).split()))
            del out[at:]
            while roots and roots[-1][0] >= at:
                roots.pop()
        if tag in ("article", "main") and not inside and not drop:
            roots.append((at, len(out), tag))
        if tag in BLOCK:
            out.append(" ")

    def text(piece: str) -> None:
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            out.append(piece)
            if words := " ".join(piece.split()):
                canon.append(words)

    at = 0
    for m in TAG.finditer(html):
        start = m.start()
        if start < at:
            continue
        text(html[at:start])
        at = m.end()
        if (tag := m[2]) is not None:
            tag = tag.lower()
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in BLOCK:
                if tag in IMPLIED:
                    _implied(stack, opened, *IMPLIED[tag], close)
                if opened.get("p"):
                    _implied(stack, opened, {"p"}, NOT_P, close)
                out.append(" ")
            elif tag == "br":
                out.append(" ")
            attributes = _attributes(m[3]) if m[3] else {}
            if tag in VOID:
                continue
            drop = _dropped(tag, attributes, articles > 0)
            stack.append((tag, len(out), len(canon), drop, articles))
            canon.append(f"<{tag} {attributes.get('class', '')} {attributes.get('id', '')}")
            opened[tag] = opened.get(tag, 0) + 1
            articles += tag in ("article", "main")
        elif (tag := m[1]) is not None:
            tag = tag.lower()
            if tag == "p" and not opened.get("p"):
                out.append(" ")
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag and (tag in BLOCK or stack[k][0] not in BLOCK):
                    k -= 1
                if stack[k][0] == tag:
                    while len(stack) > k:
                        close()
    text(html[at:])
    while stack:
        close()
    for kind in ("article", "main"):
        if found := " ".join(" ".join("".join(out[a:b]) for a, b, tag in roots if tag == kind).split()):
            return found, hashes, *deleted
    return " ".join("".join(out).split()), hashes, *deleted


def _implied(stack: list, opened: dict[str, int], wanted: set[str], fence: frozenset[str] | set[str], close) -> None:
    if not any(opened.get(t) for t in wanted):
        return
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in wanted:
            while len(stack) > k:
                close()
            return
        if stack[k][0] in fence:
            return


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, texts = [], []
        for html in batch.column(3):
            text, found, _, _ = parse(html.as_py())
            hashes.append(sorted(set(found)))
            texts.append(_hash([text]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["k1", "k2", "host", "content", "hashes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [parse(html.as_py(), frozenset(found.as_py() or ())) for html, found in zip(batch.column(2), batch.column(3), strict=True)]
        longs = ([len(g[0]) for g in got], [g[2] for g in got], [g[3] for g in got])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), *(pa.array(x, pa.int64()) for x in longs)], ["page_id", "url", "text", "n_chars", "template_chars", "markup_chars"])


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _keyed(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    return rows.withColumns({"k1": F.xxhash64("page_id", "html", "host"), "k2": F.xxhash64("host", "html", "page_id")})


def features(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """k1, k2 (of the page), host, content (of its main text), hashes (of its subtrees), for each page; stored."""
    rows = _keyed(pages, page_id, url, html).select("k1", "k2", "host", "html")
    return saved(rows.mapInArrow(released(_features), "k1 long, k2 long, host string, content long, hashes array<long>"), "page-subtrees")


def templates(features: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, hash, n, pages): subtrees beside at least so many different main texts (n) of their host, and the pages that hold them."""
    seen = features.select("host", "content", F.explode("hashes").alias("hash")).groupBy("host", "content", "hash").agg(F.count(F.lit(1)).alias("pages"))
    return seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("pages").alias("pages")).filter(F.col("n") >= least_pages)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars, template_chars, markup_chars."""
    rows = _keyed(pages, page_id, url, html)
    seen = features(pages, page_id, url, html)
    own = seen.select("k1", "k2", "host", F.explode("hashes").alias("hash")).distinct()
    known = saved(templates(seen, least_pages), "host-templates")
    found = met(own, known, ["host", "hash"], "pages", seen.agg(F.sum(F.size("hashes"))).head()[0] or 0)
    # a page's own subtrees: the list is bounded by the page
    found = saved(found.groupBy("k1", "k2").agg(F.collect_list("hash").alias("found")), "page-templates")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    texts = rows.join(found, ["k1", "k2"], "left").select("page_id", "url", "html", "found")
    return texts.mapInArrow(released(_texts), "page_id long, url string, text string, n_chars long, template_chars long, markup_chars long")
