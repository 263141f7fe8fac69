"""HTML extraction with a site style tree.

Method: every page is read into blocks, each with its place in the style tree (the chain of element
names and class names from the body down). The pages of a host are merged: one aggregate over all
pages counts, for each host and place, the pages that carry each content and each whole list of contents. The
importance of a place is the entropy of its lists over the host's pages, divided by its maximum: 1 if
every page has a list of its own there, 0 if all pages repeat the same (menus, notices, legal lines). In a
place of low importance the contents of more than one page go; what a single page has there stays. In other places a
content is judged alone, by the share of the place's pages that carry it (0 if all do, 1 if one does),
whatever the size of the host.

Presentation counts too: elements that stand for navigation, headers, footers, sidebars and forms have no
importance whatever they contain; a header inside an article or main element belongs to it. A class or id, taken whole,
that stands for such a part, for adverts, notices or reader comments removes its branch, unless the branch
is a wrapper by its place: it encloses the main element or, on a page without one, the article with the most text. If no
text is left, the name of the largest branch is ignored. Names of reader comments and adverts have no such way out. Marked articles
weigh by their share of the page's text: importances inside them are raised by it, those outside
lowered, so a teaser decides nothing and a whole article much.

Entropy speaks only where a host has at least ``MIN_PAGES`` pages with the place. Pages with equal texts
count once, so copies of one page stay whole.

A host with a third of all pages costs partial counts before the shuffle; what a page needs from its
host is the short list of its low places and contents, and the join that brings it is a plain one that skew
handling can split.

Cases: a null or empty html gives an empty text; a null url has an empty host. Markup that is cut off or
unclosed is read as far as it goes. Page ids may be null or repeat; rows are read one by one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesync.llm.common import pinned
from tidesync.llm.url_filter import url_host

MIN_PAGES = 5
LOW_IMPORTANCE = 0.3

# Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select button canvas".split())
TO_THE_END = frozenset("script style".split())  # unclosed, they hold the rest of the page
PLAIN = frozenset("textarea title iframe".split())  # hold text only
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset("head nav header footer aside form dialog menu".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Reader comments and adverts: their names speak against a branch of any size.
READER_NAMES = frozenset("comment comments commentlist disqus replies respond reviews discussion".split())
ADVERT_NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion".split())
HEADER_NAMES = frozenset("header masthead banner".split())
SKIPPED_NAMES = READER_NAMES | ADVERT_NAMES | HEADER_NAMES | frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager "
    "copyright legal disclaimer".split()
)
#: Words that may stand beside a skipped one in a compound name, such as site-footer.
BESIDE_NAMES = frozenset(
    "site page main top bottom left right global primary secondary area section list box bar block wrapper container inner "
    "links buttons posts".split()
)
#: Words that may stand beside a name of reader comments or adverts, such as post-comments or ad-slot.
BESIDE_READER = BESIDE_NAMES | frozenset("post article user users reader readers customer visitor thread slot unit space".split())
#: Names of a single comment that is marked up as an article.
COMMENT_ARTICLES = frozenset("comment reply".split())
BESIDE_COMMENT = frozenset("body item content".split())
COMMENT_TYPES = ("schema.org/comment", "schema.org/usercomments")
ARTICLE = frozenset(("article", "main"))
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z0-9]+")


def unimportant(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the presentation of an element tells that it holds no main text; ``inside``: a marked article."""
    role = attributes.get("role", "").lower()
    if (tag in SKIPPED or role in SKIPPED_ROLES) and not (inside and tag == "header"):
        return True
    if role == "comment" or attributes.get("itemtype", "").lower().rstrip("/").endswith(COMMENT_TYPES):
        return True
    return "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def named(tag: str, attributes: dict[str, str], inside: bool) -> str | None:
    """What a class or id of an element, taken whole, says against it: ``reader`` (comments, adverts), ``part`` or nothing.

    Main, html and body are exempt, articles but for single comments; a header of a marked article (``inside``) is its own.
    """
    if tag in ("main", "html", "body"):
        return None
    found = None
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = set(_NAMES.findall(name))
        if tag == "article":
            if parts & COMMENT_ARTICLES and parts <= COMMENT_ARTICLES | BESIDE_COMMENT:
                return "reader"
            continue
        reader = READER_NAMES | ADVERT_NAMES
        if parts & reader and parts <= reader | BESIDE_READER:
            return "reader"
        skipped = SKIPPED_NAMES - HEADER_NAMES if inside else SKIPPED_NAMES
        if parts & skipped and parts <= SKIPPED_NAMES | BESIDE_NAMES:
            found = "part"
    return found


def _unnamed(blocks: list, branches: list[frozenset[int]], kinds: dict[int, str], wrappers: set[int]) -> list:
    """The blocks that no name speaks against."""
    against = [frozenset(i for i in b if i not in wrappers) for b in branches]
    if blocks and all(against):
        held: Counter[int] = Counter()
        for block, names in zip(blocks, against):
            held.update({i: len(block[2]) for i in names if kinds[i] == "part"})
        if held:
            largest = max(held, key=lambda i: (held[i], -i))
            against = [b - {largest} for b in against]
    return [block for block, names in zip(blocks, against) if not names]


def read_blocks(page: str | None) -> list[tuple[str, bool, str]]:
    """Blocks of a page in order: (place in the style tree, inside a marked article, text)."""
    blocks: list[tuple[str, bool, str]] = []
    branches: list[frozenset[int]] = []  # of each block: its branches whose name speaks against them
    kinds: dict[int, str] = {}  # of each such branch: what its name says
    enclosing: dict[int, frozenset[int]] = {}  # of each article and main element: the branches around it
    mains: set[int] = set()
    held_by: list[frozenset[int]] = []  # of each block: the articles and main elements around it
    around: list[tuple[int, int]] = []  # open articles and main elements: depth, number
    stack: list[tuple[str, str, bool, bool, frozenset[int], bool]] = []  # tag, label, unimportant, in article, branches, muted
    text: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            low = bool(stack) and stack[-1][2]
            if not low:
                place = "/".join(s[1] for s in stack if s[0] not in INLINE and not s[5])
                blocks.append((place, bool(stack) and stack[-1][3], joined))
                branches.append(stack[-1][4] if stack else frozenset())
                held_by.append(frozenset(number for _, number in around))

    def close_to(depth: int) -> None:
        if any(s[0] not in INLINE and not s[5] for s in stack[depth:]):
            flush()
        del stack[depth:]
        while around and around[-1][0] >= depth:
            around.pop()

    def close_open(tags: set[str], barrier: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return close_to(i)
            if stack[i][0] in barrier:
                return None

    source, at = page or "", 0
    while at < len(source):
        found = _MARKUP.search(source, at)
        if not (stack and stack[-1][5]):
            text.append(entities.unescape(source[at : found.start() if found else len(source)]))
        if not found:
            break
        at = found.end()
        closing, tag = found[1], (found[2] or "").lower()
        if not tag:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                close_to(depth)
            continue
        muted = bool(stack) and stack[-1][5]
        if tag in RAW:
            if found[0].endswith("/>"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at) if tag in TO_THE_END or tag in PLAIN else None
            if end or tag in TO_THE_END:
                at = end.end() if end else len(source)
                continue
            above = stack[-1] if stack else ("", "", False, False, frozenset(), False)
            stack.append((tag, tag, *above[2:5], True))  # without an end tag it ends with its parent
            continue
        if tag == "br" and not muted:
            text.append(" ")
        if tag in VOID:
            if tag == "hr" and not muted:
                flush()
            continue
        attributes = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(found[3])}
        if tag not in INLINE and not muted:
            flush()
        if tag in CLOSES_P and not muted:
            close_open({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS and not muted:
            close_open(SIBLINGS[tag], SCOPES[tag])
        inside = stack[-1][3] if stack else False
        low = (stack[-1][2] if stack else False) or unimportant(tag, attributes, inside)
        label = ".".join([tag, *sorted(attributes.get("class", "").lower().split())])
        against = stack[-1][4] if stack else frozenset()
        if kind := named(tag, attributes, inside):
            kinds[len(kinds)] = kind
            against |= {len(kinds) - 1}
        if not found[0].endswith("/>"):
            muted = bool(stack) and stack[-1][5]
            if tag in ARTICLE and not muted:
                around.append((len(stack), len(enclosing)))
                if tag == "main":
                    mains.add(len(enclosing))
                enclosing[len(enclosing)] = against
            stack.append((tag, label, low, inside or tag in ARTICLE, against, muted))
    flush()
    sizes: Counter[int] = Counter()
    for block, names, held in zip(blocks, branches, held_by):
        if not any(kinds[i] == "reader" for i in names):
            sizes.update(dict.fromkeys(held, len(block[2])))
    marked = mains or set(sorted(sizes, key=lambda i: (-sizes[i], i))[:1])
    wrappers = {i for m in marked for i in enclosing[m] if kinds[i] == "part"}
    return _unnamed(blocks, branches, kinds, wrappers)


def digest(*parts: str) -> int:
    """63-bit digest of texts; a place and a content of that place are named by it."""
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) >> 1


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every page: a row per place, with its list of contents as variant, and per content.

    ``node`` names the place, ``key`` the place or the content, ``version`` the page by its whole text.
    """
    for rows in batches:
        out = []
        for host, page in zip(rows["host"], rows["html"]):
            blocks = read_blocks(page)
            version = digest(*(text for _, _, text in blocks))
            lists: dict[str, list[str]] = {}
            for place, _, text in blocks:
                lists.setdefault(place, []).append(text)
            for place, texts in lists.items():
                node = digest(place)
                out.append((host, node, node, digest(*texts), version))
                out += [(host, node, digest(place, text), 0, version) for text in set(texts)]
        yield pd.DataFrame(out, columns=["host", "node", "key", "variant", "version"]).astype(dict.fromkeys(("node", "key", "variant", "version"), "int64"))


def low_places(spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = LOW_IMPORTANCE) -> DataFrame:
    """(host, lows): contents of a host (digests of place and text) that repeat over its pages, and their importance.

    Pages with equal texts count once. The importance is the content's own, 0 for what every page with the
    place carries and 1 for what one page has alone, or that of its place if more than one page carries it and the place's is less.
    """
    names = ["host", "node", "key", "variant"]
    rows = pages.select("host", "html").mapInPandas(_contents, "host string, node long, key long, variant long, version long")
    counted = rows.distinct().groupBy(*names).agg(F.count("*").alias("n"))
    counted = pinned(spark, counted, "html-counted")
    nodes = (
        counted.filter("key = node").groupBy("host", "node")
        .agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log2("n")).alias("s")).filter(F.col("pages") >= max(min_pages, 2))
    )
    of_node = (F.log2("pages") - F.col("s") / F.col("pages")) / F.log2("pages")
    of_content = 1 - (F.col("n") - 1) / (F.col("pages") - 1)
    contents = counted.filter("key != node AND n > 1").join(nodes, ["host", "node"])
    low = contents.select("host", "key", F.least(of_content, of_node).alias("importance")).filter(F.col("importance") < threshold)
    return low.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("key", "importance"))).alias("lows"))


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = []
        for page, lows in zip(rows["html"], rows["lows"]):
            low = {} if lows is None else {r["key"]: r["importance"] for r in lows}
            blocks = read_blocks(page)
            marked = sum(len(b[2]) for b in blocks if b[1]) / max(sum(len(b[2]) for b in blocks), 1)
            kept = []
            for place, inside, text in blocks:
                importance = low.get(digest(place, text), 1.0) if low else 1.0
                if importance * (1 + marked if inside else 1 - marked) >= LOW_IMPORTANCE:
                    kept.append(text)
            texts.append(" ".join(kept))
        yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), url_host(F.col("url")).alias("host"))
    low = pinned(spark, low_places(spark, rows), "html-low").withColumnRenamed("host", "__host")
    joined = rows.join(low, rows["host"] == low["__host"], "left").select("page_id", "url", "html", "lows")
    return joined.mapInPandas(_texts, "page_id long, url string, text string, n_chars long")
