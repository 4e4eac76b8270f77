"""Main text of pages by template deduction over the pages of a host.

A page is a sequence of tokens: its structural elements (named by their path of structural ancestors, with their
classes) and its text blocks (path and text). Tokens of a host with equal occurrence vectors - the same number of
occurrences in the same pages - form an equivalence class. The vectors are never gathered: a token's vector is
the XOR of hash(page, count) over its pages, an aggregate with a map-side part, so a host with a third of all pages is no
hot group.

A class is valid if it is frequent (in half of the host's pages or more) and its tokens occur once in each of its
pages; its elements nest by their paths, and a class that repeats within a page (the rows of a list, the
paragraphs) is nested in the slot of the valid element above it. The valid elements make the host's template, and
text blocks of valid classes in nine tenths of three or more pages belong to it too. What is left varies: it fills the
template's slots. The main slot is the deepest valid element that is no furniture (menus, headers, footers, side
bars, notices, adverts, forms, comments, by element, role or class name) and holds all of the host's varying
words. It is never below an article or main element, so no article is narrowed to a part of its text. Text repeated on every page
helps to choose the slot but is never cut out of it, so copies of a page keep their text.

A class or id marks furniture only as a whole name ("share", "cookie-notice", not "share-prices"), on no article or main
element and none above a main element, and only where it holds half of the host's varying words or less.

Extraction joins each page with its host's main slot and writes the slot's blocks without furniture. A page
that lacks the slot, or a host without one, falls back on the page's own article, main or body.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.
Null and empty html give an empty text; a null url is a host of its own; repeated rows give repeated rows; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import map_batches
from tallyframe.llm.words import slices
from tallyframe.session import cut_lineage

#: HTML element names by their part here, and names that mark furniture.
STRUCTURAL = frozenset("html body main article section div header footer nav aside form ul ol dl table tbody tr td figure details dialog menu blockquote".split())
BLOCKS = STRUCTURAL | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address caption thead tfoot th figcaption summary fieldset legend center title head option optgroup".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea select button datalist noembed noframes xmp".split())
#: Without an end tag these go on to the end of the page; of the others only the tag is left out.
UNPARSED = frozenset("script style textarea iframe xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form menu dialog head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos
    promotion sidebar sidebars side aside menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead header
    footer foot footers comment comments reply replies respond disqus discussion cookie cookies consent gdpr notice
    notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related
    recommended recommendations widget widgets pagination pager tags search skip""".split()
)

#: Parts that may stand beside furniture names in a class or id ("top-banner", "comment-list") without changing what it names.
NEUTRAL_NAMES = frozenset("top bottom left right main site page box boxes list area bar block blocks button buttons wrap wrapper container section inner outer primary secondary global post posts form links".split())

HEADS = frozenset(("header", "masthead"))

DEEPEST = 64  # levels that paths tell apart
PAGES_AT_ONCE = 128  # whose texts a task holds

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
_QUOTED = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_BARE_HIDDEN = re.compile(r"\shidden(?=[\s/>]|$)", re.IGNORECASE)
_NAMES = re.compile(r"[a-z0-9]+")
_CLOSED = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Element:
    """An open structural element."""

    __slots__ = ("above", "depth", "furniture", "hard", "inside", "main", "marked", "name", "named", "own_main", "parent", "path")

    def __init__(self, name: str, path: str, parent: Element | None, depth: int) -> None:
        self.name, self.path, self.parent, self.depth = name, path, parent, depth
        self.own_main = self.marked = self.above = False  # above: a main element is inside
        self.named = frozenset()  # furniture names among its classes and id
        self.inside = False  # the slot that is asked for
        self.furniture = self.hard = self.main = False

    def settle(self, kept: frozenset[str]) -> None:
        """Whether it is furniture, by its marks alone (hard) or by names too, or in an article; its parent is settled."""
        up = self.parent
        head = up.main and (self.name == "header" or self.named <= HEADS)  # an article's own header stays
        marked = self.marked or (self.name in FURNITURE and not (self.name == "header" and up.main))
        named = bool(self.named) and not (head or self.own_main or self.above or self.path in kept)
        self.hard = up.hard or marked
        self.furniture = up.furniture or marked or named
        self.main = (self.own_main or up.main) and not self.furniture


def _tag_end(html: str, at: int, gone: dict[str, bool]) -> int:
    """Place of the '>' that ends the tag, outside quoted values (an unclosed quote doesn't count)."""
    end = html.find(">", at)
    if end < 0:
        return len(html)
    while (m := _QUOTED.search(html, at, end)) and not gone.get(m[1]):
        close = html.find(m[1], m.end())
        if close < 0:
            gone[m[1]] = True
        elif close < end:
            at = close + 1
        else:
            end = html.find(">", close)
            if end < 0:
                return len(html)
            at = close + 1
    return end


def markup(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): 'text' with the raw text, 'open' and 'close' with the name and the attributes' text."""
    at, gone = 0, {}
    while True:
        m = _MARKUP.search(html, at)
        if not m:
            yield "text", "", html[at:]
            return
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        start = m.group()
        if start == "<!--":
            end = html.find("-->", m.end())
            at = len(html) if end < 0 else end + 3
        elif start == "<![CDATA[":
            end = html.find("]]>", m.end())
            at = len(html) if end < 0 else end + 3
        elif not m[2]:
            end = html.find(">", m.end())
            at = len(html) if end < 0 else end + 1
        else:
            end = _tag_end(html, m.end(), gone)
            name = m[2].lower()
            at = end + 1
            if m[1]:
                yield "close", name, ""
                continue
            rest = html[m.end() : end]
            if name in RAW and not rest.endswith("/"):
                closing = None if gone.get(name) else _CLOSED[name].search(html, at)
                gone[name] = closing is None
                if closing:
                    at = min(len(html), _tag_end(html, closing.end(), gone) + 1)
                elif name in UNPARSED:
                    at = len(html)
            if name not in RAW:
                yield "open", name, rest
        if at >= len(html):
            return


def _furniture_names(label: str) -> frozenset[str]:
    """The furniture names in a class or id list, of names that have nothing else in them."""
    found: set[str] = set()
    for whole in label.split():
        pieces = set(_NAMES.findall(whole))
        if pieces <= FURNITURE_NAMES | NEUTRAL_NAMES:
            found |= pieces & FURNITURE_NAMES
    return frozenset(found)


def _element(name: str, rest: str, parent: Element) -> Element:
    attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
    label = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    names = _NAMES.findall(label)
    role = attributes.get("role", "").lower()
    main = name in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
    named = _furniture_names(label) if name not in ("body", "html") and not main else frozenset()
    own = f"{name}{'!' if main else ''}{'?' if named else ''}"  # in paths: article and main elements, furniture names
    own = f"{own}.{'.'.join(sorted(set(names)))}" if names else own
    depth = parent.depth + 1
    path = f"{parent.path}/{own}" if depth <= DEEPEST else parent.path  # deeper elements share a name; their text counts all the same
    made = Element(name, path, parent, depth)
    made.own_main, made.named = main, named
    made.marked = (
        role in FURNITURE_ROLES
        or "hidden" in attributes
        or bool(_BARE_HIDDEN.search(rest))
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    )
    if name == "main" or role == "main":
        up = parent
        while up is not None and not up.above:
            up.above = True
            up = up.parent
    return made


class Block:
    """A text block, with the structural element it stands in."""

    __slots__ = ("element", "text")

    def __init__(self, element: Element, text: str) -> None:
        self.element, self.text = element, text


def parse(html: str, slot: str | None = None, kept: frozenset[str] = frozenset()) -> tuple[list[Block], list[Element]]:
    """The page's text blocks in order, and its structural elements in order; those in ``slot`` are marked.

    Names do not make furniture of the paths ``kept``.
    """
    root = Element("", "", None, 0)
    stack, elements, blocks, held = [root], [], [], []
    opened: dict[str, int] = {}
    skipping = 0  # inside <head>/<title>

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append(Block(stack[-1], text))

    for kind, name, rest in markup(html):
        if kind == "text":
            if not skipping:
                held.append(rest)
        elif name in ("title", "head"):
            if name == "title":
                flush()
                skipping = int(kind == "open")
        elif name == "br":
            held.append(" ")
        elif name in BLOCKS:
            flush()
            skipping = 0
            if name in STRUCTURAL:
                if kind == "open":
                    made = _element(name, rest, stack[-1])
                    made.inside = stack[-1].inside or made.path == slot
                    stack.append(made)
                    opened[name] = opened.get(name, 0) + 1
                    elements.append(stack[-1])
                elif opened.get(name):  # closes what is open inside it, too
                    while True:
                        closed = stack.pop()
                        opened[closed.name] -= 1
                        if closed.name == name:
                            break
    flush()
    for e in elements:  # parents come first
        e.settle(kept)
    return blocks, elements


def _tokens(html: str) -> dict[tuple[str, str], list[int]]:
    """(path, text) -> [occurrences, words, words whatever the names]; elements have an empty text. Furniture has no words."""
    blocks, elements = parse(html)
    out: dict[tuple[str, str], list[int]] = {}
    for e in elements:
        out.setdefault((e.path, ""), [0, 0, 0])[0] += 1
    for b in blocks:
        row = out.setdefault((b.element.path, b.text), [0, 0, 0])
        words = len(b.text.split())
        row[0] += 1
        row[1] += 0 if b.element.furniture else words
        row[2] += 0 if b.element.hard else words
    return out


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, path, text, pages, vector, most, words, loose) of every token of every host; text: hash, null for elements."""
    fields = [
        ("host", T.StringType()),
        ("page", T.LongType()),
        ("path", T.StringType()),
        ("text", T.StringType()),
        ("n", T.IntegerType()),
        ("words", T.LongType()),
        ("loose", T.LongType()),
    ]
    rows = pages.select(host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), "html")

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in slices(batch, "html"):
            out: list[list] = [[], [], [], [], [], [], []]
            for h, page, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for (path, text), (n, words, loose) in _tokens(html or "").items():
                    for column, value in zip(out, (h, page, path, text, n, words, loose), strict=True):
                        column.append(value)
            yield out

    found = map_batches(rows, run, fields)
    hashed = found.withColumn("text", F.expr("IF(text = '', NULL, xxhash64(text))"))
    return hashed.groupBy("host", "path", "text").agg(
        F.count("*").alias("pages"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.max("n").alias("most"),
        F.sum("words").alias("words"),
        F.sum("loose").alias("loose"),
    )


def _held(part: str, whole: str) -> Column:
    """An element's share of its host's varying words, or of all its words if none varies."""
    varies = F.col(f"{whole}_varying") > 0
    return F.when(varies, F.col(f"{part}_varying") / F.col(f"{whole}_varying")).otherwise(F.col(f"{part}_words") / F.greatest(f"{whole}_words", F.lit(1)))


def deduce(pages: DataFrame) -> DataFrame:
    """(host, slot, kept): the path of each host's main slot, and the paths that are no furniture in spite of their names."""
    tokens = cut_lineage(occurrences(pages), "tokens")
    total = pages.select(host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("of"))
    classes = tokens.filter("most = 1").groupBy("host", "vector", "pages").agg(F.count("*").alias("size"), F.count("text").alias("texts"))
    classes = classes.join(total, "host").filter("2 * pages >= of")
    template = classes.select("host", "vector", "pages", "of", "size", "texts")
    marked = tokens.join(template, ["host", "vector", "pages"], "left")
    # A text is the template's if its class is valid and nearly everywhere; then its words don't vary.
    fixed = F.col("text").isNotNull() & (F.col("most") == 1) & (F.col("of") >= 3) & (10 * F.col("pages") >= 9 * F.col("of"))
    marked = marked.withColumn("fixed", F.coalesce(fixed, F.lit(False)))
    steps = F.expr("transform(sequence(2, size(split(path, '/'))), n -> array_join(slice(split(path, '/'), 1, n), '/'))")
    names = F.filter(steps, lambda s: F.element_at(F.split(s, "/"), -1).contains("?"))

    def sums(rows: DataFrame, words: str, prefix: str, *by: str) -> DataFrame:
        varying = F.when(F.col("fixed"), 0).otherwise(F.col(words))
        return rows.groupBy(*by).agg(F.sum(varying).alias(f"{prefix}_varying"), F.sum(words).alias(f"{prefix}_words"))

    texts = marked.filter("text IS NOT NULL")
    named = texts.filter("path LIKE '%?%'").select("host", F.explode(names).alias("slot"), "fixed", "loose")
    named = sums(named, "loose", "part", "host", "slot").join(sums(texts, "loose", "whole", "host"), "host")
    named = named.filter(_held("part", "whole") > 0.5).groupBy("host").agg(F.collect_set("slot").alias("kept"))  # nested paths
    named = cut_lineage(named, "kept")
    texts = texts.join(named, "host", "left")
    free = F.col("kept").isNotNull() & (F.size(F.array_except(names, "kept")) == 0) & (F.col("path") != "")
    texts = texts.withColumn("words", F.when(F.coalesce(free, F.lit(False)), F.col("loose")).otherwise(F.col("words")))
    weights = sums(texts.filter("path <> ''").select("host", F.explode(steps).alias("slot"), "fixed", "words"), "words", "part", "host", "slot")
    valid = marked.filter("text IS NULL AND of IS NOT NULL AND most = 1").select("host", F.col("path").alias("slot"))
    slots = valid.join(weights, ["host", "slot"]).join(sums(texts, "words", "whole", "host"), "host")
    ranked = slots.select("host", "slot", _held("part", "whole").alias("held"), F.size(F.split("slot", "/")).alias("depth"))
    ranked = ranked.filter((F.col("held") >= 1) & ~F.col("slot").rlike("![^/]*/"))
    slots = ranked.groupBy("host").agg(F.max_by("slot", F.struct("depth", "slot")).alias("slot"))
    return slots.join(named, "host", "full")


def main_text(html: str, slot: str | None, kept: frozenset[str] = frozenset()) -> str:
    """The blocks of ``slot`` (a path), or of the page's own article, main or body, without furniture."""
    blocks, elements = parse(html, slot, kept)
    if any(e.inside for e in elements):
        inside = [b for b in blocks if b.element.inside]
    else:
        inside = [b for b in blocks if b.element.main]
        if not inside:
            inside = blocks
    return "\n\n".join(b.text for b in inside if not b.element.furniture)


@F.arrow_udf(T.BinaryType())
def _packed(html: pa.Array) -> pa.Array:
    """Compressed pages: the join by host moves them once."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if h is None else pack(h.encode()) for h in html.to_pylist()], pa.binary())


def extract(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""
    slots = deduce(pages)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _packed(F.col("html").cast("string")).alias("html"), host(F.col("url")).alias("host"))
    rows = rows.join(slots, "host", "left").select("page_id", "url", "html", "slot", "kept")
    fields = [("page_id", pages.schema["page_id"].dataType), ("url", T.StringType()), ("text", T.StringType()), ("n_chars", T.LongType())]

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        unpack = zstandard.ZstdDecompressor().decompress
        for start in range(0, batch.num_rows, PAGES_AT_ONCE):
            part = batch.slice(start, PAGES_AT_ONCE)
            packed, wanted = part.column("html").to_pylist(), part.column("slot").to_pylist()
            kept = part.column("kept").to_pylist()
            texts = ["" if h is None else main_text(unpack(h).decode(), s, frozenset(k or ())) for h, s, k in zip(packed, wanted, kept, strict=True)]
            yield [part.column("page_id"), part.column("url"), texts, [len(t) for t in texts]]

    return map_batches(rows, run, fields)
