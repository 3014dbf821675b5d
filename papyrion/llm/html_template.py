"""HTML main-text extraction by equivalence-class template deduction.

Tokens of a page are its tags, told apart by their path in the tree, and its texts, told apart by
path and content. A path names each element by tag, class and id, and a container by the kind of its
first child too, so that boxes without names differ by what they hold. Tokens of one host that have
the same occurrence vector (equally often in every page) form an equivalence class. Occurrence
vectors are never gathered: a sum of hashes of (page, count) over the pages that hold a token
identifies its vector, and sums combine before the shuffle. Large classes that nearly all pages of
the host hold are its template. On each page the classes whose tokens stand in the class's order are
valid; they are nested, the rarer inside one gap of the wider; what is left between their tokens are
the slots.

A host's main slot is the one with the most text over all its pages, links and what HTML itself sets
apart not counted. Main text is what lies in the slots of the template's box about it, without the
parts that tags, roles and names mark as something else. Two different pages make a template. Where
there is no such box on a page (hosts of one page, pages off the template), tags and names alone decide.

A host may hold most pages: they are parsed where they lie, and what meets by host is the template
alone, which a page's length bounds. Templates reach pages by a join on host and a salt: a host of
many pages has its template copied to as many salts, so that no task gets more than about SALTED of
one host's pages. Parsing is linear in a page's length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.shared import free_name, stored

#: A template class is held by at least so many pages and this percentage of the host's pages, and has so many tokens.
LEAST_PAGES, LEAST_PERCENT, LEAST_TOKENS = 2, 90, 3
#: Pages that hold a template token must differ: not all have one content, and their contents' hashes fall into at least
#: so many of 64 bins, or half as many as the host has contents. So a page that a host serves under very many addresses
#: does not make its own article a template.
LEAST_BINS = 5
#: Where template text is more than this percentage of the main box's text, the pages are versions of one article, and
#: it stays; so it does on hosts of fewer different pages than this, where one shared passage is no evidence.
MOST_FIXED, FIXED_PAGES = 50, 3

#: Pages of a host that one salt stands for, on average.
SALTED = 4096
#: Hosts of more pages than that whose numbers of salts are sent to every task.
MOST_WIDE = 100_000

# HTML's void, inline and raw-text elements, and the elements, roles and names of what is not main text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg".split())
_NOT_MAIN = frozenset(
    "head script style noscript template svg math iframe object canvas audio video nav header footer aside menu form button select textarea dialog".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe share sharing social comment comments "
    "disqus replies related recommended pagination pager toolbar copyright".split()
)
_COMMENT_NAMES = frozenset("comment comments disqus reply replies".split())
#: Elements that a following element of the named kinds closes, and those beyond which it does not reach.
_CLOSES_P = frozenset("p div article section aside nav header footer main ul ol dl table form h1 h2 h3 h4 h5 h6 pre blockquote hr figure fieldset address".split())
_HOLDS_P = ("article", "section", "div", "td", "th", "li", "blockquote", "body", "main", "aside", "nav", "header", "footer", "form")
_CLOSED_BY_OWN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr",), "th": ("tr",), "option": ("select",)}

#: Kinds of tokens, as the host's template keeps them.
TEXT, TAG, BOX, ARTICLE, TITLE, BODY = range(6)
_KINDS = dict.fromkeys(("div", "section", "td", "center", "table", "tr", "tbody"), BOX) | dict.fromkeys(("article", "main"), ARTICLE) | {"h1": TITLE} | dict.fromkeys(("html", "body"), BODY)

#: A tag as nearly all are written, and the beginnings of any other markup.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+)>")
_BEGINS = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_UNQUOTED = re.compile(r"[^>\"']*+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_ATTR = re.compile(r"\b(class|id|role|hidden|style)(?=[\s=/>]|\Z)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"[0-9]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_SIGN = (1 << 63) - 1


class Open:
    """An element: its tag, names and parent, its path once its first child is known, and what holds
    for text inside it. volume is the length of that text, links and dropped parts not counted."""

    __slots__ = ("tag", "names", "parent", "kind", "path", "token", "dropped", "main", "article", "link", "volume", "inside")

    def __init__(self, tag: str, names: str, parent: Open | None, gone: bool, main: bool):
        self.tag, self.names, self.parent, self.kind, self.path, self.token, self.volume, self.inside = tag, names, parent, _KINDS.get(tag, TAG), None, 0, 0, False
        if parent is None:
            self.path, self.dropped, self.main, self.article, self.link = b"", False, False, False, False
        else:
            self.dropped, self.main, self.article, self.link = parent.dropped or gone, parent.main or main, parent.article or tag == "article", parent.link or tag == "a"

    def begun(self, first: str) -> None:
        """Settles the path by the kind of the first child."""
        kind = first if self.kind in (BOX, ARTICLE) else ""
        self.path = xxhash.xxh64_digest(self.parent.path + f"<{self.tag}{self.names}>{kind}".encode())
        self.token = int.from_bytes(self.path, "little") & _SIGN


def _opened(parent: Open, tag: str, attrs: str) -> Open:
    names, role, gone = "", "", tag in _NOT_MAIN
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += f" {value}"
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or "display:none" in value.replace(" ", "").lower():
                gone = True
    if names:
        parts = {p.lower() for p in _NAME_PARTS.findall(names)}
        if tag == "article":
            gone |= not parts.isdisjoint(_COMMENT_NAMES)
        elif tag not in ("html", "body", "main"):
            gone |= not parts.isdisjoint(_NAMES)
    return Open(tag, _DIGITS.sub("0", names) if names else "", parent, gone or role in _ROLES, tag == "main" or role == "main")


#: A token (kind, text, element): a tag (no text), a text, or the end of a block (kind -1, no text) or a space (kind -1).
Token = tuple[int, str, Open]


def token_hash(token: Token) -> int:
    kind, said, at = token
    if kind != TEXT:
        return at.token if kind > TEXT else 0
    return xxhash.xxh64_intdigest(at.path + b"\0" + " ".join(said.split()).encode()) & _SIGN


def parse(html: str) -> list[Token]:
    """The tokens of a page in order."""
    root = Open("", "", None, False, False)
    stack, where = [root], defaultdict(list)
    tokens: list[Token] = []
    failed: set[int] = set()

    def text(raw: str) -> None:
        if not raw:
            return
        top = stack[-1]
        if raw.isspace():
            tokens.append((-1, " ", top))
            return
        if top.path is None:
            top.begun("#")
        said = unescape(raw) if "&" in raw else raw
        tokens.append((TEXT, said, top))
        if not (top.dropped or top.link):
            top.volume += len(said)

    def pop(to: int) -> None:
        while len(stack) > to:
            gone = stack.pop()
            if gone.path is None:
                gone.begun("")
            gone.parent.volume += gone.volume
            where[gone.tag].pop()

    def close(tag: str, within: tuple[str, ...] = ()) -> None:
        if (places := where.get(tag)) and all(not (w := where.get(t)) or w[-1] < places[-1] for t in within):
            pop(places[-1])

    def quoted_end(at: int) -> int:
        """The > that ends a tag, looked for from at, quoted ones not counted; -1 if there is none. Where a
        search has failed, no later one goes again."""
        seen = []
        while True:
            at = _UNQUOTED.match(html, at).end()
            if at < len(html) and html[at] == ">":
                return at
            if at in failed or at >= len(html) or (end := html.find(html[at], at + 1)) < 0:
                failed.update(seen, (at,))
                return -1
            seen.append(at)
            at = end + 1

    at, last = 0, html.rfind(">")
    start = html.find("<")
    while 0 <= start < last:
        if m := _TAG.match(html, start):
            slash, tag, attrs, end = m[1], m[2].lower(), m[3], m.end()
        elif html.startswith("<!--", start):
            text(html[at:start])
            at = end + 3 if (end := html.find("-->", start + 4)) >= 0 else len(html)
            start = html.find("<", at)
            continue
        elif html.startswith(("<!", "<?"), start):
            text(html[at:start])
            at = html.find(">", start) + 1
            start = html.find("<", at)
            continue
        elif m := _BEGINS.match(html, start):
            end = quoted_end(m.end())
            end = (html.find(">", m.end()) if end < 0 else end) + 1
            slash, tag, attrs = m[1], m[2].lower(), html[m.end() : end - 1]
        else:
            start = html.find("<", start + 1)
            continue
        text(html[at:start])
        at = end
        if tag in _RAW and not slash:
            if not attrs.endswith("/"):
                at = m.end() if (m := _RAW_END[tag].search(html, end)) else len(html)
            start = html.find("<", at)
            continue
        start = html.find("<", at)
        if tag == "br":
            tokens.append((-1, " ", stack[-1]))
            continue
        if tag not in _INLINE:
            tokens.append((-1, "", stack[-1]))
        if slash:
            close(tag)
            continue
        if tag in _CLOSES_P:
            close("p", _HOLDS_P)
        if tag in _CLOSED_BY_OWN:
            close(tag, _CLOSED_BY_OWN[tag])
        if (top := stack[-1]).path is None:
            top.begun(tag)
        opened = _opened(top, tag, attrs)
        tokens.append((opened.kind, "", opened))
        if tag in _VOID or attrs.endswith("/"):
            opened.begun("")
        else:
            where[tag].append(len(stack))
            stack.append(opened)
    text(html[at:])
    pop(1)
    return tokens


class Template(NamedTuple):
    """A host's template: token -> (class, place in the class's order, tokens of the class), classes
    numbered from the widest; the token of the main box (0: none), and whether template text in it stays."""

    places: dict[int, tuple[int, int, int]]
    box: int = 0
    stays: bool = False


def template_places(hashes: list[int], places: dict[int, tuple[int, int, int]]) -> set[int]:
    """The places of a page's tokens that its host's template holds.

    A class is valid on the page if its tokens stand in its order, as often as they come, and
    nested if each run of it lies in one gap of the classes before it.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes = {}
    for i, h in enumerate(hashes):
        if found := places.get(h):
            runs[found[0]].append((i, found[1]))
            sizes[found[0]] = found[2]
    held: list[int] = []
    for c in sorted(runs):
        run, size = runs[c], sizes[c]
        if len(run) % size or any(order != k % size for k, (_, order) in enumerate(run)):
            continue
        spans = [[i for i, _ in run[k : k + size]] for k in range(0, len(run), size)]
        gaps = [bisect_left(held, s[0]) for s in spans]
        if any(bisect_left(held, s[-1]) != g for s, g in zip(spans, gaps, strict=True)):
            continue
        for s, g in zip(reversed(spans), reversed(gaps), strict=True):
            held[g:g] = s
    return set(held)


def main_text(html: str, template: Template | None = None) -> str:
    """The main text of a page: blocks in order, joined by line feeds, white space in a block as
    one space."""
    tokens = parse(html)
    fixed: set[int] = set()
    region, stays = "", False
    said_in = lambda region: any(kind == TEXT and not at.dropped and getattr(at, region) for kind, _, at in tokens)
    if template:
        fixed = template_places(list(map(token_hash, tokens)), template.places)
        for kind, _, at in tokens:
            if kind > TEXT:
                at.inside = at.parent.inside or at.token == template.box
        region, stays = ("inside", template.stays) if template.box and said_in("inside") else ("", False)
    region = region or next((r for r in ("article", "main") if said_in(r)), "")
    blocks: list[str] = []
    parts: list[str] = []
    loose = linked = False

    def flush() -> None:
        # Outside any article, a block of links alone is a menu.
        if (loose or not linked or region) and (said := " ".join("".join(parts).split())):
            blocks.append(said)

    for i, (kind, said, at) in enumerate(tokens):
        if not said:
            if kind < 0:
                flush()
                parts, loose, linked = [], False, False
            continue
        if at.dropped or (i in fixed and not stays) or (region and not getattr(at, region)):
            parts.append(" ")
            continue
        parts.append(said)
        if kind == TEXT:
            loose, linked = loose or not at.link, linked or at.link
    flush()
    return "\n".join(blocks)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, content, token, n, place, parent, kind, volume) for every different token of a page."""
    names = ("host", "page", "content")
    for batch in batches:
        keys, found = ([], [], []), ([], [], [], [], [], [])
        for *key, html in zip(*(batch.column(c).to_pylist() for c in names), batch.column("html"), strict=True):
            counts: dict[int, list[int]] = {}
            for i, (kind, said, at) in enumerate(tokens := parse(html.as_py())):
                if kind >= 0:
                    parent, volume = (at.token, 0 if at.dropped or at.link else len(said)) if kind == TEXT else (at.parent.token, at.volume)
                    row = counts.setdefault(token_hash(tokens[i]), [0, i, parent, kind, 0])
                    row[0] += 1
                    row[4] += volume
            for k, value in enumerate(key):
                keys[k].extend([value] * len(counts))
            for k, column in enumerate((counts, *zip(*counts.values(), strict=True))):
                found[k].extend(column)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*keys, *found)], [*names, "token", "n", "place", "parent", "kind", "volume"])


def main_box(tokens: list[tuple[int, int, int, int, bool]]) -> tuple[int, bool]:
    """The token of a host's main box (0: none), and whether template text in it stays. tokens: (token,
    parent, kind, volume, in the template) of what nearly all pages hold; parents of these are such too."""
    known = {t: (parent, kind) for t, parent, kind, _, _ in tokens}
    framed = {t for t, _, kind, _, held in tokens if held and kind in (BOX, ARTICLE)}
    # What an element's own slots hold: its text without that of parts that have slots of their own.
    own = {t: volume for t, _, kind, volume, _ in tokens if kind != TEXT}
    for _, parent, kind, volume, held in tokens:
        if parent in own and (kind != TEXT or held):
            own[parent] -= volume
    box = min((t for t in own), key=lambda t: (-own[t], t), default=0)
    titled: set[int] = set()
    for t, _, kind, _, _ in tokens:
        while kind == TITLE and t in known and known[t][1] != BODY and t not in titled:
            titled.add(t)
            t = known[t][0]

    def up(t: int, wanted) -> int:
        while t and not wanted(t):
            t = known[t][0] if t in known else 0
        return t

    box = up(box, framed.__contains__)
    if article := up(box, lambda t: t in framed and known[t][1] == ARTICLE):
        box = article
    elif box:
        # A box about it that holds the title belongs to the article.
        outer = up(known[box][0], lambda t: known[t][1] == BODY or (t in framed and t in titled)) if box not in titled else 0
        box = outer if outer in framed else box
    within = {box: True, 0: False}
    for t in known:
        chain = []
        while t not in within:
            chain.append(t)
            t = known[t][0] if t in known else 0
        within |= dict.fromkeys(chain, within[t])
    fixed = sum(volume for t, _, kind, volume, held in tokens if kind == TEXT and held and within[t])
    return box, fixed * 100 > MOST_FIXED * sum(volume for t, _, _, volume, _ in tokens if t == box)


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, template, box, stays): the tokens of each host's template classes as pairs of 64-bit
    integers (class, token), by class from the widest and in the class's order, and the main box.
    pages: host, page, content (hashes) and html."""
    hosts = pages.groupBy("host", "content").agg(F.count("*").alias("n")).groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("contents"))
    hosts = hosts.where(F.col("contents") >= LEAST_PAGES)
    rows = pages.mapInArrow(_occurrences, "host long, page long, content long, token long, n long, place long, parent long, kind long, volume long")
    h = F.xxhash64("page", "n")
    tokens = rows.groupBy("host", "token").agg(
        F.count("*").alias("held"), F.sum("n").alias("total"), F.sum("place").alias("place"),
        F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("v1"), F.sum(F.shiftrightunsigned(h, 33)).alias("v2"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, int(pmod(content, 64)))"))).alias("bins"),
        F.min("content").alias("c1"), F.max("content").alias("c2"), F.min("parent").alias("parent"), F.min("kind").alias("kind"), F.sum("volume").alias("volume"),
    )
    tokens = tokens.where((F.col("held") >= LEAST_PAGES) & (F.col("c1") < F.col("c2"))).join(hosts, "host")
    tokens = tokens.where((F.col("held") * 100 >= F.col("pages") * LEAST_PERCENT) & (F.col("bins") >= F.least(F.lit(LEAST_BINS), F.expr("contents DIV 2"))))
    same = Window.partitionBy("host", "held", "total", "v1", "v2")
    tokens = tokens.withColumn("size", F.count("*").over(same)).withColumn("class", F.xxhash64("total", "v1", "v2"))
    # Widest first: held by most pages, then the fewest runs a page, then the largest.
    order = [(-F.col("held")).alias("a"), "total", (-F.col("size")).alias("b"), "v1", "v2", "place", "token"]
    row = F.struct(*order, "class", "parent", "kind", "volume", (F.col("size") >= LEAST_TOKENS).alias("inside"))

    @F.arrow_udf("struct<template: binary, box: bigint, stays: boolean>")
    def settled(lists: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for rows, n in zip(lists, contents.to_pylist(), strict=True):
            rows = rows.as_py()
            box, stays = main_box([(r["token"], r["parent"], r["kind"], r["volume"], r["inside"]) for r in rows])
            out.append({"template": np.array([(r["class"], r["token"]) for r in rows if r["inside"]], "<i8").tobytes(), "box": box, "stays": stays or n < FIXED_PAGES})
        return pa.array(out, pa.struct([("template", pa.binary()), ("box", pa.int64()), ("stays", pa.bool_())]))

    found = tokens.groupBy("host").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("contents").alias("contents"), F.max("pages").alias("pages"))
    return found.select("host", "pages", settled("rows", "contents").alias("s")).select("host", "pages", "s.*")


@lru_cache(maxsize=64)
def _lookup(template: bytes, box: int, stays: bool) -> Template | None:
    classes: dict[int, list[int]] = {}
    for c, token in np.frombuffer(template, "<i8").reshape(-1, 2).tolist():
        classes.setdefault(c, []).append(token)
    if not classes:
        return None
    return Template({token: (c, k, len(held)) for c, held in enumerate(classes.values()) for k, token in enumerate(held)}, box, stays)


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Every row of df with ``out_col``: the main text of its page, empty if there is none.

    Null pages are empty; pages with a null URL, or one without a host, are of one host. Repeated
    rows count once for each. Hosts without two different pages have no template; their pages
    are read by tags and names alone. A column of that name is replaced, all others stay.
    """
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), _HOST, 1)))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    found = stored(templates(df.select(host.alias("host"), F.xxhash64(F.col(url_col), html).alias("page"), F.xxhash64(html).alias("content"), html.alias("html"))), "templates")

    @F.arrow_udf("string")
    def text_of(pages: pa.Array, template: pa.Array, box: pa.Array, stays: pa.Array) -> pa.Array:
        rows = zip(pages, template, box, stays, strict=True)
        return pa.array([main_text(p.as_py(), _lookup(t.as_py(), b.as_py(), s.as_py()) if t.is_valid else None) for p, t, b, s in rows], pa.string())

    plain = df.drop(out_col) if html_col != out_col and url_col != out_col else df
    names = [free_name(plain, f"_page_{c}") for c in ("host", "salt", "template", "box", "stays")]
    salts = lambda pages: F.floor((pages - 1) / SALTED).cast("int") + 1
    copies = found.select("host", F.explode(F.sequence(F.lit(0), salts(F.col("pages")) - 1)).alias("salt"), "template", "box", "stays")
    # How many salts a host has is known from its template; few hosts have several, and those alone are looked up.
    wide = found.where(F.col("pages") > SALTED).select(F.col("host").alias(names[0]), salts(F.col("pages")).alias(names[1]))
    rows = plain.withColumn(names[0], host)
    rows = rows.join(F.broadcast(wide), names[0], "left") if wide.limit(MOST_WIDE + 1).count() <= MOST_WIDE else rows.join(wide, names[0], "left")
    rows = rows.withColumn(names[1], F.coalesce(F.pmod(F.xxhash64(html), F.col(names[1])), F.lit(0)).cast("int"))
    joined = rows.join(copies.toDF(*names), names[:2], "left")
    return joined.withColumn(out_col, text_of(html, *names[2:])).drop(*names)
