"""Main text of web pages, by container paths that pages of a host agree on.

Every page votes for the container that holds its text; votes for generalised
paths of tags and classes are counted by host in Spark; then every page is
extracted again by the containers on its host's winning paths: they are kept
whole, and outside them only blocks that are mainly links are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.llm.common import stored, text_slices
from ondula.session import broadcast_if_small

SHARE = 0.7  # of a page's text that its container holds
SEMANTIC_SHARE = 0.5  # the same for an article or main element
WINNER_PERCENT = 20  # of a host's votes that a path needs
SALTS = 16

# Fixed lists of elements.
VOTED = set("html body main article section div center".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg".split())
UNENDED = set("script style textarea".split())  # without an end tag they hold the rest of the page
SKIP = set(
    "nav footer aside form button dialog menu head object audio video canvas select datalist "
    "optgroup option annotation annotation-xml".split()
)
MATH = set(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover none semantics annotation annotation-xml".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
) | (MATH - {"annotation", "annotation-xml"})
P_CLOSERS = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
    "option": {"option"},
    "optgroup": {"option", "optgroup"},
}
# What these start isn't part of an option outside a list of choices, or of an svg.
ENDS_OPTION = P_CLOSERS - {"hr"} | {"li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot"}
_ENDS_SVG = re.compile(
    r"<(?:blockquote|body|center|d[dlt]|div|embed|h[1-6]|hr|img|li|listing|menu|[ou]l|p|pre|ruby|table)(?=[\s/>])",
    re.I,
)
SCOPE = set("table td th ul ol dl article section div main body html".split())
SKIP_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())
SKIP_NAMES = re.compile(
    r"(?!(?:has|with|no)[-_]|.*[-_]open$)"  # names of states
    r"(?:(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:ed|s)?|promo(?:s|tion)?|banner|cookies?|consent"
    r"|gdpr|notices?|pop-?up|modal|overlay|side-?bar|menus?|nav(?:bar|igation)?|bread-?crumbs?"
    r"|shar(?:e|ing)|social|related|recommended|comments?|disqus|respond|repl(?:y|ies)|footer"
    r"|site-?header|page-?header|masthead|subscribe|newsletter|pag(?:er|ination)|toolbar|widgets?"
    r"|search|login|skip-?link)(?:[-_].*)?|.*[-_](?:ads?|menu|nav|sidebar|footer|comments?|banner))"
)
# A list of these may outweigh the page's own text.
COMMENT_NAMES = re.compile(
    r"(?!(?:has|with|no)[-_]|.*[-_]open$)"
    r"(?:(?:comments?|disqus|respond|repl(?:y|ies))(?:[-_].*)?|.*[-_]comments?)"
)
KEEP = {"html", "body", "main", "article"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Page:
    """The text blocks of a page and the containers that hold them."""

    paths: list[str] = field(default_factory=list)  # of containers
    tags: list[str] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)  # -1: none
    blocks: list[str] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)  # characters outside links, or in a heading
    homes: list[tuple[int, ...]] = field(default_factory=list)
    bare: list[bool] = field(default_factory=list)  # in no element at all

    def held(self) -> list[int]:
        out = [0] * len(self.paths)
        for home, weight in zip(self.homes, self.weights):
            for c in home:
                out[c] += weight
        return out

    def vote(self) -> int | None:
        """The deepest container that holds most of the text, or an article or
        main element that holds over half, and around it what _climb adds.
        Only sectioning and div-like elements are voted for."""
        held, total = self.held(), sum(self.weights)
        if not total:
            return None
        best = None
        for c, own in enumerate(held):
            if not self._votable(c):
                continue
            semantic = self.tags[c] in ("article", "main")
            if own > total * SEMANTIC_SHARE if semantic else own >= total * SHARE:
                rank = (semantic, self.depths[c] if not semantic else 0, own, -c)
                if best is None or rank > best[0]:
                    best = (rank, c)
        return min(self._climb({best[1]}, held)) if best else None

    def _votable(self, c: int) -> bool:
        return self.tags[c] in VOTED or "-" in self.tags[c]  # or a custom element

    def _climb(self, chosen: set[int], held: list[int]) -> set[int]:
        """``chosen``, or the outermost container around all of them that adds
        mainly text outside links."""
        size = [0] * len(self.paths)
        for home, block in zip(self.homes, self.blocks):
            for c in home:
                size[c] += len(block)
        text, whole = sum(held[c] for c in chosen), sum(size[c] for c in chosen)
        first, *others = chosen
        around = self._around(first)
        for c in others:
            both = set(self._around(c))
            around = [a for a in around if a in both]
        for c in around:
            if self._votable(c) and 2 * (held[c] - text) > size[c] - whole:
                chosen, text, whole = {c}, held[c], size[c]
        return chosen

    def _around(self, c: int) -> list[int]:
        """The containers around one, innermost first."""
        out = []
        while (c := self.parents[c]) >= 0:
            out.append(c)
        return out

    def text(self, chosen: set[int]) -> str:
        """The blocks of the chosen containers, and the others that aren't
        mainly links; beside an article or main, none without any element."""
        semantic = any(self.tags[c] in ("article", "main") for c in chosen)
        return " ".join(
            block
            for block, weight, home, bare in zip(self.blocks, self.weights, self.homes, self.bare)
            if not chosen.isdisjoint(home) or 2 * weight > len(block) and not (bare and semantic)
        )

    def extract(self, winners: list[str]) -> str:
        """The text by the first winning path that holds most of the page's,
        or else by the page's own container."""
        held, total = self.held(), sum(self.weights)
        for path in winners:
            on = {c for c, p in enumerate(self.paths) if p == path}
            if on and total and sum(held[c] for c in on) >= SHARE * total:
                return self.text(self._climb(on, held))
        own = self.vote()
        return " ".join(self.blocks) if own is None else self.text({own})


def _attributes(source: str) -> dict[str, str]:
    return {
        m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(source)
    }


def _skipped(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in SKIP or tag == "header" and not inside:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in SKIP_ROLES:
        return True
    return False


def _named(tag: str, attributes: dict[str, str]) -> int:
    """Whether a class or id says that an element be skipped, unless it turns
    out to hold the page's text: 0 no, 1 yes, 2 as comments."""
    if tag in ("html", "body"):
        return 0
    names = attributes.get("class", "").lower().split() + attributes.get("id", "").lower().split()
    if any(COMMENT_NAMES.fullmatch(n) for n in names):
        own = any(re.match(r"comments?(?:[-_]|$)", n) for n in names)
        return 2 if own or tag not in KEEP else 0
    return int(tag not in KEEP and any(SKIP_NAMES.fullmatch(n) for n in names))


def _step(tag: str, attributes: dict[str, str]) -> str:
    """A path step: the tag and its classes without digits."""
    classes = {re.sub(r"\d+", "", c) for c in attributes.get("class", "").lower().split()}
    return ".".join([tag, *sorted(c for c in classes if c)])


def _after_raw(tag: str, html: str, at: int) -> int:
    """Where the page goes on behind an element without markup of its own."""
    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
    if tag == "svg":
        inner = _ENDS_SVG.search(html, at, end.start() if end else len(html))
        if inner and not (end and "<foreignobject" in html[at : end.start()].lower()):
            return inner.start() if end else at
    if end:
        return end.end()
    return len(html) if tag in UNENDED else at


def _has_end(tag: str, html: str, at: int) -> bool:
    """Whether an end tag comes before the next element of the kind."""
    m = re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).search(html, at)
    return bool(m and m[1])


class _Named:
    """The elements of a page whose names say that they be skipped. What they
    hold decides, so they are parsed and left out afterwards."""

    def __init__(self, page: Page):
        self.page = page
        self.kinds: list[int] = []
        self.inside: list[list[tuple[str, int]]] = []  # article and main elements around them
        self.within: list[tuple[int, ...]] = []  # of every block
        self.articles: list[tuple[str, int, tuple[int, ...]]] = []  # with those around them

    def open(self, kind: int, inside: list[tuple[str, int]]) -> int:
        self.kinds.append(kind)
        self.inside.append(inside)
        return len(self.kinds) - 1

    def _has_article(self, name: int) -> bool:
        """It holds a main element, or articles that aren't beside or below
        the page's own."""
        tags = {tag for tag, _, names in self.articles if name in names}
        if not tags or "main" in tags:
            return bool(tags)
        around = self.inside[name]
        if any(tag == "article" for tag, _ in around):
            return False
        mains = {c for _, c in around}
        return all(names or c in mains for _, c, names in self.articles)

    def leave_out(self) -> None:
        if not self.kinds:
            return
        page, total, held = self.page, 0, [0] * len(self.kinds)
        for names, weight in zip(self.within, page.weights):
            if not any(self.kinds[n] == 2 for n in names):
                total += weight
                for n in names:
                    held[n] += weight
        out = {
            n
            for n, kind in enumerate(self.kinds)
            if not (kind == 1 and 2 * held[n] > total) and not self._has_article(n)
        }
        keep = [out.isdisjoint(names) for names in self.within]
        for values in (page.blocks, page.weights, page.homes, page.bare):
            values[:] = [v for v, k in zip(values, keep) if k]


def parse(html: str) -> Page:
    """Read a page leniently: end tags may be missing or misplaced."""
    page = Page()
    # open elements: tag, whether it skips, container index or -1, and the
    # number of one that is named to be skipped, or -1
    stack: list[tuple[str, bool, int, int]] = []
    named = _Named(page)
    skips = links = 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        block = " ".join("".join(text).split())
        text.clear()
        if block:
            page.blocks.append(block)
            page.weights.append(max(0, len(block) - linked))
            page.homes.append(tuple(c for _, _, c, _ in stack if c >= 0))
            page.bare.append(not stack)
            named.within.append(tuple(n for _, _, _, n in stack if n >= 0))
        linked = 0

    def pop() -> None:
        nonlocal skips, links
        tag, skip, _, name = stack[-1]
        if tag not in INLINE or name >= 0:
            flush()
        stack.pop()
        skips -= skip
        links -= tag == "a"

    def close(names: set[str], scope: set[str]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                while len(stack) > at:
                    pop()
                return
            if stack[at][0] in scope:
                return

    def add(data: str) -> None:
        nonlocal linked
        if data and not skips:
            data = unescape(data)
            text.append(data)
            if links and not any(s[0] in HEADINGS for s in stack):
                linked += len(data.strip())

    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag == "br":
                flush()
            elif tag == "p":
                close({"p"}, SCOPE)
                flush()
            elif any(s[0] == tag for s in stack):
                close({tag}, set())
            continue
        if tag in ("br", "hr"):
            flush()
        if tag in VOID:
            continue
        closed = (m[3] or m[6] or "").endswith("/") and (tag == "svg" or tag in MATH)
        if tag in RAW:
            if not closed:
                at = _after_raw(tag, html, at)
            continue
        if closed or tag in ("select", "datalist") and not _has_end(tag, html, at):
            continue
        if tag in ENDS_OPTION and not any(s[0] in ("select", "datalist") for s in stack):
            close({"option", "optgroup"}, SCOPE)
        if tag in P_CLOSERS:
            close({"p"}, SCOPE)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE - CLOSES[tag])
        attributes = _attributes(m[3] or m[6] or "")
        skip = _skipped(tag, attributes, any(s[0] in ("article", "main") for s in stack))
        kind = 0 if skip or skips else _named(tag, attributes)
        if tag not in INLINE or skip or kind:
            flush()
        container = -1
        if tag not in INLINE and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li"):
            container = len(page.paths)
            parent = next((c for _, _, c, _ in reversed(stack) if c >= 0), -1)
            step = _step(tag, attributes)
            page.paths.append(f"{page.paths[parent]}>{step}" if parent >= 0 else step)
            page.tags.append(tag)
            page.depths.append(page.depths[parent] + 1 if parent >= 0 else 0)
            page.parents.append(parent)
        name = -1
        if kind:
            name = named.open(kind, [(t, c) for t, _, c, _ in stack if t in ("article", "main")])
        elif tag in ("article", "main") and not (skip or skips):
            named.articles.append((tag, container, tuple(n for _, _, _, n in stack if n >= 0)))
        stack.append((tag, skip, container, name))
        skips += skip
        links += tag == "a"
    flush()
    named.leave_out()
    return page


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "html"):
        hosts, paths, weights = [], [], []
        for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            page = parse(html or "")
            own = page.vote()
            if own is not None:
                hosts.append(host)
                paths.append(page.paths[own])
                weights.append(page.held()[own])
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(weights, pa.int64())],
            ["host", "path", "weight"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning paths of every host: host, paths (most votes first, then
    most text; at most 100 / WINNER_PERCENT). ``pages``: host, html."""
    votes = (
        pages.select("host", "html")
        .mapInArrow(_votes, "host string, path string, weight long")
        .groupBy("host", "path")
        .agg(F.count("*").alias("votes"), F.sum("weight").alias("weight"))
    )
    votes = stored(votes, "path-votes")
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(totals, "host").where(f"votes * 100 >= total * {WINNER_PERCENT}")
    order = F.sort_array(F.collect_list(F.struct(-F.col("votes"), -F.col("weight"), "path")))
    return won.groupBy("host").agg(order.alias("won")).select("host", F.col("won.path").alias("paths"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "html"):
        texts = [
            parse(html or "").extract(paths or [])
            for html, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(1),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html).

    Blocks in page order, joined by one blank: all of the winning containers,
    and the others that aren't mainly links (beside an article or main, text
    that no element holds is left out);
    white space within a block is one blank, character references are
    decoded. Left out, wherever they stand: navigation, footers, asides,
    forms, lists of choices, scripts, drawings, hidden parts, and elements whose class, id or role names a
    menu, notice, advert, comment list or the like; headers outside an
    article. An element so named stays if it holds over half of the page's text
    outside links and comments, a main element, or an article where no other
    stands outside. A page without a winning path that holds most of its text uses
    its own container, one without any all of its blocks. Null or empty html gives an empty text;
    pages without a host share the host ""; repeated rows each get a row;
    other columns are left out.

    Returns page_id, url, text, n_chars (code points).
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\w+://([^/?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    won = stored(host_paths(rows), "host-paths")
    side = broadcast_if_small(won)
    if side is won:  # many hosts: spread the pages of each over some tasks
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        side = won.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", salt).join(side, ["host", "_salt"], "left")
    else:
        joined = rows.join(side, "host", "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(
        _texts, "page_id long, url string, text string, n_chars long"
    )
