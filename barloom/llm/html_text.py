"""Main texts of web pages, with site style trees.

Pages of one host share a layout. Their element trees are merged by element path (tag,
class and id of each step). A path's content is judged by how its texts repeat: a text
on n of the m pages that have the path has entropy log_m n, so the mean of 1 - log_m n
is near 1 for articles and falls for menus and adverts. Its presentation is judged by
the entropy of the child sequences seen there. Paths of low importance are removed
from every page of the host.

The tree needs several pages and says little where all pages are copies. So pages of a
host whose article (or else whole text) is equal count once, and what a page declares
is a prior that the tree corrects:

*   Elements that are page parts by tag, role or ``hidden`` are always removed.
*   Elements with a class or id that is, as a whole, the name of a page part are removed
    unless the tree finds their texts important, or they hold an article.
*   Inside an article (``article``, ``main``) a path must be of lower importance to be
    removed, and none is where most of the article repeats (near copies of one text).
*   What lies outside the articles is removed, unless the tree leaves more text there
    than in them (cards that announce other pages).

Counting is one pass over the pages that shuffles only hashes, combined per host and
path in each task; a hot host is a few thousand counts. The second pass needs the low
paths of each host: they are broadcast up to ``MAX_BROADCAST_PATHS`` rows and joined
by host beyond. Page texts are never shuffled in the first case.

Nulls and the like: null or empty html gives an empty text, a null url the host "".
Unclosed or misnested tags close with their parents. Equal pages give equal texts.
Added columns replace columns of the same name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.scratch import stored

MIN_PAGES = 8  # pages of a host that must have a path before it can be called low
MIN_IMPORTANCE = 0.6
ARTICLE_IMPORTANCE = 0.3  # the same inside an article
MIN_VARIED = 0.5  # below it, an article's texts repeat so much that the tree says nothing of it
CONTENT_WEIGHT = 0.9
MAX_BROADCAST_PATHS = 200_000

#: Fixed names of HTML and of common page parts.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_DROPPED_TAGS = frozenset(
    "head script style noscript template iframe textarea title nav footer aside form button select "
    "dialog menu svg canvas object audio video search".split()
)
_DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
_DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted "
    "banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription paywall sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "masthead comment comments commentlist disqus replies respond share sharing social related "
    "recommended widget toolbar pagination pager login signup skip "
    "ad-slot ad-banner ad-container adsbygoogle cookie-notice cookie-banner cookie-consent main-nav "
    "site-nav nav-menu side-bar site-footer page-footer comments-section comment-list share-buttons "
    "social-links social-share related-posts related-articles newsletter-signup skip-link".split()
)
_OUTER_NAMES = frozenset("header topbar site-header page-header".split())  # page parts, unless inside the article
_CLOSES = {  # an opening tag closes these when they are open
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
_LIST_ENDS = frozenset("ul ol dl table menu select article body".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Named:
    """An element that bears the name of a page part."""

    path: str
    inside: bool  # of an article tag
    holds: bool = False  # an article, so that it is no page part


@dataclass
class Element:
    tag: str
    path: str
    dropped: bool
    root: str | None  # path of the outermost article or main it is in
    children: list[str]
    named: tuple[Named, ...] = ()


@dataclass(frozen=True)
class Block:
    path: str
    text: str
    dropped: bool
    root: str | None
    named: tuple[Named, ...]

    def paths(self) -> set[int]:
        """Hashes of what the tree counts this block for."""
        return {*_branches(self.path), *(_hash(n.path) for n in self.named), *([_hash(self.root)] if self.root is not None else [])}


def _names(attributes: dict[str, str]) -> list[str]:
    return re.findall(r"[a-z0-9]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())


def _is_dropped(tag: str, attributes: dict[str, str], declared: bool) -> bool:
    if tag in _DROPPED_TAGS or (tag == "header" and not declared):
        return True
    if tag in ("body", "html", "main"):
        return False
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or "display:none" in style:
        return True
    return attributes.get("role", "").lower() in _DROPPED_ROLES


def _is_named(tag: str, attributes: dict[str, str], declared: bool) -> bool:
    """Whether a whole class name or the id is that of a page part."""
    if tag in ("body", "html"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return any(n in _DROPPED_NAMES or (n in _OUTER_NAMES and not declared) for n in names)


class Page:
    """The text blocks of a page in order, and its elements with their child tags."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.styles: list[tuple[str, str]] = []
        self.open = [Element("", "", False, None, [])]
        self._words: list[str] = []
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while (m := _TAG.search(source, at)) is not None:
            self._text(source[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                self._end(name)
                continue
            rest = m["rest"] or m["rest2"] or ""
            self._start(name, rest)
            if name in _RAW and not rest.endswith("/"):
                closing = re.compile(f"</{name}", re.I).search(source, at)
                at = closing.start() if closing else len(source)
        self._text(source[at:])
        self._flush()
        self._close(1)

    def _text(self, text: str) -> None:
        if text:
            self._words.append(html.unescape(text))

    def _flush(self) -> None:
        text = " ".join("".join(self._words).split())
        self._words.clear()
        if text:
            top = self.open[-1]
            self.blocks.append(Block(top.path, text, top.dropped, top.root, top.named))

    def _start(self, tag: str, rest: str) -> None:
        if tag in _BLOCK:
            self._flush()
            if tag != "body":
                self._close_open(("p",), _LIST_ENDS - {"body"} | {"div", "section", "li", "td"})
        if tag == "br":
            self._words.append(" ")
        for_names = _CLOSES.get(tag)
        if for_names:
            self._close_open(for_names, _LIST_ENDS if tag != "body" else frozenset())
        parent = self.open[-1]
        if tag in _VOID or rest.endswith("/") and tag not in _BLOCK | _RAW:
            return
        if tag not in _BLOCK and tag not in _DROPPED_TAGS and "=" not in rest:
            self.open.append(Element(tag, parent.path, parent.dropped, parent.root, [], parent.named))
            return
        attributes = {
            k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)
        } if rest else {}
        inside = parent.root is not None
        dropped = parent.dropped or _is_dropped(tag, attributes, inside)
        article = not dropped and (tag in ("article", "main") or attributes.get("role") in ("main", "article"))
        # Articles inside an article are its comments and the like.
        nested = any(e.tag == "article" for e in self.open)
        is_named = not dropped and (nested or not article) and _is_named(tag, attributes, inside)
        if dropped and not parent.dropped or is_named:
            self._flush()
        label = ".".join([tag, *_names(attributes)])
        parent.children.append(label)
        path = f"{parent.path}>{label}" if tag in _BLOCK or dropped or is_named else parent.path
        if article:
            for outer in parent.named:
                outer.holds = outer.holds or not outer.inside
        named = (*parent.named, Named(path, nested)) if is_named else parent.named
        root = None if dropped else path if article and not inside else parent.root
        self.open.append(Element(tag, path, dropped, root, [], named))

    def _close_open(self, tags: tuple[str, ...], until: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._flush()
                self._close(i)
                return
            if self.open[i].tag in until:
                return

    def _end(self, tag: str) -> None:
        if tag == "p" and not any(e.tag == "p" for e in self.open):
            self._flush()
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                if tag in _BLOCK or any(e.tag in _BLOCK for e in self.open[i:]) or self.open[i].dropped or self.open[i].named:
                    self._flush()
                self._close(i)
                return

    def _close(self, i: int) -> None:
        for element in self.open[i:]:
            if element.tag in _BLOCK and not element.dropped:
                self.styles.append((element.path, ",".join(element.children)))
        del self.open[i:]

    def key(self) -> int:
        """Equal for pages with an equal article, or without one an equal text."""
        left = [b for b in self.blocks if not b.dropped]
        article = [b for b in left if b.root is not None]
        return _hash("\n".join(b.text for b in article or left))

    def main_text(
        self,
        low: frozenset[int],
        lower: frozenset[int] = frozenset(),
        copied: frozenset[int] = frozenset(),
        important: frozenset[int] = frozenset(),
    ) -> str:
        """The blocks that are left: of the articles, or also of what is around them.

        ``low`` paths are removed outside articles, ``lower`` ones inside, unless the
        article is ``copied``; elements named as page parts stay if they are ``important``.
        """
        articles, around, parts = [], [], []
        for i, b in enumerate(self.blocks):
            refuted = [n for n in b.named if not n.holds]
            if b.dropped or any(_hash(n.path) not in important for n in refuted):
                continue
            if b.root is None:
                if low.isdisjoint(_branches(b.path)):
                    (parts if refuted else around).append(i)
            elif not lower or _hash(b.root) in copied or lower.isdisjoint(_branches(b.path, b.root)):
                articles.append(i)
        size = [sum(len(self.blocks[i].text) for i in part) for part in (articles, around)]
        if not articles:
            left = sorted(around + parts)
        else:
            left = articles if size[0] >= size[1] else sorted(articles + around)
        return "\n\n".join(self.blocks[i].text for i in left)


def _branches(path: str, root: str | None = None) -> list[int]:
    """Hashes of a path and of the paths above it, from the second step on or below ``root``."""
    steps = path.split(">")
    first = min(4, len(steps)) if root is None else root.count(">") + 2
    return [_hash(">".join(steps[:i])) for i in range(first, len(steps) + 1)]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def host(url: str | Column = "url") -> Column:
    url = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


# What a counted row is: a page that has the path, a text there, a child sequence there,
# a page where the path is an article, a page where it bears the name of a page part.
_PAGE, _TEXT, _STYLE, _ARTICLE, _NAMED = range(5)


def style_tree(pages: DataFrame) -> DataFrame:
    """``host``, ``path``, the number of ``pages`` with it, and its ``importance``.

    ``varied`` is what the importance would be if each text counted as often as it is
    there; ``article`` and ``named`` say whether the path is an article or bears a name
    of a page part. Pages of a host with equal keys count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, counted = [], []
            for name, source in zip(batch.column(0), batch.column(1)):
                page, found = Page(source.as_py() or ""), set()
                key = page.key()
                for block in page.blocks:
                    if block.dropped:
                        continue
                    text = _hash(block.text)
                    for path in block.paths():
                        found |= {(path, _PAGE, 0, key), (path, _TEXT, text, key)}
                    if block.root is not None:
                        found.add((_hash(block.root), _ARTICLE, 0, key))
                    found |= {(_hash(n.path), _NAMED, 0, key) for n in block.named}
                for path, children in page.styles:
                    found.add((_hash(path), _STYLE, _hash(children), key))
                hosts += [name.as_py()] * len(found)
                counted += found
            rows = np.array(counted, np.int64).reshape(len(counted), 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), *(pa.array(rows[:, i]) for i in range(4))],
                ["host", "path", "kind", "feature", "key"],
            )

    rows = pages.select(host().alias("host"), "html").mapInArrow(
        run, "host string, path long, kind long, feature long, key long"
    )
    counts = rows.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    n, kind = F.col("n"), F.col("kind")
    sums = counts.groupBy("host", "path").agg(
        F.max(F.when(kind == _PAGE, n)).alias("pages"),
        F.avg(F.when(kind == _TEXT, F.log(n))).alias("text_entropy"),
        (F.sum(F.when(kind == _TEXT, n * F.log(n))) / F.sum(F.when(kind == _TEXT, n))).alias("weighed"),
        F.max(kind == _ARTICLE).alias("article"),
        F.max(kind == _NAMED).alias("named"),
        F.sum(F.when(kind == _STYLE, n)).alias("styled"),
        F.sum(F.when(kind == _STYLE, n * F.log(n))).alias("style_sum"),
    )
    base = F.log("pages")
    content = F.greatest(F.lit(0.0), 1 - F.col("text_entropy") / base)
    shape = F.coalesce((F.log("styled") - F.col("style_sum") / F.col("styled")) / base, F.lit(0.0))
    importance = F.when(
        F.col("pages") > 1, CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * F.least(shape, F.lit(1.0))
    ).otherwise(1.0)
    varied = F.when(F.col("pages") > 1, 1 - F.col("weighed") / base).otherwise(1.0)
    return sums.where("pages is not null").select(
        "host", "path", "pages", importance.alias("importance"), varied.alias("varied"), "article", "named"
    )


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with the main ``text`` of their ``html`` and its length ``n_chars``."""
    importance = F.col("importance")
    verdicts = {
        "low": importance < MIN_IMPORTANCE,
        "lower": importance < ARTICLE_IMPORTANCE,
        "copied": F.col("article") & (F.col("varied") < MIN_VARIED),
        "important": F.col("named") & (importance >= MIN_IMPORTANCE),
    }
    names = tuple(verdicts)
    said = F.struct(*[F.collect_list(F.when(v, F.col("path"))).alias(k) for k, v in verdicts.items()])
    some = verdicts["low"] | verdicts["copied"] | verdicts["important"]
    low = stored(
        style_tree(pages).where((F.col("pages") >= MIN_PAGES) & some).groupBy("host").agg(said.alias("_low")),
        "style-tree",
    )
    paths = low.agg(F.sum(sum((F.size(f"_low.{k}") for k in verdicts), F.lit(0)))).first()[0] or 0
    rest = [c for c in pages.columns if c not in ("text", "n_chars", "_low", "_host")]

    @F.arrow_udf("string")
    def main_text(sources: pa.Array, low_paths: pa.Array) -> pa.Array:
        texts = []
        for source, paths in zip(sources, low_paths):
            said = paths.as_py() or dict.fromkeys(names, ())
            texts.append(Page(source.as_py() or "").main_text(*(frozenset(said[k]) for k in names)))
        return pa.array(texts, pa.string())

    side = low.withColumnRenamed("host", "_host")
    joined = pages.select(*rest, host().alias("_host")).join(
        F.broadcast(side) if paths <= MAX_BROADCAST_PATHS else side, "_host", "left"
    )
    return joined.select(*rest, main_text("html", "_low").alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
