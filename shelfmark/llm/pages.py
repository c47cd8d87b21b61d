"""Main text of web pages by wrapper induction.

A page's DOM is folded into a skeleton: neighbouring siblings of one tag and class are one repeated
node, and each node keeps a hash of its text. Each host gives a few reference skeletons with
different texts (minima and maxima over hashes: a hot host is a partial aggregate). A page is aligned
with its host's references by simple tree matching; an aligned node whose text is the same in two
references, or in the only one, is template, a node whose text varies is a slot. The content is the varying slot that holds most text
outside links and outside parts that by tag or name are no article (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments); inside it everything else is kept.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from shelfmark.session import settle

# The parts of HTML that matter here, and names that sites give to parts outside an article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "audio", "video", "math"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "input", "label", "fieldset"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|dropdown|footer|header|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notification|pager|pagination|popup|promo|promotion|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|toolbar|topbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
REFERENCES = 6


class Node:
    __slots__ = ("children", "name", "outside", "tag")

    def __init__(self, tag: str, name: str = "", outside: bool = False):
        self.tag, self.name, self.outside = tag, name, outside
        self.children: list[Node | str] = []


class _Builder(HTMLParser):
    """A forgiving DOM: open elements are closed where HTML closes them, stray end tags are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and tag == "html":
            return
        if tag in BLOCKS:
            closing = CLOSES.get(tag, {"p"})
            for k in range(len(self.open) - 1, 0, -1):
                own = self.open[k].tag
                if own in closing:
                    del self.open[k:]
                    if own == tag or tag not in ("li", "dt", "dd", "tr", "td", "th"):
                        break
                elif own in ("ul", "ol", "dl", "table", "div", "article", "section", "td", "th", "li", "blockquote", "body", "main", "aside", "nav", "header", "footer", "form", "button"):
                    break
        found = dict(attrs)
        name = " ".join(x for x in (found.get("class"), found.get("id")) if x)
        hidden = "hidden" in found or (found.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style") or "", re.IGNORECASE)
        outside = tag in OUTSIDE or bool(hidden) or (found.get("role") or "").lower() in ROLES or (tag not in ("body", "article", "main", "html") and tag not in INLINE and bool(NAMES.search(name)))
        node = Node(tag, name, outside)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if tag in INLINE and self.open[k].tag in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def blocks(node: Node, out: list[str] | None = None, skip: set[int] | None = None) -> list[str]:
    """The texts of a node's blocks in page order, white space made single and trimmed."""
    parts: list[str] = []
    made: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            made.append(text)
        parts.clear()

    work: list[Node | str | None] = [node]
    while work:
        own = work.pop()
        if own is None:
            flush()
        elif isinstance(own, str):
            parts.append(own)
        elif own is not node and (own.outside or own.tag in HIDDEN or skip and id(own) in skip):
            if own.tag not in INLINE:
                flush()
        elif own.tag in ("br", "hr"):
            flush()
        else:
            block = own.tag not in INLINE
            if block:
                flush()
                work.append(None)
            work.extend(reversed(own.children))
    flush()
    return made


class Fold:
    """A skeleton node: one element, or neighbouring ones of the same tag and class; ``mass`` is its text outside links and outside parts."""

    __slots__ = ("children", "label", "mass", "members", "text")

    def __init__(self, label: str, members: list[Node]):
        self.label, self.members = label, members
        self.children: list[Fold] = []
        self.text, self.mass = 0, 0


def _label(node: Node) -> str:
    return node.tag + "." + re.sub(r"\d+", "#", node.name)


def fold(members: list[Node], depth: int = 0) -> Fold:
    """Repeated siblings become one node, whose children are those of all its members folded together."""
    made = Fold(_label(members[0]), members)
    inner: list[Node] = []
    for member in members:
        for child in member.children:
            if isinstance(child, str):
                words = child.split()
                made.text = zlib.crc32(" ".join(words).encode(), made.text) if words else made.text
                made.mass += sum(map(len, words)) if member.tag != "a" else 0
            elif child.tag not in HIDDEN:
                inner.append(child)
    groups: list[list[Node]] = []
    for child in inner:
        if groups and _label(groups[-1][0]) == _label(child) and groups[-1][0].outside == child.outside:
            groups[-1].append(child)
        else:
            groups.append([child])
    if len(members) > 1 or depth > 40:  # inside a repeated or very deep node only the kinds of children count
        by: dict[tuple[str, bool], list[Node]] = {}
        for child in inner:
            by.setdefault((_label(child), child.outside), []).append(child)
        groups = list(by.values())
    if depth > 60:
        groups = []
        for child in inner:
            own = " ".join(blocks(child))
            made.text, made.mass = zlib.crc32(own.encode(), made.text), made.mass + len(own)
    for group in groups:
        child = fold(group, depth + 1)
        made.children.append(child)
        made.text = zlib.crc32(f"{child.label}{child.text}".encode(), made.text)
        if not group[0].outside and group[0].tag != "a":
            made.mass += child.mass
    return made


def skeleton(root: Fold) -> list:
    return [root.label, root.text, [skeleton(c) for c in root.children]]


def match(a: Fold, b: list) -> tuple[int, list[tuple[Fold, list]]]:
    """Simple tree matching: the size of the largest order-keeping alignment of two trees, and its pairs."""
    if a.label != b[0]:
        return 0, []
    n, m = len(a.children), len(b[2])
    best = [[0] * (m + 1) for _ in range(n + 1)]
    pairs: dict[tuple[int, int], list] = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            size, found = match(a.children[i - 1], b[2][j - 1])
            pairs[i, j] = found
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + size)
    out, i, j = [(a, b)], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out += pairs[i, j]
            i, j = i - 1, j - 1
    return best[n][m] + 1, out


def extract(root: Node, references: list[list]) -> str:
    """The main text of a page, given its host's reference skeletons."""
    tree = fold([root])
    same: dict[int, int] = {}
    others = [r for r in references if r[1] != tree.text]
    for reference in others:
        for own, other in match(tree, reference)[1]:
            same[id(own)] = same.get(id(own), 0) + (own.text == other[1])
    needed = min(2, len(others))
    template = {k for k, n in same.items() if needed and n >= needed}

    def varying(node: Fold) -> int:
        """Text outside links, outside parts and template."""
        if id(node) in template or node.members[0].outside or node.members[0].tag == "a":
            return 0
        return node.mass - sum(c.mass for c in node.children if not c.members[0].outside and c.members[0].tag != "a") + sum(map(varying, node.children))

    def choose(node: Fold) -> Fold:
        named = [x for x in _walk(node) if x.members[0].tag in ("article", "main") and varying(x)]
        if named:
            node = max(named, key=lambda x: (varying(x), x.members[0].tag == "article"))
            inner = [x for x in named if x is not node and x.members[0].tag == "article" and x in _walk(node)]
            return max(inner, key=varying) if inner and 10 * varying(inner[0]) >= 9 * varying(node) else node
        while True:
            total = varying(node)
            child = max(node.children, key=varying, default=None)
            if child is None or 10 * varying(child) < 9 * total or child.members[0].tag in INLINE or child.members[0].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote"):
                return node
            node = child

    if not tree.mass:
        return ""
    if not varying(tree):
        template.clear()  # every text of the page recurs: tell its parts by tag and name alone
    slot = choose(tree)
    return " ".join(x for member in slot.members for x in blocks(member))


def _walk(node: Fold) -> list[Fold]:
    return [node, *(x for c in node.children for x in _walk(c))]


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def skeletons(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, turn, skeleton) of each page."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(skeleton(fold([parse(h)])), separators=(",", ":")) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array(made, pa.string())], names=["host", "skeleton"])

    rows = pages.where(F.col(html_col).isNotNull()).select(F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInArrow(make, "host string, skeleton string")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", references: int = REFERENCES) -> DataFrame:
    """(host, references): up to ``references`` skeletons of a host's pages, of different texts."""
    found = skeletons(pages, url_col, html_col)
    turns = [F.struct(F.xxhash64("skeleton", F.lit(k)).alias("turn"), "skeleton") for k in range((references + 1) // 2)]
    picks = [f(t)["skeleton"] for t in turns for f in (F.min, F.max)]
    return found.groupBy("host").agg(F.array_sort(F.array_distinct(F.array(*picks[:references]))).alias("references"))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", references: int = REFERENCES) -> DataFrame:
    """All columns of ``pages`` with text and n_chars (code points).

    The text joins the blocks of the article by one space; it is empty for a null or empty page and
    where nothing is content. Pages without a host in their url form one host. Pages that repeat each
    other are no references for each other. Columns of ``pages`` named text or n_chars are replaced.
    """
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    known = wrappers(pages, url_col, html_col, references).withColumnRenamed("host", "__host").withColumnRenamed("references", "__references")
    known = settle(known, "wrappers")  # so that Spark can split a hot host's join, or broadcast a few hosts
    kept = pages.select(*columns).withColumn("__own", F.coalesce(host_of(F.col(url_col)), F.lit("")))
    joined = kept.join(known, kept["__own"] == known["__host"], "left").select(*[kept[c] for c in columns], "__references")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, found in zip(batch[html_col].to_pylist(), batch["__references"].to_pylist()):
                texts.append(extract(parse(html), [json.loads(x) for x in found or []]) if html else "")
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(texts, pa.string())], names=[*columns, "text"])

    out = joined.mapInArrow(make, T.StructType([*(T.StructField(f.name, f.dataType) for f in pages.select(*columns).schema), T.StructField("text", T.StringType())]))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
