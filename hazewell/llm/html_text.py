"""Main text of web pages: what a page's own elements name as noise goes, and what a site style tree finds empty of content.

The style tree merges the element trees of all pages of a host. A node is a path of elements (tag and classes). Over the
pages that have it, its presentation importance is the entropy of its child sequences, and its content importance is one
less the mean entropy of the block texts below it: a text found on all pages has entropy 1, on one page 0. Nodes whose
combined importance is low are removed from each page.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazewell.llm.common import free_name, small
from hazewell.llm.url_filter import url_host
from hazewell.session import stored

#: Pages of different main text that a node must be seen on: on fewer there is nothing to compare.
MIN_PAGES = 2
#: Few pages prove little: contents are weighed as if so many further pages without a node's texts had been seen. With the
#: first number a text must be on all of three pages, or nearly all of many, to be removed; nodes that are low with the
#: second one too are surely template (all of 12 pages, or nearly all of 20).
UNSEEN, UNSEEN_SURE = 0.25, 4.0
#: Nodes of at most this importance are removed.
THRESHOLD = 0.1
#: Weight of what is below a node, a child sequence.
GAMMA = 0.9

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOISE_TAGS = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "fieldset", "label", "menu", "dialog", "input"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br",
}
#: Words of a class, id or role that name noise.
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
    "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus",
    "respond", "reply", "replies", "widget", "toolbar", "pager", "pagination", "skip", "alert", "complementary", "contentinfo", "search", "form", "hidden", "copyright",
}
#: Their beginnings, where a name runs on (``commentlist``).
NOISE_STARTS = ("comment", "sidebar", "advert", "adsby", "cookie", "newsletter", "breadcrumb", "footer", "navbar", "navigation", "sponsor", "popup", "disqus")
#: Names that begin or end so tell what an element has or how it is, not what it is (``has-sidebar``, ``comments-open``).
HAVING = {"has", "have", "with", "without", "no", "not", "is", "show", "shows", "hide", "hides", "allow", "allows"}
STATES = {"open", "closed", "enabled", "disabled", "on", "off", "active", "inactive", "allowed", "loaded", "visible", "count", "ready"}
#: Text of a block from so many characters on is prose.
PROSE = 40
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<[!?/a-zA-Z][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    path: str
    text: str
    noise: bool
    article: bool


class _Node:
    __slots__ = ("tag", "sign", "path", "parent", "noise", "soft", "article", "kids", "protected")

    def __init__(self, tag: str, sign: str, parent, noise: bool, soft: bool, article: bool):
        self.tag, self.sign, self.parent, self.noise, self.soft, self.article = tag, sign, parent, noise, soft, article
        self.path = f"{parent.path}>{sign}" if parent else sign
        self.kids: list[str] = []
        self.protected = False


def _element(tag: str, attributes: str, parent) -> _Node:
    words: set[str] = set()
    sign = tag
    hidden = False
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name == "hidden" or name == "aria-hidden":
                hidden |= name == "hidden" and value.lower() not in ("false", "until-found")
            else:
                for one in value.split():
                    own = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()) if w]
                    if len(own) < 2 or own[0] not in HAVING and own[-1] not in STATES:
                        words.update(own)
                if name == "class":
                    sign += "".join(f".{c}" for c in sorted(set(value.split()))[:6])
    inside = parent.article if parent else False
    noise = tag in NOISE_TAGS or hidden or (tag == "header" and not inside)
    named = not NOISE_WORDS.isdisjoint(words) or any(w.startswith(NOISE_STARTS) for w in words) or ("header" in words and not inside)
    soft = named and tag not in ("html", "body", "main")
    return _Node(tag, sign, parent, noise or (parent.noise if parent else False), soft, inside or tag in ("article", "main") or "role=main" in attributes.replace('"', ""))


def parse(page: str) -> tuple[list[Block], set[tuple[str, str]]]:
    """Blocks of a page in order, and its (path, child sequence) pairs. A block is the text between two block-level tags."""
    root = _Node("", "", None, False, False, False)
    node, at, parts = root, 0, []
    found: list[tuple[_Node, str]] = []
    nodes: list[_Node] = [root]

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                found.append((node, text))

    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        block = tag not in INLINE
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            if not block:
                continue
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![\w-])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or not block:
            continue
        if node.tag == "p" or tag in CLOSES:
            shut, stop = CLOSES.get(tag, (set(), set()))
            if node.tag == "p":
                node = node.parent
            up = node
            while up is not root and up.tag not in stop:
                if up.tag in shut:
                    node = up.parent
                up = up.parent
        new = _element(tag, m[3], node if node is not root else None)
        if new.parent is None:
            new.parent = root
        node.kids.append(new.sign)
        nodes.append(new)
        node = new
        if tag in ("article", "main") and not new.soft and not new.noise:
            up = node.parent
            while up is not root and not up.protected:
                up.protected = True
                up = up.parent
    if at < len(page):
        parts.append(page[at:].rsplit("<", 1)[0] if re.search(r"<[a-zA-Z/!][^<>]*\Z", page[at:]) else page[at:])
    flush()
    bad: dict[int, bool] = {id(root): False}
    for n in nodes[1:]:
        bad[id(n)] = n.noise or bad[id(n.parent)] or (n.soft and not n.protected)
    for n in _spared(found, nodes[1:], bad):
        n.soft = False
        for x in nodes[1:]:
            bad[id(x)] = x.noise or bad[id(x.parent)] or (x.soft and not x.protected)
    blocks = [Block(n.path, text, bad[id(n)], n.article) for n, text in found]
    return blocks, {(n.path, ",".join(dict.fromkeys(n.kids))) for n in nodes[1:]}


def _spared(found: list[tuple[_Node, str]], nodes: list[_Node], bad: dict[int, bool]) -> Iterator[_Node]:
    """Elements that only a name makes noise, but that hold over half of the page's prose outside of other noise, outermost
    first. Where an article or main element has clean prose, the page has its text already, and none is spared."""
    if any(n.article and not bad[id(n)] and len(text) >= PROSE for n, text in found):
        return
    below: dict[int, int] = {}
    total = 0
    for n, text in found:
        if n.noise or len(text) < PROSE:
            continue
        total += len(text)
        while n is not None:
            below[id(n)] = below.get(id(n), 0) + len(text)
            n = n.parent
    for n in nodes:
        if n.soft and not n.protected and 2 * below.get(id(n), 0) > total:
            yield n


def main_blocks(blocks: list[Block]) -> list[Block]:
    """Without noise. What stands outside of article and main elements is left to the style tree."""
    return [b for b in blocks if not b.noise]


def _outside(blocks: list[Block], low: set[str]) -> list[Block]:
    return [b for b in blocks if not any(b.path == p or b.path.startswith(f"{p}>") for p in low)] if low else blocks


def without(blocks: list[Block], low: set[str], sure: set[str] = frozenset()) -> list[Block]:
    """The blocks that no low-importance node holds. Nodes that are surely template go whatever they hold; what few pages
    speak against goes unless it is over half of the remaining text. A page that would keep nothing keeps its blocks."""
    own = _outside(blocks, sure) or blocks
    left = _outside(own, low)
    return left if 2 * sum(len(b.text) for b in left) >= sum(len(b.text) for b in own) else own


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def low_importance(pages: DataFrame, host: str = "host", html: str = "html", min_pages: int = MIN_PAGES, threshold: float = THRESHOLD, gamma: float = GAMMA) -> DataFrame:
    """The style tree's nodes of low importance: host, path, and sure: whether they are low by the larger number of unseen pages too.

    Pages of a host with the same main text count once, so copies of an article don't make it look like a template.
    Counts are combined before each shuffle; a host with a third of all pages is split over (path, text) keys.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, page in zip(batch["h"], batch["page"]):
                blocks, styles = parse(page)
                main = main_blocks(blocks)
                if main:
                    # text of the main region alone can be told from noise only here, so only its nodes are weighed
                    texts = list({(b.path, _number(b.text)) for b in main})
                    paths = {p for p, _ in texts}
                    shown = [(p, _number(s)) for p, s in styles if any(q == p or q.startswith(f"{p}>") for q in paths)]
                    rows.append((h, _number("\n".join(b.text for b in main)), [{"path": p, "x": x, "style": False} for p, x in texts] + [{"path": p, "x": x, "style": True} for p, x in shown]))
            yield pd.DataFrame(rows, columns=["h", "print", "f"])

    pages = pages.select(F.coalesce(F.col(host), F.lit("")).alias("h"), F.coalesce(F.col(html), F.lit("")).alias("page"))
    seen = pages.mapInPandas(features, "h string, print long, f array<struct<path: string, x: long, style: boolean>>").dropDuplicates(["h", "print"])
    counts = seen.select("h", F.explode("f").alias("f")).select("h", "f.*").groupBy("h", "path", "x", "style").agg(F.count("*").alias("n"))
    counts = stored(
        counts.groupBy("h", "path").agg(
            F.sum(F.when(F.col("style"), F.col("n"))).alias("m"),
            F.sum(F.when(F.col("style"), F.col("n") * F.log("n"))).alias("style_nlogn"),
            F.sum(F.col("style").cast("int")).alias("styles"),
            F.sum((~F.col("style")).cast("int")).alias("texts"),
            F.sum(F.when(~F.col("style"), F.log("n"))).alias("text_logn"),
        ),
        "style-tree",
    )
    parts = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ">"))
    below = counts.filter("texts > 0").select("h", F.explode(above).alias("path"), "texts", "text_logn").groupBy("h", "path").agg(F.sum("texts").alias("texts"), F.sum("text_logn").alias("text_logn"))
    tree = counts.filter("m IS NOT NULL").select("h", "path", "m", "style_nlogn", "styles").join(below, ["h", "path"]).filter(F.col("m") >= max(2, min_pages))
    shown = (F.log("m") - F.col("style_nlogn") / F.col("m")) / F.log("m")
    content = lambda unseen: F.lit(1.0) - F.col("text_logn") / F.col("texts") / F.log(F.col("m") + F.lit(unseen))
    weight = F.pow(F.lit(gamma), F.col("styles"))
    low = lambda unseen: (F.lit(1.0) - weight) * shown + weight * content(unseen) <= threshold
    return tree.filter(low(UNSEEN)).select(F.col("h").alias("host"), "path", low(UNSEEN_SURE).alias("sure"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", **tree) -> DataFrame:
    """Add ``text``, the main text of each page's whole html, and ``n_chars``, its code points (columns of those names give way).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one line feed in
    page order. Null or empty html gives an empty text and 0. A null url, or one without a host, belongs to the host "".
    Rows are neither dropped nor merged; an empty table gives an empty one.
    """
    rows = pages.drop("text", "n_chars")
    host, low, sure, out = (free_name(rows, f"site_{c}") for c in ("host", "low", "sure", "text"))
    rows = rows.withColumn(host, url_host(F.col(url)))
    paths = lambda c: F.sort_array(F.collect_set(c))
    nodes = low_importance(rows, host, html, **tree).groupBy("host").agg(paths("path").alias(low), paths(F.when(F.col("sure"), F.col("path"))).alias(sure))  # bounded by a site's template
    nodes = stored(nodes.withColumnRenamed("host", host), "low-nodes")
    rows = rows.join(small(nodes, 10_000), host, "left")

    @F.pandas_udf("string")
    def main_text(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        some = lambda paths: set(paths) if paths is not None else set()
        for page, removed, surely in columns:
            yield pd.Series(["\n".join(b.text for b in without(main_blocks(parse(p or "")[0]), some(r), some(y))) for p, r, y in zip(page, removed, surely)], dtype=object)

    rows = rows.withColumn(out, main_text(F.coalesce(F.col(html), F.lit("")), F.col(low), F.col(sure)))
    return rows.select(*[c for c in rows.columns if c not in (host, low, sure, out)], F.col(out).alias("text"), F.length(out).cast("long").alias("n_chars"))
