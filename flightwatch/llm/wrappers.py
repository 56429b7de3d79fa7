"""Main text of web pages by wrappers learned from pages of the same host.

A few pages of each host are parsed into trees and aligned by simple tree matching: two trees match if
their roots agree, and the best order-preserving matching of their children is found by dynamic
programming. Aligned nodes whose text never changes belong to the template; nodes whose text varies are
slots. The wrapper of a host is its template texts by place, and the place that holds the varying text.
Extraction is one pass over a page: text in that place, outside menus, forms and the like, and not known
as template.
"""

from __future__ import annotations

import html as entities
import json
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.llm.registry import query
from flightwatch.llm.tables import arrow_schema, settled, slices, table

#: Pages of a host that are looked at, and used after copies are left out; larger pages are not used to learn.
SAMPLED, USED, SAMPLE_CHARS, SAMPLE_NODES = 16, 8, 200_000, 1500
#: Aligned pages from which text that never changes counts as template.
STEADY = 5
#: Wrappers of up to so many bytes in all are broadcast; more are joined by host.
BROADCAST_BYTES = 16 << 20

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main "
               "menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
HOLDERS = set("ul ol dl table tbody thead select body article section div".split())
CONTAINERS = set("article main section div body td".split())
APART = set("nav header footer aside form script style noscript template button select option textarea iframe svg canvas "
            "object dialog menu title head audio video math".split())
APART_NAMES = set("ad ads adv advert advertisement advertising sponsor sponsored banner cookie cookies consent gdpr popup modal "
                  "overlay promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment "
                  "comments reply replies respond disqus discussion share sharing social related recommended newsletter "
                  "subscribe subscription signup login notice notices alert widget pagination pager toolbar skip".split())
#: These names also hold where an article begins inside; elements of the text itself are never judged by their name.
READERS = set("comment comments reply replies respond disqus discussion".split())
TEXT = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption td th tr tbody thead table body html".split())
APART_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>"
    r"|<[!?/][^>]*>|([^<]+)|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)", re.I)


#: How an element is set apart: not, by the name of its class or id, by a name that means readers' words, by its role.
OPEN, NAMED, READ, CLOSED = range(4)


def _look(tag: str, attributes: str) -> tuple[str, int]:
    """The class of an element and how its attributes set it apart from the text. Only whole names count."""
    if not attributes.strip(" /\n\t"):
        return "", OPEN
    name, apart = "", OPEN
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class":
            name = " ".join(value.split())
        if key in ("class", "id"):
            if tag not in TEXT and tag not in INLINE:
                names = set(value.split())
                apart = max(apart, OPEN if APART_NAMES.isdisjoint(names) else NAMED if READERS.isdisjoint(names) else READ)
        elif (key == "role" and value in APART_ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (
                key == "style" and re.search(r"display\s*:\s*none", value)):
            apart = CLOSED
    return name, apart


def step(path: int, key: str) -> int:
    """The path of a child: a hash, so that paths cost the same however deep they are."""
    return xxhash.xxh64_intdigest(key, path)


class Element:
    """``path`` is a hash of the keys from the root; ``block`` the nearest element that is not inline, itself included;
    ``inside`` tells whether it lies in the wrapper's place, ``article`` in an article."""

    __slots__ = ("apart", "article", "block", "children", "inside", "key", "link", "path", "tag", "texts")

    def __init__(self, tag: str, key: str, path: int, apart: int, link: bool, up: Element | None = None):
        self.tag, self.key, self.path, self.apart, self.link = tag, key, path, apart, link
        self.inside = up is not None and up.inside
        self.article = tag in ("article", "main") or (up is not None and up.article)
        self.block = up.block if up is not None and tag in INLINE else self
        self.children: list[Element] = []
        self.texts: list[str] = []


def read_page(html: str, tree: bool = False, place: int | None = None):
    """The blocks of a page in order, each ``(element, text, share of it in links)``; with ``tree`` also its root.

    A block is the text between two tags that are not inline. Missing end tags are supplied as browsers do for
    paragraphs, list items and table cells; a page that breaks off is read as far as it goes. Work and memory grow
    with the page's length alone, however deep it nests. At ``place`` (the path of the wrapper's place), and where
    an article begins, names of the elements around no longer set apart.
    """
    root = Element("", "", 0, OPEN, False)
    stack, blocks, part, linked = [root], [], [], 0
    open_tags: dict[str, int] = {}
    owner = root

    def cut(at: int):
        for gone in stack[at:]:
            open_tags[gone.tag] -= 1
        del stack[at:]

    def close_block():
        nonlocal part, linked
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            if text:
                blocks.append((owner, text, linked / max(1, sum(map(len, part)))))
                if tree:
                    owner.texts.append(text)
            part, linked = [], 0

    for m in _TOKEN.finditer(html):
        text = m[8]
        if text is not None:
            top = stack[-1]
            if not part:
                owner = top.block
            part.append(text)
            if top.link:
                linked += len(text)
            continue
        if m[1]:
            if m[1].lower() not in INLINE:
                close_block()
            continue
        tag = m[3] or m[6]
        if tag is None:
            if m[0] == "<":
                part.append("<")
            continue
        tag = tag.lower()
        if tag == "br":
            part.append(" ")
            continue
        if tag not in INLINE:
            close_block()
        if m[2] or m[5]:
            for i in range(len(stack) - 1, 0, -1) if open_tags.get(tag) else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        attributes = m[4] or m[7] or ""
        if tag in CLOSES_P or tag in ENDS_LIKE:
            ends = ENDS_LIKE.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for i in range(len(stack) - 1, 0, -1) if any(open_tags.get(t) for t in ends) else ():
                if stack[i].tag in ends:
                    cut(i)
                    break
                if stack[i].tag in HOLDERS:
                    break
        if tag in VOID or attributes.endswith("/") and tag not in CONTAINERS:
            continue
        up = stack[-1]
        name, apart = _look(tag, attributes)
        key = f"{tag}.{name}" if name else tag
        path = up.path if tag in INLINE else step(up.path, key)
        above = up.apart
        if (path == place and tag not in INLINE) or (above == NAMED and tag in ("article", "main")):
            above = apart = OPEN
        new = Element(tag, key, path, max(above, CLOSED if tag in APART else apart), up.link or tag == "a", up)
        new.inside |= path == place and tag not in INLINE
        if tree and tag not in INLINE:
            up.block.children.append(new)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        stack.append(new)
    close_block()
    return (blocks, root) if tree else blocks


def _table(a: Element, b: Element, sizes: dict) -> list[list[int]]:
    """Best sizes of matching the first i children of one with the first j of the other."""
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + sizes.get((id(x), id(y)), 0))
    return best


def match_trees(a: Element, b: Element) -> tuple[int, list[tuple[Element, Element]]]:
    """Size and pairs of the best simple tree matching: roots agree, children match in order. Without recursion:
    pairs of nodes are sized from the leaves up, then the matching is read from the roots down."""
    if a.key != b.key:
        return 0, []
    met = [(a, b)]
    for x, y in met:  # grows while it is read
        met += [(c, d) for c in x.children for d in y.children if c.key == d.key]
    sizes: dict[tuple[int, int], int] = {}
    for x, y in reversed(met):
        sizes[id(x), id(y)] = _table(x, y, sizes)[-1][-1] + 1
    pairs = [(a, b)]
    for x, y in pairs:
        best, i, j = _table(x, y, sizes), len(x.children), len(y.children)
        while i and j:
            size = sizes.get((id(x.children[i - 1]), id(y.children[j - 1])), 0)
            if size and best[i][j] == best[i - 1][j - 1] + size:
                pairs.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return sizes[id(a), id(b)], pairs


def _walk(e: Element) -> list[Element]:
    """The element and all below it, each before its children."""
    out = [e]
    for x in out:
        out += x.children
    return out


def induce(pages: list[str]) -> dict:
    """The wrapper of pages of one host: ``steady`` ([place, text] that never changes) and ``root`` (the place
    of the varying text, None if it has no single one)."""
    kept: list[tuple[set, Element, int]] = []
    for page in pages:
        blocks, root = read_page(page, tree=True)
        seen = {t for _, t, _ in blocks}
        nodes = len(_walk(root))
        # Pages that share most of their text are copies and say nothing about what varies.
        if nodes <= SAMPLE_NODES and all(2 * sum(map(len, seen & s)) < max(1, sum(map(len, seen | s))) for s, _, _ in kept):
            kept.append((seen, root, nodes))
        if len(kept) == USED:
            break
    if len(kept) < 2:
        return {"steady": [], "root": None}
    kept.sort(key=lambda x: -x[2])  # the richest page has most to align with
    base = kept[0][1]
    texts = {id(e): [e.texts] for e in _walk(base)}
    for _, other, _ in kept[1:]:
        for mine, theirs in match_trees(base, other)[1]:
            texts[id(mine)].append(theirs.texts)
    steady, varying, named = [], {}, {}
    order = _walk(base)
    for e in order:
        seen = texts[id(e)]
        if len(seen) >= STEADY and e.texts and all(s == seen[0] for s in seen):
            steady += [[e.path, t] for t in e.texts]
        elif e.apart < CLOSED:
            (named if e.apart else varying)[id(e)] = sum(len(t) for s in seen for t in s)
    # Names do not set apart what holds most of the text that varies.
    if sum(named.values()) > 4 * sum(varying.values()):
        varying |= named
    total = sum(varying.values())
    volumes: dict[int, int] = {}
    for e in reversed(order):
        volumes[id(e)] = varying.get(id(e), 0) + sum(volumes[id(c)] for c in e.children)

    root, at = None, base
    while total:
        heavy = [c for c in at.children if volumes[id(c)] >= 0.8 * total]
        if not heavy:
            break
        at = heavy[0]
        if at.tag in CONTAINERS and at.tag != "body":
            root = at.path
        if at.tag in ("article", "main"):
            break
    return {"steady": steady, "root": root}


def main_text(html: str | None, wrapper: dict | None = None) -> str:
    """The text of a page: blocks in the wrapper's place, or, where there is no such place, in its articles, or else
    anywhere where they are not mostly links; those that are not set apart and not template."""
    if not html:
        return ""
    root = wrapper["root"] if wrapper else None
    steady = wrapper["steady"] if wrapper else ()
    blocks = [b for b in read_page(html, place=root) if not b[0].apart]
    inside = [b for b in blocks if b[0].inside]
    articles = [b for b in blocks if b[0].article]
    blocks = inside or articles or [b for b in blocks if b[2] < 0.5]
    return " ".join(t for e, t, _ in blocks if (e.path, t) not in steady)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text. Pages without a host (null or odd urls) share one wrapper. Hosts with
    fewer than two unlike pages have no wrapper, and their pages are read by the roles of elements alone.
    Repeated rows are answered one by one; other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)),
                      F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    # The rank is limited before rows move, so a host brings at most SAMPLED pages of each partition.
    by = Window.partitionBy("host").orderBy(F.xxhash64("url", "page_id"), "page_id")
    sample = (rows.filter(F.length("html").between(1, SAMPLE_CHARS)).withColumn("_nth", F.row_number().over(by))
              .filter(F.col("_nth") <= SAMPLED).select("host", "html"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group.host.iloc[0]], "wrapper": [json.dumps(induce(sorted(set(group.html))))]})

    wrappers = settled(sample.groupBy("host").applyInPandas(learn, "host string, wrapper string"))
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    known = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def read(batches):
        parsed: dict[str | None, dict | None] = {None: None}
        for ids, urls, htmls, texts in slices(batches, "page_id", "url", "html", "wrapper"):
            out = []
            for page, wrapper in zip(htmls, texts, strict=True):
                if wrapper not in parsed:
                    if len(parsed) > 1000:
                        parsed = {None: None}
                    w = json.loads(wrapper)
                    parsed[wrapper] = {"root": w["root"], "steady": {tuple(x) for x in w["steady"]}}
                out.append(main_text(page, parsed[wrapper]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                [ids, urls, out, [len(x) for x in out]], schema.types, strict=True)], schema=schema)

    return (rows.join(known, "host", "left")
            .select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "wrapper")
            .mapInArrow(read, ddl))


@query("op10_html_text")
def op10_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
