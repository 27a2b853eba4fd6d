"""Main text of web pages through wrappers inferred per host.

A wrapper is a union-free regular expression over a host's pages: element labels (tag and class), text, optional
parts ``?`` and repeated groups ``+``. A page is first read as such an expression, with adjacent repetitions of one
to four siblings folded into a group. Pages of a host are then aligned one after the other: matched elements are
aligned inside, different strings at the same place become a text slot, parts that only one side has become
optional, and repetitions that appear are folded again. Every task aligns its own pages and hands over one wrapper
a host; those are aligned by host, in a fixed order. A host with a third of all pages therefore costs its tasks
the same work as any other pages, and one small row each in the shuffle.

The wrapper tells where a host keeps its article: in ``article`` or ``main``, else in the deepest element that
holds most of the text that differs between pages. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are known by tag, role, class and id, and are left out inside and outside it. A form, or an
element whose name only contains such a word, is left out unless it holds more than half of the page's text (some pages are one form).
A page without the host's element is read by its own expression, and, if that finds nothing, with whole names only.

Html is read in one pass, and trees are ``DEEPEST`` levels deep at most: elements further down still end blocks and are still
left out, but are no nodes of their own. Text of ``math`` and ``xmp`` is text.

Blocks are joined by line feeds in page order; white space inside a block is one space; character references are
decoded; line breaks count as white space. Null or empty html has no text; pages with a null url share a wrapper;
rows with null or repeated ``page_id`` are read each on its own; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import attach, slices, stored

# Element names of HTML by role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
                   "title ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("aside button datalist dialog footer form head input label menu nav option select textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of classes and ids that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie "
                  "cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager "
                  "pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar "
                  "signup social sponsor sponsored subscribe toolbar widget".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
# Elements whose whole content is not page text; what they hold is not read as markup.
RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in "script style noscript template iframe svg object".split()}
PLAIN = {"xmp": re.compile(r"</xmp\s*>", re.IGNORECASE)}
# Marks that no share of the page's text can lift: a long thread of comments stays a thread of comments.
FIRM = frozenset("comment comments consent cookie cookies disqus recommended related replies reply respond".split())
LIFTED = frozenset("has hide no non with without".split())
"""Words that turn the mark after them into a statement about the page: no-comments, content-with-sidebar."""
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
DEEPEST = 120
"""Levels of the tree; elements further down end a block like any other, but are no nodes of their own."""
WIDEST = 256
"""Parts of a wrapper's node; of more, those with the most text stay. It decides where the article lies, never what is read there."""
# A name up to "=", "/" or white space, and its whole value: what stands inside a value is never a name.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
GROUP, SLOT = "()", "#"
LONGEST_GROUP = 4


SURE, MAYBE = 1, 2


class Element:
    __slots__ = ("label", "skip", "parts")

    def __init__(self, label: str, skip: int):
        self.label, self.skip, self.parts = label, skip, []


def _named(name: str, exact: bool) -> int:
    """How far a class or id marks what is not the article: a word of it does, unless the word before lifts that."""
    words = [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]
    if len(words) == 1:
        return SURE if words[0] in MARKS else 0
    hit = [w for before, w in zip(["", *words], words) if w in MARKS and before not in LIFTED]
    return 0 if exact or not hit else SURE if FIRM.intersection(hit) else MAYBE


def _marked(tag: str, rest: str, inside: bool, loose: bool = False) -> tuple[str, int]:
    """An element's label, and whether it is not of the article: surely, or unless it holds most of the page's text.

    ``inside`` an article, a header is its own. An article's own names mark it only if they are nothing but a mark; ``loose``
    reads all elements so.
    """
    found: dict[str, str] = {}
    if rest and not rest.isspace():
        for m in ATTRIBUTE.finditer(rest):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = found.get("class", "").split()
    label = ".".join([tag, *(re.sub(r"\d+", "0", n) for n in names[:1])])
    if tag in ("html", "body"):
        return label, 0
    exact = loose or tag in ("article", "main")
    skip = [_named(n, exact) for n in (*names, *found.get("id", "").split())]
    if tag == "form":
        skip.append(0 if loose else MAYBE)
    if tag in SKIPPED and tag != "form" or found.get("role", "").strip().lower() in ROLES or "hidden" in found:
        skip.append(SURE)
    if not inside and (tag == "header" or any("header" in re.split(r"[^a-z0-9]+", n.lower()) for n in (*names, found.get("id", "")))):
        skip.append(SURE)
    return label, SURE if SURE in skip else max(skip, default=0)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order: kind is text, open or close. One pass, whatever is left unclosed."""
    at, n = 0, len(html)
    last = html.rfind(">")
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            lt = n
        if lt > at:
            yield "text", html[at:lt], ""
            at = lt
            continue
        follows = html[lt + 1:lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif follows in "!?":
            at = html.find(">", lt) + 1
        elif (m := TAG.match(html, lt)) or (follows.isalpha() or follows == "/" and html[lt + 2:lt + 3].isalpha()) and follows.isascii():
            if m:
                close, tag, rest, at = m[1], m[2].lower(), m[3], m.end()
            else:  # an open quotation runs to the end: the tag ends where it can
                at = html.find(">", lt) + 1
                close, tag, rest = re.match(r"<(/?)([^\s/>]*)([^>]*)", html[lt:at]).groups()
                tag = tag.lower()
            if not close and tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.end() if end else n
            elif not close and tag in PLAIN:
                end = PLAIN[tag].search(html, at)
                yield "text", html[at:end.start() if end else n].replace("&", "&amp;"), ""
                at = end.end() if end else n
            else:
                yield "close" if close else "open", tag, rest
        else:
            yield "text", "<", ""
            at += 1


def parse(html: str, loose: bool = False) -> Element:
    """The tree of a page's block elements; inline markup is dropped and its text kept."""
    root = Element("", 0)
    stack: list[tuple[str, Element]] = [("", root)]
    is_open: Counter[str] = Counter()

    def drop(to: int) -> None:
        for tag, node in reversed(stack[to:]):
            is_open[tag] -= 1
            stack.pop()
            if stack[-1][1] is node:  # no node of its own: it still ends a block
                node.parts.append(Element("hr", 0))

    for kind, tag, rest in tokens(html):
        if kind == "text":
            stack[-1][1].parts.append(tag)
            continue
        if tag == "br":
            stack[-1][1].parts.append(" ")
            continue
        if kind == "close":
            if is_open[tag]:
                drop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        label, skip = _marked(tag, rest, bool(is_open["article"] or is_open["main"]), loose)
        if tag not in BLOCKS and not skip:
            continue
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
            if tag == "hr":
                stack[-1][1].parts.append(Element("hr", 0))
            continue
        if tag in BLOCKS and stack[-1][0] == "p":
            drop(len(stack) - 1)
        if any(is_open[t] for t in CLOSES.get(tag, ())):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    drop(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        parent = stack[-1][1]
        node = Element(label, skip)
        if len(stack) > DEEPEST and (not skip or parent.skip == SURE):
            parent.parts.append(Element("hr", 0))
            node = parent
        else:
            parent.parts.append(node)
        stack.append((tag, node))
        is_open[tag] += 1
    weigh(root)
    return root


def weigh(root: Element) -> None:
    """Elements that may not be of the article are of it if they hold more than half of the text that is not surely left out."""
    order: list[Element] = [root]
    for e in order:  # parents come before their parts
        order.extend(p for p in e.parts if not isinstance(p, str) and p.skip != SURE)
    held: dict[int, int] = {}
    for e in reversed(order):
        held[id(e)] = sum(len(p) - p.count(" ") if isinstance(p, str) else held.get(id(p), 0) for p in e.parts)
    for e in order:
        if e.skip == MAYBE:
            e.skip = 0 if 2 * held[id(e)] > held[id(root)] else SURE


def clean(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


# ---- expressions ------------------------------------------------------------------------------
# A node is [label, mark, chars, skip, children]; the mark is "", "?", "+" or "*" on elements, and on text
# the checksum of a fixed string or -1 for a slot.

def expression(element: Element) -> list:
    children: list[list] = []
    pieces: list[str] = []

    def flush() -> None:
        t = clean(pieces)
        pieces.clear()
        if t:
            children.append([SLOT, zlib.crc32(t.encode("utf-8", "replace")), len(t), False, []])

    for part in element.parts:
        if isinstance(part, str):
            pieces.append(part)
        else:
            flush()
            children.append(expression(part))
    flush()
    return [element.label, "", 0, bool(element.skip), fold(children)]


def fold(children: list[list]) -> list[list]:
    """Adjacent repetitions of one to ``LONGEST_GROUP`` siblings become one repeated node or group."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list[list] = []
        i = 0
        while i < len(children):
            group = children[i:i + size]
            labels = [c[0] for c in group]
            j, count = i + size, 1
            while len(group) == size and [c[0] for c in children[j:j + size]] == labels:
                group = [align(a, b) for a, b in zip(group, children[j:j + size])]
                j, count = j + size, count + 1
            if count == 1:
                out.append(children[i])
                i += 1
                continue
            if size == 1:
                group[0][1] = group[0][1] if group[0][0] == SLOT else repeated(group[0][1])
                out.append(group[0])
            else:
                out.append([f"{GROUP}{','.join(labels)}", "+", 0, False, group])
            i = j
        children = out
    return children


def repeated(mark: str) -> str:
    return "*" if mark in ("?", "*") else "+"


def optional(node: list) -> list:
    if node[0] != SLOT:
        node[1] = "*" if node[1] in ("+", "*") else "?"
    return node


def align(a: list, b: list) -> list:
    """The expression that covers both nodes, which have the same label."""
    if a[0] == SLOT:
        return [SLOT, a[1] if a[1] == b[1] else -1, a[2] + b[2], False, []]
    marks = {a[1], b[1]}
    many, maybe = bool(marks & {"+", "*"}), bool(marks & {"?", "*"})
    mark = "*" if many and maybe else "+" if many else "?" if maybe else ""
    mine, other = a[4], b[4]
    keys = [c[0] for c in mine], [c[0] for c in other]
    if keys[0] == keys[1]:
        children = [align(x, y) for x, y in zip(mine, other)]
    else:
        children = []
        for op, i, j, k, l in difflib.SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
            if op == "equal":
                children.extend(align(x, y) for x, y in zip(mine[i:j], other[k:l]))
            else:
                children.extend(optional(c) for c in (*mine[i:j], *other[k:l]))
        children = fold(children)
    if len(children) > WIDEST:
        rank = sorted(range(len(children)), key=lambda i: (-varying(children[i], True), i))
        children = [children[i] for i in sorted(rank[:WIDEST])]
    return [a[0], mark, 0, a[3] and b[3], children]


def varying(node: list, alone: bool) -> int:
    """Characters of text slots below a node, without what is not of the article; ``alone``: of fixed text too."""
    if node[0] == SLOT:
        return node[2] if alone or node[1] == -1 else 0
    return 0 if node[3] else sum(varying(c, alone) for c in node[4])


def article_path(wrapper: list, pages: int) -> list[str]:
    """Labels from the root to the element that holds the article."""
    alone = pages < 2
    named: list[tuple[int, int, list[str]]] = []

    def walk(node: list, path: list[str]) -> None:
        for c in node[4]:
            if c[0] == SLOT or c[3]:
                continue
            below = path if c[0].startswith(GROUP) else [*path, c[0]]
            tag = c[0].split(".")[0]
            if tag in ("article", "main") and below is not path:
                named.append((tag == "article", varying(c, True), below))
                if tag == "article":
                    continue
            walk(c, below)

    walk(wrapper, [])
    if any(chars for _, chars, _ in named):
        return max(x for x in named if x[1])[2]
    alone = alone or not varying(wrapper, False)
    node, path, total = wrapper, [], varying(wrapper, alone)
    while total:
        child = max((c for c in node[4] if c[0] != SLOT and not c[3]), key=lambda c: varying(c, alone), default=None)
        if child is None or varying(child, alone) < 0.7 * total or child[0].split(".")[0] in ("p", "li", "td"):
            break
        node = child
        if not child[0].startswith(GROUP):
            path = [*path, child[0]]
    return path


def blocks(root: Element, path: list[str]) -> list[str] | None:
    """Text blocks of all elements at ``path``; None if the page has no such element."""
    out: list[str] = []
    found = False

    def take(element: Element) -> None:
        pieces: list[str] = []
        for part in [*element.parts, None]:
            if isinstance(part, str):
                pieces.append(part)
                continue
            if t := clean(pieces):
                out.append(t)
            pieces.clear()
            if part is not None and not part.skip:
                take(part)

    def find(element: Element, rest: list[str]) -> None:
        nonlocal found
        if not rest:
            found = True
            take(element)
            return
        for part in element.parts:
            if not isinstance(part, str) and not part.skip and part.label == rest[0]:
                find(part, rest[1:])

    find(root, path)
    return out if found else None


def main_text(html: str, path: list[str] | None) -> str:
    root = parse(html)
    got = blocks(root, path) if path is not None else None
    if not got:
        got = blocks(root, article_path(expression(root), 1))
    if not got:  # names that merely contain a mark, or a form around everything, have hidden it all
        root = parse(html, loose=True)
        got = blocks(root, article_path(expression(root), 1))
    return "\n".join(got or [])


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


# ---- jobs -------------------------------------------------------------------------------------

FEW_HOSTS = 100_000
HELD_HOSTS = 2_000


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper) for (url, html): the wrapper as JSON."""
    names, out = ["host", "pages", "wrapper"], "host string, pages long, wrapper string"

    def batch_of(held: dict[str, list]) -> pa.RecordBatch:
        rows = [(h, n, json.dumps(w)) for h, (n, w) in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))],
                                          names=names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                for url, html in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                    host, one = host_of(url), expression(parse(html or ""))
                    n, w = held.get(host, (0, None))
                    held[host] = [n + 1, one if w is None else align(w, one)]
                    if len(held) >= HELD_HOSTS:
                        yield batch_of(held)
                        held = {}
        yield batch_of(held)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            done = {}
            for host, n, w in zip(*(batch.column(c).to_pylist() for c in names)):
                if host == at:
                    now = [now[0] + n, align(now[1], json.loads(w))]
                    continue
                if at is not None:
                    done[at] = now
                at, now = host, [n, json.loads(w)]
            yield batch_of(done)
        if at is not None:
            yield batch_of({at: now})

    parts = pages.mapInArrow(own, out)
    return parts.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(together, out)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article_path(json.loads(w), n) for n, w in zip(batch.column("pages").to_pylist(), batch.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.list_(pa.string()))], names=["host", "path"])

    known = stored(wrappers(rows.select("url", "html")), "wrappers")
    # Hosts share few places for their article; a page carries the number of its host's.
    found = known.mapInArrow(paths, "host string, path array<string>")
    places = {r["host"]: r["path"] for r in found.limit(FEW_HOSTS + 1).collect()}
    names = ["page_id", "url", "text", "n_chars"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                joined = "path" in part.schema.names
                path = part.column("path").to_pylist() if joined else [places.get(host_of(u)) for u in part.column("url").to_pylist()]
                text = [main_text(h or "", p) for h, p in zip(part.column("html").to_pylist(), path)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                                                  pa.array([len(t) for t in text], pa.int64())], names=names)

    def hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host = pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, host], names=[*batch.schema.names, "host"])

    out = "page_id long, url string, text string, n_chars long"
    if len(places) <= FEW_HOSTS:  # a bounded table of places travels with the tasks
        return rows.mapInArrow(extract, out)
    places = {}
    facts = stored(found.join(known.select("host", F.col("pages").alias("n")), "host"), "places")
    named = stored(rows.mapInArrow(hosted, "page_id long, url string, html string, host string"), "hosts")
    return attach(named, facts, "host").select("page_id", "url", "html", F.col("fact.path").alias("path")).mapInArrow(extract, out)
