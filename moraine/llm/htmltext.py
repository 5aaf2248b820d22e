"""The main text of web pages, by scoring a tree.

A page is parsed into a forgiving tree.  Menus, site headers, footers, side bars,
forms, scripts and the like go first, by element; so do notices, adverts, reader
comments and others by a name in class, id or role, unless the name only says how
a page is laid out (`with-sidebar`, `comments-open`), belongs to the article
(`article-header`), or the element holds most of the page's text together with an
article, a main element or a first-level heading.  If names would leave nothing,
none counts.  Every paragraph then earns points for its length and its commas and
passes them to its ancestors, halved at the grandparent and less above; a
container's points are discounted by the share of its text that stands in links.
The best container, widened to the article or main element around it, and its good
siblings are kept: other articles of at least `SIBLING` of its points, or, without
an article, blocks that are mostly unlinked text.

Text comes block by block in page order: character references decoded, white space
inside a block turned into one space, blocks joined by one newline.

Defined results: a null, empty or blank page has an empty text; text outside any
block is a block of its own; unclosed and stray tags close as browsers close them;
a page cut off inside a tag loses that tag only; a page without any container is
its own container; a page of several articles of like weight has the text of all;
repeated rows and null ids each get their row; columns other than id, url and
markup are not read, whatever their names; an empty table gives an empty table.
Time grows with the page's length, however deep it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import parts

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Fixed sets of element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_DROPPED = frozenset("script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video dialog menu head title noembed noframes xmp datalist map".split())
_PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
#: Fixed words of class, id and role that mark what is not the article.
_AROUND = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disqus dialog disclaimer footer gdpr header masthead menu modal nav navbar navigation navigationbar newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription tagcloud toc toolbar widget widgets".split())
#: Fixed parts of names that say how a page is laid out, or that something belongs to the article.
_LAYOUT = frozenset("with without no has is open closed enabled disabled layout page wrapper container grid row col columns left right on off".split())
_OWN = frozenset("article entry post story content main title headline".split())
_OTHERS = frozenset("comment comments reply related promo sponsored ad advert".split())
#: The share of the best article's points from which another article is the page's too.
SIBLING = 0.3
#: Elements that a tag closes if one is open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "points", "length", "linked", "commas", "holds")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.length = self.linked = self.commas = 0
        self.holds = False


def parse(page: str) -> Node:
    root = Node("#root", "", None)
    at, now = 0, root
    opened: dict[str, int] = {}

    def text(raw: str) -> None:
        if raw:
            now.children.append(html.unescape(raw) if "&" in raw else raw)

    def leave(node: Node) -> None:
        """Closes all up to and with `node`."""
        nonlocal now
        while now is not node:
            opened[now.tag] -= 1
            now = now.parent
        opened[node.tag] -= 1
        now = node.parent

    def close(tags: set[str], stop: set[str]) -> None:
        if not any(opened.get(x) for x in tags):
            return
        node, found = now, None
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            leave(found)

    for m in iter(lambda: _TOKEN.search(page, at), None):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or (m[5] and not m.group().endswith(">")):
            continue
        if m[1] or m[4]:
            if not opened.get(tag):
                continue
            node = now
            while node.parent is not None and node.tag != tag:
                # An end tag of something inside doesn't reach out of the table, article or block that holds it.
                if node.tag in ("table", "td", "th", "article", "section", "div", "main", "aside", "nav", "footer", "header", "form") and tag not in _BLOCK:
                    break
                node = node.parent
            if node.parent is not None and node.tag == tag:
                leave(node)
            continue
        if tag in _BLOCK:
            close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "blockquote", "li"} if tag != "p" else {"table", "td", "th", "button", "article", "section", "div", "blockquote"})
        if tag in _CLOSES:
            close(_CLOSES[tag], _SCOPE[tag])
        node = Node(tag, m[3] if m[2] else m[6], now)
        now.children.append(node)
        if tag in _RAW and not (tag == "noscript"):
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not (node.attributes.endswith("/") and tag in ("svg", "path")):
            now = node
            opened[tag] = opened.get(tag, 0) + 1
    text(page[at:])
    return root


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _named(node: Node, called: dict[str, str], inside: bool) -> bool:
    """Whether a name in class, id or role says that an element stands beside the article."""
    if called.get("role", "").lower() in ("complementary", "banner", "alert", "alertdialog", "status"):
        return True
    for name in (x for k in ("class", "id", "role") for x in called.get(k, "").split()):
        words = {w.lower() for w in _NAME.findall(name)}
        if node.tag in ("article", "main"):
            if words & _OTHERS and not words & _LAYOUT:
                return True
        elif words & _AROUND and not words & _LAYOUT and not (words & _AROUND <= {"header", "banner"} and (inside or words & _OWN)):
            return True
    return False


def _beside(node: Node, inside: bool, total: int, names: bool) -> bool:
    """Whether an element stands beside the article; `inside` tells that it is part of an article or main element."""
    if node.tag in _DROPPED or (node.tag == "header" and not inside):
        return True
    if not node.attributes.strip() or node.tag in ("html", "body"):
        return False
    called = _attributes(node.attributes)
    if "hidden" in called or called.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", called.get("style", ""), re.I):
        return True
    return names and _named(node, called, inside) and not (node.holds and node.length * 2 > total)


def _prune(root: Node, total: int, names: bool) -> None:
    stack = [(root, False)]
    while stack:
        now, inside = stack.pop()
        inside = inside or now.tag in ("article", "main")
        now.children = [x for x in now.children if isinstance(x, str) or not _beside(x, inside, total, names)]
        stack.extend((x, inside) for x in now.children if not isinstance(x, str))


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Each element twice: before (True) and after (False) its contents."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, enters = stack.pop()
        yield node, enters
        if enters:
            stack.append((node, False))
            stack.extend((x, True) for x in reversed(node.children) if not isinstance(x, str))


def _measure(root: Node) -> None:
    """Lengths, linked lengths and commas of all elements, and whether they hold an article of the page, a main element or an h1."""
    for node, enters in _walk(root):
        if enters:
            continue
        own = "".join(x for x in node.children if isinstance(x, str)).strip()
        inner = [x for x in node.children if not isinstance(x, str)]
        node.length = len(own) + sum(x.length for x in inner)
        node.linked = node.length if node.tag == "a" else sum(x.linked for x in inner)
        node.commas = own.count(",") + own.count("、") + sum(x.commas for x in inner)
        node.holds = node.tag in ("main", "h1") or any(x.holds for x in inner) or (node.tag == "article" and not _named(node, _attributes(node.attributes), True))


def _score(root: Node) -> None:
    boxes = ("div", "section", "article", "main", "body")
    for node, enters in _walk(root):
        if enters or not node.length:
            continue
        own = "".join(x for x in node.children if isinstance(x, str)).strip() if node.tag in boxes else ""
        if node.tag not in _PARAGRAPH and not own:
            continue
        length, commas = (len(own), own.count(",") + own.count("、")) if node.tag in boxes else (node.length, node.commas)
        points = (1 if length >= 25 else 0) + commas + min(length / 100, 3)
        points *= 1 - (node.linked / node.length)
        up, level = (node if node.tag in boxes else node.parent), 0
        while up is not None and level < 5:
            up.points += points / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1


def _value(node: Node) -> float:
    return node.points * (1 - node.linked / node.length) if node.length else 0.0


def _blocks(nodes: list[Node]) -> list[str]:
    out, held = [], []

    def flush() -> None:
        block = _SPACE.sub(" ", "".join(held)).strip()
        if block:
            out.append(block)
        held.clear()

    for top in nodes:
        stack: list[tuple[Node | str, bool]] = [(top, True)]
        while stack:
            node, enters = stack.pop()
            if isinstance(node, str):
                held.append(node)
                continue
            if node.tag in _BLOCK or node is top:
                flush()
            elif node.tag in ("br", "td", "th"):
                held.append(" ")
            if enters and node.tag not in _VOID:
                stack.append((node, False))
                stack.extend((x, True) for x in reversed(node.children))
    flush()
    return out


def _articles(root: Node) -> list[Node]:
    """The outermost article and main elements, an only main element giving way to several articles in it."""
    found, stack = [], [root]
    while stack:
        now = stack.pop()
        inner = [x for x in now.children if not isinstance(x, str)]
        if now.tag == "article" or (now.tag == "main" and sum(x.tag == "article" for x in inner) < 2):
            found.append(now)
        else:
            stack.extend(reversed(inner))
    return found


def _kept(root: Node) -> list[Node]:
    """The elements that make the page's main text, in page order."""
    best, most = root, -1.0
    for node, enters in _walk(root):
        if enters and node.tag not in _PARAGRAPH and _value(node) > most:
            best, most = node, _value(node)
    articles = _articles(root)
    up = best
    while up is not None and up not in articles:
        if up.tag == "main" or _attributes(up.attributes).get("role", "").lower() == "main" or "articlebody" in up.attributes.lower():
            break
        up = up.parent
    if up is not None and up not in articles and up.tag != "main":
        return [up]
    if up is None and articles and max(map(_value, articles)) >= most / 3:
        up = max(articles, key=_value)
    if up is not None:
        if up not in articles:
            articles = [x for x in articles if _inside(x, up)] or [up]
            up = max(articles, key=_value)
        return [x for x in articles if x is up or (x.tag == "article" and _value(x) >= max(1.0, SIBLING * _value(up)))]
    if best.parent is None or best.tag == "body":
        return [best]
    return [x for x in best.parent.children if not isinstance(x, str) and (x is best or (x.length and x.linked / x.length < 0.3 and (x.tag in _PARAGRAPH or _value(x) >= 1 or x.holds or any(not isinstance(y, str) and y.tag in _PARAGRAPH for y in x.children))))]


def _inside(node: Node, outer: Node) -> bool:
    up = node
    while up is not None and up is not outer:
        up = up.parent
    return up is not None


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    for names in (True, False):
        root = parse(page)
        _prune(root, 0, False)
        _measure(root)
        if names:
            _prune(root, root.length, True)
            _measure(root)
        _score(root)
        text = "\n".join(_blocks(_kept(root)))
        if text:
            break
    return text


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per row of `pages`: (page_id, url, text, n_chars)."""
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(markup).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
