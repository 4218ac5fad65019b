"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

Each DOM node gets its characters per tag, adjusted for links; a container's sum adds
the densities of its children. The container with the greatest sum is the content,
and the least density on the path from the body to it is the threshold that any
other part must reach to join it. Menus, adverts, forms and the like, which their
tag, role or class names, are no content; but a name never takes away the part that
holds most of the page's text outside links, nor all text there is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article body center div html main section table tbody td tr".split())
#: Elements that a start tag of the same kind ends, and what ends the search for one.
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"},
            "td": {"table", "tr"}, "th": {"table", "tr"}}
SCOPES = frozenset("article aside blockquote body div footer form header main nav section table td th ul ol".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer head iframe input label link menu meta "
    "nav noscript object option script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id attributes that mark something other than the article.
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted promotion recommended related respond responses share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
COMMENTS = frozenset("comment commentlist comments disqus respond responses".split())
#: Long texts of these are still not the article while any other text is there.
ASIDES = COMMENTS | frozenset("consent cookie cookies gdpr modal popup".split())
#: Words beside a mark that do not change what it says: "comment-list" is marked,
#: "content-with-comments" and "has-sidebar" are only likely to be.
FILLERS = frozenset(
    "area articles block bottom box buttons col column container content group inner item items left links list main "
    "news outer panel post posts primary right row secondary section site stories thread top wrap wrapper".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped")

    def __init__(self, tag: str, parent: Node | None, dropped: str = ""):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _why_dropped(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> str:
    """Why an element may be no content: 'tag' is final, 'name' gives way to an article
    inside or to nearly all the text, 'hint' also to most of it, and 'last' to an article
    inside or when nothing else is left. ``inside``: within an article or main element."""
    if tag in DROPPED or tag == "header" and not inside:
        return "tag"
    if tag in ("body", "html"):
        return ""
    why = "hint" if tag == "form" else ""
    marks = COMMENTS if tag == "article" else MARKS if inside else MARKS | {"header"}
    for key, value in attrs:
        value = value or ""
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return "last"
        if key == "role" and value.lower() in ROLES:
            if value.lower() in ("alert", "alertdialog", "dialog"):
                return "last"
            why = "hint" if value.lower() == "form" and why != "name" else "name"
        if key in ("class", "id") and tag != "main":
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                if found := words & marks:
                    if words <= MARKS | FILLERS | {"header"}:
                        if found & ASIDES:
                            return "last"
                        why = "name"
                    else:
                        why = why or "hint"
    return why


class Tree(HTMLParser):
    """A forgiving DOM builder: unclosed and stray tags are taken as browsers do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.inside = 0

    def _end(self, node: Node) -> None:
        """Close everything up to and with ``node``."""
        closing = self.at
        while closing is not node.parent:
            self.inside -= closing.tag in ("article", "main")
            closing = closing.parent
        self.at = node.parent

    def _open(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> Node | None:
        node = self.at
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                return node
            node = node.parent
        return node if node.tag in tags else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SIBLINGS:
            kinds = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            if node := self._open(kinds, SIBLINGS[tag]):
                self._end(node)
        elif tag not in INLINE and tag not in DROPPED - {"aside", "nav", "footer"} and (node := self._open({"p"}, SCOPES)):
            self._end(node)
        if tag == "body" and (node := self._open({"head"}, frozenset())):
            self._end(node)
        node = Node(tag, self.at, _why_dropped(tag, attrs, self.inside > 0))
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
            self.inside += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        # An inline end tag never closes a block around it.
        until = SCOPES | {"p", "li"} if tag in INLINE else frozenset()
        if tag not in VOID and (node := self._open({tag}, until)):
            self._end(node)

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def _in_order(top: Node) -> list[Node]:
    nodes, todo = [], [top]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return nodes


def _without(root: Node, gone: set[int]) -> None:
    for node in _in_order(root):
        node.parts = [x for x in node.parts if isinstance(x, str) or id(x) not in gone]


def _body(root: Node) -> Node:
    return next((n for n in _in_order(root) if n.tag == "body"), root)


def _prune(root: Node) -> None:
    """Take out what is no content by name. What is marked beyond doubt goes first, so
    that long asides do not hide how much of the rest a doubtful part holds."""
    nodes = _in_order(root)
    holds = {id(n): n.tag in ("article", "main") and not n.dropped for n in nodes}
    for node in reversed(nodes):
        if node.parent is not None and holds[id(node)]:
            holds[id(node.parent)] = True
    doubtful = [n for n in nodes if n.dropped and not holds[id(n)]]
    for kind in ("last", "name", "hint"):
        named = [n for n in doubtful if n.dropped == kind]
        if not named:
            continue
        if kind == "last":
            _without(root, {id(n) for n in named})
            continue
        body = _body(root)
        within = _measure(body)
        whole = body.chars - body.link_chars
        kept: set[int] = set()
        if kind == "name":
            # An article elsewhere that has text is the content; names are right then.
            if not any(n.tag in ("article", "main") and not n.dropped and n.chars > n.link_chars for n in within):
                kept = {id(n) for n in within if 10 * (n.chars - n.link_chars) >= 9 * max(whole, 1)}
        else:
            kept = {id(n) for n in within if 2 * (n.chars - n.link_chars) > whole}
            at: Node | None = max((n for n in within if n is body or n.tag in CONTAINERS), key=lambda n: n.total)
            while at is not None:
                if 3 * (at.chars - at.link_chars) > whole:
                    kept.add(id(at))
                at = at.parent
        _without(root, {id(n) for n in named} - kept)


def _parse(page: str) -> Node:
    """The tree of a page without the elements that their tag rules out."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    nodes = _in_order(tree.root)
    _without(tree.root, {id(n) for n in nodes if n.dropped == "tag"})
    return tree.root


def _measure(body: Node) -> list[Node]:
    """Densities of all nodes below the body, in page order."""
    nodes = _in_order(body)
    for node in reversed(nodes):
        node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        node.chars = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        for x in node.parts:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
    links = body.link_chars / max(body.chars, 1)
    for node in nodes:
        chars, tags = node.chars, max(node.tags, 1)
        if not chars:
            continue
        inside, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(chars / max(chars - node.link_chars, 1) * node.link_chars + links * chars + math.e)
        ratio = chars / inside * tags / link_tags
        # The base is at least 1 and is 1 on pages without links: the plain logarithm.
        node.density = chars / tags * (math.log(ratio) / (math.log(base) if base > math.e else 1.0))
    for node in nodes:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node))
    return nodes


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    blocks: list[str] = []
    current: list[str] = []

    def close() -> None:
        if text := " ".join("".join(current).split()):
            blocks.append(text)
        current.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            current.append(x)
        elif x.tag == "br" or x.tag == "wbr":
            current.append(" " if x.tag == "br" else "")
        elif x.tag in INLINE:
            todo.extend(reversed(x.parts))
        else:
            close()
            todo.append(None)
            todo.extend(reversed(x.parts))
    close()
    return blocks


def _whole_markup(html: str) -> str:
    """The page without a comment or tag that its end cuts off."""
    at = html.rfind("<!--")
    if at >= 0 and "-->" not in html[at:] and "</script" not in html[at:].lower():
        html = html[:at]
    at = html.rfind("<")
    if at >= 0 and ">" not in html[at:] and re.match(r"<[a-zA-Z/!?]", html[at:]):
        html = html[:at]
    return html


def main_text(html: str | None) -> str:
    """Blocks of the main text joined by line feeds; empty for an empty or null page."""
    if not html:
        return ""
    page = _whole_markup(html)
    root = _parse(page)
    _prune(root)
    body = _body(root)
    nodes = _measure(body)
    if not body.chars:
        # Names left nothing: they do not say what is content here.
        root = _parse(page)
        body = _body(root)
        nodes = _measure(body)
    if not body.chars:
        return ""
    candidates = [n for n in nodes if n is body or n.tag in CONTAINERS]
    best = max(candidates, key=lambda n: n.total)
    threshold = math.inf
    at: Node | None = best
    while at is not None and at is not body.parent:
        threshold = min(threshold, at.density)
        if at.tag in ("article", "main"):  # named as the content: taken whole
            best = at
        at = at.parent
    chosen = {id(best)}
    within = {id(n) for n in _in_order(best)}
    above = set()
    at = best.parent
    while at is not None:
        above.add(id(at))
        at = at.parent
    # Other parts join if they are as dense, unless an element names the article.
    if best.tag not in ("article", "main"):
        for node in nodes:
            if id(node) not in within and id(node) not in above and node.tag not in INLINE:
                if node.density >= threshold and node.chars > node.link_chars:
                    chosen.add(id(node))
    blocks: list[str] = []
    todo = [body]
    while todo:
        node = todo.pop()
        if id(node) in chosen:
            blocks += _blocks(node)
        else:
            todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    if best is root or not blocks:
        blocks = _blocks(body)
    return "\n".join(blocks)


def texts(html: Column) -> Column:
    """Main text of a page column; null and empty pages give an empty text."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text)

    return of(html)
