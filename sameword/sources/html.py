"""IO16: the main text of a page, by a tree of its tags.

Text outside of navigation, tables, scripts, forms and the like is counted for each container, less what stands in links;
paragraphs give points to the container they are in and half as many to the one around it. The container with the most
points is the text; one within an article belongs to the outermost article. Character references are resolved.

Defined cases: a null page has a null text, a page without text an empty one; tags that are never closed end with what is
around them; an end tag without a beginning is ignored; where nothing has points, all text outside of such parts is taken.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the language: elements without an end tag, and what the begin tag of an element ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Parts that are no text of the article.
SKIPPED = {"aside", "audio", "button", "canvas", "footer", "form", "head", "header", "iframe", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "table", "template", "textarea", "title", "video"}
CONTAINERS = {"", "article", "body", "div", "main", "section", "td"}
PARAGRAPHS = {"blockquote", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre"}
BLOCKS = CONTAINERS | PARAGRAPHS | {"address", "center", "dl", "fieldset", "figure", "hr", "html", "ol", "ul"}
ARTICLES = {"article", "main"}
#: Characters from which text by itself counts as a paragraph, and those that give a point.
LEAST, POINT = 25, 100
#: The share of a list or container's text in links from which it is taken for a menu.
MENU = 0.6
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "up", "inside", "size", "linked", "points")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up, self.inside = tag, up, []
        self.size, self.linked, self.points = 0, 0, 0.0


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = self.root = Node("", None)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in ENDS:
            self.end(ENDS.get(tag, {"p"}) if tag in ENDS else {"p"}, {"li": {"ol", "ul"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}.get(tag, CONTAINERS - {"td"}))
        node = Node(tag, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.at.inside.append(Node(tag, self.at))
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.end({tag}, set())

    def handle_data(self, data):
        self.at.inside.append(data)

    def end(self, tags: set[str], border: set[str]) -> None:
        """Close the nearest open element of these, with all in it, unless an element of the border is nearer."""
        node = self.at
        while node is not None and node.tag not in tags:
            if node.tag in border:
                return
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up


def in_order(root: Node) -> list[Node]:
    """Nodes, parents first, without skipped parts. No recursion: pages may be deep."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag not in SKIPPED:
            out.append(node)
            todo += [x for x in reversed(node.inside) if isinstance(x, Node)]
    return out


def measured(nodes: list[Node]) -> None:
    """Sizes of text and links of each node, then the points of containers."""
    for node in reversed(nodes):
        node.size += sum(len(SPACE.sub(" ", x).strip()) for x in node.inside if isinstance(x, str))
        if node.tag == "a":
            node.linked = node.size
        if node.up is not None:
            node.up.size += node.size
            node.up.linked += node.linked
    for node in nodes:
        loose = "".join(x for x in node.inside if isinstance(x, str)).strip() if node.tag in CONTAINERS else ""
        if node.tag in PARAGRAPHS:
            give(node.up, node.size, node.linked, sum(x.count(",") for x in node.inside if isinstance(x, str)))
        elif len(loose) >= LEAST:
            give(node, len(loose), 0, loose.count(","))


def give(node: Node | None, size: int, linked: int, commas: int) -> None:
    if size < LEAST:
        return
    points, share = (1 + commas + min(size / POINT, 3)) * (1 - linked / size), 1.0
    while node is not None and share > 0.4:
        if node.tag in CONTAINERS:
            node.points += points * share
            share /= 2
        node = node.up


def best_of(nodes: list[Node]) -> Node:
    best = nodes[0]
    for node in nodes:
        if node.points > best.points:
            best = node
    node, outer = best, best
    while node is not None:
        outer = node if node.tag in ARTICLES else outer
        node = node.up
    return outer


def is_menu(node: Node) -> bool:
    return node.tag in {"ul", "ol", "dl", "div", "section"} and node.size > 0 and node.linked > MENU * node.size


def lines_of(top: Node) -> list[str]:
    """The paragraphs under a node, in order."""
    lines, words = [], []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(words)).strip()
        if line:
            lines.append(line)
        words.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            words.append(x)
        elif x is None:
            flush()
        elif x.tag not in SKIPPED and (x is top or not is_menu(x)):
            block = x.tag in BLOCKS or x.tag == "br"
            if block:
                flush()
                todo.append(None)
            todo += reversed(x.inside)
    flush()
    return lines


def article_text(html: str | None) -> str | None:
    """The main text of one page, a paragraph a line."""
    if html is None:
        return None
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes = in_order(tree.root)
    measured(nodes)
    return "\n".join(lines_of(best_of(nodes)))


def main_text(html: Column) -> Column:
    """IO16 for a column of pages, in Arrow batches."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(article_text, na_action="ignore")

    return F.pandas_udf(run, "string")(html)
