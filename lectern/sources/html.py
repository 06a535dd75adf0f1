"""Text of web pages, by a forgiving HTML walk; two profiles, server and client.

The server profile keeps no line ends and drops nothing; the client profile drops scripts, styles and embedded objects,
keeps line ends, and turns <br> into one. What a main-content detector would do is left to a plain rule: the <article>
if there is one, else the body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.batches import by_row

# Fixed values.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset({*HEADINGS, "p", "li", "blockquote", "figcaption", "td", "th"})
DROPPED = frozenset({"script", "style", "iframe", "object"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: What an open <p> can't hold: their start ends it.
ENDS_P = frozenset({
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    *HEADINGS, "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
})
#: Tags that end an open one of the same group, up to the nearest list or table around.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
HEAD = frozenset({"head", "title", "base", "link", "meta"})


@dataclass
class Node:
    tag: str
    children: list = field(default_factory=list)

    def text(self, drop: frozenset[str] = frozenset(), br: str = "") -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "br":
                out.append(br)
            elif node.tag not in drop:
                todo.extend(reversed(node.children))
        return "".join(out)

    def find(self, tag: str) -> Node | None:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.tag == tag:
                return node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
        return None


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _close(self, tags: set[str] | frozenset[str], walls: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in walls:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            self._close({tag}, set())

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _body(root: Node) -> Node:
    return root.find("body") or Node("body", [c for c in root.children if not (isinstance(c, Node) and c.tag in HEAD)])


_blank, _blank_but_lf = re.compile(r"\s+"), re.compile(r"[^\S\n]+")


def structured_text(root: Node, profile: str = "server") -> str:
    """Headings with #, list items with -, other blocks as they are, a blank line between; all text where there are none."""
    server = profile == "server"
    drop, br, space = (frozenset(), "", _blank) if server else (DROPPED, "\n", _blank_but_lf)
    blocks, todo = [], [c for c in reversed(root.children) if isinstance(c, Node)]
    while todo:
        node = todo.pop()
        if node.tag in drop:
            continue
        if node.tag not in BLOCKS:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
            continue
        text = space.sub(" ", node.text(drop, br)).strip()
        if text:
            sign = "#" * int(node.tag[1]) + " " if node.tag in HEADINGS else "- " if node.tag == "li" else ""
            blocks.append(sign + text)
    if blocks:
        return "\n\n".join(blocks)
    whole = root.text(drop, br)
    return _blank.sub(" ", whole).strip() if server else whole.strip()


def page_text(html: str | None, profile: str = "server") -> tuple[str, str]:
    """(title, text) of a page: its article if that has text, else its body."""
    root = parse(html or "")
    title = root.find("title")
    article = root.find("article")
    text = structured_text(article, profile) if article else ""
    return (_blank.sub(" ", title.text()).strip() if title else ""), text or structured_text(_body(root), profile)


def extract(html: Column, profile: str = "server") -> Column:
    """struct(title, text) of an HTML column."""

    def one(page: str | None) -> dict:
        return dict(zip(("title", "text"), page_text(page, profile), strict=True))

    return by_row(one, "struct<title:string,text:string>", pa.struct([("title", pa.string()), ("text", pa.string())]))(html)


def websites(pages: DataFrame, profile: str = "server") -> DataFrame:
    """(page_id, title, text) of pages (page_id, url, html); a page without a title is called by its host."""
    found = pages.select("page_id", "url", extract(F.col("html"), profile).alias("x"))
    return found.select("page_id", F.coalesce(F.nullif("x.title", F.lit("")), F.try_parse_url("url", F.lit("HOST"))).alias("title"), "x.text")
