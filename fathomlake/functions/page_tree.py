"""Detail pages read with a stack of open tags: elements may be nested, unclosed, or closed twice."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no part of an item's title; classes of items, titles and details.
TITLE_NOISE = ["Mở rộng", "Thu gọn"]
ITEM_CLASS, TITLE_CLASS, DETAIL_CLASS = "tthc-list-item", "item-title", "tthc-list-item-detail"

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag that opens closes the nearest of the first ones that is open, unless one of the others is nearer.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "p": ({"p"}, {"div", "td", "li"})}
CLOSES |= {t: ({"p"}, {"div", "td", "li"}) for t in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "article", "nav", "footer", "section")}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|$)|<(/?)([a-z][a-z0-9:-]*)([^<>]*)>", re.S | re.I)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INSIDE = re.compile(r"<!--.*?(?:-->|$)|<[^>]*>", re.S)


@dataclass
class Node:
    tag: str
    classes: str
    start: int  # where its content starts
    end: int  # and ends
    rest: str = ""  # what the tag holds after its name


def nodes_of(html: str) -> list[Node]:
    """The elements of a page in the order in which they open, each with where its content starts and ends."""
    out: list[Node] = []
    stack: list[Node] = []

    def close(at: int, end: int) -> None:
        for node in stack[at:]:
            node.end = end
        del stack[at:]

    for m in TOKEN.finditer(html):
        slash, tag, rest = m.group(2), (m.group(3) or "").lower(), m.group(4) or ""
        if not tag:
            continue
        if slash:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if at is not None:  # what was left open inside ends here too; a tag that closes nothing is none
                close(at, m.start())
            continue
        same, bounds = CLOSES.get(tag, ((), ()))
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in same:
                close(i, m.start())
                break
            if stack[i].tag in bounds:
                break
        found = CLASS.search(rest)
        node = Node(tag, next((x for x in found.groups() if x is not None), "") if found else "", m.end(), m.end(), rest)
        out.append(node)
        if tag not in VOID:  # a slash at the end of another tag means nothing in HTML
            stack.append(node)
    close(0, len(html))
    return out


def text_of(html: str) -> str:
    return unescape(INSIDE.sub("", html))


def items_of(html: str | None) -> list[tuple[str, str, str, str]]:
    """(title, title in lower case, content of the detail, its text) of the items that have a title and a detail. Of items of
    one title the last one's text stands at the first one's place, of titles that differ in case the last one's content."""
    nodes = nodes_of(html or "")
    starts = [n.start for n in nodes]
    with_class = {c: [i for i, n in enumerate(nodes) if c in n.classes] for c in (TITLE_CLASS, DETAIL_CLASS)}

    def first_in(i: int, name: str) -> Node | None:
        at = bisect_left(with_class[name], i + 1)
        found = nodes[with_class[name][at]] if at < len(with_class[name]) else None
        return found if found and found.start <= nodes[i].end and starts[i] <= found.start else None

    texts, contents = {}, {}
    for i, node in enumerate(nodes):
        if node.tag != "div" or ITEM_CLASS not in node.classes:
            continue
        title, detail = first_in(i, TITLE_CLASS), first_in(i, DETAIL_CLASS)
        if title is None or detail is None:
            continue
        name = text_of(html[title.start : title.end])
        for noise in TITLE_NOISE:
            name = name.replace(noise, "")
        name, inner = " ".join(name.split()), html[detail.start : detail.end]
        contents[name.lower()] = inner
        texts[name] = "\n".join(x for x in map(str.strip, text_of(inner).splitlines()) if x)
    return [(name, name.lower(), contents[name.lower()], text) for name, text in texts.items()]


def page_items(html: Column) -> Column:
    """array of struct(title, low, inner, text) of a detail page's list items."""
    names = ("title", "low", "inner", "text")

    @F.pandas_udf("array<struct<title: string, low: string, inner: string, text: string>>")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: [dict(zip(names, x, strict=True)) for x in items_of(html)], na_action=None)

    return read(html)
