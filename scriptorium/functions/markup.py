"""The blocks of one HTML page, read in a single pass over its tags.

A page's elements are numbered in document order; each knows where its text begins and ends, its parent, and the
nearest figure, box, list item, table and section around it, all handed down as it opens. Everything takes time in
proportion to the page. What the blocks' text means is decided by column expressions (`functions.text`).
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-z][a-z0-9]*)\b([^>]*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What closes an open paragraph, as browsers do.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADS = frozenset(("h2", "h3", "h4"))


@dataclass(slots=True)
class Node:
    """An element: html[start:end] is what it holds. figure, box, item, table, section: numbers of the nearest such element around it or itself."""

    name: str
    attrs: dict[str, str]
    start: int
    parent: int
    open_at: int
    end: int = -1
    close_at: int = -1
    figure: int = -1
    box: int = -1
    item: int = -1
    table: int = -1
    titled: int = -1
    section: int = -1
    area: int = -1
    list_of: int = -1
    at: int = 0
    children: list[int] = field(default_factory=list)


def is_figure(name: str, classes: str) -> bool:
    return name == "figure" or (name == "div" and "c-article-section__figure" in classes)


def elements(page: str) -> list[Node]:
    """All elements in document order, the page itself first; unclosed ones end where their parents do."""
    nodes = [Node("", {}, 0, -1, 0)]
    stack, at = [0], {"": 1}

    def close(upto: int, end: int, after: int) -> None:
        while len(stack) > upto:
            n = nodes[stack.pop()]
            n.end, n.close_at = end, after
            at[n.name] -= 1

    for m in TOKEN.finditer(page):
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if at.get(name, 0):
                k = len(stack) - 1
                while nodes[stack[k]].name != name:
                    k -= 1
                inner = len(stack) > k + 1
                if inner:
                    close(k + 1, m.start(), m.start())
                close(k, m.start(), m.end())
            continue
        # An open paragraph or list item ends where the next block or item begins.
        while len(stack) > 1 and ((nodes[stack[-1]].name == "p" and name in ENDS_P) or (name == "li" and nodes[stack[-1]].name == "li")):
            close(len(stack) - 1, m.start(), m.start())
        if at.get("p", 0) and name in ENDS_P and nodes[stack[-1]].name in ("b", "i", "em", "strong", "a", "span", "sup", "sub"):
            k = len(stack) - 1
            while nodes[stack[k]].name in ("b", "i", "em", "strong", "a", "span", "sup", "sub"):
                k -= 1
            if nodes[stack[k]].name == "p":
                close(k, m.start(), m.start())
        attrs = {a[1].lower(): html.unescape(next(x for x in a.group(2, 3, 4) if x is not None)) for a in ATTRIBUTE.finditer(m[4])} if m[4] else {}
        up = nodes[stack[-1]]
        n = Node(name, attrs, m.end(), stack[-1], m.start(), figure=up.figure, box=up.box, item=up.item, table=up.table, titled=up.titled, section=up.section, area=up.area, list_of=up.list_of)
        k = len(nodes)
        nodes.append(n)
        n.at = len(up.children)
        up.children.append(k)
        classes = attrs.get("class", "")
        if n.figure < 0 and is_figure(name, classes):
            n.figure = k
        if name == "div" and "c-article-box" in classes.split():
            n.box = k
        if name == "li":
            n.item = k
        if name == "table":
            n.table = k
        if name in ("ol", "ul"):
            n.list_of = k
        if name == "section" and n.titled < 0 and attrs.get("data-title"):
            n.titled = k
        if name == "section" or (name == "div" and "c-article-section" in classes.split()):
            n.section = k
        if name in VOID:
            n.end = n.close_at = m.end()
        else:
            stack.append(k)
            at[name] = at.get(name, 0) + 1
    close(1, len(page), len(page))
    nodes[0].end = nodes[0].close_at = len(page)
    return nodes


def plain(raw: str) -> str:
    """Text of markup: tags dropped, entities read, spaces squashed."""
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", raw)).split())


def list_behind(page: str, nodes: list[Node], k: int, over_blank: bool = False) -> int:
    """The list that directly follows element k, or -1; empty paragraphs between them are passed over if asked."""
    up = nodes[nodes[k].parent].children
    for i in range(nodes[k].at + 1, len(up)):
        j = up[i]
        if page[nodes[k].close_at : nodes[j].open_at].strip():
            return -1
        if nodes[j].name in ("ol", "ul"):
            return j
        if not over_blank or nodes[j].name != "p" or plain(page[nodes[j].start : nodes[j].end]):
            return -1
        k = j
    return -1


def inside(nodes: list[Node], k: int, name: str) -> list[int]:
    """Descendants of k of a name: those that follow it till one begins behind its end."""
    out = []
    for j in range(k + 1, len(nodes)):
        if nodes[j].open_at >= nodes[k].close_at:
            break
        if nodes[j].name == name:
            out.append(j)
    return out


def captions(page: str, nodes: list[Node]) -> dict[int, str]:
    """The first caption of each figure that has one."""
    out: dict[int, str] = {}
    for n in nodes:
        if n.figure >= 0 and n.figure not in out and (n.name == "figcaption" or (n.name == "b" and "c-article-section__figure-caption" in n.attrs.get("class", ""))):
            out[n.figure] = page[n.start : n.end]
    return out


#: A block: its main section and heading, the running number of that heading, and its markup.
BLOCK = "main string, heading string, level int, sec int, raw string, items array<string>, is_figure boolean, label string, in_box boolean"


def section_blocks(page: str | None, skip: frozenset[str]) -> list[tuple]:
    """Blocks of titled sections, outermost ones whole: figures' paragraphs first, then paragraphs under their headings.

    Tables are no text. A paragraph that ends with a colon takes in the list right behind it."""
    page = page or ""
    nodes = elements(page)
    labels = captions(page, nodes)
    by_section: dict[int, tuple[list[int], list[int]]] = {}
    for k, n in enumerate(nodes):
        if n.titled == k:
            by_section[k] = ([], [])
        elif n.titled >= 0 and n.name in ("p", "h3", "h4"):
            by_section[n.titled][n.figure < 0].append(k)
    out: list[tuple] = []
    sec = -1
    for s, (figures, flow) in by_section.items():
        main = nodes[s].attrs["data-title"].strip()
        if main.lower() in skip:
            continue
        sec += 1
        for k in figures:
            n = nodes[k]
            if n.name == "p":
                out.append((main, main, 1, sec, page[n.start : n.end], [], True, labels.get(n.figure), False))
        heading, level, taken = main, 1, -1
        for k in flow:
            n = nodes[k]
            if n.table >= 0 or (taken >= 0 and n.list_of == taken):
                continue
            raw = page[n.start : n.end]
            if n.name != "p":
                text = plain(raw)
                if text:
                    heading, level, sec = text, 2 if n.name == "h3" else 3, sec + 1
                continue
            items: list[str] = []
            if "<" not in raw and raw.rstrip().endswith(":"):
                behind = list_behind(page, nodes, k)
                if behind >= 0:
                    taken = behind
                    items = [page[nodes[j].start : nodes[j].end] for j in inside(nodes, behind, "li")]
            out.append((main, heading, level, sec, raw, items, False, None, False))
    return out


NUMBER = re.compile(r"""(?is)<(\w+)\b[^>]*class\s*=\s*["'][^"']*u-custom-list-number[^"']*["'][^>]*>(.*?)</\1>""")
AREAS = (
    lambda n: n.name == "div" and "main-content" in n.attrs.get("class", "").split(),
    lambda n: n.name == "div" and n.attrs.get("data-component") == "article-body",
    lambda n: "c-article-body" in n.attrs.get("class", "").split(),
    lambda n: n.name == "article",
    lambda n: n.name == "body",
)


def numbered_item(raw: str, k: int) -> str:
    m = NUMBER.search(raw)
    number = plain(m[2]) if m else str(k)
    return f"{number}{'' if number.endswith('.') else '.'} {raw[: m.start()] + raw[m.end() :] if m else raw}"


def browser_blocks(page: str | None, skip: frozenset[str]) -> list[tuple]:
    """Blocks as a browser's document gives them: the abstract, then each section of the article's container with its first heading.

    A paragraph belongs to the outermost section that has a heading. Paragraphs of figures carry the caption, those
    of boxes a flag; in boxes a paragraph that ends with a colon takes in the list behind it, and paragraphs of list
    items go. Without any section all paragraphs are one, the introduction."""
    page = page or ""
    nodes = elements(page)
    labels = captions(page, nodes)
    area = next((k for test in AREAS for k, n in enumerate(nodes) if k and test(n)), 0)
    last = nodes[area].close_at
    out: list[tuple] = []
    sec = -1

    def emit(heading: str, level: int, ps: list[int], marks: bool) -> bool:
        nonlocal sec
        rows = []
        for k in ps:
            n = nodes[k]
            raw, items = page[n.start : n.end], []
            if marks and n.figure >= 0:
                rows.append((heading, heading, level, sec + 1, raw, [], True, labels.get(n.figure), False))
                continue
            if marks and n.box >= 0:
                if n.item >= 0:
                    continue
                if plain(raw).endswith(":"):
                    behind = list_behind(page, nodes, k, True)
                    items = [numbered_item(page[nodes[j].start : nodes[j].end], i) for i, j in enumerate(inside(nodes, behind, "li") if behind >= 0 else [], 1)]
            rows.append((heading, heading, level, sec + 1, raw, items, False, None, marks and n.box >= 0))
        if rows and heading.lower() not in skip:
            sec += 1
            out.extend(rows)
        return bool(rows)

    tests = (lambda n: n.name == "section" and n.attrs.get("data-title") == "Abstract", lambda n: n.attrs.get("id") == "Abs1-section", lambda n: n.name == "div" and n.attrs.get("data-title") == "Abstract")
    abstract = next((k for test in tests for k, n in enumerate(nodes) if test(n)), -1)
    seen = abstract >= 0 and emit("Abstract", 1, inside(nodes, abstract, "p"), False)
    head: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    owner: dict[int, int] = {-1: -1}
    every: list[int] = []
    for k in range(area + 1, len(nodes)):
        n = nodes[k]
        if n.open_at >= last:
            break
        if n.name in HEADS:  # the first heading of each section around it that has none
            s = n.section
            while s > area and s not in head:
                head[s] = k
                s = nodes[nodes[s].parent].section
        if n.name == "p":
            every.append(k)

    def title(s: int) -> str:
        return plain(page[nodes[head[s]].start : nodes[head[s]].end]) if s in head else plain(nodes[s].attrs.get("data-title", ""))

    titles = {k: title(k) for k in range(area + 1, len(nodes)) if nodes[k].section == k and nodes[k].open_at < last}
    for s, t in titles.items():
        above = owner.get(nodes[nodes[s].parent].section, -1)
        first_of_all = not seen and not any(held)
        owner[s] = above if above >= 0 else s if t and (t.lower() != "abstract" or first_of_all) else -1
        if owner[s] == s:
            held[s] = []
    for k in every:
        s = owner.get(nodes[k].section, -1)
        if s >= 0:
            held[s].append(k)
    for s, ps in held.items():
        seen = emit(titles[s], 2 if s in head and nodes[head[s]].name == "h3" else 1, ps, True) or seen
    if not seen:
        emit("Introduction", 1, every, False)
    return out
