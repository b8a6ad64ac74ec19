"""HTML text to a flat tree of nodes, and nodes to reading blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements without content, and elements that begin a block of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
SKIP = frozenset(("script", "style", "head", "template", "noscript"))


@dataclass
class Node:
    type: str
    path: tuple[int, ...]
    attrs: dict[str, str] = field(default_factory=dict)
    text: str | None = None
    children: list[Node] = field(default_factory=list)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", ())
        self.open = [self.root]

    def add(self, n: Node) -> Node:
        top = self.open[-1]
        n.path = (*top.path, len(top.children))
        top.children.append(n)
        return n

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and len(self.open) > 1 and self.open[-1].type == tag:
            self.open.pop()
        n = self.add(Node(tag, (), {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.add(Node(tag, (), {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].type == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if len(self.open) == 1 and not data.strip():
            return
        top = self.open[-1]
        if top.children and top.children[-1].type == "#text":
            top.children[-1].text += data
        elif data:
            self.add(Node("#text", (), {}, data))


def tree(html: str | None) -> Node:
    """The root of the parsed text; white space alone counts only inside elements."""
    b = _Builder()
    b.feed(re.sub(r"^﻿?\s*<\?xml[^>]*\?>", "", html or ""))
    b.close()
    return b.root


def walk(n: Node):
    for c in n.children:
        yield c
        yield from walk(c)


def text_of(n: Node) -> str:
    return n.text or "" if n.type == "#text" else "".join(map(text_of, n.children))


def serialize(n: Node) -> str:
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if n.type == "#text":
        return esc(n.text or "")
    inner = "".join(map(serialize, n.children))
    if n.type == "#root":
        return inner
    head = n.type + "".join(f' {k}="{esc(v).replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
    return f"<{head}/>" if n.type in VOID else f"<{head}>{inner}</{n.type}>"


def is_note(n: Node) -> bool:
    """A footnote's text, which stands outside the reading text."""
    marks = f"{n.attrs.get('epub:type', '')} {n.attrs.get('role', '')} {n.attrs.get('class', '')}".lower()
    return any(m in marks.split() for m in ("footnote", "footnotes", "endnote", "endnotes", "rearnote", "doc-footnote", "doc-endnotes"))


ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def marker(kind: str, n: int) -> str:
    """Marker of a list item."""
    if kind in "aA" and kind:
        out, k = "", n
        while k > 0:
            k, r = divmod(k - 1, 26)
            out = chr(97 + r) + out
        return (out.upper() if kind == "A" else out) + "."
    if kind in "iI" and kind:
        out, k = "", n
        for v, s in ROMAN:
            out, k = out + s * (k // v), k % v
        return (out.upper() if kind == "I" else out) + "."
    return f"{n}."


def squeeze(s: str) -> str:
    return "\n".join(re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in s.split("\n")).strip("\n")


def inline_text(n: Node) -> str:
    """Text of an element on one line for each br; images and notes leave nothing."""
    if n.type == "#text":
        return re.sub(r"\s+", " ", n.text or "")
    if n.type == "br":
        return "\n"
    if n.type in SKIP or n.type == "img" or is_note(n):
        return ""
    return "".join(map(inline_text, n.children))


def blocks(html: str | None) -> list[dict]:
    """Reading blocks in order: block_id, type, depth and text. Ids are the elements' own or the type with a running number."""
    out: list[dict] = []

    def emit(kind: str, text: str, depth: int = 0, own: str | None = None) -> None:
        out.append({"block_id": own or f"{kind}-{len(out)}", "block_type": kind, "depth": depth, "text": text})

    def visit(n: Node, lists: int) -> None:
        loose: list[str] = []

        def flush() -> None:
            text = squeeze("".join(loose))
            loose.clear()
            if text:
                emit("paragraph", text, lists)

        number = int(n.attrs["start"]) if n.type == "ol" and re.fullmatch(r"-?\d+", n.attrs.get("start", "")) else 1
        for c in n.children:
            t = c.type
            if t == "#text" or t not in BLOCK and t not in SKIP and t != "img" and not any(x.type in BLOCK or x.type == "img" for x in walk(c)):
                if not is_note(c):
                    loose.append(inline_text(c))
                continue
            if t in SKIP or is_note(c):
                continue
            flush()
            own = c.attrs.get("id")
            if re.fullmatch("h[1-6]", t):
                if text := squeeze(inline_text(c)):
                    emit("chapter" if t == "h1" else "heading", text, int(t[1]), own)
            elif t == "p":
                for img in (x for x in walk(c) if x.type == "img"):
                    emit("image", img.attrs.get("alt") or img.attrs.get("title") or "", 0, img.attrs.get("id"))
                text = squeeze(inline_text(c))
                if text:
                    emit("paragraph", text, 0, own)
                elif "\n" in inline_text(c):
                    emit("break", "", 0, own)
            elif t == "blockquote" and not any(x.type in BLOCK for x in walk(c)):
                if text := squeeze(inline_text(c)):
                    emit("blockquote", text, 0, own)
            elif t == "blockquote":
                first = len(out)
                visit(c, lists)
                for b in out[first:]:
                    if b["block_type"] == "paragraph":
                        b["block_type"] = "blockquote"
            elif t == "pre":
                if text_of(c).strip():
                    emit("pre", text_of(c).strip("\n"), 0, own)
            elif t == "li":
                nested = [x for x in c.children if x.type in ("ul", "ol")]
                text = squeeze("".join(inline_text(x) for x in c.children if x not in nested))
                mark = marker(n.attrs.get("type", ""), number) if n.type == "ol" else "•"
                number += 1
                if text:
                    emit("listItem", f"{mark} {text}", lists, own)
                for x in nested:
                    visit(x, lists + 1)
            elif t in ("ul", "ol"):
                visit(c, lists + 1)
            elif t == "table":
                rows = [[squeeze(inline_text(x)) for x in r.children if x.type in ("td", "th")] for r in walk(c) if r.type == "tr"]
                for k, r in enumerate(x for x in rows if any(x)):
                    emit("table", " ".join(x for x in r if x), 0, (own if not k else f"{own}-row-{k}") if own else None)
            elif t == "img":
                emit("image", c.attrs.get("alt") or c.attrs.get("title") or "", 0, own)
            elif t == "hr":
                emit("separator", "", 0, own)
            else:
                visit(c, lists)
        flush()

    visit(tree(html), 0)
    return out


def matches(n: Node, selector: str) -> bool:
    """One simple selector: tag, .class, #id, [attr], [attr=value], or these joined."""
    for kind, name, op, value in re.findall(r"([.#\[]?)([\w:-]+|\*)(?:(=)[\"']?([^\]\"']*)[\"']?)?\]?", selector):
        if kind == "." and name not in n.attrs.get("class", "").split():
            return False
        if kind == "#" and n.attrs.get("id") != name:
            return False
        if kind == "[" and (n.attrs.get(name) != value if op else not n.attrs.get(name)):
            return False
        if kind == "" and name not in ("*", n.type):
            return False
    return True


def edit(root: Node, path: tuple[int, ...], insert: Node | None = None, remove: bool = False, attrs: dict | None = None, text: str | None = None) -> Node:
    """Change the tree at a path and number its nodes anew."""
    top = root
    for i in path[:-1]:
        top = top.children[i]
    if insert is not None:
        top.children.insert(path[-1] if path else len(top.children), insert)
    elif path and path[-1] < len(top.children):
        n = top.children[path[-1]]
        if remove:
            del top.children[path[-1]]
        if attrs:
            n.attrs = n.attrs | attrs
        if text is not None and n.type == "#text":
            n.text = text

    def number(n: Node) -> None:
        for i, c in enumerate(n.children):
            c.path = (*n.path, i)
            number(c)

    number(root)
    return root
