"""Inline text of HTML: styled segments, the parts notes play, and tables with the weights of their columns."""

from __future__ import annotations

import re

from .css import declarations, length
from .html import BLOCK, SKIP, Node, is_note, squeeze, text_of, tree, walk

#: What elements say of the style of their text.
ELEMENT_STYLE = {
    "b": {"weight": "700"}, "strong": {"weight": "700"}, "i": {"style": "italic"}, "em": {"style": "italic"}, "cite": {"style": "italic"}, "code": {"family": "monospace"}, "kbd": {"family": "monospace"},
    "tt": {"family": "monospace"}, "u": {"decoration": "underline"}, "s": {"decoration": "line-through"}, "del": {"decoration": "line-through"}, "sup": {"align": "super"}, "sub": {"align": "sub"},
}
PROPERTIES = {"font-weight": "weight", "font-style": "style", "font-family": "family", "text-decoration": "decoration", "vertical-align": "align", "color": "color", "font-size": "size", "letter-spacing": "spacing"}
#: Marks of references to notes, and forms of their anchors and texts.
REFERENCE = frozenset(("noteref", "doc-noteref", "footnote-ref", "epub-footnote", "epub-footnote1"))
ANCHOR = re.compile(r"(?:m|fn|footnote|note|endnote|en)[-_]?\d{1,4}", re.I)
NUMBER = re.compile(r"\s*[\[［(（]?\d{1,4}[)\]］）]?\s*")
OBJECT = "￼"


def is_reference(n: Node) -> bool:
    """Whether an element points to a note: by its marks, or as a link to an anchor of a note whose text is only a number."""
    marks = " ".join(n.attrs.get(k, "") for k in ("epub:type", "type", "role", "rel", "class")).lower().split()
    if REFERENCE & set(marks):
        return True
    href = n.attrs.get("href") or n.attrs.get("xlink:href") or ""
    return n.type == "a" and "#" in href and bool(ANCHOR.fullmatch(href.rpartition("#")[2].strip())) and bool(NUMBER.fullmatch(text_of(n)))


def styled(style: dict[str, str], n: Node) -> dict[str, str]:
    """The style inside an element: what it inherits, what the element means, what its own declarations say."""
    own = {PROPERTIES[k]: v for k, v in declarations(n.attrs.get("style")).items() if k in PROPERTIES}
    return style | ELEMENT_STYLE.get(n.type, {}) | own


def inline(n: Node, style: dict[str, str] | None = None, lists: bool = True) -> list[dict]:
    """Segments of an element as they stand: text, style and source (the kind of node, and whether it points to a note). A br is a line end, a block inside ends with one, an
    image is one object sign; lists inside can be left out."""
    out: list[dict] = []

    def visit(c: Node, style: dict[str, str], role: str) -> None:
        if c.type == "#text":
            if c.text:
                out.append({"text": c.text, "style": style, "source": "text", "role": role})
            return
        if c.type in SKIP or is_note(c) or not lists and c.type in ("ul", "ol"):
            return
        role = "noteref" if is_reference(c) else role
        if c.type == "br":
            out.append({"text": "\n", "style": style, "source": "br", "role": role})
        elif c.type == "img":
            out.append({"text": OBJECT, "style": style, "source": "img", "role": role})
        else:
            inner = styled(style, c)
            for x in c.children:
                visit(x, inner, role)
            if c.type in BLOCK:
                out.append({"text": "\n", "style": style, "source": c.type, "role": role})

    for c in n.children:
        visit(c, style or {}, "")
    return out


def normalized(segments: list[dict]) -> list[dict]:
    """Blanks squeezed, neighbours of one style and source joined, no line end at either edge."""
    out: list[dict] = []
    for s in segments:
        text = re.sub(r"[ \t\r\n\f]+" if s["source"] == "text" else r"[ \t\r\f]+", " ", s["text"])
        if not text:
            continue
        if out and all(out[-1][k] == s[k] for k in ("style", "source", "role")):
            out[-1] = out[-1] | {"text": out[-1]["text"] + text}
        else:
            out.append(s | {"text": text})
    while out and not (text := out[0]["text"].lstrip("\n")):
        out.pop(0)
    if out:
        out[0] = out[0] | {"text": text}
    while out and not (text := out[-1]["text"].rstrip("\n")):
        out.pop()
    if out:
        out[-1] = out[-1] | {"text": text}
    return out


def to_blocks(segments: list[dict]) -> list[list[dict]]:
    """Segments parted at line ends; empty parts are no blocks."""
    out: list[list[dict]] = [[]]
    for s in segments:
        for k, piece in enumerate(s["text"].split("\n")):
            if k:
                out.append([])
            if piece:
                out[-1].append(s | {"text": piece})
    return [b for b in out if b]


def document_segments(html: str | None) -> list[dict]:
    """Normalised segments of a whole document, each with the number of its block."""
    found = to_blocks(normalized(inline(tree(html))))
    return [s | {"block": k} for k, b in enumerate(found) for s in b]


#: Least weight of a column, most by content, and how content counts.
LEAST, MOST, MEDIUM, MEDIUM_PART, PART, DENSITY = 6.0, 80.0, 24.0, 0.75, 0.35, 0.14


def text_width(text: str, size: float = 1.0) -> float:
    return size * sum(0.32 if c == " " else 1.0 if "一" <= c <= "鿿" else 0.54 for c in text)


def percent(value: str | None) -> float | None:
    m = re.search(r"(?:^|width\s*:)\s*(\d+(?:\.\d+)?)%", value or "")
    return float(m.group(1)) if m and float(m.group(1)) > 0 else None


def column_weights(table: Node, rows: list[list[dict]], n: int) -> list[float] | None:
    """Widths the table names, in its columns or in the first full row, or else weights by content: a column's widest cell, and how much stands in all of it."""
    named = [percent(c.attrs.get("style")) or percent(c.attrs.get("width")) for c in walk(table) if c.type == "col"]
    named = [w for w in named if w]
    if len(named) == n:
        return named
    first = next((r for r in rows if len(r) == n and all(c["colspan"] == 1 for c in r)), None)
    if first and all(c["width"] for c in first):
        return [c["width"] for c in first]
    if n < 2:
        return None
    widest, total = [0.0] * n, [0.0] * n
    for r in rows:
        at = 0
        for c in r:
            if at >= n:
                break
            span = min(c["colspan"], n - at)
            whole = text_width(c["text"])
            cell = max(LEAST, max(map(text_width, c["text"].split()), default=0.0), min(MEDIUM, whole * MEDIUM_PART), min(MOST, whole * PART)) if c["text"] else LEAST
            for k in range(at, at + span):
                widest[k] = max(widest[k], cell / span)
                total[k] += (whole if c["text"] else 0.0) / span
            at += span
    return [max(LEAST, a, min(MOST, b * DENSITY)) for a, b in zip(widest, total)]


def tables(html: str | None) -> list[dict]:
    """Tables in order: how many columns, their weights, and rows of cells with text, spans and whether they head a column. Rows without text are kept."""

    def number(value: str | None) -> int:
        return max(1, int(value)) if value and value.strip().isdigit() else 1

    out = []
    for t in (x for x in walk(tree(html)) if x.type == "table"):
        rows = [
            [{"text": squeeze(text_of(c)), "colspan": number(c.attrs.get("colspan")), "rowspan": number(c.attrs.get("rowspan")), "header": c.type == "th", "width": percent(c.attrs.get("style")) or percent(c.attrs.get("width"))} for c in r.children if c.type in ("td", "th")]
            for r in walk(t) if r.type == "tr"
        ]
        n = max((sum(c["colspan"] for c in r) for r in rows), default=0)
        if n:
            out.append({"column_count": n, "weights": column_weights(t, rows, n), "rows": rows})
    return out


def image_box(width: float | None, height: float | None, style: str | None, room: float, line: float, most: float | None = None, cover: bool = False) -> tuple[float, float]:
    """Width and height of an image in a column of some width: its own or declared width up to the column's, then its proportions, within the page."""
    own = declarations(style)
    widest = min(room, length(own.get("max-width"), room) or room)
    w = max(1.0, min(widest, length(own.get("width"), room) or width or widest))
    h = length(own.get("height")) or (w / (width / height) if width and height else height or (most or w * 1.35 if cover else w * 0.75))
    top = length(own.get("max-height")) or float("inf")
    top = max(2 * line, min(most, top)) if most else top
    return w, max(2 * line, min(top, h))
