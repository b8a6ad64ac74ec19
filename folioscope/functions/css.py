"""Style declarations and class rules."""

from __future__ import annotations

import re
from dataclasses import dataclass


def declarations(text: str | None) -> dict[str, str]:
    """Properties of a style attribute or rule body; later ones win, names in lower case, !important dropped."""
    out: dict[str, str] = {}
    for part in re.split(r";(?![^(]*\))", re.sub(r"(?s)/\*.*?\*/", "", text or "")):
        name, colon, value = part.partition(":")
        value = re.sub(r"\s*!important\s*$", "", value.strip(), flags=re.I)
        if colon and name.strip() and value:
            out[name.strip().lower()] = value
    return out


@dataclass(frozen=True)
class Rule:
    tag: str
    classes: frozenset[str]
    order: int
    style: tuple[tuple[str, str], ...]


class Sheet:
    """Rules of the form tag.class.class, found by their first class."""

    def __init__(self, text: str):
        self.by_class: dict[str, list[Rule]] = {}
        clean = re.sub(r"(?s)/\*.*?\*/|@media[^{]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[\w-]+[^;{]*;", "", text)
        order = 0
        for heads, body in re.findall(r"([^{}]+)\{([^{}]*)\}", clean):
            style = tuple(declarations(body).items())
            for head in heads.split(","):
                m = re.fullmatch(r"\s*([\w-]*)((?:\.[\w-]+)+)\s*", head)
                if m and style:
                    names = m.group(2)[1:].split(".")
                    self.by_class.setdefault(names[0], []).append(Rule(m.group(1).lower(), frozenset(names), order, style))
                order += 1

    def style(self, tag: str, classes: str) -> dict[str, str]:
        """What all matching rules say, in the order of the sheet."""
        own = set(classes.split())
        hits = {r for c in own for r in self.by_class.get(c, ()) if r.classes <= own and r.tag in ("", tag.lower())}
        out: dict[str, str] = {}
        for r in sorted(hits, key=lambda r: r.order):
            out |= dict(r.style)
        return out


def imports(text: str) -> list[str]:
    return [a or b for a, b in re.findall(r"""@import\s+(?:url\(\s*["']?([^"')]+)["']?\s*\)|["']([^"']+)["'])""", text)]


def length(value: str | None, base: float = 16.0) -> float | None:
    """A length in pixels; null where there is none."""
    m = re.fullmatch(r"\s*(-?[\d.]+)(px|pt|em|rem|%|in|cm|mm)?\s*", value or "")
    if not m:
        return None
    factor = {"px": 1.0, None: 1.0, "pt": 4 / 3, "em": base, "rem": base, "%": base / 100, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4}
    return float(m.group(1)) * factor[m.group(2)]
