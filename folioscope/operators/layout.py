"""Blocks of a unit laid out as lines on pages, with estimated widths in place of a browser's measurer.

A unit's blocks are brought together in order and laid out one after the other by the task that holds them; rows stream, so a task holds
one unit at a time. Widths are those of text_width(): a blank .32 of the type size, a Han sign 1, any other sign .54. Scripts that are mostly
Han, kana or hangul break between any two signs; others break at blanks, as a simple greedy breaker does."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.inline import text_width

CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿가-힯]")
#: Type size, line height, and gaps before and after by kind of block, in parts of the base size.
PRESETS = {"chapter": (1.55, 1.45, 1.2, 1.2), "blockquote": (1.0, None, 0.0, 0.0), "pre": (0.92, 1.55, 0.6, 0.6), "listItem": (1.0, None, 0.0, 0.35), "table": (0.8, 1.25, 0.5, 0.5), "paragraph": (1.0, None, 0.75, 0.75)}


def preset(kind: str | None, size: float, lead: float, depth: int | None = None) -> tuple[float, float, float, float]:
    """Type size, line height, gap before and gap after of a block."""
    if kind == "heading":
        return size * max(1.08, 1.42 - (2 if depth is None else depth) * 0.08), 1.45, size * 0.9, size * 0.6
    scale, own, before, after = PRESETS.get(kind or "", (1.0, None, 0.0, 0.75))
    return size * scale, own or lead, size * before, size * after


def is_dense(text: str) -> bool:
    """Whether lines may break between signs: four or more, and at least 35 of a hundred of them Han, kana or hangul."""
    if text.isascii():
        return False
    solid = len(text) - sum(map(str.isspace, text))
    return solid >= 4 and len(CJK.findall(text)) >= 0.35 * solid


@lru_cache(100_000)
def word_width(word: str) -> float:
    return text_width(word)


def broken(text: str, room: float, size: float) -> list[str]:
    """Lines of a text in a column. Dense text is cut where the running width passes the room, at the last place where it may break; a sign wider than the column stands alone."""
    out: list[str] = []
    blank = text_width(" ", size)
    for part in text.split("\n"):
        if not is_dense(part):
            line, used = "", 0.0
            for w in part.split():
                wide = word_width(w) * size
                if line and used + blank + wide > room:
                    out.append(line)
                    line, used = "", 0.0
                line, used = (f"{line} {w}", used + blank + wide) if line else (w, wide)
                if used > room and line == w:  # a word wider than the column
                    run = [0.0, *accumulate(text_width(c, size) for c in w)]
                    at = 0
                    while run[-1] - run[at] > room and len(w) - at > 1:
                        end = max(at + 1, bisect_right(run, run[at] + room + 1e-9) - 1)
                        out.append(w[at:end])
                        at = end
                    line, used = w[at:], run[-1] - run[at]
            if line or not part.strip():
                out.append(line)
            continue
        run = [0.0, *accumulate(text_width(c, size) for c in part)]
        at, n = len(part) - len(part.lstrip(" \t")), len(part)
        while at < n:
            end = min(n, max(at + 1, bisect_right(run, run[at] + room + 1e-9) - 1))
            if end < n:
                k = end
                while k > at and not (part[k - 1] in " \t" or part[k] in " \t" or CJK.match(part[k - 1]) or CJK.match(part[k])):
                    k -= 1
                end = k if k > at else end
            out.append(part[at:end].rstrip(" \t"))
            at = end
            while at < n and part[at] in " \t":
                at += 1
    return out


def kept(top: float, height: float, page: float | None, line: float = 0.0, whole: bool = False) -> float:
    """Where something of a height begins so that no page's end cuts it: there, or at the top of the next page. What is meant to stay whole also
    begins a page if it is as high as one."""
    if not page:
        return top
    at = top % page
    if not at or at + height <= page and not (whole and height >= page):
        return top
    return top + (max(line, page - at) if whole else page - at)


def laid_out(blocks: list[dict], room: float, size: float = 17.0, lead: float = 1.7, page: float | None = None) -> list[dict]:
    """Lines of a unit's blocks: block_index, kind, text, top, height and width. Blocks without content are left out, and gaps stand only behind something."""
    out: list[dict] = []
    top, base = 0.0, size * lead
    for b in blocks:
        kind, text = b["block_type"], b["text"] or ""
        solid = kind in ("image", "break", "separator")
        if not solid and not text.strip():
            continue
        own, own_lead, before, after = preset(kind, size, lead, b.get("depth"))
        top += before if out else 0.0
        put = lambda kind, text, width, height: out.append({"block_index": b["block_index"], "line_index": len(out), "kind": kind, "text": text, "top": top, "height": height, "width": width})  # noqa: B023, E731
        if kind == "image":
            height = max(2 * base, min(page or float("inf"), room * 0.75))
            top = kept(top, height, page, base, True)
            put("image", text, room, height)
            top += height
        elif kind in ("break", "separator"):
            top = kept(top, base, page)
            put("text" if kind == "break" else "separator", "", 0.0 if kind == "break" else room, base)
            top += base
        elif kind in ("pre", "table"):
            lines = broken(text, room, own)
            height = len(lines) * own * own_lead + (own * 1.5 if kind == "pre" else own * 0.9)
            height = max(2 * base if kind == "pre" else 1.5 * own * own_lead, min(page or height, height))
            top = kept(top, height, page, base, True)
            put(kind, "\n".join(lines), room, height)
            top += height
        else:
            height = own * own_lead
            for line in broken(text, room, own):
                top = kept(top, height, page)
                put("text", line, text_width(line, own), height)
                top += height
        top += after
    return out


def lines(blocks: DataFrame, room: float = 326.0, size: float = 17.0, lead: float = 1.7, page: float | None = 676.0) -> DataFrame:
    """book_id, unit_index, block_index, line_index, kind, text, top, height, width. blocks: each once, with block_type and text."""
    cols = ["book_id", "unit_index", "block_index", "block_type", "text"]
    schema = "book_id long, unit_index int, block_index int, line_index int, kind string, text string, top double, height double, width double"
    arrow = pa.schema([("book_id", pa.int64()), ("unit_index", pa.int32()), ("block_index", pa.int32()), ("line_index", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("top", pa.float64()), ("height", pa.float64()), ("width", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, []

        def out() -> pa.RecordBatch:
            rows = [{"book_id": unit[0], "unit_index": unit[1], **x} for x in laid_out(own, room, size, lead, page)]
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for b in batches:
            for r in b.to_pylist():
                if (r["book_id"], r["unit_index"]) != unit:
                    if own:
                        yield out()
                    unit, own = (r["book_id"], r["unit_index"]), []
                own.append(r)
        if own:
            yield out()

    rows = blocks.select(*cols, "block_uid").repartition("book_id", "unit_index").sortWithinPartitions("book_id", "unit_index", "block_index", "block_uid").select(*cols)
    return rows.mapInArrow(run, schema)


def visible(lines: DataFrame, top: float, height: float, overscan: int = 2) -> DataFrame:
    """Lines in view, and so many before and behind them in each unit."""
    from pyspark.sql import Window as W

    inside = (F.col("top") < top + height) & (F.col("top") + F.col("height") > top)
    w = W.partitionBy("book_id", "unit_index")
    span = lines.withColumns({"_a": F.min(F.when(inside, F.col("line_index"))).over(w), "_b": F.max(F.when(inside, F.col("line_index"))).over(w)})
    return span.filter(F.col("line_index").between(F.col("_a") - overscan, F.col("_b") + overscan)).drop("_a", "_b")


def page_of(top: Column, page: float) -> Column:
    """Page a place lies on, and how far through the unit's pages that is: columns page_index and fraction need pages(), the number of pages."""
    return F.floor(top / page).cast("int")


def page_fractions(lines: DataFrame, page: float) -> DataFrame:
    """Pages of each unit and the fraction of the unit at which each begins."""
    from pyspark.sql import Window as W

    pages = lines.groupBy("book_id", "unit_index", page_of(F.col("top"), page).alias("page_index")).agg(F.count("*").alias("lines"), F.min("line_index").alias("first_line"))
    last = F.max("page_index").over(W.partitionBy("book_id", "unit_index"))
    return pages.withColumn("fraction", F.when(last > 0, F.col("page_index") / last).otherwise(F.lit(0.0)))
