"""Greedy folds whose next step depends on the last: packing, merging, wrapping. They run over Arrow batches, one bounded
group (a block or a section) at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^。！？.!?；;]+[。！？.!?；;]*")


def split_text(text: str | None, most: int) -> list[str]:
    """Sentences packed to at most so many characters, joined by one blank; a longer sentence stays whole."""
    out: list[str] = []
    for s in (x.strip() for x in SENTENCE.findall(text or "")):
        if not s:
            continue
        if out and len(out[-1]) + 1 + len(s) <= most:
            out[-1] += " " + s
        else:
            out.append(s)
    plain = (text or "").strip()
    return out or [plain[i : i + most] for i in range(0, len(plain), most)]


def narration(blocks: DataFrame, most: int = 100) -> DataFrame:
    """Narration pieces of each block: book_id, unit_index, block_index, piece_index, piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, p) for i, t in enumerate(b.column(3).to_pylist()) for k, p in enumerate(split_text(t, most))]
            own = pa.array([r[0] for r in rows], pa.int64())
            cols = [b.column(i).take(own) for i in range(3)] + [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["book_id", "unit_index", "block_index", "piece_index", "piece"])

    kinds = F.col("block_type").isin("paragraph", "heading", "listItem", "blockquote", "pre", "table")
    return blocks.filter(kinds).select("book_id", "unit_index", "block_index", "text").mapInArrow(run, "book_id long, unit_index int, block_index int, piece_index int, piece string")


def batches_of(blocks: DataFrame, most: int = 2000) -> DataFrame:
    """Blocks of each unit packed in order into batches of at most so many characters; a larger one is alone."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("block_index")
        number, room, out = -1, 0, []
        for n in t.column("n").to_pylist():
            if number < 0 or n > room:
                number, room = number + 1, most
            room -= n
            out.append(number)
        return t.append_column("batch_index", pa.array(out, pa.int32())).drop_columns(["n"])

    rows = blocks.filter(F.col("text").isNotNull()).select("book_id", "unit_index", "block_index", F.length("text").alias("n"))
    return rows.groupBy("book_id", "unit_index").applyInArrow(run, "book_id long, unit_index int, block_index int, batch_index int")


def width(text: str) -> float:
    return sum(0.32 if c.isspace() else 1.0 if "一" <= c <= "鿿" else 0.54 for c in text)


def wrapped_lines(text: str, room: float) -> int:
    """Lines a text takes if words are wrapped greedily."""
    lines, used = 1, 0.0
    for w in re.findall(r"\s+|[一-鿿]|[^\s一-鿿]+", text):
        n = width(w)
        if used and used + n > room and not w.isspace():
            lines, used = lines + 1, 0.0
        used += n
    return lines
