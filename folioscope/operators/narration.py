"""Speech and narration inside blocks, estimates of their duration, stable places for speakers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK

#: Pairs of quotation marks.
PAIRS = (("“", "”"), ("「", "」"), ("『", "』"), ("«", "»"), ("„", "“"))
SENTENCE = re.compile(r"[^。！？.!?；;\n]+[。！？.!?；;]*|\n+")


def quoted(text: str) -> list[tuple[int, int]]:
    """Start and end of each quotation, by start; one inside another isn't one of its own."""
    found = [m.span() for a, b in PAIRS for m in re.finditer(re.escape(a) + "[^" + re.escape(a + b) + "]*" + re.escape(b), text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def atoms(text: str) -> list[tuple[int, int, bool]]:
    """Quotations whole, what stands between them by sentence; the flag says which."""
    out: list[tuple[int, int, bool]] = []
    at = 0
    for a, b in [*quoted(text), (len(text), len(text))]:
        for m in SENTENCE.finditer(text, at, a):
            if m.group().strip():
                out.append((m.start(), m.end(), False))
        if b > a:
            out.append((a, b, True))
        at = b
    return out


def atom_rows(blocks: DataFrame) -> DataFrame:
    """book_id, unit_index, block_index, atom_index, start_offset, end_offset, is_speech."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *x) for i, t in enumerate(b.column(3).to_pylist()) for k, x in enumerate(atoms(t or ""))]
            own = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(i).take(own) for i in range(3)] + made, names=["book_id", "unit_index", "block_index", "atom_index", "start_offset", "end_offset", "is_speech"])

    return blocks.select("book_id", "unit_index", "block_index", "text").mapInArrow(run, "book_id long, unit_index int, block_index int, atom_index int, start_offset int, end_offset int, is_speech boolean")


def duration_ms(text: Column) -> Column:
    """Estimate: 180 for an ideograph, 260 for a word, 120 for a mark; between 450 and 30000."""
    cjk = F.regexp_count(text, F.lit(CJK))
    word = F.regexp_count(text, F.lit("[A-Za-z0-9]+"))
    mark = F.regexp_count(text, F.lit(r"[.,!?;:。，！？；：、]"))
    return F.least(F.greatest(cjk * 180 + word * 260 + mark * 120, F.lit(450)), F.lit(30000))


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
    return h


def pan(speaker: str) -> float:
    """A place from -1 to 1 that stays the same for a speaker."""
    return (fnv1a(speaker) % 2001 - 1000) / 1000


def collapsed(text: str) -> tuple[str, list[int]]:
    """Text with each run of white space as one blank, none at its ends, and the offset in the source of each of its characters."""
    out: list[str] = []
    at: list[int] = []
    gap = None
    for i, c in enumerate(text):
        if c.isspace():
            gap = i if gap is None and out else gap
            continue
        if gap is not None:
            out.append(" ")
            at.append(gap)
            gap = None
        out.append(c)
        at.append(i)
    return "".join(out), at


def source_range(at: list[int], start: int, end: int) -> tuple[int, int]:
    """Source offsets of a range of collapsed text, clamped to it; an empty map gives 0."""
    if not at:
        return 0, 0
    a, b = min(max(0, start), len(at) - 1), min(max(0, end), len(at))
    return at[a], at[b - 1] + 1 if b else at[0]


REFERENCES = re.compile(r"[\s\xa0]*[\[［]\s*\d{1,4}\s*[\]］]|[\s\xa0]*[¹²³⁴⁵⁶⁷⁸⁹⁰]+")


def readable(text: str) -> tuple[str, list[int]]:
    """As collapsed(), without references to notes; offsets still count in the text as it was."""
    gone = [False] * len(text)
    for m in REFERENCES.finditer(text):
        gone[m.start() : m.end()] = [True] * (m.end() - m.start())
    kept = [i for i, g in enumerate(gone) if not g]
    out, at = collapsed("".join(text[i] for i in kept))
    return out, [kept[i] for i in at]


SILENT = re.compile("[\\s\"'“”‘’「」『』()\\[\\]{}<>《》。，、？！：；,.!?;:\\-—–…]+")


def is_mixed(text: str) -> bool:
    """Whether a text holds both quoted speech and narration that can be spoken."""
    spans = quoted(text)
    rest, at = [], 0
    for a, b in spans:
        rest.append(text[at:a])
        at = b
    rest.append(text[at:])
    return bool(SILENT.sub("", "".join(rest))) and any(SILENT.sub("", text[a:b]) for a, b in spans)


def selection(text: str, offset: int, unit: str) -> tuple[int, int]:
    """The word, sentence or paragraph around a place. Words are runs of letters, figures and marks; in scripts without blanks, single signs."""
    n = len(text)
    offset = min(max(0, offset), max(0, n - 1))
    pattern = {"word": r"[^\W\u3040-\u30ff\u3400-\u9fff]+(?:['’-][^\W\u3040-\u30ff\u3400-\u9fff]+)*|\S", "sentence": SENTENCE.pattern, "paragraph": r"[^\n]+"}[unit]
    for m in re.finditer(pattern, text):
        if m.start() <= offset < m.end() and m.group().strip():
            a, b = m.span()
            return a + len(m.group()) - len(m.group().lstrip()), b - (len(m.group()) - len(m.group().rstrip()))
    return offset, offset


def joined(a: str, b: str) -> str:
    """Two texts put together: a blank comes between only where an ASCII letter or figure meets another."""
    alnum = lambda c: c.isascii() and c.isalnum()
    return a + " " + b if a and b and alnum(a[-1]) and alnum(b[0]) else a + b


def merged_segments(segments: DataFrame, same: list[str], most: int, gap: int = 8) -> DataFrame:
    """Neighbouring segments of a block put together while all attributes in same agree, the gap is small and the text stays within a length. segments: segment_uid, book_id,
    unit_index, block_index, start_offset, end_offset, text and the attributes. Only the segment in hand is kept while a unit's rows go by."""
    keys = ["book_id", "unit_index", "block_index"]
    columns = ["segment_uid", *keys, "start_offset", "end_offset", "text", *same]
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", n_merged int"
    rows = segments.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "start_offset", "end_offset", "segment_uid")
    arrow = pa.schema([*_arrow(rows), pa.field("n_merged", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand, out = None, []
        for b in batches:
            for r in b.to_pylist():
                r["n_merged"] = 1
                if hand is not None and all(hand[k] == r[k] for k in (*keys, *same)) and 0 <= r["start_offset"] - hand["end_offset"] <= gap and len(text := joined(hand["text"], r["text"])) <= most:
                    hand |= {"text": text, "end_offset": r["end_offset"], "n_merged": hand["n_merged"] + 1}
                    continue
                if hand is not None:
                    out.append(hand)
                hand = r
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if hand is not None:
            out.append(hand)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
