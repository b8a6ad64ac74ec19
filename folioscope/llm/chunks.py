"""Cutting oversized items at natural boundaries, with an overlap.

Lexical cohesion: around every sentence end the word counts of the block before and the block after are compared by
cosine; a valley's depth is how far the similarity on both sides rises above it. Within each window of admissible
sizes the cut goes to the deepest valley, of equals to the later; without a sentence end to the best lesser boundary
(line, clause, blank), and without any to the limit, but never between a character and its combining marks.
The next piece begins `overlap` characters before the cut, so that pieces of limit size hold
limit - overlap new characters.

Null and empty texts have no piece; an item within the limit is one piece; a limit below 1 is an error.
All offsets count code points. Repeated rows give repeated pieces; ties are resolved by position.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spread

WORD = re.compile(r"\w+")
WIDE = re.compile("[぀-ヿ㐀-鿿฀-๿]")
ENDS = re.compile(r"(?:[.!?…][\"'”’»)\]]*(?=\s)|[。！？।][”」』）]*|\n+)\s*")
#: Lesser boundaries, the better first.
LESSER = [re.compile(r"[;:,，、；：—–]\s*"), re.compile(r"\s+"), re.compile(r"(?<=[^\w\s])(?=\w)|(?<=\w)(?=[^\w\s])")]
#: Sentences in the block on each side of a candidate, and the least share of a window's new text that a piece holds.
BLOCK, LEAST = 3, 0.5


def terms(text: str) -> Counter:
    """Words of a sentence; in scripts without blanks, pairs of characters."""
    out: Counter = Counter()
    for w in WORD.findall(text.lower()):
        if len(w) > 2 and WIDE.search(w):
            out.update(w[i : i + 2] for i in range(len(w) - 1))
        elif len(w) > 2:
            out[w] += 1
    return out


def cosine(a: Counter, b: Counter) -> float:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    dot = sum(v * large[k] for k, v in small.items() if k in large)
    return dot / sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0


def valleys(text: str) -> tuple[list[int], list[float]]:
    """Positions of sentence ends and the depth of the valley at each."""
    at = [m.end() for m in ENDS.finditer(text) if m.end() < len(text)]
    if not at:
        return [], []
    bounds = [0, *at, len(text)]
    bags = [terms(text[a:b]) for a, b in zip(bounds, bounds[1:])]
    left, right = Counter(), Counter()
    for b in bags[1 : BLOCK + 1]:
        right.update(b)
    sims = []
    for i in range(len(at)):  # blocks slide by one sentence
        left.update(bags[i])
        if i >= BLOCK:
            left.subtract(bags[i - BLOCK])
            left += Counter()
        if i:
            right.subtract(bags[i])
            right += Counter()
            if i + BLOCK < len(bags):
                right.update(bags[i + BLOCK])
        sims.append(cosine(left, right))
    depth = []
    n = len(sims)
    rise_l, rise_r = [0.0] * n, [0.0] * n
    for i in range(1, n):  # how far one climbs without going down again
        rise_l[i] = max(0.0, sims[i - 1] - sims[i]) + (rise_l[i - 1] if sims[i - 1] > sims[i] else 0.0)
    for i in range(n - 2, -1, -1):
        rise_r[i] = max(0.0, sims[i + 1] - sims[i]) + (rise_r[i + 1] if sims[i + 1] > sims[i] else 0.0)
    for i in range(n):
        depth.append(rise_l[i] + rise_r[i] + (0.5 if "\n" in text[max(0, at[i] - 2) : at[i]] else 0.0))
    return at, depth


def cut(text: str | None, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece."""
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("limit must be positive and larger than overlap")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    at, depth = valleys(text)
    out, start = [], 0
    while len(text) - start > limit:
        new = start + overlap if start else 0
        low, high = new + max(1, int((limit - (new - start)) * LEAST)), start + limit
        i, j = bisect_left(at, low), bisect_right(at, high)
        if i == j:  # sooner a short piece than a cut sentence
            i = max(bisect_left(at, new + 1), j - 1)
        if i < j:
            end = at[max(range(i, j), key=lambda k: (depth[k], at[k]))]
        else:
            end = 0
            for p in LESSER:
                for m in p.finditer(text, low, high):
                    if m.end() <= high:
                        end = m.end()
                if end:
                    break
            end = end or high
            while end > new + 1 and unicodedata.combining(text[end]):
                end -= 1
        out.append((start, end))
        start = max(end - overlap, start + 1)
    return [*out, (start, len(text))]


def split_items(df: DataFrame, key: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """Pieces of the items over the limit: the key, piece, n_pieces, piece_start, piece_end, piece_text. Shorter items
    are filtered by the engine and never reach Python."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(key)).to_pylist()
        rows, own = [], []
        for i, t in enumerate(texts):
            spans = cut(t, limit, overlap)
            rows += [(k, len(spans), a, b, t[a:b]) for k, (a, b) in enumerate(spans)]
            own += [i] * len(spans)
        take = pa.array(own, pa.int64())
        cols = [batch.column(i).take(take) for i in range(len(key))]
        values = zip(*rows) if rows else [[]] * 5
        cols += [pa.array(list(v), t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=[*key, "piece", "n_pieces", "piece_start", "piece_end", "piece_text"])

    large = df.filter(F.length(text) > limit).select(*key, text)
    return map_rows(large, f"{schema}, piece int, n_pieces int, piece_start long, piece_end long, piece_text string", text, kernel)


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """The part of a text between two UTF-16 offsets, clamped to it. A null start is 0, a null end the text's end.
    Texts without characters beyond the basic plane are cut by code points, which is the same."""
    astral = text.rlike("[\\x{10000}-\\x{10FFFF}]")
    size = F.when(astral, F.octet_length(F.encode(text, "UTF-16BE")) / 2).otherwise(F.length(text)).cast("int")
    a = F.least(F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)), size)
    b = F.least(F.greatest(F.coalesce(end, size), F.lit(0)), size)
    plain = F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    wide = F.decode(F.substring(F.encode(text, "UTF-16BE"), 2 * a + 1, F.greatest(2 * (b - a), F.lit(0))), "UTF-16BE")
    return F.when(astral, wide).otherwise(plain)


def narration_texts(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """segment_uid and the text of each narration segment: an equi-join on the block's own key, which stays narrow
    however large a book is. Several deliveries of a block count once."""
    one = blocks.filter(F.col("text").isNotNull()).groupBy("book_id", "unit_index", F.col("block_index").alias("b")).agg(F.max("text").alias("text"))
    segs = segments.select("segment_uid", "book_id", "unit_index", "b", "s", "e")
    return segs.join(one, ["book_id", "unit_index", "b"]).select("segment_uid", utf16_slice(F.col("text"), F.col("s"), F.col("e")).alias("text"))
