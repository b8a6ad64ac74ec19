"""Literal search over blocks of text units.

A block is split at the lower-cased query; the running length of the parts gives each hit's place, so hits don't overlap and
run from left to right. Blocks that don't contain the query are filtered before anything is generated, and what is shuffled are keys,
places and excerpts, never whole texts. A block that is delivered several times counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import quote

CONTEXT = 48
BLOCK = ("book_id", "unit_index", "block_index")
ORDER = (*BLOCK, "start_offset")


def places(text: Column, query: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """Where the query begins in a text, from left to right."""
    needle = query if case_sensitive else query.lower()
    parts = F.split(text if case_sensitive else F.lower(text), quote(needle), -1)
    # The place of hit k is the length of the parts before it and of the k hits before it.
    found = F.aggregate(
        F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.length(x)),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
        lambda a, n: F.struct((a["at"] + n + len(needle)).alias("at"), F.concat(a["all"], F.array(a["at"] + n)).alias("all")),
    )["all"]
    if not whole_word:
        return found
    word = r"[\p{L}\p{N}_]"
    before = lambda at: (at > 0) & F.substring(text, at, F.lit(1)).rlike(word)
    return F.filter(found, lambda at: ~(before(at) | F.substring(text, at + len(needle) + 1, F.lit(1)).rlike(word)))


def holding(blocks: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Blocks that contain the query; none for an empty one."""
    if not query:
        return blocks.filter(F.lit(False))
    return blocks.filter(F.contains(F.col("text") if case_sensitive else F.lower("text"), F.lit(query if case_sensitive else query.lower())))


def excerpt(text: Column, start: Column, size: int, context: int = CONTEXT) -> Column:
    """The hit with what stands around it, dots only where it is cut."""
    a, b = F.greatest(start - context, F.lit(0)), F.least(start + size + context, F.length(text))
    return F.concat(F.when(a > 0, "...").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "...").otherwise(""))


def with_excerpt(found: DataFrame, size: int, context: int = CONTEXT) -> DataFrame:
    """Adds end_offset, match_text and the excerpt to rows with text and start_offset."""
    start = F.col("start_offset")
    return found.withColumns({"end_offset": start + size, "match_text": F.substring("text", start + 1, F.lit(size)), "excerpt": excerpt(F.col("text"), start, size, context)})


def numbered(rows: DataFrame) -> DataFrame:
    unit = W.partitionBy("book_id", "unit_index").orderBy("block_index", "start_offset")
    return rows.withColumn("match_index", F.row_number().over(unit) - 1)


def hits(blocks: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False, context: int = CONTEXT) -> DataFrame:
    """blocks: book_id, unit_index, block_index, text. One row for each hit, with its offsets, text, excerpt and match_index."""
    at = holding(blocks, query, case_sensitive).withColumn("start_offset", F.explode(places(F.col("text"), query or "-", case_sensitive, whole_word)))
    return numbered(with_excerpt(at, len(query), context).select(*ORDER, "end_offset", "match_text", "excerpt").dropDuplicates(list(ORDER)))


def first_hits(blocks: DataFrame, query: str, order: list[str], limit: int, context: int = CONTEXT, extra: dict[str, Column] | None = None, **options) -> DataFrame:
    """The first hits in an order that takes units whole. Keys and places alone are ordered; the few that stay fetch their texts."""
    found = holding(blocks, query, options.get("case_sensitive", False)).select(*BLOCK, places(F.col("text"), query or "-", **options).alias("_at")).distinct()
    keys = found.select(*BLOCK, F.explode("_at").alias("start_offset")).withColumns(extra or {})
    # All hits of a unit before one that stays, stay too, so they can be numbered among themselves.
    top = numbered(keys.orderBy(*order).limit(max(0, limit)))
    return with_excerpt(blocks.select(*BLOCK, "text").join(F.broadcast(top), list(BLOCK)), len(query), context).drop("text").dropDuplicates(list(ORDER))


def search_book(blocks: DataFrame, query: str, limit: int = 100, **options) -> DataFrame:
    """The first hits of all blocks in reading order."""
    return first_hits(blocks, query, list(ORDER), limit, **options)


def search_units(blocks: DataFrame, query: str, per_unit: int = 3, **options) -> DataFrame:
    """The first hits of each unit."""
    return hits(blocks, query, **options).filter(F.col("match_index") < per_unit)


def search_scope(blocks: DataFrame, query: str, units: list[int], limit: int = 100) -> DataFrame:
    """Units in the order given, repeated and unknown ones dropped."""
    order = list(dict.fromkeys(units))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("unit_index")).cast("int") - 1
    return first_hits(blocks.filter(F.col("unit_index").isin(order)), query, ["book_id", "scope_rank", "block_index", "start_offset"], limit, extra={"scope_rank": rank})


def chunks_containing(chunks: DataFrame, query: str) -> DataFrame:
    """One hit for each chunk that contains the trimmed query in any case; score 1."""
    return holding(chunks, query.strip()).withColumn("score", F.lit(1))


def provider_search(chunks: DataFrame, query: str, start: tuple[int, int] | None = None, end: tuple[int, int] | None = None) -> DataFrame:
    """Chunk search inside a range of (unit, block) places, both ends included; no range is the whole book."""
    place = F.struct("unit_index", "block_index")
    bound = lambda p: F.struct(F.lit(p[0]).alias("unit_index"), F.lit(p[1]).alias("block_index"))
    if start is not None:
        chunks = chunks.filter(place >= bound(start))
    if end is not None:
        chunks = chunks.filter(place <= bound(end))
    return chunks_containing(chunks, query)


def page_chunks(runs: DataFrame, fmt: str = "pdf") -> DataFrame:
    """Text chunks of fixed pages: one for each run with text, with an id that counts all runs of its page and the run's rectangle.
    runs: run_uid, book_id, page_index, run_index, text, transform_matrix, width, height; each run once."""
    number = F.row_number().over(W.partitionBy("book_id", "page_index").orderBy("run_index", "run_uid")) - 1
    at = lambda k: F.element_at("transform_matrix", k)
    return runs.withColumn("n", number).filter(F.col("text").rlike(r"\S")).select(
        "run_uid", "book_id", "page_index", F.concat(F.lit(f"{fmt}:"), F.col("page_index").cast("string"), F.lit(":text:"), F.col("n").cast("string")).alias("chunk_id"), "text",
        at(5).alias("x"), (at(6) - F.col("height")).alias("y"), "width", "height",
    )


def search_citations(blocks: DataFrame, units: DataFrame, query: str, limit: int = 8, context: int = 96, scheme: str = "book") -> DataFrame:
    """The first hits with label and link of their block. blocks: with block_id; units: book_id, unit_index, title. A blank query has none."""
    top = first_hits(blocks, query.strip(), list(ORDER), limit, context)
    named = blocks.select(*BLOCK, "block_id").join(F.broadcast(top), list(BLOCK)).dropDuplicates(list(ORDER)).join(units, ["book_id", "unit_index"], "left")
    label, link = citation(F.col("title"), F.col("block_id"), F.col("unit_index"), scheme)
    return named.withColumns({"label": label, "link": link})


def citation(title, block_id, unit_index, scheme: str = "book"):
    """Label and link of a block; the link's scheme is the reading application's."""
    label = F.concat_ws(" · ", title, block_id)
    safe = F.replace(F.url_encode(F.coalesce(block_id, F.lit(""))), F.lit("+"), F.lit("%20"))
    return label, F.concat(F.lit(f"{scheme}://j/"), unit_index.cast("string"), F.lit("/"), safe)
