"""Content of units for readers and tools: lists of units, texts under a budget, contents lists, surroundings of a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import path_of
from .progress import clip


def unit_list(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each unit with its title, and how many blocks with text and characters it has (blocks joined by a line end). Texts never move: their lengths do.
    units: book_id, unit_index, unit_title; blocks: each once."""
    sizes = blocks.filter(F.length("text") > 0).groupBy("book_id", "unit_index").agg(F.count("*").alias("blocks"), (F.sum(F.length("text")) + F.count("*") - 1).alias("char_count"))
    return units.join(sizes, ["book_id", "unit_index"], "left").select("book_id", "unit_index", "unit_title", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("char_count", F.lit(0)).alias("char_count"))


def unit_texts(blocks: DataFrame, most: int = 12_000) -> DataFrame:
    """Text of each unit up to so many characters, and whether more was there. Blocks beyond the budget are dropped before texts meet."""
    rows = clip(blocks.filter(F.length("text") > 0).select("book_id", "unit_index", "block_index", F.concat("text", F.lit("\n")).alias("text")), ["book_id", "unit_index"], ["block_index"], most + 1)
    whole = rows.groupBy("book_id", "unit_index").agg(F.array_sort(F.collect_list(F.struct("block_index", F.coalesce("clipped", "text").alias("t")))).alias("r"), F.max("truncated").alias("cut"))
    text = F.regexp_replace(F.array_join("r.t", ""), r"\n$", "")
    return whole.select("book_id", "unit_index", F.rtrim(F.substring(text, 1, most)).alias("text"), (F.col("cut") | (F.length(text) > most)).alias("truncated"))


def around(blocks: DataFrame, current: DataFrame, before: int, after: int, budget: int) -> DataFrame:
    """Blocks of the units around the current one of each book, in order, until a shared budget of characters is spent. current: book_id, unit.
    Blocks far from it are dropped before anything is ordered."""
    near = blocks.join(current, "book_id").filter(F.col("unit_index").between(F.col("unit") - before, F.col("unit") + after))
    return clip(near, ["book_id"], ["unit_index", "block_index"], budget)


def contents_list(toc: DataFrame, limit: int = 80) -> DataFrame:
    """The first entries of each book, with their depth and unit. toc: book_id, toc_index, depth, label, resolved_index."""
    n = F.row_number().over(W.partitionBy("book_id").orderBy("toc_index"))
    return toc.withColumn("_n", n).filter(F.col("_n") <= limit).select("book_id", "toc_index", "depth", "label", F.col("resolved_index").alias("unit_index"))


def toc_positions(toc: DataFrame) -> DataFrame:
    """Entries that lead somewhere, numbered by the section they lead to and their own order."""
    at = W.partitionBy("book_id").orderBy("resolved_index", "toc_index")
    return toc.filter(F.col("resolved_index").isNotNull()).withColumn("position", F.row_number().over(at) - 1)


def same_entry(a: Column, b: Column) -> Column:
    """Whether two references lead to the same place: equal once brought to one form with their fragments, and not empty."""
    form = lambda x: F.concat_ws("#", path_of(x), F.nullif(F.regexp_extract(F.trim(x), "#(.*)$", 1), F.lit("")))
    return F.coalesce((form(a) != "") & (form(a) == form(b)), F.lit(False))


def block_ranges(blocks: DataFrame) -> DataFrame:
    """The whole of each block as a range of code points."""
    return blocks.select("block_uid", F.lit(0).alias("start_offset"), F.coalesce(F.length("text"), F.lit(0)).alias("end_offset"))


def next_id(*columns: DataFrame) -> DataFrame:
    """One more than the largest id of several one-column sources; each source is brought down to one row first."""
    tops = [c.agg(F.max(c.columns[0]).cast("long").alias("top")) for c in columns]
    rows = tops[0]
    for t in tops[1:]:
        rows = rows.unionByName(t)
    return rows.agg((F.coalesce(F.max("top"), F.lit(0)) + 1).alias("next_id"))


def page_href(href: Column, fmt: str | None = None) -> Column:
    """Page index of a reference page:<n>, with or without a format before it; with one where it must be named."""
    head = f"(?:{fmt}:)" if fmt else r"(?:[a-z0-9]+:)?"
    return F.nullif(F.regexp_extract(href, rf"^{head}page:(\d+)$", 1), F.lit("")).cast("int")


def page_rects(marks: DataFrame, pages: list[int], fmt: str) -> DataFrame:
    """Rectangles of marks on some pages of a format. marks: mark_id, locations array<struct<format, page, rects array<struct<x,y,w,h>>>>."""
    at = marks.select("mark_id", F.inline("locations"))
    return at.filter((F.col("format") == fmt) & F.col("page").isin(pages)).select("mark_id", "page", F.inline("rects"))


def mark_store(log: DataFrame) -> DataFrame:
    """What a store of marks holds after a log of operations: upsert and delete by id, delete by kind. log: seq, op, mark_id, kind, value.
    Of each id the last operation counts, unless its kind was deleted later."""
    own = log.filter(F.col("op").isin("upsert", "delete")).groupBy("mark_id").agg(F.max_by(F.struct("op", "kind", "value", "seq"), "seq").alias("r")).select("mark_id", "r.*")
    gone = log.filter(F.col("op") == "delete_kind").groupBy("kind").agg(F.max("seq").alias("gone_at"))
    left = own.filter(F.col("op") == "upsert").join(gone, "kind", "left")
    return left.filter(F.col("gone_at").isNull() | (F.col("gone_at") < F.col("seq"))).select("mark_id", "kind", "value", "seq")


def prefetch(wanted: DataFrame, group: str, pages: str) -> DataFrame:
    """Pages to fetch ahead for each group: the most any consumer wants, whole pages, none for less than 0."""
    return wanted.groupBy(group).agg(F.greatest(F.lit(0), F.floor(F.coalesce(F.max(pages), F.lit(0)))).cast("long").alias("pages"))
