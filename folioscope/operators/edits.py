"""Edits and translations laid over blocks when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """The newest edit of a block stands in for its text. edits: book_id, unit_index, block_id, new_text, version."""
    last = edits.groupBy("book_id", "unit_index", "block_id").agg(F.max_by("new_text", F.struct("version", "new_text")).alias("new_text"))
    return blocks.join(last, ["book_id", "unit_index", "block_id"], "left").withColumns({"edited": F.col("new_text").isNotNull(), "final_text": F.coalesce("new_text", "text")})


def bilingual(blocks: DataFrame, translations: DataFrame, replace: bool = False) -> DataFrame:
    """Each block and, behind it, its translation; or the translation in its place."""
    both = blocks.join(translations, ["book_id", "unit_index", "block_index"], "left")
    if replace:
        return both.withColumn("text", F.coalesce("translated", "text")).drop("translated")
    rows = F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("shown")), F.struct(F.lit(1).alias("part"), F.col("translated").alias("shown")))
    return both.select("book_id", "unit_index", "block_index", F.inline(rows)).filter("part = 0 or shown is not null")


def translatable(blocks: DataFrame) -> DataFrame:
    """Blocks worth translating: running text of two characters or more that is not only figures and marks."""
    kinds = F.col("block_type").isin("paragraph", "heading", "listItem", "blockquote")
    return blocks.filter(kinds & (F.length(F.trim("text")) >= 2) & F.col("text").rlike(r"\p{L}"))


def labels(toc: DataFrame, translations: DataFrame) -> DataFrame:
    """Contents labels replaced by their translation, and with it beside them; those without keep their own. translations: book_id, toc_index, translated."""
    both = toc.join(translations, ["book_id", "toc_index"], "left")
    return both.select("book_id", "toc_index", F.coalesce("translated", "label").alias("replaced"), F.concat_ws(" / ", "label", "translated").alias("both"))


def cells(tables: DataFrame) -> DataFrame:
    """Cells of tables worth translating, with their place. tables: block_uid, rows array<array<string>>."""
    at = tables.select("block_uid", F.posexplode("rows").alias("row_index", "cells")).select("block_uid", "row_index", F.posexplode("cells").alias("cell_index", "text"))
    return at.filter((F.length(F.trim("text")) >= 2) & F.col("text").rlike(r"\p{L}"))


def current(log: DataFrame) -> DataFrame:
    """Edits that hold after a log: the last of each block, none where it was cleared, or its unit, or its book, later. log: version, op (set or clear), book_id, unit_index, block_id, new_text;
    a clear with a null block clears the unit, with a null unit the book."""
    sets = log.filter(F.col("op") == "set").groupBy("book_id", "unit_index", "block_id").agg(F.max_by(F.struct("new_text", "version"), "version").alias("e")).select("book_id", "unit_index", "block_id", "e.*")
    clear = log.filter(F.col("op") == "clear")
    for key, scope in ((["book_id", "unit_index", "block_id"], clear.filter("block_id is not null")), (["book_id", "unit_index"], clear.filter("block_id is null and unit_index is not null")), (["book_id"], clear.filter("unit_index is null"))):
        last = scope.groupBy(*key).agg(F.max("version").alias("_cleared"))
        sets = sets.join(last, key, "left").filter(F.col("_cleared").isNull() | (F.col("_cleared") < F.col("version"))).drop("_cleared")
    return sets
