"""Plain text of whole books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIVIDER = "-" * 60


def section_bodies(blocks: DataFrame) -> DataFrame:
    rows = blocks.filter(F.col("text").isNotNull()).groupBy("book_id", "unit_index").agg(F.array_sort(F.collect_list(F.struct("block_index", "block_uid", "text"))).alias("rows"))
    return rows.select("book_id", F.col("unit_index").alias("section_index"), F.array_join("rows.text", "\n").alias("body"))


def section_texts(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, section_index and what a plain-text file holds of each section in the line of reading: divider, title and text. A book's file
    is its sections in order; a book of any size is so written without ever lying in one row."""
    line = sections.filter(F.coalesce(F.col("linear") != "no", F.lit(True)))
    parts = line.join(section_bodies(blocks), ["book_id", "section_index"], "left")
    shown = F.concat_ws("\n", F.lit(DIVIDER), F.coalesce("toc_label", "title", "section_id"), F.coalesce("body", F.lit("")))
    return parts.select("book_id", "section_index", shown.alias("exported"))


def book_texts(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """One text for each book, for books that fit in a row; section_texts() has no such bound."""
    rows = section_texts(sections, blocks).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "exported"))).alias("rows"))
    return rows.select("book_id", F.array_join("rows.exported", "\n").alias("exported"))


def write_texts(sections: DataFrame, blocks: DataFrame, folder: str) -> None:
    """Plain-text files by book, sections in order: one folder for each book."""
    rows = section_texts(sections, blocks).select("book_id", "section_index", F.col("exported").alias("value"))
    rows.repartitionByRange("book_id", "section_index").sortWithinPartitions("book_id", "section_index").select("book_id", "value").write.mode("overwrite").partitionBy("book_id").text(folder)
