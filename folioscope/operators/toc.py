"""Contents entries and sections: titles, resolution of references, active entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import path_of


def units_with_titles(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """Each section with the first contents entry that names it; an empty label is a label."""
    first = toc.groupBy("book_id", "section_id").agg(F.min_by("label", "toc_index").alias("label"))
    title = F.coalesce("label", "title", "section_id", F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string")))
    return sections.join(first, ["book_id", "section_id"], "left").withColumn("unit_title", title)


def resolve(toc: DataFrame, sections: DataFrame) -> DataFrame:
    """The section of each entry: by exact id, else by path, else by a path's end; of equals the last for ids and paths,
    the first for ends. The ends of a section's path are generated, so that all three are equi-joins."""
    refs = toc.withColumn("path", path_of(F.col("href")))
    secs = sections.select("book_id", "section_index", "section_id", path_of(F.col("section_id")).alias("path"))
    exact = secs.groupBy("book_id", F.col("section_id").alias("href")).agg(F.max("section_index").alias("by_id"))
    path = secs.groupBy("book_id", "path").agg(F.max("section_index").alias("by_path"))
    steps = F.split("path", "/")
    tails = secs.filter(F.size(steps) > 1).select("book_id", "section_index", F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps) - k + 1), "/"))).alias("path"))
    ends = tails.groupBy("book_id", "path").agg(F.min("section_index").alias("by_end"))
    out = refs.join(exact, ["book_id", "href"], "left").join(path, ["book_id", "path"], "left").join(ends, ["book_id", "path"], "left")
    return out.withColumn("resolved_index", F.coalesce("by_id", "by_path", "by_end"))


def active(toc: DataFrame) -> DataFrame:
    """An entry can be marked active only if no other entry of the book has its reference."""
    return toc.withColumn("can_be_active", F.count("*").over(W.partitionBy("book_id", "href")) == 1)


def clamped(unit: int, n):
    """Nearest valid index."""
    return F.least(F.greatest(F.lit(unit), F.lit(0)), n - 1)
