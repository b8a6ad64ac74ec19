"""Best match, newest row, kept contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best(candidates: DataFrame, key: list[str], score: str, order: str, value: str) -> DataFrame:
    """The value of the highest positive score of each key; the first of equals."""
    top = F.max_by(value, F.struct(score, (-F.col(order)).alias("o")))
    return candidates.filter(F.col(score) > 0).groupBy(*key).agg(top.alias(value))


def newest(rows: DataFrame, key: list[str], version: list[str], value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*version)).alias(value))


def first_seen_order(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of each key in the order they come first."""
    firsts = rows.groupBy(*key, value).agg(F.min(order).alias("first"))
    listed = firsts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", value))).alias("v"))
    return listed.select(*key, F.col(f"v.{value}").alias(f"{value}s"))


#: Places of a book that one task goes through at a time.
STRIDE = 4096


def filled(rows: DataFrame, group: list[str], index: str, order: list[str], value: str, out: str, stride: int = STRIDE) -> DataFrame:
    """The last value that isn't null, up to each row in the order of its group, index first. Groups of any size are gone through in strides of the index,
    and only one value of each stride is carried along a group."""
    near = W.partitionBy(*group, "_stride").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_stride", F.floor(F.col(index) / stride))
    tops = rows.filter(F.col(value).isNotNull()).groupBy(*group, "_stride").agg(F.max_by(value, F.struct(*order)).alias("_top"))
    every = rows.select(*group, "_stride").distinct().join(tops, [*group, "_stride"], "left")
    along = W.partitionBy(*group).orderBy("_stride").rowsBetween(W.unboundedPreceding, -1)
    carry = every.select(*group, "_stride", F.last("_top", True).over(along).alias("_before"))
    return rows.join(carry, [*group, "_stride"]).withColumn(out, F.coalesce(F.last(value, True).over(near), F.col("_before"))).drop("_stride", "_before")


def entry_at_page(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """The contents entry a page lies under: the last in order whose own page isn't behind it. toc: book_id, toc_index,
    label, page_index. Entries are brought down to the last of each page; a page takes its own or the one carried to it."""
    own = toc.groupBy("book_id", "page_index").agg(F.max(F.struct("toc_index", "label")).alias("entry"))
    # A page counts once in the carrying, whether it has rows, entries or both.
    places = pages.select("book_id", "page_index").distinct().join(own, ["book_id", "page_index"], "full")
    line = filled(places, ["book_id"], "page_index", ["page_index"], "entry", "top").select("book_id", "page_index", F.col("top.label").alias("label"))
    return pages.select("page_uid", "book_id", "page_index").join(line, ["book_id", "page_index"], "left").select("page_uid", "book_id", "page_index", "label")


def kept_toc(toc: DataFrame, kept: DataFrame) -> DataFrame:
    """Entries of kept sections with their depth counted over kept ancestors only. toc: book_id, toc_index, section_id,
    label and ancestors, the toc indexes above each entry."""
    own = toc.join(kept.select("book_id", "section_id").distinct(), ["book_id", "section_id"], "left_semi")
    up = own.select("book_id", "toc_index", F.explode("ancestors").alias("above")).join(own.select("book_id", F.col("toc_index").alias("above")), ["book_id", "above"])
    depth = up.groupBy("book_id", "toc_index").agg(F.count("*").alias("depth"))
    return own.join(depth, ["book_id", "toc_index"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
