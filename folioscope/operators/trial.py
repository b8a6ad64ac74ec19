"""Reading up to a limit: how many pages a book has, which share of it is open, and what lies beyond."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import clamp01
from .progress import density_sample, section_fractions, weight

#: Slack in comparing fractions, and bytes to a unit of text where nothing was sampled.
EPSILON, BYTES_PER_UNIT = 1e-4, 2.4


def units_per_page(font_size: float = 17, line_height: float = 1.7, fill: float = 0.92, width: float = 390, height: float = 740, margin: float = 32) -> float:
    """Text units a page holds: units in a line times lines, filled to a part. Every measure has a least value."""
    size, lead = max(8.0, font_size), max(1.0, line_height)
    margins = 2 * max(0.0, margin)
    across = max(8 * size, max(120.0, width) - margins) / size
    down = max(4 * size * lead, max(160.0, height) - margins) / (size * lead)
    return max(1.0, across * down * min(1.0, max(0.4, fill)))


def page_counts(books: DataFrame, sections: DataFrame, page_list: DataFrame, units: DataFrame, per_page: float) -> DataFrame:
    """Pages of each book and what they are estimated by: a page list, the sections of a book with fixed pages, the density of
    text in sampled sections, or sizes alone. books: book_id, fixed; page_list: book_id, n; units: book_id, section_index, units."""
    line = sections.filter(F.coalesce(F.col("linear") != "no", F.lit(True)))
    size = sections.groupBy("book_id").agg(F.sum(weight()).alias("bytes"), F.count("*").alias("n_all")).join(line.groupBy("book_id").agg(F.count("*").alias("n_line")), "book_id", "left")
    sample = density_sample(sections).join(units, ["book_id", "section_index"], "left").groupBy("book_id").agg(F.sum(F.coalesce("units", F.lit(0.0))).alias("u"), F.sum("weight").alias("w"))
    rows = books.join(page_list, "book_id", "left").join(size, "book_id", "left").join(sample, "book_id", "left")
    listed, sampled = F.coalesce("n", F.lit(0)) > 0, (F.coalesce("u", F.lit(0.0)) > 0) & (F.coalesce("w", F.lit(0)) > 0)
    total = F.coalesce("bytes", F.lit(0))
    pages = (
        F.when(listed, F.col("n")).when(F.col("fixed"), F.greatest(F.lit(1), F.coalesce(F.nullif("n_line", F.lit(0)), "n_all", F.lit(0))))
        .when(sampled, F.ceil(total * (F.col("u") / F.col("w")) / per_page)).otherwise(F.ceil(total / BYTES_PER_UNIT / per_page))
    )
    by = F.when(listed, "page-list").when(F.col("fixed"), "pre-paginated-sections").when(sampled, "sampled-text").otherwise("section-size")
    return rows.select("book_id", pages.cast("long").alias("pages"), by.alias("estimated_by"))


def limit_state(pages: DataFrame, most: int) -> DataFrame:
    """limit_fraction and page_step of each book for a trial of so many pages; no limit for 0 and less."""
    n = F.greatest(F.col("pages"), F.lit(1))
    most = max(0, most)
    limit = clamp01(F.lit(float(most)) / F.greatest(n, F.lit(most))) if most else F.lit(1.0)
    return pages.withColumn("limit_fraction", limit).withColumn("page_step", F.col("limit_fraction") / most if most else F.lit(0.0))


def boundaries(sections: DataFrame) -> DataFrame:
    """Start of each section as a share of its book, and the end of the last one, nudged so that it lies inside its section."""
    f = section_fractions(sections)
    starts = f.select("book_id", "section_index", F.col("start_fraction").alias("fraction"))
    ends = f.groupBy("book_id").agg((F.max("section_index") + 1).alias("section_index"), F.max("end_fraction").alias("fraction"))
    return starts.unionByName(ends).withColumn("fraction", F.col("fraction") + 2.220446049250313e-16)


def toc_access(toc: DataFrame, sections: DataFrame, limit: DataFrame) -> DataFrame:
    """Contents entries with the fraction they lead to and whether that lies beyond the trial. toc: book_id, toc_index, depth, label, href, resolved_index;
    limit: book_id, limit_fraction. An entry that leads nowhere is open."""
    at = section_fractions(sections).select("book_id", F.col("section_index").alias("resolved_index"), "start_fraction")
    rows = toc.join(at, ["book_id", "resolved_index"], "left").join(limit, "book_id")
    fraction = F.coalesce("start_fraction", F.lit(0.0))
    key = F.concat_ws("-", F.col("depth").cast("string"), F.col("toc_index").cast("string"), F.coalesce("href", F.lit("")))
    return rows.select(
        "book_id", "toc_index", key.alias("key"), F.coalesce(F.nullif("label", F.lit("")), F.lit("Untitled")).alias("label"), "depth", "resolved_index", fraction.alias("section_fraction"),
        (F.col("resolved_index").isNotNull() & (fraction > F.col("limit_fraction") + EPSILON)).alias("disabled"),
    )


def go(sections: DataFrame, limit: DataFrame, within: float) -> DataFrame:
    """For a place in each section: its total fraction, whether the section may be gone to, whether another page may be turned, and the
    fraction a page turn at the section's end leads to."""
    f = section_fractions(sections).join(limit, "book_id")
    along = W.partitionBy("book_id").orderBy("section_index")
    start, following = F.col("start_fraction"), F.coalesce(F.lead("start_fraction").over(along), F.lit(1.0))
    total = clamp01(start + F.greatest(following - start, F.lit(0.0)) * within)
    top = F.col("limit_fraction") + EPSILON
    return f.select("book_id", "section_index", total.alias("total_fraction"), (start <= top).alias("can_go_to"), (total + F.col("page_step") <= top).alias("can_go_next"), following.alias("next_fraction"))


def current_entry(toc: DataFrame, sections: DataFrame) -> DataFrame:
    """The entry a reader in each section stands under: the first that leads to the section itself, or else the last in order of those that lead to an
    earlier one. One row of sums for each section that has entries, and a running maximum over them."""
    led = toc.filter(F.col("resolved_index").isNotNull()).groupBy("book_id", F.col("resolved_index").alias("section_index")).agg(F.min("toc_index").alias("own"), F.max("toc_index").alias("latest"))
    rows = sections.select("book_id", "section_index").join(led, ["book_id", "section_index"], "left")
    earlier = F.max("latest").over(W.partitionBy("book_id").orderBy("section_index").rowsBetween(W.unboundedPreceding, -1))
    return rows.select("book_id", "section_index", F.coalesce("own", earlier).alias("toc_index"))
