"""Intervals inside blocks: overlap joins, intersections, gaps, trimming, merging. Every join is an equi-join on the block first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

BLOCK = ["book_id", "unit_index", "block_index"]


def overlaps(marks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of a mark (m_start, m_end) and a range (r_start, r_end) of a block that overlap, half-open; a mark of no width is a point."""
    point = F.col("m_start") == F.col("m_end")
    hit = F.when(point, (F.col("r_start") <= F.col("m_start")) & (F.col("m_start") < F.col("r_end"))).otherwise((F.col("m_start") < F.col("r_end")) & (F.col("r_start") < F.col("m_end")))
    pairs = marks.join(ranges, BLOCK).filter(hit)
    return pairs.withColumns({"start_offset": F.greatest("m_start", "r_start"), "end_offset": F.least("m_end", "r_end")})


def validated(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segments of known blocks with their offsets clamped to the text; empty ones go."""
    size = blocks.groupBy(*BLOCK).agg(F.max(F.length("text")).alias("size"))
    a = F.least(F.greatest(F.coalesce("s", F.lit(0)), F.lit(0)), F.col("size"))
    b = F.least(F.greatest(F.coalesce("e", "size"), F.lit(0)), F.col("size"))
    return segments.join(size, BLOCK).withColumns({"start_offset": a, "end_offset": b}).filter("start_offset < end_offset")


def ordered() -> WindowSpec:
    return W.partitionBy(*BLOCK).orderBy("start_offset", "end_offset", "segment_uid")


def reached() -> Column:
    """The furthest end of the segments before."""
    return F.max("end_offset").over(ordered().rowsBetween(W.unboundedPreceding, -1))


def trimmed(segments: DataFrame) -> DataFrame:
    """Parts not covered by earlier segments of the block."""
    cut = segments.withColumn("reached", F.coalesce(reached(), F.lit(0)))
    return cut.withColumn("start_offset", F.greatest("start_offset", "reached")).filter("start_offset < end_offset").drop("reached")


def gaps(segments: DataFrame) -> DataFrame:
    """Uncovered stretches before, between and after the segments of each block."""
    inner = segments.withColumn("gap_start", F.coalesce(reached(), F.lit(0))).select(*BLOCK, "gap_start", F.col("start_offset").alias("gap_end"))
    tail = segments.groupBy(*BLOCK).agg(F.max("end_offset").alias("gap_start"), F.max("size").alias("gap_end"))
    return inner.unionByName(tail).filter("gap_start < gap_end")


def merged(segments: DataFrame, same: str) -> DataFrame:
    """Touching segments of one value become one."""
    prev_end, prev = F.lag("end_offset").over(ordered()), F.lag(same).over(ordered())
    new = F.when((prev_end >= F.col("start_offset")) & prev.eqNullSafe(F.col(same)), 0).otherwise(1)
    isles = segments.withColumn("new", new).withColumn("isle", F.sum("new").over(ordered().rowsBetween(W.unboundedPreceding, 0)))
    return isles.groupBy(*BLOCK, "isle", same).agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.count("*").alias("merged_count")).drop("isle")


def quality(segments: DataFrame, blocks: DataFrame, tiny: int = 6) -> DataFrame:
    """Counts of findings in an assignment of segments to blocks."""
    size = blocks.groupBy(*BLOCK).agg(F.max(F.length("text")).alias("size"))
    rows = segments.join(size, BLOCK, "left").withColumns({"start_offset": F.coalesce("s", F.lit(0)), "end_offset": F.coalesce("e", "size")})
    rows = rows.withColumn("reached", reached())
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("book_id").agg(
        F.count("*").alias("segments"), flag(F.col("size").isNull()).alias("unknown_blocks"), flag(F.col("start_offset") >= F.col("end_offset")).alias("invalid"),
        flag((F.col("start_offset") < 0) | (F.col("end_offset") > F.col("size"))).alias("out_of_range"), flag(F.col("start_offset") < F.col("reached")).alias("overlaps"),
        flag(F.col("start_offset") > F.coalesce("reached", F.lit(0))).alias("gaps"), flag((F.col("end_offset") - F.col("start_offset")).between(1, tiny - 1)).alias("tiny"),
    )


def cut_at(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments cut wherever a range of their block begins or ends inside them: segment_uid, start_offset, end_offset of each part, in any number."""
    own = segments.select("segment_uid", F.explode(F.array("start_offset", "end_offset")).alias("at"))
    marks = segments.select("segment_uid", *BLOCK, "start_offset", "end_offset").join(ranges.select(*BLOCK, "r_start", "r_end"), BLOCK).filter("start_offset < r_end and r_start < end_offset")
    inside = marks.select("segment_uid", "start_offset", "end_offset", F.explode(F.array("r_start", "r_end")).alias("at")).filter("at between start_offset and end_offset")
    cuts = own.unionByName(inside.select("segment_uid", "at")).distinct()
    return cuts.select("segment_uid", F.col("at").alias("start_offset"), F.lead("at").over(W.partitionBy("segment_uid").orderBy("at")).alias("end_offset")).filter("end_offset is not null")


def marks_in_ranges(marks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of a mark and a range that match. marks: mark_id, book_id, start_unit, end_unit, start_block, end_block (ids, nullable), start_offset, end_offset (nullable); ranges: range_id, book_id, unit_index,
    block_id, start_offset, end_offset (nullable), reliable.

    A mark over several units matches every range of them. One in a unit matches by its block, if it names one, and by half-open offsets; a mark of no width is a point; a mark without offsets,
    and a range with unreliable or empty ones, match by block alone; a mark whose ends lie in two blocks matches by either end. Marks are joined by each unit they touch."""
    far = F.col("start_unit") != F.col("end_unit")
    m = marks.withColumn("unit_index", F.explode(F.sequence(F.least("start_unit", "end_unit"), F.greatest("start_unit", "end_unit"))))
    r = ranges.select("range_id", "book_id", "unit_index", F.col("block_id").alias("_b"), F.col("start_offset").alias("_s"), F.col("end_offset").alias("_e"), "reliable")
    low, high = F.coalesce("_s", F.lit(-(1 << 31))), F.coalesce("_e", F.lit((1 << 31) - 1))

    def matches(block, start, end):
        in_block = block.isNull() | F.coalesce(F.col("_b") == block, F.lit(False))
        a, z = F.coalesce(start, F.lit(-(1 << 31))), F.coalesce(end, F.lit((1 << 31) - 1))
        by_offset = F.when(a == z, (low <= a) & (a < high)).otherwise((low < z) & (high > a))
        return in_block & ((start.isNull() & end.isNull()) | ~F.col("reliable") | (high <= low) | by_offset)

    start, end = F.col("start_offset"), F.col("end_offset")
    one_block = F.coalesce(F.col("start_block") == F.col("end_block"), F.lit(False))
    near = F.when(one_block, matches(F.col("start_block"), start, end)).otherwise(matches(F.col("start_block"), start, start) | matches(F.col("end_block"), end, end))
    return m.join(r, ["book_id", "unit_index"]).filter(far | near).select("mark_id", "range_id").distinct()
