"""Counting reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def request_log(events: DataFrame, kind: str, value: str, failed) -> DataFrame:
    """Count, sum, maximum and failures of each kind and, with a null kind, of all: one pass by grouping sets."""
    return events.rollup(kind).agg(F.count("*").alias("requests"), F.sum(value).alias("total"), F.max(value).alias("longest"), F.count_if(failed).alias("failed"))


def counts(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(reason))


def first_seen(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(at).alias("first_seen"), F.count("*").alias("times"))


def adjacent_same(segments: DataFrame, gap: int = 8, most: int | None = None, none_is_one: bool = False) -> DataFrame:
    """Segments whose next one in the block has the same speakers, begins within a gap, and leaves both joined within a size. Without speakers counts as one speaker if so asked."""
    w = W.partitionBy("book_id", "unit_index", "block_index").orderBy("start_offset", "end_offset", "segment_uid")
    size = F.col("end_offset") - F.col("start_offset")
    nxt = segments.withColumns({"next_uid": F.lead("segment_uid").over(w), "next_start": F.lead("start_offset").over(w), "next_speaker": F.lead("speaker").over(w), "next_size": F.lead(size).over(w)})
    near = (F.col("next_start") - F.col("end_offset")).between(0, gap)
    if most is not None:
        near = near & (size + F.col("next_size") + 1 <= most)
    same = F.col("speaker").eqNullSafe(F.col("next_speaker")) if none_is_one else F.col("speaker") == F.col("next_speaker")
    return nxt.filter(near & same & F.col("next_uid").isNotNull())


def predicted_start(items: DataFrame, group: str, order: list[str], duration: str) -> DataFrame:
    """Running sum of durations before each item."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return items.withColumn("predicted_start", F.coalesce(F.sum(duration).over(w), F.lit(0)))


def classified(url, rules: list[tuple[str, str]], other: str = "other"):
    """The first kind whose pattern a URL or path matches."""
    out = F.lit(other)
    for kind, pattern in reversed(rules):
        out = F.when(url.rlike(pattern), kind).otherwise(out)
    return out


def prepared(segments: DataFrame, blocks: DataFrame, tiny: int = 6, gap: int = 8) -> DataFrame:
    """Of each book's prepared segments: unknown blocks, tiny ones, and neighbours in a block, also with one speaker."""
    size = blocks.groupBy("book_id", "unit_index", "block_index").agg(F.max(F.length("text")).alias("size"))
    a = F.least(F.greatest(F.coalesce("s", F.lit(0)), F.lit(0)), F.col("size"))
    z = F.least(F.greatest(F.coalesce("e", "size"), F.lit(0)), F.col("size"))
    known = F.col("size").isNotNull()
    rows = segments.join(size, ["book_id", "unit_index", "block_index"], "left").withColumns({"a": F.when(known, a), "z": F.when(known, z)})
    w = W.partitionBy("book_id", "unit_index", "block_index").orderBy("a", "z", "segment_uid")
    rows = rows.withColumns({"before": F.lag("z").over(w), "speaker_before": F.lag("speaker").over(w)})
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    near = (F.col("a") - F.col("before")).between(0, gap)
    return rows.groupBy("book_id").agg(
        F.count("*").alias("segments"), flag(~known).alias("unknown_blocks"), flag((F.col("z") - F.col("a")).between(0, tiny - 1)).alias("tiny"),
        flag(near).alias("adjacent"), flag(near & (F.col("speaker") == F.col("speaker_before"))).alias("adjacent_same"),
    )


def synthesis(items: DataFrame, seen: DataFrame, risk: float = 500.0) -> DataFrame:
    """Of each unit's narrated items: how many came, how many are missing, and how many came later than what was narrated before them lasts, by more than risk. items: block_uid, key columns, ms;
    seen: key columns, at, any number of times."""
    key = ["book_id", "unit_index", "block_index"]
    first = seen.groupBy(*key).agg(F.min("at").alias("seen"))
    begun = first.groupBy("book_id", "unit_index").agg(F.min("seen").alias("begun"))
    rows = items.join(first, key, "left").join(begun, ["book_id", "unit_index"], "left")
    w = W.partitionBy("book_id", "unit_index").orderBy("block_index", "block_uid").rowsBetween(W.unboundedPreceding, -1)
    came = F.col("seen").isNotNull()
    rows = rows.withColumns({"first_seen_ms": (F.unix_micros("seen") - F.unix_micros("begun")) / 1000.0, "predicted": F.coalesce(F.sum(F.when(came, F.col("ms")).otherwise(0)).over(w), F.lit(0))})
    return rows.groupBy("book_id", "unit_index").agg(
        F.count("*").alias("items"), F.count_if(~came).alias("missing"), F.count_if(F.coalesce(F.col("first_seen_ms") - F.col("predicted") > risk, F.lit(False))).alias("wait_risks"),
        F.round(F.min("first_seen_ms"), 3).alias("first_result_ms"), F.round(F.max("first_seen_ms"), 3).alias("last_result_ms"),
    )


def not_asked_for(used: DataFrame, asked: DataFrame, group: list[str], id: str) -> DataFrame:
    """Ids of each group that a plan uses though the request doesn't hold them, each once."""
    return used.filter(F.col(id).isNotNull()).select(*group, id).distinct().join(asked.select(*group, id).distinct(), [*group, id], "left_anti")


def repeated(rows: DataFrame, key: list[str], *more) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("times"), *more).filter("times > 1")


def compared(rows: DataFrame, kind: str, value: str, base: str) -> DataFrame:
    """Mean and total of each kind over all runs, and how the mean of a base kind relates to its mean."""
    each = rows.groupBy(kind).agg(F.avg(value).alias("mean_value"), F.sum(value).alias("total"))
    of_base = F.broadcast(each.filter(F.col(kind) == base).select(F.col("mean_value").alias("_base")))  # one row
    return each.join(of_base, how="left").select(kind, F.round("mean_value", 6).alias("mean_value"), F.round("total", 2).alias("total"), F.round(F.col("_base") / F.col("mean_value"), 6).alias("ratio"))
