"""Reading progress: running sums of section sizes, their inverse, and what is filled or clipped along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

LOCATION = 1500


def by_book() -> WindowSpec:
    return W.partitionBy("book_id").orderBy("section_index")


def before() -> WindowSpec:
    return by_book().rowsBetween(W.unboundedPreceding, -1)


def weight() -> Column:
    """Size that counts for progress: nothing for sections outside the line or without size."""
    return F.when(F.col("linear") == "no", 0).otherwise(F.greatest(F.coalesce("size_bytes", F.lit(0)), F.lit(0))).cast("long")


def section_fractions(sections: DataFrame) -> DataFrame:
    """Start and end of each section as a share of its book; 0 in a book without size."""
    sized = sections.withColumn("weight", weight())
    total = F.sum("weight").over(W.partitionBy("book_id"))
    done = F.coalesce(F.sum("weight").over(before()), F.lit(0))
    out = sized.withColumns({"size_before": done, "size_total": total})
    share = lambda x: F.when(F.col("size_total") > 0, x / F.col("size_total")).otherwise(F.lit(0.0))
    return out.withColumns({"start_fraction": share(F.col("size_before")), "end_fraction": share(F.col("size_before") + F.col("weight"))})


def progress_at(sections: DataFrame, within: float) -> DataFrame:
    """Total fraction and locations for a place in each section."""
    f = section_fractions(sections)
    here = F.col("size_before") + F.lit(within) * F.col("weight")
    return f.withColumns({
        "total_fraction": F.when(F.col("size_total") > 0, here / F.col("size_total")).otherwise(F.lit(0.0)),
        "location": F.floor(here / LOCATION), "locations": F.ceil(F.col("size_total") / LOCATION), "remaining": F.col("size_total") - here,
    })


def section_at(sections: DataFrame, fraction: float) -> DataFrame:
    """The section of each book that holds a fraction; sections without size are passed over; null in a book without size."""
    f = section_fractions(sections)
    ok = (F.col("weight") > 0) & (F.col("start_fraction") <= fraction)
    return f.groupBy("book_id").agg(F.max(F.when(ok, F.col("section_index"))).alias("section_index"))


def toc_fill(sections: DataFrame) -> DataFrame:
    """Each section's label; those without take the last one before."""
    return sections.withColumn("filled_label", F.last("toc_label", True).over(by_book().rowsBetween(W.unboundedPreceding, 0)))


def first_sections(sections: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    line = sections.filter(F.coalesce(F.col("linear") != "no", F.lit(True)))
    return line.withColumn("position", F.row_number().over(by_book())).filter(F.col("position") <= n)


def clip(rows: DataFrame, group: list[str], order: list[str], budget: int) -> DataFrame:
    """Texts of each group until a budget of characters is spent; the last one is cut and flagged."""
    w = W.partitionBy(*group).orderBy(*order)
    spent = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("spent")
    out = rows.withColumn("spent", spent).filter(F.col("spent") < budget)
    cut = F.length("text") > left
    return out.withColumns({"truncated": cut, "clipped": F.when(cut, F.rtrim(F.substring("text", F.lit(1), left.cast("int")))).otherwise(F.col("text"))})


def density_sample(sections: DataFrame, count: int = 4, size: int = 96_000) -> DataFrame:
    """First sections of each book until so many or so many bytes are reached."""
    line = sections.withColumn("weight", weight()).filter("weight > 0")
    return line.withColumns({"taken": F.row_number().over(by_book()) - 1, "bytes_before": F.coalesce(F.sum("weight").over(before()), F.lit(0))}).filter((F.col("taken") < count) & (F.col("bytes_before") < size))


def page_estimate(sections: DataFrame, units: DataFrame, per_page: float) -> DataFrame:
    """Pages of a book: density of text units in the sampled sections times its size, over what a page holds."""
    sample = density_sample(sections).join(units, ["book_id", "section_index"], "left")
    density = sample.groupBy("book_id").agg((F.sum(F.coalesce("units", F.lit(0.0))) / F.sum("weight")).alias("density"))
    total = sections.groupBy("book_id").agg(F.sum(weight()).alias("bytes"))
    return total.join(density, "book_id", "left").withColumn("pages", F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("density"), F.lit(0.5)) * F.col("bytes") / per_page)))


def trial_access(sections: DataFrame, limit: float) -> DataFrame:
    """Contents entries and whether they lie beyond the trial."""
    f = section_fractions(sections).filter(F.col("toc_label").isNotNull())
    return f.withColumn("disabled", F.col("start_fraction") > limit + 1e-4)
