"""Named queries over the tables, and the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..operators import edits, folds, lookup, narration, nodes, progress, ranges, reports, search, toc

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Blocks and segments as delivered once.
BLOCKS_SQL = "blocks AS (SELECT DISTINCT block_uid, book_id, unit_index, block_index, block_id, block_type, text FROM unit_texts)"
SEGS_SQL = "segs AS (SELECT DISTINCT segment_uid, book_id, unit_index, b AS block_index, s, e, i, list_aggregate(speaker_ids, 'string_agg', ',') AS speaker FROM tts_segments)"
VALID_SQL = f"""{BLOCKS_SQL}, {SEGS_SQL},
sized AS (SELECT book_id, unit_index, block_index, max(length(text)) AS size FROM blocks GROUP BY ALL),
valid AS (SELECT * FROM (SELECT segs.*, size, least(greatest(coalesce(s, 0), 0), size) AS start_offset, least(greatest(coalesce(e, size), 0), size) AS end_offset
  FROM segs JOIN sized USING (book_id, unit_index, block_index)) WHERE start_offset < end_offset)"""
FRACTIONS_SQL = """weighed AS (SELECT *, CASE WHEN linear = 'no' THEN 0 ELSE greatest(coalesce(size_bytes, 0), 0) END AS weight FROM sections),
summed AS (SELECT *, CAST(coalesce(sum(weight) OVER (PARTITION BY book_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS size_before,
  CAST(sum(weight) OVER (PARTITION BY book_id) AS BIGINT) AS size_total FROM weighed),
fr AS (SELECT *, CASE WHEN size_total > 0 THEN size_before / size_total ELSE 0.0 END AS start_fraction,
  CASE WHEN size_total > 0 THEN (size_before + weight) / size_total ELSE 0.0 END AS end_fraction FROM summed)"""


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


BLOCK_COLUMNS = ("block_uid", "book_id", "unit_index", "block_index", "block_id", "block_type", "text")


def raw(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as delivered, some several times. What is worked out of them is brought down to one row for each block by once()."""
    return table(spark, d, "unit_texts").select(*BLOCK_COLUMNS)


def once(df: DataFrame, *key: str) -> DataFrame:
    """Deliveries of one id hold the same, so any one stands for all: rows meet by id, never by text."""
    return df.dropDuplicates(list(key) or ["block_uid"])


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return once(raw(spark, d))


def segments(spark: SparkSession, d: str) -> DataFrame:
    speaker = F.array_join(F.transform("speaker_ids", lambda x: x.cast("string")), ",")
    return table(spark, d, "tts_segments").select("segment_uid", "book_id", "unit_index", F.col("b").alias("block_index"), "s", "e", "i", F.when(F.size("speaker_ids") > 0, speaker).alias("speaker")).distinct()


def valid_segments(spark: SparkSession, d: str) -> DataFrame:
    return ranges.validated(segments(spark, d), raw(spark, d))


def toc_rows(spark: SparkSession, d: str) -> DataFrame:
    """Contents entries: the sections' own labels and references."""
    s = table(spark, d, "sections").filter(F.col("toc_label").isNotNull())
    return s.select("book_id", F.col("section_index").alias("toc_index"), F.col("toc_label").alias("label"), "href")


# ---------------------------------------------------------------- search

HITS_SQL = """hit AS (
  SELECT book_id, unit_index, block_index, text, CAST(start_offset AS INTEGER) AS start_offset FROM (
    SELECT *, unnest(list_transform(range(1, len(parts)), lambda k: CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) AS BIGINT) + (k - 1) * {n})) AS start_offset
    FROM (SELECT *, string_split({low}, '{q}') AS parts FROM blocks WHERE contains({low}, '{q}') AND {where})))"""
SHOWN = """start_offset + {n} AS end_offset, substring(text, start_offset + 1, {n}) AS match_text,
  CASE WHEN start_offset > 48 THEN '...' ELSE '' END || substring(text, greatest(start_offset - 48, 0) + 1, least(start_offset + {n} + 48, length(text)) - greatest(start_offset - 48, 0))
  || CASE WHEN start_offset + {n} + 48 < length(text) THEN '...' ELSE '' END AS excerpt"""
NUMBERED = "CAST(row_number() OVER (PARTITION BY book_id, unit_index ORDER BY block_index, start_offset) - 1 AS INTEGER) AS match_index"


def _search_sql(q: str, low: str = "lower(text)", where: str = "true", keep: str = "true", tail: str = "ORDER BY book_id, unit_index, block_index, start_offset LIMIT 100") -> str:
    n = len(q)
    return f"""WITH {BLOCKS_SQL}, {HITS_SQL.format(n=n, low=low, q=q, where=where)},
numbered AS (SELECT *, {NUMBERED} FROM hit WHERE {keep})
SELECT book_id, unit_index, block_index, start_offset, match_index, {SHOWN.format(n=n)} FROM numbered {tail}"""


def _slim(spark, d):
    return raw(spark, d).select("book_id", "unit_index", "block_index", "text")


@query(_search_sql("en"))
def search_book(spark, d):
    return search.search_book(_slim(spark, d), "En")


@query(_search_sql("the", keep="NOT regexp_matches(substring(text, start_offset, 1), '[\\p{L}\\p{N}_]') AND NOT regexp_matches(substring(text, start_offset + 4, 1), '[\\p{L}\\p{N}_]') OR start_offset = 0 AND NOT regexp_matches(substring(text, 4, 1), '[\\p{L}\\p{N}_]')", tail=""))
def search_whole_word(spark, d):
    return search.hits(_slim(spark, d), "the", whole_word=True)


@query(_search_sql("Das", low="text"))
def search_case_sensitive(spark, d):
    return search.search_book(_slim(spark, d), "Das", case_sensitive=True)


@query(_search_sql("map", tail="WHERE match_index < 3"))
def search_topn_per_unit(spark, d):
    return search.search_units(_slim(spark, d), "map", 3)


@query(f"""WITH {BLOCKS_SQL}, {HITS_SQL.format(n=5, low="lower(text)", q="river", where="unit_index IN (4, 1, 2)")},
numbered AS (SELECT *, {NUMBERED}, CASE unit_index WHEN 4 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS scope_rank FROM hit)
SELECT book_id, unit_index, block_index, start_offset, match_index, scope_rank, {SHOWN.format(n=5)} FROM numbered ORDER BY book_id, scope_rank, block_index, start_offset LIMIT 100""")
def search_unit_scope(spark, d):
    return search.search_scope(_slim(spark, d), "river", [4, 1, 4, 2])


@query(f"WITH {BLOCKS_SQL}, {HITS_SQL.format(n=6, low='lower(text)', q='letter', where='true')} SELECT book_id, unit_index, count(*) AS n_hits, count(DISTINCT block_index) AS n_blocks FROM hit GROUP BY ALL")
def search_units_grouped(spark, d):
    h = search.hits(_slim(spark, d), "letter")
    return h.groupBy("book_id", "unit_index").agg(F.count("*").alias("n_hits"), F.countDistinct("block_index").alias("n_blocks"))


@query(f"WITH {BLOCKS_SQL} SELECT block_uid, book_id, 1 AS score FROM blocks WHERE contains(lower(text), 'broken compass')")
def search_chunks_contains(spark, d):
    return once(search.chunks_containing(raw(spark, d).select("block_uid", "book_id", "text"), "  Broken Compass ").drop("text"))


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT b.*, s.title FROM blocks b LEFT JOIN sections s ON b.book_id = s.book_id AND b.unit_index = s.section_index WHERE contains(lower(text), 'compass'))
SELECT block_uid, concat_ws(' · ', title, block_id) AS label, 'book://j/' || unit_index || '/' || url_encode(coalesce(block_id, '')) AS link FROM t""")
def search_citations(spark, d):
    s = table(spark, d, "sections").select("book_id", F.col("section_index").alias("unit_index"), "title")
    found = once(search.holding(raw(spark, d), "compass").drop("text")).join(s, ["book_id", "unit_index"], "left")
    label, link = search.citation(F.col("title"), F.col("block_id"), F.col("unit_index"))
    return found.select("block_uid", label.alias("label"), link.alias("link"))


# ---------------------------------------------------------------- text

_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_UNESC = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
_SP = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_HTML = f"'<p class=\"b\">' || {_ESC.format('text')} || '</p><script>x < y</script>'"


def _html(spark, d):
    body = F.concat(F.lit('<p class="b">'), T.escape_html(F.col("text")), F.lit("</p><script>x < y</script>"))
    return raw(spark, d).filter(F.col("text").isNotNull()).select("block_uid", body.alias("html"))


@query(f"WITH {BLOCKS_SQL} SELECT block_uid, {_ESC.format('text')} AS escaped FROM blocks WHERE text IS NOT NULL")
def escape_html(spark, d):
    return once(raw(spark, d).filter(F.col("text").isNotNull()).select("block_uid", T.escape_html(F.col("text")).alias("escaped")))


@query(f"""WITH {BLOCKS_SQL}, h AS (SELECT block_uid, {_HTML} AS html FROM blocks WHERE text IS NOT NULL)
SELECT block_uid, trim(regexp_replace({_UNESC.format("regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '{_SP}+', ' ', 'g')) AS readable FROM h""")
def html_readable_text(spark, d):
    return once(_html(spark, d).select("block_uid", T.readable_text(F.col("html")).alias("readable")))


@query(f"""WITH {BLOCKS_SQL}, h AS (SELECT block_uid, {_HTML} AS html FROM blocks WHERE text IS NOT NULL)
SELECT block_uid, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '{_SP}+', ' ', 'g')) AS stripped FROM h""")
def html_strip_markup(spark, d):
    return once(_html(spark, d).select("block_uid", T.strip_markup(F.col("html")).alias("stripped")))


_EXPORT = "regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>', '', 'g'), '(?i)<br\\s*/?>', chr(10), 'g')"
_EXPORT = f"regexp_replace(regexp_replace({_EXPORT}, '(?i)</(?:p|div|h[1-6]|li|tr|section|article|blockquote)\\s*>', chr(10), 'g'), '<[^>]*>', '', 'g')"


@query(f"""WITH {BLOCKS_SQL}, h AS (SELECT block_uid, {_HTML} AS html FROM blocks WHERE text IS NOT NULL), u AS (SELECT block_uid, {_UNESC.format(_EXPORT)} AS t FROM h)
SELECT block_uid, trim(regexp_replace(regexp_replace(regexp_replace(t, '&[A-Za-z]+;', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS exported FROM u""")
def html_export_text(spark, d):
    return once(_html(spark, d).select("block_uid", T.export_text(F.col("html")).alias("exported")))


@query(f"WITH {BLOCKS_SQL} SELECT block_uid, trim(regexp_replace(coalesce(text, ''), '{_SP}+', ' ', 'g')) AS readable, trim(regexp_replace(coalesce(text, ''), '[\\t\\n\\f\\r ]+', ' ', 'g')) AS plain FROM blocks")
def normalize_text(spark, d):
    return once(raw(spark, d).select("block_uid", T.normalize_readable(F.col("text")).alias("readable"), T.normalize_whitespace(F.col("text")).alias("plain")))


_UNITS = """(length(t) - length(regexp_replace(t, '{sp}', '', 'g'))) * 0.25 + (length(t) - length(regexp_replace(t, '{cjk}', '', 'g'))) * 1.0 + (length(t) - length(regexp_replace(t, '[A-Za-z0-9]', '', 'g'))) * 0.55
 + (length(t) - (length(t) - length(regexp_replace(t, '{sp}', '', 'g'))) - (length(t) - length(regexp_replace(t, '{cjk}', '', 'g'))) - (length(t) - length(regexp_replace(t, '[A-Za-z0-9]', '', 'g')))) * 0.5""".format(sp=_SP, cjk=T.CJK)


@query(f"WITH {BLOCKS_SQL}, x AS (SELECT block_uid, coalesce(text, '') AS t FROM blocks) SELECT block_uid, round(CAST({_UNITS} AS DOUBLE), 4) AS units FROM x")
def text_units(spark, d):
    return once(raw(spark, d).select("block_uid", F.round(T.text_units(F.col("text")).cast("double"), 4).alias("units")))


@query(f"""WITH {BLOCKS_SQL}, x AS (SELECT block_uid, text AS t FROM blocks WHERE text IS NOT NULL),
c AS (SELECT block_uid, length(t) AS n, length(t) - length(regexp_replace(t, '{_SP}', '', 'g')) AS sp, length(t) - length(regexp_replace(t, '[\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS han FROM x)
SELECT block_uid, round(CAST(sp * 0.32 + han * 1.0 + (n - sp - han) * 0.54 AS DOUBLE), 4) AS width FROM c""")
def estimated_width(spark, d):
    return once(raw(spark, d).filter(F.col("text").isNotNull()).select("block_uid", F.round(T.estimated_width(F.col("text")).cast("double"), 4).alias("width")))


_TOKENS = f"list_filter(string_split(regexp_replace(text, '{_SP}+', ' ', 'g'), ' '), lambda x: x <> '')"
_WIDTH = "(length(w) - length(regexp_replace(w, '[\\x{4E00}-\\x{9FFF}]', '', 'g'))) * 1.0 + length(regexp_replace(w, '[\\x{4E00}-\\x{9FFF}]', '', 'g')) * 0.54"


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, t AS (SELECT block_uid, {_TOKENS} AS words FROM blocks WHERE text IS NOT NULL),
x AS (SELECT block_uid, i, round(CAST({_WIDTH} AS DOUBLE), 6) AS width FROM (SELECT block_uid, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM t)),
f AS (SELECT block_uid, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS lines, CAST(0.0 AS DOUBLE) AS filled FROM t
 UNION ALL SELECT x.block_uid, x.i,
  CASE WHEN width > 40 THEN f.lines + (CASE WHEN filled > 0 THEN 1 ELSE 0 END) + CAST(ceil(width / 40) AS BIGINT) - 1 WHEN (CASE WHEN filled = 0 THEN width ELSE round(filled + 0.32 + width, 6) END) <= 40 THEN f.lines ELSE f.lines + 1 END,
  CASE WHEN width > 40 THEN (CASE WHEN round(width - 40 * floor(width / 40), 6) = 0 THEN 40 ELSE round(width - 40 * floor(width / 40), 6) END) WHEN (CASE WHEN filled = 0 THEN width ELSE round(filled + 0.32 + width, 6) END) <= 40 THEN (CASE WHEN filled = 0 THEN width ELSE round(filled + 0.32 + width, 6) END) ELSE width END
 FROM f JOIN x ON x.block_uid = f.block_uid AND x.i = f.i + 1)
SELECT block_uid, CAST(arg_max(lines, i) AS INTEGER) AS lines FROM f GROUP BY block_uid""")
def wrapped_line_count(spark, d):
    return once(raw(spark, d).filter(F.col("text").isNotNull()).select("block_uid", T.wrapped_lines(F.col("text"), 40.0).alias("lines")))


@query("""SELECT book_id, lower(CASE WHEN trim(coalesce(lang, '')) = '' THEN 'und' ELSE split_part(replace(trim(lang), '_', '-'), '-', 1) END) AS language,
  CASE WHEN regexp_matches(trim(published), '^[0-9]{4}') THEN substring(trim(published), 1, 4) END AS year, coalesce(array_to_string(genres, ', '), '') AS subjects FROM books""")
def book_metadata(spark, d):
    lang = F.trim(F.coalesce("lang", F.lit("")))
    first = F.lower(F.when(lang == "", "und").otherwise(F.element_at(F.split(F.replace(lang, F.lit("_"), F.lit("-")), "-"), 1)))
    year = F.when(F.trim("published").rlike("^[0-9]{4}"), F.substring(F.trim("published"), 1, 4))
    return table(spark, d, "books").select("book_id", first.alias("language"), year.alias("year"), F.coalesce(F.array_join("genres", ", "), F.lit("")).alias("subjects"))


@query("""WITH p AS (SELECT DISTINCT page_uid, page_index FROM fixed_pages)
SELECT page_uid, CASE WHEN page_index + 1 <= 3999 THEN ['', 'M', 'MM', 'MMM'][(page_index + 1) // 1000 % 10 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(page_index + 1) // 100 % 10 + 1]
 || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(page_index + 1) // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][(page_index + 1) % 10 + 1] END AS numeral FROM p""")
def page_numerals(spark, d):
    return table(spark, d, "fixed_pages").select("page_uid", "page_index").distinct().select("page_uid", T.roman(F.col("page_index") + 1).alias("numeral"))


# ---------------------------------------------------------------- progress


@query(f"WITH {FRACTIONS_SQL} SELECT book_id, section_index, size_before, size_total, start_fraction, end_fraction FROM fr")
def section_fractions(spark, d):
    return progress.section_fractions(table(spark, d, "sections")).select("book_id", "section_index", "size_before", "size_total", "start_fraction", "end_fraction")


@query(f"""WITH {FRACTIONS_SQL} SELECT book_id, section_index, CASE WHEN size_total > 0 THEN (size_before + 0.5::DOUBLE * weight) / size_total ELSE 0.0 END AS total_fraction,
 CAST(floor((size_before + 0.5::DOUBLE * weight) / 1500) AS BIGINT) AS location, CAST(ceil(size_total / 1500) AS BIGINT) AS locations, size_total - (size_before + 0.5::DOUBLE * weight) AS remaining FROM fr""")
def progress_at(spark, d):
    return progress.progress_at(table(spark, d, "sections"), 0.5).select("book_id", "section_index", "total_fraction", "location", "locations", "remaining")


@query(f"WITH {FRACTIONS_SQL} SELECT book_id, max(section_index) FILTER (weight > 0 AND start_fraction <= 0.37) AS section_index FROM fr GROUP BY book_id")
def section_at_fraction(spark, d):
    return progress.section_at(table(spark, d, "sections"), 0.37)


@query("SELECT book_id, section_index, last_value(toc_label IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_label FROM sections")
def toc_forward_fill(spark, d):
    return progress.toc_fill(table(spark, d, "sections")).select("book_id", "section_index", "filled_label")


@query("SELECT book_id, section_index, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_index) AS position FROM sections WHERE linear IS NULL OR linear <> 'no') WHERE position <= 3")
def first_n_sections(spark, d):
    return progress.first_sections(table(spark, d, "sections"), 3).select("book_id", "section_index", "position")


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY book_id, unit_index ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM blocks WHERE text IS NOT NULL)
SELECT book_id, unit_index, block_index, length(text) > 800 - spent AS truncated, CASE WHEN length(text) > 800 - spent THEN rtrim(substring(text, 1, CAST(800 - spent AS BIGINT))) ELSE text END AS clipped FROM t WHERE spent < 800""")
def budget_clip(spark, d):
    return progress.clip(blocks(spark, d).filter("text is not null"), ["book_id", "unit_index"], ["block_index"], 800).select("book_id", "unit_index", "block_index", "truncated", "clipped")


@query("""WITH w AS (SELECT *, CASE WHEN linear = 'no' THEN 0 ELSE greatest(coalesce(size_bytes, 0), 0) END AS weight FROM sections),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_index) - 1 AS taken, coalesce(sum(weight) OVER (PARTITION BY book_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before FROM w WHERE weight > 0)
SELECT book_id, section_index, CAST(weight AS BIGINT) AS weight FROM k WHERE taken < 4 AND bytes_before < 96000""")
def density_sample(spark, d):
    return progress.density_sample(table(spark, d, "sections")).select("book_id", "section_index", "weight")


@query(f"""WITH {BLOCKS_SQL}, w AS (SELECT *, CASE WHEN linear = 'no' THEN 0 ELSE greatest(coalesce(size_bytes, 0), 0) END AS weight FROM sections),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_index) - 1 AS taken, coalesce(sum(weight) OVER (PARTITION BY book_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before FROM w WHERE weight > 0),
x AS (SELECT book_id, unit_index, coalesce(text, '') AS t FROM blocks), u AS (SELECT book_id, unit_index AS section_index, sum(CAST({_UNITS} AS DOUBLE)) AS units FROM x GROUP BY ALL),
dens AS (SELECT k.book_id, sum(coalesce(units, 0)) / sum(weight) AS density FROM k LEFT JOIN u USING (book_id, section_index) WHERE taken < 4 AND bytes_before < 96000 GROUP BY ALL),
tot AS (SELECT book_id, CAST(sum(weight) AS BIGINT) AS bytes FROM w GROUP BY ALL)
SELECT book_id, bytes, round(density, 6) AS density, greatest(1, CAST(ceil(coalesce(density, 0.5) * bytes / 412.67) AS BIGINT)) AS pages FROM tot LEFT JOIN dens USING (book_id)""")
def page_estimate(spark, d):
    units = once(raw(spark, d).select("block_uid", "book_id", F.col("unit_index").alias("section_index"), T.text_units(F.col("text")).cast("double").alias("units"))).groupBy("book_id", "section_index").agg(F.sum("units").alias("units"))
    return progress.page_estimate(table(spark, d, "sections"), units, 412.67).select("book_id", "bytes", F.round("density", 6).alias("density"), "pages")


@query(f"WITH {FRACTIONS_SQL} SELECT book_id, section_index, toc_label, start_fraction > 0.2 + 0.0001 AS disabled FROM fr WHERE toc_label IS NOT NULL")
def trial_toc_access(spark, d):
    return progress.trial_access(table(spark, d, "sections"), 0.2).select("book_id", "section_index", "toc_label", "disabled")


# ---------------------------------------------------------------- contents

TOC_SQL = "toc AS (SELECT book_id, section_index AS toc_index, toc_label AS label, href FROM sections WHERE toc_label IS NOT NULL)"


@query(f"""WITH {TOC_SQL}, keyed AS (SELECT book_id, regexp_replace(href, '#.*$', '') AS section_id, label, toc_index FROM toc), f AS (SELECT book_id, section_id, min_by(label, toc_index) AS label FROM keyed GROUP BY ALL)
SELECT s.book_id, s.section_index, coalesce(label, title, s.section_id, 'Section ' || (section_index + 1)) AS unit_title FROM sections s LEFT JOIN f ON s.book_id = f.book_id AND s.section_id = f.section_id""")
def units_with_titles(spark, d):
    t = toc_rows(spark, d).withColumn("section_id", F.regexp_replace("href", "#.*$", ""))
    return toc.units_with_titles(table(spark, d, "sections"), t).select("book_id", "section_index", "unit_title")


@query("SELECT book_id, section_index, array_to_string(list_filter(string_split(replace(regexp_replace(trim(href), '#.*$', ''), '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM sections")
def path_normalize(spark, d):
    return table(spark, d, "sections").select("book_id", "section_index", T.path_of(F.col("href")).alias("path"))


@query(f"""WITH {TOC_SQL}, refs AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(trim(href), '#.*$', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM toc),
secs AS (SELECT book_id, section_index, section_id, array_to_string(list_filter(string_split(regexp_replace(trim(section_id), '#.*$', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM sections)
SELECT r.book_id, r.toc_index, coalesce((SELECT max(section_index) FROM secs s WHERE s.book_id = r.book_id AND s.section_id = r.href), (SELECT max(section_index) FROM secs s WHERE s.book_id = r.book_id AND s.path = r.path),
 (SELECT min(section_index) FROM secs s WHERE s.book_id = r.book_id AND r.path <> '' AND ends_with(s.path, '/' || r.path))) AS resolved_index FROM refs r""")
def toc_resolve(spark, d):
    return toc.resolve(toc_rows(spark, d), table(spark, d, "sections")).select("book_id", "toc_index", "resolved_index")


@query(f"WITH {TOC_SQL} SELECT book_id, toc_index, count(*) OVER (PARTITION BY book_id, href) = 1 AS can_be_active FROM toc")
def href_unique_active(spark, d):
    return toc.active(toc_rows(spark, d)).select("book_id", "toc_index", "can_be_active")


@query("""WITH n AS (SELECT book_id, count(*) AS n FROM sections GROUP BY book_id), r AS (SELECT book_id, least(greatest(7, 0), n - 1) AS section_index FROM n)
SELECT book_id, CAST(section_index AS INTEGER) AS section_index, title FROM r JOIN sections USING (book_id, section_index)""")
def content_unit_clamped(spark, d):
    s = table(spark, d, "sections")
    at = s.groupBy("book_id").agg(toc.clamped(7, F.count("*")).cast("int").alias("section_index"))
    return at.join(s, ["book_id", "section_index"]).select("book_id", "section_index", "title")


@query("""WITH p AS (SELECT DISTINCT page_uid, book_id, page_index, label FROM fixed_pages)
SELECT page_uid, coalesce(label, 'Page ' || (page_index + 1)) AS title, CASE WHEN count(*) OVER (PARTITION BY book_id) > 1 THEN page_index / (count(*) OVER (PARTITION BY book_id) - 1) ELSE 0.0 END AS fraction,
 last_value(label IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_index, page_uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label_so_far FROM p""")
def page_units(spark, d):
    p = once(table(spark, d, "fixed_pages").select("page_uid", "book_id", "page_index", "label"), "page_uid")
    n = p.groupBy("book_id").agg(F.count("*").alias("n"))
    rows = lookup.filled(p, ["book_id"], "page_index", ["page_index", "page_uid"], "label", "label_so_far").join(n, "book_id")
    title = F.coalesce("label", F.concat(F.lit("Page "), (F.col("page_index") + 1).cast("string")))
    return rows.select("page_uid", title.alias("title"), F.when(F.col("n") > 1, F.col("page_index") / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("fraction"), "label_so_far")


@query("SELECT book_id, title FROM books WHERE list_has_all(coalesce(genres, []), ['essay']) AND (contains(lower(coalesce(title, '')), 'e') OR contains(lower(coalesce(author, '')), 'e'))")
def catalog_search(spark, d):
    b = table(spark, d, "books")
    wanted = F.size(F.array_except(F.array(F.lit("essay")), F.coalesce("genres", F.expr("cast(array() as array<string>)")))) == 0
    return b.filter(wanted & (F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("e")) | F.contains(F.lower(F.coalesce("author", F.lit(""))), F.lit("e")))).select("book_id", "title")


@query("SELECT b.book_id, CASE WHEN n IS NULL THEN 'available' WHEN n > 5 THEN 'installed' ELSE 'partial' END AS state FROM books b LEFT JOIN (SELECT book_id, count(*) AS n FROM sections GROUP BY book_id) s USING (book_id)")
def catalog_state(spark, d):
    n = table(spark, d, "sections").groupBy("book_id").agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "available").when(F.col("n") > 5, "installed").otherwise("partial")
    return table(spark, d, "books").join(n, "book_id", "left").select("book_id", state.alias("state"))


# ---------------------------------------------------------------- ranges


@query(f"WITH {VALID_SQL} SELECT segment_uid, start_offset, end_offset FROM valid")
def segment_validation(spark, d):
    return valid_segments(spark, d).select("segment_uid", "start_offset", "end_offset")


@query(f"""WITH {VALID_SQL}, found AS (SELECT DISTINCT r.result_id, b.book_id, b.unit_index, b.block_index, r.start_offset AS r_start, r.end_offset AS r_end FROM search_results r JOIN blocks b ON r.book_id = b.book_id AND r.unit_index = b.unit_index AND r.block_id = b.block_id)
SELECT segment_uid, result_id, greatest(v.start_offset, r_start) AS start_offset, least(v.end_offset, r_end) AS end_offset FROM valid v JOIN found USING (book_id, unit_index, block_index)
WHERE v.start_offset < r_end AND r_start < v.end_offset""")
def marks_overlap_ranges(spark, d):
    b = raw(spark, d).select("book_id", "unit_index", "block_index", "block_id")
    found = table(spark, d, "search_results").select("result_id", "book_id", "unit_index", "block_id", F.col("start_offset").alias("r_start"), F.col("end_offset").alias("r_end")).join(b, ["book_id", "unit_index", "block_id"]).drop("block_id").distinct()
    marks = valid_segments(spark, d).select("segment_uid", *ranges.BLOCK, F.col("start_offset").alias("m_start"), F.col("end_offset").alias("m_end"))
    return ranges.overlaps(marks, found).select("segment_uid", "result_id", "start_offset", "end_offset")


_REACHED = "max(end_offset) OVER (PARTITION BY book_id, unit_index, block_index ORDER BY start_offset, end_offset, segment_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH {VALID_SQL}, r AS (SELECT *, coalesce({_REACHED}, 0) AS reached FROM valid)
SELECT book_id, unit_index, block_index, reached AS gap_start, start_offset AS gap_end FROM r WHERE reached < start_offset
UNION ALL SELECT book_id, unit_index, block_index, max(end_offset), max(size) FROM valid GROUP BY ALL HAVING max(end_offset) < max(size)""")
def coverage_gaps(spark, d):
    return ranges.gaps(valid_segments(spark, d))


@query(f"WITH {VALID_SQL}, r AS (SELECT *, coalesce({_REACHED}, 0) AS reached FROM valid) SELECT segment_uid, greatest(start_offset, reached) AS start_offset, end_offset FROM r WHERE greatest(start_offset, reached) < end_offset")
def overlap_trim(spark, d):
    return ranges.trimmed(valid_segments(spark, d)).select("segment_uid", "start_offset", "end_offset")


@query(f"""WITH {VALID_SQL}, f AS (SELECT *, CASE WHEN lag(end_offset) OVER w >= start_offset AND lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND lag(segment_uid) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM valid
 WINDOW w AS (PARTITION BY book_id, unit_index, block_index ORDER BY start_offset, end_offset, segment_uid)),
g AS (SELECT *, sum(new) OVER (PARTITION BY book_id, unit_index, block_index ORDER BY start_offset, end_offset, segment_uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM f)
SELECT book_id, unit_index, block_index, speaker, min(start_offset) AS start_offset, max(end_offset) AS end_offset, count(*) AS merged_count FROM g GROUP BY book_id, unit_index, block_index, isle, speaker""")
def merge_adjacent(spark, d):
    return ranges.merged(valid_segments(spark, d), "speaker")


@query(f"WITH {VALID_SQL} SELECT book_id, unit_index, block_index, count(DISTINCT speaker) AS speakers, count(*) AS segments, bool_or(speaker IS NULL) AS has_narrator FROM valid GROUP BY ALL HAVING count(DISTINCT speaker) > 1")
def repair_candidates(spark, d):
    g = valid_segments(spark, d).groupBy(*ranges.BLOCK).agg(F.countDistinct("speaker").alias("speakers"), F.count("*").alias("segments"), F.bool_or(F.col("speaker").isNull()).alias("has_narrator"))
    return g.filter("speakers > 1")


@query(f"""WITH {BLOCKS_SQL}, {SEGS_SQL}, sized AS (SELECT book_id, unit_index, block_index, max(length(text)) AS size FROM blocks GROUP BY ALL),
t AS (SELECT segs.*, size, coalesce(s, 0) AS start_offset, coalesce(e, size) AS end_offset FROM segs LEFT JOIN sized USING (book_id, unit_index, block_index)),
r AS (SELECT *, {_REACHED.replace('ORDER BY start_offset, end_offset', 'ORDER BY start_offset, end_offset NULLS FIRST')} AS reached FROM t)
SELECT book_id, count(*) AS segments, count(*) FILTER (size IS NULL) AS unknown_blocks, count(*) FILTER (start_offset >= end_offset) AS invalid, count(*) FILTER (start_offset < 0 OR end_offset > size) AS out_of_range,
 count(*) FILTER (start_offset < reached) AS overlaps, count(*) FILTER (start_offset > coalesce(reached, 0)) AS gaps, count(*) FILTER (end_offset - start_offset BETWEEN 1 AND 5) AS tiny FROM r GROUP BY book_id""")
def segment_quality(spark, d):
    return ranges.quality(segments(spark, d), raw(spark, d))


@query(f"""WITH {VALID_SQL}, n AS (SELECT *, lead(segment_uid) OVER w AS next_uid, lead(start_offset) OVER w AS next_start, lead(speaker) OVER w AS next_speaker FROM valid WINDOW w AS (PARTITION BY book_id, unit_index, block_index ORDER BY start_offset, end_offset, segment_uid))
SELECT segment_uid, next_uid FROM n WHERE next_start - end_offset BETWEEN 0 AND 8 AND speaker = next_speaker""")
def adjacent_same_speaker(spark, d):
    return reports.adjacent_same(valid_segments(spark, d)).select("segment_uid", "next_uid")


@query(f"WITH {BLOCKS_SQL}, {SEGS_SQL} SELECT segment_uid FROM segs ANTI JOIN blocks USING (book_id, unit_index, block_index)")
def unknown_block_segments(spark, d):
    return segments(spark, d).join(raw(spark, d).select(*ranges.BLOCK), ranges.BLOCK, "left_anti").select("segment_uid")


# ---------------------------------------------------------------- folds, edits


_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIPPED = f"regexp_replace(@, '^{_WS}+|{_WS}+$', '', 'g')"


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, k AS (SELECT block_uid, book_id, unit_index, block_index, coalesce(text, '') AS text FROM blocks WHERE block_type IN ('paragraph', 'heading', 'listItem', 'blockquote', 'pre', 'table')),
s AS (SELECT *, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?；;]+[。！？.!?；;]*'), lambda x: {_STRIPPED.replace('@', 'x')}), lambda x: x <> '') AS parts FROM k),
f AS (SELECT block_uid, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS piece_index, parts[1] AS piece FROM s WHERE len(parts) > 0
 UNION ALL SELECT f.block_uid, f.i + 1, CASE WHEN length(piece) + 1 + length(parts[f.i + 1]) <= 100 THEN piece_index ELSE piece_index + 1 END, CASE WHEN length(piece) + 1 + length(parts[f.i + 1]) <= 100 THEN piece || ' ' || parts[f.i + 1] ELSE parts[f.i + 1] END
 FROM f JOIN s ON s.block_uid = f.block_uid WHERE f.i < len(parts)),
done AS (SELECT block_uid, piece_index, arg_max(piece, i) AS piece FROM f GROUP BY ALL),
bare AS (SELECT block_uid, {_STRIPPED.replace('@', 'text')} AS t FROM s WHERE len(parts) = 0),
cut AS (SELECT block_uid, unnest(range(0, CAST(ceil(length(t) / 100.0) AS BIGINT))) AS piece_index, t FROM bare WHERE t <> '')
SELECT book_id, unit_index, block_index, CAST(piece_index AS INTEGER) AS piece_index, piece FROM (SELECT * FROM done UNION ALL SELECT block_uid, piece_index, substring(t, piece_index * 100 + 1, 100) FROM cut) JOIN k USING (block_uid)""")
def split_sentences(spark, d):
    return folds.narration(blocks(spark, d))


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, o AS (SELECT book_id, unit_index, block_index, length(text) AS n, row_number() OVER (PARTITION BY book_id, unit_index ORDER BY block_index) AS k FROM blocks WHERE text IS NOT NULL),
f AS (SELECT book_id, unit_index, block_index, k, CAST(0 AS BIGINT) AS batch_index, CAST(n AS BIGINT) AS used FROM o WHERE k = 1
 UNION ALL SELECT o.book_id, o.unit_index, o.block_index, o.k, CASE WHEN f.used + o.n > 2000 THEN f.batch_index + 1 ELSE f.batch_index END, CASE WHEN f.used + o.n > 2000 THEN o.n ELSE f.used + o.n END
 FROM f JOIN o ON o.book_id = f.book_id AND o.unit_index = f.unit_index AND o.k = f.k + 1)
SELECT book_id, unit_index, block_index, CAST(batch_index AS INTEGER) AS batch_index FROM f""")
def pack_batches(spark, d):
    return folds.batches_of(blocks(spark, d))


@query(f"WITH {BLOCKS_SQL} SELECT block_uid FROM blocks WHERE block_type IN ('paragraph', 'heading', 'listItem', 'blockquote') AND length(trim(text)) >= 2 AND regexp_matches(text, '\\p{{L}}')")
def translatable_items(spark, d):
    return edits.translatable(raw(spark, d)).select("block_uid").distinct()


@query(f"""WITH {BLOCKS_SQL}, last AS (SELECT book_id, unit_index, block_id, max_by(excerpt, (searched_at, excerpt)) AS new_text FROM search_results WHERE excerpt IS NOT NULL GROUP BY ALL)
SELECT block_uid, new_text IS NOT NULL AS edited, coalesce(new_text, text) AS final_text FROM blocks LEFT JOIN last USING (book_id, unit_index, block_id)""")
def edit_overlay(spark, d):
    e = table(spark, d, "search_results").filter(F.col("excerpt").isNotNull()).select("book_id", "unit_index", "block_id", F.col("excerpt").alias("new_text"), F.col("searched_at").alias("version"))
    return edits.overlay(blocks(spark, d), e).select("block_uid", "edited", "final_text")


@query(f"""WITH {BLOCKS_SQL}, tr AS (SELECT book_id, unit_index, block_index, '[' || text || ']' AS translated FROM blocks WHERE block_type = 'heading'),
j AS (SELECT blocks.*, translated FROM blocks LEFT JOIN tr USING (book_id, unit_index, block_index))
SELECT book_id, unit_index, block_index, 0 AS part, text AS shown FROM j UNION ALL SELECT book_id, unit_index, block_index, 1, translated FROM j WHERE translated IS NOT NULL""")
def bilingual_blocks(spark, d):
    b = blocks(spark, d)
    tr = b.filter("block_type = 'heading'").select("book_id", "unit_index", "block_index", F.concat(F.lit("["), F.col("text"), F.lit("]")).alias("translated"))
    return edits.bilingual(b, tr)


# ---------------------------------------------------------------- reports, export


@query("SELECT event_type, count(*) AS requests, round(sum(value), 2) AS total, max(value) AS longest, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ROLLUP (event_type)")
def request_log_rollup(spark, d):
    return reports.request_log(table(spark, d, "events"), "event_type", "value", F.col("event_type") == "error").withColumn("total", F.round("total", 2))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def counts_by_reason(spark, d):
    return reports.counts(table(spark, d, "events"), "event_type")


@query("SELECT user_id, min(ts) AS first_seen, count(*) AS times FROM events GROUP BY user_id")
def first_seen_min(spark, d):
    return reports.first_seen(table(spark, d, "events"), "user_id", "ts")


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT book_id, unit_index, string_agg(text, chr(10) ORDER BY block_index, block_uid) AS body FROM blocks WHERE text IS NOT NULL GROUP BY ALL)
SELECT s.book_id, string_agg(repeat('-', 60) || chr(10) || coalesce(toc_label, title, section_id) || chr(10) || coalesce(body, ''), chr(10) ORDER BY section_index) AS exported FROM sections s LEFT JOIN t ON s.book_id = t.book_id AND section_index = unit_index
WHERE linear IS NULL OR linear <> 'no' GROUP BY s.book_id""")
def export_txt(spark, d):
    from ..sinks.text import book_texts

    return book_texts(table(spark, d, "sections"), blocks(spark, d))


_MARK = "[.,!?;:。，！？；：、]"


@query(f"""WITH {BLOCKS_SQL} SELECT block_uid, least(greatest((length(text) - length(regexp_replace(text, '{T.CJK}', '', 'g'))) * 180 + len(regexp_extract_all(text, '[A-Za-z0-9]+')) * 260 + len(regexp_extract_all(text, '{_MARK}')) * 120, 450), 30000) AS ms FROM blocks WHERE text IS NOT NULL""")
def duration_estimate(spark, d):
    return once(raw(spark, d).filter("text is not null").select("block_uid", narration.duration_ms(F.col("text")).alias("ms")))


@query()
def narration_atoms(spark, d):
    return narration.atom_rows(blocks(spark, d))


@query(f"WITH {BLOCKS_SQL} SELECT book_id, query_text, max_by(result_id, (searched_at, result_id)) AS result_id FROM (SELECT DISTINCT book_id, query_text, result_id, searched_at FROM search_results) GROUP BY ALL")
def latest_search(spark, d):
    return lookup.newest(table(spark, d, "search_results").select("book_id", "query_text", "result_id", "searched_at").distinct(), ["book_id", "query_text"], ["searched_at", "result_id"], "result_id")


@query(f"WITH {BLOCKS_SQL}, f AS (SELECT book_id, unit_index, block_type, min(block_index) AS first FROM blocks WHERE block_type IS NOT NULL GROUP BY ALL) SELECT book_id, unit_index, string_agg(block_type, ',' ORDER BY first) AS block_types FROM f GROUP BY ALL")
def kinds_in_order(spark, d):
    rows = lookup.first_seen_order(raw(spark, d).filter("block_type is not null"), ["book_id", "unit_index"], "block_type", "block_index")
    return rows.select("book_id", "unit_index", F.array_join("block_types", ",").alias("block_types"))


@query(f"WITH {BLOCKS_SQL} SELECT book_id, max_by(block_uid, (length(text), -block_uid)) AS block_uid FROM blocks WHERE length(text) > 0 GROUP BY book_id")
def longest_block(spark, d):
    return lookup.best(raw(spark, d).withColumn("n", F.length("text")).withColumn("o", F.col("block_uid")), ["book_id"], "n", "o", "block_uid")


@query("""WITH p AS (SELECT DISTINCT page_uid, book_id, page_index, label FROM fixed_pages), t AS (SELECT book_id, page_index, label FROM p WHERE label IS NOT NULL)
SELECT page_uid, book_id, page_index, (SELECT max_by(label, (t.page_index, label)) FROM t WHERE t.book_id = p.book_id AND t.page_index <= p.page_index) AS label FROM p""")
def toc_at_page(spark, d):
    p = once(table(spark, d, "fixed_pages").select("page_uid", "book_id", "page_index", "label"), "page_uid")
    entries = p.filter("label is not null").select("book_id", F.col("page_index").alias("toc_index"), "label", "page_index")
    return lookup.entry_at_page(entries, p)


def _pages(spark, d):
    """One piece of HTML for each section, made of its blocks."""
    tag = F.when(F.col("block_type") == "heading", "h2").when(F.col("block_type") == "blockquote", "blockquote").when(F.col("block_type") == "pre", "pre").otherwise("p")
    one = F.concat(F.lit("<"), tag, F.lit(' id="'), F.coalesce("block_id", F.lit("")), F.lit('">'), T.escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    rows = blocks(spark, d).filter("text is not null").groupBy("book_id", "unit_index").agg(F.array_sort(F.collect_list(F.struct("block_index", "block_uid", one.alias("one")))).alias("r"))
    return rows.select("book_id", "unit_index", F.array_join("r.one", "").alias("html"))


@query()
def html_nodes(spark, d):
    return nodes.html_nodes(_pages(spark, d), ["book_id", "unit_index"], "html")


@query(f"""WITH {BLOCKS_SQL} SELECT book_id, unit_index, count(*) AS headings FROM blocks WHERE block_type = 'heading' AND text IS NOT NULL GROUP BY ALL""")
def node_query(spark, d):
    return nodes.select(html_nodes(spark, d), tag="h2").groupBy("book_id", "unit_index").agg(F.count("*").alias("headings"))


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT *, CASE block_type WHEN 'heading' THEN 'heading' WHEN 'blockquote' THEN 'blockquote' WHEN 'pre' THEN 'pre' ELSE 'paragraph' END AS kind FROM blocks WHERE text IS NOT NULL),
t AS (SELECT *, CASE WHEN kind = 'pre' THEN regexp_replace(text, '^\n+|\n+$', '', 'g') ELSE trim(regexp_replace(text, '{_WS}+', ' ', 'g')) END AS shown FROM b WHERE length(regexp_replace(text, '{_WS}', '', 'g')) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY book_id, unit_index ORDER BY t.block_index, block_uid) - 1 AS place FROM t)
SELECT book_id, unit_index, CAST(place AS INTEGER) AS block_index, coalesce(nullif(block_id, ''), kind || '-' || place) AS block_id, kind AS block_type, CASE WHEN kind = 'heading' THEN 2 ELSE 0 END AS depth, shown AS text FROM n""")
def html_blocks(spark, d):
    return nodes.html_blocks(_pages(spark, d), ["book_id", "unit_index"], "html")


@query()
def export_epub(spark, d):
    from ..sinks.files import export_rows
    from ..sinks.text import section_bodies

    s = table(spark, d, "sections")
    rows = s.select("book_id", "section_index", "linear", F.coalesce("toc_label", "title", "section_id").alias("label")).join(section_bodies(blocks(spark, d)), ["book_id", "section_index"], "left")
    return export_rows(table(spark, d, "books"), rows).select("book_id", "file_name", F.octet_length("content").alias("size"))


from . import reading  # noqa: E402, F401  its queries register themselves


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
