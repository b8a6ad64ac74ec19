"""Queries of content, contents, limits and reports that the first registry doesn't hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content, layout, nodes, records, reports, search, toc, trial
from . import registry as R
from .registry import BLOCKS_SQL, FRACTIONS_SQL, SEGS_SQL, TOC_SQL, VALID_SQL, query

PER_PAGE = trial.units_per_page()
RESOLVED_SQL = f"""{TOC_SQL}, refs AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(trim(href), '#.*$', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM toc),
secs AS (SELECT book_id, section_index, section_id, array_to_string(list_filter(string_split(regexp_replace(trim(section_id), '#.*$', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM sections),
led AS (SELECT r.book_id, r.toc_index, r.label, r.href, coalesce((SELECT max(section_index) FROM secs s WHERE s.book_id = r.book_id AND s.section_id = r.href), (SELECT max(section_index) FROM secs s WHERE s.book_id = r.book_id AND s.path = r.path),
 (SELECT min(section_index) FROM secs s WHERE s.book_id = r.book_id AND r.path <> '' AND ends_with(s.path, '/' || r.path))) AS resolved_index FROM refs r)"""
PAGES_SQL = f"""w AS (SELECT *, CASE WHEN linear = 'no' THEN 0 ELSE greatest(coalesce(size_bytes, 0), 0) END AS weight FROM sections),
sz AS (SELECT book_id, sum(weight) AS bytes, count(*) AS n_all, count(*) FILTER (linear IS NULL OR linear <> 'no') AS n_line FROM w GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_index) - 1 AS taken, coalesce(sum(weight) OVER (PARTITION BY book_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before FROM w WHERE weight > 0),
x AS (SELECT book_id, unit_index, coalesce(text, '') AS t FROM blocks), un AS (SELECT book_id, unit_index AS section_index, sum(CAST({R._UNITS} AS DOUBLE)) AS units FROM x GROUP BY ALL),
sm AS (SELECT k.book_id, sum(coalesce(units, 0)) AS u, sum(weight) AS w FROM k LEFT JOIN un USING (book_id, section_index) WHERE taken < 4 AND bytes_before < 96000 GROUP BY ALL),
pl AS (SELECT book_id, count(*) AS n FROM (SELECT DISTINCT page_uid, book_id FROM fixed_pages WHERE label IS NOT NULL) GROUP BY ALL),
pages AS (SELECT book_id, CAST(CASE WHEN coalesce(n, 0) > 0 THEN n WHEN book_format IN ('pdf', 'cbz') THEN greatest(1, coalesce(nullif(n_line, 0), n_all, 0))
  WHEN coalesce(u, 0) > 0 AND coalesce(sm.w, 0) > 0 THEN ceil(coalesce(bytes, 0) * (u / sm.w) / {PER_PAGE!r}) ELSE ceil(coalesce(bytes, 0) / 2.4 / {PER_PAGE!r}) END AS BIGINT) AS pages,
  CASE WHEN coalesce(n, 0) > 0 THEN 'page-list' WHEN book_format IN ('pdf', 'cbz') THEN 'pre-paginated-sections' WHEN coalesce(u, 0) > 0 AND coalesce(sm.w, 0) > 0 THEN 'sampled-text' ELSE 'section-size' END AS estimated_by
  FROM books LEFT JOIN pl USING (book_id) LEFT JOIN sz USING (book_id) LEFT JOIN sm USING (book_id)),
state AS (SELECT *, CAST(least(5.0 / greatest(pages, 1, 5), 1.0) AS DOUBLE) AS limit_fraction, CAST(least(5.0 / greatest(pages, 1, 5), 1.0) / 5 AS DOUBLE) AS page_step FROM pages)"""


def _pages(spark, d):
    books = R.table(spark, d, "books").select("book_id", F.col("book_format").isin("pdf", "cbz").alias("fixed"))
    listed = R.once(R.table(spark, d, "fixed_pages").filter("label is not null").select("page_uid", "book_id"), "page_uid").groupBy("book_id").agg(F.count("*").alias("n"))
    units = R.once(R.raw(spark, d).select("block_uid", "book_id", F.col("unit_index").alias("section_index"), T.text_units(F.col("text")).cast("double").alias("units"))).groupBy("book_id", "section_index").agg(F.sum("units").alias("units"))
    return trial.page_counts(books, R.table(spark, d, "sections"), listed, units, PER_PAGE)


def _limit(spark, d):
    return trial.limit_state(_pages(spark, d), 5)


def _led(spark, d):
    """Contents entries with the section they lead to; the tables' entries are all of one level."""
    return toc.resolve(R.toc_rows(spark, d), R.table(spark, d, "sections")).select("book_id", "toc_index", F.lit(0).alias("depth"), "label", "href", "resolved_index")


@query(f"WITH {BLOCKS_SQL}, {PAGES_SQL} SELECT book_id, pages, estimated_by FROM pages")
def page_count_estimate(spark, d):
    return _pages(spark, d)


@query(f"WITH {BLOCKS_SQL}, {PAGES_SQL} SELECT book_id, pages, estimated_by, limit_fraction, page_step FROM state")
def trial_limit_state(spark, d):
    return _limit(spark, d)


@query(f"WITH {FRACTIONS_SQL} SELECT book_id, section_index, start_fraction + 2.220446049250313e-16::DOUBLE AS fraction FROM fr UNION ALL SELECT book_id, max(section_index) + 1, max(end_fraction) + 2.220446049250313e-16::DOUBLE FROM fr GROUP BY book_id")
def boundary_fractions(spark, d):
    return trial.boundaries(R.table(spark, d, "sections"))


@query(f"""WITH {BLOCKS_SQL}, {PAGES_SQL}, {RESOLVED_SQL}, {FRACTIONS_SQL}
SELECT led.book_id, led.toc_index, '0-' || led.toc_index || '-' || coalesce(led.href, '') AS key, coalesce(nullif(led.label, ''), 'Untitled') AS label, 0 AS depth, led.resolved_index, coalesce(start_fraction, 0.0) AS section_fraction,
 led.resolved_index IS NOT NULL AND coalesce(start_fraction, 0.0) > limit_fraction + 0.0001::DOUBLE AS disabled FROM led LEFT JOIN fr ON fr.book_id = led.book_id AND fr.section_index = led.resolved_index JOIN state ON state.book_id = led.book_id""")
def trial_toc_items(spark, d):
    return trial.toc_access(_led(spark, d), R.table(spark, d, "sections"), _limit(spark, d).select("book_id", "limit_fraction"))


@query(f"""WITH {BLOCKS_SQL}, {PAGES_SQL}, {FRACTIONS_SQL}, g AS (SELECT fr.*, limit_fraction, page_step, coalesce(lead(start_fraction) OVER (PARTITION BY fr.book_id ORDER BY section_index), 1.0) AS following FROM fr JOIN state ON state.book_id = fr.book_id),
t AS (SELECT *, least(greatest(start_fraction + greatest(following - start_fraction, 0) * 0.5::DOUBLE, 0.0), 1.0) AS total_fraction FROM g)
SELECT book_id, section_index, total_fraction, start_fraction <= limit_fraction + 0.0001::DOUBLE AS can_go_to, total_fraction + page_step <= limit_fraction + 0.0001::DOUBLE AS can_go_next, following AS next_fraction FROM t""")
def trial_can_go(spark, d):
    return trial.go(R.table(spark, d, "sections"), _limit(spark, d).select("book_id", "limit_fraction", "page_step"), 0.5)


@query(f"""WITH {RESOLVED_SQL} SELECT s.book_id, s.section_index, coalesce((SELECT min(toc_index) FROM led WHERE led.book_id = s.book_id AND resolved_index = s.section_index), (SELECT max(toc_index) FROM led WHERE led.book_id = s.book_id AND resolved_index < s.section_index)) AS toc_index FROM sections s""")
def trial_current_item(spark, d):
    return trial.current_entry(_led(spark, d), R.table(spark, d, "sections"))


# ---------------------------------------------------------------- content

UNITS_SQL = f"""{TOC_SQL}, keyed AS (SELECT book_id, regexp_replace(href, '#.*$', '') AS section_id, label, toc_index FROM toc), firsts AS (SELECT book_id, section_id, min_by(label, toc_index) AS label FROM keyed GROUP BY ALL),
units AS (SELECT s.book_id, s.section_index AS unit_index, coalesce(label, title, s.section_id, 'Section ' || (section_index + 1)) AS unit_title FROM sections s LEFT JOIN firsts f ON s.book_id = f.book_id AND s.section_id = f.section_id)"""


def _units(spark, d):
    return R.units_with_titles(spark, d).withColumnRenamed("section_index", "unit_index")


@query(f"""WITH {BLOCKS_SQL}, {UNITS_SQL}, z AS (SELECT book_id, unit_index, count(*) AS blocks, sum(length(text)) + count(*) - 1 AS chars FROM blocks WHERE length(text) > 0 GROUP BY ALL)
SELECT book_id, unit_index, unit_title, coalesce(z.blocks, 0) AS blocks, CAST(coalesce(chars, 0) AS BIGINT) AS char_count FROM units LEFT JOIN z USING (book_id, unit_index)""")
def content_units(spark, d):
    sizes = R.once(R.raw(spark, d).select("block_uid", "book_id", "unit_index", "text"))
    return content.unit_list(_units(spark, d), sizes)


@query(f"""WITH {BLOCKS_SQL}, j AS (SELECT book_id, unit_index, string_agg(text, chr(10) ORDER BY block_index) AS t FROM blocks WHERE length(text) > 0 GROUP BY ALL) SELECT book_id, unit_index, rtrim(substring(t, 1, 12000), ' ') AS text, length(t) > 12000 AS truncated FROM j""")
def content_text(spark, d):
    return content.unit_texts(R.blocks(spark, d))


@query(f"""WITH {BLOCKS_SQL}, {FRACTIONS_SQL}, cur AS (SELECT book_id, max(section_index) FILTER (weight > 0 AND start_fraction <= 0.37) AS unit FROM fr GROUP BY book_id),
t AS (SELECT b.*, coalesce(sum(length(text)) OVER (PARTITION BY b.book_id ORDER BY unit_index, block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM blocks b JOIN cur USING (book_id) WHERE unit_index BETWEEN unit - 1 AND unit + 1 AND text IS NOT NULL)
SELECT book_id, unit_index, block_index, CASE WHEN length(text) > 2000 - spent THEN rtrim(substring(text, 1, CAST(2000 - spent AS BIGINT)), ' ') ELSE text END AS clipped FROM t WHERE spent < 2000""")
def context_window(spark, d):
    """The unit a reader at 37 % of each book is in, with its neighbours."""
    from ..operators import progress

    current = progress.section_at(R.table(spark, d, "sections"), 0.37).withColumnRenamed("section_index", "unit")
    rows = R.raw(spark, d).filter("text is not null").select("block_uid", "book_id", "unit_index", "block_index", "text")
    return content.around(R.once(rows), current, 1, 1, 2000).select("book_id", "unit_index", "block_index", "clipped")


@query(f"WITH {RESOLVED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY toc_index) AS k FROM led) SELECT book_id, toc_index, 0 AS depth, label, resolved_index AS unit_index FROM n WHERE k <= 80")
def contents_list(spark, d):
    return content.contents_list(_led(spark, d))


@query(f"WITH {RESOLVED_SQL} SELECT book_id, toc_index, CAST(row_number() OVER (PARTITION BY book_id ORDER BY resolved_index, toc_index) - 1 AS INTEGER) AS position FROM led WHERE resolved_index IS NOT NULL")
def toc_positions(spark, d):
    return content.toc_positions(_led(spark, d)).select("book_id", "toc_index", "position")


_FORM = "array_to_string(list_filter(string_split(replace(regexp_replace(trim({0}), '#.*$', ''), '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') || CASE WHEN regexp_extract(trim({0}), '#(.*)$', 1) <> '' THEN '#' || regexp_extract(trim({0}), '#(.*)$', 1) ELSE '' END"


@query(f"""WITH {TOC_SQL}, p AS (SELECT book_id, toc_index, href, lag(href) OVER (PARTITION BY book_id ORDER BY toc_index) AS above FROM toc)
SELECT book_id, toc_index, coalesce({_FORM.format('href')} <> '' AND {_FORM.format('href')} = {_FORM.format('above')}, false) AS same_as_above FROM p""")
def toc_same_entry(spark, d):
    from pyspark.sql import Window as W

    above = F.lag("href").over(W.partitionBy("book_id").orderBy("toc_index"))
    rows = R.toc_rows(spark, d).withColumn("above", above)
    return rows.select("book_id", "toc_index", content.same_entry(F.col("href"), F.col("above")).alias("same_as_above"))


@query(f"WITH {BLOCKS_SQL} SELECT block_uid, 0 AS start_offset, coalesce(length(text), 0) AS end_offset FROM blocks")
def block_ranges(spark, d):
    return R.once(content.block_ranges(R.raw(spark, d)))


@query("SELECT greatest((SELECT max(block_uid) FROM unit_texts), (SELECT max(segment_uid) FROM tts_segments), (SELECT max(page_uid) FROM fixed_pages), (SELECT max(result_id) FROM search_results)) + 1 AS next_id")
def next_free_id(spark, d):
    return content.next_id(*[R.table(spark, d, t).select(c) for t, c in (("unit_texts", "block_uid"), ("tts_segments", "segment_uid"), ("fixed_pages", "page_uid"), ("search_results", "result_id"))])


# ---------------------------------------------------------------- search

@query(R._search_sql("lantern", tail="ORDER BY book_id, unit_index, block_index, start_offset LIMIT 8").replace("48", "96").replace("SELECT book_id, unit_index, block_index, start_offset, match_index,", "SELECT h.book_id, h.unit_index, h.block_index, start_offset, match_index, concat_ws(' · ', s.title, b.block_id) AS label, 'book://j/' || h.unit_index || '/' || url_encode(coalesce(b.block_id, '')) AS link,").replace("substring(text,", "substring(h.text,").replace("length(text)) -", "length(h.text)) -").replace("< length(text)", "< length(h.text)").replace("FROM numbered ORDER BY book_id, unit_index, block_index, start_offset", "FROM numbered h JOIN blocks b ON b.book_id = h.book_id AND b.unit_index = h.unit_index AND b.block_index = h.block_index LEFT JOIN sections s ON s.book_id = h.book_id AND s.section_index = h.unit_index ORDER BY h.book_id, h.unit_index, h.block_index, start_offset"))
def search_with_citations(spark, d):
    units = R.table(spark, d, "sections").select("book_id", F.col("section_index").alias("unit_index"), "title")
    return search.search_citations(R.raw(spark, d), units, " lantern ").drop("block_id", "title")


@query(f"WITH {BLOCKS_SQL} SELECT block_uid, book_id, 1 AS score FROM blocks WHERE contains(lower(text), 'letter') AND (unit_index > 1 OR unit_index = 1 AND block_index >= 2) AND (unit_index < 3 OR unit_index = 3 AND block_index <= 4)")
def search_in_range(spark, d):
    chunks = R.raw(spark, d).select("block_uid", "book_id", "unit_index", "block_index", "text")
    return R.once(search.provider_search(chunks, "Letter", (1, 2), (3, 4)).select("block_uid", "book_id", "score"))


RUNS_SQL = "runs AS (SELECT run_uid, any_value(book_id) AS book_id, any_value(page_index) AS page_index, any_value(run_index) AS run_index, any_value(text) AS text, any_value(transform_matrix) AS m, any_value(width) AS width, any_value(height) AS height FROM text_runs GROUP BY run_uid)"


@query(f"""WITH {RUNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_index ORDER BY run_index, run_uid) - 1 AS n FROM runs)
SELECT run_uid, 'pdf:' || page_index || ':text:' || n AS chunk_id, m[5] AS x, m[6] - height AS y FROM n WHERE length(regexp_replace(text, '{R._SP}', '', 'g')) > 0""")
def fixed_page_chunks(spark, d):
    runs = R.once(R.table(spark, d, "text_runs").select("run_uid", "book_id", "page_index", "run_index", "text", "transform_matrix", "width", "height"), "run_uid")
    return search.page_chunks(runs).select("run_uid", "chunk_id", "x", "y")


# ---------------------------------------------------------------- reports

_PATH = "array_to_string(list_filter(string_split(replace(regexp_replace(trim(href), '#.*$', ''), '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/')"


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(href, '^(?:text|OEBPS)/') THEN 'text' WHEN regexp_matches(href, '^(?:sec|ch|chapter)-?[0-9]') THEN 'section' WHEN regexp_matches(href, '^page:[0-9]+') THEN 'page' WHEN href <> '' THEN 'path' ELSE 'other' END AS kind FROM sections) GROUP BY kind")
def reference_kinds(spark, d):
    rules = [("text", r"^(?:text|OEBPS)/"), ("section", r"^(?:sec|ch|chapter)-?[0-9]"), ("page", r"^page:[0-9]+"), ("path", r"^.")]
    return R.table(spark, d, "sections").select(reports.classified(F.col("href"), rules).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {BLOCKS_SQL}, {SEGS_SQL}, sized AS (SELECT book_id, unit_index, block_index, max(length(text)) AS size FROM blocks GROUP BY ALL),
t AS (SELECT segs.*, size, least(greatest(coalesce(s, 0), 0), size) AS a, least(greatest(coalesce(e, size), 0), size) AS z FROM segs LEFT JOIN sized USING (book_id, unit_index, block_index)),
l AS (SELECT *, lag(z) OVER w AS before, lag(speaker) OVER w AS speaker_before, lag(segment_uid) OVER w AS uid_before FROM t WINDOW w AS (PARTITION BY book_id, unit_index, block_index ORDER BY a NULLS FIRST, z NULLS FIRST, segment_uid))
SELECT book_id, count(*) AS segments, count(*) FILTER (size IS NULL) AS unknown_blocks, count(*) FILTER (z - a BETWEEN 0 AND 5) AS tiny, count(*) FILTER (a - before BETWEEN 0 AND 8 AND uid_before IS NOT NULL) AS adjacent,
 count(*) FILTER (a - before BETWEEN 0 AND 8 AND speaker = speaker_before) AS adjacent_same FROM l GROUP BY book_id""")
def prepared_segments(spark, d):
    return reports.prepared(R.segments(spark, d), R.raw(spark, d))


@query(f"""WITH {VALID_SQL}, t AS (SELECT v.*, substring(b.text, v.start_offset + 1, v.end_offset - v.start_offset) AS part FROM valid v JOIN (SELECT book_id, unit_index, block_index, max(text) AS text FROM blocks GROUP BY ALL) b USING (book_id, unit_index, block_index)),
n AS (SELECT *, lead(segment_uid) OVER w AS next_uid, lead(start_offset) OVER w AS next_start, lead(speaker) OVER w AS next_speaker, lead(length(part)) OVER w AS next_size FROM t WINDOW w AS (PARTITION BY book_id, unit_index, block_index ORDER BY start_offset, end_offset, segment_uid))
SELECT segment_uid, next_uid FROM n WHERE next_start - end_offset BETWEEN 0 AND 8 AND speaker IS NOT DISTINCT FROM next_speaker AND length(part) + next_size + 1 <= 400 AND next_uid IS NOT NULL""")
def adjacent_joinable(spark, d):
    """Neighbours of one speaker, or of none, that would still be short enough when joined."""
    return reports.adjacent_same(R.valid_segments(spark, d), most=400, none_is_one=True).select("segment_uid", "next_uid")


@query(f"""WITH {BLOCKS_SQL}, d AS (SELECT block_uid, book_id, unit_index, block_index, least(greatest((length(text) - length(regexp_replace(text, '{T.CJK}', '', 'g'))) * 180 + len(regexp_extract_all(text, '[A-Za-z0-9]+')) * 260 + len(regexp_extract_all(text, '{R._MARK}')) * 120, 450), 30000) AS ms FROM blocks WHERE text IS NOT NULL),
f AS (SELECT book_id, unit_index, b AS block_index, min(received_at) AS seen FROM tts_segments GROUP BY ALL), z AS (SELECT book_id, unit_index, min(seen) AS begun FROM f GROUP BY ALL),
j AS (SELECT d.*, seen, (epoch_us(seen) - epoch_us(begun)) / 1000.0 AS first_seen_ms FROM d LEFT JOIN f USING (book_id, unit_index, block_index) LEFT JOIN z USING (book_id, unit_index)),
p AS (SELECT *, coalesce(sum(CASE WHEN seen IS NOT NULL THEN ms ELSE 0 END) OVER (PARTITION BY book_id, unit_index ORDER BY block_index, block_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS predicted FROM j)
SELECT book_id, unit_index, count(*) AS items, count(*) FILTER (seen IS NULL) AS missing, count(*) FILTER (first_seen_ms - predicted > 500) AS wait_risks, round(CAST(min(first_seen_ms) AS DOUBLE), 3) AS first_result_ms, round(CAST(max(first_seen_ms) AS DOUBLE), 3) AS last_result_ms FROM p GROUP BY ALL""")
def synthesis_report(spark, d):
    from ..operators import narration

    items = R.once(R.raw(spark, d).filter("text is not null").select("block_uid", "book_id", "unit_index", "block_index", narration.duration_ms(F.col("text")).alias("ms")))
    seen = R.table(spark, d, "tts_segments").select("book_id", "unit_index", F.col("b").alias("block_index"), F.col("received_at").alias("at"))
    return reports.synthesis(items, seen)


@query(f"WITH {SEGS_SQL}, own AS (SELECT DISTINCT book_id, unit_index, i AS id FROM segs WHERE i IS NOT NULL), x AS (SELECT DISTINCT segment_uid, book_id, unit_index, unnest(speaker_ids) AS id FROM tts_segments) SELECT DISTINCT book_id, unit_index, id FROM x ANTI JOIN own USING (book_id, unit_index, id) WHERE id IS NOT NULL")
def plan_unknown_ids(spark, d):
    t = R.table(spark, d, "tts_segments")
    return reports.not_asked_for(t.select("book_id", "unit_index", F.explode("speaker_ids").alias("id")), t.select("book_id", "unit_index", F.col("i").alias("id")), ["book_id", "unit_index"], "id")


@query(f"WITH {BLOCKS_SQL} SELECT book_id, unit_index, block_id, count(*) AS times, count(DISTINCT block_type) AS kinds FROM blocks WHERE block_id IS NOT NULL GROUP BY book_id, unit_index, block_id HAVING count(*) > 1")
def repeated_ids(spark, d):
    rows = R.once(R.raw(spark, d).drop("text")).filter("block_id is not null")
    return reports.repeated(rows, ["book_id", "unit_index", "block_id"], F.countDistinct("block_type").alias("kinds"))


@query("WITH m AS (SELECT event_type, avg(value) AS mean_value, sum(value) AS total FROM events GROUP BY event_type) SELECT event_type, round(mean_value, 6) AS mean_value, round(total, 2) AS total, round((SELECT mean_value FROM m WHERE event_type = 'view') / mean_value, 6) AS ratio FROM m")
def averaged_comparison(spark, d):
    return reports.compared(R.table(spark, d, "events"), "event_type", "value", "view")


@query("""WITH older AS (SELECT book_id, i AS id, max(c) AS c, max(p) AS p FROM tts_segments WHERE i IS NOT NULL GROUP BY ALL), newer AS (SELECT book_id, id, max(c) AS c, max(p) AS p FROM (SELECT book_id, unnest(speaker_ids) AS id, c, p FROM tts_segments) WHERE id IS NOT NULL GROUP BY ALL)
SELECT book_id, id, coalesce(n.c, o.c) AS c, coalesce(n.p, o.p) AS p FROM older o FULL JOIN newer n USING (book_id, id)""")
def merged_speakers(spark, d):
    """Records of speakers as segments name them singly, overlaid by those of the lists of speakers."""
    t = R.table(spark, d, "tts_segments")
    top = [F.max("c").alias("c"), F.max("p").alias("p")]
    older = t.filter("i is not null").groupBy("book_id", F.col("i").alias("id")).agg(*top)
    newer = t.select("book_id", F.explode("speaker_ids").alias("id"), "c", "p").filter("id is not null").groupBy("book_id", "id").agg(*top)
    return records.merged(older, newer, ["book_id", "id"], ["c", "p"])


@query(f"""WITH {VALID_SQL}, found AS (SELECT DISTINCT b.book_id, b.unit_index, b.block_index, r.start_offset AS r_start, r.end_offset AS r_end FROM search_results r JOIN blocks b ON r.book_id = b.book_id AND r.unit_index = b.unit_index AND r.block_id = b.block_id),
cuts AS (SELECT segment_uid, start_offset AS place FROM valid UNION SELECT segment_uid, end_offset FROM valid UNION SELECT segment_uid, unnest([r_start, r_end]) FROM valid v JOIN found USING (book_id, unit_index, block_index) WHERE v.start_offset < r_end AND r_start < v.end_offset),
inner_cuts AS (SELECT c.segment_uid, place FROM cuts c JOIN valid v USING (segment_uid) WHERE place BETWEEN v.start_offset AND v.end_offset)
SELECT * FROM (SELECT segment_uid, place AS start_offset, lead(place) OVER (PARTITION BY segment_uid ORDER BY place) AS end_offset FROM inner_cuts) WHERE end_offset IS NOT NULL""")
def split_by_intervals(spark, d):
    from ..operators import ranges

    b = R.raw(spark, d).select("book_id", "unit_index", "block_index", "block_id")
    found = R.table(spark, d, "search_results").select("book_id", "unit_index", "block_id", F.col("start_offset").alias("r_start"), F.col("end_offset").alias("r_end")).join(b, ["book_id", "unit_index", "block_id"]).drop("block_id").distinct()
    return ranges.cut_at(R.valid_segments(spark, d), found)


@query(f"""WITH {TOC_SQL}, s AS (SELECT book_id, toc_index, label FROM toc), tr AS (SELECT book_id, section_index AS toc_index, title FROM sections WHERE title <> toc_label)
SELECT book_id, toc_index, coalesce(title, label) AS replaced, CASE WHEN title IS NOT NULL THEN label || ' / ' || title ELSE label END AS both FROM s LEFT JOIN tr USING (book_id, toc_index)""")
def translated_labels(spark, d):
    """Contents labels with what stands for them in the sections' own titles, in their place and beside them."""
    from ..operators import edits

    tr = R.table(spark, d, "sections").filter("title <> toc_label").select("book_id", F.col("section_index").alias("toc_index"), F.col("title").alias("translated"))
    return edits.labels(R.toc_rows(spark, d).select("book_id", "toc_index", "label"), tr)


@query(f"""WITH {BLOCKS_SQL} SELECT block_uid, length(regexp_replace(text, '[\\s"''“”‘’「」『』()\\[\\]{{}}<>《》。，、？！：；,.!?;:\\-—–…]+', '', 'g')) > 0 AS speakable,
 regexp_replace(text, '[\\s\\x{{A0}}]*[\\[［]\\s*[0-9]{{1,4}}\\s*[\\]］]|[\\s\\x{{A0}}]*[¹²³⁴⁵⁶⁷⁸⁹⁰]+', '', 'g') AS plain FROM blocks WHERE text IS NOT NULL""")
def narration_text(spark, d):
    return R.once(R.raw(spark, d).filter("text is not null").select("block_uid", T.speakable(F.col("text")).alias("speakable"), T.without_references(F.col("text")).alias("plain")))


@query("""WITH p AS (SELECT page_uid, any_value(width) AS width, any_value(height) AS height, any_value(rotation) AS rotation FROM fixed_pages GROUP BY page_uid)
SELECT page_uid, CASE WHEN rotation IN (90, 270) THEN height ELSE width END * 1.5 AS css_width, CASE WHEN rotation IN (90, 270) THEN width ELSE height END * 1.5 AS css_height,
 CAST(greatest(1, floor(CASE WHEN rotation IN (90, 270) THEN height ELSE width END * 1.5 * 2 + 0.5)) AS INTEGER) AS pixel_width FROM p WHERE rotation IN (0, 90, 180, 270) AND width > 0 AND height > 0""")
def page_viewports(spark, d):
    p = R.once(R.table(spark, d, "fixed_pages").select("page_uid", "width", "height", "rotation"), "page_uid")
    v = T.viewport(F.col("width"), F.col("height"), F.col("rotation"), 1.5, 2.0)
    return p.withColumn("v", v).filter("v is not null").select("page_uid", "v.css_width", "v.css_height", "v.pixel_width")


@query(f"""WITH {RUNS_SQL} SELECT run_uid, round(least(m[5], m[1] * width + m[5], m[3] * height + m[5], m[1] * width + m[3] * height + m[5]), 6) AS bound_left, round(greatest(m[6], m[2] * width + m[6], m[4] * height + m[6], m[2] * width + m[4] * height + m[6]), 6) AS bound_bottom FROM runs WHERE len(m) = 6 AND width IS NOT NULL AND height IS NOT NULL""")
def run_bounds(spark, d):
    r = R.once(R.table(spark, d, "text_runs").filter("size(transform_matrix) = 6 and width is not null and height is not null").select("run_uid", "transform_matrix", "width", "height"), "run_uid")
    b = T.bounds(F.col("transform_matrix"), F.col("width"), F.col("height"))
    return r.withColumn("b", b).select("run_uid", F.round("b.left", 6).alias("bound_left"), F.round("b.bottom", 6).alias("bound_bottom"))


# ---------------------------------------------------------------- segments, tables, layout


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT book_id, unit_index, block_index, block_uid, regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g') AS t, row_number() OVER (PARTITION BY book_id, unit_index ORDER BY block_index, block_uid) - 1 AS k FROM blocks WHERE text IS NOT NULL AND regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g') <> '')
SELECT book_id, unit_index, CAST(row_number() OVER (PARTITION BY book_id, unit_index ORDER BY block_index, block_uid) - 1 AS INTEGER) AS block, t AS text FROM t""")
def html_segments(spark, d):
    """Segments of the sections' HTML: one for each block with text, as no block holds elements."""
    return nodes.html_segments(R._pages(spark, d), ["book_id", "unit_index"], "html").select("book_id", "unit_index", "block", "text")


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT book_id, unit_index, text, CASE block_type WHEN 'heading' THEN 'h2' WHEN 'blockquote' THEN 'blockquote' WHEN 'pre' THEN 'pre' ELSE 'p' END AS tag, coalesce(block_id, '') AS own,
  row_number() OVER w - 1 AS k, coalesce(sum(1 + CAST(text <> '' AS INTEGER)) OVER (PARTITION BY book_id, unit_index ORDER BY block_index, block_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_node FROM blocks WHERE text IS NOT NULL WINDOW w AS (PARTITION BY book_id, unit_index ORDER BY block_index, block_uid))
SELECT book_id, unit_index, CAST(first_node AS INTEGER) AS node_index, CAST(k AS VARCHAR) AS place, tag AS type, own AS element_id, NULL::VARCHAR AS text FROM t UNION ALL SELECT book_id, unit_index, CAST(first_node + 1 AS INTEGER), k || '.0', '#text', NULL, text FROM t WHERE text <> ''""")
def html_node_rows(spark, d):
    """Every node of the sections' HTML with its place in the tree."""
    n = R.html_nodes(spark, d)
    return n.select("book_id", "unit_index", "node_index", F.array_join("node_path", ".").alias("place"), "type", F.col("attrs")["id"].alias("element_id"), "text")


@query()
def layout_lines(spark, d):
    """Every unit laid out as lines on pages of one size."""
    return layout.lines(R.blocks(spark, d))


@query()
def lines_in_view(spark, d):
    return layout.visible(layout_lines(spark, d), 300.0, 676.0).select("book_id", "unit_index", "line_index", "block_index")


@query()
def unit_page_fractions(spark, d):
    return layout.page_fractions(layout_lines(spark, d), 676.0)


# ---------------------------------------------------------------- export

_BODY = "t AS (SELECT book_id, unit_index, string_agg(text, chr(10) ORDER BY block_index, block_uid) AS body FROM blocks WHERE text IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {BLOCKS_SQL}, {_BODY} SELECT s.book_id, s.section_index, repeat('-', 60) || chr(10) || coalesce(toc_label, title, section_id) || chr(10) || coalesce(body, '') AS exported FROM sections s LEFT JOIN t ON s.book_id = t.book_id AND section_index = unit_index WHERE linear IS NULL OR linear <> 'no'""")
def export_txt_sections(spark, d):
    from ..sinks.text import section_texts

    return section_texts(R.table(spark, d, "sections"), R.blocks(spark, d))


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT book_id, unit_index, sum(len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{R._SP}', '', 'g')) > 0))) AS n FROM blocks WHERE text IS NOT NULL GROUP BY ALL),
l AS (SELECT s.book_id, s.section_index, row_number() OVER (PARTITION BY s.book_id ORDER BY section_index) - 1 AS place, coalesce(toc_label, s.title, section_id) AS label, coalesce(n, 0) AS n FROM sections s JOIN books USING (book_id) LEFT JOIN b ON s.book_id = b.book_id AND section_index = unit_index WHERE linear IS NULL OR linear <> 'no')
SELECT book_id, CAST(place AS INTEGER) AS place, trim(regexp_replace(label, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS label, CAST(n AS BIGINT) AS paragraphs FROM l""")
def epub_round_trip(spark, d):
    """Every book written as a package and read again: contents labels and paragraphs of each section as they come back."""
    from ..sinks.files import export_rows
    from ..sinks.text import section_bodies
    from ..sources import books as source

    s = R.table(spark, d, "sections")
    rows = s.select("book_id", "section_index", "linear", F.coalesce("toc_label", "title", "section_id").alias("label")).join(section_bodies(R.blocks(spark, d)), ["book_id", "section_index"], "left")
    files = export_rows(R.table(spark, d, "books"), rows).select("file_name", "content").withColumnRenamed("file_name", "path")
    back = source.parsed(files).select(F.regexp_extract("path", r"(\d+)\.epub$", 1).cast("long").alias("book_id"), F.posexplode(F.arrays_zip("sections", "toc")).alias("place", "x"))
    return back.select("book_id", "place", F.col("x.toc.label").alias("label"), F.regexp_count("x.sections.content", F.lit("<p>")).cast("long").alias("paragraphs"))


_JOIN = "CASE WHEN regexp_matches(f.text, '[A-Za-z0-9]$') AND regexp_matches(o.text, '^[A-Za-z0-9]') THEN f.text || ' ' || o.text ELSE f.text || o.text END"
_CAN = f"(o.block_index = f.block_index AND o.speaker IS NOT DISTINCT FROM f.speaker AND o.start_offset - f.end_offset BETWEEN 0 AND 8 AND length({_JOIN}) <= 200)"


@query(f"""WITH RECURSIVE {VALID_SQL}, o AS (SELECT v.segment_uid, book_id, unit_index, block_index, start_offset, end_offset, speaker, substring(b.text, start_offset + 1, end_offset - start_offset) AS text, row_number() OVER (PARTITION BY book_id, unit_index ORDER BY block_index, start_offset, end_offset, v.segment_uid) AS k
  FROM valid v JOIN (SELECT book_id, unit_index, block_index, max(text) AS text FROM blocks GROUP BY ALL) b USING (book_id, unit_index, block_index)),
f AS (SELECT book_id, unit_index, k, segment_uid AS head, block_index, speaker, end_offset, text, CAST(1 AS BIGINT) AS n FROM o WHERE k = 1
 UNION ALL SELECT o.book_id, o.unit_index, o.k, CASE WHEN {_CAN} THEN f.head ELSE o.segment_uid END, o.block_index, o.speaker, o.end_offset, CASE WHEN {_CAN} THEN {_JOIN} ELSE o.text END, CASE WHEN {_CAN} THEN f.n + 1 ELSE 1 END
 FROM f JOIN o ON o.book_id = f.book_id AND o.unit_index = f.unit_index AND o.k = f.k + 1)
SELECT head AS segment_uid, CAST(arg_max(end_offset, k) AS INTEGER) AS end_offset, arg_max(text, k) AS text, CAST(max(n) AS INTEGER) AS n_merged FROM f GROUP BY head""")
def merged_narration(spark, d):
    """Neighbouring segments of one speaker put together up to a length."""
    from ..operators import narration, ranges

    texts = R.raw(spark, d).filter("text is not null").groupBy(*ranges.BLOCK).agg(F.max("text").alias("whole"))
    part = F.substring("whole", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    rows = R.valid_segments(spark, d).join(texts, ranges.BLOCK).withColumn("text", part)
    return narration.merged_segments(rows, ["speaker"], 200).select("segment_uid", "end_offset", "text", "n_merged")
