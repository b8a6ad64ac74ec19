"""SQL for the text queries that SQL can express over whole tables."""

from __future__ import annotations

#: Offsets count UTF-16 units. Segments of blocks without characters beyond the basic plane are cut by code points;
#: in the others a character counts two units, found by walking the text's characters.
P4_FOUND = """
WITH blocks AS (SELECT book_id, unit_index, block_index, max(text) AS text FROM unit_texts WHERE text IS NOT NULL GROUP BY ALL),
lim AS (SELECT max(max_chars) FILTER (src = 'unit_texts') AS u, max(max_chars) FILTER (src = 'tts_segments') AS t FROM size_limits),
seg AS (
  SELECT DISTINCT segment_uid, s, e, string_split(text, '') AS ch
  FROM tts_segments JOIN blocks ON tts_segments.book_id = blocks.book_id AND tts_segments.unit_index = blocks.unit_index AND b = block_index
),
chars AS (
  SELECT segment_uid, s, e, i, CASE WHEN unicode(ch[i]) > 65535 THEN 2 ELSE 1 END AS w
  FROM seg, unnest(range(1, len(ch) + 1)) AS r(i)
),
placed AS (SELECT segment_uid, s, e, i, w, sum(w) OVER (PARTITION BY segment_uid, s, e ORDER BY i) - w AS pos FROM chars)
SELECT DISTINCT 'unit_texts' AS src, block_uid AS row_id FROM unit_texts, lim WHERE length(text) > u
UNION ALL
SELECT 'tts_segments', segment_uid FROM placed, lim
WHERE pos >= greatest(coalesce(s, 0), 0) AND pos + w <= coalesce(e, 2147483647)
GROUP BY segment_uid, t HAVING count(DISTINCT i) > t
"""


P4_CHECKS = P4_FOUND.replace("SELECT DISTINCT 'unit_texts' AS src, block_uid AS row_id FROM", "SELECT DISTINCT 'unit_texts' AS src, block_uid AS row_id, length(text) AS size, true AS fine FROM").replace(
    "SELECT 'tts_segments', segment_uid FROM", "SELECT 'tts_segments', segment_uid, count(DISTINCT i), true FROM"
)

_BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
P5_COVER = f"""
WITH t AS (
  SELECT DISTINCT 'unit_texts' AS src, block_uid AS row_id, text FROM unit_texts WHERE block_type IS NULL OR block_type IN ('paragraph', 'blockquote', 'listItem', 'heading')
  UNION ALL SELECT DISTINCT 'search_results', result_id, excerpt FROM search_results
)
SELECT src, row_id, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS solid FROM t WHERE length(regexp_replace(text, '{_BLANK}', '', 'g')) > 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": P4_FOUND, "p4_checks": P4_CHECKS, "p5_cover": P5_COVER,
        "p7_bytes": "SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents",
        "p8_checks": "SELECT bin_kind, (SELECT count(*) FROM documents) AS documents, 0 AS over, 0 AS broken FROM bin_specs",
        "p9_rebuilt": "SELECT doc_id, true AS same FROM documents",
    }
