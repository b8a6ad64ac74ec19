"""Trial limits, content, records, scalar functions, inline segments and layout, on small hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import inline as I
from folioscope.functions import text as T
from folioscope.operators import content, edits, layout, nodes, records, reports, search, trial


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_units_per_page():
    assert trial.units_per_page() == pytest.approx(412.67, abs=0.01)
    assert trial.units_per_page(font_size=1, width=10, height=10) == trial.units_per_page(font_size=8, width=120, height=160)


def test_trial_state_and_turning(spark):
    pages = spark.createDataFrame([(1, 20), (2, 3), (3, 0)], "book_id long, pages long")
    got = {r.book_id: (r.limit_fraction, r.page_step) for r in trial.limit_state(pages, 5).collect()}
    assert got == {1: (0.25, 0.05), 2: (1.0, 0.2), 3: (1.0, 0.2)}
    assert {r.limit_fraction for r in trial.limit_state(pages, 0).collect()} == {1.0}


def test_marks_after_a_log(spark):
    log = [(1, "upsert", "a", "note", "x"), (2, "upsert", "b", "note", "y"), (3, "upsert", "c", "bookmark", "z"), (4, "delete", "b", None, None), (5, "delete_kind", None, "bookmark", None), (6, "upsert", "a", "note", "x2"), (7, "upsert", "d", "bookmark", "w")]
    df = spark.createDataFrame(log, "seq int, op string, mark_id string, kind string, value string")
    assert {(r.mark_id, r.value) for r in content.mark_store(df).collect()} == {("a", "x2"), ("d", "w")}
    assert content.mark_store(df.limit(0)).count() == 0


def test_edits_after_a_log(spark):
    log = [(1, "set", 1, 0, "a", "x"), (2, "set", 1, 0, "b", "y"), (3, "clear", 1, 0, "a", None), (4, "set", 1, 1, "a", "z"), (5, "clear", 1, 1, None, None), (6, "set", 1, 1, "c", "w"), (7, "set", 2, 0, "a", "q"), (8, "clear", 2, None, None, None)]
    df = spark.createDataFrame(log, "version int, op string, book_id int, unit_index int, block_id string, new_text string")
    assert {(r.book_id, r.unit_index, r.block_id, r.new_text) for r in edits.current(df).collect()} == {(1, 0, "b", "y"), (1, 1, "c", "w")}


def test_references_and_rectangles(spark):
    assert one(spark, F.array(*[content.page_href(F.lit(h), f) for h, f in (("page:3", None), ("pdf:page:12", None), ("page:3", "pdf"), ("pdf:page:4", "pdf"), ("page:x", None))])) == [3, 12, None, 4, None]
    marks = spark.createDataFrame([("m", [("pdf", 1, [(0.0, 1.0, 2.0, 3.0)]), ("cbz", 1, [(9.0, 9.0, 9.0, 9.0)]), ("pdf", 2, [(1.0, 1.0, 1.0, 1.0)])])], "mark_id string, locations array<struct<format:string,page:int,rects array<struct<x:double,y:double,w:double,h:double>>>>".replace("rects array", "rects: array"))
    assert [tuple(r) for r in content.page_rects(marks, [1], "pdf").collect()] == [("m", 1, 0.0, 1.0, 2.0, 3.0)]
    assert content.prefetch(spark.createDataFrame([(1, 2.7), (1, -3.0), (2, -1.0), (3, None)], "g int, n double"), "g", "n").orderBy("g").select("pages").toPandas().pages.tolist() == [2, 0, 0]


def test_scalar_functions(spark):
    assert one(spark, T.unescape_all(F.lit("&amp;lt;&#65;&#x1F600;&#x110000;&#xD800;&nbsp;&bogus;"))) == "<A😀&#x110000;&#xD800; &bogus;"
    assert one(spark, T.css_escape(F.lit("a.b:c"))) == r"a\.b\:c" and one(spark, T.regex_escape(F.lit("a+b(c)"))) == r"a\+b\(c\)"
    assert one(spark, F.array(*[T.mime_of(F.lit(p)) for p in ("a/b.JPEG?x#y", "c.svg", "d.txt")])) == ["image/jpeg", "image/svg+xml", "application/octet-stream"]
    assert one(spark, F.array(T.extension_for(F.lit("image/png"), F.lit("x")), T.extension_for(F.lit("x/y"), F.lit("a.webp")), T.extension_for(F.lit("x/y"), F.lit("a")))) == [".png", ".webp", ".bin"]
    assert one(spark, F.array(*[T.is_external(F.lit(u)) for u in ("http://x", "//x", "mailto:a", "blob:x", "a/b.html", "#x")])) == [True, True, True, False, False, False]
    assert one(spark, T.data_bytes(T.data_uri(F.lit("image/png"), F.lit("\x00hi").cast("binary")))) == b"\x00hi" and one(spark, T.data_bytes(F.lit("data:,x"))) is None
    assert one(spark, T.clamp01(F.lit(float("nan")))) == 0.0 and one(spark, T.clamp01(F.lit(3))) == 1.0 and one(spark, T.byte_length(F.lit("é"))) == 2
    at = F.lit(datetime.datetime(2030, 1, 1, tzinfo=datetime.timezone.utc))
    assert one(spark, T.identifier(F.lit("A  Winter!"), at)) == "urn:book:a-winter:1893456000000"
    m = F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 10.0, 0.0)))
    assert one(spark, T.affine(m, F.array(*map(F.lit, (2.0, 0.0, 0.0, 2.0, 1.0, 1.0))))) == [0.0, 2.0, -2.0, 0.0, 9.0, 1.0]
    assert tuple(one(spark, T.bounds(m, F.lit(4.0), F.lit(2.0)))) == (8.0, 0.0, 10.0, 4.0)
    v = one(spark, T.viewport(F.lit(100.0), F.lit(200.0), F.lit(90), 2.0, 1.5))
    assert (v.css_width, v.css_height, v.pixel_width, v.transform) == (400.0, 200.0, 600, [0.0, 2.0, -2.0, 0.0, 400.0, 0.0]) and one(spark, T.viewport(F.lit(1.0), F.lit(1.0), F.lit(45))) is None
    assert one(spark, T.fitted(F.lit(100.0), F.lit(200.0), 50, 50)) == 0.25 and one(spark, T.fitted(F.lit(100.0), F.lit(200.0), 50, 50, "width")) == 0.5
    assert [one(spark, T.spread_of(F.lit(i))) for i in range(4)] == [0, 1, 1, 2]


def test_narration_functions(spark):
    assert one(spark, F.array(*[T.speakable(F.lit(s)) for s in ("“…!” —", "a.", "")])) == [False, True, False]
    assert one(spark, T.without_references(F.lit("Tide [12] rose²³ high［3］."))) == "Tide rose high."
    assert tuple(one(spark, T.trimmed_edges(F.lit(" “, go on” "), True))) == (4, 9) and tuple(one(spark, T.trimmed_edges(F.lit("  "), False))) == (2, 2)


def test_records(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", None)], "id int, name string, c double")
    b = spark.createDataFrame([(2, None, 0.9), (3, "z", None)], "id int, name string, c double")
    assert {tuple(r) for r in records.merged(a, b, ["id"], ["name", "c"]).collect()} == {(1, "x", 0.5), (2, "y", 0.9), (3, "z", None)}
    assert {tuple(r) for r in records.merged(a, b, ["id"], ["c"], ["name"]).collect()} == {(1, 0.5, "x"), (2, 0.9, None), (3, None, "z")}
    payloads = spark.createDataFrame([(1, '[{"blockId": " a ", "text": "x"}, {"blockId": "", "text": "y"},]'), (2, "{rewrites: [{'blockId': 'b', 'text': 'z'}]}"), (3, "no json"), (4, None)], "request_id int, payload string")
    assert {tuple(r) for r in records.rewrites(payloads).collect()} == {(1, "a", "x"), (2, "b", "z")}
    tasks = spark.createDataFrame([(1, 1, 1, True), (1, 2, 1, False), (1, 2, 2, True), (2, 1, 1, True), (2, 2, 1, False), (2, 2, 2, False), (3, 1, 1, False), (4, 1, 1, False), (4, 1, 2, False)], "job_id int, task_id int, try int, ok boolean")
    assert {r.job_id: r.state for r in records.work_state(tasks).collect()} == {1: "done", 2: "partial", 3: "running", 4: "failed"}
    chunks = spark.createDataFrame([("c1", 1, "done", "b"), ("c1", 0, "done", "a"), ("c2", 0, "open", "x")], "chapter string, chunk_index int, status string, text string")
    first = records.finished(chunks)
    assert [(r.chapter, r.texts) for r in first.collect()] == [("c1", ["a", "b"])] and records.finished(chunks, first).count() == 0
    payload = spark.createDataFrame([("c", '[{"id": "p1", "text": "eins"}]'), ("d", "eins\na | b")], "chapter string, payload string")
    blocks = spark.createDataFrame([("c", "p1", 0, "paragraph"), ("d", "q1", 0, "paragraph"), ("d", "q2", 1, "table")], "chapter string, block_id string, position int, kind string")
    assert {(r.block_id, r.text, tuple(r.cells or ())) for r in records.chunk_texts(payload, blocks).collect()} == {("p1", "eins", ()), ("q1", "eins", ()), ("q2", "a | b", ("a", "b"))}
    catalog = spark.createDataFrame([("v1", "en-GB", "Male", 1), ("v2", "en-GB", "Female", 2), ("v2", "de-DE", "Female", 3), ("v3", "de-DE", None, 4), ("v4", "xx", "Female", 5)], "voice_id string, locale string, gender string, ordinal int")
    assert [r.voice_id for r in records.voices(catalog, ["en-GB"], ["de-DE"], 2).orderBy("place").collect()] == ["v2", "v1"]
    ext = spark.createDataFrame([("e", ["c1"], ["t1", "t2"])], "extension_id string, commands array<string>, tools array<string>")
    assert {(r.kind, r.position, r.item) for r in records.contributions(ext, ["commands", "tools"]).collect()} == {("commands", 0, "c1"), ("tools", 0, "t1"), ("tools", 1, "t2")}
    assert records.applied(ext, [lambda d: d.withColumn("n", F.lit(1)), lambda d: d.withColumn("n", F.col("n") + 1)]).first().n == 2
    entries = spark.createDataFrame([("a", "store", ["x", "y"], ["r"], True, None, "Big Map"), ("b", "store", ["x"], None, False, True, "map")], "id string, source string, categories array<string>, capabilities array<string>, installed boolean, enabled boolean, name string")
    assert [r.id for r in records.catalog(entries, "store", ["x"], [], None, None, " MAP ", ["name", "id"]).orderBy("id").collect()] == ["a", "b"]
    assert [r.id for r in records.catalog(entries, categories=["x", "y"], capabilities=["r"], installed=True).collect()] == ["a"] and records.catalog(entries, enabled=False).first().id == "a"


def test_tables_of_translation(spark):
    t = spark.createDataFrame([(1, [["Name", "1"], ["12", "a"]])], "block_uid int, rows array<array<string>>")
    assert [tuple(r) for r in edits.cells(t).collect()] == [(1, 0, 0, "Name")]


def test_citations_and_ranges(spark):
    rows = [(1, 1, 0, 0, "p", "The lamp. The lamp again."), (1, 1, 0, 0, "p", "The lamp. The lamp again."), (2, 1, 1, 0, "q r", "A lamp"), (3, 1, 2, 0, None, "no light"), (4, 1, 2, 1, None, None)]
    blocks = spark.createDataFrame(rows, "block_uid int, book_id int, unit_index int, block_index int, block_id string, text string")
    units = spark.createDataFrame([(1, 0, "One"), (1, 1, None)], "book_id int, unit_index int, title string")
    got = search.search_citations(blocks, units, " lamp ", 2).orderBy("start_offset").collect()
    assert [(r.start_offset, r.match_index, r.label) for r in got] == [(4, 0, "One · p"), (14, 1, "One · p")]
    assert search.search_citations(blocks, units, "  ").count() == 0 and search.search_book(blocks, "").count() == 0
    assert [r.label for r in search.search_citations(blocks, units, "A lamp").collect()] == ["q r"]
    assert [r.block_uid for r in search.provider_search(blocks, "lamp", (0, 1), (1, 5)).collect()] == [2]


def test_segments(spark):
    html = '<p>One <b>bold</b><b> more</b><a href="#fn1">[1]</a> <i style="color: red">x</i><br/>two</p><p>three <img src="a"/></p><aside epub:type="footnote">note</aside>'
    got = I.document_segments(html)
    assert [(s["block"], s["text"]) for s in got] == [(0, "One "), (0, "bold more"), (0, "[1]"), (0, " "), (0, "x"), (1, "two"), (2, "three "), (2, I.OBJECT)]
    assert got[1]["style"] == {"weight": "700"} and got[2]["role"] == "noteref" and got[4]["style"] == {"style": "italic", "color": "red"}
    assert I.document_segments(None) == [] and I.normalized([{"text": "\n", "style": {}, "source": "br", "role": ""}]) == []
    df = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    assert nodes.html_segments(df, ["id"], "html").count() == 8


def test_tables_and_weights(spark):
    html = '<table><tr><th>Name</th><th colspan="2">A heading over two columns that is as long as this one is</th></tr><tr><td style="width: 25%">a</td><td>b</td><td>c</td></tr></table><table><colgroup><col width="25%"/><col width="75%"/></colgroup><tr><td>x</td><td>y</td></tr></table>'
    a, b = I.tables(html)
    assert a["column_count"] == 3 and len(a["weights"]) == 3 and a["rows"][0][0]["header"] and a["weights"][1] > a["weights"][0] >= I.LEAST
    assert b["weights"] == [25.0, 75.0] and I.tables("<p>x</p>") == []
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert [r.column_count for r in nodes.html_tables(df, ["id"], "html").orderBy("table_index").collect()] == [3, 2]
    assert I.image_box(200, 100, None, 100, 20) == (100, 50) and I.image_box(None, None, "width: 50%", 100, 10) == (50, 37.5) and I.image_box(10, 1000, None, 100, 10, 300) == (10, 300)


def test_layout(spark):
    assert layout.broken("aaaa bbbb", 3.0, 1.0) == ["aaaa", "bbbb"] and layout.broken("潮水上涨之前", 3.0, 1.0) == ["潮水上", "涨之前"] and layout.broken("", 5, 1) == [""]
    assert layout.broken("x" * 10, 2.7, 1.0) == ["xxxxx", "xxxxx"]
    assert layout.kept(90, 20, 100) == 100 and layout.kept(80, 20, 100) == 80 and layout.kept(50, 120, 100, 10, True) == 100 and layout.kept(5, 1, None) == 5
    assert layout.preset("heading", 10, 1.7, 3) == (10 * (1.42 - 0.24), 1.45, 9.0, 6.0) and layout.preset(None, 10, 1.7) == (10, 1.7, 0.0, 7.5)
    rows = [(1, 1, 0, 0, "heading", "A Title"), (2, 1, 0, 1, "paragraph", "word " * 60), (3, 1, 0, 2, "image", None), (4, 1, 0, 3, "paragraph", "  "), (5, 1, 0, 4, "separator", None), (6, 1, 1, 0, "paragraph", "end")]
    df = spark.createDataFrame(rows, "block_uid int, book_id long, unit_index int, block_index int, block_type string, text string")
    got = layout.lines(df, 200.0, 10.0, 1.5, 100.0)
    own = got.filter("unit_index = 0").orderBy("line_index").collect()
    assert [r.line_index for r in own] == list(range(len(own))) and {r.kind for r in own} == {"text", "image", "separator"} and all(r.width <= 200 for r in own)
    assert all(a.top + a.height <= b.top + 1e-9 for a, b in zip(own, own[1:])) and all(r.top % 100 + r.height <= 100 + 1e-9 for r in own)
    seen = layout.visible(got, 0.0, 50.0).filter("unit_index = 0").collect()
    assert 0 < len(seen) < len(own) and {r.page_index for r in layout.page_fractions(got, 100.0).collect()} >= {0, 1}
    assert layout.lines(df.limit(0)).count() == 0


def test_reports_on_small_rows(spark):
    segs = spark.createDataFrame([(1, 1, 0, 0, 0, 3, "a"), (2, 1, 0, 0, 5, 9, "a"), (3, 1, 0, 9, 0, 2, "a"), (4, 1, 0, 0, 9, 30, "b")], "segment_uid int, book_id int, unit_index int, block_index int, s int, e int, speaker string")
    blocks = spark.createDataFrame([(1, 0, 0, "x" * 20)], "book_id int, unit_index int, block_index int, text string")
    r = reports.prepared(segs, blocks).first()
    assert (r.segments, r.unknown_blocks, r.tiny, r.adjacent, r.adjacent_same) == (4, 1, 2, 2, 1)
    assert one(spark, F.array(*[reports.classified(F.lit(u), [("voices", "/voices$"), ("speech", "/speech")]) for u in ("/v1/speech/voices", "/v1/speech", "/x")])) == ["voices", "speech", "other"]


def test_narration_texts_and_offsets():
    from folioscope.operators import narration as N

    text = "  The\n tide [12]  rose² high. "
    out, at = N.collapsed(text)
    assert out == "The tide [12] rose² high." and [text[i] for i in at if not text[i].isspace()] == [c for c in out if c != " "]
    plain, at = N.readable(text)
    assert plain == "The tide rose high." and text[slice(*N.source_range(at, 9, 13))] == "rose" and N.source_range([], 0, 5) == (0, 0)
    assert N.is_mixed("“Go!” he said.") and not N.is_mixed("“Go!”") and not N.is_mixed("He went.") and not N.is_mixed("“…” —")
    assert [N.selection("One two. Three, four.", k, u) for k, u in ((4, "word"), (9, "sentence"), (0, "paragraph"), (3, "word"), (99, "sentence"))] == [(4, 7), (9, 21), (0, 21), (3, 3), (9, 21)]
    assert N.selection("", 0, "word") == (0, 0) and N.selection("潮水", 1, "word") == (1, 2)
    assert N.joined("a", "b") == "a b" and N.joined("a ", "b") == "a b" and N.joined("潮", "b") == "潮b" and N.joined("", "b") == "b"


def test_texts_and_titles(spark):
    doc = "<?xml version='1.0'?><html><head><title> A &amp; B </title></head><body class='x'><h1>Head</h1><p>t</p></body></html>"
    assert one(spark, T.body_of(F.lit(doc))) == "<h1>Head</h1><p>t</p>" and one(spark, T.body_of(F.lit("<html><head>x</head><p>t</p>"))) == "<p>t</p>"
    title = lambda label, html, own: one(spark, T.section_title(F.lit(label).cast("string"), F.lit(html).cast("string"), F.lit(own).cast("string"), F.lit(4)))
    assert [title(None, doc, "i"), title("", doc, "i"), title(None, "<h2>H</h2>", "i"), title(None, "<p>x</p>", "i"), title(None, None, None)] == ["A & B", "", "H", "i", "Section 5"]
    texts = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    unit = lambda b, s, h, k=None: one(spark, T.unit_text(b, s, F.lit(h).cast("string"), F.lit(k).cast("string")))
    assert [unit(texts("a", "", "b"), texts("x"), None), unit(texts(), texts("x", "y"), None), unit(texts(), texts(), "<p>z</p>"), unit(texts("a"), texts(), None, "image"), unit(texts(), texts(), None)] == ["a\nb", "xy", "z", "", ""]
    seg = F.array(F.struct(F.lit("a").alias("text"), F.lit("text").alias("source")), F.struct(F.lit("*").alias("text"), F.lit("img").alias("source")))
    cells = F.array(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("3")))
    assert [one(spark, T.block_text(F.lit(k), seg, F.lit(""), F.lit("t"), cells)) for k in ("image", "table", "paragraph")] == ["t", "1 2 3", "a"]
    m = F.create_map(F.lit("en"), F.lit("E"), F.lit("de"), F.lit("D"))
    assert one(spark, F.array(T.of_language(m), T.of_language(m, "de"), T.of_language(m, "xx"), T.language_tag(F.lit(" ")), T.export_title(F.lit("T"), F.lit("S")), T.export_title(F.lit(""), F.lit(None).cast("string")))) == ["E", "D", "E", "und", "T: S", "Untitled"]
    people = F.array(F.struct(F.lit(" A ").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.lit("B").alias("name")))
    assert one(spark, T.contributor_names(people)) == "A, B" and one(spark, T.subject_list(F.array(F.lit("x"), F.lit(" ")))) == ["x"]


def test_marks_in_ranges(spark):
    from folioscope.operators import ranges

    marks = [("over", 1, 0, 2, "a", "b", 1, 2), ("same", 1, 1, 1, "p", "p", 5, 9), ("point", 1, 1, 1, "p", "p", 9, 9), ("loose", 1, 1, 1, "p", "p", None, None), ("two", 1, 1, 1, "p", "q", 50, 3), ("other", 2, 1, 1, "p", "p", 5, 9)]
    rng = [("r0", 1, 0, "z", 0, 1, True), ("r1", 1, 1, "p", 9, 12, True), ("r2", 1, 1, "p", 0, 6, True), ("r3", 1, 1, "p", 100, 101, False), ("r4", 1, 1, "q", 0, 10, True), ("r5", 1, 1, "p", 7, 7, True)]
    m = spark.createDataFrame(marks, "mark_id string, book_id int, start_unit int, end_unit int, start_block string, end_block string, start_offset int, end_offset int")
    r = spark.createDataFrame(rng, "range_id string, book_id int, unit_index int, block_id string, start_offset int, end_offset int, reliable boolean")
    got = {}
    for x in ranges.marks_in_ranges(m, r).collect():
        got.setdefault(x.mark_id, set()).add(x.range_id)
    assert got == {"over": {"r0", "r1", "r2", "r3", "r4", "r5"}, "same": {"r2", "r3", "r5"}, "point": {"r1", "r3", "r5"}, "loose": {"r1", "r2", "r3", "r5"}, "two": {"r3", "r4", "r5"}}
