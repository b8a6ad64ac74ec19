"""Operators against brute force on small rows."""

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import folds, progress, ranges, search, toc

BLOCKS = "book_id long, unit_index int, block_index int, text string"


def brute(text: str, query: str, whole: bool) -> list[int]:
    low, q, at, out = text.lower(), query.lower(), 0, []
    while (i := low.find(q, at)) >= 0:
        at = i + len(q)
        edge = lambda c: c.isalnum() or c == "_"
        if not whole or not (i and edge(text[i - 1]) or at < len(text) and edge(text[at])):
            out.append(i)
    return out


def test_hits_equal_a_scan(spark):
    texts = ["aaxaaax", "", None, "The other: the, THE_ the", "a.b*c a.b*c", "x" * 5000 + "the" + "y" * 5000, "ééthe the"]
    df = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(texts)], BLOCKS)
    for q, whole in (("aa", False), ("the", True), ("the", False), ("a.b*c", False), ("\\E", False)):
        got = sorted((r.block_index, r.start_offset) for r in search.hits(df, q, whole_word=whole).collect())
        assert got == sorted((i, a) for i, t in enumerate(texts) if t for a in brute(t, q, whole))
    assert search.hits(df, "").count() == 0


def test_excerpt_is_dotted_only_where_cut(spark):
    df = spark.createDataFrame([(1, 0, 0, "b" * 60 + "key" + "c" * 10)], BLOCKS)
    r = search.search_book(df, "key").collect()[0]
    assert r.excerpt == "..." + "b" * 48 + "key" + "c" * 10 and r.match_text == "key"


def test_progress_of_empty_and_sideline_sections(spark):
    df = spark.createDataFrame([(1, 0, 100, None), (1, 1, 50, "no"), (1, 2, 0, None), (1, 3, 300, "yes"), (2, 0, 0, None), (2, 1, None, None)], "book_id long, section_index int, size_bytes long, linear string")
    f = {(r.book_id, r.section_index): (r.start_fraction, r.end_fraction) for r in progress.section_fractions(df).collect()}
    assert f[1, 3] == (0.25, 1.0) and f[1, 1] == (0.25, 0.25) and f[2, 1] == (0.0, 0.0)
    at = {r.book_id: r.section_index for r in progress.section_at(df, 0.5).collect()}
    assert at == {1: 3, 2: None}


def test_toc_resolution_order(spark):
    secs = spark.createDataFrame([(1, 0, "text/a.xhtml"), (1, 1, "b.xhtml"), (1, 2, "other/a.xhtml")], "book_id long, section_index int, section_id string")
    refs = spark.createDataFrame([(1, 0, "b.xhtml"), (1, 1, "./text/../text/a.xhtml#x"), (1, 2, "a.xhtml"), (1, 3, "none")], "book_id long, toc_index int, href string")
    assert {r.toc_index: r.resolved_index for r in toc.resolve(refs, secs).collect()} == {0: 1, 1: 0, 2: 0, 3: None}


def test_touching_ranges_do_not_overlap(spark):
    m = spark.createDataFrame([(1, 0, 0, 5, 10), (1, 0, 0, 7, 7)], "book_id long, unit_index int, block_index int, m_start int, m_end int")
    r = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 0, 0, 7, 9)], "book_id long, unit_index int, block_index int, r_start int, r_end int")
    assert sorted((x.m_start, x.r_start) for x in ranges.overlaps(m, r).collect()) == [(5, 7), (7, 7)]


def test_entities_decode_in_order(spark):
    r = spark.createDataFrame([("<p>a &amp;lt; b</p><style>p{}</style>c&copy;",)], "h string").select(T.readable_text(F.col("h")).alias("r"), T.export_text(F.col("h")).alias("e"), T.strip_markup(F.col("h")).alias("s")).first()
    assert r.r == "a < b c&copy;" and r.e == "a < b\nc" and r.s == "a &amp;lt; b c&copy;"


def test_folds():
    assert folds.split_text("One. Two! Three?", 9) == ["One. Two!", "Three?"]
    assert folds.split_text("", 5) == [] and folds.split_text(None, 5) == []
    assert folds.wrapped_lines("aaaa bbbb", 3.0) == 2


def test_packing_of_blocks(spark):
    df = spark.createDataFrame([(1, 0, i, "x" * n) for i, n in enumerate((5, 6, 30, 4, 6))], BLOCKS)
    assert [r.batch_index for r in folds.batches_of(df, 10).orderBy("block_index").collect()] == [0, 1, 2, 3, 3]


def test_styles():
    from folioscope.functions import css

    s = css.Sheet("p.a{color:red} .b.a{margin:1em;color:blue !important} /* x */ @import url('q.css'); h1{x:y}")
    assert s.style("p", "a b") == {"color": "blue", "margin": "1em"} and s.style("div", "a") == {}
    assert css.imports('@import "a.css"; @import url(b.css);') == ["a.css", "b.css"] and css.length("2em", 10) == 20 and css.length("auto") is None
    assert css.declarations("a:url(x;y);B : c;;") == {"a": "url(x;y)", "b": "c"}


def test_atoms_and_places():
    from folioscope.operators import narration

    t = "He said “No. Never.” Then left. Done"
    assert [(t[a:b].strip(), q) for a, b, q in narration.atoms(t)] == [("He said", False), ("“No. Never.”", True), ("Then left.", False), ("Done", False)]
    assert narration.fnv1a("a") == 0xE40C292C and -1 <= narration.pan("x") <= 1


def test_kept_contents(spark):
    from folioscope.operators import lookup

    rows = spark.createDataFrame([(1, 0, "a", "A", []), (1, 1, "b", "B", [0]), (1, 2, "c", "C", [0, 1])], "book_id long, toc_index int, section_id string, label string, ancestors array<int>")
    kept = spark.createDataFrame([(1, "a"), (1, "c")], "book_id long, section_id string")
    assert {r.label: r.depth for r in lookup.kept_toc(rows, kept).collect()} == {"A": 0, "C": 1}


def test_every_labelled_page_is_an_entry(spark, tmp_path):
    from folioscope.plans import registry

    labels = ["i", None, "iii", "iv", "1", "2", None]
    rows = [(k, 1, k, x) for k, x in enumerate(labels)] + [(5, 1, 5, "2"), (9, 2, 1, None), (10, 2, 3, "4")]
    spark.createDataFrame(rows, "page_uid long, book_id long, page_index int, label string").write.parquet(str(tmp_path / "fixed_pages.parquet"))
    got = {r.page_uid: r.label for r in registry.queries()["toc_at_page"](spark, str(tmp_path)).collect()}
    assert got == {0: "i", 1: "i", 2: "iii", 3: "iv", 4: "1", 5: "2", 6: "2", 9: None, 10: "4"}
