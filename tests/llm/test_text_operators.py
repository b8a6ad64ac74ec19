"""Text operators on Spark: nulls, empty tables, repeated rows, clashing names."""

import unicodedata

from folioscope.llm import chunks, encoding, language, lookalike, ocr, packing, pii, sentences, tokens

DOCS = "doc_id long, text string, ids string, kind string"
ROWS = [(1, "hello world", "x", None), (2, "", None, "k"), (3, None, None, None), (1, "hello world", "x", None), (4, "word " * 30_000, None, None)]


def test_tokens(spark):
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(spark.createDataFrame(ROWS, DOCS)).collect()}
    assert got[1] == [31373, 995] and got[2] == [] and got[3] == [] and len(got[4]) > 30_000
    assert tokens.encode_corpus(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_keeps_everything_and_the_capacity(spark):
    specs = [("small", "byte_bpe_50k", 64), ("large", "piece_bpe_32k", 500)]
    rows = [(i, "word " * (i % 70) if i % 9 else None, None, None) for i in range(400)]
    got = packing.pack_corpus(spark.createDataFrame(rows, DOCS), specs)
    bins = got.collect()
    used, seen = {}, {}
    for r in bins:
        used[r.bin_kind, r.bin_id] = used.get((r.bin_kind, r.bin_id), 0) + r.n_tokens
        seen.setdefault((r.bin_kind, r.doc_id), []).append((r.piece, r.start_token, r.n_tokens))
    caps = {k: c for k, _, c in specs}
    assert all(n <= caps[k] for (k, _), n in used.items())
    assert len(seen) == 2 * len(rows)
    for parts in seen.values():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts))) and all(b[1] == a[1] + a[2] for a, b in zip(parts, parts[1:]))
    fill = {r.bin_kind: r.fill for r in packing.fill_report(got, specs).collect()}
    assert fill["large"] > 0.9
    assert packing.pack_corpus(spark.createDataFrame([], DOCS), specs).count() == 0


def test_packing_folds_windows_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    monkeypatch.setattr(packing, "OPEN", 2)
    rows = [(None if i % 50 == 0 else i, "word " * (i % 37) if i % 11 else "", None, None) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).repartition(20)
    monkeypatch.setattr(packing, "spread", lambda d: d)
    got = packing.pack_corpus(df, [("k", "byte_bpe_50k", 64)]).collect()
    used = {}
    for r in got:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.n_tokens
    assert len(got) == 900 and max(used.values()) <= 64 and sum(used.values()) / (64 * len(used)) > 0.85
    empty = packing.pack_corpus(spark.createDataFrame([(i, None, None, None) for i in range(300)], DOCS), [("k", "byte_bpe_50k", 64)]).collect()
    assert len(empty) == 300 and all(r.bin_id and r.n_tokens == 0 for r in empty)


def test_classes_of_what_looks_the_same(spark):
    texts = ["café", "cafe\u0301", "cafe\u0301", "other", "cаfé", "", None]
    df = spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(texts)], "row_id long, book_id long, text string, form string")
    got = {tuple(r) for r in lookalike.alike_report(df, "row_id", "book_id", "text").collect()}
    assert got == {(i, 1, 0, 3, 4) for i in (0, 1, 2, 4)}
    assert {tuple(r) for r in lookalike.alike_pairs(df, "row_id", "book_id", "text").collect()} == {(0, 1), (0, 2), (0, 4), (1, 4), (2, 4)}


def test_same_form_for_what_looks_the_same(spark):
    texts = ["café", "café", "cаfé", "ｃａｆé", "ca​fé", "CAFÉ", "cafe", " café ", "x y", "x y", "x\ny", None, "", "  ", "x³", "x3", "ﬁn", "fin", "​"]
    df = spark.createDataFrame([(i, 1 if i < 18 else 2, t) for i, t in enumerate(texts)], "row_id long, book_id long, text string")
    form = {r.row_id: r.canonical for r in lookalike.canonical(df, ["row_id"], "text").collect()}
    assert len(form) == len(texts) and len({form[i] for i in (0, 1, 2, 3, 4, 7)}) == 1 and form[5] == "CAFÉ" and form[6] == "cafe"
    assert form[8] == form[9] != form[10] and form[11] is None and form[12] == form[13] == form[18] == "" and form[14] != form[15] and form[16] == form[17]
    pairs = {tuple(r) for r in lookalike.alike_pairs(df, "row_id", "book_id", "text").collect()}
    same = [{0, 1, 2, 3, 4, 7}, {8, 9}, {16, 17}]
    assert pairs == {(a, b) for g in same for a in g for b in g if a < b}
    assert lookalike.alike_pairs(df.limit(0), "row_id", "book_id", "text").count() == 0


def test_forms_by_key_equal_broadcast_forms(spark, monkeypatch):
    texts = ["cafe\u0301 ｃ", "cа\u200bfé", None, "", "x\u00a0y \r\n z ", "ｶﾞ ガ", "각 \u1100\u1161\u11a8"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    once = {r.row_id: r.canonical for r in lookalike.canonical(df, ["row_id"], "text").collect()}
    monkeypatch.setattr(lookalike, "SMALL", 0)
    assert once == {r.row_id: r.canonical for r in lookalike.canonical(df, ["row_id"], "text").collect()}
    assert once == {0: "café c", 1: "café", 2: None, 3: "", 4: "x y\nz", 5: "ガ ガ", 6: "각 각"}


def test_form_equals_normalisation_of_random_marks(spark):
    import random

    rnd = random.Random(3)
    pool = "aeiouxnß̧̨̣́̈éấ각가कि़ั"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got = {r.row_id: r.canonical for r in lookalike.canonical(df, ["row_id"], "text").collect()}
    assert [got[i] for i in range(200)] == [unicodedata.normalize("NFC", t) for t in texts]


def test_pieces(spark):
    df = spark.createDataFrame([(1, "a. " * 100, "p"), (2, None, "p"), (3, "short", "p"), (1, "a. " * 100, "p")], "row_id long, text string, piece string")
    got = chunks.split_items(df, ["row_id"], "text", 100, 10).collect()
    assert {r.row_id for r in got} == {1} and all(len(r.piece_text) <= 100 for r in got)
    segs = spark.createDataFrame([(1, 1, 0, 0, 0, None), (2, 1, 0, 0, 2, 1), (3, 1, 0, 9, 0, 5), (4, 1, 0, 0, None, 4)], "segment_uid long, book_id long, unit_index int, b int, s int, e int")
    blocks = spark.createDataFrame([(1, 0, 0, "😀abc"), (1, 0, 0, "😀abc"), (1, 0, 1, None)], "book_id long, unit_index int, block_index int, text string")
    assert {r.segment_uid: r.text for r in chunks.narration_texts(segs, blocks).collect()} == {1: "😀abc", 2: "", 4: "😀ab"}


def test_units_and_findings(spark):
    df = spark.createDataFrame([(1, "One. Two.", "a"), (2, None, "b"), (3, "", "c")], "doc_id long, text string, src string")
    assert sorted((r.row_id, r.sent_start, r.sent_end) for r in sentences.sentence_units(df, "t", "doc_id", "text").collect()) == [(1, 0, 4), (1, 5, 9)]
    mail = spark.createDataFrame([(1, "to a.b@c.example", "x"), (2, None, "y")], "doc_id long, text string, pii_kind string")
    assert [tuple(r) for r in pii.findings(mail).collect()] == [(1, "email", 3, 16)]
    assert {r.doc_id: (r.masked_text, r.n_found) for r in pii.masked(mail).collect()} == {1: ("to [EMAIL]", 1), 2: (None, 0)}


def test_language_and_encoding_tables(spark):
    from test_text_kernels import LANGS

    langs = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", "German"), ("ru", "rus", "Russian")], "lang string, iso3 string, lang_name string")
    samples = spark.createDataFrame([(k, t) for k, ts in LANGS.items() for t in ts], "lang string, text string")
    docs = spark.createDataFrame([(1, "de", LANGS["en"][1], 0), (2, None, LANGS["ru"][0], 0), (3, "en", None, 0), (4, "en", "", 0), (5, "en", "123", 0)], "doc_id long, lang string, text string, n_segs int")
    model = language.training(spark, samples, langs, [docs.select("doc_id", "lang", "text")])
    names = language.label_names([tuple(r) for r in langs.collect()])
    got = {r.row_id: (r.lang, r.label_lang, r.n_segs) for r in language.language_segments(docs, "d", "doc_id", "lang", "text", model, names).collect()}
    assert got == {1: ("en", "de", 1), 2: ("ru", None, 1)}
    m = encoding.training(samples, docs.select("doc_id", "text"))
    runs = spark.createDataFrame([(1, "FÃ¤hrmann"), (2, "Fährmann"), (3, None), (4, "plain"), (5, "w�hrend"), (1, "FÃ¤hrmann")], "run_uid long, text string")
    got = {r.row_id: (r.restored, r.complete) for r in encoding.damaged(runs, "r", "run_uid", "text", m).collect()}
    assert got == {1: ("Fährmann", True), 5: ("w�hrend", False)}


def test_pages(spark):
    def run(uid, page, k, text, y, eol=True, size=10.0):
        return (uid, 1, page, k, text, [size, 0.0, 0.0, size, 60.0, y] if y else None, size, eol)

    body = ["the tide turned behind the pier and the whole", "town opened the almanac behind the old pier."]
    rows, uid = [], 0
    for p in range(40):
        lines = [("A Winter in Sel", 32.0), (body[0], 94.0), (body[1], 108.0), (f"— {p} —", 760.0)]
        for k, (t, y) in enumerate(lines):
            uid += 1
            rows.append(run(uid, p, k, t, y))
    rows += [run(900, 50, 0, "the tide turned bchind the alma-", 94.0), run(901, 50, 1, "nac and XIV", 108.0), run(902, 50, 2, None, None), run(900, 50, 0, "the tide turned bchind the alma-", 94.0)]
    df = spark.createDataFrame(rows, "run_uid long, book_id long, page_index int, run_index int, text string, transform_matrix array<double>, font_size double, has_eol boolean")
    sizes = spark.createDataFrame([(1, 792.0)], "book_id long, height double")
    got = {(r.run_uid, r.noise) for r in ocr.noise(df, sizes).collect()}
    assert (1, "running_head") in got and (4, "page_number") in got and {n for u, n in got if u == 900} == {"misread", "broken_word"} and not any(u in (901, 902, 2, 3) for u, _ in got)
    paras = [r.paragraph for r in ocr.book_paragraphs(df, sizes).orderBy("page_index", "para_index").collect()]
    assert len(paras) == 41 and paras[0] == " ".join(body) and "behind the almanac and XIV" in paras[-1]
    assert ocr.noise(df.limit(0), sizes).count() == 0


def test_a_page_is_judged_alike_in_a_corpus_of_any_size(spark):
    from pyspark.sql import functions as F

    body = ["the tide turned behind the pier and the whole", "town opened the almanac behind the old pier."]
    texts = [t for _ in range(40) for t in body] + ["the tide turned bchind the alm", "anac and the o1d pier, as told", "the tide turned bchind the alma-", "nac and XIV"]
    rows = [(uid, 1, uid // 2, uid % 2, t, [10.0, 0.0, 0.0, 10.0, 60.0, 94.0 + 14 * (uid % 2)], 10.0, True) for uid, t in enumerate(texts)]
    once = spark.createDataFrame(rows, "run_uid long, book_id long, page_index int, run_index int, text string, transform_matrix array<double>, font_size double, has_eol boolean")
    often = once.crossJoin(spark.range(100).withColumnRenamed("id", "copy")).withColumn("run_uid", F.col("run_uid") + 1000 * F.col("copy")).withColumn("book_id", 1 + F.col("copy")).drop("copy")
    sizes = spark.createDataFrame([(1, 792.0)], "book_id long, height double")
    assert ocr.lexicon(once) == ocr.lexicon(often)
    found = [{(r.run_uid % 1000, r.noise) for r in ocr.noise(df, sizes).collect()} for df in (once, often)]
    assert found[0] == found[1] == {(80, "misread"), (80, "broken_word"), (81, "misread"), (82, "misread"), (82, "broken_word")}


def test_lines_of_scripts_without_blanks_break_no_word():
    r = ocr.Reader(ocr.Lexicon.of({"readers": 60, "天花板下": 60, "reade": 1, "天花": 1}))
    assert r.join("reade", "rs") > 0 > r.join("天花", "板下")


def test_runs_without_a_page_and_long_paragraphs(spark):
    schema = "run_uid long, book_id long, page_index int, run_index int, text string, transform_matrix array<double>, font_size double, has_eol boolean"
    place = lambda k: [10.0, 0.0, 0.0, 10.0, 60.0, 60.0 + 6.0 * k]
    rows = [(k, 1, 0, k, f"and the long line {'x' * 20} goes on", place(k), 10.0, True) for k in range(90)]
    rows += [(900, None, 3, 0, "No book here.", None, 10.0, True), (901, None, 3, 0, "No book either.", None, 10.0, True), (902, 1, None, 0, "No page here.", None, 10.0, True), (900, None, 3, 0, "No book here.", None, 10.0, True)]
    got = ocr.book_paragraphs(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 792.0)], "book_id long, height double")).collect()
    assert {(r.run_uid, r.book_id, r.page_index, r.paragraph) for r in got if r.run_uid} == {(900, None, 3, "No book here."), (901, None, 3, "No book either."), (902, 1, None, "No page here.")}
    assert sum(r.run_uid is None for r in got) == 1 and len(got) == 4
