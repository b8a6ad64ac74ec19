"""Scanned pages: the lattice, heads by repetition, the lexicon's bound, paragraphs over pages."""

import numpy as np

from folioscope.llm import ocr

RATES = {"the": 60_000, "tide": 900, "turned": 500, "behind": 400, "pier": 300, "almanac": 200, "house": 250, "harbour": 220, "master": 210, "harbourmaster": 120, "old": 700, "salt": 300, "and": 40_000, "of": 30_000}
SCHEMA = "run_uid long, book_id long, page_index int, run_index int, text string, transform_matrix array<double>, font_size double, has_eol boolean"


def lines(*texts):
    return [(k, t, True, 10.0, 60.0, 100.0 + 14 * k, 792.0, True) for k, t in enumerate(texts)]


def read(*texts):
    found, out = ocr.page(lines(*texts), ocr.Reader(ocr.Lexicon.of(RATES), repair=True))
    return sorted(found), ["".join(x["text"] + x["glue"] for x in p).strip() for p in ocr.paragraphs(out)]


def test_split_merge_confusion_and_hyphen_on_one_path():
    assert read("thetide of the hou se turned bchind", "the alma-", "nac and harbour-", "master") == ([(0, "misread"), (1, "broken_word"), (2, "broken_word")], ["the tide of the house turned behind the almanac and harbourmaster"])
    # Two words run together; a word over two hyphens whose middle piece is a whole line; a misread rest.
    assert read("of harbourhouse and")[1] == ["of harbour house and"]
    assert read("the har-", "bour-", "master turned") == ([(0, "broken_word"), (1, "broken_word")], ["the harbourmaster turned"])
    assert read("the alm-", "auac turned") == ([(0, "broken_word"), (1, "misread")], ["the almanac turned"])
    assert read("the alm", "anac turned") == ([(0, "broken_word")], ["the almanac turned"])


def test_same_readings_at_any_rate_of_all_words():
    few = read("thetide of the hou se turned bchind", "the alma-", "nac")
    assert few == read("thetide of the hou se turned bchind", "the alma-", "nac")
    r = ocr.Reader(ocr.Lexicon.of({f"w{i}": 1.0 for i in range(200_000)} | RATES))
    assert r.read("bchind")[0] == "behind" and all(r.read(w)[0] is None for w in ("qzxv", "vrbn", "kclm"))


def test_lexicon_is_bounded_and_exact():
    lex = ocr.Lexicon.of(RATES)
    assert lex.bits("tide") == round(10 * np.log2(901)) / 10 and lex.bits("tidc") == 0.0 and ocr.Lexicon.of({}).bits("x") == 0.0
    assert ocr.PER / ocr.LEAST * 9 < 40e6


def test_a_body_line_near_the_edge_is_no_head(spark):
    def run(uid, page, k, text, y):
        return (uid, 1, page, k, text, [10.0, 0.0, 0.0, 10.0, 60.0, y], 10.0, True)

    rows = [run(10 * p + k, p, k, t, y) for p in range(6) for k, (t, y) in enumerate([("A Winter in Sel", 24.0), ("the tide turned", 90.0), (str(p), 770.0)])]
    rows += [run(100, 7, 0, "the tide turned behind the pier", 44.0), run(101, 7, 1, "and the tide turned", 58.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.run_uid, r.noise) for r in ocr.noise(df, spark.createDataFrame([(1, 792.0)], "book_id long, height double")).collect()}
    assert got == {(10 * p, "running_head") for p in range(6)} | {(10 * p + 2, "page_number") for p in range(6)}


def test_long_paragraphs_and_paragraphs_over_many_pages(spark):
    place = lambda k: [10.0, 0.0, 0.0, 10.0, 60.0, 90.0 + 6.0 * k]
    rows = [(p, 1, p, 0, f"and so it goes on, page {p},", place(0), 10.0, True) for p in range(2 * ocr.STRIDE + 5)]
    rows += [(9000, 1, 3 * ocr.STRIDE, 0, "to its end.", place(0), 10.0, True), (9001, 1, 3 * ocr.STRIDE + 1, 0, "A new one.", place(0), 10.0, True)]
    got = ocr.book_paragraphs(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, 792.0)], "book_id long, height double")).orderBy("page_index").collect()
    assert [(r.page_index, r.n_parts) for r in got] == [(0, 2 * ocr.STRIDE + 6), (3 * ocr.STRIDE + 1, 1)]
    assert got[0].paragraph.startswith("and so it goes on, page 0, and") and got[0].paragraph.endswith("to its end.")
    assert ocr.book_paragraphs(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "book_id long, height double")).count() == 0
