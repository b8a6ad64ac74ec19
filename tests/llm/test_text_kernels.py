"""Kernels of the text operators, without Spark where it isn't needed."""

import base64
import random
import unicodedata

import pytest

from folioscope.llm import chunks, encoding, language, ocr, pii, sentences, tokens

LANGS = {
    "en": ["The ferryman opened the broken compass before the tide turned.", "Nobody in the lower town praised a bundle of letters.", "The night warden counted three pages of corrections."],
    "de": ["Der Fährmann öffnete den zerbrochenen Kompass vor der Flut.", "Niemand in der Unterstadt lobte ein Bündel Briefe.", "Die Nachtwächterin zählte drei Seiten Korrekturen."],
    "ru": ["Перевозчик открыл сломанный компас до прилива.", "Никто в нижнем городе не похвалил связку писем.", "Ночной сторож сосчитал три страницы исправлений."],
}


def cut_of(text, kind=None):
    return [text[a:b] for a, b in sentences.sentences(text, kind)]


def test_tokens_equal_a_public_implementation():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = tokens.ByteBPE.load("byte_bpe_50k")
    rnd = random.Random(1)
    texts = ["", "hello  world\n\n x", "<|endoftext|> it's", "日本語のテキスト", "ä" * 3000, "\x00\x01", "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(3000))]
    for t in texts:
        assert bpe.encode(t) == enc.encode_ordinary(t)
    assert bpe.encode(None) == []


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = [str(i).encode() for i in range(3000)]
    h = tokens.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(3000)) and h.find(b"x") == -1 and len(h.keys) == len(keys)


def test_sentences():
    assert cut_of("Dr. Low met Mrs. Hay at 3.5 km. “Who goes there?” asked he. It ended, etc. The rest is p. 12.") == ["Dr. Low met Mrs. Hay at 3.5 km.", "“Who goes there?” asked he.", "It ended, etc.", "The rest is p. 12."]
    assert cut_of("The sign read “Closed. Ring twice.” The bell rang.") == ["The sign read “Closed. Ring twice.”", "The bell rang."]
    assert cut_of("“等等！钟响了。”妹妹说。去年。") == ["“等等！钟响了。”妹妹说。", "去年。"]
    assert cut_of("(One thing.) Another\nthing here. Last") == ["(One thing.)", "Another\nthing here.", "Last"]
    assert cut_of(None) == [] and cut_of(" \n ") == [] and cut_of("1. A Title. And more", "heading") == ["1. A Title. And more"]
    assert cut_of("...ter of bells. Her stamp...") == ["...ter of bells.", "Her stamp..."]
    long = "One two three four. " * 5000
    assert len(cut_of(long)) == 5000


def test_chunks_cover_overlap_and_stay_within_the_limit():
    rnd = random.Random(2)
    for _ in range(60):
        text = "".join(rnd.choice(["word ", "tide. ", "\n\n", "x" * 40, "。", "é"]) for _ in range(rnd.randrange(1, 300)))
        limit, overlap = rnd.randrange(20, 200), rnd.randrange(0, 15)
        spans = chunks.cut(text, limit, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < b - a <= limit for a, b in spans)
        assert all(c == max(b - overlap, a + 1) for (a, b), (c, _) in zip(spans, spans[1:]))
    assert chunks.cut("", 5, 1) == [] and chunks.cut(None, 5, 1) == [] and chunks.cut("abc", 5, 1) == [(0, 3)]
    with pytest.raises(ValueError):
        chunks.cut("abc", 5, 5)


def test_language_of_stretches():
    m = language.fit([t for ts in LANGS.values() for t in ts], [k for k, ts in LANGS.items() for _ in ts], sorted(LANGS))
    mixed = LANGS["en"][0] + " " + LANGS["en"][1] + "\n\n" + LANGS["ru"][2]
    got = language.segment(["", None, "12 — 34", LANGS["de"][0], mixed, LANGS["en"][0] + " Her stamp said “nur für Leser”."], m)
    assert got[:3] == [[], [], []] and [m.langs[s[2]] for s in got[3]] == ["de"]
    assert [(a, m.langs[k]) for a, _, k, _ in got[4]] == [(0, "en"), (mixed.index("Ночной"), "ru")]
    assert len(got[5]) == 1
    names = language.label_names([("en", "eng", "English"), ("de", "deu", "German")])
    assert [language.label_lang(x, names) for x in ("EN", "en-GB", "ENGLISH", "deu", "de_AT", "und", "", None, "x-none")] == ["en", "en", "en", "de", "de", None, None, None, None]


def test_kernel_equals_sets_of_ngrams():
    texts = ["abc abd", "the tide", "ändern Ä"]
    g, starts, letters = language.grams(texts)
    ends = [*starts[1:], len(g)]
    assert list(letters) == [6, 7, 7] and all(len(set(g[a:b])) == b - a for a, b in zip(starts, ends))


def test_wrong_encodings_come_back():
    m = encoding.fit({w: 3 for ts in LANGS.values() for t in ts for w in encoding.WORD.findall(t)})
    for text, right, wrong in (("Fährmann öffnete", "utf-8", "cp1252"), ("Никто в нижнем городе", "cp1251", "cp1252"), ("zählte", "twice", "cp1252"), ("“Who”", "utf-8", "mac-roman")):
        bad = encoding.garble(text, right, wrong)
        assert encoding.invert(bad, right, wrong) == text
        words = encoding.WORD.findall(bad)
        m.judge(words)
        assert encoding.damaged_words(bad, words, m)
    for good in ("Die Nachtwächterin zählte drei Seiten", "12 € (½), ±3 °C", "Ночной сторож", "CORAÇÃO, SÃO TÃO"):
        words = encoding.WORD.findall(good)
        m.judge(words)
        assert not encoding.damaged_words(good, words, m)


def test_personal_information_keeps_offsets():
    text = "Mail ink+notes (at) saltledger (dot) example or ring +44 20 7946 0920. Passport X00519192; I, Íñigo de la Brumaire, of Flat 3, 16 North Ebb Avenue, Dralowen. ISBN 978-0-00-36889-0, cover@2x.png"
    got = [(k, text[a:b]) for k, a, b in pii.find(text)]
    assert got == [("email", "ink+notes (at) saltledger (dot) example"), ("phone", "+44 20 7946 0920"), ("id", "X00519192"), ("name", "Íñigo de la Brumaire"), ("address", "Flat 3, 16 North Ebb Avenue, Dralowen")]
    assert pii.mask(text, pii.find(text)).startswith("Mail [EMAIL] or ring [PHONE]. Passport [ID]; I, [NAME], of [ADDRESS].")
    wide = "​電話０００－００００－９１１６まで"
    assert [(k, wide[a:b]) for k, a, b in pii.find(wide)] == [("phone", "０００－００００－９１１６")]
    assert pii.find("") == [] and pii.find(None) == [] and pii.mask(None, []) is None
    spelled = "reach him at five-five-five, zero one nine seven after"
    assert [(k, spelled[a:b]) for k, a, b in pii.find(spelled)] == [("phone", "five-five-five, zero one nine seven")]


def test_lookalike_table_is_consistent():
    from folioscope.llm import lookalike

    rows = {a: b for a, b, _ in lookalike.mapping()}
    assert rows["Ａ"] == "A" and rows["а"] == "a" and rows["​"] == "" and rows[" "] == " " and "³" not in rows and "…" not in rows
    assert all(unicodedata.normalize("NFC", b) == unicodedata.normalize("NFC", "".join(rows.get(c, c) for c in b)) for b in rows.values())


def test_reader_undoes_confusions():
    rates = {"behind": 500, "the": 5000, "almanac": 200, "lamp-lit": 50, "lamp-": 50, "lamp": 80, "lit": 60, "procession": 90}
    r = ocr.Reader(ocr.Lexicon.of(rates))
    assert r.read("bchind")[0] == "behind" and r.read("a1manac")[0] == "almanac" and r.read("behind")[0] is None
    assert r.cut("lamp", "lit") < 0 <= r.cut("proces", "sion")


def test_names_without_a_list_are_found_by_their_place():
    def names(text):
        return [text[a:b] for k, a, b in pii.find(text) if k == "name"]

    assert not {"corvane", "ysolde", "tamsin", "brannoc"} & pii.GIVEN
    assert names("Please return the volume to Corvane Hulmbeck, 14 Old Harbour Street, Dralowen.") == ["Corvane Hulmbeck"]
    assert names("The tide fell. I, Ysolde van der Mark, lent this book.") == ["Ysolde van der Mark"]
    assert names("Ysolde Hulmbeck and Tamsin O’Quay shared a card.") == ["Ysolde Hulmbeck", "Tamsin O’Quay"]
    assert names("Mit freundlichen Grüßen\nBrannoc Tamsin Hulmbeck\nLindmoorweg 7, 00123 Varnheim") == ["Brannoc Tamsin Hulmbeck"]
    assert names("Mme ysolde de la mark a relu la page. That copy belongs to tamsin hulmbeck’s aunt.") == ["ysolde de la mark", "tamsin hulmbeck"]
    assert names("姓名：王小明。田中太郎さん、श्री राम शर्मा, ") == ["王小明", "田中太郎", "राम शर्मा"]
    assert names("The Old Tower stood by common consent. Eine Laterne und drei Seiten Korrekturen. Ein Bündel Briefe.") == []


def test_a_sentence_may_hold_any_number_of_ends():
    quoted = "“" + "It rang. " * 30 + "It stopped.”"
    assert cut_of(quoted + " Then he left.") == [quoted, "Then he left."]
    speech = "– Vänta " + "och vänta " * 60 + "nu! Klockan ringer – sade färjkarlen."
    assert sentences.quotations(speech) == [(0, speech.index("–", 1) + 1, "—")]
    assert len(cut_of(". " * 400)) == 1


def test_long_quotations_and_words_far_back():
    inner = "It rang and rang again. "
    for size, parts in ((sentences.LONG_QUOTE - 200, 1), (sentences.LONG_QUOTE + 200, 2)):
        half = inner * (size // 2 // len(inner))
        assert len(cut_of("“" + half.strip() + "\n\n" + half.strip() + "”")) == parts
    assert cut_of("x" * sentences.WORD_BACK + " Dr. Low came.") == ["x" * sentences.WORD_BACK + " Dr. Low came."]
    many = "“It rang. He left.” said the old man. " * 2000
    assert len(cut_of(many)) == 2000


def test_phrases_within_quotation_marks_and_parts_for_the_fit():
    for size, want in ((language.LONGEST_PHRASE, False), (language.LONGEST_PHRASE + 1, True)):
        assert ("x" * size in language.unquoted("The label on the box read “" + "x" * size + "” and no more.")) is want
    text = "".join(f"Sentence number {i}. " for i in range(100)) + "rest"
    got = language.parts_of(text)
    assert len(got) == language.FIT_PARTS and "number 0." in got[0] and "number 87." in got[-1]
    assert language.parts_of("x" * 5000) == ["x" * language.FIT_CHARS]


def test_very_long_texts_take_time_in_proportion():
    import time

    one = "The ferryman opened the broken compass before the tide turned. Der Fährmann öffnete den Kompass — “nur für Leser”. "
    m = language.fit([t for ts in LANGS.values() for t in ts], [k for k, ts in LANGS.items() for _ in ts], sorted(LANGS))
    e = encoding.fit({w: 3 for ts in LANGS.values() for t in ts for w in encoding.WORD.findall(t)})
    r = ocr.Reader(ocr.Lexicon.of({w: 10.0 for w in one.lower().split()}), repair=True)

    def judge(t):
        e.judge(encoding.WORD.findall(t))

    kernels = {
        "language": lambda t: language.segment([t], m), "encoding": judge, "chunks": lambda t: chunks.cut(t, 900, 80), "sentences": lambda t: sentences.sentences(t), "pii": pii.find,
        "ocr": lambda t: ocr.page([(k, p, True, 10.0, 60.0, None, None, True) for k, p in enumerate(t.split(". "))], r),
    }
    for name, f in kernels.items():
        f(one * 50)
        took = []
        for n in (500, 4000):
            began = time.perf_counter()
            f(one * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * 4 * took[0] + 0.2, (name, took)
