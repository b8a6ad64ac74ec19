"""Language of texts and of their stretches, with a confidence.

String-kernel classification: two texts are as similar as the n-grams of 1 to 3 signs that occur in both, over the
geometric mean of their numbers (a blended-spectrum presence kernel). Landmark texts stand for the rest (Nyström);
one-versus-rest ridge regression over the kernel gives a weight for each landmark and language. As the kernel counts
common n-grams, landmarks and weights fold into one matrix of n-grams by languages, and a batch of sentences is scored
by the product of its presence matrix, which is sparse, with that matrix.

A text is scored sentence by sentence. Where its sentences disagree, they are cut exactly and a path through the
languages is chosen that pays for every change; each run of the path is a stretch.

Null, empty and wordless texts have no language and give no row. Labels are null-safe; a label names its language by code,
three-letter code or name, in any case, with or without region. Repeated rows give repeated results; other columns
are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, slices, spread
from .sentences import sentences

#: Hash bits of an n-gram, longest n-gram, ridge, and what a change of language costs against a score difference of 1.
BITS, LONGEST, RIDGE, SHARP, CHANGE = 16, 3, 0.01, 7.0, 2.4
#: Labelled rows of each table the classifier may be fitted on, those with the least hashes of their ids; sentences of each, spread over its whole
#: text, and characters of each sentence; landmarks a language.
FIT_ROWS, FIT_PARTS, FIT_CHARS, LANDMARKS = 3000, 8, 400, 160
#: Rows are let through by their hash, so that about so many times FIT_ROWS are ordered however many there are.
SLACK = 1.5
#: The share of a fit's best score that a sentence's label must reach; short titles need some room. The share of a row's letters whose sentences
#: speak for its label from which its other sentences are believed too, and the share of the best score they must reach, so that those in another script aren't. How often
#: sentences are chosen, each time by the fit before.
DOUBT, BELIEF, TRUST, ROUNDS = 0.5, 0.8, 0.1, 2
#: Letters from which a sentence's own vote counts in the first look, and up to which it gains weight there.
VOTE, MOST_LETTERS = 8, 200
#: Signs of a phrase between quotation marks that is left out of its sentence, at most; a longer one is text of its own. A parameter.
LONGEST_PHRASE = 80
ATOM = re.compile(r"[.!?…।॥؟][\"”’»“)\]]*\s+|[。！？][”」』）]*\s*|\n+|(?<=[฀-๿”])[ \t]+(?=[^฀-๿ \t])|(?<=[^฀-๿\s])[ \t]+(?=[฀-๿])")
MULT = np.array([1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _fold() -> np.ndarray:
    """Lower-case letter of each code point; 32 for what is no letter or mark."""
    out = np.full(0x20000, 32, np.uint32)
    for cp in range(0x20000):
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    out[0xFE00:0xFE10] = 32
    return out


_FOLD: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of all texts, where those of each text begin, and the letters of each text."""
    if not _FOLD:
        _FOLD.append(_fold())
    n = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(n, dtype=np.uint32), lens)
    low = np.where(cps < 0x20000, _FOLD[0][np.minimum(cps, 0x1FFFF)], np.uint32(32))
    letter = low != 32
    letters = np.bincount(own[letter], minlength=n)
    same = np.empty(len(own), bool)
    if len(own):
        same[0] = False
        np.equal(own[1:], own[:-1], out=same[1:])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a single blank after each word
    low, own = low[keep], own[keep]
    if not len(low):
        return np.zeros(0, np.uint32), np.zeros(n, np.int64), letters
    parts, h = [], np.zeros(len(low), np.uint32)
    for k in range(LONGEST):
        if len(low) <= k:
            break
        h = (h[: len(low) - k] * np.uint32(0x01000193)) ^ (low[k:] * MULT[1] + np.uint32(k * 0x27D4EB2F))
        mixed = h ^ (h >> np.uint32(15))
        mixed = (mixed * MULT[2]) >> np.uint32(32 - BITS)
        ok = own[: len(own) - k] == own[k:]
        if k == 0:
            ok = low != 32
        parts.append(((own[: len(own) - k].astype(np.uint32) << np.uint32(BITS)) | mixed)[ok])
    keys = np.concatenate(parts)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    starts = np.searchsorted(keys, np.arange(n, dtype=np.uint64) << np.uint64(BITS))
    return keys & np.uint32((1 << BITS) - 1), starts, letters


#: Texts that one call of grams() can tell apart.
MOST = 1 << (32 - BITS)


class Model:
    """langs, and the folded matrix: a row for each hashed n-gram, a column for each language."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (texts by languages) and the letters of each text."""
        out, letters = [], []
        step, at = [], 0
        size = 0
        for t in texts:  # bounded products
            step.append(t)
            size += len(t)
            if size > 150_000 or len(step) >= MOST - 1:
                a, b = self._score(step)
                out.append(a), letters.append(b)
                step, size = [], 0
        if step or not out:
            a, b = self._score(step)
            out.append(a), letters.append(b)
        return np.concatenate(out), np.concatenate(letters)

    def _score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        g, starts, letters = grams(texts)
        n = len(texts)
        sums = np.zeros((n, len(self.langs)), np.float32)
        counts = np.diff(np.append(starts, len(g)))
        some = counts > 0
        if some.any():
            sums[some] = np.add.reduceat(self.matrix[g], starts[some], axis=0)
            sums[some] /= np.sqrt(counts[some])[:, None]
        return sums, letters


def fit(texts: list[str], labels: list[str], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """Kernel ridge regression over landmarks. The texts are bounded by the caller."""
    where = {lang: i for i, lang in enumerate(langs)}
    y = np.array([where[x] for x in labels])
    chosen: list[int] = []
    for c in range(len(langs)):
        own = np.flatnonzero(y == c)
        chosen += [int(i) for i in own[:: max(1, len(own) // landmarks)][:landmarks]]
    m = len(chosen)
    g, starts, _ = grams([texts[i] for i in chosen])
    spans = np.append(starts, len(g))
    seen, column = np.unique(g), np.repeat(np.arange(m), np.diff(spans))
    place = np.full(1 << BITS, len(seen), np.int64)
    place[seen] = np.arange(len(seen))
    # One byte for each n-gram and landmark: some 40 MB for the n-grams of 1700 landmarks.
    present = np.zeros((len(seen) + 1, m), np.uint8)
    present[place[g], column] = 1
    size = np.sqrt(np.maximum(1, np.diff(spans)))

    def kernel(some: list[str]) -> np.ndarray:
        g, starts, _ = grams(some)
        ends = np.append(starts[1:], len(g))
        out = np.zeros((len(some), m))
        for i, (a, b) in enumerate(zip(starts, ends)):
            if b > a:
                out[i] = present[place[g[a:b]]].sum(axis=0, dtype=np.uint16) / (size * np.sqrt(b - a))
        return out

    weight = np.maximum(1, np.bincount(y, minlength=len(langs)))[y] ** -0.5  # rare languages count for more
    weight *= len(texts) / weight.sum()
    left, right = RIDGE * kernel([texts[i] for i in chosen]) + 1e-6 * np.eye(m), np.zeros((m, len(langs)))
    for base in range(0, len(texts), 1000):
        own = slice(base, base + 1000)
        k = kernel(texts[own]) * np.sqrt(weight[own])[:, None]
        target = np.zeros((len(k), len(langs)))
        target[np.arange(len(k)), y[own]] = np.sqrt(weight[own])
        left += k.T @ k
        right += k.T @ target
    alpha = np.linalg.solve(left, right) / size[:, None]
    matrix = np.zeros((1 << BITS, len(langs)), np.float32)
    np.add.at(matrix, g, alpha[column].astype(np.float32))
    return Model(langs, matrix)


def label_names(rows: Iterable[tuple[str, str, str]]) -> dict[str, str]:
    """Lower-case spelling to language, from rows of (lang, iso3, lang_name)."""
    return {str(name).lower(): row[0] for row in rows for name in row[:3] if name}


def label_lang(label: str | None, names: dict[str, str]) -> str | None:
    """The language a label names, if any."""
    if not label:
        return None
    whole = label.strip().lower()
    return names.get(whole) or names.get(re.split(r"[-_ ]", whole)[0] if whole else "")


def atoms(text: str) -> list[str]:
    out, at = [], 0
    for m in ATOM.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return out


QUOTED = re.compile("“[^“”]{2,N}”|«[^«»]{2,N}»|„[^„“]{2,N}“|”[^”]{2,N}”|「[^「」]{2,N}」|\"[^\"]{2,N}\"".replace("N", str(LONGEST_PHRASE)))


def unquoted(sentence: str) -> str:
    """A sentence without the phrases it quotes, where enough of it is left to judge by."""
    if not any(q in sentence for q in "“«„”「\""):
        return sentence
    rest = QUOTED.sub(" ", sentence)
    return rest if sum(map(str.isalpha, rest)) >= 12 else sentence


def path(scores: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Best language of each sentence if every change costs."""
    gain = SHARP * scores * np.minimum(1.0, letters / 25.0)[:, None]
    n, k = gain.shape
    best, back = gain[0].copy(), np.zeros((n, k), np.int32)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - CHANGE
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - CHANGE) + gain[i]
    out = np.zeros(n, np.int32)
    out[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def confidence(scores: np.ndarray) -> float:
    e = np.exp(SHARP * (scores - scores.max()))
    return float(e.max() / e.sum())


def segment(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int, float]]]:
    """For each text its stretches: start, end, language's index, confidence. A text of one language is one stretch from 0."""
    cut = [atoms(t) if t else [] for t in texts]
    flat = [unquoted(a) for c in cut for a in c]
    scores, letters = model.score(flat)
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    starts = np.concatenate([[0], np.cumsum(counts)])
    weighted = scores * np.minimum(letters, MOST_LETTERS)[:, None]
    total = np.zeros((len(texts), len(model.langs)))
    np.add.at(total, np.repeat(np.arange(len(texts)), counts), weighted)
    words = np.zeros(len(texts))
    np.add.at(words, np.repeat(np.arange(len(texts)), counts), np.minimum(letters, MOST_LETTERS))
    main = total.argmax(axis=1)
    vote = scores.argmax(axis=1)
    split = (vote != np.repeat(main, counts)) & (letters >= VOTE)
    apart = np.zeros(len(texts), bool)
    np.logical_or.at(apart, np.repeat(np.arange(len(texts)), counts), split)
    exact: dict[int, list[tuple[int, int]]] = {}
    for i in np.flatnonzero(apart):
        own = path(scores[starts[i] : starts[i + 1]], letters[starts[i] : starts[i + 1]])
        if (own != own[0]).any():
            exact[int(i)] = sentences(texts[i])
        else:
            main[i] = own[0]
    s, n = model.score([unquoted(texts[i][a:b]) for i, spans in exact.items() for a, b in spans])
    at, out = 0, []
    for i, t in enumerate(texts):
        if not words[i]:
            out.append([])
            continue
        if i not in exact:
            out.append([(0, len(t), int(main[i]), confidence(total[i] / words[i]))])
            continue
        spans = exact[i]
        own_s, own_n = s[at : at + len(spans)], n[at : at + len(spans)]
        at += len(spans)
        runs: list[list] = []
        for (a, b), lang, sc, k in zip(spans, path(own_s, own_n), own_s, own_n):
            if runs and runs[-1][2] == lang:
                runs[-1][1] = b
                runs[-1][3] = runs[-1][3] + sc * k
                runs[-1][4] += k
            else:
                runs.append([a, b, int(lang), sc * k, k])
        if len(runs) == 1:
            runs[0][0], runs[0][1] = 0, len(t)
        out.append([(a, b, lang, confidence(sc / max(1, k))) for a, b, lang, sc, k in runs])
    return out


def parts_of(text: str) -> list[str]:
    """Up to FIT_PARTS sentences of a text, spread over the whole of it, each of at most FIT_CHARS characters."""
    own = atoms(text)[:-1] or [text]  # what follows the last mark may be cut off
    step = max(1.0, len(own) / FIT_PARTS)
    return [own[int(k * step)][:FIT_CHARS] for k in range(min(FIT_PARTS, len(own)))]


def labelled_parts(df: DataFrame) -> list:
    """label and sentences of at most FIT_ROWS rows of a table (id, label, text): those with the least hashes of their ids. Sentences are cut where the
    rows lie, and rows beyond a hash that lets through SLACK times FIT_ROWS don't leave it, so what reaches the driver is bounded."""
    a, b, c = df.columns
    top = 1 << 31
    n = df.count()
    share = min(1.0, SLACK * FIT_ROWS / max(n, 1))
    place = F.pmod(F.xxhash64(a), F.lit(top))
    some = df.filter(F.col(b).isNotNull() & F.col(c).isNotNull() & (F.length(c) > 3) & (place < int(share * top))).select(place.alias("place"), F.col(a).cast("string").alias("own"), b, c)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, c):
                parts = pa.array([parts_of(t) for t in own.column(3).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), parts], names=["place", "own", "label", "parts"])

    return some.mapInArrow(run, "place long, own string, label string, parts array<string>").orderBy("place", "own").limit(FIT_ROWS).collect()


def confirmed(rows: list[tuple[str, list[str]]], model: Model) -> tuple[list[str], list[str]]:
    """Sentences of labelled rows, and their labels: those whose label a model confirms by itself or by the rest of their row."""
    texts, labels = [], []
    scores, letters = model.score([p for _, parts in rows for p in parts])
    at = 0
    for lang, parts in rows:
        s, n = scores[at : at + len(parts)], letters[at : at + len(parts)]
        at += len(parts)
        c = model.langs.index(lang)
        whole = (n * (s.argmax(axis=1) == c)).sum() >= BELIEF * max(1, n.sum()) if parts else False
        for p, own, k in zip(parts, s, n):
            if k >= 6 and own[c] >= own.max() * (TRUST if whole else DOUBT):
                texts.append(p), labels.append(lang)
    return texts, labels


def training(spark: SparkSession, samples: DataFrame, languages: DataFrame, labelled: list[DataFrame]) -> Model:
    """Fit on the samples, then on these and sentences of at most FIT_ROWS rows of each labelled table (id, label, text) whose
    label the fit before confirms, ROUNDS times. The rows are the same in every run."""
    names = label_names([tuple(r) for r in languages.select("lang", "iso3", "lang_name").collect()])  # 14 rows, fixed
    langs = sorted(set(names.values()))
    rows = [(r[0], r[1]) for r in samples.select("lang", "text").collect() if r[0] in langs and r[1]]  # 210 rows, fixed
    model = fit([t for _, t in rows], [x for x, _ in rows], langs)
    found = [(x, r.parts) for df in labelled for r in labelled_parts(df) if (x := label_lang(r.label, names))]
    for _ in range(ROUNDS if found else 0):
        texts, labels = confirmed(found, model)
        model = fit([t for _, t in rows] + texts, [x for x, _ in rows] + labels, langs)
    return model


def language_segments(df: DataFrame, src: str, key: str, label: str, text: str, model: Model, names: dict[str, str]) -> DataFrame:
    """src, row_id, seg_start, seg_end, lang, confidence, label_lang and n_segs for each stretch of each text."""
    shared = df.sparkSession.sparkContext.broadcast((model, names))
    schema = "src string, row_id long, seg_start long, seg_end long, lang string, confidence double, label_lang string, n_segs int"

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, names = shared.value
        ids, labels, texts = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for i, own, segs in zip(ids, labels, segment(texts, model)):
            said = label_lang(own, names)
            rows += [(src, i, a, b, model.langs[k], c, said, len(segs)) for a, b, k, c in segs]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int32())
        cols = zip(*rows) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    rows = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("long").alias("row_id"), F.col(label).alias("label"), F.col(text).alias("text"))
    return map_rows(spread(rows), schema, "text", kernel)
