"""Text that was decoded with the wrong character encoding: finding the records and restoring the text.

Clean words are garbled by every chain of a right and a wrong encoding, and a multinomial classifier over
hashed byte bigrams learns to tell the chains and clean text apart. Words with characters beyond ASCII are classified; the
chains are taken as the classifier ranks them, down to a floor, and the first that can be inverted strictly is the word's: each character must have a byte in the wrong encoding, the bytes must
decode in the right one, garbling the result again must give the word, and the result must be likelier as clean text. A word that can't be inverted counts as damaged only
where its score is beyond doubt or a character stands for undecodable bytes.

The clean words are those of the language samples and of a whole table of texts; the bigrams of clean text are counted over all its words, and
of the words those are garbled that make up at least RATE of a million, at most PER / RATE.

Null, empty and plain ASCII texts are no case and never reach Python. A text is affected if one of its words is;
restoring changes only words whose inversion is exact. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices, spread

#: Words that are garbled to fit the classifier make up so many of PER words or more.
PER, RATE = 1_000_000, 100
#: Log-odds a word must reach: with an exact inversion, and without.
SURE, BEYOND_DOUBT = 2.0, 12.0
#: How much likelier as clean text the restored word must be.
GAIN, MUCH = 2.5, 9.0
#: Log-odds that are enough where the inversion yields valid UTF-8, which chance hardly does.
EVEN = -12.0
#: Pairs of the right and the wrong encoding. "twice" goes through UTF-8 read as cp1252 two times.
CHAINS = (
    [("utf-8", x) for x in ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp874", "koi8-r", "mac-roman", "cp437", "cp850", "cp866", "iso8859-2", "iso8859-15", "cp932", "gbk", "big5", "euc-kr", "euc-jp")]
    + [("twice", "cp1252"), ("twice", "latin-1")]
    + [("cp1252", x) for x in ("cp437", "cp850", "mac-roman", "cp1251", "cp1250", "koi8-r", "cp1253", "cp1256", "cp866", "gbk", "cp932")]
    + [("mac-roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252")]
    + [("cp1250", x) for x in ("cp1252", "cp1251", "iso8859-2", "cp850", "cp437", "mac-roman")]
    + [("iso8859-2", x) for x in ("cp1252", "cp1250")]
    + [("cp852", "cp1252")]
    + [("cp1251", x) for x in ("cp1252", "koi8-r", "cp866", "mac-roman", "cp1250", "cp437", "cp850", "gbk", "cp932")]
    + [("koi8-r", x) for x in ("cp1251", "cp1252", "cp866")]
    + [("cp866", x) for x in ("cp1251", "cp1252")]
    + [("iso8859-5", x) for x in ("cp1251", "cp1252")]
    + [("cp1256", x) for x in ("cp1252", "cp1251", "mac-roman")]
    + [("iso8859-6", "cp1252")]
    + [("cp874", x) for x in ("cp1252", "mac-roman", "cp1251")]
    + [("cp932", x) for x in ("cp1252", "gbk", "big5", "mac-roman", "cp1251", "cp437", "euc-kr")]
    + [("euc-jp", x) for x in ("cp1252", "gbk", "cp932", "cp1251")]
    + [("gbk", x) for x in ("cp1252", "big5", "cp932", "mac-roman", "cp1251", "euc-kr", "cp437")]
    + [("big5", x) for x in ("cp1252", "gbk", "cp932")]
)
VALID = frozenset(k for k, (right, _) in enumerate(CHAINS) if right in ("utf-8", "twice"))
WORD = re.compile(r"[^ \t\n\r]*[^\x00-\x7f][^ \t\n\r]*")
#: Signs that ordinary text holds in any place. The model is shown each beside letters, figures and alone.
SIGNS = "“”„‘’«»‹›…–—·•§°±½¼¾²³€£¥©®™×÷№ªº¿¡¬\xad‐‑†‡"
LOST = "�"
ORDINARY = frozenset(SIGNS + "、。「」『』（），：；！？・〜ー々〇《》【】　 ￥％")


@lru_cache(None)
def single(name: str) -> tuple[str, dict[str, int]] | None:
    """Table of a one-byte encoding, undefined bytes as the control characters of the same number; None for others."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            if name in ("cp932", "gbk", "big5", "euc-kr", "euc-jp", "utf-8"):
                return None
            out.append(chr(b))
    if name in ("cp932", "gbk", "big5", "euc-kr", "euc-jp", "utf-8"):
        return None
    table = "".join(out)
    back = {c: b for b, c in enumerate(table)}
    if name in ("cp1252", "latin-1"):
        back |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in back}
    return table, back


def to_bytes(text: str, name: str) -> bytes | None:
    one = single(name)
    try:
        return bytes(map(one[1].__getitem__, text)) if one else text.encode(name)
    except (KeyError, UnicodeEncodeError):
        return None


def to_text(raw: bytes, name: str, lossy: bool = False) -> str | None:
    one = single(name)
    if one:
        return "".join(map(one[0].__getitem__, raw))
    try:
        return raw.decode(name, "replace" if lossy else "strict")
    except UnicodeDecodeError:
        return None


def garble(text: str, right: str, wrong: str) -> str | None:
    """What the wrong encoding makes of the text; None where the right one can't hold it. Undecodable bytes become U+FFFD."""
    if right == "twice":
        once = to_text(text.encode(), wrong)
        return to_text(once.encode(), wrong) if once else None
    raw = to_bytes(text, right)
    return None if raw is None else to_text(raw, wrong, lossy=True)


def invert(text: str, right: str, wrong: str) -> str | None:
    """The text before it was garbled, if every step is exact and the way back gives the same."""
    if right == "twice":
        once = invert(text, "utf-8", wrong)
        return invert(once, "utf-8", wrong) if once is not None else None
    raw = to_bytes(text, wrong)
    out = to_text(raw, right) if raw is not None else None
    return out if out is not None and out != text and garble(out, right, wrong) == text else None


def bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte bigrams of each word in which a byte beyond ASCII takes part, and the word of each."""
    raw = " " + " ".join(words) + " "
    b = np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)
    own = np.cumsum(b == 32) - 1
    h = (b[:-1].astype(np.int64) << 8) | b[1:]
    wide = (b[:-1] >= 128) | (b[1:] >= 128)
    w = np.where(b[1:] == 32, own[:-1], own[1:])
    w = np.where(b[:-1] == 32, own[:-1], w)
    return h[wide], np.minimum(w[wide], max(0, len(words) - 1))


class Chains:
    """log-odds of each bigram for each chain against clean text."""

    def __init__(self, weights: np.ndarray, clean: np.ndarray, prior: np.ndarray):
        self.weights, self.clean, self.prior = weights, clean, prior
        self.known: dict[str, tuple[bool, str | None]] = {}

    def odds(self, words: list[str]) -> np.ndarray:
        h, own = bigrams(words)
        out = np.tile(self.prior, (len(words), 1))
        if len(h):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[starts]] += np.add.reduceat(self.weights[h], starts, axis=0)
        return out

    def judge(self, words: list[str]) -> None:
        """Remember of each new word whether it is damaged, and its restored form if there is one."""
        new = list({w for w in words if w not in self.known})
        if len(self.known) > 300_000:
            self.known.clear()
            new = list(set(words))
        for base in range(0, len(new), 4000):
            part = new[base : base + 4000]
            odds = self.odds(part)
            order = np.argsort(-odds, axis=1, kind="stable")
            for i, w in enumerate(part):
                self.known[w] = self._judge(w, odds[i], order[i])

    def _judge(self, word: str, odds: np.ndarray, order: np.ndarray) -> tuple[bool, str | None]:
        if LOST in word:
            return True, None
        top = float(odds[order[0]])
        calm = plausible(word)
        for k in order:
            if odds[k] < EVEN:
                break
            right, wrong = CHAINS[k]
            # Chance hardly makes valid UTF-8: that an inversion into it exists is evidence by itself.
            utf8 = k in VALID
            if not utf8 and odds[k] < max(SURE, top - 25.0):
                continue
            out = invert(word, right, wrong)
            if out is None or any("\x7f" <= c < "\xa0" for c in out):
                continue
            found = scripts(out)
            if len(found) > 1 or "?" in found or found & set("CATD") and re.search("[A-Za-z]", word):
                continue
            if calm and not utf8:
                # An ordinary word that happens to be another one in another encoding; letter case decides nothing.
                if "L" in found or self.plain([out.lower()])[0] < self.plain([word.lower()])[0] + MUCH:
                    continue
            elif self.plain([out])[0] < self.plain([word])[0] + GAIN:
                continue
            return True, out
        if top < SURE:
            return False, None
        signs = sum(not c.isalpha() and c not in ORDINARY for c in word if c > "\x7f")
        odd = signs >= 2 or len(scripts(word)) > 1
        c1 = any("\x80" <= c < "\xa0" and c != "\x85" for c in word)
        return odd and top > BEYOND_DOUBT or c1 and top > SURE, None

    def plain(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word as clean text."""
        h, own = bigrams(words)
        return np.bincount(own, weights=self.clean[h], minlength=len(words))

    def __getstate__(self):
        return {"weights": self.weights, "clean": self.clean, "prior": self.prior, "known": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)


def scripts(word: str) -> set[str]:
    out = set()
    for c in word:
        if c.isalpha():
            cp = ord(c)
            out.add("L" if cp < 0x250 and c not in "ªº" or 0x1E00 <= cp < 0x1F00 else "C" if 0x400 <= cp < 0x530 else "A" if 0x600 <= cp < 0x700 else "T" if 0xE00 <= cp < 0xE80 else "H" if 0x3040 <= cp < 0xA000 or cp == 0x3005 else "D" if 0x900 <= cp < 0x980 else "?")
    return out - ({"L"} if "H" in out or "T" in out else set())


QUOTES = "“”„‘’«»‹›…–—·()[]{},.;:!?¿¡'\"/"


def plausible(word: str) -> bool:
    """Whether the word looks like one of an ordinary text: one script, ordinary case, signs only at its ends."""
    for part in re.split("[-’'‐‑/]", word.strip(QUOTES + "\xad¬-‐")):
        part = part.strip(QUOTES)
        if not part:
            continue
        letters = part.rstrip("0123456789")
        if not letters.isalpha() or len(scripts(part)) > 1 or "?" in scripts(part):
            return False
        if not (letters.islower() or letters.isupper() or letters.istitle() or not letters.upper() != letters.lower()):
            return False
    return True


def everyday() -> list[str]:
    """Signs in the places where ordinary text has them."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    return [w for s in SIGNS for c in letters for w in (s, s + c, c + s, c + s + c, s + "C", s + ",", c + s + ".", c + s + ",")]


def tally(words: list[str], weights: np.ndarray | None = None) -> np.ndarray:
    """How often each bigram stands in the words."""
    if not words:
        return np.zeros(1 << 16)
    h, own = bigrams(words)
    return np.bincount(h, None if weights is None else weights[own], minlength=1 << 16).astype(np.float64)


def fit(words: dict[str, int], grams: np.ndarray | None = None, blur: float = 0.02) -> Chains:
    """words: clean ones and how often they occur; grams: counts of the bigrams of clean text, if they are known better. Garbles each word in every way and fits
    the multinomial model. Every class keeps the same share of its mass for bigrams it hasn't seen, so that these speak for none."""

    def share(n: np.ndarray) -> np.ndarray:
        return n / max(1.0, n.sum())

    even, whole = blur / (1 << 16), list(words)
    upper = [w for x in whole for w in WORD.findall(x.upper())]
    seen = tally(whole, np.array(list(words.values()), float)) if grams is None else grams
    log_clean = np.log((0.8 - blur) * share(seen) + 0.1 * share(tally(upper)) + 0.1 * share(tally(everyday())) + even)
    rows = []
    for right, wrong in CHAINS:
        made = [g for w in whole if (g := garble(w, right, wrong)) and g != w and LOST not in g]
        rows.append(np.log((1 - blur) * share(tally([x for g in made for x in WORD.findall(g)])) + even) - log_clean)
    return Chains(np.array(rows, np.float32).T.copy(), log_clean, np.full(len(CHAINS), -4.0, np.float32))


def training(samples: DataFrame, more: DataFrame) -> Chains:
    """Fit on the language samples, then on these and all clean words of a table (id, text): words that the first fit takes for garbled are left out.
    What reaches the driver are the counts of at most 2^16 bigrams and PER / RATE words."""
    texts = [r[0] for r in samples.select("text").collect() if r[0]]  # 210 rows, fixed
    own = Counter(w for t in texts for w in WORD.findall(t))
    first = more.sparkSession.sparkContext.broadcast(fit(own))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, grams = first.value, Counter(), np.zeros(1 << 16)

        def flush() -> pa.RecordBatch:
            nonlocal grams
            keys, n = list(words), np.fromiter(words.values(), np.int64, len(words))
            grams += tally(keys, n)
            at = np.flatnonzero(grams)
            cols = [pa.array([*keys, *[None] * len(at)], pa.string()), pa.array([*[None] * len(keys), *at.tolist()], pa.int32()), pa.array([*n.tolist(), *grams[at].astype(np.int64).tolist()], pa.int64())]
            words.clear()
            grams = np.zeros(1 << 16)
            return pa.RecordBatch.from_arrays(cols, names=["word", "gram", "n"])

        for batch in batches:
            for part in slices(batch, batch.schema.names[0]):
                found = [w for t in part.column(0).to_pylist() for w in WORD.findall(t)]
                model.judge(found)
                words.update(w for w in found if LOST not in w and model.known[w][1] is None)
            if len(words) > 300_000:
                yield flush()
        if words:
            yield flush()

    _, text = more.columns
    wide = spread(more.filter(F.col(text).rlike(r"[^\x00-\x7F]")).select(text))
    sums = wide.mapInArrow(count, "word string, gram int, n long").groupBy("word", "gram").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        total = sums.filter("word is not null").agg(F.sum("n")).first()[0] or 0
        rows = sums.filter(F.col("gram").isNotNull() | (F.col("n") >= RATE * total / PER)).toArrow().to_pylist()
    finally:
        sums.unpersist()
    grams = tally(list(own), np.array(list(own.values()), float))
    for r in rows:
        if r["gram"] is None:
            own[r["word"]] += r["n"]
        else:
            grams[r["gram"]] += r["n"]
    return fit(own, grams)


def damaged_words(text: str, words: list[str], model: Chains) -> list[str]:
    """The damaged words of a text. Words restored to another script than Latin need a text that isn't Latin otherwise."""
    bad = [w for w in words if model.known[w][0]]
    if not bad:
        return bad
    foreign = {w for w in bad if (out := model.known[w][1]) and scripts(out) & set("CATDH")}
    if foreign:
        latin = len(LATIN_WORD.findall(text)) - sum(len(LATIN_WORD.findall(w)) for w in foreign)
        letters = sum(c > "\x7f" for w in foreign for c in w)
        if latin > len(foreign) or letters < 3:
            bad = [w for w in bad if w not in foreign]
    return bad


LATIN_WORD = re.compile("[A-Za-z]{3,}")


def damaged(df: DataFrame, src: str, key: str, text: str, model: Chains) -> DataFrame:
    """src, row_id, restored text and whether all of it could be restored, for each affected record."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        found = [WORD.findall(t) for t in texts]
        model.judge([w for ws in found for w in ws])
        rows = []
        for i, t, ws in zip(ids, texts, found):
            # Each line is judged by itself: a page may hold lines of several scripts.
            bad = damaged_words(t, ws, model) if "\n" not in t else [w for line in t.split("\n") if not line.isascii() for w in damaged_words(line, WORD.findall(line), model)]
            if bad:
                fixed = WORD.sub(lambda m: model.known[m.group()][1] or m.group(), t)
                rows.append((src, i, fixed, all(model.known[w][1] is not None for w in bad)))
        cols = zip(*rows) if rows else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["src", "row_id", "restored", "complete"])

    wide = df.filter(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("text"))
    return map_rows(spread(wide), "src string, row_id long, restored string, complete boolean", "text", kernel)
