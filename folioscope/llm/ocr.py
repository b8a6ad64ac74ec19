"""Noise in text from scanned pages: running heads, page numbers, cut words and misread characters; and the text
repaired into paragraphs.

A lexicon holds the frequencies of all words that make up a given share of the corpus, so its size is bounded whatever the corpus.
Rules compare the frequencies of a text's readings with each other, never a count with a
fixed number, so a page is judged alike in a corpus of any size. Each page is one stream of its body lines with the line ends taken out. A lattice over the stream holds
every reading: a word as it stands, a confusion of characters undone, a word split in two, two pieces merged over a blank or a line's end,
pieces merged over any number of hyphens at line ends, or the hyphen kept. Each arc gains the bits by which its reading is likelier than
the stream as it stands, less a price for the edit; the best path through the page decides all of them jointly, and noise and repairs are read off it.
Paragraph boundaries are chosen by dynamic programming over the lines from indents, gaps, short lines,
and how sentences end and begin; paragraphs that run over pages are joined by their numbers afterwards.

A line near the page's edge is a head or foot if lines of the book stand at its place on two pages or more; where no place of the
book recurs, as in a book of one page, the edge alone decides.
Null and blank texts are runs without noise. Null geometry is replaced by what the run's place and type size say.
Books without page sizes take the lowest line of the book. A run without book or page lies on a page of its own. Deliveries of the same run count once in the result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shared_folder
from .sentences import EITHER, OPEN_ENDED

#: The lexicon's frequencies are per so many words. Words rarer than LEAST aren't kept: at most PER / LEAST words are, some 36 MB.
PER, LEAST = 1e6, 0.25
#: What scanning makes of characters: the misread form and what it stands for.
CONFUSIONS = [
    ("c", "e"), ("ri", "n"), ("!", "i"), ("o", "a"), ("0", "o"), ("f", "t"), ("cl", "d"), ("5", "s"), ("ii", "u"), ("1", "l"), ("b", "h"), ("9", "g"),
    ("rn", "m"), ("vv", "w"), ("6", "b"), ("m", "rn"), ("h", "li"), ("6", "é"), ("6", "ó"), ("1", "i"), ("l", "i"), ("i", "l"), ("|", "l"), ("|", "i"), ("e", "c"), ("t", "f"),
    ("d", "cl"), ("n", "ri"), ("u", "ii"), ("a", "o"), ("h", "b"), ("li", "h"), ("n", "u"), ("u", "n"), ("8", "b"), ("3", "e"), ("2", "z"), ("y", "v"), ("q", "g"), ("0", "о"), ("3", "з"), ("6", "б"),
    ("н", "и"), ("п", "л"), ("ьі", "ы"), ("ьi", "ы"), ("п", "н"), ("и", "н"), ("л", "п"), ("1", "і"), ("4", "ч"), ("ш", "щ"), ("е", "с"), ("с", "е"), ("0", "0"),
]
BY_SIGN: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    if _a != _b:
        BY_SIGN.setdefault(_a[0], []).append((_a, _b))
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}!|’']+(?:-[\p{L}\p{M}]+)*")
PIECE = regex.compile(r"\p{L}")
CUT = "-¬\xad‐‑"
NUMBER = regex.compile(r"^[\s\p{P}\p{S}]*(?:(?:p|pp|page|pag|pág|стр|с|s|S|str)\.?\s*)?[\s\p{P}\p{S}]*(?:[0-9OolISsZBg|]{1,4}|(?:[0-9OolI]\s){1,3}[0-9OolI]|[ivxlcIVXLC1]{1,9}|(?:[ivxlc]\s){1,6}[ivxlc])[\s\p{P}\p{S}]*$")
#: Words before which a hyphen is left hanging (Hafen- und Zollbücher).
HANGING = frozenset("und oder bzw et ou and or och eller y o e i oraz lub и или".split())
#: A figure or mark among letters is a misread letter whatever the word.
AMONG = regex.compile(r"(?:(?<=\p{Ll})[0-9!|](?=\p{Ll}))")
SIGN_INSIDE = regex.compile(r"[0-9!|]")
PLAIN_LETTERS = regex.compile(r"^[\p{Latin}\p{Cyrillic}0-9!|’'-]+$")
#: Scripts without blanks between words: a line may end in a word, and no word is broken by it.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
SHORT = frozenset("a à e i o y è é и в с к о у а".split())


def key(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def words(text: str) -> list[str]:
    return [t.strip("!’'|") for t in TOKEN.findall(text.lower())]


class Lexicon:
    """Frequencies of words as tenths of log2 of the rate per PER words plus one; words are told apart by 64-bit hashes."""

    def __init__(self, keys: np.ndarray, tenths: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.tenths = keys[order].astype(np.uint64), tenths[order].astype(np.uint8)
        self.most = float(self.tenths.max(initial=0)) / 10.0
        self.find: tuple | None = None

    @classmethod
    def of(cls, rates: dict[str, float]) -> Lexicon:
        """From rates per PER words."""
        return cls(np.array([key(w) for w in rates], np.uint64), np.round(10 * np.log2(np.array(list(rates.values()), float) + 1.0)))

    def bits(self, word: str) -> float:
        if self.find is None:
            # A table of marks by the hash's low bits answers for most words that aren't there.
            mask = (1 << max(8, int(8 * len(self.keys) + 1).bit_length())) - 1
            marks = np.zeros(mask + 1, np.uint8)
            marks[(self.keys & np.uint64(mask)).astype(np.int64)] = 1
            self.find = mask, marks.tobytes(), memoryview(self.keys), self.tenths.tobytes()
        mask, marks, keys, tenths = self.find
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if not marks[h & mask]:
            return 0.0
        i = bisect_left(keys, h)
        return tenths[i] / 10.0 if i < len(keys) and keys[i] == h else 0.0

    def __eq__(self, other) -> bool:
        return np.array_equal(self.keys, other.keys) and np.array_equal(self.tenths, other.tenths)

    def __getstate__(self):
        return self.__dict__ | {"find": None}


def lexicon(df: DataFrame, text: str = "text") -> Lexicon:
    """Frequencies per PER words over all rows. Each batch counts its own words first; what reaches the driver are the words with
    a rate of LEAST or more, of which there are at most PER / LEAST, and the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            sums: Counter = Counter()
            for token, n in total.items():
                w = token.strip("!’'|")
                sums[w] += n
                head, dash, _ = w.partition("-")
                if dash:
                    sums[head + "-"] += n
            keys = np.fromiter(map(key, sums), np.uint64, len(sums)).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array([*keys.tolist(), None], pa.int64()), pa.array([*sums.values(), total.total()], pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                total.update(TOKEN.findall(t.lower()))
            if len(total) > 500_000:
                yield flush()
        if total:
            yield flush()

    sums = df.filter(F.col(text).isNotNull()).select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        total = next((r.n for r in sums.filter("word is null").collect()), 0)  # one row
        rows = sums.filter(F.col("word").isNotNull() & (F.col("n") >= LEAST * total / PER)).toArrow()
    finally:
        sums.unpersist()
    keys, n = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    return Lexicon(keys, np.minimum(255, np.round(10 * np.log2(n * (PER / max(total, 1)) + 1.0))))


#: What a token's readings say: the gain of the best one, whether it is misread, its repairs as (place, length, new text),
#: and the bits of the token as it stands.
Verdict = tuple[float, bool, tuple[tuple[int, int, str], ...], float]


class Reader:
    """Reads words by a lexicon; remembers what it read."""

    #: How many bits likelier than the word as it stands another reading must be, for each edit, and one of a word with a
    #: figure or mark inside; a whole word than either of its pieces, over a line's end, and than both, over a blank; each of
    #: two words than both run together.
    MARGIN, SIGN_MARGIN, JOIN, MERGE, SPLIT = 3.6, 0.9, 3.0, 3.0, 5.0

    def __init__(self, table: Lexicon, repair: bool = False):
        self.table, self.repair = table, repair
        self.known: dict[tuple[str, float], tuple[str | None, int, float]] = {}
        self.counts: dict[str, float] = {}
        self.most = table.most
        self.verdicts: dict[str, Verdict] = {}

    def bits(self, word: str) -> float:
        """log2 of the frequency of a word per PER words plus one."""
        v = self.counts.get(word)
        if v is None:
            if len(self.counts) > 200_000:
                self.counts.clear()
            v = self.counts[word] = self.table.bits(word)
        return v

    def verdict(self, token: str) -> Verdict:
        hit = self.verdicts.get(token)
        if hit is None:
            if len(self.verdicts) > 300_000:
                self.verdicts.clear()
            hit = self.verdicts[token] = self._verdict(token)
        return hit

    def _verdict(self, token: str) -> Verdict:
        # Marks at the ends belong to the sentence unless the word needs them.
        bare = token.strip("!|’'")
        form = token.rstrip("’'|")
        if form != bare and self.read(form, self.bits(bare.lower()) + self.MARGIN - self.SIGN_MARGIN)[0] is None:
            form = bare
        own = self.bits(form.lower())
        if not PIECE.search(form) or not PLAIN_LETTERS.match(form):
            return 0.0, False, (), own
        gain, bad, fixes = 0.0, False, []
        for p in form.split("-"):
            # A part is seen by itself and in the compound.
            better, _, more = self.read(p, math.log2(2.0 ** self.bits(p.lower()) + 2.0**own - 1.0) if "-" in form else 0.0)
            two, apart = self.split(p)
            if two is not None and apart > more:
                gain += apart
                fixes.append((token.find(p), len(p), " ".join(two)))
            elif better is not None:
                gain, bad = gain + more, True
                fixes.append((token.find(p), len(p), case_like(better, p)))
            elif AMONG.search(p) and PLAIN_LETTERS.match(p):
                bad = True
        return gain, bad, tuple(fixes), own

    def read(self, word: str, own: float = 0.0) -> tuple[str | None, int, float]:
        """A better reading of a word, where its edit lies and its gain, or (None, -1, 0). own: bits that the word has at least."""
        hit = self.known.get((word, own))
        if hit is None:
            if len(self.known) > 200_000:
                self.known.clear()
            hit = self.known[word, own] = self._read(word, own)
        return hit

    def _read(self, word: str, own: float) -> tuple[str | None, int, float]:
        low = word.lower()
        own = max(own, self.bits(low))
        if len(low) < 2:
            return None, -1, 0.0
        if sum(map(str.isalpha, low)) < max(1, len(low) // 2) or low.isdigit():
            return None, -1, 0.0
        least = own + (self.SIGN_MARGIN if SIGN_INSIDE.search(low) else self.MARGIN)
        best, at, score = None, -1, least
        if score >= self.most:
            return None, -1, 0.0
        forms = list(edits(low))
        bits = self.table.bits
        for form, i in forms:
            v = bits(form)
            if v > score:
                best, at, score = form, i, v
        if best is not None:
            return best, at, score - least
        twice = least = least + self.MARGIN
        if len(low) >= 6 and twice < self.most:
            for form, i in forms:  # the later edit second: each pair once
                for form2, _ in edits(form, i):
                    v = bits(form2)
                    if v > twice:
                        best, at, twice = form2, i, v
        return best, at, twice - least if best else 0.0

    def cut(self, left: str, right: str | None) -> float:
        """What a merged word gains against the compound with the hyphen kept; 0 or more says that the line's end cut it."""
        a, b = left.lower(), (right or "").lower()
        if right is None or not b:
            head = self.bits(a + "-")
            return self.bits(a) - head - 1.0 - 1e-9 if head > 0 else 1.0
        merged, compound = self.bits(a + b), self.bits(a + "-" + b)
        if b in HANGING and merged < self.bits(a) + 1.0:
            return -1.0
        fixed, _, more = self.read(a + b, compound)
        if fixed is not None:
            return more
        compound = max(compound, min(self.bits(a + "-"), self.bits(b)) - 2.0)
        return merged + 0.5 - compound

    def join(self, left: str, right: str) -> float:
        """What one word gains against two pieces without a hyphen over a line's end: seldom said apart by what is said of them as one."""
        a, b = left.lower(), right.lower()
        if len(a) < 2 or len(b) < 2:
            return -1.0
        gain = self.bits(a + b) - max(self.bits(a), self.bits(b)) - self.JOIN + 1e-9
        return -1.0 if gain >= 0 and UNSPACED.search(a + b) else gain

    def merge(self, left: str, right: str) -> float:
        """What one word gains against two with a blank between them."""
        a, b = left.lower(), right.lower()
        gain = self.bits(a + b) - self.bits(a) - self.bits(b) - self.MERGE
        return -1.0 if gain > 0 and (not (a + b).isalpha() or UNSPACED.search(a + b)) else gain

    def split(self, word: str) -> tuple[tuple[str, str] | None, float]:
        """Two words that were run together, and what they gain."""
        low = word.lower()
        if len(low) < 7:
            return None, 0.0
        least = self.bits(low) + self.SPLIT
        if least >= self.most:
            return None, 0.0
        best, score, bits = None, 2 * least, self.table.bits
        for i in range(2, len(low) - 1):
            a, b = low[:i], low[i:]
            if (len(a) > 2 or a in SHORT) and len(b) > 2 and (x := bits(a)) > least and (y := bits(b)) > least and x + y > score:
                best, score = (word[:i], word[i:]), x + y
        return best, score / 2 - least


def edits(word: str, start: int = 0) -> Iterator[tuple[str, int]]:
    for i in range(start, len(word)):
        for a, b in BY_SIGN.get(word[i], ()):
            if word.startswith(a, i):
                yield word[:i] + b + word[i + len(a) :], i


#: A run as it is handed on: its columns in this order. RECURS: whether lines of the book recur at its place.
UID, TEXT, EOL, SIZE, X, Y, HEIGHT, RECURS = range(8)
#: The edges of a page as shares of its height, and how near lines stand that have one place, in points.
HEAD, FOOT, NEARBY = 0.075, 0.93, 4.0


def zone(run: tuple, k: int, n: int, size: float) -> str:
    """head, foot or body of the page."""
    y, height = run[Y], run[HEIGHT]
    if y is not None and height:
        if HEAD * height <= y <= FOOT * height or not run[RECURS] and not NUMBER.match(run[TEXT]):
            return "body"
        return "head" if y < HEAD * height else "foot"
    small = run[SIZE] is not None and size and run[SIZE] <= size - 0.8
    if k <= 1 and small:
        return "head"
    if k >= n - 2 and (small or k == n - 1 and NUMBER.match(run[TEXT])):
        return "foot"
    return "body"


#: How two tokens of the stream meet: within a line, over a line's end, over a hyphen at it, or not at all.
BLANK, END, HYPHEN, APART = range(4)
MARKS = "!|’'"


class Stream:
    """A page's body without its line ends: tokens, the line each is from, and how each meets the next."""

    def __init__(self, body: list[tuple]):
        self.tokens: list[str] = []
        self.line: list[int] = []
        self.link: list[int] = []
        self.first: list[int] = []  # of each line's tokens
        self.last: list[bool] = []  # whether a run ends its line
        self.piece: dict[int, str] = {}  # what a hyphen at the line's end cuts off
        for k, r in enumerate(body):
            text = r[TEXT]
            own = TOKEN.findall(text)
            nxt = body[k + 1] if k + 1 < len(body) else None
            last = bool(r[EOL]) or nxt is None or nxt[Y] is not None and r[Y] is not None and nxt[Y] != r[Y]
            self.first.append(len(self.tokens))
            self.last.append(last)
            if not own:
                if self.link:
                    self.link[-1] = APART if self.link[-1] != HYPHEN else HYPHEN
                continue
            self.tokens += own
            self.line += [k] * len(own)
            self.link += [BLANK] * (len(own) - 1)
            ending = text.rstrip()
            piece = own[-1].rpartition("-")[2] if last and ending[-1:] in CUT and ending.endswith(own[-1], 0, -1) else ""
            if PIECE.search(piece):
                self.link.append(HYPHEN)
                self.piece[len(self.tokens) - 1] = piece
            else:
                self.link.append(END if last and ending[-1:].isalpha() else APART)
        self.first.append(len(self.tokens))


def decode(stream: Stream, reader: Reader) -> list[tuple]:
    """The arcs of the best path, from left to right: (first token, token behind it, kind, reading). Kinds: word with its
    verdict, join or cut with (the word or None if it stands, where its edit lies), pairs with whether each hyphen cuts, merge."""
    tokens, link, n = stream.tokens, stream.link, len(stream.tokens)
    known = reader.verdicts.get
    verdicts = [known(w) or reader.verdict(w) for w in tokens]
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    lines, most = stream.line, reader.most - reader.MERGE

    def relax(i: int, j: int, gain: float, kind: str, reading) -> None:
        if best[i] + gain > best[j]:
            best[j], back[j] = best[i] + gain, (i, j, kind, reading)

    for i in range(n):
        how = link[i]
        if how != HYPHEN:
            v = best[i] + verdicts[i][0]
            if v > best[i + 1]:
                best[i + 1], back[i + 1] = v, None
            if how == BLANK:
                if verdicts[i][3] + verdicts[i + 1][3] < most and (gain := reader.merge(tokens[i], tokens[i + 1])) > 0:
                    relax(i, i + 2, gain, "merge", None)
            elif how == END and i + 1 < n and lines[i + 1] == lines[i] + 1:
                if (gain := reader.join(tokens[i], tokens[i + 1])) >= 0:
                    whole = reader.read(tokens[i].strip(MARKS) + tokens[i + 1].strip(MARKS))
                    relax(i, i + 2, gain + whole[2] + 1e-6, "join", whole)
            continue
        # Pieces go on over hyphens as long as a line holds nothing else.
        pieces, j = [stream.piece[i].strip(MARKS)], i + 1
        while link[j - 1] == HYPHEN and j < n and lines[j] == lines[j - 1] + 1:
            pieces.append((stream.piece[j] if link[j] == HYPHEN else tokens[j]).strip(MARKS))
            j += 1
        rests: list[str | None] = [*pieces[1:], *[None] * (link[j - 1] == HYPHEN)]
        if len(rests) == len(pieces) - 1 and (gain := reader.cut("".join(pieces[:-1]), pieces[-1])) >= 0:
            relax(i, j, gain, "cut", reader.read("".join(pieces)))
        each = [reader.cut(x, y) for x, y in zip(pieces, rests)]
        relax(i, j, sum(max(g, 0.0) for g in each), "pairs", tuple(g >= 0 for g in each))
    path, j = [], n
    while j:
        path.append(back[j] or (j - 1, j, "word", verdicts[j - 1]))
        j = path[-1][0]
    return path[::-1]


def page(runs: list[tuple], reader: Reader) -> tuple[list[tuple[int, str]], list[dict]]:
    """Noise of a page's runs, and its repaired body lines if the reader is to repair."""
    found: list[tuple[int, str]] = []
    sizes = sorted(r[SIZE] for r in runs if r[SIZE] is not None and r[SIZE] == r[SIZE])
    size = sizes[len(sizes) // 2] if sizes else 0.0
    body = []
    for k, r in enumerate(runs):
        text = r[TEXT]
        if not text or text.isspace():
            continue
        if zone(r, k, len(runs), size) == "body":
            body.append(r)
        else:
            found.append((r[UID], "page_number" if NUMBER.match(text) else "running_head"))
    stream = Stream(body)
    line, uid = stream.line, [r[UID] for r in body]
    noisy: set[tuple[int, str]] = set()
    whole: dict[int, tuple[int, str | None]] = {}  # first token of a word over lines: token behind it, its new form
    repairs: dict[int, tuple] = {}
    for i, j, kind, reading in decode(stream, reader):
        if kind == "word":
            if reading[1]:
                noisy.add((line[i], "misread"))
            if reading[2]:
                repairs[i] = reading[2]
        elif kind == "merge":
            whole[i] = j, None
        elif kind == "pairs":
            for k, cuts in enumerate(reading, i):
                if cuts:
                    noisy.add((line[k], "broken_word"))
                    whole[k] = min(k + 2, j), None
        else:
            for k in range(i, j - 1):
                noisy.add((line[k], "broken_word"))
            better, at, _ = reading
            if better is not None:
                k = i
                while k < j - 1 and at >= len((stream.piece.get(k) or stream.tokens[k]).strip(MARKS)):
                    at -= len((stream.piece.get(k) or stream.tokens[k]).strip(MARKS))
                    k += 1
                noisy.add((line[k], "misread"))
            whole[i] = j, better
    found += [(uid[k], noise) for k, noise in noisy]
    return found, repaired(body, stream, whole, repairs, size) if reader.repair else []


def repaired(body: list[tuple], stream: Stream, whole: dict, repairs: dict, size: float) -> list[dict]:
    """The body's lines with the readings of the best path. A word that was put together stands where it began."""
    lines, gone, joined = [], set(), {k: (i, j, new) for i, (j, new) in whole.items() for k in range(i, j)}
    touched = {stream.line[t] for t in (*joined, *repairs)}
    for k, r in enumerate(body):
        text, out, at, closed = r[TEXT], [], 0, True
        for t, m in zip(range(stream.first[k], stream.first[k + 1]), TOKEN.finditer(text)) if k in touched else ():
            if t in gone:  # it went to the line where its word began
                out.append(text[at : m.start()])
                at = m.end()
            elif t in joined:
                i, j, new = joined[t]
                piece = stream.piece.get(t)
                begin = m.end() - len(piece) if piece and m.group().endswith(piece) else m.start()
                if t == i and new is not None:
                    out += [text[at:begin], case_like(new, text[begin : m.end()])]
                    at = m.end()
                    gone |= set(range(i + 1, j))
                elif t > i and stream.line[t] == stream.line[t - 1]:  # over a blank
                    out.append(text[at : m.start()].rstrip())
                    at = m.start()
                closed = t + 1 == j
                if not closed and stream.line[t + 1] == k:
                    closed = True
            else:
                for a, n, new in repairs.get(t, ()):
                    out.append(text[at : m.start() + a] + new)
                    at = m.start() + a + n
        own = stream.first[k + 1] - 1
        cut = own >= stream.first[k] and (own in joined and stream.link[own] == HYPHEN)
        fixed = ("".join(out) + text[at:]).rstrip()
        if cut:
            fixed = fixed.rstrip(CUT)
        hyphen = own >= stream.first[k] and stream.link[own] == HYPHEN
        no_blank = hyphen or not closed or NO_BLANK.match(fixed[-1:])
        last = stream.last[k]
        glue = ("" if no_blank else " ") if last else (" " if text[-1:].isspace() else "")
        lines.append({"text": fixed, "glue": glue, "x": r[X], "y": r[Y], "size": r[SIZE] or size, "last": last, "wide": len(text)})
    return lines


NO_BLANK = re.compile("[぀-ヿ㐀-鿿฀-๿]")


def case_like(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new


def ends(text: str) -> bool:
    """Whether a sentence ends at a text's end, closing marks apart."""
    return text.rstrip().rstrip("\"”’»“)]」』")[-1:] in ENDS


#: Signs that end a sentence.
ENDS = frozenset(".!?…。！？।")


def left_open(text: str) -> int:
    """Whether a text goes on behind its end: 2 surely, as no sentence ends; 1 if it does where small letters follow, as the full stop may
    be that of an abbreviation or ordinal; 0 not."""
    if not ends(text):
        return 2
    word = re.split(r"[\s(\[]+", text.rstrip())[-1].casefold()
    bare = word[:-1]
    return int(word.endswith(".") and (bare in OPEN_ENDED or bare in EITHER or "." in bare or len(bare) == 1 or bare.isdigit()))


def paragraphs(lines: list[dict]) -> list[list[dict]]:
    """Whole lines grouped into paragraphs: the boundaries with the best sum. A boundary gains from an indent, a gap wider than usual, a short line before,
    a sentence that ends and one that begins; it costs a fixed price, and a paragraph of one short line costs more."""
    whole: list[list[dict]] = []
    for piece in lines:
        if whole and not whole[-1][-1]["last"]:
            whole[-1].append(piece)
        else:
            whole.append([piece])
    n = len(whole)
    if n < 2:
        return [sum(whole, [])] if n else []
    gaps = [b[0]["y"] - a[0]["y"] if a[0]["y"] is not None and b[0]["y"] is not None else None for a, b in zip(whole, whole[1:])]
    known = sorted(g for g in gaps if g is not None and g > 0)
    usual = known[len(known) // 2] if known else 0.0
    widths = [sum(p["wide"] for p in w) for w in whole]
    full = sorted(widths)[int(0.8 * (n - 1))]
    xs = sorted(w[0]["x"] for w in whole if w[0]["x"] is not None)
    left = xs[len(xs) // 4] if xs else None
    gain = []
    for i in range(1, n):
        a, b = whole[i - 1], whole[i]
        text, nxt = "".join(p["text"] for p in a), b[0]["text"].lstrip()
        g = -2.0
        g += 1.6 if ends(text) else -2.5
        first = nxt[:1] if nxt[:1].isalnum() else next((c for c in nxt if c.isalnum()), "")
        g += -3.0 if first.islower() else 0.2
        g += 1.8 if widths[i - 1] < 0.72 * full else -0.6
        if gaps[i - 1] is not None and usual:
            g += 3.0 if gaps[i - 1] > 1.35 * usual else 0.0
        if left is not None and b[0]["x"] is not None:
            g += 2.0 if b[0]["x"] > left + 6 else 0.0
        if abs((a[0]["size"] or 0) - (b[0]["size"] or 0)) > 1:
            g += 2.0
        gain.append(g)
    # A paragraph's only cost of its own is that of one short line, so the best start before the line above is known already.
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    far, at = -math.inf, 0
    for j in range(1, n + 1):
        near = best[j - 1] + (gain[j - 2] if j > 1 else 0.0)
        alone = near - (0.7 if widths[j - 1] < 0.4 * full else 0.0)
        best[j], back[j] = (far, at) if far >= alone else (alone, j - 1)
        if near > far:
            far, at = near, j - 1
    out, j = [], n
    while j:
        out.append(sum(whole[back[j] : j], []))
        j = back[j]
    return out[::-1]


#: Up to so many books' page sizes are broadcast (some 20 MB).
FEW_BOOKS = 100_000


def pages(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs with their place and the height of the book's pages, all runs of a page together and in order.

    The key of the exchange is the page, so a book of any size spreads. Sizes, with the places near the pages' edges where
    lines recur (some tens at most), are one row for each book: up to FEW_BOOKS are broadcast, more joined by key."""
    shared_folder(runs.sparkSession)
    heights = sizes.filter(F.col("height") > 0).groupBy("book_id").agg(F.max("height").alias("height"))
    lowest = F.element_at("transform_matrix", 6)
    y = F.when(~F.isnan(lowest), lowest)
    edge = runs.select("book_id", "page_index", y.alias("y"), F.col("text").rlike(r"\S").alias("some")).filter("some and y is not null and page_index is not null").join(heights, "book_id")
    edge = edge.filter((F.col("y") < HEAD * F.col("height")) | (F.col("y") > FOOT * F.col("height")))
    near = edge.select("book_id", "page_index", F.explode(F.array(*[(F.floor(F.col("y") / NEARBY) + d).cast("int") for d in (-1, 0, 1)])).alias("at")).distinct()
    places = near.groupBy("book_id", "at").agg(F.count("*").alias("n")).filter("n > 1").groupBy("book_id").agg(F.collect_list("at").alias("places"))
    slim = runs.filter(F.col("run_uid").isNotNull()).select(
        "book_id", "page_index", "run_index", F.col("run_uid").cast("long").alias("run_uid"), "text", "has_eol", "font_size", F.element_at("transform_matrix", 5).alias("x"), y.alias("y"),
    )
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * runs.sparkSession.sparkContext.defaultParallelism)
    # Runs without a page spread by themselves; each is a page of its own.
    placed = F.when(F.col("book_id").isNull() | F.col("page_index").isNull(), F.col("run_uid"))
    recurs = F.col("places").isNull() | F.array_contains("places", F.floor(F.col("y") / NEARBY).cast("int"))
    books = heights.join(places, "book_id", "left").checkpoint()
    rows = slim.withColumn("alone", placed).join(F.broadcast(books) if books.count() <= FEW_BOOKS else books, "book_id", "left").withColumn("recurs", recurs).drop("places")
    return rows.repartition(n, "book_id", "page_index", "alone").sortWithinPartitions("book_id", "page_index", "alone", "run_index", "run_uid")


def _by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The key of each page and its runs, each once however often it was delivered."""
    key, runs = None, []
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for book, at, alone, *run in zip(*(cols[n] for n in ("book_id", "page_index", "alone", "run_uid", "text", "has_eol", "font_size", "x", "y", "height", "recurs"))):
            if (book, at, alone) != key:
                if runs:
                    yield key, runs
                key, runs = (book, at, alone), []
            if not runs or runs[-1][UID] != run[UID]:
                runs.append(run)
    if runs:
        yield key, runs


def noise(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """run_uid and noise, one row for each kind of noise of a run."""
    shared = runs.sparkSession.sparkContext.broadcast(lexicon(runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        rows: list[tuple[int, str]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["run_uid", "noise"])

        for _, runs in _by_page(batches):
            rows += page(runs, reader)[0]
            if len(rows) > 20_000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    return pages(runs, sizes).mapInArrow(run, "run_uid long, noise string").distinct()


#: Pages whose paragraphs are numbered by one task at a time.
STRIDE = 256


def book_paragraphs(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """book_id, page_index and para_index of a paragraph's first line, its repaired text and how many pages' parts it has; a run without
    book or page is a paragraph of its own, by run_uid (null for others).

    A page's first paragraph goes on from the page before if that one's last line doesn't end a sentence, or ends in an abbreviation or
    ordinal and this one begins in lower case. That is decided on one row without text for each page, in strides of STRIDE pages, of which only a row each is carried
    through a book. Text moves only for the paragraphs at a page's ends."""
    shared = runs.sparkSession.sparkContext.broadcast(lexicon(runs))
    schema = "book_id long, page_index int, alone long, para int, n int, text string, goes_on boolean, stays_open int"
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, repair=True)
        rows: list[tuple] = []
        size = 0
        for (book, at, alone), own in _by_page(batches):
            groups = paragraphs(page(own, reader)[1])
            for i, g in enumerate(groups):
                text = "".join(x["text"] + x["glue"] for x in g)
                first = next((c for c in text if c.isalnum()), "")
                rows.append((book, at, alone, i, len(groups), text, i == 0 and first.islower(), left_open(text) if i == len(groups) - 1 else 0))
                size += len(text)
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    every = pages(runs, sizes).mapInArrow(run, schema).checkpoint()
    bare = F.lit(None).cast("long").alias("run_uid")
    own_place = [F.col("para").alias("para_index"), F.trim("text").alias("paragraph"), F.lit(1).alias("n_parts")]
    ends = (F.col("para") == 0) | (F.col("para") == F.col("n") - 1)
    loose = every.filter(F.col("alone").isNotNull()).select("book_id", "page_index", *own_place, F.col("alone").alias("run_uid"))
    placed = every.filter(F.col("alone").isNull()).drop("alone")
    inner = placed.filter(~ends).select("book_id", "page_index", *own_place, bare)

    # One row for each page: whether its first paragraph may go on, whether its last stays open, and how many it has.
    sheet = placed.filter(ends).groupBy("book_id", "page_index").agg(F.bool_or("goes_on").alias("goes_on"), F.max("stays_open").alias("stays_open"), F.max("n").alias("n")).withColumn("stride", F.floor(F.col("page_index") / STRIDE))
    near = W.partitionBy("book_id", "stride").orderBy("page_index")
    along = W.partitionBy("book_id").orderBy("stride")
    last = sheet.groupBy("book_id", "stride").agg(F.max_by("stays_open", "page_index").alias("open_after"))
    before = last.select("book_id", "stride", F.lag("open_after").over(along).alias("open_before"))
    # Null where the book has no page before.
    open_before = F.coalesce(F.lag("stays_open").over(near), F.col("open_before"))
    sheet = sheet.join(before, ["book_id", "stride"]).withColumn("continues", F.coalesce((open_before == 2) | ((open_before == 1) & F.col("goes_on")), F.lit(False)))
    place = lambda para: F.struct("page_index", para.cast("int").alias("para"))
    # Where the paragraph that is last on the page began, as far as the page tells.
    top = F.when(F.col("n") > 1, place(F.col("n") - 1)).when(~F.col("continues"), place(F.lit(0)))
    sheet = sheet.withColumn("top", top)
    tops = sheet.groupBy("book_id", "stride").agg(F.max("top").alias("top"))
    carry = tops.select("book_id", "stride", F.last("top", True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    started = F.coalesce(F.last("top", True).over(near.rowsBetween(W.unboundedPreceding, -1)), F.col("carried"))
    starts = sheet.join(carry, ["book_id", "stride"]).select("book_id", "page_index", F.when(F.col("continues"), started).alias("start"))

    firsts = placed.filter("para = 0").join(starts, ["book_id", "page_index"]).withColumn("start", F.coalesce("start", place(F.col("para"))))
    lasts = placed.filter("para > 0 and para = n - 1").withColumn("start", place(F.col("para")))
    part = ["book_id", "start", "page_index", "para", "text"]
    parts = firsts.select(*part).unionByName(lasts.select(*part)).groupBy("book_id", "start").agg(F.array_sort(F.collect_list(F.struct("page_index", "para", "text"))).alias("p"))
    over = parts.select("book_id", F.col("start.page_index").alias("page_index"), F.col("start.para").alias("para_index"), F.trim(F.array_join("p.text", "")).alias("paragraph"), F.size("p").alias("n_parts"), bare)
    return over.unionByName(inner).unionByName(loose)
