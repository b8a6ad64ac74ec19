"""Sentences of texts in any language and script.

A semi-Markov model: candidates are the places after sentence marks (with their closing marks), blank lines, line
ends and, in scripts that part sentences by blanks, blanks. Dynamic programming picks the sequence of whole spans with the best
sum; a span is scored by its length, the word it opens with, the word it closes with, and whether its quotations and
parentheses are balanced, including speech that a dash opens. Speech stays with the words that report it.

Null, empty and blank texts have no sentence. Text without any mark is one sentence. A heading is one unit.
Offsets count code points, from the first to after the last character that is no white space. The sum
is the best over all starts: those up to REACH candidates back are scored at once, others only if what their length costs leaves them a chance.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows, spread

REACH = 24
#: A blank line ends a sentence inside a quotation of so many characters or more; how far ahead speech that a dash opens is first looked for its
#: end (then to the paragraph's end); how much text before a full stop is read for the word it closes. Parameters.
LONG_QUOTE, NEAR_SPEECH, WORD_BACK = 600, 400, 40
#: Abbreviations after which the sentence goes on, mostly titles and labels of a number or name.
OPEN_ENDED = frozenset(
    """dr dra drs mr mrs ms st ste sr sra srta prof hr hrn fr frl m mm mme mlle me mgr sig sigg dott dott.ssa avv ing don
    rev capt col gen lt sgt hon gov sen rep pres messrs gebr bros p pp pag pág págs pagg s ss vol vols bd bde fig figs abb tab taf
    nr no núm num n ch chap cap kap sec § art ed. cf cfr vgl vid por zob см ср напр рис табл стр с т тт гл разд ул пл пер просп г-н г-жа
    проф акад им д-р inż mgr dyr ks płk kpt tel tlf approx ca env aprox ok ок ung vs v e.g i.e z.b d.h u.a bl.a t.ex np tzn tj d.v.s
    डॉ श्री श्रीमती पृ खं क्र सं د أ م ص ج ف रु विं นาย นาง ดร t lib par av bv resp inkl exkl zzgl ggf mind max min int ext dept fa fam""".split()
)
#: Abbreviations that are as likely to close a sentence as not.
EITHER = frozenset("etc usw osv ecc itp itd пр др a.m p.m m.m jr sen т.д т.п е.д الخ إلخ u.k u.s co inc ltd cie ag bzw".split())
#: German words before an ordinal, and month names behind one.
ORDINAL_AFTER = frozenset("am der dem den im vom zum zur bis ab des die das".split())
MONTH = re.compile("(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)[a-zä]*\\b")
CLOSERS = "\"'”’»›)]}」』）】〉》“‘«"
MARK = re.compile(r"(?:[.!?…؟۔।॥]+|[。！？．｡]+)[\"”’»›)\]}」』）】〉》“«]*(?:(?<=[.!?…])\s?[»”](?=\s|[.,]|$))?[.]?")
BLANK = re.compile(r"\s+")
#: Blanks that hold more than spaces.
BROKEN = re.compile(r"(?<!\s) *[^\S ]\s*")
DASHES = "–—―‒-"
#: Quotation marks: what closes what.
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "”": "”", '"': '"', "(": ")", "（": "）", "[": "]", "《": "》", "‹": "›"}
THAI = re.compile("[฀-๿຀-໿ក-៿က-႟]")
CJK = re.compile("[぀-ヿ㐀-鿿가-힯ｦ-ﾟ]")


def caseless(ch: str) -> bool:
    return unicodedata.category(ch) == "Lo"


def first_sign(text: str, at: int) -> str:
    """The first character from here that is neither blank nor without width nor an opening mark."""
    n = len(text)
    while at < n and (text[at].isspace() or unicodedata.category(text[at]) in ("Cf", "Mn", "Pi", "Ps", "So", "Sk") or text[at] in "\"'¿¡«»„“”‚*_•"):
        at += 1
    return text[at] if at < n else ""


def quotations(text: str) -> list[tuple[int, int, str]]:
    """Start, end and opening sign of each closed quotation or parenthesis; of those cut off at the ends of an excerpt too."""
    found: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int]] = []
    cut_left, cut_right = text.startswith(("...", "…")), text.rstrip().endswith(("...", "…"))
    n = len(text)
    for m in QUOTE.finditer(text):
        i, ch = m.start(), m.group()
        before = text[i - 1] if i else " "
        after = text[i + 1] if i + 1 < n else " "
        hit = next((k for k in range(len(stack) - 1, -1, -1) if ch in PAIRS.get(stack[k][0], "")), -1)
        if hit >= 0:
            sign, start = stack[hit]
            del stack[hit:]
            found.append((start, i + 1, sign))
        elif ch in "“„«「『(（[《‹" or ch in "»”\"" and (before.isspace() or before in "(:—–" or not i or CJK.match(before)) and not after.isspace():
            stack.append((ch, i))
        elif cut_left and not found and not stack and i and ch in "”»」』)）":
            found.append((0, i + 1, ch))
    if cut_right and stack:
        found.append((stack[0][1], n, stack[0][0]))
    for m in SPEECH.finditer(text):
        # Speech that a dash opens ends at the dash, or else at the comma, before the words that report it.
        # The near ones first: a dash further on in the paragraph may open other speech.
        blank = GAP.search(text, m.end())
        stop = blank.start() if blank else n
        near = min(stop, m.start() + NEAR_SPEECH)
        end = SHUT.search(text, m.end(), near) or REPORT.search(text, m.end(), near) or SHUT.search(text, m.end(), stop) or REPORT.search(text, m.end(), stop)
        if end:
            found.append((m.start(), end.start() + 1, "—"))
    return found


SPEECH = regex.compile(r"(?:(?<=^\s*)|(?<=[.!?…”»\"]\s+)|(?<=\n))[–—―]\s?[¿¡«“\"]?\p{Lu}")
SHUT = regex.compile(r"[–—―]\s?\p{Ll}")
REPORT = regex.compile(r",\s\p{Ll}+\s")
GAP = regex.compile(r"\n\n|\r\n\r")


QUOTE = re.compile("[“”„«»「」『』\"()（）\\[\\]《》‹›]")


def candidates(text: str) -> list[tuple[int, float]]:
    """Where a span may end, and what speaks for an end there by the mark alone. The last is the text's end."""
    n, out = len(text), {}
    for m in MARK.finditer(text):
        end, marks = m.end(), m.group()
        while marks[-1] in "“«" and end < n and not text[end].isspace() and text[end].isalnum():
            end, marks = end - 1, marks[:-1]  # it opens what follows
        nxt = text[end] if end < n else " "
        full = marks[0] in "。！？｡．"
        if not nxt.isspace() and not full and not (marks[0] in "।॥؟۔" or (marks[-1] in CLOSERS and CJK.match(nxt))):
            if not (CJK.match(nxt) and marks[0] in "!?"):
                continue
        if marks.strip("…") == "" or marks.startswith("..") or marks[0] == "…":
            score = 0.5
        elif marks[0] == ".":
            score = 3.0
        else:
            score = 4.0
        if marks[0] == "．" and (nxt.isdigit() or not CJK.match(nxt)):
            continue
        out[end] = score
    thai = THAI.search(text) is not None
    for m in (BLANK if thai else BROKEN).finditer(text):
        a, b = m.span()
        if a == 0 or b == n or a in out:
            if a in out and "\n\n" in m.group():
                out[a] += 4.0
            continue
        blank = m.group()
        if blank.count("\n") > 1 or "\u2029" in blank:
            out[a] = 4.0
        elif thai and (THAI.match(text[a - 1]) or THAI.match(first_sign(text, b) or " ")):
            sign = first_sign(text, b)
            if THAI.match(text[a - 1]) and sign and not THAI.match(sign) and (sign.isupper() or caseless(sign)):
                out[a] = 2.0  # another script goes on
            elif THAI.match(first_sign(text, b) or " ") and (THAI.match(text[a - 1]) or text[a - 1].isdigit() or text[a - 1] in "”\"’).%"):
                out[a] = 3.0
    out.pop(n, None)
    return [*sorted(out.items()), (n, 0.0)]


def closing(text: str, end: int, nxt: str) -> float:
    """What the word before a full stop says against an end here."""
    body = text[max(0, end - WORD_BACK) : end].rstrip(CLOSERS + " ")
    if not body.endswith(".") or body.endswith(".."):
        return 0.0
    word = re.split(r"[\s(\[«“„\"—–/  ’']+", body[:-1])[-1].casefold()
    prev = body[: len(body) - 1 - len(word)].rstrip()
    if not word:
        return 0.0
    if text[end - 1] != ".":  # closing marks stand behind the stop
        return 0.0
    if word in EITHER:
        return 0.0 if not nxt.isdigit() else -4.0
    if word in OPEN_ENDED:
        return -9.0
    if word.isdigit() and len(word) <= 2:
        # An ordinal before a month or a noun.
        before = re.split(r"\s+", prev)[-1].casefold() if prev else ""
        return -8.0 if before in ORDINAL_AFTER or MONTH.match(text[end:].lstrip()) else 0.0
    letters = [c for c in word if c.isalpha()]
    if len(letters) == 1 and len(word) <= 2:
        # One letter: an initial or part of a chain (z. B., т. е.); a chain's last part may close.
        if prev.endswith(".") and word in "дпe" and nxt.isupper():
            return 0.0
        return -8.0
    if "." in word and len(word) <= 6:
        return -5.0 if not nxt.isupper() else 0.0
    if nxt.isdigit() and len(word) <= 6:
        return -3.0
    return 0.0


def opening(text: str, at: int) -> float:
    """What the first word after a cut says."""
    rest = text[at : at + 12].lstrip()
    nxt = first_sign(text, at)
    if not rest:
        return 0.0
    if rest[0] in DASHES and len(rest) > 1:
        tail = first_sign(text, at + text[at : at + 12].find(rest[0]) + 1)
        return -9.0 if tail.islower() else 0.5
    if rest[0] in ",;:)]}»”’،、，；：）」』" and not (rest[0] in "»”" and len(rest) > 1 and rest[1].isalpha()):
        return -9.0
    if nxt.islower():
        return -9.0
    if nxt.isdigit():
        return -1.0
    return 0.5 if nxt else -6.0


SOLID = re.compile(r"[^\W_]")
SPEECH_SHUT = re.compile(r"[,!?…]?\s[–—―]\s?[^\W\d_]")
SPEECH_TOLD = re.compile(r",\s+[^\W\d_A-ZÅÄÖ]\w+[^,]*$")


def sentences(text: str | None, kind: str | None = None) -> list[tuple[int, int]]:
    """Start and end of each sentence."""
    if not text or not text.strip():
        return []
    if kind == "heading":
        a = len(text) - len(text.lstrip())
        return [(a, len(text.rstrip()))]
    cand = candidates(text)
    ends = [c[0] for c in cand]
    quotes = quotations(text)
    # Quotations around each candidate, short and long ones, as running sums; and those that end at a place.
    around, closed = [[0] * (len(ends) + 1) for _ in range(2)], {}
    for a, b, sign in quotes:
        lo, hi = bisect_right(ends, a), bisect_left(ends, b)
        if lo < hi:
            around[b - a >= LONG_QUOTE][lo] += 1
            around[b - a >= LONG_QUOTE][hi] -= 1
        closed.setdefault(b, []).append(sign)
    short, long = (list(accumulate(x)) for x in around)
    # Local scores of ending at each candidate.
    local = []
    for k, (end, score) in enumerate(cand[:-1]):
        nxt = first_sign(text, end)
        s = score + closing(text, end, nxt) + opening(text, end) - 14.0 * short[k]
        if long[k]:
            s -= long[k] * (2.0 if text[end : end + 4].startswith(("\n\n", "\r\n\r")) else 14.0)
        for b in (end, end - 1):
            if b in closed and (b == end or text[b] in ".。"):
                for sign in closed[b]:
                    if sign in "(（[":
                        if end == b and not MARK.match(text[b - 2 : b]) and text[b - 2] not in ".!?。！？…":
                            s -= 6.0
                    elif text[end : end + 1] in ("と", "っ"):
                        s -= 12.0
        local.append(s)
    local.append(0.0)
    n = len(ends)
    best, back = [-math.inf] * n, [0] * n
    starts = [0, *ends]
    speech_at = {a: (b, sign) for a, b, sign in quotes}

    firsts = []  # of each start, without blanks
    for a in starts:
        while a < len(text) and text[a].isspace():
            a += 1
        firsts.append(a)

    def span(i: int, j: int) -> float:
        """Joint score of the text between starts[i] and ends[j]."""
        a, b = firsts[i], ends[j]
        if a >= b:
            return -20.0
        s = -0.12 * math.log((b - a) / 70.0) ** 2
        if not text[a].isalnum() and not SOLID.search(text, a, b):
            s -= 8.0
        rest = text[b : b + 1]
        if a in speech_at and speech_at[a][1] not in "(（[":
            close = speech_at[a][0]
            # Speech at the opening whose end is the span's end: words that report it may follow.
            if close == b and j < n - 1 and rest and not rest.isspace() and caseless(rest):
                s -= 8.0
        if text[a] in "–—―" and j < n - 1:
            inner = text[a + 1 : b]
            if not SPEECH_SHUT.search(inner) and not SPEECH_TOLD.search(inner) and "\n" not in text[b : b + 2]:
                s -= 7.0
        return s

    priors, top = np.zeros(n + 1), [0.0]
    bodies = np.array(firsts)
    seen = np.cumsum([False, *map(str.isalnum, text)]) if n > REACH + 1 else None

    def far(j: int) -> list[int]:
        """Starts more than REACH back that may give a better score. A span scores what its length, and signs alone, cost at best."""
        k = j - REACH
        size = ends[j] - firsts[k - 1]
        if size >= 70 and top[k - 1] + local[j] - 0.12 * math.log(size / 70.0) ** 2 <= best[j]:
            return []
        sizes = np.maximum(ends[j] - bodies[:k], 1)
        bare = seen[bodies[:k]] >= seen[ends[j]]
        return np.flatnonzero(priors[:k] + local[j] - 0.12 * np.log(sizes / 70.0) ** 2 - 8.0 * bare > best[j]).tolist()

    for j in range(n):
        for near in (True, False):
            for i in range(max(0, j - REACH), j + 1) if near else far(j) if j > REACH else ():
                prior = 0.0 if i == 0 else best[i - 1]
                if prior == -math.inf:
                    continue
                v = prior + span(i, j) + local[j]
                if v > best[j]:
                    best[j], back[j] = v, i
        priors[j + 1] = best[j]
        top.append(max(top[-1], best[j]))
    out, j = [], n - 1
    while j >= 0:
        i = back[j]
        a, b = starts[i], ends[j]
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        j = i - 1
    return out[::-1]


def sentence_units(df: DataFrame, src: str, key: str, text: str, kind: str | None = None) -> DataFrame:
    """src, row_id, sent_start, sent_end. Each text is cut where it lies; nothing is shuffled."""
    from pyspark.sql import functions as F

    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("row_id"), text, (F.col(kind) if kind else F.lit(None).cast("string")).alias("kind"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, own, a, b = batch.column(0).to_pylist(), [], [], []
        for i, t, k in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for x, y in sentences(t, k):
                own.append(i), a.append(x), b.append(y)
        cols = [pa.array([src] * len(own), pa.string()), *(pa.array(x, pa.int64()) for x in (own, a, b))]
        return pa.RecordBatch.from_arrays(cols, names=["src", "row_id", "sent_start", "sent_end"])

    return map_rows(spread(rows), "src string, row_id long, sent_start long, sent_end long", text, kernel)
