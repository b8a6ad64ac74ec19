"""One consistent form for text that looks the same.

A text holds units that may change: a character that has another form, or one with the marks and joining characters behind it.
No unit acts on its neighbours, so each distinct unit of the corpus is worked out once: it is exploded to positioned code points;
a broadcast join brings each one's decomposition, its combining class
and its look-alike; marks are ordered by class behind their base; the unit is rebuilt and recomposed. Units that come out changed are put back
into the texts that hold them; the others, and all between them, stay.
Full-width and half-width forms, presentation forms, ligatures, radicals, zero-width characters, blanks of any width
and look-alike letters of Greek and Cyrillic come to one form. Letter case, accents, raised signs, words and line breaks stay.

Null stays null; a blank text becomes the empty string.
Repeated rows keep their results; rows are told apart by a given key, whose repetitions must carry the same text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .common import shared_folder

#: Letters of Cyrillic and Greek that look like the Latin letter beside them.
CYRILLIC = {"а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y"}
GREEK = {"ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "α": "a", "κ": "k", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
SIGNS = {"‐": "-", "‑": "-", "ʼ": "’", "ı": "i", "ɡ": "g", "ɑ": "a", "⁄": "/", "∕": "/", "µ": "μ"}
#: Decomposition tags under which both sides read the same; raised, circled and squared signs don't.
SAME = {"<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>"}


@cache
def mapping() -> list[tuple[str, str, int]]:
    """Each code point that the form changes or that combines: itself, its replacement, its own class."""
    looks = CYRILLIC | GREEK | SIGNS

    def full(ch: str) -> str:
        if ch in "\n\x85\x0b\x0c\u2028\u2029":
            return "\n"
        if ch == "\r":
            return ch
        cat = unicodedata.category(ch)
        if cat == "Zs" or ch in "\t\u2800\u3164\uffa0":
            return " "
        if cat == "Cf" and not "\u0600" <= ch <= "\u0605" and ch != "\u06dd" or ch in "\u034f\u115f\u1160\u17b4\u17b5" or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
            return ""
        if cat == "Cc":
            return ""
        raw = unicodedata.decomposition(ch)
        tag, _, rest = raw.partition(" ") if raw.startswith("<") else ("", "", raw)
        if raw and (not tag or tag in SAME or tag == "<compat>" and (cat[0] in "LS" and (cat[0] == "L" or "⺀" <= ch <= "⿟"))):
            return "".join(full(chr(int(x, 16))) for x in rest.split())
        if "가" <= ch <= "힣":
            return unicodedata.normalize("NFD", ch)
        return looks.get(ch, ch)

    out = []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0xE000 <= cp < 0xF900 or 0x3400 <= cp < 0xA000 or cp >= 0x20000 and not 0x2F800 <= cp < 0x2FA20 and cp < 0xE0000 or 0xE01F0 <= cp:
            continue
        ch = chr(cp)
        new, ccc = full(ch), unicodedata.combining(ch)
        if new != ch or ccc:
            out.append((ch, new, ccc))
    return out


#: Characters of class 0 that compose with one before them, besides those that mapping() leads to.
BEHIND = {0x0BBE, 0x0BD7, 0x09BE, 0x09D7, 0x0B3E, 0x0B57, 0x0CC2, 0x0CD5, 0x0CD6, 0x0D3E, 0x0D57, 0x0DCF, 0x0DDF, 0x102E, *range(0x1160, 0x1200)}


class Units:
    """Finds the units of texts and puts in other forms, over a mapping.

    Characters go on if they belong to what stands before them: marks, what vanishes, and what composes backwards. A unit is a
    character with those that go on behind it, or a single one that has another form."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        going = {ord(ch) for ch, new, ccc in rows if ccc or not new or unicodedata.combining(new[0]) or ord(new[0]) in BEHIND} | BEHIND
        # Characters beyond the basic plane make a class slow; it is used only for texts that hold some.
        self.near, self.wide = (self.spelled(sorted(cp for cp in going if cp <= top)) for top in (0xFFFF, 0x10FFFF))
        self.single = frozenset(ch for ch, new, _ in rows if ord(ch) not in going and unicodedata.normalize("NFC", new) != ch)

    @staticmethod
    def spelled(cps: list[int]) -> str:
        run: list[list[int]] = []
        for cp in cps:
            if run and cp == run[-1][1] + 1:
                run[-1][1] = cp
            else:
                run.append([cp, cp])
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in run) + "]+"

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where characters that go on stand, with the one before them."""
        if text.isascii():
            return []
        out, end = [], 0
        for m in re.compile(self.near if max(text) <= "\uffff" else self.wide).finditer(text):
            a, b = m.span()
            out.append((a - 1 if a > end else a, b))
            end = b
        return out

    def find(self, text: str) -> set[str]:
        return self.single.intersection(text).union(text[a:b] for a, b in self.spans(text))

    def replace(self, text: str, forms: dict[str, str]) -> str:
        """The text with other forms in place of units. Longer units come first: what they become holds no unit that changes."""
        out, at = [], 0
        for a, b in self.spans(text):
            if (new := forms.get(text[a:b])) is not None:
                out += [text[at:a], new]
                at = b
        text = "".join(out) + text[at:] if out else text
        for ch in self.single.intersection(text):
            if ch in forms:
                text = text.replace(ch, forms[ch])
        return text


@F.pandas_udf(T.StringType())
def recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


BLANKS = re.compile(" {2,}")


def tidy(text: str) -> str:
    """Runs of blanks become one blank; none stays at the ends of a line; line ends are of one kind."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "  " in text:
        text = BLANKS.sub(" ", text)
    return "\n".join(line.strip(" ") for line in text.split("\n"))


#: Up to so many changed units (a few MB) are broadcast; more are joined by key.
SMALL = 200_000


def unit_forms(units: DataFrame, rows: list[tuple[str, str, int]]) -> DataFrame:
    """unit and new of each of some distinct units that changes. Units stay where distinct() put them."""
    spark: SparkSession = units.sparkSession
    table = F.broadcast(spark.createDataFrame([(c, n) for c, n, _ in rows], "ch string, new string"))  # fixed by Unicode
    classes = F.broadcast(spark.createDataFrame([(c, k) for c, _, k in rows if k], "part string, ccc int"))
    points = units.select("unit", F.posexplode(F.split("unit", "")).alias("pos", "ch"))
    mapped = points.join(table, "ch", "left").select("unit", "pos", F.coalesce("new", "ch").alias("new"))
    parts = mapped.select("unit", "pos", F.posexplode(F.split("new", "")).alias("sub", "part"))
    parts = parts.join(classes, "part", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    order = W.partitionBy("unit").orderBy("pos", "sub").rowsBetween(W.unboundedPreceding, 0)
    # A part that is mapped to nothing stays as an empty string: it separates no marks, and a unit of such parts isn't lost.
    parts = parts.withColumn("base", F.count(F.when((F.col("ccc") == 0) & (F.col("part") != ""), 1)).over(order))
    built = parts.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("base", "ccc", "pos", "sub", "part"))).alias("_p"))
    return built.select("unit", recompose(F.array_join(F.col("_p.part"), "")).alias("new")).filter("new <> unit")


def canonical(df: DataFrame, key: list[str], text: str, out: str = "canonical") -> DataFrame:
    """The key and the consistent form of each row. Texts are read twice where they lie: for their units, and to put in the forms of those that change. Up to SMALL
    of these forms are broadcast and no text moves; more are brought to their texts by key."""
    shared_folder(df.sparkSession)
    rows = mapping()
    units = Units(rows)

    @F.pandas_udf("array<string>")
    def units_of(s: pd.Series) -> pd.Series:
        return s.map(lambda t: list(units.find(t)) if t else [])

    base = df.select(*key, F.col(text).alias("_t"))
    forms = unit_forms(base.select(F.explode(units_of("_t")).alias("unit")).distinct(), rows).checkpoint()
    if forms.count() <= SMALL:
        shared = df.sparkSession.sparkContext.broadcast({r.unit: r.new for r in forms.collect()})  # counted just now

        @F.pandas_udf("string")
        def rebuilt(s: pd.Series) -> pd.Series:
            forms = shared.value
            return s.map(lambda t: tidy(units.replace(t, forms)), na_action="ignore")

        return base.select(*key, rebuilt("_t").alias(out))

    @F.pandas_udf("string")
    def rebuilt_by(s: pd.Series, maps: pd.Series) -> pd.Series:
        def one(t, pairs):
            return None if t is None else tidy(units.replace(t, dict(pairs)) if pairs is not None and len(pairs) else t)

        return pd.Series([one(t, m) for t, m in zip(s, maps)], dtype=object)

    hashed = base.withColumn("_h", F.md5("_t"))
    held = hashed.select("_h", F.explode(units_of("_t")).alias("unit"))
    maps = held.join(forms, "unit").groupBy("_h").agg(F.map_from_entries(F.collect_set(F.struct("unit", "new"))).alias("_m"))
    return hashed.join(maps, "_h", "left").select(*key, rebuilt_by("_t", "_m").alias(out))


def alike_classes(df: DataFrame, key: str, group: list[str], text: str) -> tuple[DataFrame, list[str]]:
    """_k, the group's columns, own and form of each row with a text that isn't blank: digests of its own characters and of its form. And the names of the group's columns."""
    names = [f"_g{i}" for i in range(len(group))]
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("_k"), *[F.col(g).alias(n) for g, n in zip(group, names)], F.md5(text).alias("own"), F.col(text).alias("_x"))
    forms = canonical(rows, ["_k", *names, "own"], "_x").filter("canonical <> ''").select("_k", *names, "own", F.md5("canonical").alias("form"))
    return forms.distinct(), names


def alike_pairs(df: DataFrame, key: str, group: str | list[str], text: str) -> DataFrame:
    """id_a < id_b within a group whose texts come to one form but hold different characters, with the group's columns if there are several. Blank texts are no case.

    Different texts of one form meet first, each once however many rows hold it; the rows are put to them by group, form and text, so
    that a form that many rows share spreads over its texts."""
    several_groups = not isinstance(group, str)
    group = list(group) if several_groups else [group]
    # Digests and ids only, read several times below: written once to the shared folder.
    hashed, g = alike_classes(df, key, group, text)
    hashed = hashed.checkpoint()
    texts = hashed.select(*g, "form", "own").distinct()
    several = texts.groupBy(*g, "form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi").select(*g, "form")
    few = texts.join(several, [*g, "form"])
    pairs = few.select(*g, "form", F.col("own").alias("own_a")).join(few.select(*g, "form", F.col("own").alias("own_b")), [*g, "form"]).filter("own_a < own_b")
    a, b = (hashed.select(*g, "form", F.col("own").alias(f"own_{x}"), F.col("_k").alias(f"k_{x}")) for x in "ab")
    both = pairs.join(a, [*g, "form", "own_a"]).join(b, [*g, "form", "own_b"]).filter("k_a <> k_b")
    named = [F.col(n).alias(c) for n, c in zip(g, group)] if several_groups else []
    return both.select(*named, F.least("k_a", "k_b").alias("id_a"), F.greatest("k_a", "k_b").alias("id_b")).distinct()


def alike_report(df: DataFrame, key: str, group: str | list[str], text: str) -> DataFrame:
    """Of each row whose form is shared by different texts: its class (the least key with the form in its group), and how many
    different texts and rows the class has."""
    group = [group] if isinstance(group, str) else list(group)
    hashed, g = alike_classes(df, key, group, text)
    hashed = hashed.checkpoint()
    classes = hashed.groupBy(*g, "form").agg(F.min("_k").alias("class_id"), F.countDistinct("own").alias("n_texts"), F.countDistinct("_k").alias("n_rows")).filter("n_texts > 1")
    return hashed.join(classes, [*g, "form"]).select(F.col("_k").alias(key), *[F.col(n).alias(c) for n, c in zip(g, group)], "class_id", "n_texts", "n_rows").distinct()
