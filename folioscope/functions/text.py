"""Column functions over text. All run inside the engine; none is a UDF.

Offsets and lengths count code points. White space is the set that ECMAScript calls white space, given explicitly,
because the engines' own classes differ."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of ECMAScript.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Named entities and their order; the ampersand comes first, so that &amp;lt; becomes <.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def normalize_whitespace(s: Column) -> Column:
    """Runs of ASCII white space become one blank, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"[\t\n\f\r ]+", " "))


def normalize_readable(s: Column) -> Column:
    """As above over all white space."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), SPACE + "+", " "))


def escape_html(s: Column) -> Column:
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_html(s: Column) -> Column:
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def strip_markup(html: Column) -> Column:
    """Tags become blanks; entities stay as they are."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " ")
    return normalize_readable(F.regexp_replace(s, r"<[^>]*>", " "))


def readable_text(html: Column) -> Column:
    """Readable text of a piece of HTML: scripts and styles go, tags become blanks, six entities are decoded in order."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " ")
    return normalize_readable(unescape_html(F.regexp_replace(s, r"<[^>]*>", " ")))


def export_text(html: Column) -> Column:
    """Text for a plain-text file: ends of blocks become line ends, unknown entities blanks, three line ends two."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", "")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, r"(?i)</(?:p|div|h[1-6]|li|tr|section|article|blockquote)\s*>", "\n")
    s = unescape_html(F.regexp_replace(s, r"<[^>]*>", ""))
    s = F.regexp_replace(s, r"&[A-Za-z]+;", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def quote(literal: str) -> str:
    """A regular expression for exactly this text."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", literal)


def roman(n: Column) -> Column:
    """Roman numeral of 1..3999; null beyond."""
    digits = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"]]
    part = lambda k: F.element_at(F.array(*map(F.lit, digits[k])), (F.floor(n / 10**k) % 10).cast("int") + 1)
    return F.when((n >= 1) & (n <= 3999), F.concat(part(3), part(2), part(1), part(0)))


def text_units(s: Column) -> Column:
    """Reading weight of a text: a blank .25, an ideograph 1, an ASCII letter or figure .55, any other sign .5."""
    s = F.coalesce(s, F.lit(""))
    size = F.length(s)
    left = lambda pattern: F.length(F.regexp_replace(s, pattern, ""))
    blanks, cjk, ascii_ = size - left(SPACE), size - left(CJK), size - left("[A-Za-z0-9]")
    return blanks * 0.25 + cjk * 1.0 + ascii_ * 0.55 + (size - blanks - cjk - ascii_) * 0.5


def estimated_width(s: Column, font_size: float = 1.0) -> Column:
    """Width of a line of text without a measuring canvas: a blank .32, a Han sign 1, any other .54 of the type size."""
    size = F.length(s)
    blanks = size - F.length(F.regexp_replace(s, SPACE, ""))
    han = size - F.length(F.regexp_replace(s, r"[\x{4E00}-\x{9FFF}]", ""))
    return (blanks * 0.32 + han * 1.0 + (size - blanks - han) * 0.54) * font_size


def wrapped_lines(s: Column, width: float) -> Column:
    """Lines a text takes when its words are put one after the other as long as they fit, by estimated widths at a type size of 1. A
    word wider than a line begins a line of its own and runs over as many as it needs. Widths are kept to six decimals."""
    words = F.filter(F.split(F.regexp_replace(s, SPACE + "+", " "), " "), lambda x: x != "")
    w = F.lit(float(width))
    sized = F.transform(words, lambda x: F.round(estimated_width(x).cast("double"), 6))

    def step(acc, size):
        joined = F.when(acc["filled"] == 0, size).otherwise(F.round(acc["filled"] + 0.32 + size, 6))
        rest = F.round(size - w * F.floor(size / w), 6)
        over = F.struct((acc["lines"] + F.when(acc["filled"] > 0, 1).otherwise(0) + F.ceil(size / w).cast("int") - 1).alias("lines"), F.when(rest == 0, w).otherwise(rest).alias("filled"))
        fits = F.struct(acc["lines"].alias("lines"), joined.alias("filled"))
        new = F.struct((acc["lines"] + 1).alias("lines"), size.alias("filled"))
        return F.when(size > w, over).when(joined <= w, fits).otherwise(new)

    return F.aggregate(sized, F.struct(F.lit(1).alias("lines"), F.lit(0.0).alias("filled")), step)["lines"]


def path_of(href: Column) -> Column:
    """Path of a reference: trimmed, without fragment, with forward slashes, without dot segments."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(href), "#.*$", ""), r"\\", "/")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((x == ".") | (x == ""), acc).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(plain, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def clamp01(x: Column) -> Column:
    """Between 0 and 1; 0 for what is no number."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(0.0)).otherwise(F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))


def byte_length(s: Column) -> Column:
    """Length in UTF-8."""
    return F.coalesce(F.octet_length(s), F.lit(0))


def unescape_all(s: Column) -> Column:
    """The named entities in their order, then decimal and hexadecimal ones; numbers that name no character stay."""
    s = unescape_html(s)

    def one(acc: Column, e: Column) -> Column:
        digits = F.regexp_extract(e, "(?i)^&#(x?)([0-9a-f]+);$", 2)
        n = F.conv(digits, 16, 10).cast("long")
        n = F.when(F.regexp_extract(e, "(?i)^&#(x?)", 1) != "", n).otherwise(digits.cast("long"))
        ok = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        # UTF-16: one unit, or two for what lies beyond the basic plane.
        rest = n - 0x10000
        units = F.when(n < 0x10000, F.lpad(F.hex(n), 4, "0")).otherwise(F.concat(F.hex(F.lit(0xD800) + F.floor(rest / 0x400)), F.hex(F.lit(0xDC00) + rest % 0x400)))
        return F.when(ok, F.replace(acc, e, F.decode(F.unhex(units), "UTF-16BE"))).otherwise(acc)

    found = F.array_distinct(F.regexp_extract_all(s, F.lit("(?i)(&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});)"), F.lit(1)))
    return F.aggregate(found, s, one)


def css_escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([^\w-])", r"\\$1")


def regex_escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([-/\\^$*+?.()|\[\]{}])", r"\\$1")


#: Extensions and types of images.
IMAGE_TYPES = ((".jpg", "image/jpeg"), (".png", "image/png"), (".gif", "image/gif"), (".webp", "image/webp"), (".svg", "image/svg+xml"), (".avif", "image/avif"), (".bmp", "image/bmp"))


def extension_of(path: Column) -> Column:
    """Lower-case extension of an image path without query and fragment; null for others."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"(?i)\.(jpe?g|png|gif|webp|svg|avif|bmp)$", 1))
    return F.when(ext != "", F.concat(F.lit("."), F.when(ext == "jpeg", "jpg").otherwise(ext)))


def mime_of(path: Column) -> Column:
    ext, out = extension_of(path), F.lit("application/octet-stream")
    for e, m in IMAGE_TYPES:
        out = F.when(ext == e, m).otherwise(out)
    return out


def extension_for(mime: Column, path: Column) -> Column:
    """Extension for a type, or else the path's, or .bin."""
    out = F.coalesce(extension_of(path), F.lit(".bin"))
    for e, m in IMAGE_TYPES[:-1]:
        out = F.when(mime == m, e).otherwise(out)
    return out


def is_external(url: Column) -> Column:
    """Whether a reference names a scheme other than blob, or a host."""
    return F.coalesce(url.rlike(r"(?i)^(?!blob)\w+:") | url.startswith("//"), F.lit(False))


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def data_bytes(uri: Column) -> Column:
    """Bytes of a base64 data URI; null for others."""
    return F.when(uri.rlike(r"(?is)^data:[^,]*;base64,"), F.unbase64(F.regexp_replace(F.regexp_replace(uri, r"(?is)^data:[^,]*,", ""), r"\s", "")))


def identifier(title: Column, at: Column) -> Column:
    """An identifier of a title and a point of time, which the caller gives, so that it is the same in every run."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit("book"))), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.concat(F.lit("urn:book:"), slug, F.lit(":"), F.unix_millis(at).cast("string"))


def affine(a: Column, b: Column) -> Column:
    """The matrix that applies a after b; both arrays of six numbers, columns first."""
    x, y = (lambda k: a[k]), (lambda k: b[k])
    return F.array(
        x(0) * y(0) + x(2) * y(1), x(1) * y(0) + x(3) * y(1), x(0) * y(2) + x(2) * y(3), x(1) * y(2) + x(3) * y(3),
        x(0) * y(4) + x(2) * y(5) + x(4), x(1) * y(4) + x(3) * y(5) + x(5),
    )


def moved(m: Column, x: Column, y: Column) -> Column:
    """A point after a matrix."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def bounds(m: Column, width: Column, height: Column) -> Column:
    """Least rectangle around a transformed rectangle at the origin: left, top, right, bottom."""
    corners = F.array(*[moved(m, F.lit(i) * width, F.lit(j) * height) for i in (0, 1) for j in (0, 1)])
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))


def viewport(width: Column, height: Column, rotation: Column, scale: float = 1.0, ratio: float = 1.0) -> Column:
    """Size of a rotated page in CSS and device pixels, and the matrix that brings the page into it. Rotations other than quarter turns
    and sizes that aren't positive give null."""
    turned = rotation.isin(90, 270)
    css_w, css_h = F.when(turned, height).otherwise(width) * scale, F.when(turned, width).otherwise(height) * scale
    pixels = lambda x: F.greatest(F.lit(1), F.floor(x * ratio + 0.5)).cast("int")
    z, s = F.lit(0.0), F.lit(float(scale))
    matrix = (
        F.when(rotation == 90, F.array(z, s, -s, z, height * scale, z)).when(rotation == 180, F.array(-s, z, z, -s, width * scale, height * scale))
        .when(rotation == 270, F.array(z, -s, s, z, z, width * scale)).otherwise(F.array(s, z, z, s, z, z))
    )
    ok = rotation.isin(0, 90, 180, 270) & (width > 0) & (height > 0)
    return F.when(ok, F.struct(css_w.alias("css_width"), css_h.alias("css_height"), pixels(css_w).alias("pixel_width"), pixels(css_h).alias("pixel_height"), matrix.alias("transform")))


def fitted(width: Column, height: Column, box_width: float, box_height: float, fit: str = "page") -> Column:
    """Scale at which a page fits the width of a box, or all of it."""
    across = F.lit(float(box_width)) / width
    return across if fit == "width" else F.least(across, F.lit(float(box_height)) / height)


def spread_of(index: Column, first_alone: bool = True) -> Column:
    """Number of the two-page spread a page lies on; the first page may stand alone."""
    return F.floor((index + (1 if first_alone else 0)) / 2).cast("int")


def speakable(s: Column) -> Column:
    """Whether something is left to speak once blanks and marks are gone."""
    return F.coalesce(F.length(F.regexp_replace(s, "[\\s\"'“”‘’「」『』()\\[\\]{}<>《》。，、？！：；,.!?;:\\-—–…]+", "")) > 0, F.lit(False))


def without_references(s: Column) -> Column:
    """Text without bracketed numbers and raised figures, which point to notes. Both are found in the text as it stands."""
    return F.regexp_replace(s, r"[\s\x{A0}]*[\[［]\s*\d{1,4}\s*[\]］]|[\s\x{A0}]*[¹²³⁴⁵⁶⁷⁸⁹⁰]+", "")


def trimmed_edges(s: Column, speech: bool = False) -> Column:
    """Offsets of a text without silent edges: blanks and quotation marks; before speech, marks of punctuation too."""
    quiet = "\\s\"'“”‘’「」『』"
    head = F.length(s) - F.length(F.regexp_replace(s, f"^[{quiet}{',，、。.!！?？;；:：—–…-' if speech else ''}]+", ""))
    tail = F.length(F.regexp_replace(s, f"[{quiet}]+$", ""))
    return F.struct(F.least(head, F.length(s)).alias("start"), F.greatest(F.least(head, F.length(s)), tail).alias("end"))


def body_of(html: Column) -> Column:
    """What stands in the body of a document, or the text without its head and shell where no body is marked."""
    found = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1)
    shell = F.regexp_replace(html, r"(?is)<\?xml[^>]*>|<!doctype[^>]*>|<head\b.*?</head\s*>|</?(?:html|body)\b[^>]*>", "")
    return F.when(html.rlike(r"(?is)<body\b[^>]*>.*</body\s*>"), found).otherwise(shell)


def heading_of(html: Column) -> Column:
    """Text of the title element or else of the first heading; null where neither holds any."""
    text = lambda pattern: F.nullif(readable_text(F.regexp_extract(html, pattern, 1)), F.lit(""))
    return F.coalesce(text(r"(?is)<title\b[^>]*>(.*?)</title\s*>"), text(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"))


def section_title(label: Column, html: Column, own: Column, index: Column) -> Column:
    """Title of a section: its contents label, even an empty one, what its document is headed, its id, its number."""
    return F.coalesce(label, heading_of(html), own, F.concat(F.lit("Section "), (index + 1).cast("string")))


def unit_text(blocks: Column, segments: Column, html: Column, kind: Column) -> Column:
    """Text of a unit: its blocks' texts by line, its segments', or its HTML made readable; images have none. blocks and segments: arrays of texts."""
    some = lambda a, by: F.nullif(F.array_join(F.filter(a, lambda x: F.length(x) > 0), by), F.lit(""))
    return F.when(kind == "image", "").otherwise(F.coalesce(some(blocks, "\n"), some(segments, ""), readable_text(html), F.lit("")))


def block_text(kind: Column, segments: Column, alt: Column, title: Column, cells: Column) -> Column:
    """Text of a block: an image's description, a table's cells parted by blanks, or its segments but for those of images. segments: array<struct<text, source>>; cells: array<array<string>>."""
    own = F.array_join(F.transform(F.filter(segments, lambda s: s["source"] != "img"), lambda s: s["text"]), "")
    return F.when(kind == "image", F.coalesce(F.nullif(alt, F.lit("")), title, F.lit(""))).when(kind == "table", F.array_join(F.flatten(cells), " ")).otherwise(F.coalesce(own, F.lit("")))


def of_language(texts: Column, wanted: str | None = None) -> Column:
    """One text of a map by language: the wanted one or the first; null of an empty map."""
    first = F.get(F.map_values(texts), F.lit(0))
    return F.coalesce(texts[wanted], first) if wanted else first


def language_tag(lang: Column) -> Column:
    """A language as one tag: und where there is none."""
    return F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.lit("und"))


def contributor_names(people: Column) -> Column:
    """Names of contributors in order, those without a name left out. people: array<struct<name>>."""
    return F.array_join(F.filter(F.transform(people, lambda p: F.trim(p["name"])), lambda n: F.length(n) > 0), ", ")


def subject_list(subjects: Column) -> Column:
    """Subjects without empty ones."""
    return F.filter(subjects, lambda s: F.length(F.trim(s)) > 0)


def export_title(title: Column, subtitle: Column) -> Column:
    """Title and subtitle of a file."""
    return F.concat_ws(": ", F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Untitled")), F.nullif(F.trim(subtitle), F.lit("")))
