"""Books as files: EPUB, HTML, CBZ and plain text, one file for each book, written by the tasks that hold the book's row.

A section's body is plain text, or HTML where it begins with a tag. Images that HTML carries as data URIs become files of the package, each once however
often it is used, numbered by first use. Contents may be nested; entries of sections that aren't exported give way to their children."""

from __future__ import annotations

import base64
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAMP = (1980, 1, 1, 0, 0, 0)


def _zip(entries: list[tuple[str, bytes, bool]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body, packed in entries:
            z.writestr(zipfile.ZipInfo(name, STAMP), body, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    return out.getvalue()


ATTRIBUTE = re.compile(r"""(?i)(\s)(src|poster|data|href|xlink:href)=(["'])(.*?)\3""")
IMAGE_EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/avif": ".avif"}


def rewritten(text: str, new: Callable[[str, str], str | None]) -> str:
    """HTML with other references: new gets a URL and its attribute and gives another URL, or None to leave it."""

    def one(m: re.Match) -> str:
        to = new(html.unescape(m.group(4)), m.group(2).lower())
        return m.group() if to is None else f'{m.group(1)}{m.group(2)}="{html.escape(to)}"'

    return ATTRIBUTE.sub(one, text)


def data_image(url: str) -> tuple[str, bytes] | None:
    """Type and bytes of an image in a data URI."""
    m = re.match(r"(?is)data:(image/[\w.+-]+)(?:;[\w=-]+)*;base64,(.*)$", url)
    try:
        return (m.group(1).lower(), base64.b64decode(re.sub(r"\s", "", m.group(2)), validate=True)) if m else None
    except ValueError:
        return None


class Package:
    """Images of a package, each URL once."""

    def __init__(self):
        self.names: dict[str, str] = {}
        self.files: list[tuple[str, str, bytes]] = []  # name, type, bytes

    def add(self, url: str, attribute: str = "src") -> str | None:
        if url not in self.names:
            found = data_image(url)
            if found is None or attribute in ("href", "xlink:href") and not found[0].startswith("image/"):
                return None
            self.names[url] = f"images/resource-{len(self.files) + 1}{IMAGE_EXTENSIONS.get(found[0], '.bin')}"
            self.files.append((self.names[url], *found))
        return self.names[url]


def is_html(body: str) -> bool:
    return body.lstrip()[:1] == "<"


def inner(body: str) -> str:
    """The body's content of a document, or the text without its head and shell."""
    m = re.search(r"(?is)<body\b[^>]*>(.*)</body\s*>", body)
    return m.group(1) if m else re.sub(r"(?is)<\?xml[^>]*>|<!doctype[^>]*>|<head\b.*?</head\s*>|</?(?:html|body)\b[^>]*>", "", body)


def shown(body: str, package: Package | None = None, up: str = "") -> str:
    if not is_html(body):
        return "".join(f"<p>{html.escape(x)}</p>" for x in body.split("\n") if x.strip())
    found = inner(body)
    return rewritten(found, lambda url, attribute: up + name if (name := package.add(url, attribute)) else None) if package is not None else found


def page(title: str, text: str, package: Package | None = None) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{shown(text, package)}</body></html>'


def projected(toc: list[tuple[int, str, int | None]]) -> list[tuple[int, str, int]]:
    """Contents entries (depth, label, number of the section or None) of kept sections in order; children of dropped ones move up, so depth counts kept entries alone."""
    out, above = [], []
    for depth, label, to in toc:
        above = [d for d in above if d < depth]
        if to is not None:
            out.append((len(above), label, to))
            above.append(depth)
    return out


def nested(entries: list[tuple[int, str, str]]) -> str:
    """Nested lists of links, from depth, label and reference."""
    text, depth = "", -1
    for d, label, href in entries:
        d = min(d, depth + 1)
        if d > depth:
            text += "<ol>"
        else:
            text += "</li>" + "</ol></li>" * (depth - d)
        text += f'<li><a href="{html.escape(href)}">{html.escape(label)}</a>'
        depth = d
    return text + ("</li>" + "</ol></li>" * depth + "</ol>" if entries else "<ol></ol>")


Toc = list[tuple[int, str, int | None]]


def epub_bytes(identifier: str, title: str, language: str, sections: list[tuple[str, str]], toc: Toc | None = None) -> bytes:
    """A package with one document for each section, its images, and contents that name them."""
    names, package = [f"s{i:04d}.xhtml" for i in range(len(sections))], Package()
    pages = [(f"OEBPS/{n}", page(t, b, package).encode(), True) for n, (t, b) in zip(names, sections)]
    entries = [(d, label, names[to]) for d, label, to in projected(toc)] if toc else [(0, t, n) for n, (t, _) in zip(names, sections)]
    items = "".join(f'<item id="s{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    items += "".join(f'<item id="r{i}" href="{n}" media-type="{kind}"/>' for i, (n, kind, _) in enumerate(package.files))
    spine = "".join(f'<itemref idref="s{i}"/>' for i in range(len(names)))
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{html.escape(identifier)}</dc:identifier><dc:title>{html.escape(title)}</dc:title><dc:language>{html.escape(language)}</dc:language></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
    )
    nav = f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc">{nested(entries)}</nav></body></html>'
    box = '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    files = [("mimetype", b"application/epub+zip", False), ("META-INF/container.xml", box.encode(), True), ("OEBPS/content.opf", opf.encode(), True), ("OEBPS/nav.xhtml", nav.encode(), True)]
    return _zip(files + pages + [(f"OEBPS/{n}", body, False) for n, _, body in package.files])


def html_text(identifier: str, title: str, language: str, sections: list[tuple[str, str]], toc: Toc | None = None) -> bytes:
    entries = [(d, label, f"#s{to}") for d, label, to in projected(toc)] if toc else [(0, t, f"#s{i}") for i, (t, _) in enumerate(sections)]
    body = "".join(f'<section id="s{i}"><h2>{html.escape(t)}</h2>{shown(b)}</section>' for i, (t, b) in enumerate(sections))
    return f'<!doctype html><html lang="{html.escape(language)}"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><nav>{nested(entries)}</nav>{body}</body></html>'.encode()


def inline_images(text: str, prefix: str) -> list[tuple[str, bytes]]:
    """Images a piece of HTML carries under src or poster, named by page and order."""
    found = [data_image(html.unescape(u)) for u in re.findall(r"""(?i)\s(?:src|poster)=["']([^"']+)["']""", text)]
    return [(f"page{prefix}-img{k:02d}{IMAGE_EXTENSIONS.get(kind, '.bin')}", body) for k, (kind, body) in enumerate((x for x in found if x), 1)]


def cbz_bytes(identifier: str, title: str, language: str, sections: list[tuple[str, str]], toc: Toc | None = None) -> bytes:
    """Images of the sections in order; a section without any is a page of text."""
    entries: list[tuple[str, bytes, bool]] = []
    for i, (t, b) in enumerate(sections, 1):
        own = inline_images(b, f"{i:04d}") if is_html(b) else []
        entries += [(n, body, False) for n, body in own] or [(f"{i:04d}.txt", f"{t}\n\n{b}".encode(), True)]
    info = f"<?xml version=\"1.0\" encoding=\"utf-8\"?><ComicInfo><Title>{html.escape(title)}</Title><LanguageISO>{html.escape(language)}</LanguageISO><PageCount>{len(entries)}</PageCount></ComicInfo>"
    return _zip([("ComicInfo.xml", info.encode(), True), *entries])


def txt_bytes(identifier: str, title: str, language: str, sections: list[tuple[str, str]], toc: Toc | None = None) -> bytes:
    from .text import DIVIDER

    plain = lambda b: html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)</(?:p|div|h[1-6]|li|tr|section|article|blockquote)\s*>|<br\s*/?>", "\n", inner(b)))).strip() if is_html(b) else b
    return "\n".join([title, *(f"{DIVIDER}\n{t}\n{plain(b)}" for t, b in sections)]).encode()


#: Writers by format. A writer gets identifier, title, language, sections (title, body) and contents, and gives bytes.
WRITERS: dict[str, Callable[..., bytes]] = {}


def register(kind: str, writer: Callable[..., bytes]) -> None:
    WRITERS[kind] = writer


def unregister(kind: str) -> bool:
    return WRITERS.pop(kind, None) is not None


for _kind, _writer in (("epub", epub_bytes), ("html", html_text), ("cbz", cbz_bytes), ("txt", txt_bytes)):
    register(_kind, _writer)


def numbered_resources(uses: DataFrame) -> DataFrame:
    """Each resource of a book once, numbered by its first use. uses: book_id, url, position."""
    from pyspark.sql import Window as W

    first = uses.groupBy("book_id", "url").agg(F.min("position").alias("position"))
    return first.withColumn("number", F.row_number().over(W.partitionBy("book_id").orderBy("position", "url")))


def export_rows(books: DataFrame, sections: DataFrame, kind: str = "epub", first: int | None = None) -> DataFrame:
    """book_id, file name and bytes. sections: book_id, section_index, linear, label, body. A reading order of the first sections if wanted."""
    from pyspark.sql import Window as W

    if kind not in WRITERS:
        raise ValueError(f"unknown format {kind}")
    line = sections.filter(F.coalesce(F.col("linear") != "no", F.lit(True)))
    if first is not None:
        if first < 1:
            raise ValueError("first must be at least 1")
        line = line.withColumn("_n", F.row_number().over(W.partitionBy("book_id").orderBy("section_index"))).filter(F.col("_n") <= first)
    parts = line.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("section_index", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("body", F.lit("")).alias("body")))).alias("parts"))
    rows = books.join(parts, "book_id").select("book_id", F.coalesce("identifier", F.lit("")).alias("identifier"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("lang", F.lit("und")).alias("lang"), "parts")

    write = WRITERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                body = write(r["identifier"], r["title"], r["lang"], [(p["label"], p["body"]) for p in r["parts"]])
                yield pa.RecordBatch.from_pylist([{"book_id": r["book_id"], "file_name": f"{r['book_id']}.{kind}", "content": body}], schema=pa.schema([("book_id", pa.int64()), ("file_name", pa.string()), ("content", pa.binary())]))

    return rows.mapInArrow(run, "book_id long, file_name string, content binary")


def write_files(rows: DataFrame, folder: str) -> None:
    """Each task writes its files under a temporary name and moves them, so that a repeated task does no harm. folder is a URI of a file system all
    machines share, or a local path, which only a single machine may use."""
    if "://" not in folder and not rows.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster the folder must be the URI of a shared file system")

    def save(part) -> None:
        system, root = arrow_fs.FileSystem.from_uri(folder) if "://" in folder else (arrow_fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for r in part:
            to = f"{root}/{r.file_name}"
            with system.open_output_stream(to + ".part") as f:
                f.write(r.content)
            system.move(to + ".part", to)

    rows.foreachPartition(save)
