"""Book files as DataFrames: one row for each book, with its sections, contents, pages and resources nested."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import parse

SCHEMA = """path string, book_format string, error string, metadata map<string, array<string>>,
 sections array<struct<section_id: string, linear: string, media_type: string, content: string>>,
 toc array<struct<depth: int, label: string, href: string>>, pages array<struct<label: string, href: string>>,
 resources array<struct<resource_id: string, href: string, media_type: string, size: bigint>>,
 landmarks array<struct<label: string, href: string>>, links array<struct<page_index: int, target: string>>,
 runs array<struct<page_index: int, text: string, transform_matrix: array<double>, width: double, font_size: double, has_eol: boolean>>"""
_S = pa.string()
ARROW = pa.schema([
    ("path", _S), ("book_format", _S), ("error", _S), ("metadata", pa.map_(_S, pa.list_(_S))),
    ("sections", pa.list_(pa.struct([("section_id", _S), ("linear", _S), ("media_type", _S), ("content", _S)]))),
    ("toc", pa.list_(pa.struct([("depth", pa.int32()), ("label", _S), ("href", _S)]))), ("pages", pa.list_(pa.struct([("label", _S), ("href", _S)]))),
    ("resources", pa.list_(pa.struct([("resource_id", _S), ("href", _S), ("media_type", _S), ("size", pa.int64())]))),
    ("landmarks", pa.list_(pa.struct([("label", _S), ("href", _S)]))), ("links", pa.list_(pa.struct([("page_index", pa.int32()), ("target", _S)]))),
    ("runs", pa.list_(pa.struct([("page_index", pa.int32()), ("text", _S), ("transform_matrix", pa.list_(pa.float64())), ("width", pa.float64()), ("font_size", pa.float64()), ("has_eol", pa.bool_())]))),
])


def row(path: str, data: bytes) -> dict:
    try:
        b = parse(path, data)
    except Exception as e:  # a damaged file is a row with its error, never the end of the job
        return {"path": path, "error": f"{type(e).__name__}: {e}"[:500], "metadata": [], "sections": [], "toc": [], "pages": [], "resources": [], "landmarks": [], "links": [], "runs": []}
    named = lambda keys, rows: [dict(zip(keys, r)) for r in rows]
    return {
        "path": path, "book_format": b.format, "error": b.error, "metadata": list(b.metadata.items()),
        "sections": named(("section_id", "linear", "media_type", "content"), b.sections), "toc": named(("depth", "label", "href"), b.toc),
        "pages": named(("label", "href"), b.pages), "resources": named(("resource_id", "href", "media_type", "size"), b.resources),
        "landmarks": named(("label", "href"), b.landmarks), "links": named(("page_index", "target"), b.links), "runs": named(("page_index", "text", "transform_matrix", "width", "font_size", "has_eol"), b.runs),
    }


def read_books(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """All book files under a path. One file is read and parsed at a time in each task."""

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")
    return parsed(files)


def parsed(files: DataFrame) -> DataFrame:
    """Books of rows of path and content, wherever they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_pylist([row(p.as_py(), c.as_py())], schema=ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def sections_of(books: DataFrame) -> DataFrame:
    s = books.select("path", F.posexplode("sections").alias("section_index", "s"))
    return s.select("path", "section_index", "s.*", F.octet_length("s.content").cast("long").alias("size_bytes"))


def toc_of(books: DataFrame) -> DataFrame:
    return books.select("path", F.posexplode("toc").alias("toc_index", "t")).select("path", "toc_index", "t.*")


def runs_of(books: DataFrame) -> DataFrame:
    """Text runs of fixed pages, as text_runs holds them."""
    return books.select("path", F.posexplode("runs").alias("run_index", "r")).select("path", "run_index", "r.*")
