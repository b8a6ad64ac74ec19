"""Nodes and reading blocks of HTML sections as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import html as H
from ..functions import inline as I


def _mapped(df: DataFrame, key: list[str], content: str, schema: str, arrow: pa.Schema, rows) -> DataFrame:
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, r) for i, t in enumerate(b.column(len(key)).to_pylist()) for r in rows(t)]
            own = pa.array([i for i, _ in found], pa.int64())
            made = pa.RecordBatch.from_pylist([r for _, r in found], schema=arrow)
            yield pa.RecordBatch.from_arrays([b.column(i).take(own) for i in range(len(key))] + made.columns, names=[*key, *arrow.names])

    return df.select(*key, content).mapInArrow(run, f"{types}, {schema}")


def html_nodes(df: DataFrame, key: list[str], content: str) -> DataFrame:
    """key, node_index, node_path, type, attrs, text: the tree in preorder."""

    def rows(t):
        return [{"node_index": i, "node_path": list(n.path), "type": n.type, "attrs": list(n.attrs.items()), "text": n.text} for i, n in enumerate(H.walk(H.tree(t)))]

    arrow = pa.schema([("node_index", pa.int32()), ("node_path", pa.list_(pa.int32())), ("type", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
    return _mapped(df, key, content, "node_index int, node_path array<int>, type string, attrs map<string, string>, text string", arrow, rows)


def html_blocks(df: DataFrame, key: list[str], content: str) -> DataFrame:
    """key, block_index, block_id, block_type, depth, text."""

    def rows(t):
        return [{"block_index": i, **b} for i, b in enumerate(H.blocks(t))]

    arrow = pa.schema([("block_index", pa.int32()), ("block_id", pa.string()), ("block_type", pa.string()), ("depth", pa.int32()), ("text", pa.string())])
    return _mapped(df, key, content, "block_index int, block_id string, block_type string, depth int, text string", arrow, rows)


def html_segments(df: DataFrame, key: list[str], content: str) -> DataFrame:
    """key, segment_index, block, text, style, source, role: styled text in reading order."""

    def rows(t):
        return [{"segment_index": i, "block": s["block"], "text": s["text"], "style": sorted(s["style"].items()), "source": s["source"], "role": s["role"]} for i, s in enumerate(I.document_segments(t))]

    arrow = pa.schema([("segment_index", pa.int32()), ("block", pa.int32()), ("text", pa.string()), ("style", pa.map_(pa.string(), pa.string())), ("source", pa.string()), ("role", pa.string())])
    return _mapped(df, key, content, "segment_index int, block int, text string, style map<string, string>, source string, role string", arrow, rows)


def html_tables(df: DataFrame, key: list[str], content: str) -> DataFrame:
    """key, table_index, column_count, weights and rows of each table."""
    cell = pa.struct([("text", pa.string()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("header", pa.bool_())])

    def rows(t):
        return [{"table_index": i, "column_count": x["column_count"], "weights": x["weights"], "rows": [[{k: c[k] for k in ("text", "colspan", "rowspan", "header")} for c in r] for r in x["rows"]]} for i, x in enumerate(I.tables(t))]

    arrow = pa.schema([("table_index", pa.int32()), ("column_count", pa.int32()), ("weights", pa.list_(pa.float64())), ("rows", pa.list_(pa.list_(cell)))])
    return _mapped(df, key, content, "table_index int, column_count int, weights array<double>, rows array<array<struct<text: string, colspan: int, rowspan: int, header: boolean>>>", arrow, rows)


def select(nodes: DataFrame, tag: str | None = None, cls: str | None = None, id: str | None = None, has: str | None = None) -> DataFrame:
    """Nodes by tag, class, id or an attribute that isn't empty."""
    ok = F.lit(True)
    if tag:
        ok &= F.col("type") == tag
    if cls:
        ok &= F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), cls)
    if id:
        ok &= F.coalesce(F.col("attrs")["id"] == id, F.lit(False))
    if has:
        ok &= F.coalesce(F.col("attrs")[has], F.lit("")) != ""
    return nodes.filter(ok)


def node_text(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Text of each document: its text nodes in preorder, nothing between them."""
    rows = nodes.filter("type = '#text'").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("node_index", "text"))).alias("t"))
    return rows.select(*key, F.array_join("t.text", "").alias("text"))


def images(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Images with a source, numbered in order, and the type their name tells."""
    src = F.col("attrs")["src"]
    low = F.lower(src)
    kind = F.when(F.contains(low, F.lit(".png")), "image/png").when(F.contains(low, F.lit(".jpg")) | F.contains(low, F.lit(".jpeg")), "image/jpeg").when(F.contains(low, F.lit(".gif")), "image/gif").when(F.contains(low, F.lit(".svg")), "image/svg+xml").when(F.contains(low, F.lit(".webp")), "image/webp").otherwise("application/octet-stream")
    number = F.row_number().over(W.partitionBy(*key).orderBy("node_index")) - 1
    return nodes.filter((F.col("type") == "img") & (F.coalesce(src, F.lit("")) != "")).select(*key, F.concat(F.lit("img-"), number.cast("string")).alias("image_id"), src.alias("src"), kind.alias("mime_type"))
