"""The queries of the text operators: production parameters, whole tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _specs(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, int]]:
    rows = table(spark, sf_dir, "bin_specs").select("bin_kind", "tokenizer", "capacity_tokens").orderBy("bin_kind").collect()  # three rows, fixed
    return [tuple(r) for r in rows]


def _limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    rows = table(spark, sf_dir, "size_limits").select("src", "max_chars", "overlap_chars").collect()  # two rows, fixed
    return {r[0]: (r[1], r[2]) for r in rows}


#: Spellings of title and description: short, with prefix, or as the end of a URL.
TITLES = r"(?i)^(?:.*[:/#])?(?:title|description)$"


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document, title and description, and of every stretch of a mixed one."""
    from .language import label_names, language_segments, training

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    meta = table(spark, sf_dir, "parsed_meta").filter(F.col("property").rlike(TITLES)).select("meta_id", "lang", "meta_value")
    languages = table(spark, sf_dir, "languages")
    model = training(spark, table(spark, sf_dir, "lang_samples"), languages, [docs, meta])
    names = label_names([tuple(r) for r in languages.select("lang", "iso3", "lang_name").collect()])  # 14 rows, fixed
    return language_segments(docs, "documents", "doc_id", "lang", "text", model, names).unionByName(
        language_segments(meta, "parsed_meta", "meta_id", "lang", "meta_value", model, names)
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = "n_segs > 1 or label_lang is null or label_lang <> lang"
    return p1_segments(spark, sf_dir).filter(wrong).select("src", "row_id", "seg_start", "lang").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads, page numbers, cut words and misread characters of every run."""
    from .ocr import noise

    return noise(table(spark, sf_dir, "text_runs"), table(spark, sf_dir, "fixed_pages").select("book_id", "height"))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous readable paragraphs of every book with page runs."""
    from .ocr import book_paragraphs

    return book_paragraphs(table(spark, sf_dir, "text_runs"), table(spark, sf_dir, "fixed_pages").select("book_id", "height"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of runs and pages with their restored text."""
    from .encoding import damaged, training

    runs, pages = table(spark, sf_dir, "text_runs"), table(spark, sf_dir, "fixed_pages")
    model = training(table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "unit_texts").select("block_uid", "text"))
    return damaged(runs, "text_runs", "run_uid", "text", model).unionByName(damaged(pages, "fixed_pages", "page_uid", "text", model))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("src", "row_id").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every oversized block and narration segment."""
    from .chunks import narration_texts, split_items

    limits = _limits(spark, sf_dir)
    blocks = table(spark, sf_dir, "unit_texts")
    texts = {
        "unit_texts": blocks.select(F.col("block_uid").alias("row_id"), "text"),
        "tts_segments": narration_texts(table(spark, sf_dir, "tts_segments"), blocks).select(F.col("segment_uid").alias("row_id"), "text"),
    }
    parts = [split_items(df, ["row_id"], "text", *limits[src]).select(F.lit(src).alias("src"), "*") for src, df in texts.items()]
    return parts[0].unionByName(parts[1]).dropDuplicates(["src", "row_id", "piece"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).filter("n_pieces > 1").select("src", "row_id").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every text block and excerpt."""
    from .sentences import sentence_units

    kinds = F.col("block_type").isNull() | F.col("block_type").isin("paragraph", "blockquote", "listItem", "heading")
    blocks = table(spark, sf_dir, "unit_texts").filter(kinds)
    hits = table(spark, sf_dir, "search_results")
    found = sentence_units(blocks, "unit_texts", "block_uid", "text", "block_type").unionByName(sentence_units(hits, "search_results", "result_id", "excerpt"))
    return found.distinct()


def _alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "unit_texts").select(F.lit("unit_texts").alias("src"), F.col("block_uid").alias("row_id"), "book_id", "text")
    hits = table(spark, sf_dir, "search_results").select(F.lit("search_results").alias("src"), F.col("result_id").alias("row_id"), "book_id", F.col("match_text").alias("text"))
    return blocks.unionByName(hits)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lookalike import alike_pairs

    return alike_pairs(_alike(spark, sf_dir), "row_id", ["src", "book_id"], "text").select("src", "id_a", "id_b")


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row whose text looks like another one of its book, with its class."""
    from .lookalike import alike_report

    return alike_report(_alike(spark, sf_dir), "row_id", ["src", "book_id"], "text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), "byte_bpe_50k")


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_corpus

    return pack_corpus(table(spark, sf_dir, "documents"), _specs(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import findings

    return findings(table(spark, sf_dir, "documents")).distinct()


def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders."""
    from .pii import masked

    return masked(table(spark, sf_dir, "documents"))


# What holds of every result whatever the data: held against SQL over the whole tables.

BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each item that was cut, and whether its pieces keep to the limit, cover it all and overlap as they should."""
    from pyspark.sql import Window as W

    limits = _limits(spark, sf_dir)
    pieces = p4_pieces(spark, sf_dir).filter("n_pieces > 1")
    at = W.partitionBy("src", "row_id").orderBy("piece")
    pick = lambda k: F.coalesce(*[F.when(F.col("src") == src, v[k]) for src, v in limits.items()])
    begin = F.coalesce(F.greatest(F.lag("piece_end").over(at) - pick(1), F.lag("piece_start").over(at) + 1), F.lit(0))
    size = F.col("piece_end") - F.col("piece_start")
    fine = (F.col("piece_start") == begin) & size.between(1, pick(0)) & (size == F.length("piece_text"))
    rows = pieces.withColumn("fine", fine)
    return rows.groupBy("src", "row_id").agg(F.max("piece_end").alias("size"), (F.bool_and("fine") & (F.count("*") == F.first("n_pieces"))).alias("fine"))


def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that aren't blank in the sentences of each text: all that the text has."""
    kinds = F.col("block_type").isNull() | F.col("block_type").isin("paragraph", "blockquote", "listItem", "heading")
    blocks = table(spark, sf_dir, "unit_texts").filter(kinds).select(F.lit("unit_texts").alias("src"), F.col("block_uid").alias("row_id"), "text")
    hits = table(spark, sf_dir, "search_results").select(F.lit("search_results").alias("src"), F.col("result_id").alias("row_id"), F.col("excerpt").alias("text"))
    texts = blocks.unionByName(hits).dropDuplicates(["src", "row_id"])
    spans = p5_found(spark, sf_dir).join(texts, ["src", "row_id"])
    part = F.substring("text", F.col("sent_start").cast("int") + 1, (F.col("sent_end") - F.col("sent_start")).cast("int"))
    return spans.groupBy("src", "row_id").agg(F.sum(F.length(F.regexp_replace(part, BLANK, ""))).alias("solid"))


def p7_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that the ids of each document stand for: those of its text."""
    from .tokens import ByteBPE

    bpe = ByteBPE.load("byte_bpe_50k")
    sizes = np.zeros(int(bpe.ids.max()) + 1, np.int64)
    sizes[bpe.ids[bpe.hash.slot]] = [len(k) for k in bpe.hash.keys]
    shared = spark.sparkContext.broadcast(sizes)

    @F.pandas_udf("long")
    def total(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: int(shared.value[x].sum()) if len(x) else 0)

    return p7_ids(spark, sf_dir).select("doc_id", total("ids").alias("n_bytes"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of container: documents that came out, containers over their capacity, and documents whose pieces don't follow each other from 0 on."""
    bins = p8_bins(spark, sf_dir).checkpoint()  # ids and numbers, read twice
    caps = {k: c for k, _, c in _specs(spark, sf_dir)}
    used = bins.groupBy("bin_kind", "bin_id").agg(F.sum("n_tokens").alias("used")).groupBy("bin_kind").agg(F.count_if(F.col("used") > F.coalesce(*[F.when(F.col("bin_kind") == k, c) for k, c in caps.items()])).alias("over"))
    each = bins.groupBy("bin_kind", "doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.min("piece").alias("first"), F.sum("n_tokens").alias("tokens"), F.max(F.struct("start_token", "n_tokens")).alias("end"))
    broken = (F.col("first") != 0) | (F.col("last") + 1 != F.col("n")) | (F.col("tokens") != F.col("end.start_token") + F.col("end.n_tokens"))
    docs = each.groupBy("bin_kind").agg(F.count("*").alias("documents"), F.count_if(broken).alias("broken"))
    return docs.join(used, "bin_kind")


def p9_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the masked text of each document is its text with the findings' placeholders in place of their spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = p9_found(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "pii_kind"))).alias("f"))  # of one document
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, (x["start_char"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["pii_kind"]), F.lit("]")).alias("out"), x["end_char"].alias("at")
    )
    made = F.aggregate(F.coalesce("f", F.expr("cast(array() as array<struct<start_char:bigint,end_char:bigint,pii_kind:string>>)")), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step)
    whole = F.concat(made["out"], F.substring(F.col("text"), made["at"].cast("int") + 1, F.length("text")))
    rebuilt = docs.join(found, "doc_id", "left").select("doc_id", whole.alias("whole"))
    return rebuilt.join(p9_masked(spark, sf_dir), "doc_id").select("doc_id", F.col("whole").eqNullSafe(F.col("masked_text")).alias("same"))


def queries() -> dict:
    found = (p1_found, p1_segments, p2_found, p2_paragraphs, p3_found, p3_restored, p4_found, p4_pieces, p5_found, p6_found, p6_classes, p7_ids, p8_bins, p9_found, p9_masked)
    return {f.__name__: f for f in (*found, p4_checks, p5_cover, p7_bytes, p8_checks, p9_rebuilt)}
