"""Records merged, indexed and followed: full outer merges, contributions by kind, finished chunks, states of work."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(older: DataFrame, newer: DataFrame, key: list[str], fields: list[str], overwrite: Iterable[str] = ()) -> DataFrame:
    """Records of two versions by key: a newer value stands unless it is null; of the overwrite fields it stands, null or not, where the newer version has the record."""
    a = older.select(*key, F.struct(*fields, *overwrite).alias("_old"))
    b = newer.select(*key, F.struct(*fields, *overwrite).alias("_new"))
    both = a.join(b, key, "full")
    kept = [F.coalesce(f"_new.{f}", f"_old.{f}").alias(f) for f in fields]
    kept += [F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f"_old.{f}")).alias(f) for f in overwrite]
    return both.select(*key, *kept)


def contributions(extensions: DataFrame, kinds: list[str]) -> DataFrame:
    """One row for each thing an extension contributes: extension_id, kind, position, item. extensions: extension_id and an array for each kind."""
    rows = None
    for k in kinds:
        part = extensions.select("extension_id", F.lit(k).alias("kind"), F.posexplode(k).alias("position", "item"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def catalog(entries: DataFrame, source: str | None = None, categories: Iterable[str] = (), capabilities: Iterable[str] = (), installed: bool | None = None, enabled: bool | None = None, text: str = "", fields: Iterable[str] = ()) -> DataFrame:
    """Entries that meet every condition given; text counts in any of the fields, in any case."""
    ok = F.lit(True)
    if source is not None:
        ok = ok & (F.col("source") == source)
    for column, wanted in (("categories", list(categories)), ("capabilities", list(capabilities))):
        if wanted:
            ok = ok & (F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(column, F.array().cast("array<string>")))) == 0)
    for column, wanted in (("installed", installed), ("enabled", enabled)):
        if wanted is not None:
            ok = ok & (F.coalesce(column, F.lit(False)) == wanted)
    q = text.strip().lower()
    if q:
        ok = ok & F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(q))
    return entries.filter(ok)


def applied(book: DataFrame, plugins: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each plugin changes what the one before it gave."""
    for p in plugins:
        book = book.transform(p)
    return book


def finished(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Texts of chapters whose finished chunks changed: chapter, signature, texts in the order of chunk_index. chunks: chapter, chunk_index, status, text;
    known: chapter and signature as given out before."""
    done = chunks.filter(F.col("status") == "done").groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    rows = done.select("chapter", F.xxhash64("c").alias("signature"), F.col("c.text").alias("texts"))
    if known is None:
        return rows
    return rows.join(known.select("chapter", F.col("signature").alias("_before")), "chapter", "left").filter(F.col("_before").isNull() | (F.col("_before") != F.col("signature"))).drop("_before")


def chunk_texts(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Translated text of each block: by id where the chunk is JSON that names ids, else by position; the cells of a table are parted by tabs or bars.
    chunks: chapter, payload (JSON list of {id, text}, or lines); blocks: chapter, block_id, position, kind."""
    items = F.from_json("payload", "array<struct<id:string,text:string>>")
    parsed = chunks.withColumn("items", items)
    named = parsed.filter("items is not null").select("chapter", F.inline("items")).select("chapter", F.col("id").alias("block_id"), F.col("text").alias("by_id"))
    lines = parsed.filter("items is null").select("chapter", F.posexplode(F.split("payload", "\n")).alias("position", "by_place"))
    rows = blocks.join(named, ["chapter", "block_id"], "left").join(lines, ["chapter", "position"], "left")
    text = F.coalesce("by_id", "by_place")
    cells = F.transform(F.split(text, r"\t|\s*\|\s*"), lambda x: F.trim(x))
    return rows.select("chapter", "block_id", "position", text.alias("text"), F.when(F.col("kind") == "table", F.filter(cells, lambda x: x != "")).alias("cells"))


def rewrites(payloads: DataFrame) -> DataFrame:
    """Items of edits that came as JSON text: a list, or an object that holds one under rewrites; items without block or text are dropped. Single quotes, unquoted names and a comma
    before a closing bracket are accepted. payloads: request_id, payload. Text that is no JSON even then gives no row."""
    item = "array<struct<blockId:string,text:string>>"
    options = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
    clean = F.regexp_replace(F.trim("payload"), r",\s*([\]}])", "$1")
    listed = F.when(F.startswith(clean, F.lit("{")), F.from_json(clean, f"struct<rewrites:{item}>", options)["rewrites"]).otherwise(F.from_json(clean, item, options))
    rows = payloads.select("request_id", F.inline(listed))
    return rows.filter((F.trim("blockId") != "") & (F.trim("text") != "")).select("request_id", F.trim("blockId").alias("block_id"), "text")


def work_state(tasks: DataFrame, attempts: int = 2) -> DataFrame:
    """State of each job from its tasks' tries: a task failed for good after so many; a job is done, partial, failed or still running.
    tasks: job_id, task_id, try, ok."""
    each = tasks.groupBy("job_id", "task_id").agg(F.bool_or("ok").alias("done"), F.count("*").alias("tries"))
    n = each.groupBy("job_id").agg(F.count("*").alias("tasks"), F.count_if("done").alias("done"), F.count_if(~F.col("done") & (F.col("tries") >= attempts)).alias("failed"))
    state = F.when(F.col("done") == F.col("tasks"), "done").when(F.col("done") + F.col("failed") < F.col("tasks"), "running").when(F.col("done") > 0, "partial").otherwise("failed")
    return n.withColumn("state", state)


def voices(catalog: DataFrame, first: list[str], then: list[str], most: int = 24) -> DataFrame:
    """Voices offered: those of the first locales, then of others, up to a number; among them by gender and their own order; each id once. catalog: voice_id, locale, gender, ordinal."""
    from pyspark.sql import Window as W

    tier = F.when(F.col("locale").isin(first), 0).when(F.col("locale").isin(then), 1)
    rank = F.when(F.col("gender") == "Female", 0).when(F.col("gender") == "Male", 1).otherwise(2)
    rows = catalog.withColumns({"tier": tier, "rank": rank}).filter("tier is not null")
    one = rows.groupBy("voice_id").agg(F.min(F.struct("tier", "rank", "ordinal", "locale", "gender")).alias("v")).select("voice_id", "v.*")
    return one.withColumn("place", F.row_number().over(W.orderBy("tier", "rank", "ordinal", "voice_id"))).filter(F.col("place") <= most)
