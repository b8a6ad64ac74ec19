"""Streams of reader events and of finished translation chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_windows(events: DataFrame, key: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Block windows seen for the first time: the same key within the watermark counts once."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def counts_by_window(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in key]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, *[F.col(c).cast("string") for c in rest if c != version])).alias("r"))
    return top.select(*key, "r.*")


def _folders(spark, folder: str) -> dict[str, int]:
    """Finished parts of a store by name, and the last batch each holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {s.getPath().getName(): s.getPath() for s in system.listStatus(path)} if system.exists(path) else {}
    done = {n for n, p in found.items() if "=" in n and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    return {n: int(n.partition("=")[2]) for n in done}


def _current(spark, folder: str, upto: int | None = None) -> list[str]:
    """Parts that make up the store: the newest base and the batches behind it."""
    parts = {n: k for n, k in _folders(spark, folder).items() if upto is None or k <= upto}
    base = max((k for n, k in parts.items() if n.startswith("base=")), default=-1)
    return [f"{folder}/{n}" for n, k in sorted(parts.items()) if n == f"base={base}" or n.startswith("batch=") and k > base]


def upsert(folder: str, key: list[str], version: str, every: int = 16):
    """A function for foreachBatch: each batch is a part of its own; a batch that is repeated replaces itself. Every so many batches all parts become one new base,
    and those before the base before it are removed, so that reading stays bounded and a reader of the last base isn't disturbed."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, key, version).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if number % every != every - 1:
            return
        latest(spark.read.parquet(*_current(spark, folder, number)), key, version).write.mode("overwrite").parquet(f"{folder}/base={number}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for name, k in _folders(spark, folder).items():
            if k <= number - every:
                system.delete(path(f"{folder}/{name}"), True)

    return write


def upserted(spark, folder: str, key: list[str], version: str) -> DataFrame:
    return latest(spark.read.parquet(*_current(spark, folder)), key, version)
