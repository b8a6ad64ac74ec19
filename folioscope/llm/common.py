"""What the text operators share: reading, spreading and batch-wise mapping."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows are handed to the kernels in slices of about so many characters, so that memory doesn't follow the length of texts.
SLICE_CHARS = 2_000_000


def shared_folder(spark: SparkSession) -> None:
    """Make checkpoint() usable: in the folder the cluster names; where none is named, in one of our own on a single machine, never on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "folioscope-checkpoints"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Give each core work where a table is so small that its splits are fewer than that. Large files are cut at spark.sql.files.maxPartitionBytes by the
    engine, so rows of large tables stay where they lie. df must be a scan with filters and columns."""
    least = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(least) if df._jdf.queryExecution().toRdd().getNumPartitions() < least else df


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of its text column pass the limit."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
    start, base = 0, 0
    while start < batch.num_rows:
        end = int(sizes.searchsorted(base + limit, side="right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        base, start = int(sizes[end - 1]), end


def map_rows(df: DataFrame, schema: str, text: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """mapInArrow over slices. The kernel gets a batch and gives a batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = kernel(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
