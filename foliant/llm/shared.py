"""Folders all executors share, tables written there, and forced exchanges for joins that Spark may split."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by sessions of one machine that name no folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written once to the shared folder and read from there: its lineage ends at replicated files,
    its values no longer depend on a recomputation, and the shuffles behind it can be freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{re.sub('[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    del df
    # Spark removes shuffle files once the driver's JVM has collected their last reference.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes tables that stored() wrote, when nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/foliant-" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch; batches without rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `most` bytes of the column each; a longer single value is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    at = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(at, [*at[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def rejoin_key(column: str):
    """The column in another form. A frame aggregated by the column is laid out by it already, and a join would
    keep that layout and so could not split a hot key; by this form both sides are dealt anew, and it can."""
    return F.struct(F.col(column))


WHITE = r"[\x20\x09-\x0D]"
