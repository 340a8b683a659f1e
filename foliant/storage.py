"""Tables and folders that the driver and all executors share, by the session's setting."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Sessions of one machine that name none use the warehouse; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/foliant-{re.sub('[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = hadoop_path(spark, path)
    return files.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, files = hadoop_path(spark, path)
    files.delete(p, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to the path in place of what is there, and read from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
