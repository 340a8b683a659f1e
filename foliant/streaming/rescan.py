"""Re-scans of a growing document folder: each micro-batch is analysed, what fails goes to dead letters, and a repeated batch changes nothing.

Results and dead letters are tables with a folder for each batch, which a batch that runs again replaces. The analysis is any function
of a DataFrame; where it fails on a batch, the batch is halved by a hash of its keys until the documents that fail stand alone, and
the others are stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from foliant import storage
from foliant.functions.text import strip
from foliant.operators import collections

Analysis = Callable[[DataFrame], DataFrame]

MOST_BYTES = 1 << 20
#: A dead letter has at most so many characters of a message.
MESSAGE = 500
#: A part that fails is written in slices by so many bits of the hash, which are folders; and the name of their column.
SLICED, SLICE = 4, "__slice"
DEAD = "path string, reason string, detail string, batch_id bigint"


def sorted_out(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs (path, content binary or string) with reason, null for those that can be analysed: too_large, not_text or blank."""
    raw = F.col("content").cast("binary")
    text = F.col("content").cast("string")
    reason = F.when(F.octet_length(raw) > most_bytes, "too_large").when(~F.is_valid_utf8(text), "not_text").when(strip(F.coalesce(text, F.lit(""))) == "", "blank")
    return docs.withColumn("reason", reason)


def message_of(error: Exception) -> str:
    return f"{type(error).__name__}: {error}".split("\n")[0][:MESSAGE]


def isolated(docs: DataFrame, analysis: Analysis, key: str = "path", bits: int = 32) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """Results that could be computed, as tables, and the keys that failed, each with a message.

    All documents are tried at once. On failure each half by the next bit of a hash of the key is, so a document that fails costs at most `bits` attempts;
    keys of one hash fail together. What failed is written by its next SLICED bits, so that attempts read their own part only and few failures cost
    a few passes in all, not one for each attempt. Errors of the plan, which no split can mend, are raised."""
    spark, names = docs.sparkSession, docs.columns
    done: list[DataFrame] = []
    failed: list[tuple[str, str]] = []
    folders: list[str] = []
    # Depth and bits of a part, the table that it is in, and the depth of that table's slices.
    work: list[tuple[int, int, DataFrame, int]] = [(0, 0, docs, 0)]
    while work:
        depth, value, table, since = work.pop()
        part = table.where(F.col(SLICE).bitwiseAND((1 << depth - since) - 1) == value >> since).select(*names) if depth else docs
        plan = analysis(part)
        path = storage.fresh(spark, "isolated")
        try:
            done.append(storage.written(plan, path))
        except PySparkException as error:
            storage.delete(spark, path)
            least, most = part.agg(F.min(F.struct(key)), F.max(F.struct(key))).first()
            if depth == bits or least == most:
                failed += [(r[0], message_of(error)) for r in part.select(key).distinct().collect()]  # the keys of one hash
                continue
            if depth % SLICED == 0:
                folders.append(storage.fresh(spark, "slices"))
                own = F.shiftrightunsigned(F.xxhash64(F.col(key)), depth).bitwiseAND((1 << SLICED) - 1).cast("int")
                part.withColumn(SLICE, own).write.partitionBy(SLICE).parquet(folders[-1])
                table, since = spark.read.schema(StructType([*docs.schema, StructField(SLICE, IntegerType())])).parquet(folders[-1]), depth
            work += [(depth + 1, value, table, since), (depth + 1, value | 1 << depth, table, since)]
    for folder in folders:
        storage.delete(spark, folder)
    return done, failed


def batch_writer(analysis: Analysis, store: str, dead: str, most_bytes: int = MOST_BYTES) -> Callable[[DataFrame, int], None]:
    """What foreachBatch does: stores results and dead letters of a batch in its own folders, whole and in place of what is there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = storage.fresh(spark, "batch")
        rows = storage.written(sorted_out(batch, most_bytes), own)
        good = rows.where("reason IS NULL").drop("reason").withColumn("content", F.col("content").cast("string"))
        results, failed = isolated(good, analysis)
        out = results[0] if results else analysis(good).limit(0)
        for more in results[1:]:
            out = out.unionByName(more)
        letters = rows.where("reason IS NOT NULL").select("path", "reason", F.lit(None).cast("string").alias("detail"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        letters = letters.unionByName(spark.createDataFrame([(p, "failed", m, batch_id) for p, m in failed], DEAD))
        out.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
        letters.drop("batch_id").write.mode("overwrite").parquet(f"{dead}/batch_id={batch_id}")
        for df in results:
            for file in df.inputFiles()[:1]:
                storage.delete(spark, file.rsplit("/", 1)[0])
        storage.delete(spark, own)

    return write


def start(files: DataFrame, analysis: Analysis, store: str, dead: str, checkpoint: str, most_bytes: int = MOST_BYTES, once: bool = True) -> StreamingQuery:
    """Begins to analyse a stream of files (path, content, and what the analysis needs besides). once: what is there now, then stop.

    The checkpoint makes batches and their numbers the same after a restart; a batch that was not finished runs again and replaces its folders."""
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_writer(analysis, store, dead, most_bytes))
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored(spark: SparkSession, store: str, key: str = "path") -> DataFrame:
    """The last result of each document: that of the latest batch that has it. Null columns where no batch has been stored is an error of the caller: an empty store has no schema."""
    return collections.latest(spark.read.option("mergeSchema", True).parquet(store).withColumn("batch_id", F.col("batch_id").cast("bigint")), key, "batch_id")


def dead_letters(spark: SparkSession, dead: str) -> DataFrame:
    return spark.read.schema(DEAD).parquet(dead)
