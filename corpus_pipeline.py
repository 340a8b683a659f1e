"""Documents to packed training sequences, in five stages that each read the Parquet files of the one before.

All stages but the last return the columns of documents. Decisions are by row: repeated and null ids lose no other text, and of rows
that are equal in a stage's eyes one stays, the one with the smallest doc_id (null last)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bag_minhash, exact_dedup, packing, positional_index, toxicity
from foliant.llm.shared import by_arrow, read, slices, stored


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, stored so that it stays the same however often the table is read."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def first_of(docs: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Of docs, numbered(), the row of each group with the smallest doc_id. rows: _row and the group of every row."""
    placed = docs.select(F.struct("_row").alias("at"), F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("_order")).join(rows.select(F.struct("_row").alias("at"), group), "at")
    kept = placed.groupBy(group).agg(F.min("_order")["_row"].alias("_row")).select("_row")
    return docs.join(kept, "_row", "left_semi").drop("_row")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts to be toxic go."""
    net = toxicity.fitted(docs, read(spark, sf_dir, "labels"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in slices(batch, "text"):
            yield own.filter(pa.array(net.scores(own.column("text")) < 0.5))

    return by_arrow(docs, run, docs.schema)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays."""
    rows = numbered(docs)
    return first_of(rows, exact_dedup.deduplicate(rows, id_col="_row"), "keep_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the smallest doc_id stays."""
    rows = numbered(docs)
    return first_of(rows, bag_minhash.near_duplicates(rows, id_col="_row"), "class_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    rows = numbered(docs)
    found = positional_index.contamination(rows, read(spark, sf_dir, "benchmark"), id_col="_row")
    return rows.join(found.where("contaminated").select("_row"), "_row", "left_anti").drop("_row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL has no recurrent network and no tokeniser; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
