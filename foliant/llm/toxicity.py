"""Toxicity of whole texts by a bidirectional gated recurrent network (bigru) over all overlapping windows.

The network is fitted in one task, on a bounded sample of labelled rows, and only its weights come to the driver; all rows are scored on the
executors."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import bigru
from foliant.llm.shared import by_arrow, read, slices

FOLDS = 5
#: The sample that a network is fitted on, for each class: most labelled rows, and most bytes of their whole texts together. Scoring takes all.
ROWS_OF_CLASS = 1600
BYTES_OF_CLASS = 16 << 20


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(-1))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1) of rows that may be learned from: one for each doc_id, 1 if any says so; null ids and labels are left out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0)
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, known: DataFrame, rows_of_class: int, bytes_of_class: int) -> DataFrame:
    """doc_id, text and toxic of the rows to learn from, in the order of a hash of their ids: at most rows_of_class of each class, as long as
    their whole texts have at most bytes_of_class bytes. A single text of more bytes than that isn't learned from."""
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_of_class) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * rows_of_class rows
    rows = docs.select("doc_id", "text", F.octet_length("text").alias("_bytes")).where(F.col("_bytes") <= bytes_of_class).join(ids, "doc_id")
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_sum", F.sum("_bytes").over(so_far)).where(F.col("_sum") <= bytes_of_class).select("doc_id", "text", "toxic")


def fitted(docs: DataFrame, labels: DataFrame, rows_of_class: int = ROWS_OF_CLASS, bytes_of_class: int = BYTES_OF_CLASS) -> bigru.Network:
    """A network that learned from sample(), in one task, whose input that bounds."""
    known = labelled(labels.select("doc_id", "toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            rows = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            net = bigru.fit(rows.column("text"), rows.column("toxic").to_numpy().astype(np.float64), prior)
            yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(net)]})

    found = sample(docs, known, rows_of_class, bytes_of_class).coalesce(1).mapInArrow(run, "net binary").collect()  # one row of about 1.3 MB
    return pickle.loads(found[0]["net"]) if found else bigru.fit(pa.array([], pa.string()), np.zeros(0), prior)


def score(docs: DataFrame, net: bigru.Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone.

    Null and empty texts score the share of toxic texts among the labels, at most 0.49. Repeated rows are scored each; a null
    doc_id is not held out. Without labels of both classes every text scores that share. Other columns are not read."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in slices(batch, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": own.column("doc_id"), "score": net.scores(own.column("text")).astype(np.float64)})

    scored = by_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    return score(docs, fitted(docs if learn_from is None else learn_from, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
