"""Stored vectors of documents: re-indexing what has changed, and search by a text.

The table has a row for each document and model, in folders by a hash of the document. An update reads and replaces the folders that it
changes; a folder's rows meet in one shuffle of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions.text import strip
from foliant.operators import retrieval, store

MODEL = "feature-hash-64"
FOLDERS = 64
SCHEMA = "id string, model string, embedding array<float>, content_hash string, folder int"


@dataclass
class Report:
    """What an update did with each document."""

    indexed: int
    skipped_sensitive: int
    skipped_unchanged: int
    failed: int


def folder(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(FOLDERS)).cast("int")


def vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Stored vectors, of one model or all; none where nothing is stored yet."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    found = spark.read.schema(SCHEMA).parquet(path)
    return found if model is None else found.where(F.col("model") == model)


def reindex(docs: DataFrame, path: str, model: str = MODEL, text: str = "content") -> Report:
    """Embeds the documents (id, content, updated_at, is_sensitive) that are new or changed and not sensitive, and stores their vectors.

    A document without content has failed and keeps what is stored of it. Of repeated ids, the row that was updated last counts. The decision is
    made once and stored before anything is replaced, so that a lost task can't decide anew."""
    spark = docs.sparkSession
    once = docs.groupBy(F.col("id").cast("string").alias("id")).agg(F.max(F.struct("updated_at", F.col(text).alias("content"), "is_sensitive")).alias("d")).select("id", "d.*")
    old = vectors(spark, path, model).select("id", "content_hash")
    todo = retrieval.to_reindex(once, old).withColumn("_failed", (F.col("todo") == "indexed") & F.col("content").isNull())
    todo = todo.withColumn("_in", F.when((F.col("todo") == "indexed") & ~F.col("_failed"), F.col("content")))
    decided = storage.fresh(spark, "reindex")
    todo = storage.written(retrieval.embedded(todo, "_in").select("id", "content_hash", "todo", F.when(F.col("_in").isNotNull(), F.col("embedding")).alias("vector")), decided)
    report = Report(*store.index_report(todo).first())
    new = todo.where("vector is not null").select("id", F.lit(model).alias("model"), F.col("vector").alias("embedding"), "content_hash", folder(F.col("id")).alias("folder"))
    touched = [r[0] for r in new.select("folder").distinct().collect()]  # at most FOLDERS
    if touched:
        kept = vectors(spark, path).where(F.col("folder").isin(touched)).join(new.select("id", "model"), ["id", "model"], "left_anti")
        merged = storage.fresh(spark, "vectors")
        both = storage.written(kept.select(new.columns).unionByName(new), merged)
        both.repartition("folder").write.partitionBy("folder").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        storage.delete(spark, merged)
    storage.delete(spark, decided)
    return report


def removed(spark: SparkSession, ids: DataFrame, path: str) -> None:
    """Takes out the vectors of documents (id), of all models."""
    gone = ids.select(F.col("id").cast("string").alias("id")).distinct()
    touched = [r[0] for r in gone.select(folder(F.col("id")).alias("folder")).distinct().collect()]  # at most FOLDERS
    there = vectors(spark, path).where(F.col("folder").isin(touched))
    copy = storage.fresh(spark, "vectors")
    kept = storage.written(there.join(gone, "id", "left_anti"), copy)
    left = {r[0] for r in kept.select("folder").distinct().collect()}
    kept.repartition("folder").write.partitionBy("folder").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for f in set(touched) - left:
        storage.delete(spark, f"{path}/folder={f}")
    storage.delete(spark, copy)


def semantic_search(spark: SparkSession, query: str, path: str, docs: DataFrame, k: int = 10, model: str = MODEL) -> DataFrame:
    """id, score, title and category of the k (1 to 50) documents whose vectors are most like the query's; never their texts. A blank query finds nothing."""
    stored = vectors(spark, path, model)
    if not query.strip():
        stored = stored.where("false")
    one = retrieval.embedded(spark.range(1).select(strip(F.lit(query)).alias("text"))).first()["embedding"]
    hits = retrieval.nearest(stored, one, k, "embedding", "id")
    return store.with_metadata(hits, docs.withColumn("id", F.col("id").cast("string"))).orderBy(F.desc("score"), "id")
