"""An inverted index that outlives a search: tables of postings, tombstones and totals, with a generation for each update.

Postings are kept by the first letter of their term, sorted by term, so that a search for prefixes reads the folders of their letters, and in
these the row groups whose terms may begin so; no text is read. An update appends postings of changed documents as a new generation,
a tombstone for each of them and for each removed one, which hides its older postings, and what totals have changed by. compact()
makes one generation of all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions.text import tokens
from foliant.operators.retrieval import B, K1

#: Folders of postings: first letters are dealt to so many.
HEADS = 64


def head(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(1))), F.lit(HEADS)).cast("int")


def posted(docs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, length in tokens over all fields, and terms with their numbers; documents without tokens have an empty list."""
    words = F.concat(*(tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields))
    return docs.select(F.col(key).alias("key"), words.alias("w")).select("key", F.size("w").alias("length"), "w")


def _add(docs: DataFrame, path: str, key: str, fields: Sequence[str], generation: int) -> None:
    rows = posted(docs, key, fields)
    postings = rows.select("key", "length", F.explode("w").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    postings.withColumn("head", head(F.col("term"))).repartition(F.col("head"), F.pmod(F.xxhash64("term"), F.lit(16))).sortWithinPartitions("head", "term").write.partitionBy("head").mode("overwrite").parquet(f"{path}/postings/generation={generation}")
    rows.select("key", "length").write.mode("overwrite").parquet(f"{path}/lengths/generation={generation}")


def create(docs: DataFrame, path: str, key: str = "id", fields: Sequence[str] = ("title", "description", "category", "content")) -> None:
    """Builds the index of docs, whose keys are distinct, in place of what is at the path."""
    storage.delete(docs.sparkSession, path)
    _add(docs, path, key, fields, 0)
    lengths = docs.sparkSession.read.parquet(f"{path}/lengths")
    lengths.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(f"{path}/totals/generation=0")


def generations(spark: SparkSession, path: str) -> int:
    """The number of the next generation. One writer at a time."""
    return spark.read.parquet(f"{path}/totals").agg(F.max("generation")).first()[0] + 1


def update(changed: DataFrame, removed: DataFrame, path: str, key: str = "id", fields: Sequence[str] = ("title", "description", "category", "content")) -> int:
    """Adds or replaces the changed documents and takes out the removed ones (key); returns the generation. Totals are written last: without them an update has not been.

    A generation that was left half written by a lost driver is written anew by the next update."""
    spark = changed.sparkSession
    g = generations(spark, path)
    gone = changed.select(F.col(key).alias("key")).unionByName(removed.select(F.col(key).alias("key"))).distinct()
    before = live_lengths(spark, path, g).join(gone, "key", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t"))
    n, t = before.first()
    _add(changed, path, key, fields, g)
    gone.write.mode("overwrite").parquet(f"{path}/tombstones/generation={g}")
    new = spark.read.parquet(f"{path}/lengths/generation={g}")
    new.agg((F.count("*") - n).alias("documents"), (F.coalesce(F.sum("length"), F.lit(0)) - t).alias("tokens")).write.mode("overwrite").parquet(f"{path}/totals/generation={g}")
    return g


def without_dead(rows: DataFrame, spark: SparkSession, path: str, before: int) -> DataFrame:
    """rows (key, generation) of generations below `before`, without those that a later generation replaced or removed."""
    rows = rows.where(F.col("generation") < before)
    if not storage.exists(spark, f"{path}/tombstones"):
        return rows
    dead = spark.read.parquet(f"{path}/tombstones").where(F.col("generation") < before).groupBy(F.col("key").alias("_key")).agg(F.max("generation").alias("_last"))
    return rows.join(dead, F.col("key") == F.col("_key"), "left").where(F.col("_last").isNull() | (F.col("generation") >= F.col("_last"))).drop("_key", "_last")


def live_lengths(spark: SparkSession, path: str, before: int) -> DataFrame:
    return without_dead(spark.read.parquet(f"{path}/lengths"), spark, path, before)


def candidates(spark: SparkSession, path: str, prefixes: Sequence[str]) -> DataFrame:
    """Postings whose terms begin with one of the prefixes, of the folders of their letters."""
    wanted = spark.range(1).select(*(head(F.lit(p)).alias(f"h{i}") for i, p in enumerate(prefixes))).first()
    begins = F.lit(False)
    for p in prefixes:
        begins = begins | F.startswith(F.col("term"), F.lit(p))
    return spark.read.parquet(f"{path}/postings").where(F.col("head").isin(*set(wanted)) & begins)


def search(spark: SparkSession, path: str, query: str, limit: int = 500) -> DataFrame:
    """key and rank of documents with a word beginning with each of the query's words, by BM25; ties by key. A blank query returns all, with rank 0."""
    now = generations(spark, path)
    prefixes = query.lower().split()
    if not prefixes:
        return live_lengths(spark, path, now).select("key", F.lit(0.0).alias("rank"))
    n, total = spark.read.parquet(f"{path}/totals").where(F.col("generation") < now).agg(F.sum("documents"), F.sum("tokens")).first()
    found = without_dead(candidates(spark, path, prefixes), spark, path, now)
    each = F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(prefixes))), lambda x: F.startswith(F.col("term"), x["p"])))
    hits = found.select("key", "tf", "length", "term", each.alias("x")).groupBy("x.i", "key").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    df = hits.groupBy("i").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (total / max(n, 1))))
    scored = hits.join(F.broadcast(df), "i").groupBy("key").agg(F.sum(part).alias("rank"), F.count("*").alias("matched"))  # df: a row for each query word
    return scored.where(F.col("matched") == len(prefixes)).select("key", "rank").orderBy(F.desc("rank"), "key").limit(limit)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Writes the index with one generation to another path."""
    now = generations(spark, path)
    without_dead(spark.read.parquet(f"{path}/postings"), spark, path, now).drop("generation").repartition(F.col("head"), F.pmod(F.xxhash64("term"), F.lit(16))).sortWithinPartitions("head", "term").write.partitionBy("head").mode("overwrite").parquet(f"{target}/postings/generation=0")
    live_lengths(spark, path, now).select("key", "length").write.mode("overwrite").parquet(f"{target}/lengths/generation=0")
    spark.read.parquet(f"{target}/lengths").agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(f"{target}/totals/generation=0")
