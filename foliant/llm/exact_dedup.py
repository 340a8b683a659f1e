"""Exact deduplication that no large group of copies can slow down.

Stage 1 combines equal texts inside each input partition (Spark's map-side aggregation), stage 2 merges what is left of a
digest in each of `salts` salted groups, stage 3 combines the salt winners. Each stage groups by digest and whole
normalised text, so a digest alone never decides. Only aggregates meet in one task: a group of copies reaches stage 2
as at most one row for each partition and salt, and stage 3 as at most `salts` rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import read, stored


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Single spaces need no work and don't match."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the smallest id stays. Null and empty texts are one group. A null id is larger than any other;
    a group of null ids only has keep_id null and keeps its rows. Repeated rows count in group_size, and all rows that
    bear the winning id are marked kept. An empty table gives an empty result. Other columns are not read.
    digest may be any function of the text, even a poor one: texts that share a digest are told apart by their content."""
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm")).withColumn("digest", digest(F.col("norm")))
    local = rows.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    merged = local.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = stored(merged.select("digest", "keep_id", "group_size"), "exact-winners")
    if winners.groupBy("digest").count().where("count > 1").isEmpty():
        found = rows.select("id", "digest", *([] if digest is sha256 else ["norm"])).join(winners, "digest")
    else:
        found = rows.join(merged, ["digest", "norm"])
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("norm", 256)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), sha.alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
