"""Embeddings by feature hashing, vector search, an inverted index with BM25, and incremental indexing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import tokens

DIMENSIONS = 64
K1, B = 1.2, 0.75


def token_vectors(tokens_: pa.Array) -> pa.Array:
    """Unit vectors of lists of tokens: all tokens of a batch are hashed at once, a byte of each at a time, the longer ones first."""
    flat = tokens_.flatten().cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    size, row = np.diff(offsets), np.repeat(np.arange(len(tokens_)), pc.fill_null(pc.list_value_length(tokens_), 0).to_numpy(zero_copy_only=False))
    order = np.argsort(-size, kind="stable")
    order = order[: int((size >= 2).sum())]
    h, start, longest = np.full(len(order), 0xCBF29CE484222325, np.uint64), offsets[:-1][order], size[order]
    longer = np.searchsorted(-longest, -np.arange(int(longest[0]) if len(order) else 0), side="left")  # how many tokens have more bytes than that
    for at, n in enumerate(longer):
        h[:n] = (h[:n] ^ data[start[:n] + at]) * np.uint64(0x100000001B3)
    sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
    total = np.bincount(row[order] * DIMENSIONS + (h & np.uint64(DIMENSIONS - 1)).astype(np.int64), sign, len(tokens_) * DIMENSIONS).astype(np.float64).reshape(-1, DIMENSIONS)
    norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
    unit = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens_) + 1, dtype=np.int32) * DIMENSIONS), pa.array(unit.ravel()))


def embedded(docs: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
    """docs with an array<float>: each token of two bytes or more adds 1 or -1 in a bucket, by its FNV hash; of length 1, or zero for texts without tokens.

    Spark cuts the tokens; their bytes are hashed by numpy over Arrow batches, as column expressions take microseconds for each byte."""

    def run(a: pa.Array) -> pa.Array:
        return token_vectors(a)

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return docs.withColumn(name, F.arrow_udf(run, "array<float>")(F.coalesce(tokens(F.col(text)), F.expr("cast(array() as array<string>)"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths and for zero vectors."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), 0.0).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def nearest(vectors: DataFrame, query: Sequence[float] | Column, k: int = 10, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k (1 to 50) vectors most similar to one, with scores to three places; ties by key. One pass, and a top-k in each partition."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(vector), q), 3).alias("score")).orderBy(F.desc("score"), key).limit(max(1, min(k, 50)))


def search(docs: DataFrame, query: str, key: str = "doc_id", fields: Sequence[str] = ("text",), limit: int = 500) -> DataFrame:
    """key and rank of documents with a word beginning with each of the query's words, ranked by BM25 over all fields; ties by key. A blank query returns all, with rank 0.

    For a single search: texts are read and their words counted inside the row, and only numbers are added up. search_index keeps postings for many."""
    prefixes = query.lower().split()
    if not prefixes:
        return docs.select(key, F.lit(0.0).alias("rank"))
    words = F.concat(*(tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields))
    low = F.lower(F.concat_ws(" ", *fields))
    hit = lambda p: F.when(F.contains(low, F.lit(p)), F.size(F.filter("_w", lambda t: F.startswith(t, F.lit(p))))).otherwise(0)
    counted = docs.withColumn("_w", words).select(key, F.size("_w").alias("_length"), *(hit(p).alias(f"_tf{i}") for i, p in enumerate(prefixes)))
    totals = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(prefixes))))
    rank = F.lit(0.0)
    for i in range(len(prefixes)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        rank = rank + F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))
    every = F.least(*(F.col(f"_tf{i}") for i in range(len(prefixes))), F.lit(1)) > 0
    return counted.where(every).crossJoin(F.broadcast(totals)).select(key, rank.alias("rank")).orderBy(F.desc("rank"), key).limit(limit)  # totals: one row


def content_hash(content: Column, updated_at: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", content, updated_at.cast("string")), 256)


def to_reindex(docs: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """docs with what to do: skipped_sensitive, skipped_unchanged or indexed. docs: content, updated_at, is_sensitive; stored: key, content_hash."""
    new = content_hash(F.col("content"), F.col("updated_at"))
    old = stored.select(key, F.col("content_hash").alias("_old"))
    todo = F.when(F.coalesce("is_sensitive", F.lit(False)), "skipped_sensitive").when(new == F.col("_old"), "skipped_unchanged").otherwise("indexed")
    return docs.join(old, key, "left").withColumns({"content_hash": new, "todo": todo}).drop("_old")
