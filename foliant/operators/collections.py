"""Relational operators over document collections: filters, search, groups, reports, duplicates, trees and joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import half_up, squeeze


@dataclass(frozen=True)
class Filters:
    """A conjunction. Scores count only if their range isn't the whole one; documents without a score have 0."""

    favorite: bool = False
    category: str | None = None
    hygiene_status: str | None = None
    tags: Sequence[str] = field(default_factory=tuple)
    search: str = ""
    min_score: int = 0
    max_score: int = 100


def mentions(query: str, fields: Sequence[str], tags: str | None = None) -> Column:
    """Case-insensitive substring in any of the fields or tags."""
    low = F.lower(F.lit(query))
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(F.lower(F.col(f)), low), F.lit(False))
    return found | F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(t), low)), F.lit(False)) if tags else found


def filtered(docs: DataFrame, f: Filters, fields: Sequence[str] = ("title", "category", "content"), tags: str | None = "tags") -> DataFrame:
    """docs need the columns a filter in use names: is_favorite, category, hygiene_status, tags, overall_score and the fields."""
    keep = F.lit(True)
    if f.favorite:
        keep = keep & F.col("is_favorite")
    if f.category is not None:
        keep = keep & (F.col("category") == f.category)
    if f.hygiene_status is not None:
        keep = keep & (F.col("hygiene_status") == f.hygiene_status)
    if f.tags:
        keep = keep & F.arrays_overlap(tags, F.array(*map(F.lit, f.tags)))
    if f.search:
        keep = keep & mentions(f.search, fields, tags)
    if f.min_score > 0 or f.max_score < 100:
        keep = keep & F.coalesce("overall_score", F.lit(0)).between(f.min_score, f.max_score)
    return docs.where(keep)


def page(docs: DataFrame, order: Sequence[Column | str], limit: int = 50, offset: int = 0, most: int = 1000) -> DataFrame:
    """One page in a total order."""
    return docs.orderBy(*order).offset(max(offset, 0)).limit(max(1, min(limit, most)))


def by_category(docs: DataFrame, category: str = "category", score: str = "overall_score") -> DataFrame:
    """Documents and rounded mean score of each category; blank ones are uncategorized, documents without a score don't count in the mean."""
    name = F.when(F.trim(F.coalesce(F.col(category), F.lit(""))) == "", "uncategorized").otherwise(F.col(category))
    return docs.groupBy(name.alias("category")).agg(F.count("*").alias("n_docs"), F.coalesce(half_up(F.avg(score)), F.lit(0)).cast("bigint").alias("mean_score"))


def corpus_report(docs: DataFrame, score: str = "overall_score") -> DataFrame:
    """One row: documents and the mean over all of them, with 0 for those without a score."""
    return docs.agg(F.count("*").alias("total"), (F.sum(F.coalesce(F.col(score), F.lit(0))) / F.count("*")).alias("mean_score"))


def distinct_tags(docs: DataFrame, tags: str = "tags") -> DataFrame:
    return docs.select(F.explode(tags).alias("tag")).distinct()


def score_buckets(docs: DataFrame, score: str) -> DataFrame:
    """Documents in the five ranges of 20 points."""
    low = F.least(F.floor(F.col(score) / 20), F.lit(4)) * 20
    label = F.concat_ws("-", low.cast("string"), F.when(low == 80, 100).otherwise(low + 19).cast("string"))
    return docs.groupBy(label.alias("bucket")).agg(F.count("*").alias("n_docs"))


def duplicate_groups(docs: DataFrame, doc_id: str, text: str, near: bool = False) -> DataFrame:
    """Groups of two documents or more with equal texts: a digest, the first id and the size. near: but for case and white space."""
    key = F.sha2(F.lower(squeeze(F.col(text))) if near else F.col(text), 256)
    return docs.groupBy(key.alias("digest")).agg(F.min(doc_id).alias("first_id"), F.count("*").alias("n_docs")).where("n_docs > 1")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def file_tree(files: DataFrame, path: str = "file_path", root: str = "") -> DataFrame:
    """A row for each file and folder: path, name, parent, depth, is_dir and files below; by parent, folders first, then by name."""
    clean = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.col(path), r"\\", "/"), "^" + root, ""), "/+"), lambda p: ~p.isin("", ".", ".."))
    parts = files.select(clean.alias("p")).where("size(p) > 0")
    nodes = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.struct(F.array_join(F.slice("p", F.lit(1), k), "/").alias("path"), F.get("p", k - 1).alias("name"), F.array_join(F.slice("p", F.lit(1), k - 1), "/").alias("parent"), k.alias("depth"), (k < F.size("p")).alias("is_dir")))).alias("n"))
    return nodes.groupBy("n.path", "n.name", "n.parent", "n.depth", "n.is_dir").agg(F.count("*").alias("n_files")).orderBy("parent", F.desc("is_dir"), "name")


def latest(history: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key; ties in time go to the row that sorts last."""
    rest = [c for c in history.columns if c not in (key, at)]
    return history.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_last")).select(key, "_last.*")


def upserted(old: DataFrame, new: DataFrame, key: str = "file_path", kept: Sequence[str] = ("id", "created_at", "is_favorite")) -> DataFrame:
    """new laid over old by key: of a row in both, the columns in `kept` stay as they were."""
    before, after = old.alias("o"), new.alias("n")
    joined = before.join(after, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in (key, *kept) else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def compared(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with both scores, their difference and the winner; pairs of unknown documents are NOT_EVALUATED."""
    a, b = scores.select(F.col("id").alias("a"), F.col("score").alias("score_a")), scores.select(F.col("id").alias("b"), F.col("score").alias("score_b"))
    delta = F.col("score_a") - F.col("score_b")
    winner = F.when(delta.isNull(), "NOT_EVALUATED").when(delta > 0, "a").when(delta < 0, "b").otherwise("tie")
    return pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"delta": delta, "winner": winner})
