"""The store's operators: favourites, histories, score lookups, counts, invariants, bounded recency, and what may leave it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import redaction

MOST_FINGERPRINTS = 1000
MOST_CHARACTERS = 500


def in_order(docs: DataFrame, key: str = "file_path") -> DataFrame:
    """All documents, by path."""
    return docs.orderBy(key)


def by_id(docs: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The documents of an id: none or one in a store."""
    return docs.where(F.col(key) == F.lit(value))


def favourites(docs: DataFrame) -> DataFrame:
    return docs.where("is_favorite")


def with_favourite(docs: DataFrame, ids: DataFrame, value: bool | None = None, key: str = "id") -> DataFrame:
    """docs with is_favorite set to the value, or turned over if it is None, in the rows whose key is among ids (repeats count once)."""
    named = ids.select(F.struct(key).alias("_at")).distinct().withColumn("_named", F.lit(True))
    joined = docs.withColumn("_at", F.struct(key)).join(named, "_at", "left")
    new = ~F.coalesce("is_favorite", F.lit(False)) if value is None else F.lit(value)
    return joined.withColumn("is_favorite", F.when(F.col("_named"), new).otherwise(F.col("is_favorite"))).select(docs.columns)


def cleared(docs: DataFrame) -> DataFrame:
    """The store without rows."""
    return docs.where("false")


def hydrated(scanned: DataFrame, stored: DataFrame, key: str = "file_path") -> DataFrame:
    """Scanned documents with the favourites of the store, by path; new ones are none."""
    old = stored.groupBy(key).agg(F.max("is_favorite").alias("_old"))
    return scanned.join(old, key, "left").withColumn("is_favorite", F.coalesce("_old", F.lit(False))).select(scanned.columns)


def append(history: DataFrame, path: str) -> None:
    """Adds evaluations to a history; rows are never replaced, and latest() of collections reads the last ones."""
    history.write.mode("append").parquet(path)


def with_scores(docs: DataFrame, evaluations: DataFrame, hygiene: DataFrame, key: str = "id") -> DataFrame:
    """docs with quality_score and hygiene_score, null where there are none. The tables have prompt_id, a score and, for repeats, evaluated_at: the last one counts."""
    one = lambda t, score, name: t.groupBy("prompt_id").agg(F.max_by(score, F.struct("evaluated_at", score)).alias(name)).withColumnRenamed("prompt_id", key)
    return docs.join(one(evaluations, "overall_score", "quality_score"), key, "left").join(one(hygiene, "hygiene_score", "hygiene_score"), key, "left")


def with_hygiene(docs: DataFrame, hygiene: DataFrame, key: str = "id") -> DataFrame:
    """docs with hygiene_status and artifacts of their last check; unchecked ones are clean and have none."""
    last = hygiene.groupBy("prompt_id").agg(F.max_by(F.struct("status", "artifacts"), "evaluated_at").alias("_h")).withColumnRenamed("prompt_id", key)
    joined = docs.join(last, key, "left")
    return joined.withColumns({"hygiene_status": F.coalesce("_h.status", F.lit("clean")), "artifacts": F.coalesce("_h.artifacts", F.lit("[]"))}).drop("_h")


def with_metadata(hits: DataFrame, docs: DataFrame, key: str = "id", columns: Sequence[str] = ("title", "category")) -> DataFrame:
    """Search hits with columns of their documents, never their texts; hits without a document are dropped.

    Which side is sent to all tasks, if any, is left to Spark, which knows a search's limit and measures the rest."""
    return docs.select(key, *columns).join(hits, key)


def vectors_by_model(vectors: DataFrame, model: str = "model") -> DataFrame:
    return vectors.groupBy(model).agg(F.count("*").alias("n"))


def index_report(todo: DataFrame) -> DataFrame:
    """One row: how many documents were indexed, skipped as sensitive, skipped as unchanged, and failed (a null vector). todo: of retrieval.to_reindex(), with vector."""
    is_ = lambda t: F.col("todo") == t
    failed = is_("indexed") & F.col("vector").isNull()
    return todo.agg(F.count_if(is_("indexed") & ~failed).alias("indexed"), F.count_if(is_("skipped_sensitive")).alias("skipped_sensitive"), F.count_if(is_("skipped_unchanged")).alias("skipped_unchanged"), F.count_if(failed).alias("failed"))


RESULTS = ("success", "error", "blocked", "approved", "denied")


def evidence_summary(log: DataFrame) -> DataFrame:
    """One row: how many entries there are, and of each result."""
    return log.agg(F.count("*").alias("total"), *(F.count_if(F.col("result") == r).alias(r) for r in RESULTS))


def missing_families(pairs: DataFrame, families: Sequence[str], family: str = "family_id") -> DataFrame:
    """The families of which no pair is there."""
    wanted = pairs.sparkSession.createDataFrame([(f,) for f in families], f"{family} string")
    return wanted.join(pairs.select(family).distinct(), family, "left_anti")


def violations(prompts: DataFrame, evaluations: DataFrame, hygiene: DataFrame) -> DataFrame:
    """What must hold of results and doesn't: type, reason_code, subject and description.

    prompts: id, content_fingerprint and constraints_before; evaluations: id, result_fingerprint, result_type and constraints_after; hygiene: id. Different numbers of
    rows, results of other texts than the present ones, and constraints that were lost."""
    n = lambda t, name: t.agg(F.count("*").alias(name))
    counts = n(prompts, "p").join(n(evaluations, "e")).join(n(hygiene, "h"))  # one row each
    row = lambda t, code, subject, text: (F.lit(t).alias("type"), code.alias("reason_code"), subject.cast("string").alias("subject"), text.alias("description"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    lengths = counts.where("p != e or p != h").select(*row("LENGTH_MISMATCH", F.lit("ANALYZE_ALL_RESULT_LENGTH_MISMATCH"), F.lit(None), text("Result length mismatch: prompts=", F.col("p"), ", evaluations=", F.col("e"), ", hygiene=", F.col("h"))))
    both = prompts.join(evaluations, "id")
    kinds = {"analysis": "STALE_ANALYSIS_RESULT", "hygiene": "STALE_HYGIENE_RESULT", "context": "STALE_CONTEXT_RESULT", "blueprint": "STALE_BLUEPRINT_RESULT", "gate": "STALE_GATE_CONTEXT", "variant": "STALE_VARIANT_RESULT"}
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("result_type")), F.lit("CONTENT_FINGERPRINT_MISMATCH"))
    stale = both.where("content_fingerprint != '' and result_fingerprint != '' and content_fingerprint != result_fingerprint").select(*row("STALE_RESULT", code, F.col("id"), text("Stale ", F.col("result_type"), " result: content fingerprint changed but old result is still in use")))
    lost = both.where("constraints_before > constraints_after").select(*row("CONSTRAINT_LOST", F.lit("CONSTRAINT_LOST"), F.col("id"), text("Constraint loss detected: ", F.col("constraints_before"), " before, ", F.col("constraints_after"), " after")))
    return lengths.unionByName(stale).unionByName(lost)


def changed(docs: DataFrame, processed: DataFrame, key: str = "id", fingerprint: str = "fingerprint") -> DataFrame:
    """docs whose fingerprint isn't the one that was processed last."""
    old = processed.select(key, F.col(fingerprint).alias("_old"))
    return docs.join(old, key, "left").where(~F.col(fingerprint).eqNullSafe(F.col("_old"))).drop("_old")


def remembered(processed: DataFrame, now: DataFrame, key: str = "id", at: str = "at", most: int = MOST_FINGERPRINTS) -> DataFrame:
    """The last fingerprint of each key of both tables, of the `most` keys that were processed last. That bound is the feature: forgotten documents are only processed again."""
    rest = [c for c in processed.columns if c not in (key, at)]
    last = processed.unionByName(now.select(processed.columns)).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_l")).select(key, "_l.*")
    return last.orderBy(F.desc(at), key).limit(most).select(processed.columns)


def safe_events(events: DataFrame, allowed: Sequence[str], attributes: str = "attributes", root: str = "") -> DataFrame:
    """events with what may be exported of their attributes (a map of strings): allowed keys, values of at most MOST_CHARACTERS without secrets and paths; and omitted, how many were left out.

    Columns message, stack and description, which may hold anything, are dropped."""
    safe = lambda v: redaction.redact_path(redaction.strip_secrets(F.left(v, F.lit(MOST_CHARACTERS))), root)
    keys = F.array(*map(F.lit, allowed)).cast("array<string>")
    kept = F.transform_values(F.map_filter(attributes, lambda k, v: F.array_contains(keys, k) & v.isNotNull()), lambda _, v: safe(v))
    df = events.withColumn("omitted", F.coalesce(F.size(F.map_keys(attributes)), F.lit(0))).withColumn(attributes, kept)
    return df.withColumn("omitted", F.col("omitted") - F.coalesce(F.size(F.map_keys(attributes)), F.lit(0))).drop("message", "stack", "description")


def pasted(spark: SparkSession, text: str | None) -> DataFrame:
    """A pasted text as a document; blank ones are refused."""
    if not (text or "").strip():
        raise ValueError("Bitte füge einen Prompt-Text ein, bevor du die Analyse startest.")
    return spark.createDataFrame([(text.strip(),)], "content string")


def combined_score(quality: Column, hygiene: Column, context: Column) -> Column:
    """Two parts quality, one part hygiene, two parts context; rounded, halves up."""
    return F.floor(0.4 * quality + 0.2 * hygiene + 0.4 * context + 0.5).cast("int")
