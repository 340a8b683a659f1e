"""The engine's actions by name: each takes a DataFrame of documents (id, content and what it needs besides) and returns one.

    from foliant.actions import ACTIONS
    ACTIONS["prompts.score"](docs)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.functions.text import strip, utf16_length
from foliant.operators import blueprints, collections, context, hygiene, quality, restructure, store
from foliant.sources import exports

LONG = 50_000


def search(docs: DataFrame, query: str, filters: collections.Filters | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the documents that mention the query in title, category, tags, content or description, by path, with total, how many there are."""
    kept = collections.filtered(docs, filters or collections.Filters()).where(collections.mentions(query, ("title", "category", "content", "description"), "tags"))
    return collections.page(kept, ("file_path",), limit, offset).withColumn("total", F.lit(kept.count()))


def get(docs: DataFrame, value: object) -> DataFrame:
    """The document of an id; it must be there."""
    found = store.by_id(docs, value)
    if found.isEmpty():
        raise KeyError(f"Prompt nicht gefunden: {value}")
    return found


def score(docs: DataFrame, text: str = "content") -> DataFrame:
    """docs with quality_score, hygiene_score, context_score and the combined score.

    What an analysis gives is written before the next begins, as one plan of all three takes minutes to optimise."""
    keep, spark = docs.columns, docs.sparkSession
    cut = lambda df: storage.written(df, storage.fresh(spark, "scores"))
    df = cut(quality.evaluated(docs, text).select(*keep, F.col("overall_score").alias("quality_score")))
    df = cut(hygiene.analyze(df, text).select(*keep, "quality_score", "hygiene_score"))
    df = context.evaluated(df, text).select(*keep, "quality_score", "hygiene_score", F.col("overall_score").alias("context_score"))
    return df.withColumn("score", store.combined_score(F.col("quality_score"), F.col("hygiene_score"), F.col("context_score")))


def detect_artifacts(docs: DataFrame, text: str = "content") -> DataFrame:
    """docs with artifacts, hygiene_score, hygiene_status and the distinct categories."""
    return hygiene.analyze(docs, text).withColumn("categories", F.array_sort(F.array_distinct(F.transform("artifacts", lambda a: a["category"]))))


def optimize(docs: DataFrame, mode: str = "balanced", text: str = "content") -> DataFrame:
    """docs with optimized, changes and warnings, and the context scores before and after, where both texts say something."""
    return _rewritten(docs, mode, text, "prompt", lambda df, t: context.evaluated(df, t).withColumnRenamed("overall_score", "_score"))


def blueprint_optimize(docs: DataFrame, mode: str = "balanced", text: str = "content") -> DataFrame:
    """As optimize(), by the blueprint's sections and scores; an empty result keeps the score before."""
    return _rewritten(docs, mode, text, "blueprint", lambda df, t: blueprints.evaluated(df, t).withColumnRenamed("blueprint_score", "_score"))


def _rewritten(docs: DataFrame, mode: str, text: str, kind: str, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    keep = [*docs.columns, "optimized", "changes", "warnings", "contamination_cleaned"]
    df = docs.withColumn("_r", restructure.optimized(F.col(text), mode, kind)).select(*docs.columns, "_r.*")
    df = judge(df, text).select(*keep, F.col("_score").alias("score_before"))
    df = judge(df, "optimized").select(*keep, "score_before", F.col("_score").alias("score_after"))
    both = (strip(F.coalesce(F.col(text), F.lit(""))) != "") & (strip("optimized") != "")
    if kind == "blueprint":
        return df.withColumn("score_after", F.when(strip("optimized") != "", F.col("score_after")).otherwise(F.col("score_before")))
    return df.withColumns({c: F.when(both, F.col(c)) for c in ("score_before", "score_after")})


def create(docs: DataFrame | None, folder: str, title: str, tags: Sequence[str] | None = None) -> str:
    """Where a new document would be written; nothing is written."""
    return exports.new_file(title, folder)


def paste_analysis(docs: DataFrame, text: str = "content") -> DataFrame:
    """docs with their class, context evaluation, blueprint_score (of blueprints, hybrids and guidelines) and notes for the user. Blank texts are left out."""
    df = docs.withColumn(text, strip(F.coalesce(F.col(text), F.lit("")))).where(F.col(text) != "")
    df = context.evaluated(blueprints.evaluated(df, text), text)
    like = F.col("content_class").isin("BLUEPRINT", "PROMPT_BLUEPRINT_HYBRID", "GUIDELINE")
    size = utf16_length(F.col(text))
    notes = F.array_compact(F.array(
        F.when(size > LONG, F.concat(F.lit("Der eingefügte Text ist sehr lang ("), F.format_number(size, 0), F.lit(" Zeichen). Die Analyse kann etwas dauern."))),
        F.when(F.size("contamination_signals") > 0, F.concat(F.lit("Kontaminationshinweise erkannt: "), F.array_join("contamination_signals", ", "), F.lit("."))),
        F.when(F.col("contamination_status") == "BLOCKING_SENSITIVE_CONTENT", "Der Text enthält möglicherweise sensible Daten (Secrets, PII). Keine Daten werden gespeichert."),
    ))
    return df.withColumns({"blueprint_score": F.when(like, F.col("blueprint_score")), "content_length": size, "notes": notes})


def load_fixture(docs: DataFrame | None, folder: str, name: str) -> DataFrame:
    return exports.load_fixture(docs.sparkSession if docs is not None else SparkSession.active(), folder, name)


def compare(docs: DataFrame, pairs: DataFrame, text: str = "content") -> DataFrame:
    """pairs (a, b) of ids with both combined scores, their difference and the winner."""
    return collections.compared(score(docs, text).select("id", "score"), pairs)


ACTIONS: dict[str, Callable] = {
    "prompts.search": search, "prompts.get": get, "prompts.score": score, "prompts.detect_artifacts": detect_artifacts, "prompts.optimize": optimize, "prompts.create": create, "prompts.update": create,
    "collections.list": collections.by_category, "qa.load_fixture": load_fixture, "qa.compare_score": compare, "blueprints.detect": lambda docs, text="content": blueprints.classified(docs, text),
    "blueprints.evaluate": lambda docs, text="content": blueprints.evaluated(docs, text), "blueprints.optimize": blueprint_optimize,
}


def run(name: str, docs: DataFrame, **arguments: object) -> DataFrame:
    """An action by its name; unknown names are refused."""
    if name not in ACTIONS:
        raise KeyError(f"Unknown action: {name}")
    return ACTIONS[name](docs, **arguments)


def routes(spark: SparkSession, folder: str, roots: Sequence[str] | None = None) -> dict[str, Callable[..., DataFrame]]:
    """What the server's routes answer, over the documents of a folder that may be scanned."""
    from foliant.sources import files

    real = exports.checked_root(folder, tuple(roots) if roots is not None else None)
    docs = lambda: files.scan(spark, real)
    return {
        "/health": lambda: spark.createDataFrame([("ok",)], "status string"), "/scan": docs, "/prompts": docs, "/prompts/:id": lambda value: get(docs(), value), "/prompts/:id/analyze": lambda value: score(get(docs(), value)),
        "/favorites": lambda: store.favourites(docs()), "/favorites/:id/toggle": lambda ids: store.with_favourite(docs(), ids), "/prompts/:id/context": lambda value: context.evaluated(get(docs(), value), "content"),
        "/evidence/:id": lambda log, value: log.where(F.col("prompt_id") == value), "/export": lambda kind="json": exports.served(docs(), kind)[0],
    }
