"""Quality of a document: twelve dimensions from its features, an overall score, and reported criteria.

Which dimensions count depends on the kind of document (APPLIES), and features can only add to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip, truncate_bytes
from foliant.operators import contradictions
from foliant.operators.features import MODERATE, NONE, STRONG, WEAK, extracted, ladder
from foliant.operators.recommendations import reasons, recommendations

MOST_BYTES = 100_000

# Fixed values. R: required, X: not applicable, a number: optional, and the score where nothing speaks for or against it.
DIMENSIONS = ("Goal", "Context", "Input", "Output", "Constraint", "Actionability", "Ambiguity", "Consistency", "Completeness", "Noise", "Safety", "Reuse")
R, X = -1, -2
APPLIES = {
    "Guideline": (R, R, X, R, R, R, R, R, R, R, X, R),
    "Template": (R, 10, R, R, 10, 8, R, R, R, R, X, R),
    "Translation": (R, 10, R, R, 10, 8, R, R, R, R, X, 8),
    "Summarization": (R, 10, R, R, 10, 8, R, R, R, R, X, 8),
    "Extraction": (R, 10, R, R, 10, 8, R, R, R, R, X, 8),
    "Transformation": (R, 10, R, R, 10, 8, R, R, R, R, X, 8),
    "Classification": (R, 10, R, R, 10, 8, R, R, R, R, X, 8),
    "Generation": (R, R, 8, R, 10, 8, R, R, R, R, X, 8),
    "Planning": (R, R, R, R, R, R, R, R, R, R, X, X),
    "Analysis": (R, R, R, R, 10, 8, R, R, R, R, X, X),
    "Coding": (R, R, R, R, R, 8, R, R, R, R, X, 8),
    "AgentWorkflow": (R, R, R, R, R, R, R, R, R, R, X, 8),
    "GeneralTask": (R, R, X, R, 10, 8, R, R, R, R, X, X),
}
TASK_CRITERIA = {"Zieldefinition": "Goal", "Kontextqualität": "Context", "Eingabendefinition": "Input", "Vorgehensbeschreibung": "Actionability", "Ausgabeformat": "Output", "Qualitätsanforderungen": "Constraint", "Sicherheitsgrenzen": "Safety", "Klarheit": "Ambiguity", "Wiederverwendbarkeit": "Reuse"}
ROLE = "Rollendefinition"
GUIDELINE_CRITERIA = {"Scope/Zweck": ("Goal", "Context"), "Regel-Spezifität": ("Actionability",), "Constraint-Klarheit": ("Constraint",), "Anwendbarkeit": ("Context",), "Output-Disziplin": ("Output",), "Konsistenz/Struktur": ("Consistency", "Ambiguity"), "Sicherheitsgrenzen": ("Safety",), "Wiederverwendbarkeit": ("Reuse",)}
CAPPED_IF_POOR = ("Goal", "Context", "Input", "Output", "Constraint", "Actionability", "Ambiguity", "Completeness", "Noise", "Reuse")
BARE_CAPS = {"Goal": 6.0, "Context": 3.0, "Actionability": 3.0, "Ambiguity": 5.0, "Completeness": 3.0}


def f(name: str) -> Column:
    return F.col(f"features.{name}")


def kind() -> Column:
    """The kind of task, of tasks, else the kind of document."""
    return F.when(F.col("content_kind") == "Task", F.col("prompt_type")).otherwise(F.col("content_kind"))


def by_kind() -> dict[str, Column]:
    """For each dimension, what APPLIES says of the document's kind."""
    table = F.create_map(*(x for k, row in APPLIES.items() for x in (F.lit(k), F.array(*map(F.lit, row)))))
    return {d: F.get(F.element_at(table, kind()), F.lit(i)) for i, d in enumerate(DIMENSIONS)}


def applicability() -> dict[str, Column]:
    """For each dimension: X not applicable, R required, else the neutral score of an optional one."""
    base = by_kind()
    known = {"Goal": f("goal_statement") > NONE, "Context": f("context_substance") > NONE, "Output": f("output_contract") > NONE, "Actionability": f("procedure_steps") > NONE, "Constraint": f("relevant_constraints") + f("boilerplate_constraints") > 0}
    out = {d: F.when(known[d], -1).otherwise(base[d]) if d in known else base[d] for d in DIMENSIONS}
    out["Input"] = F.when(f("placeholder_count") > 0, -1).when((f("input_present") > NONE) & (base["Input"] == X), 8).otherwise(base["Input"])
    out["Safety"] = F.when(f("safety_relevant"), -1).otherwise(-2)
    return out


def spam() -> Column:
    return (f("placeholder_count") >= 5) & (f("referenced_fraction") < 0.8)


def sufficient() -> Column:
    """Whether the document says enough for its kind."""
    guideline, template = F.col("content_kind") == "Guideline", F.col("content_kind") == "Template"
    anchored = (f("task_signal") >= MODERATE) & (f("placeholder_count") > 0) & (f("referenced_fraction") >= 0.5) & (f("goal_statement") >= MODERATE)
    needs_input = F.col("prompt_type").isin("Extraction", "Translation", "Summarization", "Transformation") & (f("input_present") == NONE) & (f("placeholder_count") == 0)
    short = f("atomic_action") & (f("goal_statement") >= MODERATE) & (f("output_contract") >= MODERATE) & ((f("input_present") >= WEAK) | (f("referenced_fraction") >= 0.5)) & (f("filler_ratio") < 0.4) & (f("redundancy") < 0.4)
    return F.when(guideline, True).when(template, (f("referenced_fraction") >= 0.8) & (f("placeholder_quality") >= 0.5) & ~spam()).otherwise(anchored | ((f("task_signal") > NONE) & ~F.coalesce(needs_input, F.lit(False))) | short)


def poor(weight: Column, critical: Column) -> Column:
    few = (f("placeholder_count") > 1) & (f("referenced_fraction") < 0.4)
    return ~sufficient() | (f("filler_ratio") >= 0.4) | (f("redundancy") >= 0.4) | (weight >= 4) | critical | few | spam()


def ladders(app: dict[str, Column], weight: Column, critical: Column) -> dict[str, Column]:
    """Scores before caps. `_poor` is a column."""
    bad, guideline, template = F.col("_poor"), F.col("content_kind") == "Guideline", F.col("content_kind") == "Template"
    neutral = lambda d, low: F.when(bad, low).when(app[d] >= 0, app[d]).otherwise(low)
    limits = f("relevant_constraints") + f("boilerplate_constraints")
    unread = (f("placeholder_count") > 0) & (f("referenced_fraction") < 0.4)
    by_relevant = lambda none: F.when(f("relevant_constraints") >= 2, 9).when(f("relevant_constraints") == 1, 7).otherwise(none)
    noise = ladder(((f("signal_to_noise") >= 0.8) & (f("redundancy") < 0.2) & (f("filler_ratio") < 0.2), 10), (f("signal_to_noise") >= 0.6, 7), (f("signal_to_noise") >= 0.4, 5), (f("signal_to_noise") >= 0.2, 3), default=1)
    noise = noise - F.least(f("boilerplate_severity"), F.lit(2)) - F.when(f("redundancy") >= 0.4, 3).otherwise(0)
    return {
        "Goal": F.when((f("goal_statement") < MODERATE) & ((template & (f("placeholder_count") >= 2)) | guideline), 8).otherwise(ladder((f("goal_statement") == STRONG, 10), (f("goal_statement") == MODERATE, 8), (f("goal_statement") == WEAK, 6), default=1)),
        "Context": F.when(~bad & f("self_contained"), 10).when(f("context_substance") == STRONG, 10).when(f("context_substance") > NONE, 3).otherwise(neutral("Context", 1)),
        "Input": F.when(template & (f("placeholder_count") >= 3) & (f("input_present") < MODERATE), 8).when(unread, 3).when(f("input_present") == STRONG, F.when(f("referenced_fraction") < 0.5, 9).otherwise(10)).when(f("input_present") == MODERATE, 7).when(f("input_present") == WEAK, 5).otherwise(neutral("Input", 1)),
        "Output": F.when((f("output_contract") < MODERATE) & ((template & (f("placeholder_count") >= 3)) | guideline), 8).when(f("output_contract") == STRONG, F.when(f("output_matches_task") < 0.2, 9).otherwise(10)).when(f("output_contract") == MODERATE, 7).when(f("output_contract") == WEAK, 4).otherwise(neutral("Output", 1)),
        "Constraint": F.when(guideline, F.when(f("relevant_constraints") >= 2, 9).otherwise(7)).when(limits == 0, neutral("Constraint", 2)).otherwise(by_relevant(4)),
        "Actionability": F.when(guideline, 8).when(f("procedure_steps") == STRONG, 9).when(f("procedure_steps") == MODERATE, 7).when(f("procedure_steps") == WEAK, 3).when(f("atomic_action"), 8).otherwise(neutral("Actionability", 2)),
        "Ambiguity": ladder((f("redundancy") >= 0.4, 3), (f("redundancy") >= 0.25, 5), (f("atomic_action") & (f("sentence_count") <= 6), 9), (f("sentence_count") <= 6, 8), default=7),
        "Consistency": ladder((critical, 0), (weight == 0, 10), (weight <= 3, 5), (weight <= 5, 3), default=0),
        "Completeness": ladder((((f("placeholder_count") > 0) & (f("referenced_fraction") < 0.5)) | (~f("self_contained") & (f("context_substance") != STRONG)), 3), (f("terse_sufficiency"), 10), (f("output_contract") == STRONG, 9), (f("context_substance") == STRONG, 10), ((f("goal_statement") > NONE) & (f("output_contract") > NONE), 8), default=4),
        "Noise": F.when(f("redundancy") >= 0.3, F.least(noise, F.lit(3))).otherwise(noise),
        "Safety": F.when(f("safety_relevant"), F.when((f("relevant_constraints") > 0) & (f("boilerplate_severity") == 0), 9).otherwise(3)).when(f("boilerplate_severity") > 0, 4).otherwise(neutral("Safety", 2)),
        "Reuse": F.when((f("placeholder_count") > 0) & (f("placeholder_quality") < 0.5), 3).when(f("placeholder_quality") >= 0.8, 9).when(f("placeholder_quality") >= 0.5, 7).when(template, 3).when(bad, 2).when(app["Reuse"] >= 0, app["Reuse"]).otherwise(6),
    }


def capped(d: str, score: Column) -> Column:
    bare = ~F.col("_poor") & ~f("concrete_core") & (f("context_substance") != STRONG) & (F.col("content_kind") == "Task")
    if d in CAPPED_IF_POOR:
        score = F.when(F.col("_poor"), F.least(score, F.lit(3))).otherwise(score)
    if d in BARE_CAPS:
        score = F.when(bare, F.least(score, F.lit(BARE_CAPS[d]))).otherwise(score)
    if d == "Constraint":
        score = F.when(bare & (f("relevant_constraints") + f("boilerplate_constraints") == 0), F.least(score, F.lit(2))).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), score.cast("double")))


def evaluated(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with dimensions (name, score, applicable), overall_score, criteria, missing_sections, recommendations and na_reasons, besides the columns of
    features and of contradictions.

    Texts count up to MOST_BYTES; blank ones score 0, miss everything and get no advice. Columns of the same names are replaced."""
    df = contradictions.detected(docs.withColumn("_text", truncate_bytes(F.coalesce(F.col(text), F.lit("")), MOST_BYTES)), "_text")
    df = extracted(df.withColumns({"_w": F.col("conflict_weight"), "_c": F.col("has_critical_conflict")}), "_text")
    df = df.withColumn("_poor", poor(F.col("_w"), F.col("_c"))).withColumn("_app", F.struct(*(c.alias(d) for d, c in applicability().items())))
    app = {d: F.col(f"_app.{d}") for d in DIMENSIONS}
    scores = ladders(app, F.col("_w"), F.col("_c"))
    df = df.withColumn("_s", F.struct(*(capped(d, scores[d]).alias(d) for d in DIMENSIONS)))
    blank = strip(F.col("_text")) == ""
    dims = F.array(*(F.struct(F.lit(d).alias("name"), F.col(f"_s.{d}").alias("score"), (app[d] != X).alias("applicable")) for d in DIMENSIONS))
    total = F.aggregate(F.filter(dims, lambda x: x["applicable"]), F.lit(0.0), lambda a, x: a + x["score"])
    mean = total / F.greatest(F.size(F.filter(dims, lambda x: x["applicable"])), F.lit(1))
    overall = F.round(mean * 10).cast("int")
    overall = F.when((F.col("_w") >= 6) | F.col("_c"), F.least(overall, F.lit(45))).otherwise(overall)
    df = df.withColumn("dimensions", dims).withColumn("overall_score", F.when(blank, 0).otherwise(overall))
    df = df.withColumn("criteria", F.when(blank, no_content()).when(F.col("content_kind") == "Task", task_criteria(app)).otherwise(guideline_criteria()))
    counts = {d: app[d] != X for d in DIMENSIONS}
    advice = recommendations({d: F.col(f"_s.{d}") for d in DIMENSIONS}, counts, f, F.col("language"), F.col("conflicts"))
    df = df.withColumns({"recommendations": F.when(blank, F.expr("cast(array() as array<string>)")).otherwise(advice), "na_reasons": reasons({d: c == X for d, c in by_kind().items()}, kind())})
    missing = F.filter("criteria", lambda c: (c["name"] != ROLE) & (c["score"] < 3) & c["applicable"])
    everything = F.array(*(F.lit(n) for n in (ROLE, *TASK_CRITERIA)))
    return df.withColumn("missing_sections", F.when(blank, everything).otherwise(F.transform(missing, lambda c: c["name"]))).drop("_text", "_w", "_c", "_poor", "_app", "_s")


def criterion(name: str, score: Column, weight: Column, applicable: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.round(score).cast("int").alias("score"), F.lit(10).alias("max_score"), weight.cast("double").alias("weight"), applicable.alias("applicable"))


def no_content() -> Column:
    return F.array(*(criterion(n, F.lit(0.0), F.lit(0.1), F.lit(True)) for n in (ROLE, *TASK_CRITERIA)))


def task_criteria(app: dict[str, Column]) -> Column:
    n = sum(((app[d] != X).cast("int") for d in TASK_CRITERIA.values()), F.lit(0))
    role = criterion(ROLE, ladder((f("role_present") == STRONG, 10.0), (f("role_present") == MODERATE, 7.0), (f("role_present") == WEAK, 4.0), default=2.0), F.lit(0.0), F.lit(True))
    weight = lambda d: F.when(app[d] != X, 1 / F.greatest(n, F.lit(1))).when(n == 0, 0.1).otherwise(0.0)
    return F.array(role, *(criterion(name, F.col(f"_s.{d}"), weight(d), app[d] != X) for name, d in TASK_CRITERIA.items()))


def guideline_criteria() -> Column:
    return F.array(*(criterion(name, sum((F.col(f"_s.{d}") for d in ds), F.lit(0.0)) / len(ds), F.lit(1 / 8), F.lit(True)) for name, ds in GUIDELINE_CRITERIA.items()))
