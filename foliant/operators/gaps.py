"""Questions that a document leaves open: collected from its evaluations, ranked by need, and answers merged into the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import squeeze, strip
from foliant.operators.context import AR, CE, PE, by_name, first_by
from foliant.operators.redaction import sanitize_answer

# Texts, and how many questions of a tier are asked.
QUESTIONS = {
    "zieldefinition": "Was ist das Ziel dieses Prompts?", "zielgruppe": "Wer ist die Zielgruppe dieses Prompts?", "ausgabeformat": "In welchem Format soll die Ausgabe erfolgen?",
    "constraints": "Welche Constraints oder Einschränkungen gelten?", "kontext": "Welcher Kontext oder Hintergrund ist relevant?", "quellenangaben": "Welche Quellen sollen verwendet werden?",
    "annahmen": "Welche Annahmen liegen zugrunde?", "sicherheitsregeln": "Welche Sicherheits- oder Datenschutzregeln gelten?", "toolauswahl": "Welche Tools sind erlaubt oder ausgeschlossen?", "versionsangaben": "Welche Versionen oder Stände sind relevant?",
}
CLEANING = ("Artefaktbereinigung", "Der Prompt enthält Artefakte. Sollen diese vor der Optimierung bereinigt werden?")
TIERS = {"REQUIRED": 5, "RECOMMENDED": 7, "OPTIONAL": 10}
HEADING = "## Ergänzte Informationen (Missing-Info-Gate)"
LOW_HYGIENE = 50
MANY_POINTS, SHORT, FEW = 95, 50, 3


def item(source: Column | str, label: Column, question: Column, rationale: Column, kind: str = "free_text", **known: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    null = lambda n, t: known.get(n, F.lit(None)).cast(t).alias(n)
    return F.struct(as_column(source).alias("source"), label.alias("label"), question.alias("question"), rationale.alias("rationale"), F.lit(kind).alias("input_type"), null("severity", "string"))


def asked(label: Column) -> Column:
    return F.coalesce(by_name(QUESTIONS, F.lower(squeeze(label))), F.concat(F.lit("Bitte ergänzen: "), label))


def detected(df: DataFrame, name: str = "gaps") -> DataFrame:
    """df with its open questions: id, source, label, question, rationale, input_type, and the severity of a risk.

    df has the columns of context.evaluated() (missing_elements, risk_flags, criteria, suggested_improvements, overall_score), hygiene_score, blueprint_missing
    (null where no blueprint was evaluated), contamination_status and content_length. Of equal labels the first question is asked. Nothing is asked of
    empty texts, of texts with secrets and of those with more than MANY_POINTS; texts shorter than SHORT get FEW questions at most."""
    source = lambda d: F.when(d == AR, AR).when(d == CE, CE).otherwise(PE)
    named = lambda array: F.filter(F.transform(F.coalesce(array, F.expr("cast(array() as array<string>)")), strip), lambda x: x != "")
    missing = F.transform(named(F.col("missing_elements")), lambda x: item(PE, x, asked(x), F.lit("Dieses Element fehlt in der Prompt-Analyse.")))
    risks = F.transform("risk_flags", lambda r: item("risk_flag", r["flag"], r["message"], F.concat(F.lit("Risiko ("), r["severity"], F.lit("): "), r["message"]), severity=r["severity"]))
    criteria = F.transform(F.filter("criteria", lambda c: c["score"] == 0), lambda c: item(
        source(c["dimension"]), c["name"], F.concat(F.lit('Das Kriterium "'), c["name"], F.lit('" wurde mit 0 bewertet. '), F.coalesce(F.nullif(c["details"], F.lit("")), F.lit("Bitte ergänzen Sie die fehlenden Informationen."))),
        F.concat(F.lit('Kriterium "'), c["name"], F.lit('" hat Score 0/'), c["max_score"].cast("string"), F.lit(".")),
    ))
    better = F.transform("suggested_improvements", lambda a: item(source(a["dimension"]), a["criterion"], a["message"], F.concat(F.lit("Verbesserungsvorschlag ("), a["priority"], F.lit("): "), a["message"])))
    blueprint = F.transform(named(F.col("blueprint_missing")), lambda x: item("blueprint", x, asked(x), F.lit("Dieses Element fehlt im Blueprint.")))
    cleaning = item("hygiene", F.lit(CLEANING[0]), F.lit(CLEANING[1]), F.concat(F.lit("Hygiene-Score ist niedrig ("), F.col("hygiene_score").cast("string"), F.lit(").")), "boolean")
    none = F.filter(missing, lambda x: F.lit(False))
    hygiene = F.when(F.col("hygiene_score") < LOW_HYGIENE, F.array(cleaning)).otherwise(none)
    numbered = lambda x, i: F.struct(F.concat(F.lit("MISS_"), F.upper(F.left(x["source"], F.lit(3))), F.lit("_"), F.lpad((i + 1).cast("string"), 3, "0")).alias("id"), *(x[f].alias(f) for f in ("source", "label", "question", "rationale", "input_type", "severity")), F.lower(squeeze(x["label"])).alias("_key"))
    df = df.withColumn("_gaps", F.concat(missing, risks, criteria, better, blueprint, hygiene)).withColumn("_gaps", F.transform("_gaps", numbered)).withColumn("_gaps", first_by("_gaps", "_key"))
    silent = (F.coalesce("content_length", F.lit(1)) == 0) | F.coalesce(F.col("contamination_status") == "BLOCKING_SENSITIVE_CONTENT", F.lit(False)) | (F.col("overall_score") > MANY_POINTS)
    most = F.when(silent, 0).when(F.col("content_length") < SHORT, FEW).otherwise(F.size("_gaps"))
    return df.withColumn(name, F.transform(F.slice("_gaps", F.lit(1), most), lambda x: x.dropFields("_key"))).drop("_gaps")


def classified(df: DataFrame, gaps: str = "gaps", name: str = "questions") -> DataFrame:
    """df with its questions by need (REQUIRED, RECOMMENDED, OPTIONAL; within a tier in their order, at most as many as TIERS says) and overflow, how many more of each tier there are.

    df has the columns that detected() needs, detected_prompt_type and detected_context_profile."""
    simple, agentic, minimal = F.col("detected_prompt_type") == "simple_prompt", F.col("detected_prompt_type") == "agentic_prompt", F.col("detected_context_profile") == "minimal"

    def tier(x: Column) -> tuple[Column, Column]:
        of = lambda s: x["source"] == s
        judged = x["source"].isin(PE, CE, AR)
        criterion = F.get(F.filter("criteria", lambda c: judged & (c["name"] == x["label"])), F.lit(0))
        improvement = F.get(F.filter("suggested_improvements", lambda a: judged & (a["criterion"] == x["label"])), F.lit(0))
        score = F.coalesce(criterion["score"], F.lit(-1))
        rules = (
            (of("risk_flag") & (x["severity"] == "critical"), "REQUIRED", "Risk flag severity is critical → REQUIRED"),
            (of("risk_flag") & (x["severity"] == "high"), "REQUIRED", "Risk flag severity is high → REQUIRED"),
            (of(PE) & (score == 0) & ~simple & (criterion["dimension"] == PE), "REQUIRED", "PE criterion score is 0 and prompt is not simple → REQUIRED"),
            (of(AR) & (score == 0) & agentic, "REQUIRED", "AR criterion score is 0 and prompt is agentic → REQUIRED"),
            (of("risk_flag") & (x["severity"] == "medium"), "RECOMMENDED", "Risk flag severity is medium → RECOMMENDED"),
            (of(CE) & (score == 0) & minimal, "RECOMMENDED", "CE criterion score is 0 and context is minimal → RECOMMENDED"),
            (of("blueprint"), "RECOMMENDED", "Blueprint missing element → RECOMMENDED"),
            (of("hygiene") & (F.col("hygiene_score") < LOW_HYGIENE), "RECOMMENDED", F.concat(F.lit("Hygiene score is low ("), F.col("hygiene_score").cast("string"), F.lit(") → RECOMMENDED"))),
            (of(PE) & (score == 1), "OPTIONAL", "PE criterion score is 1 → OPTIONAL"), (of(CE) & (score == 1), "OPTIONAL", "CE criterion score is 1 → OPTIONAL"),
            (of("risk_flag") & (x["severity"] == "low"), "OPTIONAL", "Risk flag severity is low → OPTIONAL"), (improvement.isNotNull(), "OPTIONAL", "Suggested improvement → OPTIONAL"),
        )
        which, why = F, F
        for condition, t, reason in rules:
            condition = F.coalesce(condition, F.lit(False))
            which, why = which.when(condition, t), why.when(condition, reason)
        return which.otherwise("OPTIONAL"), why.otherwise("Standard: keine spezifische Regel → OPTIONAL")

    def ranked(x: Column) -> Column:
        t, why = tier(x)
        return F.struct(*(x[f].alias(f) for f in ("id", "source", "label", "question", "rationale", "input_type")), t.alias("tier"), why.alias("reason"))

    df = df.withColumn("_ranked", F.transform(gaps, ranked))
    of = lambda t: F.filter("_ranked", lambda x: x["tier"] == t)
    df = df.withColumn(name, F.concat(*(F.slice(of(t), 1, most) for t, most in TIERS.items())))
    return df.withColumn("overflow", F.struct(*(F.greatest(F.size(of(t)) - most, F.lit(0)).alias(t.lower()) for t, most in TIERS.items()))).drop("_ranked")


def merged(df: DataFrame, content: str = "content", items: str = "questions", answers: str = "answers", skipped: str = "skipped", outcome: str = "outcome") -> DataFrame:
    """df with enriched_content, answered_count, assumed_count and skipped_count.

    items: array of structs with id and label; answers: array of (item_id, value), the last of an item counts; skipped: array of ids; outcome: COMPLETED, ASSUMPTIONS or
    SKIPPED, which changes nothing. Answers are cleaned before they become lines of a section behind the text. Null arrays are empty."""
    empty = F.expr("cast(array() as array<struct<item_id: string, value: string>>)")
    given = F.filter(F.coalesce(F.col(answers), empty), lambda a: F.coalesce(strip(a["value"]) != "", F.lit(False)))
    passed = F.coalesce(F.col(skipped), F.expr("cast(array() as array<string>)"))
    assumed = F.col(outcome) == "ASSUMPTIONS"

    def line(x: Column) -> Column:
        value = sanitize_answer(F.element_at(F.filter(F.concat(F.array(F.struct(x["id"].alias("item_id"), F.lit("").alias("value"))), given), lambda a: a["item_id"] == x["id"]), -1)["value"])
        label = F.concat(F.lit("- **"), x["label"], F.lit(":** "))
        answered = F.struct(F.lit("answered").alias("kind"), F.concat(label, value, F.when(assumed, " _(Annahme)_").otherwise("")).alias("line"))
        return F.when(value != "", answered).when(F.array_contains(passed, x["id"]), F.struct(F.lit("skipped").alias("kind"), F.concat(label, F.lit("*übersprungen*")).alias("line")))

    df = df.withColumn("_lines", F.when(F.col(outcome) == "SKIPPED", F.expr("cast(array() as array<struct<kind: string, line: string>>)")).otherwise(F.array_compact(F.transform(items, line))))
    count = lambda kind: F.size(F.filter("_lines", lambda x: x["kind"] == kind))
    section = F.concat(F.regexp_replace(F.col(content), r"(?U)\s+\z", ""), F.lit("\n\n" + HEADING + "\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    return df.withColumns({
        "enriched_content": F.when(F.size("_lines") > 0, section).otherwise(F.col(content)), "answered_count": count("answered"), "assumed_count": F.when(assumed, count("answered")).otherwise(0),
        "skipped_count": F.when(F.col(outcome) == "SKIPPED", F.size(passed)).otherwise(count("skipped")),
    }).drop("_lines")
