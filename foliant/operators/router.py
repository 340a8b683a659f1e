"""Routes documents: guideline, template, or one of eleven kinds of task; and their language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.gates import Gates
from foliant.functions.text import alternation, let, router_sentences, strip, stripped
from foliant.operators import lexicons as lex

# Expressions that results depend on.
ACTION = rf"\b(?:{'|'.join(lex.ACTION_STEMS_DE + lex.ACTION_STEMS_EN)})\w*"
GENERATION_VERB = r"\b(?:write|create|generate|schreib|erstell|generier)\w*"
PLACEHOLDER = r"\{\w+\}"
LABELED_FIELD = r"(?im)^\s*[-*]\s*[A-Za-zÄÖÜäöü0-9 ]+:\s*\{\{?\w+\}?\}\s*$"
FILL_INSTRUCTION = r"(?i)(?:fill (?:every|each)|fülle jedes|füllen sie|write nothing|schreibe nichts|write unknown|schreibe unbekannt|unbekannt)"
MODAL_RULE = r"(?i)\b(?:must|should|shall|always|never|soll\w*|muss\w*|immer|nie)\b"
TASKS = {
    "Translation": r"(?:\bübersetz\w*\b|\btranslate\w*\b|ins deutsche|ins englische|to english|to german|into english)",
    "Summarization": r"(?:\bfass\w* zusammen\b|\bsummar\w*\b|kernaussagen|zusammenfassung|three sentences|3 sätze)",
    "Extraction": r"(?:\bextrahier\w*\b|\bextract\w*\b|\bentnimm\w*\b|pull out|extrahiere|\blist\w*\b|\bidentif\w*\b|\bfind\w*\b|\breturn\w*\b|\benumerat\w*\b|\bcollect\w*\b|\bselect\w*\b|\bretriev\w*\b|\bshow\w*\b|\boutput\w*\b|\bliste\w*\b|\bidentifizier\w*\b|\bfinde\w*\b|\bgib\w*\b|\bnenn\w*\b|\bermittel\w*\b|\bzeig\w*\b)",
    "Classification": r"(?:\bklassifizier\w*\b|\bclassify\w*\b|\bkategorisier\w*\b|\blabel\w*\b|\bkategorisiere\b)",
    "Transformation": r"(?:\bkonvertier\w*\b|\bconvert\w*\b|\brewrit\w*\b|\brefactor\w*\b|\brename\w*\b|\bnormalize\w*\b|\bübertrag\w*\b|\btransform\w*\b)",
    "Generation": None,  # by sentences, see task_scores()
    "Planning": r"(?:\bplan\w*\b|roadmap|migration plan|rollback plan|schritte|step-by-step plan)",
    "Analysis": r"(?:\banalys\w*\b|\banalyz\w*\b|\breview\w*\b|\bprüf\w*\b|\buntersuche\w*\b|\binspect\w*\b|\baudit\w*\b)",
    "Coding": r"(?:\bcode\w*\b|\bfunction\w*\b|\bscript\w*\b|\bimplement\w*\b|\bprogramm\w*\b|\bpython\b|\brust\b|\btypescript\b|\bjavascript\b|\bfunktion\w*\b|write a function)",
    "AgentWorkflow": r"(?:\bagent\w*\b|\bautomate\w*\b|\bworkflow\w*\b|\bautonom\w*\b|\bschleife\w*\b|\bloop\w*\b|execute sequentially|multi-step)",
}

IMPERATIVES = (*lex.IMPERATIVES_DE, *lex.IMPERATIVES_EN)
NOUNS, POLICIES, MARKERS = tuple(lex.ARTIFACT_NOUNS), tuple(lex.POLICY_TERMS), tuple(lex.TEMPLATE_MARKERS)
#: What is gated by the document, by its sentences and by its lines, as long documents have the words of all.
GATES = Gates(IMPERATIVES, POLICIES, MARKERS, ascii_blanks=False)
BY_SENTENCE = Gates(ACTION, GENERATION_VERB, NOUNS, *(p for p in TASKS.values() if p), ascii_blanks=False)
BY_LINE = Gates(IMPERATIVES, ascii_blanks=False)


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit("(?U)" + pattern))


def has(x: Column, pattern: str) -> Column:
    return x.rlike("(?U)" + pattern)


def language(text: Column) -> Column:
    """De, En, or Mixed for a tie: by how many stopwords occur anywhere, each once."""
    number = lambda low, words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    more = let(F.lower(text), lambda low: number(low, lex.STOPWORDS_DE) - number(low, lex.STOPWORDS_EN))
    return let(more, lambda n: F.when(n > 0, "De").when(n < 0, "En").otherwise("Mixed"))


def lines(text: Column) -> Column:
    return stripped(text, F.split(text, r"\r?\n", -1))


def prepared(docs: DataFrame, text: Column, name: str = "_r") -> DataFrame:
    """docs with what the expressions below read more than once, as a struct: the text, its lines, its sentences, and what gates the text, each sentence and each line."""
    df = docs.withColumn(name, F.struct(text.alias("text"), lines(text).alias("lines"), router_sentences(text).alias("sents")))
    found = {"gate": GATES.passed(F.col(f"{name}.text")), "sent_gates": BY_SENTENCE.passed_each(F.col(f"{name}.sents")), "line_gates": BY_LINE.passed_each(F.col(f"{name}.lines"))}
    df = df.withColumns({name + n: c for n, c in found.items()})
    return df.withColumn(name, F.struct(f"{name}.*", *(F.col(name + n).alias(n) for n in found))).drop(*(name + n for n in found))


def gated_sentences(r: str, holds: Callable[[Column, Callable[[str | tuple[str, ...]], Column]], Column]) -> Column:
    """The sentences for which holds(sentence, may) is true; may tells whether the sentence passes a gate of BY_SENTENCE."""
    return F.filter(F.col(f"{r}.sents"), lambda s, i: holds(s, lambda x: BY_SENTENCE.may(F.get(F.col(f"{r}.sent_gates"), i), x)))


def guideline_score(r: str) -> Column:
    """Points for guideline headings, imperative lines, policy terms and rule-like sentences; with what the decision needs besides. r: of prepared()."""
    text, rows, gate = (F.col(f"{r}.{c}") for c in ("text", "lines", "gate"))
    marked = F.when(F.contains(text, F.lit("#")), F.filter(rows, lambda x: F.startswith(x, F.lit("#")))).otherwise(F.expr("cast(array() as array<string>)"))
    headings = F.filter(F.transform(marked, lambda x: F.struct(strip(F.regexp_replace(x, "^#", "")).alias("h"), (F.startswith(x, F.lit("# "))).alias("first"))), lambda s: s["h"] != "")
    names = alternation(x.lower() for x in lex.GUIDELINE_HEADINGS)
    canonical = lambda s: has(F.lower(s["h"]), rf"^{names}(?:\s|\z)") | (s["first"] & has(F.lower(s["h"]), rf"(?:^|\s){names}\z"))
    compound = lambda s: F.lower(s["h"]).rlike(rf"{alternation(lex.COMPOUND_HEADING_SUFFIXES)}\z")
    number = lambda array, f: F.size(F.filter(array, f))
    opener = rf"(?i){alternation(lex.IMPERATIVES_DE + lex.IMPERATIVES_EN)}(?![\p{{L}}\p{{N}}])"
    marker = r"(?:[-*] |[0-9]+[.)] *(?=[^ ]))"
    commands = GATES.may(gate, IMPERATIVES)
    may = lambda i: BY_LINE.may(F.get(F.col(f"{r}.line_gates"), i), IMPERATIVES)
    bullets = F.when(commands, number(rows, lambda x, i: may(i) & has(x, rf"^{marker}{opener}"))).otherwise(0)
    plain = F.when(commands, number(rows, lambda x, i: may(i) & has(x, rf"^{opener}") & ~has(x, rf"^{marker}") & has(x, r"\s\S"))).otherwise(0)
    by_heading = number(headings, canonical)
    policy = F.when(GATES.may(gate, POLICIES), F.least(count(F.lower(text), alternation(x.lower() for x in lex.POLICY_TERMS)) * 0.5, F.lit(1.0))).otherwise(0.0)
    modal = F.when(by_heading > 0, number(F.col(f"{r}.sents"), lambda s: has(s, MODAL_RULE))).otherwise(0)
    points = by_heading * 1.0 + number(headings, compound) * 0.8 + (bullets + plain + modal) * 0.6 + policy
    return F.struct(points.alias("points"), F.size(headings).alias("headings"), bullets.alias("bullets"))


def actions(r: str) -> Column:
    """How many sentences ask for an action."""
    return F.size(gated_sentences(r, lambda s, may: may(ACTION) & has(s, ACTION)))


def task_scores(r: str) -> Column:
    """Matches are counted by sentences, as none goes beyond one."""
    both = F.size(gated_sentences(r, lambda s, may: may(GENERATION_VERB) & may(NOUNS) & has(s, GENERATION_VERB) & has(s, rf"\b{alternation(lex.ARTIFACT_NOUNS)}\b")))
    number = lambda p: F.aggregate(gated_sentences(r, lambda s, may: may(p)), F.lit(0), lambda a, s: a + count(F.lower(s), p))
    return F.array(*(F.struct((both if p is None else number(p)).cast("int").alias("score"), F.lit(name).alias("name")) for name, p in TASKS.items()))


def routed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with content_kind (Guideline, Template, Task), prompt_type (of tasks), language and route_confidence."""
    t = F.col("_r.text")
    df = prepared(docs, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_g": guideline_score("_r"), "_acts": actions("_r"), "_tasks": task_scores("_r")})
    lifted = (F.col("_g.points") < 2) & (F.col("_g.bullets") >= 3) & (F.col("_g.headings") == 0) & ~F.contains(t, F.lit("{"))
    df = df.withColumn("_points", F.col("_g.points") + F.when(lifted, 1.5).otherwise(0.0))
    guideline = (F.col("_points") >= 2) & ~((F.col("_acts") == 1) & (F.col("_g.headings") == 0) & (F.col("_g.bullets") <= 1))
    filled = F.greatest(F.size(F.filter("_r.lines", lambda x: x != "")), F.lit(1))
    braces = F.contains(t, F.lit("{"))
    number = lambda p: F.when(braces, count(t, p)).otherwise(0)
    marker = GATES.may(F.col("_r.gate"), MARKERS) & F.lower(t).rlike(alternation(x.lower() for x in lex.TEMPLATE_MARKERS))
    df = df.withColumns({"_fields": number(LABELED_FIELD), "_marks": (number(PLACEHOLDER) / filled >= 0.3).cast("int") + marker.cast("int")})
    marks, fields = F.col("_marks") + (F.col("_fields") >= 3).cast("int"), F.col("_fields")
    template = ((marks >= 2) | ((fields >= 2) & has(F.lower(t), FILL_INSTRUCTION))) & (F.col("_points") < 2)
    kind = F.when(guideline, "Guideline").when(template, "Template").otherwise("Task")
    top = F.array_max(F.transform("_tasks", lambda s: s["score"]))
    best = F.filter("_tasks", lambda s: s["score"] == top)
    second = F.coalesce(F.get(F.sort_array(F.transform("_tasks", lambda s: s["score"]), asc=False), F.lit(1)), F.lit(0))
    task = F.when((top > 0) & (F.size(best) == 1), F.get(best, F.lit(0))["name"]).otherwise("GeneralTask")
    df = df.withColumns({"content_kind": kind, "_task": task, "_top": top, "_second": second})
    of_kind = lambda k: F.col("content_kind") == k
    sure = F.when(of_kind("Guideline"), F.least(F.col("_points") / 4, F.lit(1.0))).when(of_kind("Template"), F.least(marks / 3, F.lit(1.0))).when(F.col("_top") > 0, F.least(0.5 + (F.col("_top") - F.col("_second")) / F.col("_top"), F.lit(1.0))).otherwise(0.3)
    df = df.withColumns({"prompt_type": F.when(of_kind("Task"), F.col("_task")), "language": language(t), "route_confidence": sure})
    return df.drop("_r", "_g", "_acts", "_tasks", "_points", "_fields", "_marks", "_task", "_top", "_second")


def with_is_guideline(docs: DataFrame, text: Column, name: str = "is_guideline") -> DataFrame:
    """docs with whether routed() would call a text a guideline; what costs most is looked at last."""
    df = prepared(docs, text, "_r").withColumn("_g", guideline_score("_r"))
    lifted = (F.col("_g.points") < 2) & (F.col("_g.bullets") >= 3) & (F.col("_g.headings") == 0) & ~F.contains("_r.text", F.lit("{"))
    points = F.col("_g.points") + F.when(lifted, 1.5).otherwise(0.0)
    found = (points >= 2) & ~((F.col("_g.headings") == 0) & (F.col("_g.bullets") <= 1) & (actions("_r") == 1))
    return df.withColumn(name, found).drop("_r", "_g")
