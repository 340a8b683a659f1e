"""Hard constraints that a document states: which, and where; and answers that go against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.gates import Gates, folded
from foliant.functions.spans import spans, summed
from foliant.functions.text import djb2_hex, each, line_of, plain_rx, strip

# Category, severity, expressions.
CONSTRAINTS = (
    ("offline_only", "hard", (r"keine\s+cloud\s+(?:verwenden|nutzen|einsetzen)", r"nur\s+lokal\s+(?:ausführen|ausführbar|verarbeiten)", r"no\s+cloud", r"local\.only", r"local-only", r"offline", r"nicht\s+(?:online|im\s+internet|im\s+netz)")),
    ("max_length", "hard", (r"maximal\s+(?:\d+)\s+(?:Wörter|Worte|Zeichen)\b", r"max\.?\s+(?:\d+)\s+(?:Wörter|Worte|Zeichen)\b", r"nicht\s+mehr\s+als\s+(?:\d+)\s+(?:Wörter|Worte|Zeichen)\b", r"höchstens\s+(?:\d+)\s+(?:Wörter|Worte|Zeichen)\b", r"max(?:imum)?\s+(?:\d+)\s+words", r"at\s+most\s+(?:\d+)\s+words")),
    ("no_examples", "soft", (r"keine\s+beispiele", r"ohne\s+beispiele", r"no\s+examples", r"keine\s+beispielprompts", r"nicht\s+mit\s+beispielen")),
    ("language", "hard", (r"nur\s+auf\s+deutsch", r"ausschließlich\s+auf\s+deutsch", r"in\s+deutscher\s+sprache", r"antwort\s+auf\s+deutsch", r"nur\s+auf\s+englisch", r"in\s+english", r"only\s+in\s+(?:german|english)", r"sprache\s*:\s*deutsch", r"language\s*:\s*(?:german|english)")),
    ("format_lock", "hard", (r"als\s+json\s+(?:ausgeben|formatieren|format)", r"im\s+json[.\s-]format", r"als\s+markdown", r"nur\s+als\s+(?:tabelle|liste|aufzählung)", r"output\s+as\s+json")),
    ("tool_restriction", "hard", (r"keine?\s+(?:tools?|plugins?|erweiterungen?)\s+(?:verwenden|nutzen)", r"nur\s+(?:git|shell|bash|node)\s+(?:verwenden|nutzen)", r"ohne\s+(?:docker|npm|pip|apt)", r"do\s+not\s+use\s+(?:docker|npm|pip)")),
    ("approval_required", "hard", (r"vor\s+der\s+ausführung\s+(?:bestätigen|prüfen|genehmigen)", r"human\s+approval\s+required", r"menschliche\s+(?:freigabe|genehmigung|prüfung)\s+(?:nötig|erforderlich)", r"nicht\s+automatisch\s+(?:ausführen|deployen|mergen)", r"review\s+(?:required|mandatory)")),
    ("scope_boundary", "hard", (r"nur\s+(?:diese|folgende)\s+datei(?:en)?\s+(?:ändern|bearbeiten)", r"keine\s+neuen\s+dateien", r"kein\s+refactoring", r"scope\s*:\s*(?:nur|only)", r"do\s+not\s+(?:modify|change|touch)\s+(?:other|unrelated)")),
)


# Words of an answer that go against a constraint of the category, and how grave that is.
CONFLICTS = {
    "offline_only": ("blocking", ("cloud", "online", "remote", "api", "web service", "internet", "server", "saas")),
    "max_length": ("warning", ("ausführlich", "detailliert", "umfangreich", "lang", "comprehensive", "detailed", "long", "extensive")),
    "language": ("blocking", ("englisch", "english", "französisch", "french", "spanisch", "spanish")),
    "no_examples": ("warning", ("beispiel", "beispiele", "example", "examples", "muster", "vorlage", "template")),
    "tool_restriction": ("blocking", ("docker", "npm install", "pip install", "apt-get", "package")),
    "approval_required": ("blocking", ("automatisch", "automatic", "auto-deploy", "deployen", "ohne freigabe", "ohne genehmigung", "ohne review", "skip review", "auto-merge")),
    "format_lock": ("warning", ("markdown", "plain text", "csv", "yaml", "xml", "html", "text")),
    "scope_boundary": ("blocking", ("refactoring", "refactor", "umbau", "restructure", "rewrite")),
}
#: Constraints of these categories are never loosened without a person's approval.
SECURITY = ("offline_only", "approval_required", "scope_boundary")
RESOLUTIONS = {True: ("keep_constraint", "require_human_approval", "save_as_review"), False: ("keep_constraint", "change_constraint", "save_as_review")}


GATES = Gates(*(p for _, _, ps in CONSTRAINTS for p in ps))


def with_constraints(docs: DataFrame, text: str = "text", name: str = "constraints") -> DataFrame:
    """docs with an array of constraints in the order of CONSTRAINTS, then of their places: id, category, severity, constraint_text, line and column (in characters).

    The id is a hash of what and where a constraint is. A null text has none. Rules are rows of an array, of which those run whose words are in the text: as columns,
    they would make a plan that takes longer to optimise than a small table to read."""
    t = F.col("_text")
    rules = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(plain_rx(p)).alias("pattern"), F.lit(GATES.at.get(p, -1)).alias("gate")) for c, s, ps in CONSTRAINTS for p in ps))
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_passed", GATES.passed(folded(t)))
    df = df.withColumn("_found", F.filter(rules, lambda r: (r["gate"] < 0) | F.get(F.col("_passed"), r["gate"])))
    df = df.withColumn("_found", F.filter(F.transform("_found", lambda r: r.withField("hits", F.regexp_extract_all(t, r["pattern"], F.lit(0)))), lambda r: F.size(r["hits"]) > 0))
    df = df.withColumn("_found", F.transform("_found", lambda r: r.withField("gaps", F.split(t, r["pattern"], -1))))

    def described(r: Column) -> Column:
        before = lambda x: F.substring(t, F.lit(1), x["start"])
        column = lambda x: F.length(F.substring_index(before(x), "\n", -1)) + 1
        return F.transform(r["spans"], lambda x: F.struct(r["category"].alias("category"), r["severity"].alias("severity"), strip(x["hit"]).alias("constraint_text"), line_of(t, x["start"]).alias("line"), column(x).alias("column")))

    df = df.withColumn("_found", F.transform("_found", lambda r: r.withField("spans", spans(summed(r)))))
    df = df.withColumn("_found", F.flatten(F.transform("_found", described)))
    key = lambda c: F.concat(F.lit("HC_"), djb2_hex(F.concat_ws(":", c["category"], c["constraint_text"], c["line"].cast("string"), c["column"].cast("string"))))
    rows = F.transform("_found", lambda c: F.struct(key(c).alias("id"), *(c[f].alias(f) for f in ("category", "severity", "constraint_text", "line", "column"))))
    return df.withColumn(name, rows).drop("_text", "_passed", "_found")


def hard_constraints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each constraint of each document: key, seq (its place among them, from 0), id, category, severity, constraint_text, line and column."""
    return each(with_constraints(docs.select(key, text), text, "_all"), "_all", "c", key).select(key, "seq", "c.*")


def resolutions(category: Column) -> Column:
    """Ids of what a user may choose for a conflict with a constraint."""
    return F.when(category.isin(*SECURITY), F.array(*map(F.lit, RESOLUTIONS[True]))).otherwise(F.array(*map(F.lit, RESOLUTIONS[False])))


def conflicts(found: DataFrame, answers: DataFrame, key: str = "doc_id", order: str = "item_id") -> DataFrame:
    """Constraints (of hard_constraints()) and answers (key, order, value) of one document that go against each other: key, id, constraint_id, category, keyword,
    source, severity, description and resolutions. Ids count a document's conflicts in the order of constraints, then of answers. Null answers have none."""
    rules = F.create_map(*(x for c, (severity, words) in CONFLICTS.items() for x in (F.lit(c), F.struct(F.lit(severity).alias("severity"), F.array(*map(F.lit, words)).alias("words")))))
    rule = F.element_at(rules, F.col("category"))
    own = answers.select(key, F.col(order).alias("_order"), F.col("value").alias("source"))
    both = found.join(own, key).withColumn("keyword", F.get(F.filter(rule["words"], lambda w: F.contains(F.lower("source"), w)), F.lit(0))).where("keyword is not null")
    hard = F.concat(F.lit('Die Antwort "'), "source", F.lit('" kollidiert mit der harten Regel "'), "constraint_text", F.lit('".'))
    soft = F.concat(F.lit('Die Antwort "'), "source", F.lit('" steht im Konflikt mit der Regel "'), "constraint_text", F.lit('".'))
    number = F.row_number().over(Window.partitionBy(key).orderBy("seq", "_order", "source"))
    return both.select(key, F.concat(F.lit("CC_"), F.lpad(number.cast("string"), 3, "0")).alias("id"), F.col("id").alias("constraint_id"), "category", "keyword", "source", rule["severity"].alias("severity"), F.when(F.col("severity") == "hard", hard).otherwise(soft).alias("description"), resolutions(F.col("category")).alias("resolutions"))
