"""Hygiene of prompt documents: detectors of artifacts, score and status.

A detector is a row of PATTERNS or a column function. Each gives an array of artifacts; a document's are concatenated in a fixed
order and never exploded on the way, so that a document's analysis needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.gates import folded, may_contain, may_match
from foliant.functions.spans import with_all_spans
from foliant.functions.text import column_of, line_of, mask_secret, strip

ARTIFACT = "struct<id: string, category: string, severity: string, match: string, line: int, column: int, suggestion: string>"
NONE = f"cast(array() as array<{ARTIFACT}>)"
PENALTY = {"critical": 20, "warning": 8}
OTHER_PENALTY = 3


@dataclass(frozen=True)
class Pattern:
    """keep: which hits count. match, suggestion: what to report for a hit; a string stands for itself."""

    category: str
    severity: str
    pattern: str
    suggestion: str | Callable[[Column], Column]
    keep: Callable[[Column], Column] | None = None
    match: Callable[[Column], Column] | None = None
    gate: str | None = None


# Patterns, word lists and texts that results depend on.
COMMON_WORDS = (
    "JavaScript", "TypeScript", "Python", "React", "Angular", "Vue", "NodeJS", "GitHub", "GitLab", "Docker", "Kubernetes", "Linux", "Windows", "MacOS", "Android", "iOS", "PostgreSQL", "MongoDB", "Redis", "RabbitMQ",
    "Kafka", "GraphQL", "REST", "JSON", "YAML", "HTML", "CSS", "SQL", "HTTP", "OpenAI", "Anthropic", "Claude", "GPT", "BatchPrompting",
)
FOREIGN_APPS = ("Positron", "MietVisor", "CiviPet", "Tesseron", "OpenCode", "CodeBuddy", "Cursor", "Copilot")
PROJECT = r"\b(?:[A-Z][a-z]+){2,}(?:OS|App|Tool|Kit|Hub|Vault|Visor|Pet|DB|API|SDK|CLI|UI|Pro|Lite|Server|Client)?\b"
REPOSITORIES = (r"github\.com/[\w\-\.]+/[\w\-\.]+", r"gitlab\.com/[\w\-\.]+/[\w\-\.]+", r"bitbucket\.org/[\w\-\.]+/[\w\-\.]+", r"\b[\w\-]+/[\w\-]+@[\w\-\:]+")
PATHS = (
    r"(?:^|\s)(?:/(?:home|usr|opt|var|tmp|etc|mnt)/[\w\-\./]+)", r"(?:^|\s)(?:[A-Za-z]:\\(?:[\w\-\.]+\\)*[\w\-\.]+)",
    r"(?:^|\s)(?:(?:src|app|lib|tests?|docs?|components?|pages?|utils?|hooks?|stores?|assets?)/[\w\-\./]+)", r"\b[\w\-/]+\.(?:tsx?|jsx?|rs|py|go|java|rb|php|css|html|json|yaml|yml|toml|md|sql)\b",
)
ISSUE = r"(?i)\b(?:Issue|PR|Bug|Ticket|Task|Feature)\s*#\s*\d+\b"
TEST_COUNTS = r"\d+\s+(?:passed|bestanden|erfolgreich).*?\d+\s+(?:failed|fehlgeschlagen|nicht\s+bestanden)"
TEST_SUMMARY = r"(?i)(?:tests?\s+(?:run|suites?)|test\s+results?)\s*:?\s*\d+"
LOG_LINE = r"(?m)^\s*(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})?\s*(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b"
STACKTRACES = (
    r"(?m)^\s+at\s+[\w\.$<>]+\([^)]*\)", r"(?m)^Traceback\s+\(most\s+recent\s+call\s+last\)", r"(?m)^Exception\s+(?:in\s+thread\s+)?[\"']?\w+",
    r"(?m)^\s+File\s+\"[^\"]+\",\s+line\s+\d+", r"(?m)^Caused\s+by:", r"(?m)^thread\s+'[\w\-]+'\s+panicked\s+at",
)
BUILDS = (
    r"(?:npm|pnpm|yarn)\s+(?:run\s+)?(?:build|test|dev|start|install|lint|format)", r"cargo\s+(?:build|test|run|check|clippy|fmt)", r"go\s+(?:build|test|run|mod)",
    r"(?i)(?:compil|build)\s+(?:successful|failed|error|warning)", r"(?m)^\s*(?:>|➜|❯|\$)\s+(?:npm|pnpm|cargo|make|docker)", r"(?i)(?:installing|building|compiling|bundling)\s+(?:packages?|dependencies|modules?)",
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?(?:\d{1,3})[ \t\-\./]?)?(?:\(?0?\d{2,4}\)?[ \t\-\./]?)?\d{3,4}[ \t\-\./]?\d{3,5}"
PHONE_WORDS = ("tel", "telefon", "phone", "mobil", "handy", "fax", "ruf", "kontakt", "hotline", "whatsapp", "call")
SECRETS = (
    ("API Key", r"(?i)(?:api[_\s\-]?key|apikey|api[_\s\-]?secret|api[_\s\-]?token)\s*[:=]\s*['\"`]?(?:[\w\-\.]{20,})['\"`]?"),
    ("Token", r"(?i)(?:token|access[_\s\-]?token|auth[_\s\-]?token|bearer)\s*[:=]\s*['\"`]?(?:[\w\-\.]{20,})['\"`]?"),
    ("Password", r"(?i)(?:password|passwd|pwd|secret)\s*[:=]\s*['\"`](?:[^'\"`]{4,})['\"`]"),
    ("Private Key", r"-----BEGIN\s+(?:RSA|EC|DSA|OPENSSH)?\s*PRIVATE\s+KEY-----"),
    ("AWS Access Key", r"(?i)(?:AKIA[0-9A-Z]{16})"),
    ("JWT Token", r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+(?:\.[A-Za-z0-9\-_]+)?"),
    ("Stripe Key", r"(?i)(?:sk|pk)_(?:live|test)_[0-9a-zA-Z]{24,}"),
    ("GitHub Token", r"(?i)(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}"),
)
CHAT = r"(?im)^(?:User|Assistant|System|Human|AI|Agent|Bot|Model)\s*:\s*.+$"
OCR = (
    r"(?i)\b(?:button|schaltfläche|dropdown|eingabefeld|textfeld|checkbox|radio|tab|menü|menu|toolbar|statusbar|title bar|dialog|modal|popup|overlay)\s*(?:label|text|angezeigt|click|klick)?\s*\z",
    r"(?i)^\s*(?:OK|Cancel|Abbrechen|Save|Speichern|Delete|Löschen|Submit|Senden|Close|Schließen)\s*\z",
    r"(?i)^\s*(?:Settings|Einstellungen|Preferences|Präferenzen|Help|Hilfe|About|Über)\s*\z",
)
TASK_CONTEXT = r"(?i)(?:aufgabe|task|ziel|goal|auftrag|rolle|role|context|kontext)"
ROLE_SECTORS = ("developer|entwickler|engineer|programmierer", "designer|gestalter|ux|ui", "analyst|analytiker|data|daten", "writer|autor|redakteur|content|texter", "tester|qa|qualität|prüfer", "manager|projektleiter|scrum|product owner")
SECTIONS = (("Rolle", "rolle|role|rollendefinition"), ("Ziel", "ziel|goal|aufgabe|task|objective"), ("Kontext", "kontext|context|hintergrund|background"), ("Anforderungen", "anforderung|requirements|eingabe|input"), ("Ausgabeformat", "ausgabe|output|format|ergebnis"), ("Constraints", "einschränkung|constraint|grenze|limitation|boundary"))
GUIDELINE_SECTIONS = (("Scope/Zweck", "scope|umfang|geltung|ziel|purpose|goal"), ("Regeln/Prinzipien", "regeln?|rules?|prinzipien|principles|vorgaben?"), ("Constraints/Guardrails", "einschränkung|constraint|grenze|limitation|boundary|guardrail"), ("Anwendbarkeit/Kontext", "anwendbarkeit|applicability|kontext|context|gültig"), ("Output-Disziplin", "ausgabe|output|format|struktur"))
EVIDENCE = (
    ("critical", r"(?im)^={3,}\s*(?:test\s*results?|testergebnis|build\s*output|log|report)\s*={3,}"), ("warning", r"(?im)^\-{3,}\s*(?:test\s*results?|testergebnis|evidence|nachweis|proof)\s*\-{3,}"),
    ("warning", r"(?im)^\*\*(?:evidence|test\s*results?|ci\s*pipeline|build\s*status)\*\*"), ("info", r"^diff\s+\-\-git"),
)


def project_name(x: Column) -> Column:
    capitals = F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    return ~F.array_contains(F.array(*map(F.lit, COMMON_WORDS)), x) & ((capitals >= 2) | (F.octet_length(x) >= 8))


def real_path(x: Column) -> Column:
    x = strip(x)
    return (F.octet_length(x) >= 5) & ~(F.endswith(x, F.lit(".md")) & ~F.contains(x, F.lit("/")) & ~F.contains(x, F.lit("\\")))


def braced(x: Column) -> Column:
    return F.concat(F.lit("{"), F.upper(x), F.lit("}"))


BEFORE_JSON = [
    Pattern("PROJECT_ARTIFACT", "warning", PROJECT, lambda x: braced(F.replace(x, F.lit(" "), F.lit("_"))), project_name),
    *(Pattern("REPO_REFERENCE", "warning", p, "{REPOSITORY_URL}") for p in REPOSITORIES),
    *(Pattern("FILE_PATH", "warning", p, "{FILE_PATH}", real_path, strip) for p in PATHS),
    Pattern("ISSUE_REFERENCE", "info", ISSUE, lambda x: braced(F.regexp_extract(x, r"^\p{L}+", 0))),
    Pattern("TEST_REPORT", "info", TEST_COUNTS, "{TEST_RESULTS}"),
    Pattern("TEST_REPORT", "info", TEST_SUMMARY, "{TEST_SUMMARY}"),
    Pattern("LOG_LINE", "info", LOG_LINE, "{LOG_ENTRY}"),
    *(Pattern("STACKTRACE", "info", p, "{STACKTRACE}") for p in STACKTRACES),
    *(Pattern("BUILD_OUTPUT", "info", p, "{BUILD_COMMAND}") for p in BUILDS),
]
INLINE_CODE = Pattern("CODE_DUMP", "info", "`[^`]{200,}`", "{CODE_SNIPPET}", None, lambda x: F.concat(F.lit("Langer Inline-Code ("), F.octet_length(x).cast("string"), F.lit(" Zeichen)")))
EMAILS = Pattern("PII", "critical", EMAIL, "{EMAIL}", gate="@")
AFTER_PHONE = [
    *(Pattern("SECRET", "critical", p, "{" + name.upper().replace(" ", "_") + "}", None, lambda x, name=name: F.concat(F.lit(name + ": "), mask_secret(x))) for name, p in SECRETS),
    Pattern("CHAT_META", "warning", CHAT, "{CHAT_ROLE}"),
    *(Pattern("SCOPE_POLLUTION", "warning", rf"\b{a}\b", "{SCOPE_CLEAN}", gate=a) for a in FOREIGN_APPS),
    *(Pattern("OCR_RESIDUE", "info", p, "{UI_RELEVANT}") for p in OCR),
]
EVIDENCE_BLOCKS = [Pattern("EVIDENCE_BLOCK", severity, p, "{INTEGRATE_EVIDENCE}") for severity, p in EVIDENCE]


def artifact(text: Column, category: str, severity: Column | str, match: Column, line: Column, column: Column, suggestion: Column | str) -> Column:
    """An artifact; its id is a digest of what and where it is."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    key = F.sha2(F.concat_ws("\x01", F.sha2(text, 256), F.lit(category), line.cast("string"), column.cast("string"), match), 256)
    return F.struct(F.left(key, F.lit(32)).alias("id"), F.lit(category).alias("category"), as_column(severity).alias("severity"), match.alias("match"), line.cast("int").alias("line"), column.cast("int").alias("column"), as_column(suggestion).alias("suggestion"))


def detected(df: DataFrame, text: str, patterns: dict[str, Pattern]) -> DataFrame:
    """df with a column of artifacts for each name and pattern. An expression runs where words that it can't match without are in the text."""
    t = F.col(text)
    low = F.col("__low")
    gate = lambda p: F.contains(t, F.lit(p.gate)) if p.gate else may_match(low, p.pattern) & t.rlike("(?U)" + p.pattern)
    df = with_all_spans(df.withColumn("__low", folded(t)), text, {n: ("(?U)" + p.pattern, gate(p)) for n, p in patterns.items()}).drop("__low")

    def found(name: str, p: Pattern) -> Column:
        kept = F.filter(name, lambda x: p.keep(x["hit"])) if p.keep else F.col(name)
        suggestion = p.suggestion if callable(p.suggestion) else lambda x: F.lit(p.suggestion)
        report = p.match or (lambda x: x)
        return F.transform(kept, lambda x: artifact(t, p.category, p.severity, report(x["hit"]), line_of(t, x["start"]), column_of(t, x["start"]), suggestion(x["hit"])))

    return df.withColumns({n: found(n, p) for n, p in patterns.items()})


def groups(x: Column) -> Column:
    return F.filter(F.split(x, r"[-./ ]", -1), lambda g: g != "")


def is_year(x: Column) -> Column:
    return x.rlike("^(?:19|20)..$")


def technical_number(raw: Column, near_word: Column) -> Column:
    """Dates, versions, decimals, model dates, year ranges and long ids, which are no phone numbers."""
    t = F.regexp_replace(strip(raw), "^[,;:]+|[,;:]+$", "")
    n = F.length(F.regexp_replace(t, "[^0-9]", ""))
    g = groups(t)
    at = lambda i: F.coalesce(F.get(g, F.lit(i)), F.lit(""))
    size = lambda i: F.length(at(i))
    iso = is_year(at(0)) & (size(1) == 2) & (size(2) == 2)
    german = (size(0) <= 2) & (size(1) == 2) & is_year(at(2))
    version = F.forall(g, lambda x: F.length(x) <= 3) & (n <= 7)
    decimal = F.contains(t, F.lit(".")) & (size(0) <= 2) & (size(1) >= 4) & ~F.startswith(at(0), F.lit("0"))
    month, day = F.substring(at(1), 5, 2), F.substring(at(1), 7, 2)
    model = F.contains(t, F.lit("-")) & (size(0) <= 2) & (size(1) == 8) & is_year(F.left(at(1), F.lit(4))) & month.between("01", "12") & day.between("01", "31")
    years = is_year(at(0)) & is_year(at(1))
    digits_only = t.rlike("^[0-9]+$")
    by_groups = F.when(F.size(g) == 3, iso | german | version).when(F.size(g) == 2, decimal | model | years).otherwise(False)
    return F.when(t == "", False).when(digits_only & (n >= 13) & ~F.startswith(t, F.lit("00")) & ~near_word, True).when(F.exists(g, lambda x: ~x.rlike("^[0-9]+$")), False).otherwise(by_groups)


def phone_shape(raw: Column) -> Column:
    t = strip(raw)
    n = F.length(F.regexp_replace(t, "[^0-9]", ""))
    g = groups(t)
    plus, trunk, area = F.startswith(t, F.lit("+")), t.rlike(r"^\(?0"), F.contains(t, F.lit("(")) & F.contains(t, F.lit(")"))
    slash = F.contains(t, F.lit("/")) & (F.size(g) == 2) & (plus | F.startswith(F.coalesce(F.get(g, F.lit(0)), F.lit("")), F.lit("0")))
    grouped = (F.size(g) >= 3) & F.forall(g, lambda x: F.length(x) <= 5) & (F.length(F.element_at(g, -1)) >= 3)
    return (n >= 8) & (plus | trunk | area | slash | grouped)


def phones(df: DataFrame, text: str, name: str) -> DataFrame:
    df = with_all_spans(df, text, {name: ("(?U)" + PHONE, F.col(text).rlike(r"\d(?:\D?\d){6}"))})
    word = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(PHONE_WORDS)})(?![\p{{L}}\p{{N}}])"

    def near_word(x: Column) -> Column:
        before = F.substring_index(F.substring(F.col(text), F.lit(1), x["start"]), "\n", -1)
        return F.lower(F.right(before, F.lit(40))).rlike(word)

    digits = lambda x: F.length(F.regexp_replace(x["hit"], "[^0-9]", ""))
    found = F.filter(name, lambda x: digits(x).between(7, 15) & ~technical_number(x["hit"], near_word(x)))
    severity = lambda x: F.when(phone_shape(x["hit"]) | near_word(x), "critical").otherwise("warning")
    return df.withColumn(name, F.transform(found, lambda x: artifact(F.col(text), "PII", severity(x), x["hit"], line_of(F.col(text), x["start"]), column_of(F.col(text), x["start"]), "{PHONE}")))


def json_dumps(text: Column) -> Column:
    """Blocks of more than 5 lines and 500 bytes that begin with a brace or bracket, by a fold over lines."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    blank = "named_struct('start', -1, 'depth', 0, 'found', cast(array() as array<struct<first: int, last: int>>))"
    count = lambda x, chars: F.length(x) - F.length(F.regexp_replace(x, chars, ""))

    def step(a: Column, x: Column) -> Column:
        line = strip(x["line"])
        start = F.when(a["start"] >= 0, a["start"]).when(line.rlike(r"^[{\[]"), x["i"]).otherwise(-1)
        depth = F.when(start < 0, 0).otherwise(F.when(a["start"] >= 0, a["depth"]).otherwise(0) + count(line, r"[{\[]") - count(line, r"[}\]]"))
        ends = (start >= 0) & (depth <= 0)
        found = F.when(ends & (x["i"] - start + 1 > 5), F.concat(a["found"], F.array(F.struct(start.cast("int").alias("first"), x["i"].cast("int").alias("last"))))).otherwise(a["found"])
        return F.struct(F.when(ends, -1).otherwise(start).cast("int").alias("start"), F.when(ends, 0).otherwise(depth).cast("int").alias("depth"), found.alias("found"))

    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    folded = F.aggregate(numbered, F.expr(blank), step)["found"]
    size = lambda b: F.octet_length(F.array_join(F.slice(lines, b["first"] + 1, b["last"] - b["first"] + 1), "\n"))
    large = F.filter(folded, lambda b: size(b) > 500)
    label = lambda b: F.concat(F.lit("JSON-Block ("), (b["last"] - b["first"] + 1).cast("string"), F.lit(" Zeilen, "), size(b).cast("string"), F.lit(" Zeichen)"))
    return F.when(text.rlike(r"(?m)^[ \t]*[{\[]"), F.transform(large, lambda b: artifact(text, "JSON_DUMP", "warning", label(b), b["first"] + 1, F.lit(1), "{JSON_DATA}"))).otherwise(F.expr(NONE))


def code_dumps(text: Column) -> Column:
    """Fenced blocks of more than 20 lines; a closed one is reported at its first line, an open one at its fence."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    fences = F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(strip(x), F.lit("```")), i)), lambda i: i.isNotNull())
    opened = F.transform(F.filter(F.transform(fences, lambda f, k: F.struct(f.alias("f"), k.alias("k"))), lambda s: s["k"] % 2 == 0), lambda s: F.struct(s["f"].alias("first"), F.get(fences, s["k"] + 1).alias("end")))
    count = lambda b: F.coalesce(b["end"], F.size(lines)) - b["first"] - 1
    line = lambda b: F.when(b["end"].isNull(), b["first"] + 1).otherwise(b["first"] + 2)
    label = lambda b: F.concat(F.lit("Code-Block ("), count(b).cast("string"), F.lit(" Zeilen)"))
    return F.when(F.contains(text, F.lit("```")), F.transform(F.filter(opened, lambda b: count(b) > 20), lambda b: artifact(text, "CODE_DUMP", "info", label(b), line(b), F.lit(1), "{CODE_SNIPPET}"))).otherwise(F.expr(NONE))


def role_mismatch(text: Column, low: Column) -> Column:
    """Lines with two role sectors or more, in texts with three or more. low: the text's folded() form."""
    here = [may_contain(low, s.split("|")) for s in ROLE_SECTORS]
    number = lambda x: sum(((g & x.rlike(rf"(?iU)\b(?:{s})\b")).cast("int") for s, g in zip(ROLE_SECTORS, here, strict=True)), F.lit(0))
    might = sum((g.cast("int") for g in here), F.lit(0)) >= 3
    lines = F.transform(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    rows = F.transform(F.filter(lines, lambda x: number(x["x"]) >= 2), lambda x: artifact(text, "ROLE_MISMATCH", "warning", strip(x["x"]), x["i"] + 1, F.lit(1), "{CORRECTED_ROLE}"))
    return F.when(might & (number(text) >= 3), rows).otherwise(F.expr(NONE))


def missing_structure(text: Column, low: Column, guideline: Column) -> Column:
    """One artifact where half of the usual headings are absent from a text of some length. low: the text's folded() form."""
    sharp = F.contains(text, F.lit("#"))

    def absent(sections: tuple, end: str) -> Column:
        return F.array_compact(F.array(*(F.when(~(sharp & may_match(low, f"(?:{p})") & text.rlike(rf"(?imU)^#{{1,3}}\s*(?:{p}){end}")), name) for name, p in sections)))

    task, rules = absent(SECTIONS, ""), absent(GUIDELINE_SECTIONS, r"\b")
    long = F.octet_length(strip(text)) > 100
    one = lambda missing, label, hint: F.array(artifact(text, "MISSING_STRUCTURE", "info", F.concat(F.lit(label), F.array_join(missing, ", ")), F.lit(1), F.lit(1), hint))
    return F.when(~guideline & (F.size(task) >= 3) & long, one(task, "Fehlende Sektionen: ", "{ADD_STRUCTURE}")).when(guideline & (F.size(rules) > 2) & long, one(rules, "Fehlende Guideline-Sektionen: ", "{ADD_GUIDELINE_STRUCTURE}")).otherwise(F.expr(NONE))


def analyze(docs: DataFrame, text: str = "text", guideline: Column | None = None) -> DataFrame:
    """docs with artifacts, hygiene_score and hygiene_status. guideline: which texts are rule collections; by default none.

    A null text counts as empty; an empty text is clean. Columns of the same names are replaced."""
    from foliant.operators.router import with_is_guideline

    t, low = F.col("_text"), F.col("_low")
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    named = {f"_{group}{i}": p for group, patterns in (("a", BEFORE_JSON), ("d", [INLINE_CODE, EMAILS]), ("f", AFTER_PHONE), ("i", EVIDENCE_BLOCKS)) for i, p in enumerate(patterns)}
    df = phones(detected(df, "_text", named), "_text", "_e0")
    ocr = [n for n, p in named.items() if p.category == "OCR_RESIDUE"]
    df = with_is_guideline(df, t, "_rules") if guideline is None else df.withColumn("_rules", guideline)
    df = df.withColumns({"_low": folded(t), "_task": t.rlike(TASK_CONTEXT)})
    others = {"_b0": json_dumps(t), "_c0": code_dumps(t), "_g0": role_mismatch(t, low), "_h0": missing_structure(t, low, F.col("_rules"))}
    df = df.withColumns(others | {n: F.when(F.col("_task"), F.expr(NONE)).otherwise(F.col(n)) for n in ocr})
    names = sorted({*named, *others, "_e0"}, key=lambda n: (n[1], int(n[2:])))
    df = df.withColumn("artifacts", F.concat(*names)).drop("_text", "_low", "_task", "_rules", *names)
    return df.withColumn("hygiene_score", score(F.col("artifacts"))).withColumn("hygiene_status", status(F.col("hygiene_score")))


def score(artifacts: Column) -> Column:
    """100 less a penalty for each artifact, within 0 and 100."""
    penalty = lambda a: F.when(a["severity"] == "critical", PENALTY["critical"]).when(a["severity"] == "warning", PENALTY["warning"]).otherwise(OTHER_PENALTY)
    return F.greatest(F.lit(0), F.aggregate(artifacts, F.lit(100), lambda s, a: s - penalty(a)))


def status(score: Column) -> Column:
    return F.when(score >= 80, "clean").when(score >= 50, "warning").otherwise("critical")


def is_sensitive(artifacts: Column) -> Column:
    """Whether a document must not be embedded."""
    return F.exists(artifacts, lambda a: (a["severity"] == "critical") | a["category"].isin("PII", "SECRET"))
