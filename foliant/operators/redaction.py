"""Redaction and sanitizing of texts, as ordered replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import chain, strip

MAX_ANSWER = 5000
MAX_SPOKEN = 500

# Expressions, in the order in which they apply, and their replacements.
SECRETS = (
    r"(?i)(?:(?:api|access)[_-]?key|secret|token|password|passphrase)\s*[:=]\s*['\"][^'\"]+['\"]", r"-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----",
    r"ghp_[A-Za-z0-9_]{36}", r"gho_[A-Za-z0-9_]{36}", r"ghu_[A-Za-z0-9_]{36}", r"ghs_[A-Za-z0-9_]{36}", r"ghr_[A-Za-z0-9_]{36}", r"xox[bpras]-[A-Za-z0-9-]+", r"sk-[A-Za-z0-9]{32,}", r"eyJ[A-Za-z0-9_-]{50,}",
)
SPOKEN = (
    (r"-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+ PRIVATE KEY-----", "[Private-Key]"), (r"```[\s\S]*?```", " [Code-Block] "), (r"sk-[a-zA-Z0-9]{20,}", "[API-Key]"), (r"(?i)https?://\S*(?:token|key|secret|auth|password|api_key)=[^&\s]+", "[URL-mit-Token]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[E-Mail]"), (r"/(?:home|Users|tmp|etc|var|opt|usr)/\S+", "[Pfad]"), (r"[A-Z]:\\\S+", "[Pfad]"),
    (r"(?i)\{[^{}]*\"(?:id|token|key|secret|password|hash)\"[^{}]*\}", "[JSON]"), (r"(?i)\b[a-f0-9]{40,}\b", "[Hash]"), (r"(?m)^\s*(?:at |File |\s+at ).*$", " "),
    (r"(?m)^\s*(?:ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\b.*$", " "), (r"[^\n]{200,}", " [Langer-Text] "), (r"[a-zA-Z0-9_-]{32,}", "[Token]"),
)


def strip_secrets(text: Column) -> Column:
    return chain(text, *((p, "[REDACTED]") for p in SECRETS))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def speakable(text: Column) -> Column:
    """What may be read aloud, without secrets, addresses, paths and dumps; at most MAX_SPOKEN characters."""
    return shortened(strip(F.regexp_replace(chain(text, *SPOKEN), r"\s{2,}", " ")), MAX_SPOKEN)


BLOCKED = "Dieser Inhalt wird aus Sicherheitsgründen nicht vorgelesen. Bitte prüfen Sie die Quelldatei manuell."
WARNING = "Achtung: Dieser Prompt enthält mögliche Fremdartefakte oder sensible technische Details. "


def audio_summary(docs: DataFrame) -> DataFrame:
    """docs with spoken, severity (normal, warning, blocked), spoken_source and can_speak.

    docs: title, description, category, tags, content, hygiene_status and contamination_status. A description of ten characters or more is read after the title; else title,
    category and tags; else the first two lines of the content that say something. Critical hygiene and secrets block; other findings put a warning first, where there is room."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    description = strip(text("description"))
    tags = F.filter(F.coalesce("tags", F.expr("cast(array() as array<string>)")), lambda t: (t != "") & ~t.rlike("(?i)^[a-f0-9]{8,}$"))
    parts = F.array_compact(F.array(
        F.when(text("title") != "", text("title")), F.when((text("category") != "") & (F.col("category") != "Unkategorisiert"), F.concat(F.lit("aus der Kategorie "), "category")),
        F.when(F.size(tags) > 0, F.concat(F.lit("mit Schlagworten: "), F.array_join(F.slice(tags, 1, 3), ", "))),
    ))
    says = lambda x: (x != "") & ~F.startswith(x, F.lit("```")) & (F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("- ")) | F.length(x).between(6, 199))
    lines = F.filter(F.split(text("content"), "\n", -1), lambda x: says(strip(x)))
    head = F.concat(F.lit('Prompt "'), text("title"))
    excerpt = F.when(F.size(lines) == 0, F.concat(head, F.lit('" – Inhalt bitte manuell prüfen.'))).otherwise(F.concat(head, F.lit('" – Inhaltsauszug: '), shortened(strip(F.array_join(F.slice(lines, 1, 2), " ")), 200)))
    source = F.when(F.length(description) >= 10, "description").when(F.size(parts) > 0, "metadata").otherwise("content_fallback")
    df = docs.withColumns({"spoken_source": source, "_text": F.when(source == "description", F.concat(text("title"), F.lit(" – "), description)).when(source == "metadata", F.concat(F.array_join(parts, ", "), F.lit("."))).otherwise(excerpt)})
    df = df.withColumn("_text", speakable(F.col("_text")))
    blocked = F.coalesce(F.col("hygiene_status") == "critical", F.lit(False)) | F.coalesce(F.col("contamination_status") == "BLOCKING_SENSITIVE_CONTENT", F.lit(False))
    warned = F.coalesce(F.col("hygiene_status") == "warning", F.lit(False)) | F.coalesce(F.col("contamination_status").isin("CONTAMINATED_NEEDS_REVIEW", "POSSIBLE_CONTAMINATION"), F.lit(False))
    told = F.when(warned & (F.length("_text") + len(WARNING) <= MAX_SPOKEN), F.concat(F.lit(WARNING), "_text")).otherwise(F.col("_text"))
    return df.withColumns({
        "spoken": F.when(blocked, BLOCKED).otherwise(told), "severity": F.when(blocked, "blocked").when(warned, "warning").otherwise("normal"),
        "spoken_source": F.when(blocked, "safety_fallback").otherwise(F.col("spoken_source")), "can_speak": ~blocked,
    }).drop("_text")


def redact_path(path: Column, root: str = "") -> Column:
    """Below the root: vault: and the rest; else the last part only."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").removesuffix("/")
    parts = F.filter(F.split(clean, "/"), lambda p: p != "")
    short = F.when(F.size(parts) > 1, F.concat(F.lit(".../"), F.element_at(parts, -1))).otherwise(clean)
    inside = F.startswith(F.lower(clean), F.lit(base.lower())) if base else F.lit(False)
    return F.when(F.coalesce(path, F.lit("")) == "", "").when(inside, F.concat(F.lit("vault:"), F.substring(clean, len(base) + 1, 1 << 30))).otherwise(short)


def sanitize_answer(text: Column) -> Column:
    """An answer that cannot inject headings, markup, code or dangerous links into a document."""
    clean = chain(
        F.coalesce(text, F.lit("")), (r"(?m)^#{1,6}\s+", ""), (r"<[^>]*>", ""), (r"(?<!\\)`", r"\\`"), (r"(?i)\[([^\]]*)\]\((?:javascript|data):(?:[^()]|\([^()]*\))*\)", "[$1]"),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+\z", ""),
    )
    return F.when(F.length(clean) > MAX_ANSWER, F.concat(F.left(clean, F.lit(MAX_ANSWER)), F.lit("…"))).otherwise(clean)
