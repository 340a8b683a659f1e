"""Advice: what to change in a document by its scores and contradictions, why a dimension doesn't count, and what to put in an artifact's place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.operators.features import MODERATE, WEAK

MOST = 3

# Texts that users see, German and English.
BY_DIMENSION = {
    "Goal": ("Formuliere ein explizites Ziel: Deine Aufgabe ist es, [Ziel] zu erreichen.", "State an explicit goal: Your task is to achieve [goal]."),
    "Input": ("Definiere Eingaben mit Platzhaltern: Erwartete Eingabe: {{INPUT}}.", "Define inputs with placeholders: Expected input: {{INPUT}}."),
    "Output": ("Spezifiziere das Ausgabeformat: Antworte im JSON-Format mit den Feldern [FELD1, FELD2].", "Specify the output format: Answer in JSON with the fields [FIELD1, FIELD2]."),
    "Context": ("Ergänze den fehlenden Kontext: [Fakt] fehlt, damit die Aufgabe eigenständig ausführbar ist.", "Add the missing context: the task references [fact] that is not supplied."),
    "Constraint": ("Ergänze Prüfkriterien: Das Ergebnis muss folgende Akzeptanzkriterien erfüllen: [KRITERIEN].", "Add acceptance criteria: the result must satisfy the following checks: [CRITERIA]."),
    "Actionability": ("Strukturiere das Vorgehen: 1. Analysiere... 2. Implementiere... 3. Validiere...", "Structure the procedure: 1. Analyze... 2. Implement... 3. Validate..."),
    "Ambiguity": ("Verbessere die Lesbarkeit: verwende Überschriften, Absätze und prägnante Formulierungen.", "Improve readability: use headings, paragraphs and concise wording."),
    "Safety": ("Definiere Grenzen: gib keine personenbezogenen Daten aus und führe keine destruktiven Aktionen aus.", "Define boundaries: never output personal data and do not perform destructive actions."),
    "Reuse": ("Mache den Prompt generischer: ersetze konkrete Projekt- und Dateinamen durch Platzhalter.", "Make the prompt more generic: replace concrete project and file names with placeholders."),
    "Role": ("Ersetze die generische Rollenangabe durch eine konkrete Rolle mit Expertise: Du bist ein [Rolle] mit [Expertise].", "Replace the generic role with a concrete one: You are a [role] with [expertise]."),
}
CONTRADICTION = (("Löse den Widerspruch zwischen »", "« und »", "«: entscheide dich für eine Vorgabe."), ('Resolve the contradiction between "', '" and "', '": choose one mandate.'))
REASONS = {
    "Input": ("INPUT: pure ideation, no data referenced", ("Guideline", "GeneralTask")),
    "Reuse": ("REUSE: one-off task", ("Planning", "Analysis", "GeneralTask")),
}
SAFETY_REASON = "SAFETY: benign domain, no boundaries stated"
REPLACEMENTS = {
    "PROJECT_ARTIFACT": "{PROJECT_NAME}", "REPO_REFERENCE": "{REPOSITORY_URL}", "FILE_PATH": "{FILE_PATH}", "ISSUE_REFERENCE": "{ISSUE_ID}", "TEST_REPORT": "{TEST_RESULTS}", "LOG_LINE": "{LOG_ENTRY}",
    "STACKTRACE": "{STACKTRACE}", "BUILD_OUTPUT": "{BUILD_COMMAND}", "JSON_DUMP": "{JSON_DATA}", "CODE_DUMP": "{CODE_SNIPPET}", "PII": "{REDACTED}", "SECRET": "{SECRET}", "CHAT_META": "{CHAT_ROLE}",
    "SCOPE_POLLUTION": "{SCOPE_CLEAN}", "OCR_RESIDUE": "{UI_RELEVANT}", "ROLE_MISMATCH": "{CORRECTED_ROLE}", "MISSING_STRUCTURE": "{ADD_STRUCTURE}", "EVIDENCE_BLOCK": "{INTEGRATE_EVIDENCE}",
}


def recommendations(scores: dict[str, Column], applicable: dict[str, Column], feature, language: Column, conflicts: Column, most: int = MOST) -> Column:
    """At most `most` texts: contradictions first, then goal, input and output, then the rest. German ones unless the document is English.

    A dimension gets one if it counts and scores below 5, unless the features say that it would not help. feature: a function of a feature's name."""
    german = language != "En"
    low = lambda d: applicable[d] & (scores[d] < 5)
    no_slots = feature("placeholder_count") == 0
    wanted = {
        "Goal": low("Goal"), "Input": low("Input") & no_slots, "Output": applicable["Output"] & (scores["Output"] <= 5) & (feature("output_contract") < MODERATE),
        "Context": low("Context") & ~feature("self_contained"), "Constraint": low("Constraint") & (feature("relevant_constraints") == 0), "Actionability": low("Actionability") & ~feature("atomic_action"),
        "Ambiguity": low("Ambiguity"), "Safety": low("Safety") & feature("safety_relevant"), "Reuse": low("Reuse") & no_slots, "Role": feature("role_present") == WEAK,
    }
    by_dimension = [F.when(F.coalesce(wanted[d], F.lit(False)), F.when(german, de).otherwise(en)) for d, (de, en) in BY_DIMENSION.items()]
    quote = lambda c, parts: F.concat(F.lit(parts[0]), c["first"], F.lit(parts[1]), c["second"], F.lit(parts[2]))
    contradictions = F.transform(conflicts, lambda c: F.when(german, quote(c, CONTRADICTION[0])).otherwise(quote(c, CONTRADICTION[1])))
    return F.slice(F.concat(contradictions, F.array_compact(F.array(*by_dimension))), 1, most)


def reasons(base: dict[str, Column], kind: Column) -> Column:
    """Why dimensions don't count for a kind of document, by the kind alone: an array of name and reason. base: which are not applicable to the kind."""
    why = {d: F.when(base[d] & kind.isin(*kinds), text) for d, (text, kinds) in REASONS.items()}
    why["Safety"] = F.when(base["Safety"], SAFETY_REASON)
    return F.array_compact(F.array(*(F.when(text.isNotNull(), F.struct(F.lit(d).alias("name"), text.alias("reason"))) for d, text in why.items())))


def artifact_advice(artifacts: Column) -> Column:
    """Distinct texts for artifacts with a suggestion, in order."""

    def one(a: Column) -> Column:
        match, new = a["match"], a["suggestion"]
        secret = F.concat(F.lit("KRITISCH: Entferne das Secret »"), match, F.lit("« sofort! Ersetze es durch eine Umgebungsvariable oder einen Platzhalter."))
        personal = F.concat(F.lit("Datenschutz: Ersetze »"), match, F.lit("« durch "), new, F.lit(" um personenbezogene Daten zu schützen."))
        project = F.concat(F.lit("Ersetze den Projektnamen »"), match, F.lit("« durch einen generischen Platzhalter wie "), new, F.lit("."))
        other = F.concat(F.lit("Ersetze »"), match, F.lit("« durch den generischen Platzhalter "), new, F.lit("."))
        return F.when(a["category"] == "SECRET", secret).when(a["category"] == "PII", personal).when(a["category"] == "PROJECT_ARTIFACT", project).otherwise(other)

    return F.array_sort(F.array_distinct(F.transform(F.filter(artifacts, lambda a: a["suggestion"].isNotNull()), one)))


def replacement(category: Column) -> Column:
    """What usually stands in the place of an artifact of the category."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in REPLACEMENTS.items() for x in kv)), category)
