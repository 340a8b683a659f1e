"""Direction profiles, conflicts of profiles with a document's constraints, and variants of documents made by profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.gates import Gates, folded
from foliant.functions.text import each, plain_rx, strip
from foliant.operators.constraints import CONSTRAINTS, SECURITY, resolutions, with_constraints

MOST_VARIANTS = 5


@dataclass(frozen=True)
class Profile:
    profile_id: str
    label: str
    category: str
    description: str
    prefix: str
    conflicting: tuple[str, ...]
    recommendation: str

    @property
    def compatible(self) -> tuple[str, ...]:
        """Categories of constraints that the profile respects; a short text is compatible with a length limit although both are named."""
        return tuple(c for c, _, _ in CONSTRAINTS if c not in self.conflicting or self.profile_id == "kurz")


# Fixed values.
PROFILES = {p.profile_id: p for p in (
    Profile("sachlich", "Sachlich / Neutral", "sachlich", "Neutrale, objektive Formulierung. Geeignet für Dokumentation, Berichte, Zusammenfassungen.", "Du bist ein Assistent für sachliche, neutrale Darstellungen. Formuliere den folgenden Prompt so um, dass das Ergebnis neutral, objektiv und faktenbasiert ist.", (), "Empfohlen für Dokumentation, Berichte, neutrale Zusammenfassungen und Analyse-Ergebnisse."),
    Profile("verkaeuferisch", "Verkaufsstark / Überzeugend", "verkaeuferisch", "Überzeugende, handlungsorientierte Sprache. Geeignet für Produkttexte, Pitches, Marketing.", "Du bist ein Experte für überzeugende Kommunikation. Formuliere den folgenden Prompt so um, dass das Ergebnis verkaufsstark, handlungsorientiert und überzeugend wirkt.", ("no_examples",), "Empfohlen für Produkttexte, Sales-Pitches, Marketing-Material und Call-to-Action-Inhalte."),
    Profile("technisch", "Technisch / Präzise", "technisch", "Technisch präzise Sprache mit Fachbegriffen. Geeignet für Entwickler-Dokumentation, API-Referenzen, Code-Reviews.", "Du bist ein technischer Experte. Formuliere den folgenden Prompt so um, dass das Ergebnis technisch präzise ist, Fachbegriffe korrekt verwendet und für ein Entwickler-Publikum geeignet ist.", (), "Empfohlen für Entwickler-Dokumentation, API-Referenzen, Code-Reviews und technische Spezifikationen."),
    Profile("kurz", "Kurz / Prägnant", "sachlich", "Maximal komprimiert. Geeignet für Social Media, Kurznachrichten, Status-Updates.", "Formuliere den folgenden Prompt so um, dass das Ergebnis maximal komprimiert und auf das Wesentliche reduziert ist. Keine Ausschweifungen, keine Füllwörter.", ("max_length",), "Empfohlen für Social-Media-Posts, Kurznachrichten, Status-Updates und prägnante Zusammenfassungen."),
    Profile("ausfuehrlich", "Ausführlich / Detailliert", "sachlich", "Umfassende Darstellung mit Kontext und Begründungen. Geeignet für Analysen, Research, Dokumentation.", "Formuliere den folgenden Prompt so um, dass das Ergebnis umfassend, detailliert und mit vollständigem Kontext dargestellt wird.", ("max_length",), "Empfohlen für Deep Dives, Analysen, Research-Papers und umfassende Dokumentation."),
    Profile("kreativ", "Kreativ / Inspirierend", "kreativ", "Kreative, assoziative Sprache. Geeignet für Brainstorming, Storytelling, Ideenfindung.", "Du bist ein kreativer Ideengeber. Formuliere den folgenden Prompt so um, dass das Ergebnis kreativ, inspirierend und assoziativ ist.", ("no_examples", "format_lock"), "Empfohlen für Brainstorming, Storytelling, Marketing-Kreation und Ideenfindung."),
    Profile("kritisch", "Kritisch prüfend", "sachlich", "Hinterfragende, risiko-bewusste Perspektive. Geeignet für Reviews, Audits, Risikoanalysen.", "Du bist ein kritischer Prüfer. Formuliere den folgenden Prompt so um, dass das Ergebnis Risiken, Schwachstellen und Alternativen aktiv hinterfragt.", (), "Empfohlen für Reviews, Audits, Risikoanalysen und Qualitätssicherung."),
    Profile("anfaenger", "Anfängerfreundlich", "sachlich", "Einfache Sprache, erklärt Begriffe. Geeignet für Einsteiger, Tutorials, Onboarding.", "Du erklärst komplexe Themen für Einsteiger. Formuliere den folgenden Prompt so um, dass das Ergebnis in einfacher Sprache gehalten ist und Fachbegriffe erklärt werden.", (), "Empfohlen für Einsteiger-Tutorials, Onboarding-Material und allgemeinverständliche Erklärungen."),
    Profile("experte", "Expertenmodus", "technisch", "Setzt Fachwissen voraus, keine Erklärungen von Grundbegriffen. Geeignet für Fachpublikum.", "Du kommunizierst mit Fachexperten. Formuliere den folgenden Prompt so um, dass das Ergebnis Fachwissen voraussetzt und keine Grundbegriffe erklärt.", (), "Empfohlen für Fachpublikum, wissenschaftliche Kommunikation und Experten-Diskurse."),
    Profile("deep_research", "Deep-Research-orientiert", "technisch", "Tiefgehende Analyse mit Quellenangaben, Methodik und Unsicherheiten. Geeignet für wissenschaftliche Research-Prompts.", "Du führst tiefgehende Recherchen durch. Formuliere den folgenden Prompt so um, dass das Ergebnis Quellen referenziert, Methodik beschreibt und Unsicherheiten transparent macht.", ("offline_only",), "Empfohlen für wissenschaftliche Recherchen, Methodik-Beschreibungen und evidenzbasierte Analysen."),
    Profile("agentisch", "Agenten-/Implementierungsmodus", "technisch", "Ausführbare Anweisungen für autonome Agenten. Geeignet für CI/CD, Automatisierung, Agent-Workflows.", "Du erstellst ausführbare Anweisungen für autonome Agenten. Formuliere den folgenden Prompt so um, dass das Ergebnis klare, schrittweise und überprüfbare Anweisungen enthält.", ("approval_required", "scope_boundary"), "Empfohlen für CI/CD-Pipelines, Automatisierungs-Workflows und autonome Agenten-Instruktionen."),
    Profile("compliance", "Compliance-/Sicherheitsmodus", "sachlich", "Regulatorisch korrekt, sicherheitsbewusst. Geeignet für DSGVO, Audit, Security-Reviews.", "Du prüfst auf regulatorische Korrektheit. Formuliere den folgenden Prompt so um, dass das Ergebnis DSGVO-konform, sicherheitsbewusst und auditierbar ist.", (), "Empfohlen für DSGVO-Compliance, Sicherheits-Audits, regulatorische Dokumentation und Risikobewertungen."),
)}
DEFAULTS = ("sachlich", "technisch", "kurz", "ausfuehrlich", "agentisch")
CUSTOM = "custom"
CLOUD = (r"cloud", r"online", r"remote\s+(?:server|api|service)", r"\bapi\s+(?:aufruf|call|endpoint|key|token)\b", r"web\s*service", r"\binternet\b", r"\bsaas\b", r"\bhttps?://")
CLOUD_GATES = Gates(*CLOUD)


def custom(text: str) -> Profile:
    return Profile(CUSTOM, "Benutzerdefiniert", CUSTOM, f'Benutzerdefinierte Richtung: "{text}"', text, (), "Benutzerdefinierte Richtung — keine automatische Constraint-Prüfung.")


def selected(ids: Sequence[str], custom_text: str = "") -> list[Profile]:
    """The profiles of the ids, each once and in their order; unknown ids, and custom without a text, are left out."""
    text = custom_text.strip()
    return [custom(text) if i == CUSTOM else PROFILES[i] for i in dict.fromkeys(ids) if i in PROFILES or (i == CUSTOM and text)]


def selection_errors(ids: Sequence[str], custom_text: str = "") -> tuple[list[str], list[str]]:
    """Errors and warnings of a selection."""
    ids = list(dict.fromkeys(ids))
    nothing = all(i == CUSTOM for i in ids) and not (CUSTOM in ids and custom_text.strip())
    errors = ["Mindestens ein Profil muss ausgewählt werden oder ein benutzerdefinierter Text angegeben werden."] if nothing else []
    return errors, [f'Unbekannte Profil-ID: "{i}" — wird ignoriert.' for i in ids if i != CUSTOM and i not in PROFILES]


def profile_conflicts(constraints: Column, profile: Profile) -> Column:
    """The constraints (an array of with_constraints()) that the profile goes against: id, constraint_id, category, source, severity, description, resolutions."""
    hit = F.filter(constraints, lambda c: c["category"].isin(*profile.conflicting)) if profile.conflicting else F.filter(constraints, lambda c: F.lit(False))

    def one(c: Column, i: Column) -> Column:
        grave = c["category"].isin(*SECURITY)
        label, text = F.lit(f'Das Profil "{profile.label}" '), c["constraint_text"]
        kept = F.concat(label, F.lit('steht im Konflikt mit der Sicherheitsregel "'), text, F.lit('". Sicherheitsregeln können nicht automatisch abgeschwächt werden. Die Regel bleibt zwingend erhalten.'))
        weak = F.concat(label, F.lit('kollidiert mit der Regel "'), text, F.lit('". Die Regel bleibt erhalten, was die Profil-Wirkung einschränken kann.'))
        return F.struct(
            F.concat(F.lit("DPC_"), F.lpad((i + 1).cast("string"), 3, "0")).alias("id"), c["id"].alias("constraint_id"), c["category"].alias("category"), F.lit(profile.label).alias("source"),
            F.when(grave, "blocking").otherwise("warning").alias("severity"), F.when(grave, kept).otherwise(weak).alias("description"), resolutions(c["category"]).alias("resolutions"),
        )

    return F.transform(hit, one)


def review_conflicts(constraints: Column) -> Column:
    """All constraints, for a person to hold against a custom direction."""
    text = lambda c: F.concat(F.lit('Benutzerdefinierte Richtung: Automatische Prüfung nicht möglich. Constraint "'), c["constraint_text"], F.lit('" muss manuell auf Kompatibilität geprüft werden.'))
    return F.transform(constraints, lambda c, i: F.struct(F.concat(F.lit("VC_CUSTOM_"), (i + 1).cast("string")).alias("id"), c["id"].alias("constraint_id"), c["category"].alias("category"), F.lit("Benutzerdefiniert").alias("source"), F.lit("warning").alias("severity"), text(c).alias("description"), F.array(F.lit("manual_review")).alias("resolutions")))


def conflicts_of_profiles(docs: DataFrame, ids: Sequence[str] = tuple(PROFILES), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each constraint of a document that one of the profiles goes against: key, profile_id and the fields of profile_conflicts()."""
    df = with_constraints(docs.select(key, text), text, "_all")
    named = lambda i: F.transform(profile_conflicts(F.col("_all"), PROFILES[i]), lambda c: F.struct(F.lit(i).alias("profile_id"), c.alias("c")))
    return each(df, F.flatten(F.array(*map(named, ids))), "x", key).select(key, "x.profile_id", "x.c.*")


def variants(docs: DataFrame, ids: Sequence[str] = DEFAULTS, custom_text: str = "", most: int = MOST_VARIANTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and one of the first `most` profiles: key, variant_id, profile_id, label, content, explanation, preserved (constraint_id, category,
    affected), conflicts, assumptions, recommendation, and source.

    The content is the profile's text, a blank line and the document; a blank document has no variant text."""
    df = with_constraints(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("source")), "source", "_all")
    blank = strip(F.col("source")) == ""

    def one(i: int, p: Profile) -> Column:
        preserved = F.transform("_all", lambda c: F.struct(c["id"].alias("constraint_id"), c["category"].alias("category"), (c["category"].isin(*p.conflicting) if p.conflicting else F.lit(False)).alias("affected")))
        done = F.array(F.lit(f'Profil-Prefix "{p.label}" wurde vorangestellt.'), F.lit("Keine Änderung an den Constraints des Original-Prompts."))
        return F.struct(
            F.lit(f"VAR_{p.profile_id}_{i + 1}").alias("variant_id"), F.lit(p.profile_id).alias("profile_id"), F.lit(p.label).alias("label"), F.when(blank, "").otherwise(F.concat(F.lit(p.prefix + "\n\n"), "source")).alias("content"),
            F.lit(p.description).alias("explanation"), preserved.alias("preserved"), (review_conflicts(F.col("_all")) if p.profile_id == CUSTOM else profile_conflicts(F.col("_all"), p)).alias("conflicts"),
            F.when(blank, F.array(F.lit("Keine Änderung möglich — Original unverändert."))).otherwise(done).alias("assumptions"), F.lit(p.recommendation).alias("recommendation"),
        )

    chosen = selected(ids, custom_text)[:most]
    if not chosen:
        chosen, df = [PROFILES["sachlich"]], df.where("false")
    return df.select(key, "source", F.explode(F.array(*(one(i, p) for i, p in enumerate(chosen)))).alias("v")).select(key, "v.*", "source")


def validated(made: DataFrame) -> DataFrame:
    """variants() with what must hold of each: original_unchanged, constraints_preserved, no_cloud_references, constraints_listed and content_different."""
    df = with_constraints(with_constraints(made, "source", "_before"), "content", "_after")
    categories = lambda c: F.transform(c, lambda x: x["category"])
    df = df.withColumn("_passed", CLOUD_GATES.passed(folded(F.coalesce("content", F.lit("")))))
    cloud = sum(((CLOUD_GATES.may(F.col("_passed"), p) & F.col("content").rlike(plain_rx(p))).cast("int") for p in CLOUD), F.lit(0)) > 0
    return df.withColumns({
        "original_unchanged": (F.col("source") != F.col("content")) | (F.col("source") == ""), "constraints_preserved": F.size(F.array_except(categories("_before"), categories("_after"))) == 0,
        "no_cloud_references": ~F.array_contains(categories("_before"), "offline_only") | ~cloud,
        "constraints_listed": F.size(F.array_except(F.transform("_before", lambda x: x["id"]), F.transform("preserved", lambda x: x["constraint_id"]))) == 0, "content_different": F.col("source") != F.col("content"),
    }).drop("_before", "_after", "_passed")
