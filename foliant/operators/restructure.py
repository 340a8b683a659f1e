"""Rewriting of documents by sections, in three modes: tidy (conservative), structured (balanced) and scaffolded (aggressive); and a check of the result.

Sections are moved, merged and renamed line by line, which columns cannot express well: this is Python over Arrow batches, one text at a time, so that a
task holds a batch. What differs between prompts and blueprints is a Style."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.operators.hygiene import FOREIGN_APPS

FENCE = re.compile(r"^```[\s\S]*?^```", re.M)
HEADING = re.compile(r"#{1,3}\s+[^\n\r\u2028\u2029]")
CODE = "\ue000{}\ue001"
MODES = ("conservative", "balanced", "aggressive")
SCAFFOLD_FROM = 200
#: Bytes of text that are rewritten before the results become Arrow.
SLICE = 1 << 16


@dataclass(frozen=True)
class Style:
    """Sections in their order: key, expression for headings (lower case) and usual heading. listed: keys whose lines become bullets, unless they begin with one of unlisted.
    texts: what is reported, by name. scaffolds: sections that the aggressive mode adds. marks: what the tidy mode marks as foreign."""

    sections: tuple[tuple[str, str, str], ...]
    listed: tuple[str, ...]
    unlisted: tuple[str, ...]
    texts: dict[str, str]
    scaffolds: tuple[tuple[str, tuple[str, ...]], ...]
    placeholders: tuple[str, ...]
    short: int
    quoted: int
    foreign: tuple[str, ...] = ()
    stale: tuple[str, ...] = ()
    legacy: bool = False
    final: bool = False

    def key(self, heading: str) -> str | None:
        name = re.sub(r"^#{1,3}\s*", "", heading).strip().lower()
        return next((k for k, pattern, _ in self.sections if re.search(pattern, name, re.I)), None)


# Expressions for headings and placeholders, and texts that users see.
TODO = (r"<!--\s*TODO", r"\bTODO\s*:", r"\bTBD\b", r"requirements?\s+ergänzen", r"verify\s+ergänzen", r"Anforderungen?\s+ergänzen", r"Acceptance\s+Criteria\s+ergänzen", r"Verifikation\s+ergänzen", r"\bplaceholder\b", r"\bPlatzhalter\b")
PROMPT = Style(
    sections=(
        ("role", r"Rolle|Rollendefinition|Role Definition|Role", "## Rollendefinition"), ("context", r"Kontext|Kontextqualität|Context", "## Kontext"), ("goal", r"Ziel|Zieldefinition|Goal|Objective", "## Ziel"),
        ("requirements", r"Anforderung|Requirements", "## Anforderungen"), ("constraints", r"Einschränkung|Constraint|Grenze|Boundary|Limitation", "## Einschränkungen / Constraints"),
        ("output", r"Output|Ausgabeformat|Output Format|Ergebnis|Result", "## Ausgabeformat"), ("verify", r"Verif(?:ication|izierung)|Prüfung|Acceptance|Akzeptanz", "## Verifikation / Acceptance Criteria"),
    ),
    listed=("requirements",), unlisted=("-", "*", "```", "<!--"), short=50, quoted=40, placeholders=TODO, legacy=True, final=True,
    texts={
        "empty": "Input ist leer — keine Optimierung möglich.", "short": "Eingabe ist sehr kurz (< 50 Zeichen). Nur minimale Optimierung angewendet.", "trailing": "Zeile {}: Leerzeichen am Zeilenende entfernt",
        "blank": "Mehrfache Leerzeilen zu einer reduziert", "bullet": "Zeile {}: Aufzählung normalisiert ({} → -)", "break": "Leerzeile vor Überschrift (Zeile {}) eingefügt", "level": 'Überschrift normalisiert: "{}" → "{}"',
        "merge": 'Doppelte Sektion "{}" zusammengeführt', "missing": 'Fehlende Sektion "{}" nicht ergänzt — keine automatische TODO-Platzhalter-Injektion. Bitte manuell ergänzen.', "order": "Sektionen in kanonische Reihenfolge gebracht",
        "listed": 'Anforderung in Aufzählung konvertiert: "{}..."', "scaffold_short": "Eingabe ist unter 200 Zeichen. Aggressive Optimierung teilweise deaktiviert. Nur minimale Workflow-Scaffolds werden hinzugefügt.",
        "added": "Workflow-Sektion ergänzt: {}", "scaffolded": "Hinweis: Aggressive Optimierung fügt umfangreiche Struktur hinzu. Kontext-Engineering-Profil-Platzhalter bitte vor Verwendung mit konkreten Projektdetails ausfüllen.",
        "placeholders": "Optimierte Ausgabe enthält {} unresolved Placeholder: {}", "hollow": "Optimierte Ausgabe enthält {} leere Sektionen: {}", "nothing": "Keine sichere automatische Änderung vorgenommen.",
    },
    scaffolds=(
        ("## Agenten-Workflow", ("Der folgende Workflow beschreibt die sequenzielle Verarbeitungskette für diesen Prompt:", "", "```text", "Issue → Spec → Verification Contract → Red Tests → Agent-Code → CI/Security Gates → Sandbox Preview → Reviewer-Agent → Human Approval → Evidence-Kommentar → Merge", "```", "", "Jeder Schritt erzeugt einen überprüfbaren Artefakt. Kein Schritt überspringen.", "")),
        ("## Kontext-Engineering-Profil", ("### Cold Context", "_(Bitte ausfüllen: Hintergrundwissen, das der Agent voraussetzen muss)_", "", "### Warm Context", "_(Bitte ausfüllen: Spezifische Umgebungsdetails, Tools, Versionen)_", "", "### Hot Context", "_(Bitte ausfüllen: Aktuelle Session-Details, was jetzt gerade passiert)_", "", "### Excluded Context", "_(Bitte ausfüllen: Was der Agent NICHT tun soll, verbotene Aktionen)_", "", "### Source of Truth", "_(Bitte ausfüllen: Wo die endgültige Wahrheit liegt — Issue, Repo, API-Doc)_", "", "### Confidence", "Der Agent muss bei jeder Aussage das Confidence-Level angeben: HIGH / MEDIUM / LOW", "", "### Evidence", "Jeder Schritt muss mit einem nachvollziehbaren Evidence-Artefakt belegt werden.", "")),
        ("## Verification Contract", ("Vor Abschluss prüfen:", "", "- [ ] Alle Acceptance Criteria erfüllt", "- [ ] Red Tests → Green Tests durchlaufen", "- [ ] CI/Security Gates grün", "- [ ] Reviewer-Agent hat freigegeben", "- [ ] Human Approval liegt vor", "- [ ] Evidence-Kommentar im Issue gepostet", "- [ ] Kein ungeplanter Scope Creep", "")),
        ("## Human Approval Gate", ("**WICHTIG:** Kein Merge, Commit oder Deploy ohne explizite Human Approval.", "", "Vor Human Approval vorlegen:", "", "1. Diff-Stat", "2. Geänderte Dateien", "3. Testliste mit Ergebnissen", "4. Gates-Status", "5. Review-Agent Ergebnis", "6. Empfehlung: READY TO COMMIT / CHANGES NEEDED / BLOCKED", "")),
    ),
)
LEGACY_SECTION = re.compile(r"##\s+Kontextfenster-Empfehlung[\s\S]*?(?=\n##\s|\Z)", re.I)
LEGACY_WINDOW = re.compile(r"Starte\s+diesen\s+Auftrag\s+in\s+einem\s+frischen/leeren\s+Kontextfenster", re.I)
REFRESH = "\n".join((
    "## Context Boundary / Reality Refresh", "", "- Chatverlauf, Memory und frühere Reports gelten als STALE_UNTIL_VALIDATED.", "- Source of Truth ist der aktuell validierte Zustand aus Git, Issues, PRs, Releases, Dateien und lokalen Gates.",
    "- Alte Reports dürfen nur als historische Evidence genutzt werden.", "- Widersprechen alte Angaben dem aktuellen Repo-Zustand, gilt der aktuelle Repo-/GitHub-/Testzustand.", "",
))
LEGACY_TEXTS = ('Legacy "Kontextfenster-Empfehlung" durch "Context Boundary / Reality Refresh" ersetzt', "## Context Boundary / Reality Refresh (Legacy-Kontextfenster-Empfehlung erkannt)", "Legacy-Kontextfenster-Empfehlung erkannt — besser durch Context Boundary / Reality Refresh ersetzen.")
BLUEPRINT = Style(
    sections=(
        ("goal", r"Ziel|Goal|Objective|Purpose|Zweck|Vision", "## Ziel / Goal"), ("scope", r"Scope|Umfang|In Scope|Out of Scope|Boundar|Grenz", "## Scope / Umfang"),
        ("architecture", r"Architektur|Architecture|Component|Komponente|System Design|Data Flow|Datenfluss", "## Architecture / Architektur"), ("implementation", r"Implementierung|Implementation|Phases|Phasen|Roadmap|Plan|Sprint|Milestone|MVP", "## Implementation Plan / Umsetzungsplan"),
        ("risks", r"Risks?|Risiken|Limitations?|Einschränkungen|Assumptions|Annahmen|Threats", "## Risks & Known Limitations / Risiken & bekannte Einschränkungen"), ("security", r"Security|Sicherheit|Privacy|Datenschutz|Auth|Compliance|GDPR|DSGVO", "## Security & Privacy / Sicherheit & Datenschutz"),
        ("testing", r"Tests?|Testing|Testen|QA|Quality|Red Tests|Verification", "## Testing & Verification / Tests & Verifikation"), ("evidence", r"Evidence|Nachweise?|Belege?|Proof|Verification Contract|Akzeptanz", "## Evidence & Verification Contract / Nachweise & Verifikationsvertrag"),
        ("next_steps", r"Next Steps?|Nächste Schritte|Handoff|Übergabe|Follow.?up|Action Items", "## Next Steps / Nächste Schritte"),
    ),
    listed=("implementation", "scope"), unlisted=("-", "*", "```", "<!--", "~~"), short=100, quoted=50, placeholders=tuple(p for p in TODO if "Criteria" not in p and "Verifikation" not in p), foreign=FOREIGN_APPS[:3],
    stale=(r"run\s*report\s*(?:from|vom|dated?)\s*202[0-5]", r"test run\s*(?:from|vom|dated?)\s*202[0-5]", r"test\s*results?\s*(?:from|vom|dated?)\s*202[0-5]"),
    texts={
        "empty": "Blueprint input is empty — no optimization possible.", "short": "Blueprint input is very short (< 100 chars). Only minimal optimization applied.", "trailing": "Line {}: trailing whitespace removed",
        "blank": "Multiple blank lines collapsed to one", "bullet": "Line {}: list bullet normalized ({} → -)", "break": "Blank line inserted before heading (line {})", "level": 'Heading normalized: "{}" → "{}"',
        "merge": 'Duplicate section "{}" merged', "missing": 'Missing section "{}" not auto-injected. Please add manually.', "order": "Sections reordered to canonical blueprint sequence", "listed": 'Line converted to bullet: "{}..."',
        "scaffold_short": "Blueprint input under 200 chars. Aggressive optimization partially disabled. Only minimal scaffolding added.", "added": "Blueprint scaffolding section added: {}",
        "scaffolded": 'Note: Aggressive optimization adds extensive scaffolding. Fill in the "Was kann die Software jetzt..." section with actual implementation results.',
        "foreign": 'Foreign app name "{}" marked as contaminated', "stale": "Stale run report marked", "placeholders": "Optimized output contains {} unresolved placeholder(s): {}", "hollow": "Optimized output contains {} empty section(s): {}",
        "marked": "Optimized output still contains contamination markers. Manual review required.",
    },
    scaffolds=(
        ("## Verification Contract", ("Before considering this blueprint complete, verify:", "", "- [ ] All acceptance criteria are defined and measurable", "- [ ] Architecture covers all components and data flows", "- [ ] Scope boundaries (in/out of scope, MVP cut) are clear", "- [ ] Risks are identified with mitigation plans", "- [ ] Security and privacy considerations are addressed", "- [ ] Test strategy is defined with red test expectations", "- [ ] Evidence requirements are specified (what proves completion?)", "- [ ] Human approval gates are defined where needed", "")),
        ("## Human Approval Gate", ("**IMPORTANT:** No merge, commit, or deploy without explicit Human Approval.", "", "Before requesting Human Approval, ensure:", "", "1. All acceptance criteria are met", "2. All tests pass (red → green)", "3. CI/Security gates are green", "4. Reviewer-Agent has approved (if applicable)", "5. Evidence artifacts are collected and posted", "6. No unplanned scope creep has occurred", "")),
        ("## Evidence & Portfolio", ("Evidence artifacts to collect during implementation:", "", "- Test results (pass/fail counts, test output)", "- CI pipeline status (green/red/failed)", "- Diff stats (files changed, lines added/removed)", "- Screenshots (UI changes, visual regressions)", "- Review findings (reviewer-agent report)", "- Approval records (human approval timestamp)", "")),
        ("## Was kann die Software jetzt im Vergleich zum vorherigen Lauf?", ("### Neue Fähigkeiten", "_(To be filled after implementation: what new capabilities were added?)_", "", "### Entfernte Blocker", "_(What blockers were resolved?)_", "", "### Veraltete Annahmen, die entfernt oder markiert wurden", "_(What stale assumptions were corrected?)_", "", "### Unveränderte Einschränkungen", "_(What limitations remain unchanged?)_", "", "### Verbleibende Risiken", "_(What risks remain after this implementation?)_", "", "### Nächster sinnvoller Schritt", "_(What should happen next?)_", "")),
    ),
)
STYLES = {"prompt": PROMPT, "blueprint": BLUEPRINT}


@dataclass
class Draft:
    """A text while it is rewritten. Code is outside: a number between private characters stands in its place."""

    text: str
    code: list[str]
    changes: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @staticmethod
    def of(text: str) -> Draft:
        code: list[str] = []

        def keep(m: re.Match) -> str:
            code.append(m[0])
            return CODE.format(len(code) - 1)

        return Draft(FENCE.sub(keep, text), code)

    def whole(self) -> str:
        return re.sub(CODE.format(r"(\d+)"), lambda m: self.code[int(m[1])] if int(m[1]) < len(self.code) else m[0], self.text)


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def tidied(text: str, style: Style) -> Draft:
    """Without white space at line ends and second blank lines, with dashes as bullets and a blank line before headings; foreign matter is marked."""
    draft, say = Draft.of(text), style.texts
    rows: list[str] = []
    squeezed = False
    for i, raw in enumerate(draft.text.split("\n"), 1):
        line = raw.rstrip(" \t")
        if line != raw:
            draft.changes.append(("whitespace", say["trailing"].format(i)))
        if not line.strip() and rows and not rows[-1].strip():
            squeezed = True
        else:
            rows.append(line)
    if squeezed:
        draft.changes.append(("whitespace", say["blank"]))
    for i, line in enumerate(rows):
        if m := re.match(r"(\s*)([*+])\s", line):
            rows[i] = m[1] + "- " + line[m.end() :]
            draft.changes.append(("format", say["bullet"].format(i + 1, m[2])))
    is_heading = [bool(re.match(r"#{1,3}\s", line)) for line in rows]
    out: list[str] = []
    for i, line in enumerate(rows):
        if i and is_heading[i] and rows[i - 1].strip() and not is_heading[i - 1]:
            out.append("")
            draft.changes.append(("format", say["break"].format(i + 1)))
        out.append(line)
    draft.text = marked("\n".join(out), style, draft)
    if not draft.text.endswith("\n"):
        draft.text += "\n"
    if units(text.strip()) < style.short:
        draft.warnings.append(say["short"])
    return draft


def marked(text: str, style: Style, draft: Draft) -> str:
    for name in style.foreign:
        text, n = re.subn(rf"(?ia)\b{name}\b", f"~~CONTAMINATED:{name}~~", text)
        if n:
            draft.changes.append(("content", style.texts["foreign"].format(name)))
    for pattern in style.stale:
        text, n = re.subn(f"(?i){pattern}", lambda m: f"~~STALE_RUN_REPORT:{m[0]}~~", text, count=1)
        if n:
            draft.changes.append(("content", style.texts["stale"]))
    return text


def structured(draft: Draft, style: Style) -> Draft:
    """Known sections in their order, each once, then the others; all headings of one level; lines of some sections as bullets."""
    say = style.texts
    before: list[str] = []
    found: list[tuple[str | None, str, list[str]]] = []
    for line in draft.text.split("\n"):
        if HEADING.match(line):
            found.append((style.key(line), line, []))
        else:
            (found[-1][2] if found else before).append(line)
    levelled = []
    for key, heading, body in found:
        if re.match(r"(?:#|###)\s", heading):
            new = re.sub(r"^#{1,3}\s", "## ", heading)
            draft.changes.append(("structure", say["level"].format(heading.strip(), new.strip())))
            heading = new
        levelled.append((key, heading, body))
    known: dict[str, tuple[str, list[str]]] = {}
    for key, heading, body in levelled:
        if key in known:
            known[key][1].extend(["", *body])
            draft.changes.append(("structure", say["merge"].format(key)))
        elif key:
            known[key] = (heading, list(body))
    draft.warnings += [say["missing"].format(usual) for key, _, usual in style.sections if key not in known]
    ordered = [(key, *known[key]) for key, _, _ in style.sections if key in known] + [s for s in levelled if s[0] is None]
    if [s[0] for s in ordered] != [s[0] for s in found]:
        draft.changes.append(("reorder", say["order"]))
    out = before
    for key, heading, body in ordered:
        out += [heading, ""]
        for line in body:
            bare = line.strip()
            if key in style.listed and bare and not bare.startswith(style.unlisted):
                line = f"- {bare}"
                draft.changes.append(("structure", say["listed"].format(bare[: style.quoted])))
            out.append(line)
        if out[-1] != "":
            out.append("")
    draft.text = "\n".join([*out, ""])
    return draft


def scaffolded(draft: Draft, style: Style, size: int) -> Draft:
    """With the sections of an agent's workflow behind it."""
    say = style.texts
    if size < SCAFFOLD_FROM:
        draft.warnings.append(say["scaffold_short"])
    if style.legacy and (LEGACY_SECTION.search(draft.text) or LEGACY_WINDOW.search(draft.text)):
        if LEGACY_SECTION.search(draft.text):
            draft.text = LEGACY_SECTION.sub(lambda _: REFRESH, draft.text, count=1)
            draft.changes.append(("replace_section", LEGACY_TEXTS[0]))
        else:
            draft.text += "\n" + REFRESH
            draft.changes.append(("add_section", LEGACY_TEXTS[1]))
        draft.warnings.append(LEGACY_TEXTS[2])
    for heading, lines in style.scaffolds:
        draft.text += heading + "\n\n" + "\n".join(lines)
        draft.changes.append(("add_section", say["added"].format(heading)))
    draft.warnings.append(say["scaffolded"])
    return draft


def finished(draft: Draft, original: str, result: str) -> None:
    """Leaves out changes that the result doesn't show, and says so where nothing changed."""
    plain = lambda x: x.replace("\r\n", "\n")
    before, after = plain(original), plain(result)

    def shown(kind: str, description: str) -> bool:
        if kind != "add_section":
            return before != after or kind != "reorder"
        m = re.search(r'"(##[^"]+)"', description) or re.search(r"(##\s.+)$", description)
        return m[1].strip() in after and m[1].strip() not in before if m else before != after

    draft.changes = [c for c in draft.changes if shown(*c)] if before != after else []
    if before == after and not draft.warnings:
        draft.warnings.append(PROMPT.texts["nothing"])


def rewritten(text: str | None, mode: str, style: Style) -> dict:
    """optimized, changes (type, description), warnings and contamination_cleaned of one text. Blank texts become empty."""
    text = text or ""
    if not text.strip():
        draft, result = Draft("", [], [], [style.texts["empty"]]), ""
    else:
        draft = tidied(text, style)
        if mode != "conservative":
            draft = structured(draft, style)
        if mode == "aggressive":
            draft = scaffolded(draft, style, units(text.strip()))
        result = draft.whole()
    cleaned = any(kind == "content" for kind, _ in draft.changes)
    if style.final:
        finished(draft, text, result)
    return {"optimized": result, "changes": [{"type": t, "description": d} for t, d in draft.changes], "warnings": draft.warnings, "contamination_cleaned": cleaned}


def checked(original: str | None, result: str | None, style: Style) -> dict:
    """Whether a result has no open placeholders, no known section without content, and (of blueprints) no marks of foreign matter."""
    original, result = original or "", result or ""
    open_ones = list(dict.fromkeys(m[0] for p in style.placeholders if (m := re.search(p, result, re.I | re.A))))
    heads = list(re.finditer(r"^##\s+([^\n\r\u2028\u2029]+)$", result, re.M))
    hollow = []
    for m, following in zip(heads, [*heads[1:], None], strict=False):
        body = result[m.start() + len(m[1]) + 4 : following.start() if following else len(result)]
        said = [x for line in body.split("\n") if (x := line.strip()) and not x.startswith("<!--") and not any(re.search(p, x, re.I | re.A) for p in style.placeholders) and not (style.foreign and x.startswith("~~"))]
        if style.key(f"## {m[1]}") and not said:
            hollow.append(m[1])
    marks = bool(style.foreign) and bool(re.search(r"~~CONTAMINATED:|~~STALE_RUN_REPORT:", result, re.I))
    warnings = [style.texts[name].format(len(x), ", ".join(x)) for name, x in (("placeholders", open_ones), ("hollow", hollow)) if x] + ([style.texts["marked"]] if marks else [])
    passed = not open_ones and not hollow and not marks
    longer = len(re.sub(r"\s", "", result)) >= len(re.sub(r"\s", "", original))
    return {"passed": passed, "unresolved_placeholders": open_ones, "empty_sections": hollow, "warnings": warnings, "structural_improvement_confirmed": passed and longer, "contamination_resolved": not marks}


REWRITTEN = pa.struct([("optimized", pa.string()), ("changes", pa.list_(pa.struct([("type", pa.string()), ("description", pa.string())]))), ("warnings", pa.list_(pa.string())), ("contamination_cleaned", pa.bool_())])
CHECKED = pa.struct([("passed", pa.bool_()), ("unresolved_placeholders", pa.list_(pa.string())), ("empty_sections", pa.list_(pa.string())), ("warnings", pa.list_(pa.string())), ("structural_improvement_confirmed", pa.bool_()), ("contamination_resolved", pa.bool_())])


def slices(*arrays: pa.Array) -> Iterator[list[pa.Array]]:
    """The arrays row by row, so many rows at a time as have SLICE bytes of text; the last of them may have more."""
    begin = size = 0
    for i in range(len(arrays[0])):
        size += sum(len(a[i].as_buffer()) if a[i].is_valid else 0 for a in arrays)
        if size >= SLICE or i + 1 == len(arrays[0]):
            yield [a.slice(begin, i + 1 - begin) for a in arrays]
            begin, size = i + 1, 0


def _by_text(f: Callable[..., dict], kind: pa.DataType, *columns: Column) -> Column:
    """f of the texts in a batch, by Arrow. What Python holds at a time are the texts and results of a slice, as results have many small objects."""
    from pyspark.sql.pandas.types import from_arrow_type

    def run(*arrays: pa.Array) -> pa.Array:
        done = [pa.array([f(*row) for row in zip(*(a.to_pylist() for a in part), strict=True)], kind) for part in slices(*arrays)]
        return pa.concat_arrays(done) if done else pa.array([], kind)

    one, two = (lambda a: run(a)), (lambda a, b: run(a, b))
    wrapped = one if len(columns) == 1 else two
    wrapped.__annotations__ = {n: pa.Array for n in ("a", "b")[: len(columns)]} | {"return": pa.Array}
    return F.arrow_udf(wrapped, from_arrow_type(kind))(*columns)


def optimized(text: Column, mode: str = "balanced", kind: str = "prompt") -> Column:
    """A struct of optimized, changes, warnings and contamination_cleaned. kind: prompt or blueprint."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    style = STYLES[kind]
    return _by_text(lambda x: rewritten(x, mode, style), REWRITTEN, text)


def validated(original: Column, result: Column, kind: str = "prompt") -> Column:
    """A struct as checked() gives it."""
    style = STYLES[kind]
    return _by_text(lambda a, b: checked(a, b, style), CHECKED, original, result)


# Words of a recommendation, and the section that answers it.
BLOCKS = (
    ("secret", "## Sicherheit", "Secrets entfernen. Zugänge über Umgebungsvariablen oder Platzhalter referenzieren."), ("datenschutz|pii|personenbezogen", "## Datenschutz", "Personenbezogene Daten anonymisieren (Platzhalter statt echter Namen)."),
    ("ziel", "## Ziel", "Das Ziel dieser Aufgabe in einem Satz präzise formulieren."), ("rolle", "## Rolle", "Rolle und Kompetenzen des Agenten beschreiben."),
    ("kontext|context", "## Kontext", "Relevanten Kontext ergänzen (Projekt, Umgebung, Voraussetzungen)."), ("ausgabeformat|output|struktur|abschnitte", "## Ausgabeformat", "Ausgabeformat definieren: Struktur, Abschnitte, Länge."),
    ("anforderung|regel", "## Anforderungen", "Anforderungen als nummerierte, imperative Regeln auflisten."), ("constraint|grenzen|begrenz", "## Constraints", "Explizite Grenzen definieren: »Erlaubt ist nur …«"),
)
BLOCK_OTHER = "<hier die Ergänzung formulieren>"


def blocks(recommendations: Column) -> Column:
    """For each recommendation: id, source, heading and text of the section that it asks for, in their order."""

    def one(r: Column, i: Column) -> Column:
        heading, body = F, F
        for words, h, b in BLOCKS:
            heading, body = heading.when(r.rlike(f"(?iu){words}"), h), body.when(r.rlike(f"(?iu){words}"), b)
        heading = heading.otherwise(F.concat(F.lit("## Ergänzung "), (i + 1).cast("string")))
        text = F.concat(heading, F.lit("\n\n<!-- Empfehlung: "), r, F.lit(" -->\n"), body.otherwise(BLOCK_OTHER))
        return F.struct(F.concat(F.lit("rec-block-"), i.cast("string")).alias("id"), r.alias("source"), heading.alias("heading"), text.alias("text"))

    return F.transform(recommendations, one)


def preview(text: Column, found: Column) -> Column:
    """The text with blocks() behind it; the text itself without any."""
    joined = F.array_join(F.transform(found, lambda b: F.regexp_replace(b["text"], r"(?U)^\s+|\s+\z", "")), "\n\n")
    bare = F.regexp_replace(text, r"(?U)\s+\z", "")
    return F.when(F.size(found) <= 0, text).otherwise(F.concat(bare, F.when(bare != "", "\n\n").otherwise(""), joined, F.lit("\n")))
