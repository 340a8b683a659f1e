"""DuckDB SQL for routing, features and quality: the same rules as the operators', in another engine and by lists instead of columns.

RE2 knows no Unicode word edges and no look-around, so rx2() writes the edges out."""

from __future__ import annotations

import re

from foliant.functions.text import alternation
from foliant.operators import features as X
from foliant.operators import lexicons as lex
from foliant.operators import quality, router

WORD = r"[\p{L}\p{N}_]"
NO_WORD = r"[^\p{L}\p{N}_]"


def rx2(pattern: str) -> str:
    p = pattern.replace(r"\w*\b", r"\w*")
    p = re.sub(r"(^|\(\?[imsU]+\)|\(\?:|\(|\|)\\b", lambda m: m[1] + f"(?:^|{NO_WORD})", p)
    return p.replace(r"\b", f"(?:$|{NO_WORD})").replace(r"[\w\-]", r"[\p{L}\p{N}_\-]").replace(r"\w", WORD)


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(rx2(pattern))})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(rx2(pattern))}))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def some(array: str, condition: str) -> str:
    return f"len(list_filter({array}, lambda s: {condition}))"


def any_of(x: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches(lower({x}), {q(alternation(w.lower() for w in words))})"


def whole_word(x: str, words: tuple[str, ...], plural: str = "") -> str:
    return has(x, rf"(?i)\b{alternation(words)}{plural}\b")


def after(x: str, pattern: str) -> str:
    """What follows the first match; null without one."""
    return f"CASE WHEN {has(x, pattern)} THEN regexp_replace({x}, {q('(?s)^.*?(?:' + rx2(pattern) + ')')}, '') END"


def ladder(*steps: tuple[str, object], default: object = 0) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + f" ELSE {default} END"


def bare(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')"


def words(x: str) -> str:
    return rf"regexp_split_to_array({strip(x)}, '\s+')"


def four(x: str) -> str:
    return f"len(list_filter({words(x)}, lambda w: length({bare('w')}) >= 4 AND NOT regexp_matches({bare('w')}, '^[0-9]+$'))) > 0"


def substantive(x: str) -> str:
    return f"({strip(x)} <> '' AND (strlen({strip(x)}) > 25 OR len(list_filter({words(x)}, lambda w: strlen({bare('w')}) >= 5 AND NOT regexp_matches({bare('w')}, '^[0-9]+$'))) > 0))"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '[.!?\n]'), lambda z: {strip('z')}), lambda z: z <> '' AND NOT starts_with(z, '#') AND NOT regexp_matches(z, '^[-*_=~]{{3,}}$'))"


def boilerplate(p: str) -> str:
    return f"({any_of(p, X.BOILERPLATE)} OR {has(strip(f'string_split({p}, chr(10))[1]'), X.BOILERPLATE_LABEL)} OR coalesce({has(f'({sentences(p)})[1]', X.BOILERPLATE_LABEL)}, false))"


_names = alternation(x.lower() for x in lex.GUIDELINE_HEADINGS)
_suffixes = alternation(lex.COMPOUND_HEADING_SUFFIXES)
_opener = rf"(?i){alternation(lex.IMPERATIVES_DE + lex.IMPERATIVES_EN)}(?:$|[^\p{{L}}\p{{N}}])"
_marker = r"(?:[-*] |[0-9]+[.)] *)"
_low = lambda words: " + ".join(f"CAST(contains(low, {q(w)}) AS INT)" for w in words)
_tasks = {name: f"len(list_filter(rsents, lambda s: {has('s', router.GENERATION_VERB)} AND {has('s', chr(92) + 'b' + alternation(lex.ARTIFACT_NOUNS) + chr(92) + 'b')}))" if p is None else count("low", p) for name, p in router.TASKS.items()}


def route(texts: str) -> str:
    """CTEs up to rt: doc_id, t, sents, lines, kind, task, language, confidence. texts: a query of doc_id and t."""
    return rf"""tx AS ({texts}),
  r1 AS (SELECT doc_id, t, lower(t) AS low, {sentences("t")} AS sents, list_filter(list_transform(regexp_split_to_array(t, '[.!?;\n]'), lambda z: {strip("z")}), lambda z: z <> '') AS rsents, list_transform(regexp_split_to_array(t, '\r?\n'), lambda z: {strip("z")}) AS lines FROM tx),
  r2 AS (SELECT *, list_filter(list_transform(list_filter(lines, lambda z: starts_with(z, '#')), lambda z: struct_pack(h := {strip("regexp_replace(z, '^#', '')")}, f := starts_with(z, '# '))), lambda z: z.h <> '') AS heads FROM r1),
  r3 AS (SELECT *, len(list_filter(heads, lambda z: regexp_matches(lower(z.h), {q("^" + _names + r"(?:\s|$)")}) OR (z.f AND regexp_matches(lower(z.h), {q(r"(?:^|\s)" + _names + "$")})))) AS canonical,
    len(list_filter(heads, lambda z: regexp_matches(lower(z.h), {q(_suffixes + "$")}))) AS compound, len(list_filter(lines, lambda z: regexp_matches(z, {q("^" + _marker + _opener)}))) AS bullets,
    len(list_filter(lines, lambda z: NOT regexp_matches(z, {q("^" + _marker)}) AND regexp_matches(z, {q("^" + _opener)}) AND regexp_matches(z, '\s\S'))) AS plain, {some("rsents", has("s", router.ACTION))} AS acts,
    len(list_filter(lines, lambda z: z <> '')) AS filled, {count("t", router.PLACEHOLDER)} AS marks_, {count("t", router.LABELED_FIELD)} AS fields, [{", ".join(_tasks.values())}] AS scores FROM r2),
  r4 AS (SELECT *, canonical * 1.0::DOUBLE + compound * 0.8::DOUBLE + (bullets + plain + CASE WHEN canonical > 0 THEN {some("rsents", has("s", router.MODAL_RULE))} ELSE 0 END) * 0.6::DOUBLE + least(len(regexp_extract_all(low, {q(alternation(x.lower() for x in lex.POLICY_TERMS))})) * 0.5::DOUBLE, 1.0::DOUBLE) AS points0 FROM r3),
  r5 AS (SELECT *, points0 + CASE WHEN points0 < 2 AND bullets >= 3 AND len(heads) = 0 AND NOT contains(t, '{{') THEN 1.5 ELSE 0 END AS points,
    CAST(marks_ / greatest(filled, 1) >= 0.3 AS INT) + CAST(regexp_matches(low, {q(alternation(x.lower() for x in lex.TEMPLATE_MARKERS))}) AS INT) + CAST(fields >= 3 AS INT) AS marks, list_max(scores) AS top, {_low(lex.STOPWORDS_DE)} AS de, {_low(lex.STOPWORDS_EN)} AS en FROM r4),
  r6 AS (SELECT *, CASE WHEN points >= 2 AND NOT (acts = 1 AND len(heads) = 0 AND bullets <= 1) THEN 'Guideline' WHEN (marks >= 2 OR (fields >= 2 AND {has("low", router.FILL_INSTRUCTION)})) AND points < 2 THEN 'Template' ELSE 'Task' END AS kind FROM r5),
  rt AS (SELECT *, CASE WHEN kind = 'Task' THEN CASE WHEN top > 0 AND len(list_filter(scores, lambda z: z = top)) = 1 THEN {list(_tasks)}[list_position(scores, top)] ELSE 'GeneralTask' END END AS task, CASE WHEN de > en THEN 'De' WHEN en > de THEN 'En' ELSE 'Mixed' END AS language,
    CASE kind WHEN 'Guideline' THEN least(points / 4, 1.0) WHEN 'Template' THEN least(marks / 3, 1.0) ELSE CASE WHEN top > 0 THEN least(0.5::DOUBLE + (top - list_reverse_sort(scores)[2]) / top, 1.0) ELSE 0.3 END END AS confidence FROM r6)"""


_braced = "'{' || s || '}'"
_holds = f"""(len(list_filter(acts_, lambda a: contains(a, s))) > 0 OR len(list_filter(lines, lambda x: ({has("x", X.LABELED_FIELD)} OR {has("x", X.NUMBERED)}) AND contains(x, {_braced}))) > 0 OR contains(last_, s)
   OR len(list_filter(sections, lambda x: contains(x, {_braced}))) > 0 OR list_contains(first_, s))"""
_filler = f"({has('s', X.RESTATEMENT)} OR {any_of('s', lex.NOISE_FILLER)})"
_limits = f"list_filter(sents, lambda s: {has('s', X.CONSTRAINT)} OR {any_of('s', X.NEGATORS)})"
_nouns = f"len(list_filter(regexp_split_to_array(s, '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(lower(w)) >= 4 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({sorted({*X.STOPWORDS, *X.GENERIC_NOUNS})}, lower(w)) AND NOT {has('w', X.ACTION)} AND NOT regexp_matches(lower(w), '(?:es|ing|ed)$')))"
_meeting, _, _notes = X.OUTSIDE_MEETING.partition("(?!")


def features(texts: str) -> str:
    """CTEs up to ft, which has the router's columns and every feature."""
    none, weak, moderate, strong = range(4)
    goal_line = f"coalesce(list_filter(list_transform(string_split({after('t', X.GOAL_HEADING)}, chr(10)), lambda z: {strip('z')}), lambda z: z <> '')[1], '')"
    first = "coalesce(sents[1], '')"
    return rf"""{route(texts)},
  f1 AS (SELECT *, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda z: {strip("z")}), lambda z: z <> '') AS paras, list_distinct(regexp_extract_all(t, '\{{(\w+)\}}', 1)) AS slots, list_filter(sents, lambda s: {has("s", X.ACTION)}) AS acts_,
    list_filter(regexp_split_to_array(low, '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 4 AND NOT regexp_matches(w, '^\p{{Nd}}+$') AND NOT list_contains({sorted(X.STOPWORDS)}, w)) AS tokens FROM rt),
  f2 AS (SELECT *, list_filter(paras, lambda p: NOT {boilerplate("p")}) AS clean_, list_filter(paras, lambda p: {boilerplate("p")}) AS marked FROM f1),
  f3 AS (SELECT *, CASE WHEN {has("t", X.INPUT_ANCHOR)} AND len(clean_) > 0 THEN clean_[-1] ELSE '' END AS last_, regexp_split_to_array(regexp_replace(string_split(t, chr(10) || chr(10))[1], {q(rx2(X.LABELED_PLACEHOLDER))}, ' ', 'g'), '\s+') AS first_,
    list_filter(paras, lambda p, i: len(list_filter(string_split(p, chr(10)), lambda x: starts_with({strip("x")}, '#'))) > 0 OR (i > 1 AND starts_with({strip("string_split(paras[i - 1], chr(10))[-1]")}, '#')) OR {has("p", X.INPUT_LABEL)}) AS sections,
    list_position(list_transform(lines, lambda x: {has("x", X.CONTEXT_HEADING)}), true) AS at_ FROM f2),
  f4 AS (SELECT *, len(slots) AS n_slots, CASE WHEN len(slots) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(slots, lambda s: {_holds})) / len(slots) END AS fraction, lines[coalesce(at_, 0) + 1:] AS rest_,
    list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda b: list_filter(list_transform(string_split(b, chr(10)), lambda z: {strip("z")}), lambda z: z <> '' AND NOT starts_with(z, '#'))), lambda b: len(b) > 0)[1] AS body_ FROM f3),
  f5 AS (SELECT *, coalesce(list_position(list_transform(rest_, lambda x: (x = '' OR starts_with(x, '#')) AND NOT {has("x", X.CONTEXT_HEADING)}), true), 0) AS stop_ FROM f4),
  f6 AS (SELECT *, list_concat(CASE WHEN coalesce(at_, 0) > 0 THEN list_filter(CASE WHEN stop_ > 0 THEN rest_[:stop_ - 1] ELSE rest_ END, lambda x: NOT {has("x", X.CONTEXT_HEADING)}) ELSE [] END, coalesce(body_, [])) AS around FROM f5),
  f7 AS (SELECT *, {sentences("array_to_string(list_filter(around, lambda x, i: list_position(around, x) = i), chr(10))")} AS region, len(sents) AS n_sents, len(acts_) AS n_acts, {has("t", X.MODERATE_OUTPUT)} AS mod_out, {has("t", X.QUOTED_INPUT)} AS quoted, {whole_word("t", lex.ARTIFACT_NOUNS, "s?")} AS artifact,
    list_filter(lines, lambda x: {has("x", X.NUMBERED)}) AS steps, list_filter(lines, lambda x: {has("x", X.PERSONA)}) AS personas, {_limits} AS limits, list_sort(sents) AS ss FROM f6),
  f8 AS (SELECT *, n_acts = 1 OR (n_acts = 2 AND mod_out AND n_sents <= 4) AS atomic, n_slots > 0 AND fraction >= 0.5 AS anchored, {some("steps", four("regexp_replace(s, " + q(rx2(X.NUMBERED)) + ", '')"))} AS n_steps, {some("region", _filler)} AS dull,
    {some("region", has("s", X.NEEDED_FACT))} + {some("region", f"NOT {_filler} AND NOT {has('s', X.ACTION)} AND len({words('s')}) >= 4 AND {four('s')}")} AS telling, list_filter(personas, lambda x: {has("x", X.EXPERTISE)}) AS expert,
    {some("limits", f"{has('s', X.ACTION)} OR {any_of('s', lex.ARTIFACT_NOUNS)}")} AS relevant, greatest(n_sents, 1) AS some_,
    coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(tokens) AS w) GROUP BY w)), 0) AS longest, len(list_distinct(list_filter(ss, lambda s, i: i > 1 AND ss[i - 1] = s))) AS repeated, len(list_distinct(list_filter(sents, lambda s: {has("s", X.PERSONA)}))) AS voices,
    len(list_filter(sents[greatest(n_sents - 1, 1):], lambda s: len(regexp_split_to_array(s, '\s+')) < 15 AND NOT {has("s", X.ACTION)} AND ({any_of("s", lex.NOISE_FILLER)} OR {has("s", X.FILLER)}))) AS n_filler FROM f7),
  f9 AS (SELECT *, {ladder((f"len(list_filter(acts_, lambda s: {substantive('s')})) > 0", strong), ("n_acts > 0", weak))} AS task_signal, len(list_filter(acts_, lambda s: {whole_word("s", X.OPERATIONS)} OR {_nouns} >= 2)) > 0 AS concrete,
    {ladder((f"coalesce({substantive(after('t', X.GOAL_CLAUSE))}, false) OR strlen({goal_line}) > 10 OR {has(first, X.DELIVERABLE)} OR ({has('t', X.TRANSFORM_VERB)} AND (anchored OR {has('t', X.INLINE_INPUT)} OR {has('t', X.FOLLOWING)})) OR (anchored AND {has(first, X.ACTION)})", strong), (has(first, X.VAGUE_GOAL), moderate), (f"({has('t', X.GOAL_CLAUSE)} OR {has('t', X.GOAL_HEADING)}) AND NOT {has('t', X.ACTION)}", weak))} AS goal,
    {ladder((f"coalesce({strip(after('t', '(?m)^```'))} <> '', false) OR {has('t', X.LABELED_PLACEHOLDER)} OR coalesce(strlen({strip(after('t', X.FOLLOWING))}) >= 10, false) OR len(list_filter(slots, lambda p: len(list_filter(acts_, lambda a: contains(a, '{{' || p || '}}'))) > 0)) > 0", strong), (f"len(list_filter(clean_, lambda p: {has('p', X.INLINE_INPUT)})) > 0 OR {has('t', X.FILE_NAME)} OR quoted", moderate), (f"len(list_filter(clean_, lambda p: {has('p', X.WEAK_INPUT)})) > 0", weak))} AS input_,
    {ladder((f"(artifact OR {whole_word('t', lex.OUTPUT_FORMAT_WORDS)}) AND {has('t', X.BOUNDARY)} AND {has('t', X.STRUCTURE)}", strong), ("mod_out", moderate), (f"artifact OR {has('t', X.TRANSFORM_VERB)}", weak))} AS output_,
    CASE WHEN n_slots = 0 THEN 0.0::DOUBLE ELSE fraction * (1 - {some("slots", has("s", X.SPAM_NAME))} / n_slots) END AS slot_quality, NOT {has("t", X.INLINE_INPUT)} AND NOT {has("t", X.WEAK_INPUT)} AND NOT {has("t", X.FOLLOWING)} AND NOT quoted AS unanchored,
    least(({" + ".join(f"CAST({any_of('t', a)} AND {any_of('t', b)} AS INT)" for a, b in X.TASK_PAIRS)}) / greatest({_low(lex.ARTIFACT_NOUNS)}, 1), 1.0) AS matches_task, {ladder(("n_steps >= 2", strong), (f"n_steps = 1 OR {has('t', X.SEQUENCE)}", moderate), ("len(steps) > 0", weak))} AS procedure,
    {ladder(("len(region) = 0", none), ("telling >= 2 AND dull <= 1", strong), ("telling >= 1", moderate), ("dull >= 1", weak))} AS substance, {ladder(("len(list_filter(expert, lambda x: strlen(x) > 30)) > 0", strong), ("len(expert) > 0", moderate), ("len(personas) > 0", weak))} AS role_,
    len(limits) - relevant AS boiler, len(list_filter(clean_, lambda p: {any_of("p", X.SENSITIVE)})) > 0 AS safety, {ladder(("len(marked) = 0", 0), ("len(marked) > 1", 3), (f"len(list_filter(marked, lambda b: len({sentences('b')}) >= 3 OR length(b) > 200)) > 0", 2), default=1)} AS severity,
    CASE WHEN len(tokens) = 0 THEN 0.0::DOUBLE ELSE least(0.5::DOUBLE * longest / len(tokens) + 0.5::DOUBLE * repeated / some_ + CASE WHEN voices >= 2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0) END AS redundancy, n_filler / some_ AS filler, n_acts / greatest(n_acts + n_filler, 1) AS signal,
    CASE WHEN len(tokens) = 0 THEN 0.0 ELSE len(list_distinct(tokens)) / len(tokens) END AS diversity, {has("t", X.EXAMPLE_OUTPUT)} AS example_out,
    {has("t", X.OUTSIDE)} OR (len(regexp_extract_all(t, {q(rx2(_meeting))})) > len(regexp_extract_all(t, {q(rx2(_meeting) + r"\s*(?:notes|minutes)")})) AND NOT quoted) AS outside FROM f8),
  ft AS (SELECT *, (atomic OR (n_acts = 2 AND output_ >= 2 AND n_sents <= 6)) AND goal >= 2 AND output_ >= 2 AND (input_ >= 2 OR unanchored) AND n_sents <= 6 AS terse, NOT outside AND (task_signal > 0 OR kind IN ('Guideline', 'Template')) AND redundancy < 0.4 AS self_contained FROM f9)"""


def judged(texts: str, conflicts: str) -> str:
    """CTEs up to ju: the twelve scores, which of them count, and the overall score. conflicts: a query of doc_id, weight and critical."""
    kind = "CASE WHEN kind = 'Task' THEN task ELSE kind END"
    table = {d: "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN {row[i]}" for k, row in quality.APPLIES.items()) + " END" for i, d in enumerate(quality.DIMENSIONS)}
    known = {"Goal": "goal > 0", "Context": "substance > 0", "Output": "output_ > 0", "Actionability": "procedure > 0", "Constraint": "relevant + boiler > 0"}
    app = {d: f"CASE WHEN {known[d]} THEN -1 ELSE {table[d]} END" if d in known else table[d] for d in table}
    app["Input"] = f"CASE WHEN n_slots > 0 THEN -1 WHEN input_ > 0 AND ({table['Input']}) = -2 THEN 8 ELSE {table['Input']} END"
    app["Safety"] = "CASE WHEN safety THEN -1 ELSE -2 END"
    guideline, template = "kind = 'Guideline'", "kind = 'Template'"
    spam = "(n_slots >= 5 AND fraction < 0.8)"
    enough = f"""CASE WHEN {guideline} THEN true WHEN {template} THEN fraction >= 0.8 AND slot_quality >= 0.5 AND NOT {spam} ELSE (task_signal >= 2 AND n_slots > 0 AND fraction >= 0.5 AND goal >= 2)
      OR (task_signal > 0 AND NOT coalesce(task IN ('Extraction', 'Translation', 'Summarization', 'Transformation') AND input_ = 0 AND n_slots = 0, false))
      OR (atomic AND goal >= 2 AND output_ >= 2 AND (input_ >= 1 OR fraction >= 0.5) AND filler < 0.4 AND redundancy < 0.4) END"""
    neutral = lambda d, low: f"CASE WHEN poor THEN {low} WHEN a_{d} >= 0 THEN a_{d} ELSE {low} END"
    noise = f"({ladder(('signal >= 0.8 AND redundancy < 0.2 AND filler < 0.2', 10), ('signal >= 0.6', 7), ('signal >= 0.4', 5), ('signal >= 0.2', 3), default=1)} - least(severity, 2) - CASE WHEN redundancy >= 0.4 THEN 3 ELSE 0 END)"
    s = {
        "Goal": f"CASE WHEN goal < 2 AND (({template} AND n_slots >= 2) OR {guideline}) THEN 8 ELSE {ladder(('goal = 3', 10), ('goal = 2', 8), ('goal = 1', 6), default=1)} END",
        "Context": f"CASE WHEN NOT poor AND self_contained THEN 10 WHEN substance = 3 THEN 10 WHEN substance > 0 THEN 3 ELSE {neutral('Context', 1)} END",
        "Input": f"CASE WHEN {template} AND n_slots >= 3 AND input_ < 2 THEN 8 WHEN n_slots > 0 AND fraction < 0.4 THEN 3 WHEN input_ = 3 THEN CASE WHEN fraction < 0.5 THEN 9 ELSE 10 END WHEN input_ = 2 THEN 7 WHEN input_ = 1 THEN 5 ELSE {neutral('Input', 1)} END",
        "Output": f"CASE WHEN output_ < 2 AND (({template} AND n_slots >= 3) OR {guideline}) THEN 8 WHEN output_ = 3 THEN CASE WHEN matches_task < 0.2 THEN 9 ELSE 10 END WHEN output_ = 2 THEN 7 WHEN output_ = 1 THEN 4 ELSE {neutral('Output', 1)} END",
        "Constraint": f"CASE WHEN {guideline} THEN CASE WHEN relevant >= 2 THEN 9 ELSE 7 END WHEN relevant + boiler = 0 THEN {neutral('Constraint', 2)} WHEN relevant >= 2 THEN 9 WHEN relevant = 1 THEN 7 ELSE 4 END",
        "Actionability": f"CASE WHEN {guideline} THEN 8 WHEN procedure = 3 THEN 9 WHEN procedure = 2 THEN 7 WHEN procedure = 1 THEN 3 WHEN atomic THEN 8 ELSE {neutral('Actionability', 2)} END",
        "Ambiguity": ladder(("redundancy >= 0.4", 3), ("redundancy >= 0.25", 5), ("atomic AND n_sents <= 6", 9), ("n_sents <= 6", 8), default=7),
        "Consistency": ladder(("crit", 0), ("w = 0", 10), ("w <= 3", 5), ("w <= 5", 3)),
        "Completeness": ladder(("(n_slots > 0 AND fraction < 0.5) OR (NOT self_contained AND substance <> 3)", 3), ("terse", 10), ("output_ = 3", 9), ("substance = 3", 10), ("goal > 0 AND output_ > 0", 8), default=4),
        "Noise": f"CASE WHEN redundancy >= 0.3 THEN least({noise}, 3) ELSE {noise} END",
        "Safety": f"CASE WHEN safety THEN CASE WHEN relevant > 0 AND severity = 0 THEN 9 ELSE 3 END WHEN severity > 0 THEN 4 ELSE {neutral('Safety', 2)} END",
        "Reuse": f"CASE WHEN n_slots > 0 AND slot_quality < 0.5 THEN 3 WHEN slot_quality >= 0.8 THEN 9 WHEN slot_quality >= 0.5 THEN 7 WHEN {template} THEN 3 WHEN poor THEN 2 WHEN a_Reuse >= 0 THEN a_Reuse ELSE 6 END",
    }
    plain = "NOT poor AND NOT concrete AND substance <> 3 AND kind = 'Task'"

    def capped(d: str) -> str:
        x = f"({s[d]})"
        x = f"CASE WHEN poor THEN least({x}, 3) ELSE {x} END" if d in quality.CAPPED_IF_POOR else x
        x = f"CASE WHEN {plain} THEN least({x}, {quality.BARE_CAPS[d]:.0f}) ELSE {x} END" if d in quality.BARE_CAPS else x
        x = f"CASE WHEN {plain} AND relevant + boiler = 0 THEN least({x}, 2) ELSE {x} END" if d == "Constraint" else x
        return f"greatest(0, least(10, {x}))::DOUBLE AS s_{d}"

    points = " + ".join(f"CASE WHEN a_{d} <> -2 THEN s_{d} ELSE 0 END" for d in table)
    number = " + ".join(f"CAST(a_{d} <> -2 AS INT)" for d in table)
    return f"""{features(texts)},
  j1 AS (SELECT ft.*, coalesce(weight, 0) AS w, coalesce(critical, false) AS crit, {", ".join(f"{x} AS a_{d}" for d, x in app.items())} FROM ft LEFT JOIN ({conflicts}) cf USING (doc_id)),
  j2 AS (SELECT *, NOT ({enough}) OR filler >= 0.4 OR redundancy >= 0.4 OR w >= 4 OR crit OR (n_slots > 1 AND fraction < 0.4) OR {spam} AS poor FROM j1),
  j3 AS (SELECT *, {", ".join(map(capped, table))} FROM j2),
  j4 AS (SELECT *, CAST(round(({points}) / greatest({number}, 1) * 10) AS INT) AS raw FROM j3),
  ju AS (SELECT *, CASE WHEN {strip("t")} = '' THEN 0 WHEN w >= 6 OR crit THEN least(raw, 45) ELSE raw END AS overall FROM j4)"""
