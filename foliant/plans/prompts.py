"""Queries of the analyzers of prompts, blueprints and rules, of the store and of evaluation, with SQL.

The driver's documents are prose, so most of these read PROMPTED texts: a prompt of some kind before each whole text, by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import each
from foliant.operators import blueprints, constraints, context, contradictions, directions, features, gaps, hygiene, metrics, quality, recommendations, restructure, router, store
from foliant.plans import quality_sql
from foliant.plans.catalog import docs, query, spread, table

PROMPTS = (
    "# Task\nImplement the login module in src/auth.rs. Return as JSON.\n## Constraints\nDo not use cloud. Never skip tests.\n## Verification\nRun cargo test and verify that all tests pass.\n",
    "help me maybe do something, perhaps kind of nice, or maybe not. please\n",
    "# Goal\nThe outcome is a report with 20% better metrics.\n# Context\nStand: 2024-01-02, based on issue #12. Project database schema.\n# Background\nhistory\n# Status\nok\n# Out of scope\nUI\n",
    "Workflow: step 1 implement then test, step 2 code review by reviewer-agent, CI pipeline must be green. Issue #42 in github.com/acme/app. Evidence: screenshot. Human approval required. Rollback plan. In scope: api.\n",
    "# System Architecture\ncomponent diagram and data flow\n## Verification Contract\nacceptance criteria\n## Human Approval\n## Evidence\nCI status\n# Risks\nfallback and assumption\n## Security\nOAuth2, personal data\n# Next steps\ncreate the MVP first\n# Scope\nMVP, out of scope: x\n# Goal\nKPI\n# Tests\nunit tests, red tests\n",
    "# Richtlinie\nVerwende kurze Sätze.\n## Regeln\nAchte auf Stil.\nVermeide Fehler.\nNutze Listen.\nAlways check.\n",
    "```python\nprint(1)\nprint(2)\nprint(3)\n```\n",
    "You are a developer. Write a blog post and fix bug 3. Output format: table. For example input a gives output b. can you do it?\n",
    "password = \"hunter22xyz\" from Positron on ubuntu and windows, see https://evil.example/x\nUser: hi\nCaused by: boom\n",
    "# Context\nTBD\n# Role\n<!-- later -->\n# Output\nplaceholder\n# Task\nanalysiere den Text\n",
    "Answer in German. Translate the answer to English. Return only JSON. Return only CSV. Keep it public. Do not keep it public.\n",
    "- a\n- b\n- c\n* d\n1. e\n",
    "nur auf deutsch, max 200 words, keine Beispiele, offline, output as json, human approval required, kein refactoring\n",
)
COMBINED = "CASE doc_id % {n} {cases} ELSE '' END || coalesce(text, '')"
literal = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
PROMPTED = COMBINED.format(n=len(PROMPTS) + 1, cases=" ".join(f"WHEN {i} THEN {literal(x)}" for i, x in enumerate(PROMPTS)))


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.expr(PROMPTED).alias("text"))


def matches(column: str, patterns: dict[str, str]) -> str:
    return ", ".join(f"regexp_matches({column}, {literal('(?im)' + p)}) AS {n}" for n, p in patterns.items())


def counts(column: str, patterns: dict[str, str]) -> str:
    return ", ".join(f"len(regexp_extract_all({column}, {literal('(?im)' + p)})) AS {n}" for n, p in patterns.items())


BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
UNITS = r"(length({0}) + len(regexp_extract_all({0}, '[\x{{10000}}-\x{{10FFFF}}]')))"
NO_CODE = r"regexp_replace({}, '```[\s\S]*?```', '', 'g')"
D = f"d AS (SELECT doc_id, {PROMPTED} AS t FROM documents)"
#: Lines by section; a section of placeholders only is left out with its heading.
EVALUATED = rf"""{D},
  ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
  sec AS (SELECT *, regexp_matches(line, '^#{{1,3}}\s') AS head, sum(CASE WHEN regexp_matches(line, '^#{{1,3}}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM ln),
  grp AS (SELECT doc_id, s, string_agg(line, chr(10) ORDER BY i) AS whole, count(*) AS n, string_agg(CASE WHEN head THEN NULL ELSE line END, chr(10) ORDER BY i) AS body FROM sec GROUP BY doc_id, s),
  kept AS (SELECT *, regexp_replace({BARE.format("regexp_replace(coalesce(body, ''), '<!--[\\s\\S]*?-->', '', 'g')")}, '\s+', ' ', 'g') AS rest FROM grp),
  ev AS (SELECT doc_id, coalesce(string_agg(whole, chr(10) ORDER BY s) FILTER (s = 0 OR n = 1 OR NOT (rest = '' OR (length(rest) < 60 AND ({" OR ".join(f"regexp_matches(rest, {literal(chr(40) + '?i)^' + chr(92) + 's*(?:' + p + ')' + chr(92) + 's*$')})" for p in context.PLACEHOLDERS)})))), '') AS e FROM kept GROUP BY doc_id),
  x AS (SELECT doc_id, t, e, {BARE.format("t")} AS w, {BARE.format("e")} AS v FROM d JOIN ev USING (doc_id)),
  sig AS (SELECT doc_id, w = '' AS blank, {UNITS.format(NO_CODE.format("e"))} AS clean_length, {UNITS.format(NO_CODE.format("w"))} AS whole_clean_length, {matches("w", context.TYPE_SIGNALS)}, {matches("e", context.SIGNALS)}, {matches("v", context.VAGUE)}, {counts("e", context.COUNTS)}, {counts("w", {"whole_headings": context.HEADING})} FROM x),
  ag AS (SELECT *, {context.AGENTIC_SQL} AS agentic FROM sig)"""
CRITERION = {context.column_of(d, n).lower(): sql for d, cs in context.CRITERIA.items() for n, sql in cs.items()}
quoted = lambda names: ", ".join(f"{sql} AS \"{n}\"" for n, sql in names.items())
total = lambda d: " + ".join(f'"{context.column_of(d, n).lower()}"' for n in context.CRITERIA[d])
zeros = lambda d, names=None: "(" + " + ".join(f'CAST("{context.column_of(d, n).lower()}" = 0 AS INT)' for n in (names or context.CRITERIA[d])) + ")"
SCORED = f"""{EVALUATED}, cr AS (SELECT *, {context.TYPE_SQL} AS kind, {context.PROFILE_SQL} AS profile, {quoted(CRITERION)}, {", ".join(f"({sql}) AS risk__{n}" for n, (_, _, sql, _) in context.RISKS.items())} FROM ag),
  sc AS (SELECT *, 5 * ({total(context.PE)}) AS pe, 5 * ({total(context.CE)}) AS ce, CASE WHEN agentic THEN 5 * ({total(context.AR)}) ELSE 0 END AS ar,
    greatest(0, 100 - ({" + ".join(f"{p} * CAST(risk__{n} AS INT)" for n, (_, p, _, _) in context.RISKS.items())})
      - CASE WHEN kind = 'simple_prompt' THEN 3 * {zeros(context.PE, context.CORE)} ELSE 3 * {zeros(context.PE)} + 3 * {zeros(context.CE)} + CASE WHEN agentic THEN 5 * {zeros(context.AR)} ELSE 0 END END) AS rob FROM cr)"""
OVERALL = "CASE WHEN blank THEN 0 ELSE least(100, greatest(0, CAST(floor(CASE kind WHEN 'agentic_prompt' THEN pe * 0.35::DOUBLE + ce * 0.25::DOUBLE + ar * 0.25::DOUBLE + rob * 0.15::DOUBLE WHEN 'structured_prompt' THEN pe * 0.45::DOUBLE + ce * 0.3::DOUBLE + rob * 0.25::DOUBLE ELSE pe * 0.6::DOUBLE + ce * 0.25::DOUBLE + rob * 0.15::DOUBLE END + 0.5) AS INT))) END"
none_if_blank = lambda c: f"CASE WHEN blank THEN 0 ELSE {c} END"


@query("context_scores", f"""WITH {SCORED} SELECT doc_id, kind AS prompt_type, profile, CAST({none_if_blank("pe")} AS INT) AS pe, CAST({none_if_blank("ce")} AS INT) AS ce, CAST({none_if_blank("ar")} AS INT) AS ar, CAST({none_if_blank("rob")} AS INT) AS robustness, CAST({OVERALL} AS INT) AS overall FROM sc""")
def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = context.evaluated(prompted(spark, sf_dir))
    return f.select("doc_id", F.col("detected_prompt_type").alias("prompt_type"), F.col("detected_context_profile").alias("profile"), F.col("prompt_engineering_score").alias("pe"), F.col("context_engineering_score").alias("ce"), F.col("agent_readiness_score").alias("ar"), F.col("robustness_score").alias("robustness"), F.col("overall_score").alias("overall"))


@query("context_criteria", f"""WITH {SCORED}, u AS ({" UNION ALL ".join(f"SELECT doc_id, '{d}' AS dimension, '{n}' AS name, CAST(" + f'CASE WHEN blank THEN 0 ELSE "{context.column_of(d, n).lower()}" END' + f" AS INT) AS score FROM sc {'WHERE agentic AND NOT blank' if d == context.AR else ''}" for d, cs in context.CRITERIA.items() for n in cs)}) SELECT * FROM u""")
def context_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = each(context.evaluated(prompted(spark, sf_dir)), "criteria", "c", "doc_id")
    return f.select("doc_id", "c.dimension", "c.name", "c.score")


RISK_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS flag, '{s}' AS severity, {p} AS score_penalty FROM sc WHERE risk__{n} AND NOT blank" for n, (s, p, _, _) in context.RISKS.items())


@query("context_risks", f"WITH {SCORED} {RISK_ROWS} UNION ALL SELECT doc_id, unnest(['ambiguous_task', 'missing_goal']), 'high', unnest([15, 20]) FROM sc WHERE blank")
def context_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = each(context.evaluated(prompted(spark, sf_dir)), "risk_flags", "r", "doc_id")
    return f.select("doc_id", "r.flag", "r.severity", "r.score_penalty")


ONE, TWO = "score = 1", "score = 2"


@query("context_advice", f"""WITH {SCORED}, u AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{n}' AS name, agentic, " + f'"{context.column_of(d, n).lower()}"' + f" AS score, '{d}' AS dimension, {literal((context.AGENT_MISSING if d == context.AR else context.MISSING)[n])} AS missing, {literal(context.PARTIAL.get(n, '') if d != context.AR else 'Strengthen the ' + n.lower() + ' in the agent workflow with more specific details.')} AS partial FROM sc WHERE NOT blank {'AND agentic' if d == context.AR else ''}" for i, (d, n) in enumerate((d, n) for d, cs in context.CRITERIA.items() for n in cs))}),
  m AS (SELECT doc_id, CASE WHEN score = 0 THEN missing ELSE partial END AS message, CASE WHEN score = 0 AND dimension <> 'context_engineering' THEN 'high' ELSE 'medium' END AS priority FROM u WHERE score < 2
        UNION ALL SELECT doc_id, message, 'high' FROM ({" UNION ALL ".join(f"SELECT doc_id, {literal(text)} AS message FROM sc WHERE risk__{n} AND NOT blank" for n, (s, _, _, text) in context.RISKS.items() if s in ("high", "critical"))})
        UNION ALL SELECT doc_id, {literal(context.EMPTY_ADVICE[2])}, 'high' FROM sc WHERE blank),
  told AS (SELECT doc_id, count(*) FILTER (score = 2) AS strengths, count(*) FILTER (score = 1) AS warnings, count(*) FILTER (score = 0) AS missing, count(*) AS n, count(*) FILTER (score > 0) AS positive FROM u GROUP BY doc_id)
SELECT doc_id, coalesce(strengths, 0) AS n_strengths, coalesce(warnings, 1) AS n_warnings, coalesce(missing, 1) AS n_missing, n_advice, n_high, round(coalesce(floor((0.2 + positive / n * 0.8) * 100 + 0.5) / 100, 1.0), 2) AS confidence
FROM (SELECT doc_id, count(DISTINCT message) AS n_advice, count(DISTINCT message) FILTER (priority = 'high') AS n_high FROM m GROUP BY doc_id) LEFT JOIN told USING (doc_id)""")
def context_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = context.evaluated(prompted(spark, sf_dir))
    size = lambda c: F.size(c).cast("bigint")
    high = F.filter("suggested_improvements", lambda a: a["priority"] == "high")
    return f.select("doc_id", size("strengths").alias("n_strengths"), size("warnings").alias("n_warnings"), size("missing_elements").alias("n_missing"), size("suggested_improvements").alias("n_advice"), size(high).alias("n_high"), F.round("confidence", 2).alias("confidence"))


listed = lambda groups: "list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql in groups.items()) + "], lambda x: x IS NOT NULL)"
KNOWN = " AND ".join(f"NOT contains(u, '{k}')" for k in blueprints.KNOWN_URLS)
CLASSED = f"""{D}, b0 AS (SELECT doc_id, {BARE.format("t")} AS w FROM d),
  b1 AS (SELECT doc_id, w, w = '' AS blank, {UNITS.format("w")} AS n_units, {UNITS.format(NO_CODE.format("w"))} AS clean_units, len(string_split(w, chr(10))) AS n_all_lines, {matches("w", blueprints.SIGNALS)}, {counts("w", blueprints.COUNTS)},
    len(list_filter(regexp_extract_all(w, 'https?://[^\\s)]+'), lambda u: {KNOWN})) > 0 AS foreign_urls, false AS stale_names FROM b0),
  b2 AS (SELECT *, {listed(blueprints.PROMPT)} AS ps, {listed(blueprints.BLUEPRINT)} AS bs, {listed(blueprints.HYBRID)} AS hs, {listed(blueprints.GUIDELINE)} AS gs, {listed({n: sql for n, (_, sql) in blueprints.CONTAMINATION.items()})} AS cs FROM b1),
  b3 AS (SELECT *, len(ps) AS p, len(bs) AS b, len(hs) AS h, len(gs) AS g, len(list_intersect(bs, {list(blueprints.STRONG)})) AS s, len(cs) = 0 AS clean FROM b2),
  b4 AS (SELECT *, {blueprints.CLASS_SQL} AS content_class, {blueprints.CONFIDENCE_SQL.replace("0.3D", "0.3")} AS confidence FROM b3)"""
SEVERE = lambda level: "len(list_intersect(cs, " + str([n for n, (s, _) in blueprints.CONTAMINATION.items() if s == level]) + ")) > 0"
STATUS = f"CASE WHEN clean THEN 'CLEAN' WHEN {SEVERE('critical')} THEN 'BLOCKING_SENSITIVE_CONTENT' WHEN {SEVERE('high')} THEN 'CONTAMINATED_NEEDS_REVIEW' ELSE 'POSSIBLE_CONTAMINATION' END"


@query("document_classes", f"WITH {CLASSED} SELECT doc_id, content_class, round(CAST(floor(CAST(confidence AS DOUBLE) * 100 + 0.5) / 100 AS DOUBLE), 2) AS confidence, array_to_string(ps, ',') AS prompt_signals, array_to_string(bs, ',') AS blueprint_signals, array_to_string(gs, ',') AS guideline_signals FROM b4")
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = blueprints.classified(prompted(spark, sf_dir))
    join = lambda c: F.array_join(c, ",").alias(c)
    return f.select("doc_id", "content_class", F.round("class_confidence", 2).alias("confidence"), *map(join, ("prompt_signals", "blueprint_signals", "guideline_signals")))


@query("contamination", f"WITH {CLASSED} SELECT doc_id, {STATUS} AS status, array_to_string(cs, ',') AS signals FROM b4")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprints.classified(prompted(spark, sf_dir)).select("doc_id", F.col("contamination_status").alias("status"), F.array_join("contamination_signals", ",").alias("signals"))


TYPE_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {priority} AS priority, {-i} AS o, {' + '.join(f'CAST(regexp_matches(w, {literal(chr(40) + chr(63) + chr(105) + chr(109) + chr(41) + p)}) AS INT)' for p in ps)}{' + CAST(content_class = ' + chr(39) + 'PROMPT_BLUEPRINT_HYBRID' + chr(39) + ' AS INT)' if k == blueprints.AGENT else ''} AS score FROM b4" for i, (k, (priority, ps)) in enumerate(blueprints.TYPES.items()))


@query("blueprint_types", f"WITH {CLASSED}, ty AS ({TYPE_ROWS}), best AS (SELECT doc_id, arg_max(kind, score * 1000 + priority * 100 + o) AS kind, max(score) AS score FROM ty GROUP BY doc_id) SELECT doc_id, CASE WHEN content_class IN ('BLUEPRINT', 'PROMPT_BLUEPRINT_HYBRID') THEN CASE WHEN score > 0 THEN kind ELSE 'generic_blueprint' END END AS blueprint_type FROM b4 JOIN best USING (doc_id)")
def blueprint_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprints.classified(prompted(spark, sf_dir)).select("doc_id", "blueprint_type")


DIMENSION_SQL = {d: f"CASE WHEN blank THEN 0 ELSE 50 * ({context.steps(two, one)}) END" for d, (_, _, two, one) in blueprints.DIMENSIONS.items()}


@query("blueprint_scores", f"""WITH {CLASSED}, ds AS (SELECT *, {", ".join(f"{sql} AS {d}" for d, sql in DIMENSION_SQL.items())} FROM b4)
SELECT doc_id, {", ".join(f"CAST({d} AS INT) AS {d}" for d in DIMENSION_SQL)}, CAST(floor({" + ".join(f"{d} * {w}::DOUBLE" for d, (_, w, _, _) in blueprints.DIMENSIONS.items())} + 0.5) AS INT) AS overall, array_to_string({listed(blueprints.TAGS)}, ',') AS tags,
  CASE WHEN blank THEN 1 ELSE {" + ".join(f"CAST({d} < 100 AS INT)" for d in DIMENSION_SQL)} END AS n_improvements FROM ds""")
def blueprint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = blueprints.evaluated(prompted(spark, sf_dir))
    return f.select("doc_id", *(F.col(f"{d}_score").cast("int").alias(d) for d in blueprints.DIMENSIONS), F.col("blueprint_score").alias("overall"), F.array_join("class_tags", ",").alias("tags"), F.size("blueprint_improvements").alias("n_improvements"))


@query("blueprint_reasons")
def blueprint_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprints.evaluated(prompted(spark, sf_dir)).select("doc_id", F.array_join("class_reasons", " | ").alias("reasons"), F.array_join("blueprint_warnings", " | ").alias("warnings"))


# Mandates and contradictions.
_word = lambda words: "(?:" + "|".join(words) + ")"
_edge = r"[^\p{L}\p{N}_]"
_mandate = literal(f"(?:^|{_edge}){_word(dict.fromkeys((*contradictions.NEGATORS, *contradictions.EXTRA_NEGATORS, *contradictions.SIGNALS, *contradictions.VERBS)))}(?:$|{_edge})")
_negators = literal(f"(?:^|{_edge}){_word((*contradictions.NEGATORS, *contradictions.EXTRA_NEGATORS))}(?:$|{_edge})")
_language = lambda terms: f"regexp_matches(low, {literal('(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}])' + _word(terms) + _word(contradictions.INFLECTIONS) + '?(?:$|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}])')})"
_any = lambda words: "(" + " OR ".join(f"contains(low, {literal(w)})" for w in words) + ")"
TOPIC_SQL = f"CASE WHEN {_language(contradictions.LANGUAGE_TERMS)} THEN 'language' " + " ".join(f"WHEN {_any(w)} THEN '{t}'" for t, w in contradictions.TOPICS.items()) + f" WHEN {_language(contradictions.LANGUAGES)} THEN 'language' " + " ".join(f"WHEN {_any(w)} THEN '{t}'" for t, w in contradictions.MORE_TOPICS.items()) + " END"
VALUE_SQL = f"CASE topic WHEN 'language' THEN CASE WHEN {_language(contradictions.GERMAN)} THEN 'german' WHEN {_language(contradictions.ENGLISH)} THEN 'english' {' '.join(f'WHEN {_language((n,))} THEN {literal(n)}' for n in contradictions.LANGUAGES)} END " + " ".join(f"WHEN '{t}' THEN CASE {' '.join(f'WHEN {_any(words)} THEN {literal(v)}' for v, words in vs.items())} END" for t, vs in contradictions.VALUES.items()) + " END"
#: Values of a mandate that names several, for the topics that have values.
SEVERAL_SQL = "CASE topic " + " ".join(f"WHEN '{t}' THEN {' + '.join(f'CAST({_any(words)} AS INT)' for words in vs.values())}" for t, vs in contradictions.VALUES.items()) + " ELSE 0 END"
#: Paragraph and place of each mandate; a line of a table, of which the texts have none, would be cut into cells.
MANDATES = rf"""c0 AS (SELECT doc_id, t FROM c),
  pl AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM c0),
  pp AS (SELECT *, sum(CASE WHEN {BARE.format("line")} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS par FROM pl),
  se AS (SELECT doc_id, i, par, unnest(regexp_split_to_array(line, '[.!?]')) AS s, generate_subscripts(regexp_split_to_array(line, '[.!?]'), 1) AS j FROM pp),
  cl AS (SELECT doc_id, i, par, j, {BARE.format("s")} AS s, list_filter(list_transform(string_split(s, ','), lambda x: {BARE.format("x")}), lambda x: x <> '') AS parts FROM se WHERE {BARE.format("s")} <> ''),
  ch AS (SELECT doc_id, i, par, j, CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda x: NOT regexp_matches(lower(x), {_mandate}))) = 0 THEN parts ELSE [s] END AS parts FROM cl),
  ma AS (SELECT doc_id, i, par, j, unnest(parts) AS text, generate_subscripts(parts, 1) AS k FROM ch),
  mb AS (SELECT *, lower(text) AS low, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) AS o FROM ma WHERE regexp_matches(lower(text), {_mandate})),
  mc AS (SELECT *, {TOPIC_SQL} AS topic, CASE len(regexp_extract_all(low, {_negators})) WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS polarity FROM mb WHERE o <= {contradictions.MOST_MANDATES}),
  m AS (SELECT *, {VALUE_SQL} AS value, {SEVERAL_SQL} AS several FROM mc)"""


@query("mandates", f"WITH {D.replace('d AS', 'c AS')}, {MANDATES} SELECT doc_id, coalesce(topic, '-') AS topic, polarity, coalesce(value, '-') AS value, count(*) AS n, min(par) >= 0 AS placed FROM m GROUP BY ALL")
def mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = each(contradictions.mandates(prompted(spark, sf_dir)), "mandates", "m", "doc_id")
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c.split(".")[1])
    return f.select("doc_id", dash("m.topic"), "m.polarity", dash("m.value"), "m.paragraph").groupBy("doc_id", "topic", "polarity", "value").agg(F.count("*").alias("n"), (F.min("paragraph") >= 0).alias("placed"))


PAIRS = (
    "Answer the mail in German. Also translate the mail to English.", "Write it auf Deutsch, please. Nothing more.", "Halte es kurz. Schreibe es ausführlich.", "The summary is exactly 40 words and at least 90 words long.",
    "Keep it long with at most 10 words. Keep it long with at least 30 words.", "Output all the rows of all data. Do not output any data.", "Answer all questions. Answer none of the questions.", "Return CSV, YAML, and XML.", "Return only YAML. Return only XML.",
    "Return YAML. Do not return YAML.", "Return a JSON object. Use prose for everything.", "Keep the plan confidential. Publish the plan.", "Use a formal voice and a casual voice.", "Sprich nie über Politik. Beginne immer mit Politik.",
    "Deploy the service immediately. Do not deploy the service immediately.", "Use active voice. Use passive voice.", "Cite sources. Do not cite sources.", "Use cm. Use inches.", "Show numbers. Never show numbers.",
)
CONTRARY = COMBINED.format(n=len(PAIRS) + 1, cases=" ".join(f"WHEN {i} THEN {literal(x + chr(10) * 2)}" for i, x in enumerate(PAIRS)))
_near = rf"(?:^|{_edge}){_word((*contradictions.NEGATORS, *contradictions.EXTRA_NEGATORS))}"
_bounds = lambda x: f"list_transform(regexp_extract_all({x}, {literal('(?i)' + contradictions.LENGTH_BOUND)}), lambda p: struct_pack(kind := CASE WHEN regexp_matches(lower(p), '^(exactly|genau)') THEN 'exact' WHEN regexp_matches(lower(p), '^(at least|mindestens|minimum)') THEN 'least' ELSE 'most' END, n := CAST(regexp_extract(p, '[0-9]+') AS BIGINT)))"
_clash = "a.b.kind <> b.b.kind AND (CASE a.b.kind WHEN 'most' THEN -1 ELSE a.b.n END > CASE b.b.kind WHEN 'least' THEN 9223372036854775807 ELSE b.b.n END OR CASE b.b.kind WHEN 'most' THEN -1 ELSE b.b.n END > CASE a.b.kind WHEN 'least' THEN 9223372036854775807 ELSE a.b.n END)"
_subject = f"list_filter(regexp_split_to_array(low, '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4 AND NOT list_contains({list(contradictions.STOPWORDS)}, w))"
CONFLICT_CTES = f"""{MANDATES},
  u AS (SELECT *, {_subject} AS words FROM m WHERE topic IS NOT NULL AND polarity <> 0),
  pr AS (SELECT a.doc_id, a.topic, a.o AS oa, b.o AS ob, a.polarity AS pa, b.polarity AS pb, a.value AS va, b.value AS vb, a.par = b.par AS same, len(list_intersect(a.words, b.words)) > 0 AS shared, a.low AS la, b.low AS lb FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.topic = b.topic AND a.o < b.o),
  bo AS (SELECT doc_id, o, unnest({_bounds("text")}) AS b FROM u WHERE topic = 'length'),
  op AS (SELECT doc_id, topic, arg_min(shared, oa * 1000 + ob) AS shared, bool_or(topic NOT IN ('procedure_order', 'budget')) AS wide FROM pr WHERE pa <> pb AND (topic NOT IN ('procedure_order', 'budget') OR same) GROUP BY ALL),
  hit AS (
    SELECT doc_id, topic FROM op WHERE topic <> 'format' AND (wide OR shared)
    UNION SELECT doc_id, topic FROM pr WHERE va <> vb AND topic <> 'format'
    UNION SELECT doc_id, topic FROM u WHERE several >= 2 AND topic <> 'format'
    UNION SELECT a.doc_id, 'length' FROM bo a JOIN bo b ON a.doc_id = b.doc_id WHERE {_clash}
    UNION SELECT doc_id, topic FROM pr WHERE topic = 'format' AND va <> vb AND regexp_matches(la, '\\b(only|nur|never|nie)\\b') AND regexp_matches(lb, '\\b(only|nur|never|nie)\\b')
    UNION SELECT doc_id, topic FROM pr WHERE topic = 'format' AND va = vb AND pa <> pb AND regexp_matches(CASE WHEN pb < 0 THEN lb ELSE la END, {literal(_near + '.{0,15}')} || va)
  ),
  many AS (SELECT doc_id FROM (SELECT doc_id, par, unnest({list(contradictions.STRUCTURED)}) AS f, low FROM m WHERE topic = 'format') WHERE contains(low, f) OR (f = 'table' AND contains(low, 'tabelle')) GROUP BY doc_id, par HAVING count(DISTINCT f) >= 3),
  prose AS (SELECT doc_id FROM m WHERE topic = 'format' AND list_contains({list(contradictions.STRUCTURED)}, value) INTERSECT SELECT doc_id FROM m WHERE topic = 'prose'),
  al AS (SELECT DISTINCT doc_id, 'format' AS topic, 4 AS weight, false AS critical FROM many
    UNION SELECT doc_id, 'format', 6, true FROM prose WHERE doc_id NOT IN (SELECT doc_id FROM many)
    UNION SELECT doc_id, topic, CASE topic {" ".join(f"WHEN '{t}' THEN {w}" for t, (_, w, _) in contradictions.CONFLICTS.items())} END, list_contains({[t for t, (_, _, c) in contradictions.CONFLICTS.items() if c]}, topic)
      FROM hit WHERE topic <> 'format' OR doc_id NOT IN (SELECT doc_id FROM many UNION SELECT doc_id FROM prose))"""


@query("contradictions", f"WITH c AS (SELECT doc_id, {CONTRARY} AS t FROM documents), {CONFLICT_CTES} SELECT doc_id, coalesce(string_agg(topic, ',' ORDER BY topic), '') AS topics, least(coalesce(sum(weight), 0), 12)::INT AS weight, coalesce(bool_or(critical), false) AS critical FROM documents LEFT JOIN al USING (doc_id) GROUP BY doc_id")
def contradicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = contradictions.detected(spread(docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.expr(CONTRARY).alias("text")))
    return f.select("doc_id", F.array_join(F.array_sort(F.transform("conflicts", lambda c: c["topic"])), ",").alias("topics"), F.col("conflict_weight").alias("weight"), F.col("has_critical_conflict").alias("critical"))


PROMPTED_TEXTS = f"SELECT doc_id, {PROMPTED} AS t FROM documents"
JUDGED = f"WITH c AS ({PROMPTED_TEXTS}), {CONFLICT_CTES}, {quality_sql.judged(PROMPTED_TEXTS, 'SELECT doc_id, least(sum(weight), 12) AS weight, bool_or(critical) AS critical FROM al GROUP BY doc_id')}"


@query("route_documents", f"WITH {quality_sql.route(PROMPTED_TEXTS)} SELECT doc_id, kind AS content_kind, task AS prompt_type, language, round(confidence, 6) AS confidence FROM rt")
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.routed(prompted(spark, sf_dir)).select("doc_id", "content_kind", "prompt_type", "language", F.round("route_confidence", 6).alias("confidence"))


#: Feature: column in the SQL.
STRENGTHS = {
    "sentence_count": "n_sents", "action_count": "n_acts", "atomic_action": "atomic", "task_signal": "task_signal", "concrete_core": "concrete", "goal_statement": "goal", "input_present": "input_", "output_contract": "output_", "output_example": "example_out",
    "numbered_steps": "n_steps", "procedure_steps": "procedure", "context_substance": "substance", "role_present": "role_", "terse_sufficiency": "terse", "self_contained": "self_contained", "outside_subject": "outside",
}
SHARES = {
    "placeholder_count": "n_slots", "referenced_fraction": "fraction", "placeholder_quality": "slot_quality", "unanchored": "unanchored", "output_matches_task": "matches_task", "relevant_constraints": "relevant", "boilerplate_constraints": "boiler",
    "safety_relevant": "safety", "boilerplate_severity": "severity", "redundancy": "redundancy", "filler_ratio": "filler", "signal_to_noise": "signal", "lexical_diversity": "diversity",
}
RATIOS = ("referenced_fraction", "placeholder_quality", "output_matches_task", "redundancy", "filler_ratio", "signal_to_noise", "lexical_diversity")


def feature_query(table_: dict[str, str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = features.extracted(prompted(spark, sf_dir))
        return f.select("doc_id", *((F.round(f"features.{n}", 6) if n in RATIOS else F.col(f"features.{n}")).alias(n) for n in table_))

    return run


feature_sql = lambda t: f"WITH {quality_sql.features(PROMPTED_TEXTS)} SELECT doc_id, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {n}' if n in RATIOS else f'{c} AS {n}' for n, c in t.items())} FROM ft"
query("feature_strengths", feature_sql(STRENGTHS))(feature_query(STRENGTHS))
query("feature_shares", feature_sql(SHARES))(feature_query(SHARES))
_low_score = lambda names: f"round(({' + '.join(f's_{d}' for d in names)}) / {len(names)}) < 3"
_missing = "CASE WHEN " + quality_sql.strip("t") + " = '' THEN " + str([quality.ROLE, *quality.TASK_CRITERIA]) + " WHEN kind = 'Task' THEN list_filter([" + ", ".join(f"CASE WHEN a_{d} <> -2 AND round(s_{d}) < 3 THEN '{n}' END" for n, d in quality.TASK_CRITERIA.items()) + "], lambda x: x IS NOT NULL) ELSE list_filter([" + ", ".join(f"CASE WHEN {_low_score(ds)} THEN '{n}' END" for n, ds in quality.GUIDELINE_CRITERIA.items()) + "], lambda x: x IS NOT NULL) END"


@query("quality_scores", f"{JUDGED} SELECT doc_id, kind AS content_kind, task AS prompt_type, overall AS overall_score, w AS conflict_weight, array_to_string({_missing}, ',') AS missing, {', '.join(f's_{d} AS {d.lower()}' for d in quality.DIMENSIONS)}, array_to_string(list_filter([{', '.join(f'CASE WHEN a_{d} <> -2 THEN {literal(d)} END' for d in quality.DIMENSIONS)}], lambda x: x IS NOT NULL), ',') AS applicable FROM ju")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.evaluated(prompted(spark, sf_dir))
    applicable = F.array_join(F.transform(F.filter("dimensions", lambda d: d["applicable"]), lambda d: d["name"]), ",")
    return found.select("doc_id", "content_kind", "prompt_type", "overall_score", "conflict_weight", F.array_join("missing_sections", ",").alias("missing"), *(F.get("dimensions", F.lit(i))["score"].alias(d.lower()) for i, d in enumerate(quality.DIMENSIONS)), applicable.alias("applicable"))


_need = lambda d: f"a_{d} <> -2 AND s_{d} < 5"
WANTED = {
    "Goal": _need("Goal"), "Input": _need("Input") + " AND n_slots = 0", "Output": "a_Output <> -2 AND s_Output <= 5 AND output_ < 2", "Context": _need("Context") + " AND NOT self_contained", "Constraint": _need("Constraint") + " AND relevant = 0",
    "Actionability": _need("Actionability") + " AND NOT atomic", "Ambiguity": _need("Ambiguity"), "Safety": _need("Safety") + " AND safety", "Reuse": _need("Reuse") + " AND n_slots = 0", "Role": "role_ = 1",
}
_told = ", ".join(f"CASE WHEN {WANTED[d]} THEN CASE WHEN language = 'En' THEN {literal(en)} ELSE {literal(de)} END END" for d, (de, en) in recommendations.BY_DIMENSION.items())
_kind = "CASE WHEN kind = 'Task' THEN task ELSE kind END"


@query("recommendations", f"""{JUDGED} SELECT doc_id, CASE WHEN w > 0 THEN NULL WHEN {quality_sql.strip('t')} = '' THEN '' ELSE array_to_string(list_filter([{_told}], lambda x: x IS NOT NULL)[:3], ' | ') END AS advice,
  array_to_string(list_filter([CASE WHEN {_kind} IN ('Guideline', 'GeneralTask') THEN 'INPUT: pure ideation, no data referenced' END, CASE WHEN {_kind} IN ('Planning', 'Analysis', 'GeneralTask') THEN 'REUSE: one-off task' END, 'SAFETY: benign domain, no boundaries stated'], lambda x: x IS NOT NULL), ' | ') AS reasons FROM ju""")
def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = quality.evaluated(prompted(spark, sf_dir))
    return f.select("doc_id", F.when(F.col("conflict_weight") == 0, F.array_join("recommendations", " | ")).alias("advice"), F.array_join(F.transform("na_reasons", lambda r: r["reason"]), " | ").alias("reasons"))


@query("artifact_advice", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{hygiene.EMAIL}'), lambda x: 'Datenschutz: Ersetze »' || x || '« durch {{EMAIL}} um personenbezogene Daten zu schützen.'))), ' | ') AS advice FROM documents""")
def artifact_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = hygiene.detected(docs(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))), "text", {"mails": hygiene.EMAILS})
    return f.select("doc_id", F.array_join(recommendations.artifact_advice(F.col("mails")), " | ").alias("advice"))


# Constraints, profiles and variants.
ANSWERS = "(SELECT doc_id, i AS item_id, CASE i WHEN 0 THEN 'use the Cloud' WHEN 1 THEN lang || ' and English' ELSE 'a very long text with examples' END AS value FROM documents, (SELECT unnest([0, 1, 2]) AS i))"
FOUND = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, unnest(regexp_extract_all(t, {literal('(?i)' + p)})) AS constraint_text FROM d" for c, _, ps in constraints.CONSTRAINTS for p in ps)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("item_id") == 0, "use the Cloud").when(F.col("item_id") == 1, F.concat("lang", F.lit(" and English"))).otherwise("a very long text with examples")
    return docs(spark, sf_dir).select("doc_id", "lang", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("item_id")).withColumn("value", value)


@query("constraint_conflicts", f"""WITH {D}, f AS ({FOUND}), r AS (SELECT unnest({[c for c, (_, ws) in constraints.CONFLICTS.items() for _ in ws]}) AS category, unnest({[w for _, ws in constraints.CONFLICTS.values() for w in ws]}) AS word),
  s AS (SELECT unnest({list(constraints.CONFLICTS)}) AS category, unnest({[s for s, _ in constraints.CONFLICTS.values()]}) AS severity)
SELECT f.doc_id, f.category, a.item_id, severity, count(*) AS n FROM f JOIN s USING (category) JOIN {ANSWERS} a ON a.doc_id = f.doc_id WHERE EXISTS (SELECT 1 FROM r WHERE r.category = f.category AND contains(lower(a.value), word)) GROUP BY ALL""")
def constraint_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = answers(spark, sf_dir)
    f = constraints.conflicts(constraints.hard_constraints(prompted(spark, sf_dir)), given.select("doc_id", "item_id", "value"))
    return f.join(given.select("doc_id", "item_id", F.col("value").alias("source")), ["doc_id", "source"]).groupBy("doc_id", "category", "item_id", "severity").agg(F.count("*").alias("n"))


@query("profile_conflicts", f"""WITH {D}, f AS ({FOUND}), p AS (SELECT unnest({[p.profile_id for p in directions.PROFILES.values() for _ in p.conflicting]}) AS profile_id, unnest({[c for p in directions.PROFILES.values() for c in p.conflicting]}) AS category)
SELECT doc_id, profile_id, category, CASE WHEN category IN {constraints.SECURITY} THEN 'blocking' ELSE 'warning' END AS severity, count(*) AS n FROM f JOIN p USING (category) GROUP BY ALL""")
def profile_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directions.conflicts_of_profiles(prompted(spark, sf_dir)).groupBy("doc_id", "profile_id", "category", "severity").agg(F.count("*").alias("n"))


CHOSEN = ("sachlich", "kreativ", "custom", "sachlich", "unknown", "kurz", "agentisch", "deep_research", "compliance")
_five = [p.profile_id for p in directions.selected(CHOSEN, "Sei nett.")][:5]
_prefix = {p.profile_id: p.prefix for p in directions.selected(CHOSEN, "Sei nett.")}


@query("variants", f"""WITH {D}, v AS (SELECT unnest({_five}) AS profile_id, unnest({[_prefix[i] for i in _five]}) AS prefix, unnest({[f"VAR_{p}_{i + 1}" for i, p in enumerate(_five)]}) AS variant_id)
SELECT doc_id, variant_id, profile_id, sha256(CASE WHEN {BARE.format("t")} = '' THEN '' ELSE prefix || chr(10) || chr(10) || t END) AS digest FROM d, v""")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directions.variants(prompted(spark, sf_dir), CHOSEN, "Sei nett.").select("doc_id", "variant_id", "profile_id", F.sha2("content", 256).alias("digest"))


_cloudy = " OR ".join(f"regexp_matches(c, {literal('(?i)' + p)})" for p in directions.CLOUD)
_offline = " OR ".join(f"regexp_matches(t, {literal('(?i)' + p)})" for p in constraints.CONSTRAINTS[0][2])


@query("variant_checks", f"""WITH {D}, v AS (SELECT doc_id, t, {literal(directions.PROFILES["technisch"].prefix)} || chr(10) || chr(10) || t AS c FROM d WHERE {BARE.format("t")} <> '')
SELECT doc_id, true AS original_unchanged, true AS constraints_preserved, NOT ({_offline}) OR NOT ({_cloudy}) AS no_cloud_references, true AS constraints_listed, true AS content_different FROM v""")
def variant_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = directions.validated(directions.variants(prompted(spark, sf_dir), ("technisch",)).where("content != ''"))
    return f.select("doc_id", "original_unchanged", "constraints_preserved", "no_cloud_references", "constraints_listed", "content_different")


# Gaps, tiers and merged answers.
def gap_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = context.evaluated(prompted(spark, sf_dir))
    return f.withColumns({"hygiene_score": (F.col("doc_id") % 100).cast("int"), "blueprint_missing": F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Zieldefinition"), F.lit(" "), F.lit("Tests"))), "contamination_status": F.when(F.col("doc_id") % 7 == 0, "BLOCKING_SENSITIVE_CONTENT").otherwise("CLEAN"), "content_length": F.length("text")})


@query("gaps")
def gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = gaps.classified(gaps.detected(gap_input(spark, sf_dir)))
    return f.select("doc_id", F.size("gaps").alias("n_gaps"), F.array_join(F.transform("questions", lambda q: F.concat_ws(":", q["tier"], q["source"], q["label"])), " | ").alias("questions"), "overflow.required", "overflow.recommended", "overflow.optional")


@query("merged_answers", """
SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 2 OR (doc_id % 5 <> 0 AND doc_id % 3 = 1) THEN coalesce(text, '') ELSE regexp_replace(coalesce(text, ''), '\\s+$', '') || chr(10) || chr(10) || '## Ergänzte Informationen (Missing-Info-Gate)' || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '- **Ziel:** ' || lang || ' goal' || CASE WHEN doc_id % 2 = 0 THEN ' _(Annahme)_' ELSE '' END ELSE '' END || CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN '- **Tools:** *übersprungen*' ELSE '' END || chr(10) END) AS digest,
  CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS answered, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 1 ELSE 0 END AS assumed, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS skipped FROM documents
""")  # fmt: skip
def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("doc_id") % 3
    df = docs(spark, sf_dir).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("content"))
    df = df.withColumns({
        "questions": F.array(F.struct(F.lit("a").alias("id"), F.lit("Ziel").alias("label")), F.struct(F.lit("b").alias("id"), F.lit("Tools").alias("label"))),
        "answers": F.when(third == 0, F.array(F.struct(F.lit("a").alias("item_id"), F.concat(F.lit("# "), "lang", F.lit(" goal ")).alias("value")))), "skipped": F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("b"))),
        "outcome": F.when(third == 2, "SKIPPED").when((F.col("doc_id") % 2 == 0) & (third == 0), "ASSUMPTIONS").otherwise("COMPLETED"),
    })
    f = gaps.merged(df)
    return f.select("doc_id", F.sha2("enriched_content", 256).alias("digest"), F.col("answered_count").alias("answered"), F.col("assumed_count").alias("assumed"), F.col("skipped_count").alias("skipped"))


# Rewriting.
def rewriting(mode: str, kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = prompted(spark, sf_dir).withColumn("r", restructure.optimized(F.col("text"), mode, kind))
        return f.select("doc_id", F.sha2("r.optimized", 256).alias("digest"), F.size("r.changes").alias("n_changes"), F.size("r.warnings").alias("n_warnings"), "r.contamination_cleaned")

    return run


for _kind in restructure.STYLES:
    for _mode in restructure.MODES:
        query(f"optimize_{_kind}_{_mode}")(rewriting(_mode, _kind))


@query("validate_prompt")
def validate_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = prompted(spark, sf_dir).withColumn("v", restructure.validated(F.col("text"), F.col("text")))
    return f.select("doc_id", "v.passed", F.array_join("v.unresolved_placeholders", ",").alias("placeholders"), F.array_join("v.empty_sections", ",").alias("empty_sections"))


_heading = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){w}') THEN '{h}'" for w, h, _ in restructure.BLOCKS)


@query("recommendation_blocks", f"SELECT doc_id, {_heading('lang')} ELSE '## Ergänzung 1' END || ';' || {_heading(literal('Zieldefinition'))} ELSE '' END AS headings FROM documents")
def recommendation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = docs(spark, sf_dir).withColumn("b", restructure.blocks(F.array("lang", F.lit("Zieldefinition"))))
    return f.select("doc_id", F.array_join(F.transform("b", lambda b: b["heading"]), ";").alias("headings"))


# The store.
STORED = "(SELECT doc_id AS id, source || '/' || doc_id AS file_path, doc_id % 3 = 0 AS is_favorite, lang AS category, n_chars FROM documents)"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), (F.col("doc_id") % 3 == 0).alias("is_favorite"), F.col("lang").alias("category"), "n_chars")


@query("documents_in_order", f"SELECT id, file_path FROM {STORED} ORDER BY file_path")
def documents_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.in_order(stored(spark, sf_dir)).select("id", "file_path")


@query("point_lookup", f"SELECT * FROM {STORED} WHERE id = 3")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_id(stored(spark, sf_dir), 3)


@query("favourites", f"SELECT id FROM {STORED} WHERE is_favorite")
def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.favourites(stored(spark, sf_dir)).select("id")


@query("toggle_favourites", f"SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM {STORED}")
def toggle_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_favourite(stored(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))).select("id", "is_favorite")


@query("set_favourites", f"SELECT id, is_favorite OR id IN (SELECT doc_id FROM labels) AS is_favorite FROM {STORED}")
def set_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_favourite(stored(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), True).select("id", "is_favorite")


@query("hydrate_favourites", f"SELECT n.id, coalesce(o.is_favorite, false) AS is_favorite FROM (SELECT id + 50 AS id, file_path FROM {STORED}) n LEFT JOIN (SELECT * FROM {STORED} WHERE n_chars > 300) o USING (file_path)")
def hydrate_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(spark, sf_dir)
    return store.hydrated(df.withColumns({"id": F.col("id") + 50, "is_favorite": F.lit(None).cast("boolean")}), df.where("n_chars > 300")).select("id", "is_favorite")


def histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("prompt_id"), F.col("value").alias("overall_score"), F.col("ts").alias("evaluated_at"), "event_type")
    return e, e.where("event_type != 'view'").withColumnRenamed("overall_score", "hygiene_score")


@query("score_lookup", f"""
WITH q AS (SELECT CAST(user_id AS BIGINT) AS id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS r FROM events), h AS (SELECT CAST(user_id AS BIGINT) AS id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS r FROM events WHERE event_type <> 'view')
SELECT d.id, q.value AS quality_score, h.value AS hygiene_score FROM {STORED} d LEFT JOIN q ON q.id = d.id AND q.r = 1 LEFT JOIN h ON h.id = d.id AND h.r = 1
""")  # fmt: skip
def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_scores(stored(spark, sf_dir), *histories(spark, sf_dir)).select("id", "quality_score", "hygiene_score")


@query("hygiene_lookup", f"WITH h AS (SELECT CAST(user_id AS BIGINT) AS id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT d.id, coalesce(event_type, 'clean') AS hygiene_status FROM {STORED} d LEFT JOIN h ON h.id = d.id AND h.r = 1")
def hygiene_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("prompt_id"), F.col("event_type").alias("status"), F.lit("[]").alias("artifacts"), F.struct("ts", "event_id").alias("evaluated_at"))
    return store.with_hygiene(stored(spark, sf_dir), h).select("id", "hygiene_status")


@query("hits_with_metadata", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
     k AS (SELECT vec_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 3) AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q ORDER BY score DESC, vec_id LIMIT 20)
SELECT vec_id AS id, score, lang, source FROM k JOIN documents ON doc_id = vec_id
""")  # fmt: skip
def hits_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators import retrieval

    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").limit(1).select("embedding").first()  # one row
    hits = retrieval.nearest(vectors, first[0] if first else [], k=20).withColumnRenamed("vec_id", "id")
    return store.with_metadata(hits, docs(spark, sf_dir).withColumnRenamed("doc_id", "id"), columns=("lang", "source")).select("id", "score", "lang", "source")


@query("vectors_by_model", "SELECT label AS model, count(*) AS n FROM embeddings GROUP BY label")
def vectors_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.vectors_by_model(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "model"))


@query("index_report", "SELECT count(*) FILTER (doc_id % 4 = 0 AND n_chars > 99) AS indexed, count(*) FILTER (doc_id % 4 = 1) AS skipped_sensitive, count(*) FILTER (doc_id % 4 >= 2) AS skipped_unchanged, count(*) FILTER (doc_id % 4 = 0 AND n_chars <= 99) AS failed FROM documents")
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("doc_id") % 4
    return store.index_report(docs(spark, sf_dir).select(F.when(r == 0, "indexed").when(r == 1, "skipped_sensitive").otherwise("skipped_unchanged").alias("todo"), F.when(F.col("n_chars") > 99, 1).alias("vector")))


_results = list(store.RESULTS)


@query("evidence_summary", f"SELECT count(*) AS total, {', '.join(f'count(*) FILTER (event_id % 6 = {i}) AS {r}' for i, r in enumerate(_results))} FROM events")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.evidence_summary(table(spark, sf_dir, "events").withColumn("result", F.get(F.array(*map(F.lit, [*_results, "other"])), (F.col("event_id") % 6).cast("int"))))


@query("missing_families", "SELECT f AS family_id FROM (SELECT unnest(['en', 'de', 'xx', 'yy']) AS f) WHERE f NOT IN (SELECT lang FROM documents)")
def missing_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing_families(docs(spark, sf_dir).withColumnRenamed("lang", "family_id"), ("en", "de", "xx", "yy"))


@query("invariants", """
WITH p AS (SELECT doc_id AS id, lang AS f, doc_id % 3 AS c FROM documents), e AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE lang END AS f, doc_id % 2 AS c FROM documents WHERE doc_id % 50 <> 1)
SELECT 'LENGTH_MISMATCH' AS type, NULL AS subject FROM (SELECT 1) WHERE (SELECT count(*) FROM p) <> (SELECT count(*) FROM e)
UNION ALL SELECT 'STALE_RESULT', CAST(p.id AS VARCHAR) FROM p JOIN e USING (id) WHERE p.f <> e.f UNION ALL SELECT 'CONSTRAINT_LOST', CAST(p.id AS VARCHAR) FROM p JOIN e USING (id) WHERE p.c > e.c
""")  # fmt: skip
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    p = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("content_fingerprint"), (F.col("doc_id") % 3).alias("constraints_before"))
    e = d.where("doc_id % 50 != 1").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("lang")).alias("result_fingerprint"), F.lit("analysis").alias("result_type"), (F.col("doc_id") % 2).alias("constraints_after"))
    return store.violations(p, e, p).select("type", "subject")


@query("changed_fingerprints", "SELECT doc_id AS id FROM documents WHERE NOT (doc_id % 2 = 0 AND lang = 'en')")
def changed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("fingerprint"))
    return store.changed(d, d.where("id % 2 = 0").withColumn("fingerprint", F.lit("en"))).select("id")


@query("remembered_fingerprints", "SELECT user_id AS id, max(ts) AS \"at\" FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20")
def remembered_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.lit("f").alias("fingerprint"))
    return store.remembered(e.where("at < '2024-06-01'"), e, most=20).select("id", "at")


@query("safe_events", "SELECT event_id, event_type AS kind, 'mail' AS note, 1 AS omitted FROM events")
def safe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("note"), F.lit("mail"), F.lit("secret"), F.lit("x")).alias("attributes"), F.lit("m").alias("message"))
    out = store.safe_events(e, ("kind", "note"))
    return out.select("event_id", F.col("attributes")["kind"].alias("kind"), F.col("attributes")["note"].alias("note"), "omitted")


@query("combined_scores", "SELECT doc_id, CAST(floor(0.4::DOUBLE * least(n_chars, 100) + 0.2::DOUBLE * (doc_id % 101) + 0.4::DOUBLE * (doc_id % 7) + 0.5) AS INT) AS score FROM documents")
def combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", store.combined_score(F.least("n_chars", F.lit(100)), F.col("doc_id") % 101, F.col("doc_id") % 7).alias("score"))


# Evaluation.
CASES = "(SELECT doc_id AS id, least(n_chars // 50, 100) AS score, (doc_id * 7) % 101 AS gold, lang, doc_id % 4 AS k FROM documents)"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.least(F.expr("n_chars div 50"), F.lit(100)).alias("score"), (F.col("doc_id") * 7 % 101).alias("gold"), "lang", (F.col("doc_id") % 4).alias("k"))


_letters = "ABCDEFGHI"


@query("contrast_checks", f"""
WITH p AS (SELECT substr('{_letters}', CAST(id // 2 AS INT) % 9 + 1, 1) || (id % 2 + 1) AS pair, min(id) AS id, count(*) AS n FROM {CASES} GROUP BY pair), s AS (SELECT pair, p.id, n, score FROM p LEFT JOIN (SELECT * FROM {CASES} WHERE id > 1) c ON c.id = p.id),
     w AS (SELECT left(pair, 1) AS stem, max(score) FILTER (pair LIKE '%1') AS a, max(score) FILTER (pair LIKE '%2') AS b, count(*) FILTER (score IS NULL) AS missing FROM s GROUP BY stem)
SELECT stem, CASE WHEN missing > 0 OR a IS NULL OR b IS NULL THEN 'NOT_EVALUATED' WHEN stem = 'I' THEN 'UNKNOWN' WHEN CASE stem WHEN 'A' THEN a >= b WHEN 'B' THEN b > a WHEN 'C' THEN abs(a - b) <= 10 WHEN 'D' THEN b - a >= 20 WHEN 'E' THEN abs(a - b) <= 30 WHEN 'F' THEN b - a <= 5 WHEN 'G' THEN abs(a - b) <= 15 ELSE b - a <= 5 END THEN 'PASS' ELSE 'FAIL' END AS result FROM w
""")  # fmt: skip
def contrast_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    pair = F.concat(F.substring(F.lit(_letters), (F.expr("id div 2") % 9 + 1).cast("int"), F.lit(1)), (F.col("id") % 2 + 1).cast("string"))
    return metrics.contrast_checks(c.withColumn("pair", pair), c.where("id > 1").select("id", "score"))


@query("routing_accuracy", f"SELECT count(*) AS n, round(avg(CASE WHEN k < 2 THEN CAST((lang = 'en') = (k = 0) AS INT) ELSE CAST((CASE WHEN k = 2 THEN 'guideline' ELSE 'task' END) = (CASE WHEN lang = 'en' THEN 'guideline' ELSE 'task' END) AS INT) END), 6) AS accuracy, round(count(*) FILTER (lang = 'en' AND k = 2) / count(*) FILTER (lang = 'en'), 6) AS guideline_recall FROM {CASES}")
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "guideline").otherwise("task")
    f = metrics.routing(cases(spark, sf_dir).withColumns({"kind": kind, "content_kind": F.when(F.col("k") >= 2, F.when(F.col("k") == 2, "guideline").otherwise("task")), "guideline_routed": F.col("k") == 0}))
    return f.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("guideline_recall", 6).alias("guideline_recall"))


@query("missing_information", f"""
WITH r AS (SELECT list_filter([CASE WHEN k <> 1 THEN 'Zieldefinition' END, CASE WHEN k >= 2 THEN 'Ausgabeformat' END], lambda x: x IS NOT NULL) AS f, CASE WHEN lang = 'en' THEN ['Zieldefinition', 'Kontextqualität'] ELSE ['Ausgabeformat'] END AS w, gold % 10 >= 5 AS sat FROM {CASES}),
     n AS (SELECT len(list_intersect(f, w)) AS tp, len(f) - len(list_intersect(f, w)) + CAST(sat AND list_contains(f, 'Zieldefinition') AS INT) AS fp, len(w) - len(list_intersect(f, w)) AS fn, CAST(sat AND NOT list_contains(f, 'Zieldefinition') AS INT) AS tn FROM r)
SELECT round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(sum(fp) / (sum(fp) + sum(tn)), 6) AS false_positive_rate FROM n
""")  # fmt: skip
def missing_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    found = F.array_compact(F.array(F.when(k != 1, "Zieldefinition"), F.when(k >= 2, "Ausgabeformat")))
    told = F.when(F.col("lang") == "en", F.array(F.lit("The GOAL is open"), F.lit("Kontext fehlt"), F.lit("???"))).otherwise(F.array(F.lit("Länge der Antwort")))
    f = metrics.missing_information(cases(spark, sf_dir).select(found.alias("missing_sections"), told.alias("missing_information"), F.create_map(F.lit("GOAL_CLARITY"), F.col("gold") % 10).alias("criteria")))
    return f.select(*(F.round(c, 6).alias(c) for c in f.columns))


@query("advice_usefulness", f"""
SELECT CAST(sum(2) AS BIGINT) AS n_advice, CAST(sum(CAST(gold % 10 < 5 AS INT) + CAST(gold % 7 < 5 AS INT)) AS BIGINT) AS n_useful, round(1 - count(*) FILTER (k = 0 AND score >= 85) / count(*) FILTER (k = 0), 6) AS gaming_resistance,
  round(count(*) FILTER (lang = 'en' AND k = 1 AND score >= 70) / count(*) FILTER (lang = 'en' AND k = 1), 6) AS terse_fairness, round(sum(CAST(gold % 10 < 5 AS INT) + CAST(gold % 7 < 5 AS INT)) / sum(2), 6) AS usefulness FROM {CASES}
""")  # fmt: skip
def advice_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = metrics.usefulness(cases(spark, sf_dir).withColumns({
        "recommendations": F.array(F.lit("State an explicit goal: now"), F.lit("Output-Disziplin fehlt")), "criteria": F.create_map(F.lit("GOAL_CLARITY"), F.col("gold") % 10, F.lit("OUTPUT_CONTRACT"), F.col("gold") % 7),
        "adversarial_pattern": F.when(F.col("k") == 0, "x"), "tags": F.when((F.col("lang") == "en") & (F.col("k") == 1), F.array(F.lit("terse"), F.lit("excellent"))).otherwise(F.array(F.lit("terse"))),
    }))
    return f.select("n_advice", "n_useful", *(F.round(c, 6).alias(c) for c in ("gaming_resistance", "terse_fairness", "usefulness")))


@query("ordering_accuracy", f"SELECT count(*) AS n, round(avg(CAST((a.score > b.score) = (a.gold > b.gold) AS INT)), 6) AS accuracy FROM {CASES} a JOIN {CASES} b ON b.id = a.id + 1 WHERE a.score <> b.score AND a.gold <> b.gold")
def ordering_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    f = metrics.ordering_accuracy(c.select(F.col("id").alias("case_a"), (F.col("id") + 1).alias("case_b")), c)
    return f.select("n", F.round("accuracy", 6).alias("accuracy"))


@query("contaminated_lines", """
WITH f AS (SELECT doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'x' || chr(10) || 'see S2-H-12 here' WHEN 1 THEN 'let a = "' || (SELECT replace(min(text), '"', '') FROM benchmark) || '";' WHEN 2 THEN 'Calibration V2 case' ELSE 'clean' END AS t FROM documents)
SELECT path, 2 AS line, 'case-id' AS kind, 's2-' AS detail FROM f WHERE path % 4 = 0 UNION ALL SELECT path, 1, 'gold-anchor', 'calibration v2' FROM f WHERE path % 4 = 2
UNION ALL SELECT path, 1, 'verbatim-corpus', left(lower(trim(regexp_replace((SELECT replace(min(text), '"', '') FROM benchmark), '\\s+', ' ', 'g'))), 80) FROM f WHERE path % 4 = 1
""")  # fmt: skip
def contaminated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "benchmark").agg(F.replace(F.min("text"), F.lit('"'), F.lit("")).alias("text"))
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "x\nsee S2-H-12 here").when(k == 1, F.concat(F.lit('let a = "'), F.col("_b"), F.lit('";'))).when(k == 2, "Calibration V2 case").otherwise("clean")
    one = first.first()[0]  # one row
    return metrics.contaminated_lines(docs(spark, sf_dir).withColumn("_b", F.lit(one)).select(F.col("doc_id").alias("path"), text.alias("text")), first)


@query("pairwise_report", f"""
WITH s AS (SELECT a.id, CASE WHEN b.score IS NULL OR b.gold IS NULL THEN 'N' WHEN abs(a.gold - b.gold) < 5 THEN 'T' WHEN a.score > b.score THEN 'P' ELSE 'F' END AS r FROM {CASES} a LEFT JOIN {CASES} b ON b.id = a.id + 1)
SELECT count(*) FILTER (r = 'P') AS pass, count(*) FILTER (r = 'F') AS fail, count(*) FILTER (r = 'T') AS tie, count(*) FILTER (r = 'N') AS not_evaluated, round(count(*) FILTER (r = 'P') / count(*) FILTER (r IN ('P', 'F')), 6) AS accuracy, 'FAIL' AS verdict,
  'missing required families: P7;' || count(*) FILTER (r = 'N') || ' pair(s) NOT_EVALUATED (missing member)' AS reasons FROM s
""")  # fmt: skip
def pairwise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    pairs = c.select(F.col("id").alias("pair_id"), F.concat(F.lit("P"), (F.col("id") % 6 + 1).cast("string")).alias("family_id"), F.col("id").alias("case_a"), (F.col("id") + 1).alias("case_b"))
    f = metrics.pairwise_report(pairs, c.select("id", F.col("gold").alias("score")), c.select("id", "score"))
    return f.select("pass", "fail", "tie", "not_evaluated", F.round("accuracy", 6).alias("accuracy"), "verdict", F.array_join("reasons", ";").alias("reasons"))


@query("adjudication", f"""
WITH j AS (SELECT id, score AS a, gold AS b, CASE WHEN score >= 85 THEN 5 WHEN score >= 70 THEN 4 WHEN score >= 55 THEN 3 WHEN score >= 40 THEN 2 ELSE 1 END AS ba, CASE WHEN gold >= 85 THEN 5 WHEN gold >= 70 THEN 4 WHEN gold >= 55 THEN 3 WHEN gold >= 40 THEN 2 ELSE 1 END AS bb, k FROM {CASES}),
     r AS (SELECT *, abs(a - b) > 15 OR abs(ba - bb) > 1 OR k = 1 OR k = 2 AS need FROM j)
SELECT id, need AS needs_third, CAST(CASE WHEN need AND k = 0 THEN 50 WHEN (a + b) % 2 = 0 OR ((a + b) // 2) % 2 = 0 THEN (a + b) // 2 ELSE (a + b) // 2 + 1 END AS INT) AS reference_score, CASE WHEN need AND k = 0 THEN 'C' WHEN k = 1 THEN 'PARTIAL' ELSE 'YES' END AS reference_fit FROM r
""")  # fmt: skip
def adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.functions.text import band

    k = F.col("k")
    judged = cases(spark, sf_dir).select(
        "id", F.col("score").alias("score_a"), F.col("gold").alias("score_b"), band(F.col("score")).alias("band_a"), band(F.col("gold")).alias("band_b"), F.lit("YES").alias("fit_a"), F.when(k == 1, "NO").otherwise("YES").alias("fit_b"),
        F.when(k == 2, F.array(F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)")).alias("critical_a"), F.expr("cast(null as array<string>)").alias("critical_b"),
        F.when(k == 0, 50).alias("score_c"), F.lit("POOR").alias("band_c"), F.lit("C").alias("fit_c"),
    )
    return metrics.adjudicated(judged).select("id", "needs_third", F.col("reference_score").cast("int").alias("reference_score"), "reference_fit")


@query("prompt_scores")
def prompt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant import actions

    return actions.score(prompted(spark, sf_dir), "text").select("doc_id", "quality_score", "hygiene_score", "context_score", "score")


@query("paste_analysis", f"""WITH {CLASSED} SELECT doc_id, content_class, n_units AS content_length, array_to_string(list_filter([CASE WHEN n_units > 50000 THEN 'long' END, CASE WHEN NOT clean THEN 'contaminated' END, CASE WHEN {STATUS} = 'BLOCKING_SENSITIVE_CONTENT' THEN 'secret' END], lambda x: x IS NOT NULL), ',') AS notes FROM b4 WHERE NOT blank""")
def paste_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant import actions

    f = actions.paste_analysis(prompted(spark, sf_dir), "text")
    kind = lambda n: F.when(F.contains(n, F.lit("sehr lang")), "long").when(F.startswith(n, F.lit("Kontamination")), "contaminated").otherwise("secret")
    return f.select("doc_id", "content_class", F.col("content_length").cast("bigint").alias("content_length"), F.array_join(F.transform("notes", kind), ",").alias("notes"))


@query("audio_summary", """
WITH d AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN 'a description' ELSE 'short' END AS description, doc_id % 5 AS k, doc_id % 4 AS m FROM documents),
     t AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN source || ' – a description' ELSE source || ', aus der Kategorie ' || lang || ', mit Schlagworten: x.' END AS s FROM d)
SELECT doc_id, CASE WHEN k = 0 OR m = 0 THEN 'Dieser Inhalt wird aus Sicherheitsgründen nicht vorgelesen. Bitte prüfen Sie die Quelldatei manuell.' WHEN k = 1 OR m = 1 THEN 'Achtung: Dieser Prompt enthält mögliche Fremdartefakte oder sensible technische Details. ' || s ELSE s END AS spoken,
  CASE WHEN k = 0 OR m = 0 THEN 'blocked' WHEN k = 1 OR m = 1 THEN 'warning' ELSE 'normal' END AS severity, NOT (k = 0 OR m = 0) AS can_speak FROM t
""")  # fmt: skip
def audio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators import redaction

    k, m = F.col("doc_id") % 5, F.col("doc_id") % 4
    f = redaction.audio_summary(docs(spark, sf_dir).select(
        "doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 3 == 0, "a description").otherwise("short").alias("description"), F.col("lang").alias("category"), F.array(F.lit("x"), F.lit("deadbeef99")).alias("tags"), F.col("text").alias("content"),
        F.when(k == 0, "critical").when(k == 1, "warning").otherwise("clean").alias("hygiene_status"), F.when(m == 0, "BLOCKING_SENSITIVE_CONTENT").when(m == 1, "POSSIBLE_CONTAMINATION").alias("contamination_status"),
    ))
    return f.select("doc_id", "spoken", "severity", "can_speak")
