import pytest
from pyspark.sql import functions as F

from foliant.operators import contradictions, quality, recommendations

# text: topic, class and weight of every conflict
CASES = {
    "Answer the mail in German. Also translate your answer to English.": [("language", 1, 6)],
    "Answer in English. Reply auf Deutsch only.": [("language", 1, 6)],
    "Schreibe in deutscher Sprache. Antworte immer auf Deutsch.": [],
    "Leser mögen kein Amtsdeutsch. Nutze Karten aus Deutschland.": [],
    "The summary must be exactly 40 words and at least 90 words long.": [("length", 3, 3)],
    "Keep it long with at most 10 words. Keep it long with at least 30 words.": [("length", 3, 3)],
    "Write at most 10 words. Keep it long, at least 30 words.": [],
    "Keep it long with at least 10 words. Keep it long with at most 30 words.": [],
    "Halte es kurz, aber erkläre alles ausführlich.": [("length", 3, 3)],
    "Keep the text short. Always stay concise.": [],
    "Output all rows of all data. Do not output any data.": [("output_data", 6, 6)],
    "Answer all questions at once. Answer none of the questions.": [("question_scope", 5, 4)],
    "Return CSV, YAML, and XML.": [("format", 2, 4)],
    "Return CSV.\n\nReturn YAML.\n\nReturn XML.": [],
    "The tool reads CSV, YAML and XML files.": [],
    "Return only YAML. Return only XML.": [("format", 2, 4)],
    "Return YAML. Return XML.": [],
    "Return YAML. Do not return YAML.": [("format", 2, 4)],
    "Include YAML examples. Write a small YAML parser in plain Dart since there is no need for Rust here.": [],
    "Return a JSON object. Use prose for everything.": [("format", 2, 6)],
    "Keep the plan confidential. Publish the plan tomorrow.": [("secrecy", 4, 4)],
    "Keep it public. Do not keep it public.": [("secrecy", 4, 4)],
    "Use a formal voice and a casual voice in one.": [("tone", 7, 4)],
    "Sprich nie über Politik. Beginne immer mit Politik.": [("content", 7, 4)],
    "Verwende keine Begriffe aus dem Sport, erkläre aber alle Begriffe.": [("content", 7, 4)],
    "Deploy the service immediately. Do not deploy the service immediately.": [("procedure_order", 8, 4)],
    "Deploy the service immediately.\n\nDo not deploy the service immediately.": [],
    "Deploy it immediately. Never run tests immediately.": [],
    "| Use the budget for cloud | Never use the budget |": [],
    "Never output no data.": [],
    "Use active voice. Use passive voice.": [("voice", 1, 6)],
    "Cite sources. Do not cite sources.": [("source_use", 6, 6)],
    "Use cm for sizes. Use inches for sizes.": [("unit", 1, 6)],
    "Answer in German. Keep it short.": [],
    "": [],
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "text string").coalesce(1).withColumns({"conflicts": F.lit(1), "topic": F.lit(2), "_m": F.lit(3)})
    return {r.text: r for r in contradictions.detected(df.drop("_m")).collect()}


@pytest.mark.parametrize("text", CASES)
def test_conflicts(found, text):
    assert [(c.topic, c["class"], c.weight) for c in found[text].conflicts] == CASES[text]


def test_weight_order_and_wording(spark, found):
    assert found[None].conflicts == [] and found[None].conflict_weight == 0 and not found[None].has_critical_conflict
    german = found["Answer in English. Reply auf Deutsch only."].conflicts[0]
    assert (german.first, german.second) == ("Reply auf Deutsch only", "Answer in English") and german.critical
    assert [(c.first, c.second) for c in found["Keep it long with at most 10 words. Keep it long with at least 30 words."].conflicts] == [("at most 10 words", "at least 30 words")]
    assert found["Return CSV, YAML, and XML."].conflicts[0].first == "csv+xml+yaml"
    both = " ".join(t for t in CASES if t.startswith(("Answer the", "Output", "Return CSV,", "The summary"))) + " " + "Use " * 5
    r = contradictions.detected(spark.createDataFrame([(both,)], "text string")).first()
    assert [c.topic for c in r.conflicts] == ["format", "language", "length", "output_data"] and r.conflict_weight == 12 and r.has_critical_conflict


def test_mandates(spark):
    text = "# Use it\nAlways write.\n\n| Never | --- | plain cell |\nDo not, never. The sky is blue! " + "Use a pen. " * 70
    r = contradictions.mandates(spark.createDataFrame([(text,)], "text string")).first().mandates
    assert len(r) == 60 and [(m.text, m.paragraph, m.polarity) for m in r[:5]] == [("# Use it", 0, 1), ("Always write", 0, 1), ("Never", 1, -1), ("Do not", 3, -1), ("never", 3, -1)]


def test_conflicts_cap_quality_and_lead_the_advice(spark):
    base = "Translate the following text into English. Return only the translation as text.\n\n{{text}}"
    rows = [("clean", base), ("bad", base + " Write the response in German."), ("poor", "Write something."), ("deutsch", "Schreibe etwas über die Katze und das Haus, bitte."), ("blank", " ")]
    r = {x.name: x for x in quality.evaluated(spark.createDataFrame(rows, "name string, text string")).collect()}
    assert r["clean"].overall_score >= 80 and r["bad"].overall_score <= 45 and r["bad"].conflict_weight == 6
    assert r["bad"].recommendations[0].startswith("Resolve the contradiction between") and 0 < len(r["poor"].recommendations) <= 3
    assert all(x.split()[0] in ("Formuliere", "Definiere", "Spezifiziere", "Ergänze", "Strukturiere", "Verbessere", "Mache", "Ersetze") for x in r["deutsch"].recommendations)
    assert r["blank"].recommendations == [] and [x.name for x in r["poor"].na_reasons] == ["Input", "Reuse", "Safety"]


def test_advice_for_artifacts(spark):
    rows = [("SECRET", "k", "{S}"), ("PII", "a@b.de", "{EMAIL}"), ("PII", "a@b.de", "{EMAIL}"), ("PROJECT_ARTIFACT", "FooBar", "{FOOBAR}"), ("LOG_LINE", "x", "{LOG}"), ("LOG_LINE", "y", None)]
    df = spark.createDataFrame(rows, "category string, match string, suggestion string").agg(F.collect_list(F.struct("category", "match", "suggestion")).alias("a"))
    got = df.select(recommendations.artifact_advice(F.col("a")).alias("x")).first().x
    assert len(got) == 4 and got == sorted(got) and "Datenschutz: Ersetze »a@b.de« durch {EMAIL} um personenbezogene Daten zu schützen." in got
    assert {r.category: r.r for r in spark.createDataFrame(rows, "category string, match string, s string").withColumn("r", recommendations.replacement(F.col("category"))).collect()}["PII"] == "{REDACTED}"


def test_negators_side_by_side_count_each(spark):
    """As in the reference, whose word edges consume nothing: two negators leave the polarity open."""
    rows = spark.createDataFrame([(1, "Do it, no no cigami"), (2, "Der der nicht nicht"), (3, "Der der nicht")], "i int, text string")
    found = contradictions.mandates(rows).select("i", F.col("mandates")[0]["polarity"].alias("p")).collect()
    assert dict(map(tuple, found)) == {1: 0, 2: 0, 3: -1}


def test_two_negators_side_by_side_make_no_contradiction(spark):
    """A mandate of open polarity is left out; by the SQL, whose expression consumes the space between them, it would forbid what the other asks for."""
    rows = spark.createDataFrame([(1, "Write the piece first. Write the piece no no first."), (2, "Write the piece first. Write the piece no other first.")], "i int, text string")
    found = {r.i: [c.topic for c in r.conflicts] for r in contradictions.detected(rows).collect()}
    assert found == {1: [], 2: ["procedure_order"]}
