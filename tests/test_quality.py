import pytest
from pyspark.sql import functions as F

from foliant.operators import quality

TERSE = "Translate the following text into German. Return only the translation as text.\n\n{{text}}"
CASES = {
    "terse": TERSE,
    "heading": "# Task\n" + TERSE,
    "bare": "Write an email.",
    "stuffed": "You are an expert developer. " * 8,
    "vague": "Make it nice, thanks.",
    "rules": "# Rules\n- Always answer in German\n- Never reveal names\n- Use short sentences",
    "slots": "{a} {b} {c} {d} {e} {f}",
    "role": "You are an experienced software developer for databases.\n" + TERSE,
    "blank": " \n ",
    "null": None,
    "long": "word " * 40_000,
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(CASES.items()), "name string, text string").coalesce(1).withColumn("features", F.lit(1))
    return {r.name: r for r in quality.evaluated(df).collect()}


def test_levels(found):
    score = {k: r.overall_score for k, r in found.items()}
    assert score["terse"] >= 85 and score["stuffed"] < 45 and score["vague"] < 55 and score["bare"] < 60 and score["rules"] >= 70 and score["slots"] < 45
    assert abs(score["heading"] - score["terse"]) <= 5 and abs(score["role"] - score["terse"]) <= 8
    assert score["blank"] == score["null"] == 0


def test_criteria(found):
    blank, terse, rules = found["blank"], found["terse"], found["rules"]
    assert len(blank.missing_sections) == 10 and all(c.score == 0 for c in blank.criteria)
    assert [c.name for c in terse.criteria] == [quality.ROLE, *quality.TASK_CRITERIA] and sum(c.weight for c in terse.criteria) == pytest.approx(1)
    assert [c.name for c in rules.criteria] == list(quality.GUIDELINE_CRITERIA) and rules.content_kind == "Guideline"
    assert next(c for c in found["role"].criteria if c.name == quality.ROLE).score == 10
    assert terse.features.referenced_fraction == 1 and found["slots"].features.placeholder_count == 6


def test_contradictions_lower_scores(spark):
    more = {"none": "", "light": " Keep it long with at most 9 words. Keep it long with at least 99 words.", "heavy": " Write it in English."}
    df = spark.createDataFrame([(k, TERSE + v) for k, v in more.items()], "name string, text string").coalesce(1)
    got = {r.name: (r.conflict_weight, r.overall_score) for r in quality.evaluated(df).collect()}
    assert [got[k][0] for k in more] == [0, 3, 6]
    assert got["none"][1] - got["light"][1] >= 3 and got["heavy"][1] <= 45


def test_empty_table(spark):
    assert quality.evaluated(spark.createDataFrame([], "text string")).count() == 0
