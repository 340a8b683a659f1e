import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import gates
from foliant.operators import blueprints, context, features, hygiene, router
from foliant.plans import prompts

PATTERNS = {
    **{f"features.{n}": v for n, v in vars(features).items() if n.isupper() and isinstance(v, str)},
    **{f"router.{n}": v for n, v in {**vars(router), **router.TASKS}.items() if isinstance(v, str) and n[:1].isupper()},
    **{f"hygiene.{p.category}.{i}": p.pattern for i, p in enumerate([*hygiene.BEFORE_JSON, hygiene.EMAILS, *hygiene.AFTER_PHONE, *hygiene.EVIDENCE_BLOCKS])},
}


@pytest.mark.parametrize(("pattern", "words"), [
    (r"(?i)\b(?:schreib\w*|use)\b", ("schreib", "use")), (r"a(?:bc|d)e", ("a",)), (r"(?:foo|foobar)x?", ("foo",)), (r"\d+", None), (r"x*", None), (r"(?:ab)+c", ("ab",)), (r"[ab]cd", ("cd",)), (r"(?<!x)yes(?!no)", ("yes",)),
    (r"(?:a|)b?", None), (r"\{\w+\}", ("{",)), (r"(?m)^Caused\s+by:", ("caused",)), (r"(?i)(?:test|prüf)(?:s|er)?", ("prüf", "test")), (r"\x41b", ("b",)), (r"(?:ab{0,2}c)", ("a",)),
])
def test_words(pattern, words):
    assert gates.literals(pattern) == words


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_every_match_has_one_of_the_words(spark, name):
    """Texts made at random around the expression's own words; Java finds the matches."""
    words = gates.literals(PATTERNS[name])
    if words is None:
        return
    rng = random.Random(3)
    parts = re.findall(r"\w+|[^\w\s]", re.sub(r"\\[a-zA-Z]|\(\?[a-zA-Z:=!<]*", " ", PATTERNS[name])) + [" ", "\n", "1", "12", ": ", "#", "- ", "x", "/", "@", "."]
    texts = []
    for _ in range(150):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 9)))
        texts.append(rng.choice([t, t.upper(), t.title(), t.replace("s", "ſ").replace("i", "İ").replace("k", "K")]))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = df.where(F.col("t").rlike("(?U)" + PATTERNS[name]) & ~gates.may_match(gates.folded(F.col("t")), PATTERNS[name])).collect()
    assert wrong == []


def test_most_expressions_have_words():
    known = [n for n, p in PATTERNS.items() if gates.literals(p)]
    assert len(known) > 0.75 * len(PATTERNS)
    assert context is not None


def test_needs_hold_where_expressions_match(spark):
    """What a gate asks for stands in each match, whatever its white space and letters; texts without it don't pass."""
    rng = random.Random(5)
    texts = ["Only\n\n modify it", "only \t CHANGE", "only", "modify only", "Nur Ändern", "nur lesen", "ſcope :", "", " \n", "BUG #  12", "kein refactoring. CI\npipeline", "STAND :2024-01-02", "ü" * 9 + "\n\nnicht\nanfassen"] + list(prompts.PROMPTS)
    tables = [(context.GATES, {**context.TYPE_SIGNALS, **context.SIGNALS, **context.VAGUE, **context.COUNTS}), (blueprints.GATES, {**blueprints.SIGNALS, **blueprints.COUNTS, **{f"{k}{i}": p for k, (_, ps) in blueprints.TYPES.items() for i, p in enumerate(ps)}})]
    for p in [p for _, table in tables for p in table.values()]:
        parts = re.findall(r"\w+|[^\w\s]", re.sub(r"\\[a-zA-Z]|\(\?[a-zA-Z:=!<]*", " ", p)) + [" ", "\n", "12", ": ", "#", "x"]
        for _ in range(8):
            t = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n ", "\t"]) for _ in range(rng.randrange(1, 9)))
            texts.append(rng.choice([t, t.upper(), t.title(), t.replace("s", "ſ").replace("i", "İ").replace("k", "K")]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    for own, table in tables:
        of = lambda p: (own.may(F.col("p"), p), F.col("text").rlike(context.matching(p)))  # noqa: B023, E731
        wrong = F.array_compact(F.array(*(F.when(of(p)[1] & ~of(p)[0], n) for n, p in table.items())))
        assert df.withColumn("p", own.passed(gates.folded(F.col("text")))).select("text", wrong.alias("w")).where(F.size("w") > 0).collect() == []
    few = df.where("i < 6").withColumn("p", context.GATES.passed(gates.folded(F.col("text")))).select("i", context.GATES.may(F.col("p"), context.SIGNALS["tools"])).collect()
    assert [m for _, m in sorted(few)] == [True, True, False, False, True, True]


def test_words_are_found_within_rows_only():
    import pyarrow as pa

    from foliant.functions.word_search import Words, slices

    words = Words(["ab", "abc d", "#", "über", "c"])
    found = [words.found(data, offsets).tolist() for data, offsets in slices(pa.array(["xab", "c  \n d", "abc\t\td#", None, "", "ÜBER über", "a", "b"]))]
    one = lambda *yes: [i in yes for i in range(5)]
    assert found == [[one(0), one(4), one(0, 1, 2, 4), one(), one(), one(3), one(), one()]]


def test_sentences_are_gated_one_by_one(spark):
    """As documents are; with white space that is not ASCII where an expression means Unicode."""
    found = gates.Gates(r"(?i)#\s*goal", ("no", "never"), ascii_blanks=False)
    rows = spark.createDataFrame([(0, ["#\u00a0GOAL", "nothing", ""]), (1, []), (2, None), (3, ["goal", "#goal never"])], "i int, a array<string>")
    got = rows.select("i", found.passed_each(F.transform("a", gates.folded)).alias("p")).collect()
    assert {r.i: r.p for r in got} == {0: [[True, False], [False, True], [False, False]], 1: [], 2: [], 3: [[True, False], [True, True]]}
