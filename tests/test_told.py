"""What the walk of the gates tells of a text is what Java's expressions and column functions say of it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import gates, text
from foliant.operators import contradictions, features
from foliant.operators import lexicons as lex

EXPRESSIONS = {n: getattr(features, n) for n in ("ACTION", "DELIVERABLE", "INPUT_ANCHOR", "MODERATE_OUTPUT", "STRUCTURE", "SEQUENCE", "NEEDED_FACT", "CONSTRAINT", "OUTSIDE", "ARTIFACT", "BOUNDARY")}


def texts_around(pattern, n=150):
    rng = random.Random(7)
    parts = [w for w in re.findall(r"\w+|[^\w\s]", re.sub(r"\\[a-zA-Z]|\(\?[a-zA-Z:=!<]*", " ", pattern)) if w] + [" ", "\n", "3", "ü", "\u0301", "_", "x", "\u00a0"]
    for _ in range(n):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "  ", "\t"]) for _ in range(rng.randrange(1, 7)))
        yield rng.choice([t, t.upper(), t.title(), t.replace("s", "ſ").replace("i", "İ").replace("k", "K").replace("ß", "ẞ")])


@pytest.mark.parametrize("name", sorted(EXPRESSIONS))
def test_expressions(spark, name):
    """The walk never says more than Java, and what passes its gate is all that Java finds; also for the two parts of an expression."""
    p = EXPRESSIONS[name]
    own = gates.Gates(*dict.fromkeys([p, *gates.parted(p)]), ascii_blanks=False)
    match = lambda x: F.col("t").rlike("(?U)" + x)
    df = spark.createDataFrame([(t,) for t in texts_around(p)], "t string").withColumn("w", own.told(F.col("t")))
    sure = own.holds(F.col("w"), p, F.lit(False))
    both = own.holds(F.col("w"), p, match(p))
    parts = F.greatest(*(own.holds(F.col("w"), x, match(x)) for x in gates.parted(p)), F.lit(False))
    assert df.where((sure & ~match(p)) | (both != match(p)) | (parts != match(p))).collect() == []
    assert df.where(sure).count() > 0


def test_words(spark):
    """Of texts with letters that the walk takes for others, it doesn't say that words are there."""
    own = gates.Gates(lex.ARTIFACT_NOUNS, features.NEGATORS, ascii_blanks=False)
    for words in (lex.ARTIFACT_NOUNS, features.NEGATORS):
        df = spark.createDataFrame([(t,) for t in [*texts_around("|".join(words)), "do not", "do  not", "do\nnot", "liſt"]], "t string").withColumn("w", own.told(F.col("t")))
        assert df.where(own.holds(F.col("w"), words, features.any_of(F.col("t"), words), gates.plain(F.col("t"))) != features.any_of(F.col("t"), words)).collect() == []


def test_forms():
    assert gates.forms(r"(?i)\b(?:List\w*|use)\b", False) == ([("list", True, False), ("use", True, True)], True)
    assert gates.forms(r"(?i)(?:items?|a\s+b)", False) == ([("items", False, False), ("item", False, False)], False)
    assert gates.forms(r"(?i)\b(?:übung)\b", True) == ([], False) and gates.forms("(a)b(?:c)", False) == ([], False)
    assert gates.parted(r"(?i)(?:a|b\d|c)") == ["(?i)(?:a|c)", r"(?i)(?:b\d)"]


def test_strip_and_four_letters(spark):
    blanks = [c for c in map(chr, range(0xD800)) if c.isspace() or c in "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"]
    rows = [(b + "a" + b + "b" + b,) for b in blanks] + [(x,) for x in ("", " ", " \n\t", " a", "1234", "a1b2", "12a 3", "x-y-z-1", "١٢٣٤", "ab cd ef", "12.34x", "12.34")]
    df = spark.createDataFrame(rows, "t string")
    assert df.where(text.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")).collect() == []
    lines = F.split("t", "\n", -1)
    assert df.where(text.stripped(F.col("t"), lines) != F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))).collect() == []
    bare = lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    old = F.exists(F.split(text.strip(F.col("t")), r"(?U)\s+", -1), lambda t: (F.length(bare(t)) >= 4) & ~bare(t).rlike("^[0-9]+$"))
    assert df.where(features.four_letters(F.col("t")) != old).collect() == []


def test_only_sentences_with_a_word_of_mandates_pass(spark):
    rows = spark.createDataFrame([(["Use it", "the fuse", "no", "know", "üno", "KEEP", "a\u00a0must", ""],)], "a array<string>")
    assert rows.select(contradictions.GATES.passed_each(F.col("a"))).first()[0] == [[x] for x in (True, False, True, False, True, True, True, False)]


def test_a_gate_is_a_step_of_its_own(spark):
    """What reads a gate is not moved to it, where it would stand once for each mention."""
    df = contradictions.detected(spark.createDataFrame([("Use it.",)], "text string")).withColumn("twice", F.col("conflict_weight") + F.col("conflict_weight"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("single format expected") == 1
