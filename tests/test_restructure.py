import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.operators import restructure as R

TEXT = "intro  \n\n\n# Ziel\n* a\n### Anforderungen\nmach x\n- y\n# Foo\nbar\n```\ncode  \n\n\n* c\n```\n## Goal\nmore\n"


def test_modes():
    tidy = R.rewritten(TEXT, "conservative", R.PROMPT)
    assert tidy["optimized"] == "intro\n\n# Ziel\n- a\n\n### Anforderungen\nmach x\n- y\n\n# Foo\nbar\n```\ncode  \n\n\n* c\n```\n\n## Goal\nmore\n" and tidy["warnings"] == []
    balanced = R.rewritten(TEXT, "balanced", R.PROMPT)
    assert balanced["optimized"] == "intro\n\n## Ziel\n\n- a\n\n\nmore\n\n## Anforderungen\n\n- mach x\n- y\n\n## Foo\n\nbar\n```\ncode  \n\n\n* c\n```\n\n"
    assert len(balanced["warnings"]) == 5 and [c["type"] for c in balanced["changes"]].count("structure") == 5 and {"type": "reorder", "description": R.PROMPT.texts["order"]} in balanced["changes"]
    grown = R.rewritten(TEXT, "aggressive", R.PROMPT)
    assert grown["optimized"].startswith(balanced["optimized"]) and all(h in grown["optimized"] for h, _ in R.PROMPT.scaffolds) and R.PROMPT.texts["scaffold_short"] in grown["warnings"]


def test_blank_unchanged_and_legacy():
    for mode in R.MODES:
        assert R.rewritten(" \n", mode, R.PROMPT) == {"optimized": "", "changes": [], "warnings": [R.PROMPT.texts["empty"]], "contamination_cleaned": False}
        assert R.rewritten(None, mode, R.BLUEPRINT)["optimized"] == ""
    same = "a line that is long enough to be no short text, really\n"
    assert R.rewritten(same, "conservative", R.PROMPT) == {"optimized": same, "changes": [], "warnings": [R.PROMPT.texts["nothing"]], "contamination_cleaned": False}
    old = R.rewritten("## Kontextfenster-Empfehlung\nStarte neu.\n## Ziel\nx\n", "aggressive", R.PROMPT)
    assert "Kontextfenster-Empfehlung" not in old["optimized"] and "Reality Refresh" in old["optimized"] and "## Ziel" in old["optimized"]


def test_blueprints_are_marked():
    r = R.rewritten("# Scope\nuse positron\nTest run from 2024\n", "balanced", R.BLUEPRINT)
    assert "- use ~~CONTAMINATED:Positron~~" in r["optimized"] and "~~STALE_RUN_REPORT:Test run from 2024~~" in r["optimized"] and r["contamination_cleaned"]
    assert not R.checked("x", r["optimized"], R.BLUEPRINT)["contamination_resolved"] and not R.checked("x", r["optimized"], R.BLUEPRINT)["passed"]


@pytest.mark.parametrize(("text", "passed", "hollow"), [("## Ziel\nfertig\n", True, []), ("## Ziel\n\n## Foo\n", False, ["Ziel"]), ("## Ziel\nTBD\n", False, ["Ziel"]), ("## Ziel\n<!-- x -->\n## Kontext\ny", False, ["Ziel"]), ("", True, [])])
def test_checked(text, passed, hollow):
    r = R.checked("", text, R.PROMPT)
    assert (r["passed"], r["empty_sections"], r["structural_improvement_confirmed"]) == (passed, hollow, passed)


def test_columns(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, text string").repartition(2)
    got = {r.id: r for r in df.select("id", R.optimized(F.col("text")).alias("r"), R.validated(F.col("text"), F.col("text")).alias("v")).collect()}
    assert got[1].r.optimized == R.rewritten(TEXT, "balanced", R.PROMPT)["optimized"] and got[2].r.optimized == got[3].r.optimized == "" and got[1].v.passed
    with pytest.raises(ValueError):
        R.optimized(F.col("text"), "wild")
    blocks = df.select("id", R.blocks(F.array(F.lit("Zieldefinition fehlt"), F.lit("anders"))).alias("b"), "text").select("id", "b", R.preview(F.coalesce("text", F.lit("")), F.col("b")).alias("p")).where("id = 3").first()
    assert [b.heading for b in blocks.b] == ["## Ziel", "## Ergänzung 2"] and blocks.p.startswith("## Ziel\n\n<!-- Empfehlung: Zieldefinition fehlt -->")


def test_batches_are_rewritten_slice_by_slice(spark):
    """Rows of a batch become Arrow a slice at a time, whatever the batch has; order, nulls and empty batches stay."""
    texts = pa.array(["x" * (R.SLICE // 4), None, "y", "z" * (3 * R.SLICE)] * 5 + ["", None])
    parts = [p for (p,) in R.slices(texts)]
    assert pa.concat_arrays(parts).equals(texts) and len(parts) > 5
    assert all(len(p) == 1 or sum(len(x or "") for x in p.to_pylist()[:-1]) < R.SLICE for p in parts)
    assert list(R.slices(texts.slice(0, 0))) == []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "i int, t string").coalesce(1)
    got = {r.i: r.o for r in rows.select("i", R.optimized(F.col("t"), "balanced")["optimized"].alias("o")).collect()}
    assert got == {i: R.rewritten(t, "balanced", R.PROMPT)["optimized"] for i, t in enumerate(texts.to_pylist())}
