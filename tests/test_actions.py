import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant import actions
from foliant.operators import collections, context, gaps, store
from foliant.sources import exports

SCHEMA = "id string, file_path string, title string, description string, category string, version string, tags array<string>, content string, raw_frontmatter string, created_at string, updated_at string, is_favorite boolean"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("a", "team/a.md", "Alpha", "first one here", "x", "1.0", ["t"], "# Goal\nTranslate the text into English.\n```\ncode\n```\n", '{"title": "Alpha"}', "t0", "t1", True),
        ("b", "../b.md", 'B "q"', "", " ", "1.0", [], "hello @ x@y.de", "{}", "t0", "t1", False), ("c", "/c.md", "C", None, None, "1.0", None, None, None, "t0", "t1", False),
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_search_get_and_unknown(docs):
    found = actions.run("prompts.search", docs, query="ALPHA").collect()
    assert [(r.id, r.total) for r in found] == [("a", 1)]
    assert [r.id for r in actions.run("prompts.search", docs, query="", filters=collections.Filters(favorite=True)).collect()] == ["a"]
    assert actions.run("prompts.get", docs, value="b").first().title == 'B "q"'
    for call in (lambda: actions.run("prompts.get", docs, value="zzz"), lambda: actions.run("nothing", docs)):
        with pytest.raises(KeyError):
            call()
    assert len(actions.ACTIONS) == 13


def test_scores_and_rewrites(docs):
    r = {x.id: x for x in actions.score(docs).collect()}
    assert all(x.score == int(0.4 * x.quality_score + 0.2 * x.hygiene_score + 0.4 * x.context_score + 0.5) for x in r.values()) and r["c"].quality_score == r["c"].context_score == 0
    o = {x.id: x for x in actions.optimize(docs, "aggressive").collect()}
    assert o["a"].score_after is not None and o["c"].score_before is None and o["c"].optimized == ""
    b = {x.id: x for x in actions.blueprint_optimize(docs).collect()}
    assert b["c"].score_after == b["c"].score_before
    p = {x.id: x for x in actions.paste_analysis(docs).collect()}
    assert set(p) == {"a", "b"} and p["b"].content_length == 14


def test_exports_and_cache(spark, docs, tmp_path):
    scored = docs.withColumns({"quality_score": F.when(F.col("id") == "a", 90), "hygiene_score": F.lit(None).cast("int")})
    exports.write_json(scored, str(tmp_path / "x.json"), "now")
    whole = json.loads((tmp_path / "x.json").read_text())
    assert whole["export_date"] == "now" and [p["id"] for p in whole["prompts"]] == ["a", "b", "c"] and whole["prompts"][0]["quality_score"] == 90 and "quality_score" not in whole["prompts"][1]
    exports.write_json(scored, str(tmp_path / "w.json"), "now", web=True)
    web = json.loads((tmp_path / "w.json").read_text())["prompts"]
    assert web[1]["category"] == "uncategorized" and web[1]["quality_score"] is None
    exports.write_markdown(scored, str(tmp_path / "x.md"))
    text = (tmp_path / "x.md").read_text()
    assert text.count("\n---\n\n---\n") == 2 and 'title: "B \\"q\\""' in text and "# quality_score: 90" in text and "# hygiene_score: —" in text
    assert exports.write_zip(scored, str(tmp_path / "x.zip")) == 3
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert sorted(z.namelist()) == ["b.md", "c.md", "index.json", "metadata.json", "team/a.md"] and z.read("team/a.md").decode().startswith('---\n{"title"')
        assert json.loads(z.read("index.json")) == {"a": "team/a.md", "b": "b.md", "c": "c.md"} and len(json.loads(z.read("metadata.json"))["prompts"]) == 3
    folder = str(tmp_path / "cache")
    assert not exports.cache_exists(spark, folder) and exports.load_cache(spark, folder, prompts=SCHEMA)["prompts"].count() == 0
    exports.save_cache(folder, prompts=docs)
    assert exports.cache_exists(spark, folder) and exports.load_cache(spark, folder, prompts=SCHEMA)["prompts"].count() == 3
    exports.clear_cache(spark, folder)
    assert not exports.cache_exists(spark, folder)
    assert exports.served(docs, "MD")[1] == 3
    with pytest.raises(ValueError):
        exports.served(docs, "pdf")


def test_loaders_and_paths(spark, tmp_path):
    (tmp_path / "cases.json").write_text('[{"id": "1", "pair": "A1"}, {"id": "2"}]')
    (tmp_path / "pairs.json").write_text('{"pairs": [{"id": "3"}]}')
    (tmp_path / "results.json").write_text('{"split": "dev", "results": [{"id": "1", "overall_score": 5}]}')
    (tmp_path / "old.json").write_text('{"results": []}')
    assert exports.load_cases(spark, str(tmp_path / "cases.json"), "id string, pair string").count() == 2 and exports.load_cases(spark, str(tmp_path / "pairs.json"), "id string").first().id == "3"
    assert tuple(exports.load_results(spark, str(tmp_path / "results.json"), "id string, overall_score int").first()) == ("dev", "1", 5)
    with pytest.raises(ValueError):
        exports.load_results(spark, str(tmp_path / "old.json"), "id string")
    assert exports.fixture_name("../..\\good/a?.md") == "good/a.md" and exports.load_fixture(spark, str(tmp_path), "../cases.json").count() == 1
    (tmp_path / "link").symlink_to(tmp_path)
    assert exports.checked_root(str(tmp_path / "link")) == str(tmp_path.resolve())
    for bad, error in (("a\x00b", ValueError), (str(tmp_path / "none"), ValueError), (str(tmp_path / "cases.json"), ValueError)):
        with pytest.raises(error):
            exports.checked_root(bad)
    with pytest.raises(PermissionError):
        exports.checked_root(str(tmp_path), roots=(str(tmp_path) + "x",))
    df = spark.createDataFrame([("/r/a",), ("/r",), ("/rx",)], "p string")
    assert [r.i for r in df.select(exports.inside(F.col("p"), "/r").alias("i")).collect()] == [True, True, False]
    assert exports.new_file("a/b: c", str(tmp_path)).endswith("/a_b_ c.md")
    with pytest.raises(ValueError):
        exports.new_file("..", str(tmp_path))
    (tmp_path / "vault").mkdir()
    (tmp_path / "vault" / "n.md").write_text("# Ziel\nx")
    r = actions.routes(spark, str(tmp_path / "vault"))
    assert len(r) == 10 and r["/prompts"]().count() == 1 and r["/health"]().first().status == "ok" and r["/export"]("md").count() == 1


def test_store(spark, docs, tmp_path):
    ids = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    assert sorted(r.id for r in store.favourites(store.with_favourite(docs, ids)).collect()) == ["b"] and sorted(r.id for r in store.favourites(store.with_favourite(docs, ids, True)).collect()) == ["a", "b"]
    assert store.cleared(docs).count() == 0
    history = spark.createDataFrame([("a", 1, "t1"), ("a", 2, "t2")], "prompt_id string, overall_score int, evaluated_at string")
    for _ in range(2):
        store.append(history, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    with pytest.raises(ValueError):
        store.pasted(spark, " ")
    assert store.pasted(spark, " x ").first().content == "x"


def test_gaps_and_tiers(spark):
    texts = [("agent", "Workflow: step 1 implement then test, CI pipeline, code review, issue #4, github.com/a/b. Do it."), ("short", "do it"), ("blank", ""), ("secret", "x" * 60), ("rich", "write a report about dogs. " * 3)]
    df = context.evaluated(spark.createDataFrame(texts, "name string, text string"))
    df = df.withColumns({"hygiene_score": F.when(F.col("name") == "rich", 40).otherwise(90), "blueprint_missing": F.when(F.col("name") == "agent", F.array(F.lit("Zielgruppe"), F.lit(" "))), "contamination_status": F.when(F.col("name") == "secret", "BLOCKING_SENSITIVE_CONTENT"), "content_length": F.length("text")})
    r = {x.name: x for x in gaps.classified(gaps.detected(df)).collect()}
    assert r["blank"].gaps == [] and r["secret"].gaps == [] and len(r["short"].gaps) == 3
    agent = r["agent"]
    assert [q.tier for q in agent.questions] == sorted((q.tier for q in agent.questions), key=["REQUIRED", "RECOMMENDED", "OPTIONAL"].index)
    assert sum(q.tier == "REQUIRED" for q in agent.questions) == 5 and agent.overflow.required > 0 and sum(q.tier == "OPTIONAL" for q in agent.questions) <= 10
    assert any(g.question == "Wer ist die Zielgruppe dieses Prompts?" and g.source == "blueprint" for g in agent.gaps) and agent.overflow.recommended > 0
    assert len({g.label.lower() for g in agent.gaps}) == len(agent.gaps) and agent.gaps[0].id == "MISS_PRO_001"
    assert any(g.source == "hygiene" and g.input_type == "boolean" for g in r["rich"].gaps)
