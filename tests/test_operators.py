import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from foliant.operators import collections as C
from foliant.functions.text import plain_rx, strip
from foliant.operators import constraints, metrics, redaction, retrieval, rewrite, router
from foliant.sources import files
from foliant.streaming import watch


def test_router(spark):
    cases = {
        "# Rules\n- Always answer briefly\n- Never guess\n- Use German": ("Guideline", None),
        "Bug report template\n- Title: {title}\n- Body: {body}\n- Steps: {steps}": ("Template", None),
        "Translate the text into English.": ("Task", "Translation"),
        "Verwende aktive Formulierungen, wenn du den Bericht schreibst.": ("Task", None),
        "": ("Task", "GeneralTask"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in router.with_is_guideline(router.routed(df), F.col("text"), "g").collect():
        kind, task = cases[r.text]
        assert r.content_kind == kind and (task is None or r.prompt_type == task) and r.g == (kind == "Guideline")
    lang = df.sparkSession.createDataFrame([("der und die nicht",), ("the you of",), ("xyz",)], "t string").select("t", router.language(F.col("t")).alias("l"))
    assert {r.t: r.l for r in lang.collect()} == {"der und die nicht": "De", "the you of": "En", "xyz": "Mixed"}


def test_collections(spark):
    df = spark.createDataFrame([(1, "a", ["x"], 80, True, "Hello"), (2, "", ["y"], None, False, "World"), (3, "a", ["x", "y"], 41, False, "hello again")], "id int, category string, tags array<string>, overall_score int, is_favorite boolean, content string").withColumn("title", F.lit("T"))
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(C.filtered(df, C.Filters(search="HELLO"))) == [1, 3] and ids(C.filtered(df, C.Filters(tags=["y"], max_score=50))) == [2, 3]
    assert ids(C.filtered(df, C.Filters(favorite=True))) == [1] and ids(C.filtered(df, C.Filters(min_score=1))) == [1, 3]
    assert sorted(map(tuple, C.by_category(df).collect())) == [("a", 2, 61), ("uncategorized", 1, 0)]
    assert tuple(C.corpus_report(df).first()) == (3, 121 / 3)
    tree = {r.path: (r.depth, r.is_dir, r.n_files) for r in C.file_tree(spark.createDataFrame([("/r/a/b.md",), ("/r/a/./c.md",), ("\\r\\d.md",)], "file_path string"), root="/r").collect()}
    assert tree == {"a": (1, True, 2), "a/b.md": (2, False, 1), "a/c.md": (2, False, 1), "d.md": (1, False, 1)}
    old = spark.createDataFrame([("p", "old", "t0", True, "v1"), ("q", "other", "t0", False, "w")], "file_path string, id string, created_at string, is_favorite boolean, content string")
    new = spark.createDataFrame([("p", "new", "t1", False, "v2"), ("r", "third", "t1", False, "z")], old.schema)
    assert sorted(map(tuple, C.upserted(old, new).collect())) == [("p", "old", "t0", True, "v2"), ("q", "other", "t0", False, "w"), ("r", "third", "t1", False, "z")]


def test_retrieval(spark):
    def embed(text):
        from tests.test_text import fnv

        v = [0.0] * 64
        for t in (t for t in text.lower().split() if len(t.encode()) >= 2):
            h = fnv(t.encode())
            v[h % 64] += -1.0 if h < 0 else 1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n if n else 0.0 for x in v]

    df = spark.createDataFrame([(1, "red apples grow"), (2, "blue sky"), (3, "red red sky apple"), (4, ""), (5, "größe größe a ÄÖ ok")], "doc_id bigint, text string")
    for r in retrieval.embedded(df, name="e").collect():
        assert r.e == pytest.approx(embed(r.text), abs=1e-6)
    vectors = retrieval.embedded(df).withColumnRenamed("doc_id", "vec_id")
    assert [r.vec_id for r in retrieval.nearest(vectors, embed("blue sky"), 2).collect()] == [2, 3]
    assert [r.doc_id for r in retrieval.search(df, "red app").collect()] == [3, 1] and retrieval.search(df, " ").count() == 5 and retrieval.search(df, "red zzz").count() == 0
    docs = df.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("t").alias("updated_at"), (F.col("doc_id") == 2).alias("is_sensitive"))
    stored = docs.where("id = 1").select("id", retrieval.content_hash(F.col("content"), F.col("updated_at")).alias("content_hash"))
    assert {r.id: r.todo for r in retrieval.to_reindex(docs, stored).collect()} == {1: "skipped_unchanged", 2: "skipped_sensitive", 3: "indexed", 4: "indexed", 5: "indexed"}


def test_metrics(spark):
    df = spark.createDataFrame([(90, 88), (60, 72), (30, 75), (80, 35)], "score int, gold int")
    r = metrics.agreement(df).first()
    assert (r.mae, r.median_ae, r.exact_band, r.within_one_band, r.false_high, r.false_low) == (26.0, 28.5, 0.25, 0.5, 1.0, 1 / 3) and r.spearman == pytest.approx(0.2)
    assert metrics.agreement(spark.createDataFrame([(5, 1), (5, 2)], "score int, gold int")).first().spearman == 0
    scores = spark.createDataFrame([("a", 80), ("b", 70), ("c", 78)], "id string, score int")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "b", "a"), (4, "a", "x")], "pair_id int, case_a string, case_b string")
    results = metrics.pairwise(pairs, scores)
    assert {r.pair_id: r.result for r in results.collect()} == {1: "PASS", 2: "TIE", 3: "FAIL", 4: "NOT_EVALUATED"}
    assert metrics.pairwise_verdict(results.where("pair_id = 1")).first().verdict == "PASS" and metrics.pairwise_verdict(results.where("pair_id = 2")).first().verdict == "FAIL"
    d = metrics.detection(df, F.col("score") > 50, F.col("gold") > 70).first()
    assert (d.precision, d.recall, d.false_positive_rate) == (2 / 3, 2 / 3, 1.0)


def test_text_rewrites(spark):
    run = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]
    assert run(redaction.strip_secrets, "a ghp_" + "x" * 36 + " b token = 'abc'") == "a [REDACTED] b [REDACTED]"
    assert run(redaction.sanitize_answer, "# H\n<b>x</b> `c` [t](javascript:alert(1)) \x00\n\n\n\ny ") == "H\nx \\`c\\` [t] \n\ny"
    assert run(redaction.redact_path, "C:\\a\\b.md") == ".../b.md" and run(lambda c: redaction.redact_path(c, "/home/u/"), "/home/u/x/y.md") == "vault:/x/y.md"
    assert run(redaction.speakable, "mail a@b.de in /home/x/y  now") == "mail [E-Mail] in [Pfad] now"
    assert run(rewrite.conservative, "a  \n\n\n\n* b\n# H\n```\n* c  \n```") == "a\n\n- b\n\n# H\n```\n* c  \n```\n" and run(rewrite.conservative, " ") == ""
    found = constraints.hard_constraints(spark.createDataFrame([(1, "x\nworks offline, max 200 words")], "doc_id int, text string")).collect()
    assert sorted((r.category, r.constraint_text, r.line, r.column) for r in found) == [("max_length", "max 200 words", 2, 16), ("offline_only", "offline", 2, 7)]


def test_sources(spark, tmp_path):
    (tmp_path / "team").mkdir()
    (tmp_path / "team" / "a.md").write_text("---\ntitle: Ä title\ntags: [x, y]\nversion: 2.0\n---\nBody\n")
    (tmp_path / "b.TXT").write_text("no front matter")
    (tmp_path / "c.md").write_text("---\nkey: [open\n---\nrest")
    (tmp_path / "d.md").write_text("---\njust words\n---\nrest")
    (tmp_path / "e.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "f.html").write_text("x")
    (tmp_path / "g.md").write_text("y" * (files.MOST_BYTES + 1))
    rows = {r.file_name: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.md", "b.TXT", "c.md", "d.md"]
    a = rows["a.md"]
    assert (a.title, a.category, a.tags, a.version, a.content, a.id) == ("Ä title", "team", ["x", "y"], "2", "Body\n", str(uuid.uuid5(uuid.NAMESPACE_URL, a.file_path)))
    assert rows["b.TXT"].title == "b" and rows["c.md"].content.startswith("---") and rows["d.md"].raw_frontmatter == '{"_raw": "just words"}'
    text = "# A\n```py\n# no\n```\n## B\n```\nopen"
    m = spark.createDataFrame([(text,)], "t string").select(files.markdown_structure(F.col("t")).alias("m")).first().m
    assert [(h.level, h.text, h.line) for h in m.headings] == [(1, "A", 1), (2, "B", 5)] and [(c.language, c.start, c.end, c.lines) for c in m.code_blocks] == [("py", 2, 4, 1), ("", 6, 7, 0)] and m.total_lines == 7


def test_change_feeds(spark, tmp_path):
    events = spark.createDataFrame([("a", 0), ("a", 400), ("a", 500), ("a", 900), ("a", 1000), ("b", 10)], "path string, ms bigint").select("path", F.timestamp_millis("ms").alias("ts"))
    want = [("a", 0), ("a", 500), ("a", 1000), ("b", 10)]
    assert sorted(map(tuple, watch.debounced_batch(events, "path", "ts").collect())) == want
    events.write.parquet(str(tmp_path / "in"))
    stream = watch.debounced(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.ms) for r in spark.sql("select key, unix_millis(at) ms from debounced").collect()) == want
    before, after = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert sorted(map(tuple, watch.snapshot_changes(before, after).collect())) == [("b", "modified"), ("c", "removed"), ("d", "added")]


def test_ranks_do_not_depend_on_parts(spark):
    rng = random.Random(3)
    values = [rng.randrange(40) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    want = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}
    for parts in (1, 7, 64):
        assert all(r.r == want[r.v] for r in metrics.average_rank(df, "v", "r", parts).collect())
    assert metrics.average_rank(df.where("false"), "v", "r").count() == 0


def test_debounced_batch_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(5)}", rng.randrange(20_000)) for _ in range(400)] + [(None, 5), (None, 90), ("u1", None)]
    df = spark.createDataFrame(rows, "k string, ms bigint").selectExpr("k", "timestamp_millis(ms) AS t")
    want, last = [], {}
    for k, ms in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        if k not in last or ms - last[k] >= 500:
            want.append((k, ms))
            last[k] = ms
    assert sorted(map(tuple, watch.debounced_batch(df, "k", "t").collect()), key=str) == sorted(want, key=str)


def test_constraints_run_by_gate_and_are_one_expression(spark):
    """Every rule finds the same as its expression alone; the plan has no search for each rule."""
    texts = ["keine \n cloud nutzen; OFFLINE", "Antwort auf Deutſch, language : english", "do not use docker. No  cloud", "nothing", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = constraints.with_constraints(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") < 5
    alone = lambda c, p: F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(plain_rx(p)), F.lit(0)), lambda h: F.struct(F.lit(c), strip(h)))
    alone = df.select("doc_id", F.flatten(F.array(*(alone(c, p) for c, _, ps in constraints.CONSTRAINTS for p in ps))).alias("x"))
    want = {r.doc_id: [tuple(x) for x in r.x] for r in alone.collect()}
    assert {r.doc_id: [(c.category, c.constraint_text) for c in r.constraints] for r in found.collect()} == want and len(want[0]) == 2 and len(want[1]) == 2
