import random
import statistics

import pytest
from pyspark.sql import functions as F

from foliant import dispatch
from foliant.operators import distribution, retrieval, search_index, vector_store
from foliant.streaming import fingerprints, watch


def documents(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, content string")


def test_index_with_updates_equals_search_of_texts(spark, tmp_path):
    rng = random.Random(1)
    words = ["red", "reddish", "apple", "app", "blue", "übung", "x1"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    now = {f"d{i}": (f"title {i % 3}", make(rng.randrange(0, 12))) for i in range(60)}
    path, fields = str(tmp_path / "index"), ("title", "content")
    frame = lambda d: documents(spark, [(k, *v) for k, v in d.items()])
    search_index.create(frame(now), path, "id", fields)

    def compare():
        for query in ("red app", "title 1 ü"):
            want = retrieval.search(frame(now), query, "id", fields).withColumn("rank", F.round("rank", 9)).collect()
            got = search_index.search(spark, path, query).withColumn("rank", F.round("rank", 9)).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want)), query
        assert search_index.search(spark, path, "  ").count() == len(now)

    compare()
    for step in range(2):
        changed = {f"d{i}": ("new title", make(6)) for i in range(step, 70, 9)}
        gone = [f"d{i}" for i in range(5 + step, 60, 11) if f"d{i}" not in changed]
        assert search_index.update(frame(changed), spark.createDataFrame([(g,) for g in gone] + [("never was",)], "id string"), path, "id", fields) == step + 1
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        compare()
    search_index.compact(spark, path, str(tmp_path / "compact"))
    path = str(tmp_path / "compact")
    compare()
    plan = search_index.candidates(spark, path, ["red"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,red)" in plan and "PartitionFilters" in plan and "head" in plan.split("PartitionFilters")[1].split("]")[0]


def test_a_half_written_update_is_no_update(spark, tmp_path):
    path = str(tmp_path / "index")
    search_index.create(documents(spark, [("a", "", "red"), ("b", "", "red red")]), path, "id", ("content",))
    search_index._add(documents(spark, [("c", "", "red")]), path, "id", ("content",), 1)
    assert sorted(r.key for r in search_index.search(spark, path, "red").collect()) == ["a", "b"]
    search_index.update(documents(spark, [("a", "", "blue")]), documents(spark, []), path, "id", ("content",))
    assert [r.key for r in search_index.search(spark, path, "red").collect()] == ["b"] and [r.key for r in search_index.search(spark, path, "b").collect()] == ["a"]


def test_vectors_are_kept_replaced_and_found(spark, tmp_path):
    path = str(tmp_path / "vectors")
    schema = "id string, content string, updated_at string, is_sensitive boolean, title string, category string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    docs = make(("a", "red apple pie", "1", False, "A", "c"), ("b", "blue sky", "1", False, "B", "c"), ("s", "secret words", "1", True, "S", "c"), ("n", None, "1", False, "N", "c"), ("e", "", "1", False, "E", "c"), ("a", "old text", "0", False, "A", "c"))
    report = lambda r: (r.indexed, r.skipped_sensitive, r.skipped_unchanged, r.failed)
    assert vector_store.vectors(spark, path).count() == 0
    assert report(vector_store.reindex(docs, path)) == (3, 1, 0, 1) and report(vector_store.reindex(docs, path)) == (0, 1, 3, 1)
    found = vector_store.semantic_search(spark, "Apple red", path, docs.dropDuplicates(["id"]), 2).collect()
    assert found[0].id == "a" and found[0].score > 0.7 and "content" not in found[0].asDict()
    assert vector_store.semantic_search(spark, " \n", path, docs).count() == 0
    assert report(vector_store.reindex(make(("b", "green grass", "2", False, "B", "c")), path)) == (1, 0, 0, 0)
    assert report(vector_store.reindex(make(("b", "green grass", "2", False, "B", "c")), path, "other")) == (1, 0, 0, 0)
    assert {(r.id, r.model) for r in vector_store.vectors(spark, path).collect()} == {("a", vector_store.MODEL), ("b", vector_store.MODEL), ("e", vector_store.MODEL), ("b", "other")}
    assert vector_store.semantic_search(spark, "grass", path, docs.dropDuplicates(["id"]), 1).first().id == "b"
    vector_store.removed(spark, spark.createDataFrame([("b",), ("zz",)], "id string"), path)
    assert {r.id for r in vector_store.vectors(spark, path).collect()} == {"a", "e"}


def test_percentiles_equal_sorted_values(spark):
    rng = random.Random(2)
    cases = [[rng.gauss(0, 1) for _ in range(999)], [5.0] * 7, [1.0, 2.0], [3.0], [1e-300, 1e300, 0.0, -1e300, 2.5], [float(rng.randrange(4)) for _ in range(200)], [10.0**k for k in range(-20, 20)]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
        s = sorted(values)
        want = [s[int(p * (len(s) - 1))] + (s[min(int(p * (len(s) - 1)) + 1, len(s) - 1)] - s[int(p * (len(s) - 1))]) * (p * (len(s) - 1) % 1) for p in (0, 0.1, 0.5, 0.77, 1)]
        assert distribution.percentiles(df, "v", [0, 0.1, 0.5, 0.77, 1]) == pytest.approx(want, rel=1e-12)
        assert distribution.summary(df.where("not isnan(v)"), "v").first().median == pytest.approx(statistics.median(values))
    assert distribution.percentiles(df.where("false"), "v", [0.5]) == [None]


def test_folders_bands_and_slowest(spark):
    df = spark.createDataFrame([("a/b/x.md", 90, 3.0), ("a\\y.md", 50, 9.0), ("z.md", None, 9.0), ("./a/b/c/w.md", 10, None)], "path string, score int, ms double")
    assert {r.folder: (r.n_docs, r["mean"]) for r in distribution.folder_means(df, "path", "score").collect()} == {"": (4, 50.0), "a": (3, 50.0), "a/b": (2, 50.0), "a/b/c": (1, 10.0)}
    assert {r.band: (r.n_docs, round(r.share, 3)) for r in distribution.bands(df, "score").collect()} == {"EXCELLENT": (1, 0.333), "POOR": (1, 0.333), "BROKEN": (1, 0.333)}
    assert [r.path for r in distribution.slowest(df, "ms", "path", 2).collect()] == ["a\\y.md", "z.md"]


def brute_debounce(events, quiet):
    out = []
    for key in {k for k, _ in events}:
        last = None
        for t in sorted(t for k, t in events if k == key):
            if last is None or t - last >= quiet:
                out.append((key, t))
                last = t
    return sorted(out, key=str)


def test_debouncing_by_runs_equals_one_pass(spark):
    rng = random.Random(3)
    events = [(rng.choice(["a", "b", None]), t) for t in (rng.randrange(-20_000, 200_000) for _ in range(3000))] + [("c", 7), ("c", 7), ("d", 499), ("d", 999), ("d", 1498)]
    for quiet in (500, 7, 100_000):
        df = spark.createDataFrame(events, "key string, ms bigint").select("key", F.timestamp_millis("ms").alias("ts"))
        assert sorted((tuple(r) for r in watch.debounced_batch(df, "key", "ts", quiet).collect()), key=str) == brute_debounce(events, quiet)


def test_a_hot_key_is_many_groups(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("key"), (F.col("id") * 3 + F.col("id").cast("int") % 100 * 0 + (F.col("id") / 50).cast("bigint") * 5000).alias("at_ms"))
    parts = watch.quiet_groups(df, 500)
    sizes = parts.groupBy("part").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert sizes.n == 4000 and sizes.most == 50 and parts.count() == 200_000


def test_remembered_fingerprints(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        steps = [[("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")], [("c", "1"), ("d", "1")], [("a", "1"), ("d", "1")], [("b", "2")]]
        seen, memory, want, tick = tmp_path / "in", {}, [], 0
        seen.mkdir()
        schema = "id string, fingerprint string, at timestamp"

        def run(most):
            stream = spark.readStream.schema(schema).parquet(str(seen))
            fingerprints.changed(stream, most=most, shards=1).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).format("parquet").option("path", str(tmp_path / "out")).trigger(once=True).start().awaitTermination(120)
            return spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()

        for i, rows in enumerate(steps):
            spark.createDataFrame([(*r, i * 10 + j) for j, r in enumerate(rows)], "id string, fingerprint string, s int").select("id", "fingerprint", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(str(seen))
            got = sorted((r.id, r.fingerprint, int(r.at.timestamp())) for r in run(3))
            for j, (k, f) in enumerate(rows):
                if memory.get(k, (None,))[0] != f:
                    want.append((k, f, i * 10 + j))
                tick += 1
                memory[k] = (f, tick)
                if len(memory) > 3:
                    del memory[min(memory, key=lambda x: memory[x][1])]
            assert got == sorted(want)
        assert len(memory) == 3 and ("a", "1", 30) in want  # a was forgotten, and processed again
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_dispatch_checks_gates_and_logs(spark, tmp_path):
    docs = documents(spark, [("a", "Alpha", "red apple"), ("b", "Beta", "blue")]).selectExpr("*", "id AS file_path", "'c' AS category", "cast(array() AS array<string>) AS tags", "'' AS description", "50 AS overall_score")
    log = str(tmp_path / "log")
    assert dispatch.evidence(spark, log).count() == 0
    off = dispatch.Dispatcher(spark, log)
    on = dispatch.Dispatcher(spark, log, developer=True)
    assert not off("prompts.search", docs, query="red").success
    assert not on("no.such", docs).success
    found = on("prompts.search", docs, query="RED")
    assert found.success and [r.id for r in found.data.collect()] == ["a"]
    assert "query: required non-empty string; limit: optional number 1-1000" in on("prompts.search", docs, query=" ", limit=0).error
    assert "columns content required" in on("prompts.score", docs.drop("content")).error
    assert "mode: must be" in on("prompts.optimize", docs, mode="wild").error
    assert on("qa.load_fixture", folder=str(tmp_path), name="../x").error.endswith("(must be simple filename)")
    assert on("prompts.get", docs, value="zz").error and on("prompts.get", docs, value="b").success
    assert "approval" in on("prompts.create", title="T", folder=str(tmp_path)).error
    asked = []
    writer = dispatch.Dispatcher(spark, log, True, lambda name, risk: asked.append((name, risk)) or len(asked) > 1, keep=2)
    assert "denied" in writer("prompts.create", title="T", folder=str(tmp_path)).error
    call = writer("prompts.create", title="T", folder=str(tmp_path))
    assert asked == [("prompts.create", "medium")] * 2 and call.data == str(tmp_path.resolve() / "T.md")
    writer.flush()
    rows = dispatch.evidence(spark, log).orderBy("at").collect()
    assert [(r.action, r.result) for r in rows] == [("prompts.search", "blocked"), ("(unknown)", "error"), ("prompts.search", "success"), ("prompts.search", "error"), ("prompts.score", "error"), ("prompts.optimize", "error"), ("qa.load_fixture", "error"), ("prompts.get", "error"), ("prompts.get", "success"), ("prompts.create", "blocked"), ("prompts.create", "denied"), ("prompts.create", "approved"), ("prompts.create", "success")]
    assert len({r.evidence_id for r in rows}) == len(rows) and found.evidence in {r.evidence_id for r in rows}
    assert rows[2].input_hash == dispatch.input_hash({"query": "RED"}) and dispatch.of_action(dispatch.evidence(spark, log), "prompts.get").count() == 2
