import os
import random

import corpus_pipeline


def test_stages_and_whole_run(spark, prose, tmp_path):
    rng = random.Random(1)
    rows, toxic = [], {}
    for i in range(260):
        w = prose(rng.randrange(30, 90), i).split()
        toxic[i] = int(i % 4 == 0)
        for _ in range(3 * toxic[i]):
            w.insert(rng.randrange(len(w)), rng.choice(["grobian", "fiesling"]))
        rows.append((i, " ".join(w)))
    clean = [i for i in toxic if not toxic[i]]
    near = rows[clean[0]][1].split()
    near[5] = "changed"
    passage = prose(15, 9999)
    rows += [(1000, rows[clean[1]][1].replace(" ", "  ")), (1001, rows[clean[0]][1] + " " + " ".join(["tail"])), (1002, prose(40, 77) + " " + passage), (1003, None), (1004, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id bigint, toxic int").selectExpr("doc_id", "1 AS quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        path = os.path.join(tmp_path, "out", name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        left[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everyone = {r[0] for r in rows}
    gone = everyone - left["toxicity"]
    assert {i for i in toxic if toxic[i]} <= gone and len(gone - {i for i in toxic if toxic[i]}) <= 3
    assert left["toxicity"] - left["exact_dedup"] == {1000, 1004} & left["toxicity"]
    assert left["exact_dedup"] - left["near_dedup"] == {1001} & left["exact_dedup"]
    assert left["near_dedup"] - left["decontamination"] == {1002} & left["near_dedup"]
    assert left["packing"] == left["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left["packing"]


def test_decisions_are_by_row(spark, prose, tmp_path):
    """Null and repeated ids, repeated rows, extra columns and empty tables."""
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    near = a.split()
    near[5] = "changed"
    passage = prose(20, 5)
    rows = [(7, a), (7, b), (3, a), (7, a), (7, a), (None, b), (None, c), (None, None), (None, ""), (9, " ".join(near)), (9, c + " x"), (4, None), (12, b + " " + passage), (12, prose(50, 8))]
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame(rows, schema).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars", "1 AS _size", "2 AS id", "3 AS keep_id", "4 AS class_id", "5 AS contaminated").repartition(3)
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = lambda stage, d: sorted(((r.doc_id, r.text) for r in stage(spark, d, str(tmp_path)).select("doc_id", "text").collect()), key=str)
    exact = left(corpus_pipeline.drop_copies, docs)
    blank = [r for r in exact if not r[1]]
    assert blank == [(4, None)]
    assert [r for r in exact if r[1]] == sorted([(3, a), (7, b), (None, c), (9, " ".join(near)), (9, c + " x"), (12, b + " " + passage), (12, prose(50, 8))], key=str)
    kept = left(corpus_pipeline.drop_near_copies, docs)
    assert kept == sorted([(3, a), (7, b), (4, None), (9, c + " x"), (12, b + " " + passage), (12, prose(50, 8))], key=str)
    clean = left(corpus_pipeline.drop_contaminated, docs)
    assert len(clean) == len(rows) - 1 and (12, b + " " + passage) not in clean
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
