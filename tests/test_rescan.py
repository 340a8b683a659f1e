import os

import pytest
from pyspark.sql import functions as F

from foliant.sources import files
from foliant.streaming import rescan, watch


def make(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return path


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_folder_scan_and_its_log(spark, tmp_path, parts):
    root, outside = tmp_path / "root", tmp_path / "outside"
    make(root, "a.md", "A")
    make(root, "sub/b.TXT", "B")
    make(root, "sub/deep/er/c.markdown", "C")
    make(root, "sub/d.pdf", "no")
    make(root, "big.md", "x" * 2000)
    make(root, "broken.txt", b"\xff\xfe")
    make(outside, "secret.md", "S")
    (root / "link.md").symlink_to(root / "a.md")
    (root / "out").symlink_to(outside)
    (root / "gone.md").symlink_to(root / "nothing")
    (root / "sub/loop").symlink_to(root / "sub")
    before = root / "a.md"
    for i in range(7):
        (root / f"chain{i}.md").symlink_to(before)
        before = root / f"chain{i}.md"
    spark.dataSource.register(files.FolderSource)
    rows = spark.read.format("document_folder").option("path", str(root)).option("most_bytes", 1000).option("depth", 3).option("parts", parts).load().collect()
    found = sorted((os.path.relpath(r.file_path, root), r.reason) for r in rows)
    assert found == sorted([("a.md", None), ("sub/b.TXT", None), ("a.md", None), *[("a.md", None)] * 5, ("big.md", "too_large"), ("broken.txt", "not_text"), ("gone.md", "broken_link"), ("out", "outside"), ("chain5.md", "link_depth"), ("chain6.md", "link_depth"), ("sub/loop", "link_loop"), ("sub/deep/er", "too_deep")])
    docs = files.scan(spark, str(root)).select("file_name", "content").distinct().collect()
    assert {tuple(r) for r in docs} == {("a.md", "A"), ("b.TXT", "B"), ("c.markdown", "C"), ("big.md", "x" * 2000)}
    log = {(os.path.relpath(r.file_path, root), r.reason) for r in files.scan_log(spark, str(root)).collect()}
    assert ("gone.md", "broken_link") in log and ("broken.txt", "not_text") in log and not any(reason == "too_large" for _, reason in log)


def test_depth_of_fifty(spark, tmp_path):
    deep = "/".join(["d"] * 49)
    make(tmp_path, f"{deep}/in.md", "in")
    make(tmp_path, f"{deep}/d/below.md", "below")
    assert [r.file_name for r in files.scan(spark, str(tmp_path)).collect()] == ["in.md"]
    assert [r.reason for r in files.scan_log(spark, str(tmp_path)).collect()] == ["too_deep"]


def test_unreadable_files_and_refused_roots(spark, tmp_path, monkeypatch):
    from foliant.sources.folder import FolderReader

    make(tmp_path, "x.md", "x")
    reader = FolderReader({"path": str(tmp_path)})
    monkeypatch.setattr("builtins.open", lambda *_, **__: (_ for _ in ()).throw(PermissionError(13, "Permission denied")))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.undo()
    assert rows == [(str(tmp_path / "x.md"), None, None, None, "unreadable: Permission denied")]
    with pytest.raises(PermissionError):
        files.scan(spark, str(tmp_path), roots=(str(tmp_path / "other"),))
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path / "missing"))


def test_other_file_systems(spark, tmp_path):
    make(tmp_path, "a.md", "A")
    make(tmp_path, "one/two/b.md", "B")
    make(tmp_path, "c.md", b"\xff")
    assert [r.file_name for r in files.scan(spark, f"file://{tmp_path}", depth=2).collect()] == ["a.md"]
    assert {(r.file_path.rsplit("/", 1)[1], r.reason) for r in files.scan_log(spark, f"file://{tmp_path}", depth=2).collect()} == {("b.md", "too_deep"), ("c.md", "not_text")}


def strict(docs):
    """Fails on documents that say so, when it runs."""
    return docs.select("path", F.when(F.contains("content", F.lit("poison")), F.raise_error(F.concat(F.lit("bad "), "path")).cast("int")).otherwise(F.length("content")).alias("size"))


def test_stream_isolates_what_fails_and_repeats_change_nothing(spark, tmp_path):
    folder, store, dead, checkpoint = (str(tmp_path / n) for n in ("in", "store", "dead", "checkpoint"))
    for i in range(12):
        make(tmp_path / "in", f"{i}.md", "x" * (i + 1))
    make(tmp_path / "in", "p.md", "poison")
    make(tmp_path / "in", "blank.md", " \n")
    make(tmp_path / "in", "bytes.md", b"\xff\xff")
    make(tmp_path / "in", "big.md", "y" * 300)
    run = lambda: rescan.start(watch.files(spark, folder).select("path", "content"), strict, store, dead, checkpoint, most_bytes=200).awaitTermination(120)
    assert run()
    name = lambda p: p.rsplit("/", 1)[1]
    results = lambda: {name(r.path): r["size"] for r in rescan.stored(spark, store).collect()}
    letters = lambda: {name(r.path): (r.reason, r.batch_id) for r in rescan.dead_letters(spark, dead).collect()}
    assert results() == {f"{i}.md": i + 1 for i in range(12)}
    assert letters() == {"p.md": ("failed", 0), "blank.md": ("blank", 0), "bytes.md": ("not_text", 0), "big.md": ("too_large", 0)}
    assert "bad " in rescan.dead_letters(spark, dead).where("reason = 'failed'").first().detail
    batch = spark.read.format("binaryFile").load(f"{folder}/*.md").select("path", "content")
    rescan.batch_writer(strict, store, dead, 200)(batch, 0)
    assert len(results()) == 12 and len(letters()) == 4 and spark.read.parquet(store).count() == 12
    make(tmp_path / "in", "new.md", "zz")
    make(tmp_path / "in", "q.md", "poison again")
    assert run()
    assert results()["new.md"] == 2 and letters()["q.md"] == ("failed", 1) and len(results()) == 13


def test_few_failures_cost_few_passes(spark):
    """What one document that fails makes others cost doesn't grow with the attempts that find it."""
    read, n = spark.sparkContext.accumulator(0), 4000

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(0, n, 1, 4).select(F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id").isin(7, 3001), "poison").otherwise("x").alias("content"))
    done, failed = rescan.isolated(rows.mapInArrow(counted, rows.schema), strict)
    assert sorted(p for p, _ in failed) == ["p3001", "p7"] and all("bad " in m for _, m in failed)
    kept = [r.path for df in done for r in df.collect()]
    assert len(kept) == len(set(kept)) == n - 2
    assert read.value <= 4 * n


def test_errors_of_the_plan_are_raised(spark, tmp_path):
    batch = spark.createDataFrame([("a", b"x")], "path string, content binary")
    with pytest.raises(Exception, match="no_such_column"):
        rescan.batch_writer(lambda d: d.select("no_such_column"), str(tmp_path / "s"), str(tmp_path / "d"))(batch, 0)
