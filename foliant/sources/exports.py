"""Exports of a selection: one document each as rows, whole files on the driver, and a JSON cache.

Rows are made on the executors. A file is written from toLocalIterator(), document by document, so that the driver never holds a whole export."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.0"
FIELDS = ("id", "file_path", "file_name", "title", "description", "category", "version", "tags", "content", "raw_frontmatter", "created_at", "updated_at", "is_favorite")


def entries(docs: DataFrame, web: bool = False) -> DataFrame:
    """id and value: a JSON object of a document with its scores. Absent scores are left out; for the web they are null, and a blank category is uncategorized."""
    if web:
        docs = docs.withColumn("category", F.when(F.trim(F.coalesce("category", F.lit(""))) == "", "uncategorized").otherwise(F.col("category")))
    return docs.select("id", F.to_json(F.struct(*(c for c in docs.columns)), {"ignoreNullFields": str(not web).lower()}).alias("value"))


def envelope(values: Iterator[str], exported_at: str) -> Iterator[str]:
    """Pieces of a JSON file: export_date, version and prompts."""
    yield json.dumps({"export_date": exported_at, "version": VERSION})[:-1] + ', "prompts": ['
    for i, v in enumerate(values):
        yield (",\n" if i else "\n") + v
    yield "\n]}\n"


def escaped(x: Column) -> Column:
    """A value inside double quotes of YAML."""
    out = F.coalesce(x, F.lit(""))
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def markdown(docs: DataFrame, web: bool = False) -> DataFrame:
    """id and value: a YAML header with all fields, scores as comments (— where there are none; null for the web), and the content."""
    quoted = lambda c: F.concat(F.lit(f'{c}: "'), escaped(F.col(c)), F.lit('"\n'))
    none = F.lit("null" if web else "—")
    tags = F.concat(F.lit("tags: "), F.to_json(F.coalesce("tags", F.expr("cast(array() as array<string>)"))), F.lit("\n"))
    score = lambda c: F.concat(F.lit(f"# {c}: "), F.coalesce(F.col(c).cast("string"), none), F.lit("\n"))
    head = F.concat(*(quoted(c) for c in ("title", "description", "category", "version")), tags, quoted("created_at"), quoted("updated_at"), score("quality_score"), score("hygiene_score"))
    return docs.select("id", F.concat(F.lit("---\n"), head, F.lit("---\n\n"), F.coalesce("content", F.lit(""))).alias("value"))


def listing(docs: DataFrame) -> DataFrame:
    """id and value: a document's heading, category and version, as the server lists them."""
    return docs.select("id", F.concat(F.lit("# "), "title", F.lit("\n\n- Kategorie: "), "category", F.lit("\n- Version: "), "version", F.lit("\n\n---\n\n")).alias("value"))


def served(docs: DataFrame, kind: str = "json") -> tuple[DataFrame, int]:
    """Rows of a server's export and their number; other kinds than json, markdown and md are refused."""
    kind = kind.lower()
    if kind not in ("json", "markdown", "md"):
        raise ValueError(f"Unbekanntes Export-Format: {kind} (unterstützt: json, markdown)")
    return (entries(docs) if kind == "json" else listing(docs)), docs.count()


def in_order(rows: DataFrame) -> Iterator[str]:
    return (r["value"] for r in rows.orderBy("id").toLocalIterator())


def write_json(docs: DataFrame, target: str, exported_at: str, web: bool = False) -> None:
    with open(target, "w", encoding="utf-8") as out:
        out.writelines(envelope(in_order(entries(docs, web)), exported_at))


def write_markdown(docs: DataFrame, target: str, web: bool = False) -> None:
    with open(target, "w", encoding="utf-8") as out:
        for i, v in enumerate(in_order(markdown(docs, web))):
            out.write((("\n\n---\n\n" if web else "\n---\n\n") if i else "") + v)


def zip_path(path: Column) -> Column:
    """A path inside an archive: its ordinary parts, none of which leads upwards."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^[A-Za-z]:", ""), r"[/\\]+"), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit(".."), F.lit("_"))), "/")).otherwise("unknown.md")


def reconstructed(docs: DataFrame) -> DataFrame:
    """id, path and value: documents as files, with their front matter (JSON, which is YAML) where they had any."""
    has = ~F.coalesce("raw_frontmatter", F.lit("{}")).isin("{}", "null", "")
    value = F.when(has, F.concat(F.lit("---\n"), "raw_frontmatter", F.lit("\n---\n\n"), "content")).otherwise(F.col("content"))
    return docs.select("id", zip_path(F.col("file_path")).alias("path"), F.coalesce(value, F.lit("")).alias("value"))


def write_zip(docs: DataFrame, target: str) -> int:
    """An archive of the documents as files, metadata.json with their fields and scores, and index.json with the path of each id."""
    index = {}
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for r in reconstructed(docs).orderBy("path", "id").toLocalIterator():
            archive.writestr(r["path"], r["value"])
            index[r["id"]] = r["path"]
        with archive.open("metadata.json", "w") as out:
            out.write(b'{"prompts": [')
            for i, v in enumerate(in_order(entries(docs))):
                out.write(((",\n" if i else "\n") + v).encode())
            out.write(b"\n]}\n")
        archive.writestr("index.json", json.dumps(index, ensure_ascii=False, indent=2))
    return len(index)


# The cache: a folder with a table of JSON lines for each of these names.
CACHED = ("prompts", "evaluations", "hygiene")


def save_cache(folder: str, **tables: DataFrame) -> None:
    """Replaces the tables that are named."""
    for name in CACHED:
        if name in tables:
            tables[name].write.mode("overwrite").json(f"{folder}/{name}")


def load_cache(spark: SparkSession, folder: str, **schemas: str) -> dict[str, DataFrame]:
    """The tables by their schemas; a missing one is empty, and damaged lines are left out."""
    out = {}
    for name, schema in schemas.items():
        there = cache_exists(spark, folder, name)
        out[name] = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{folder}/{name}") if there else spark.createDataFrame([], schema)
    return out


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cache_exists(spark: SparkSession, folder: str, name: str = "prompts") -> bool:
    p, files = _path(spark, f"{folder}/{name}")
    return files.exists(p)


def clear_cache(spark: SparkSession, folder: str) -> None:
    for name in CACHED:
        p, files = _path(spark, f"{folder}/{name}")
        files.delete(p, True)


def load_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gold cases or pairs: a JSON array, alone or under the key pairs."""
    raw = spark.read.text(path, wholetext=True)
    rows = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.from_json("value", f"struct<pairs: array<struct<{schema}>>>")["pairs"])
    return raw.select(F.explode(rows).alias("r")).select("r.*")


def load_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of one split, with a column of its name; files that don't say which split they are of are refused."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<split: string, results: array<struct<{schema}>>>").alias("r"))
    if raw.where("r.split is null").limit(1).count():
        raise ValueError(f'REFUSED: {path} has no "split" header')
    return raw.select("r.split", F.explode("r.results").alias("x")).select("split", "x.*")


def fixture_name(name: str) -> str:
    """A fixture's name that stays in its folder."""
    import re

    plain = re.sub(r"\.\.(?:/|\\)?", "", name)
    return re.sub(r'[<>:"|?*\x00]', "", re.sub(r"^[./\\]+", "", plain))


def load_fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.text(f"{folder}/{fixture_name(name)}", wholetext=True).withColumnRenamed("value", "content")


def checked_root(folder: str, roots: tuple[str, ...] | None = None, depth: int = 5) -> str:
    """The real path of a folder to scan. Null bytes, missing folders, files, long chains of links, and folders outside the roots (None: any) are refused."""
    if "\x00" in folder:
        raise ValueError("Pfad enthält ungültige Null-Bytes")
    path = Path(folder)
    if not path.exists():
        raise ValueError(f"Verzeichnis existiert nicht: {folder}")
    if not path.is_dir():
        raise ValueError(f"Pfad ist kein Verzeichnis: {folder}")
    step, links = path, 0
    while step.is_symlink():
        step, links = step.parent / step.readlink(), links + 1
        if links > depth:
            raise ValueError(f"Symlink-Tiefe > {depth}: {folder}")
    real = path.resolve()
    if roots is not None and not any(real.is_relative_to(Path(r).resolve()) for r in roots):
        raise PermissionError("Pfad liegt außerhalb der freigegebenen Scan-Wurzeln")
    return str(real)


def inside(path: Column, root: str) -> Column:
    """Whether a path is the root or below it, by whole parts."""
    base = root.rstrip("/")
    return (path == base) | F.startswith(path, F.lit(base + "/"))


def new_file(title: str, folder: str) -> str:
    """Where a document of the title would be written, inside the folder; nothing is written."""
    import re

    name = re.sub(r'[/\\:*?"<>|\x00]', "_", title).strip()
    if name in ("", ".", ".."):
        raise ValueError("Filename contains path traversal characters")
    return str(Path(checked_root(folder)) / f"{name}.md")
