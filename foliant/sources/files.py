"""Document folders as DataFrames: scan, front matter, metadata, Markdown structure."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.sources.exports import checked_root
from foliant.sources.folder import DEPTH, FolderSource
from foliant.sources.front_matter import yaml_as_json

MOST_BYTES = 1 << 20
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n?---\s*\n?(.*)"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def entries(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES, depth: int = DEPTH, roots: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each text file below a folder, and for each thing that can't be read or followed: file_path, length, modified, content and reason.

    A folder that all executors see is checked and walked by folder.FolderSource, by its rules of depth and links. Folders of other file systems
    (a path with a scheme) have no links; Spark's own source lists them."""
    if not re.match("[a-z][a-z0-9+.-]*:", folder):
        spark.dataSource.register(FolderSource)
        real = checked_root(folder, roots)
        return spark.read.format("document_folder").option("path", real).option("most_bytes", most_bytes).option("depth", depth).load()
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("path").rlike(r"(?i)\.(?:md|markdown|txt)$"))
    below = F.size(F.split(F.regexp_replace("path", "^[a-z0-9+.-]+:/*", ""), "/")) - F.size(F.split(F.regexp_replace(F.lit(base), "^[a-z0-9+.-]+:/*", ""), "/"))
    reason = F.when(below > depth, "too_deep").when(F.col("length") > most_bytes, "too_large").when(~F.is_valid_utf8(F.col("content").cast("string")), "not_text")
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), "length", F.col("modificationTime").alias("modified"), "content", reason.alias("reason"))


def scan(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES, depth: int = DEPTH, roots: tuple[str, ...] | None = None) -> DataFrame:
    """Text files below a folder, as documents in the order of their paths; scan_log() has what is left out, and why."""
    texts = entries(spark, folder, most_bytes, depth, roots).where("reason is null")
    return documents(texts.select("file_path", F.col("content").cast("string").alias("raw"), "modified")).orderBy("file_path")


def scan_log(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES, depth: int = DEPTH, roots: tuple[str, ...] | None = None) -> DataFrame:
    """file_path and reason of what scan() leaves out: too_large, not_text, too_deep, link_depth, link_loop, broken_link, outside, or unreadable with the system's message."""
    return entries(spark, folder, most_bytes, depth, roots).where("reason is not null").select("file_path", "reason")


def stable_id(path: Column) -> Column:
    """UUID version 5 of the path in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(path, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def with_front_matter(docs: DataFrame, raw: str = "raw_frontmatter", name: str = "front_matter") -> DataFrame:
    """docs with their front matter as a variant, from which nested values are read by path; null where it is no JSON."""
    return docs.withColumn(name, F.try_parse_json(raw))


def documents(files: DataFrame) -> DataFrame:
    """file_path, raw and modified as documents with metadata; front matter goes before defaults.

    Front matter that can't be read stays part of the content. A title, category, description or time counts if it is a string, a version also as a number, tags
    as a list, of which strings count, or as one string."""
    has = F.col("raw").rlike(FRONT_MATTER)
    df = with_front_matter(files.withColumn("raw_frontmatter", yaml_as_json(F.when(has, F.regexp_extract("raw", FRONT_MATTER, 1)))), name="_v")
    ok = F.col("raw_frontmatter").isNotNull()
    kind = lambda k: F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))
    string = lambda k: F.when(kind(k) == "STRING", F.try_variant_get("_v", f"$.{k}", "string"))
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    folder = F.regexp_extract("file_path", r"([^/]+)/[^/]*$", 1)
    version = F.when(kind("version").rlike("^(?:STRING|BIGINT|DECIMAL|DOUBLE)"), F.regexp_replace(F.get_json_object("raw_frontmatter", "$.version"), F.when(kind("version") == "STRING", "^$").otherwise(r"\.0$"), F.lit("")))
    listed = F.transform(F.filter(F.try_variant_get("_v", "$.tags", "array<variant>"), lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string"))
    none = F.expr("cast(array() as array<string>)")
    stamp = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.select(
        stable_id(F.col("file_path")).alias("id"), "file_path", name.alias("file_name"),
        F.coalesce(string("title"), F.regexp_replace(name, r"(?i)\.(?:markdown|md|txt)$", "")).alias("title"), F.coalesce(string("description"), F.lit("")).alias("description"),
        F.coalesce(string("category"), F.when(folder != "", folder), F.lit("Uncategorized")).alias("category"), F.coalesce(version, F.lit("1.0")).alias("version"),
        F.when(string("tags").isNotNull(), F.array(string("tags"))).otherwise(F.coalesce(listed, none)).alias("tags"),
        F.when(ok, F.regexp_extract("raw", FRONT_MATTER, 2)).otherwise(F.col("raw")).alias("content"), F.coalesce("raw_frontmatter", F.lit("{}")).alias("raw_frontmatter"),
        F.coalesce(string("created"), stamp).alias("created_at"), F.coalesce(string("updated"), stamp).alias("updated_at"), F.lit(False).alias("is_favorite"),
    )


def markdown_structure(text: Column) -> Column:
    """headings (level, text, line) outside fences, and fences (language, start, end, lines); an open fence ends with the text."""
    lines = F.split(text, r"\r?\n", -1)
    numbered = F.transform(lines, lambda x, i: F.struct(strip(x).alias("x"), (i + 1).alias("line")))
    ticks = F.filter(numbered, lambda s: F.startswith(s["x"], F.lit("```")))
    at = F.transform(ticks, lambda s: s["line"])
    pairs = F.filter(F.transform(ticks, lambda s, k: F.struct(F.trim(F.substring(s["x"], 4, 1 << 20)).alias("language"), s["line"].alias("start"), F.coalesce(F.get(at, k + 1), F.size(lines)).alias("end"), k.alias("k"))), lambda s: s["k"] % 2 == 0)
    fences = F.transform(pairs, lambda s: F.struct(s["language"].alias("language"), s["start"].alias("start"), s["end"].alias("end"), F.greatest(s["end"] - s["start"] - 1, F.lit(0)).alias("lines")))
    outside = F.filter(numbered, lambda s: s["x"].rlike(r"^#{1,6}\s+\S") & ~F.exists(pairs, lambda p: (s["line"] >= p["start"]) & (s["line"] <= p["end"])))
    headings = F.transform(outside, lambda s: F.struct(F.length(F.regexp_extract(s["x"], "^(#+)", 1)).alias("level"), strip(F.regexp_replace(s["x"], "^#+", "")).alias("text"), s["line"].alias("line")))
    return F.struct(headings.alias("headings"), fences.alias("code_blocks"), F.size(lines).alias("total_lines"))
