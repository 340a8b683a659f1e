"""Queries of what takes documents in and keeps them: folder scans, front matter, re-scans, the stored index, stored vectors, dispatch; and of distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant import storage
from foliant.dispatch import Dispatcher
from foliant.operators import distribution, router, search_index, vector_store
from foliant.plans.catalog import FNV_SQL, docs, query, spread
from foliant.sources import files
from foliant.streaming import rescan


@query("scan_folder", "SELECT 'src=' || source AS category, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as text files of a hundred each into a folder of each source, and scanned from there."""
    folder = storage.fresh(spark, "scan")
    rows = docs(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("value"), F.col("source").alias("src"))
    rows.write.partitionBy("src").option("maxRecordsPerFile", 100).text(folder)
    local = folder.removeprefix("file://").removeprefix("file:")
    if spark.sparkContext.master.startswith("local["):
        found = files.scan(spark, local)
    else:  # executors see the shared folder through Spark's own file system
        found = files.scan(spark, folder if ":" in folder else f"file://{folder}")
    return found.groupBy("category").agg(F.sum(F.octet_length("content")).alias("n_bytes"), F.sum(F.length("content")).alias("n_chars"))


HEAD = "'---' || chr(10) || 'title: \"T ' || doc_id || '\"' || chr(10) || 'version: ' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN '.50' ELSE '' END || chr(10) || 'tags: [' || lang || ', x]' || chr(10) || 'meta:' || chr(10) || '  source: {name: ' || source || '}' || chr(10) || '  sizes:' || chr(10) || '  - ' || n_chars || chr(10) || '  - |' || chr(10) || '    a' || chr(10) || '    b' || chr(10) || CASE WHEN doc_id % 7 = 0 THEN 'broken: [1' ELSE 'done: true' END || chr(10) || '---' || chr(10) || coalesce(text, '')"


@query("front_matter", f"""
SELECT doc_id, CASE WHEN ok THEN 'T ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS title, CASE WHEN NOT ok THEN '1.0' WHEN doc_id % 2 = 0 THEN (doc_id % 3) || '.5' ELSE CAST(doc_id % 3 AS VARCHAR) END AS version, CASE WHEN ok THEN lang || ',x' ELSE '' END AS tags,
       CASE WHEN ok THEN source END AS source_name, CASE WHEN ok THEN n_chars END AS n_chars, CASE WHEN ok THEN 'a' || chr(10) || 'b' || chr(10) END AS block, sha256(CASE WHEN ok THEN coalesce(text, '') ELSE {HEAD} END) AS digest
FROM (SELECT *, doc_id % 7 <> 0 AS ok FROM documents)
""")  # fmt: skip
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(docs(spark, sf_dir)).select(F.concat(F.lit("/v/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.expr(HEAD).alias("raw"), F.lit(None).cast("timestamp").alias("modified"))
    found = files.with_front_matter(files.documents(raw))
    get = lambda path, kind: F.try_variant_get("front_matter", path, kind)
    return found.select(
        F.regexp_extract("file_name", r"^\d+", 0).cast("bigint").alias("doc_id"), "title", "version", F.array_join("tags", ",").alias("tags"), get("$.meta.source.name", "string").alias("source_name"), get("$.meta.sizes[0]", "bigint").alias("n_chars"), get("$.meta.sizes[1]", "string").alias("block"), F.sha2("content", 256).alias("digest"),
    )


_STOPS = lambda words: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)
RESCAN_BYTES = 8000


@query("rescanned", f"""
SELECT doc_id, CASE WHEN strlen(text) > {RESCAN_BYTES} THEN 'too_large' WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'blank' WHEN doc_id IN (3, 77) THEN 'failed' ELSE CASE WHEN de > en THEN 'De' WHEN en > de THEN 'En' ELSE 'Mixed' END END AS outcome
FROM (SELECT doc_id, text, {_STOPS(router.lex.STOPWORDS_DE)} AS de, {_STOPS(router.lex.STOPWORDS_EN)} AS en FROM documents)
""")  # fmt: skip
def rescanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the documents, whose languages are told; two of them fail when they are looked at."""
    base = storage.fresh(spark, "rescan")
    arrived = storage.written(spread(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))), f"{base}/in")
    stream = spark.readStream.schema(arrived.schema).parquet(f"{base}/in")

    def analysis(batch: DataFrame) -> DataFrame:
        bad = F.col("path").isin("3", "77")
        return batch.select("path", F.when(bad, F.raise_error(F.lit("can't be told")).cast("string")).otherwise(router.language(F.col("content"))).alias("language"))

    rescan.start(stream, analysis, f"{base}/store", f"{base}/dead", f"{base}/checkpoint", RESCAN_BYTES).awaitTermination()
    done = rescan.stored(spark, f"{base}/store").select("path", F.col("language").alias("outcome"))
    return done.unionByName(rescan.dead_letters(spark, f"{base}/dead").select("path", F.col("reason").alias("outcome"))).select(F.col("path").cast("bigint").alias("doc_id"), "outcome")


_CHANGED = "CASE WHEN lang = 'de' THEN coalesce(text, '') || ' thin erin' ELSE text END"


@query("indexed_search", f"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower({_CHANGED}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM documents WHERE n_chars >= 100),
     live AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(coalesce({_CHANGED}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS length FROM documents WHERE n_chars >= 100), total AS (SELECT count(*) AS n, avg(length) AS mean FROM live),
     hits AS (SELECT p, doc_id, count(*) AS tf FROM w JOIN (SELECT unnest(['thin', 'eri']) AS p) ON starts_with(term, p) GROUP BY p, doc_id), df AS (SELECT p, count(*) AS df FROM hits GROUP BY p)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS rank
FROM hits JOIN df USING (p) JOIN live USING (doc_id), total GROUP BY doc_id HAVING count(*) = 2 ORDER BY rank DESC, doc_id LIMIT 500
""")  # fmt: skip
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents; then the German ones change, short ones are taken out, and the index that results is searched."""
    path = storage.fresh(spark, "index")
    df = docs(spark, sf_dir).select("doc_id", "text", "lang", "n_chars")
    search_index.create(df, path, "doc_id", ("text",))
    changed = df.where("lang = 'de' and n_chars >= 100").withColumn("text", F.expr(_CHANGED))
    search_index.update(changed, df.where("n_chars < 100"), path, "doc_id", ("text",))
    return search_index.search(spark, path, "Thin eri").select(F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank"))


def prepared_index(spark: SparkSession, sf_dir: str) -> str:
    """An index of the documents as they are, for timing searches."""
    path = storage.fresh(spark, "index")
    search_index.create(docs(spark, sf_dir), path, "doc_id", ("text",))
    return path


_ASKED = "thin erin of the red mountain"


@query("semantic_search", f"""
WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 2)) AS term FROM documents WHERE NOT contains(text, '@') AND text IS NOT NULL
           UNION ALL SELECT 'query', unnest(string_split('{_ASKED}', ' '))),
     h AS (SELECT term, {FNV_SQL.format(x="term")} AS h FROM (SELECT DISTINCT term FROM t)),
     b AS (SELECT id, CAST(h % 64 AS INT) AS bucket, CAST(sum(CASE WHEN h >= 9223372036854775808 THEN -1 ELSE 1 END) AS DOUBLE) AS v FROM t JOIN h USING (term) GROUP BY ALL),
     u AS (SELECT id, bucket, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v FROM b),
     n AS (SELECT id, sqrt(sum(v * v)) AS size FROM u GROUP BY id),
     s AS (SELECT d.id, sum(d.v * q.v) AS dot FROM u d JOIN u q ON q.id = 'query' AND q.bucket = d.bucket WHERE d.id <> 'query' GROUP BY d.id)
SELECT s.id, round(dot / (n.size * (SELECT size FROM n WHERE id = 'query')), 3) AS score, source AS title, lang AS category FROM s JOIN n USING (id) JOIN documents ON CAST(doc_id AS VARCHAR) = s.id ORDER BY score DESC, s.id LIMIT 10
""")  # fmt: skip
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an at sign are embedded and stored, twice (the second time nothing has changed), and searched by a text."""
    path = storage.fresh(spark, "vectors")
    df = spread(docs(spark, sf_dir)).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("t0").alias("updated_at"), F.contains("text", F.lit("@")).alias("is_sensitive"), F.col("source").alias("title"), F.col("lang").alias("category"))
    vector_store.reindex(df, path)
    vector_store.reindex(df, path)
    return vector_store.semantic_search(spark, _ASKED, path, df).select("id", "score", "title", "category")


@query("reindex_reports", """
WITH d AS (SELECT CASE WHEN contains(text, '@') THEN 's' WHEN text IS NULL THEN 'f' WHEN lang = 'de' THEN 'c' ELSE 'u' END AS k FROM documents), n AS (SELECT count(*) FILTER (WHERE k = 's') AS s, count(*) FILTER (WHERE k = 'f') AS f, count(*) FILTER (WHERE k = 'c') AS c, count(*) FILTER (WHERE k = 'u') AS u FROM d)
SELECT 1 AS run, c + u AS indexed, s AS skipped_sensitive, 0::BIGINT AS skipped_unchanged, f AS failed, c + u AS n_vectors FROM n UNION ALL SELECT 2, c, s, u, f, c + u FROM n
""")  # fmt: skip
def reindex_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs of re-indexing report: of all documents, and once the German ones have changed."""
    path = storage.fresh(spark, "vectors")
    df = spread(docs(spark, sf_dir)).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("t0").alias("updated_at"), F.contains("text", F.lit("@")).alias("is_sensitive"), "lang")
    rows = []
    for run, version in ((1, df), (2, df.withColumn("updated_at", F.when(F.col("lang") == "de", "t1").otherwise("t0")))):
        r = vector_store.reindex(version, path)
        rows.append((run, r.indexed, r.skipped_sensitive, r.skipped_unchanged, r.failed, vector_store.vectors(spark, path).count()))
    return spark.createDataFrame(rows, "run int, indexed bigint, skipped_sensitive bigint, skipped_unchanged bigint, failed bigint, n_vectors bigint")


@query("dispatched_search", """
WITH f AS (SELECT doc_id, source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file_path FROM documents WHERE contains(lower(text), 'tion') OR contains(lang, 'tion') OR contains(source, 'tion'))
SELECT doc_id AS id, file_path, (SELECT count(*) FROM f) AS total FROM f ORDER BY file_path LIMIT 100 OFFSET 5
""")  # fmt: skip
def dispatched_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search by its action's name, checked and logged."""
    df = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file_path"), F.col("source").alias("title"), F.col("lang").alias("category"), F.array().cast("array<string>").alias("tags"), F.col("text").alias("content"), F.lit("").alias("description"))
    call = Dispatcher(spark, storage.fresh(spark, "evidence"), developer=True)("prompts.search", df, query="TION", limit=100, offset=5)
    if not call.success:
        raise ValueError(call.error)
    return call.data.select("id", "file_path", F.col("total").cast("bigint").alias("total"))


@query("folder_means", "WITH d AS (SELECT unnest(['', source, source || '/' || lang]) AS folder, n_chars FROM documents) SELECT folder, count(*) AS n_docs, round(avg(n_chars), 6) AS mean FROM d GROUP BY folder")
def folder_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir).select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("file_path"), "n_chars")
    return distribution.folder_means(df, "file_path", "n_chars").withColumn("mean", F.round("mean", 6))


@query("score_bands", "WITH s AS (SELECT least(n_chars // 50, 100) AS s FROM documents), b AS (SELECT CASE WHEN s >= 85 THEN 'EXCELLENT' WHEN s >= 70 THEN 'GOOD' WHEN s >= 55 THEN 'FAIR' WHEN s >= 40 THEN 'POOR' ELSE 'BROKEN' END AS band FROM s WHERE s IS NOT NULL) SELECT band, count(*) AS n_docs, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY band")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir).select(F.least(F.expr("n_chars div 50"), F.lit(100)).alias("s"))
    return distribution.bands(df, "s").withColumn("share", F.round("share", 6))


@query("slowest_documents", "SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 10")
def slowest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.slowest(docs(spark, sf_dir), "n_chars", "doc_id")


