"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import threading
import time

from pyspark.sql import SparkSession

from foliant.operators import search_index
from foliant.plans import catalog, ingest

HEADLINE = ("hygiene_by_language", "hygiene_secret", "hygiene_pii", "hygiene_analysis", "quality_scores", "route_documents", "detect_language", "text_primitives", "collections_list", "exact_duplicates", "normalised_duplicates", "vector_top_k", "embed_documents", "lexical_search", "stored_index_search", "agreement_metrics", "strip_secrets", "conservative_cleanup", "latest_events", "upsert")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": "2m"}
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    limit = float(os.environ.get("BENCH_LIMIT", "240"))
    queries, failed = {}, {}
    index = ingest.prepared_index(spark, sf_dir)  # built once, for many searches
    own = {"stored_index_search": lambda spark, _: search_index.search(spark, index, "thin erin")}
    for name in HEADLINE:
        begin = time.perf_counter()
        # A query beyond its limit is cancelled and named, and the others still get their figures.
        timer = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
        timer.start()
        try:
            (catalog.QUERIES | own)[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            queries[name] = round(time.perf_counter() - begin, 3)
        except Exception as error:  # noqa: BLE001
            failed[name] = f"{type(error).__name__} after {time.perf_counter() - begin:.0f} s"
        finally:
            timer.cancel()
        print(name, queries.get(name, failed.get(name)), file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "failed": failed, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
