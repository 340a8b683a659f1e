"""Distributions of scores over a corpus: exact percentiles without holding the values, means of folders, bands, and the slowest documents.

A percentile is found by counting: values fall into BINS equal parts of their range, then those of the parts that hold a wanted rank into BINS
parts again, until a part is one value. Each pass is one aggregate that combines before its shuffle, and what comes to the driver are
counts of at most BINS parts for each rank."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import band

BINS = 4096


def ranked(docs: DataFrame, value: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at ranks from 0 of the sorted values, nulls and NaN left out. Ranks beyond the values aren't there."""
    rows = docs.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, least, most = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    #: For each part that is looked at: its bounds, and the wanted ranks in it, counted from its first value.
    parts = {(least, most): {r: r for r in ranks if 0 <= r < n}} if n else {}
    found: dict[int, float] = {}
    while parts:
        for low, high in [p for p in parts if p[0] == p[1]]:
            found |= {r: low for r in parts.pop((low, high))}
        parts = {p: w for p, w in parts.items() if w}
        if not parts:
            break
        which = F
        for i, (low, high) in enumerate(parts):
            wide = (high - low) / BINS
            bin_ = F.least(F.floor((F.col("v") - low) / wide), F.lit(BINS - 1)) if wide > 0 and math.isfinite(wide) else F.when(F.col("v") == high, BINS - 1).otherwise(0)
            which = which.when(F.col("v").between(low, high), F.struct(F.lit(i).alias("i"), bin_.cast("int").alias("bin")))
        counts = rows.select("v", which.alias("at")).where("at is not null").groupBy("at.i", "at.bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        following: dict[tuple[float, float], dict[int, int]] = {}
        for i, wanted in enumerate(parts.values()):
            before = 0
            for c in sorted((c for c in counts if c["i"] == i), key=lambda c: c["bin"]):
                inside = {r: at - before for r, at in wanted.items() if before <= at < before + c["n"]}
                if inside:
                    following.setdefault((c["low"], c["high"]), {}).update(inside)
                before += c["n"]
        parts = following
    return found


def percentiles(docs: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact percentiles, between two values in proportion; null without values."""
    n = docs.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    at = ranked(docs, value, sorted({f(p) for p in places for f in (math.floor, math.ceil)}))
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


SHARES = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}


def summary(docs: DataFrame, value: str) -> DataFrame:
    """One row: n, least, largest, mean and exact percentiles."""
    found = percentiles(docs, value, list(SHARES.values()))
    whole = docs.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"), F.avg(value).alias("mean"))
    return whole.withColumns({name: F.lit(x).cast("double") for name, x in zip(SHARES, found, strict=True)})


def folder_means(docs: DataFrame, path: str, value: str) -> DataFrame:
    """Documents and mean of every folder, with all that are below it; the root is the empty path."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/+"), lambda p: ~p.isin("", "."))
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_p") - 1, F.lit(0))), lambda k: F.array_join(F.slice("_p", F.lit(1), k), "/"))
    rows = docs.select(parts.alias("_p"), F.col(value).alias("_v")).select(F.explode(above).alias("folder"), "_v")
    return rows.groupBy("folder").agg(F.count("*").alias("n_docs"), F.avg("_v").alias("mean"))


def bands(docs: DataFrame, value: str) -> DataFrame:
    """Documents of each quality band, and their share of those that have a score."""
    counted = docs.where(F.col(value).isNotNull()).groupBy(band(F.col(value)).alias("band")).agg(F.count("*").alias("n_docs"))
    total = docs.agg(F.count(value).alias("_all"))  # one row
    return counted.crossJoin(F.broadcast(total)).select("band", "n_docs", (F.col("n_docs") / F.col("_all")).alias("share"))


def slowest(docs: DataFrame, duration: str, key: str, k: int = 10) -> DataFrame:
    """The k documents that took longest; ties by key. A top-k in each partition, and of these."""
    return docs.where(F.col(duration).isNotNull()).select(key, duration).orderBy(F.desc(duration), key).limit(k)
