"""Change feeds of document folders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Periods that are looked at together.
BLOCK = 4096
KINDS = {"create": "added", "modify": "modified", "remove": "removed"}


def files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of text files as they appear below a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return stream.where(F.col("path").rlike(r"(?i)\.(?:md|markdown|txt)$"))


def named(events: DataFrame, kind: str = "kind") -> DataFrame:
    """Events with the names of their kinds; others are left out."""
    return events.withColumn("change", F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col(kind))).where("change is not null")


def debounced(events: DataFrame, key: str = "path", at: str = "ts", quiet_ms: int = 500, forget_ms: int = 600_000) -> DataFrame:
    """Of each key's events, those at least quiet_ms after the last one that was passed on. events: key (string) and at (timestamp), a stream.

    What a key's last event was is forgotten once none has come for forget_ms (or quiet_ms, if that is longer)."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b["at"]):
            ms = t.value // 1_000_000
            if last is None or ms - last >= quiet_ms:
                out.append(t)
                last = ms
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(max(forget_ms, quiet_ms))
        yield pd.DataFrame({"key": [k[0]] * len(out), "at": pd.Series(out, dtype="datetime64[ns]")})

    rows = events.select(F.col(key).alias("key"), F.col(at).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, at timestamp", "last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def quiet_groups(events: DataFrame, quiet_ms: int) -> DataFrame:
    """events (key, at_ms) with part, the begin of the run of busy periods that an event belongs to, in periods of quiet_ms.

    Between two events with an empty period between them there is more than quiet_ms, so that debouncing starts afresh, and the runs of a key are groups of
    their own. A run begins where no event is in the period before, which is a join by key and period. Periods are counted before they are shuffled,
    and looked at in blocks, so that no task has all periods of a key."""
    period = F.floor(F.col("at_ms") / quiet_ms).cast("bigint")
    busy = events.select("key", period.alias("period")).distinct()
    earlier = busy.select(F.col("key").alias("_key"), (F.col("period") + 1).alias("_period"))
    begins = busy.join(earlier, F.col("key").eqNullSafe(F.col("_key")) & (F.col("period") == F.col("_period")), "left").select("key", "period", F.when(F.col("_period").isNull(), F.col("period")).alias("begin"))
    begins = begins.withColumn("block", F.floor(F.col("period") / BLOCK).cast("bigint"))
    blocks = begins.groupBy("key", "block").agg(F.max("begin").alias("last"))
    before = F.max("last").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.struct("key", "block").alias("_b"), before.alias("before"))
    inside = F.max("begin").over(Window.partitionBy("_b").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = begins.withColumn("_b", F.struct("key", "block")).join(blocks, "_b").select(F.struct("key", "period").alias("_at"), F.coalesce(inside, "before").alias("part"))
    return events.withColumn("_at", F.struct("key", period.alias("period"))).join(placed, "_at").drop("_at")


def debounced_batch(events: DataFrame, key: str, at: str, quiet_ms: int = 500) -> DataFrame:
    """As debounced(), for a table: key and at_ms. Null times are left out.

    The runs of quiet_groups() are dealt and sorted by Spark, which spills; a task reads its rows once, holding one run's key and one time. Events of one run
    depend on each other in their order, and so are one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = last = None
        for batch in batches:
            keys, parts, times = (batch.column(c).to_pylist() for c in ("key", "part", "at_ms"))
            kept = []
            for i, (k, p, t) in enumerate(zip(keys, parts, times, strict=True)):
                if last is None or (k, p) != now or t - last >= quiet_ms:
                    kept.append(i)
                    now, last = (k, p), t
            yield batch.select(["key", "at_ms"]).take(pa.array(kept, pa.int64()))

    rows = events.select(F.col(key).alias("key"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms")).where("at_ms is not null")
    return quiet_groups(rows, quiet_ms).select("key", "part", "at_ms").repartition("key", "part").sortWithinPartitions("key", "part", "at_ms").mapInArrow(run, rows.schema)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """added, modified and removed keys between two snapshots, which a file source alone does not tell."""
    b, a = before.select(F.col(key), F.col(value).alias("_b")), after.select(F.col(key), F.col(value).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return b.join(a, key, "full_outer").withColumn("change", change).where("change is not null").select(key, "change")
