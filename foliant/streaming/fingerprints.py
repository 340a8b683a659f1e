"""Documents whose text has changed, from a stream, by a bounded memory of fingerprints.

The memory is dealt to shards by a hash of the key; a shard forgets the key that it saw longest ago once it has its share of `most`, and any
key that hasn't come for `keep_ms`. What is forgotten is only processed again. Needs Spark's RocksDB state store, in which the
state is larger than memory and survives lost executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST, SHARDS, KEEP_MS = 1000, 8, 86_400_000
SCHEMA = "id string, fingerprint string, at timestamp"


class Changed(StatefulProcessor):
    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        #: Fingerprint and number of the last sight of each id, and how many sights there have been.
        self.seen = handle.getMapState("seen", "id string", "fingerprint string, sight bigint", ttlDurationMs=self.keep_ms)
        self.sights = handle.getValueState("sights", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.sights.get()[0] if self.sights.exists() else 0
        known = {k[0]: tuple(v) for k, v in self.seen.iterator()}
        # In the order of their times; of equal ones, by id and fingerprint, so that a repeated batch does the same.
        batch = pd.concat(list(rows)).sort_values(["at", "id", "fingerprint"], kind="stable")
        new, gone = [], set()
        for i, (id_, fingerprint) in enumerate(zip(batch["id"], batch["fingerprint"], strict=True)):
            if id_ not in known or known[id_][0] != fingerprint:
                new.append(i)
            n += 1
            known[id_] = (fingerprint, n)
            gone.discard(id_)
            if len(known) > self.most:
                oldest = min(known, key=lambda k: known[k][1])
                del known[oldest]
                gone.add(oldest)
        for id_ in gone:
            if self.seen.containsKey((id_,)):
                self.seen.removeKey((id_,))
        for id_ in set(batch["id"]) & set(known):
            self.seen.updateValue((id_,), known[id_])
        self.sights.update((n,))
        yield batch.iloc[new][["id", "fingerprint", "at"]]

    def close(self) -> None:
        pass


def changed(docs: DataFrame, most: int = MOST, shards: int = SHARDS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Of a stream of id, fingerprint and at (timestamp), the rows whose fingerprint isn't the one remembered of their id. At most `most` ids are remembered, dealt to the shards;
    with one shard they are the ones that came last. Forgetting by time needs batches to go on, so that a trigger of what is available now doesn't end: use one of an interval, or of one batch."""
    rows = docs.select(F.col("id").cast("string").alias("id"), "fingerprint", "at").where("id is not null").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").transformWithStateInPandas(Changed(max(1, most // shards), keep_ms), outputStructType=SCHEMA, outputMode="append", timeMode="ProcessingTime")
