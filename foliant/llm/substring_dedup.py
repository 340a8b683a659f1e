"""Removes passages that documents repeat, by seed and extend.

Seeds: of the 9 runs of 5 words inside each window of 13 words, the one with the least hash is the window's anchor (winnowing),
so equal windows have equal anchors, and one anchor serves several windows in a row: its span. An anchor without a second
document ends there. Extension: where all occurrences of an anchor agree in their whole span, the span repeats as it is; where
they differ, the span is taken apart into its windows, and these are compared. Overlapping repeats merge into maximal ones.

Anchors, spans and windows meet only as minima over documents, which combine before the shuffle, and the joins deal both sides
by the anchor or window alone, so Spark can split hot ones. A passage that a third of all documents share costs one row for
each of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bytewords import Runs, U, Words, mix, signed, words
from foliant.llm.shared import by_arrow, discard, read, slices, stored

WINDOW, ANCHOR = 13, 5
LAST = np.iinfo(np.int64).max

#: What a document has to do at an anchor: remove its whole span, offer its windows to others, or look its windows up as well.
REMOVE, OFFER, LOOK_UP = 1, 2, 3


class Seeds:
    """Anchors of the texts of a slice: for each, its text, its hash, its span's hash, and the span's first and last window."""

    def __init__(self, texts: pa.Array, window: int, k: int) -> None:
        self.words: Words = words(texts)
        self.word = self.words.hashes()
        self.window = window
        self.runs = Runs(self.word)
        w = self.words
        n = np.maximum(w.count - window + 1, 0)
        begin = np.repeat(w.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        if not len(begin):
            self.text = self.low = self.high = np.zeros(0, np.int64)
            self.anchor = self.span = np.zeros(0, U)
            return
        run = np.arange(len(self.word) - k + 1)
        hashes = self.runs(run, run + k)
        least, at = hashes[begin], begin.copy()
        for o in range(1, window - k + 1):
            here = hashes[begin + o]
            better = here <= least
            least[better] = here[better]
            at[better] = begin[better] + o
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        at = at[first]
        self.low, self.high = begin[first], begin[np.r_[first[1:], len(begin)] - 1]
        self.anchor = least[first]
        self.span = mix(self.runs(self.low, self.high + window) + (at - self.low).astype(U) * U(0x9E3779B97F4A7C15))
        self.text = np.searchsorted(w.first, at, side="right") - 1

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of some spans: the span's place in `which`, and the window's first word."""
        n = self.high[which] - self.low[which] + 1
        of = np.repeat(np.arange(len(which)), n)
        return of, self.low[which][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def ids(column: pa.Array) -> np.ndarray:
    """Null ids are larger than all others."""
    return pc.fill_null(column, LAST).to_numpy(zero_copy_only=False)


def kept(text: str | None, covered: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Numbers of words and of removed words, and the digest of the others; covered: begin and end of repeats in words."""
    own = (text or "").encode().split()
    n = len(own)
    if covered:
        keep = np.ones(n, bool)
        for a, b in covered:
            keep[a:b] = False
        own = [w for w, k in zip(own, keep.tolist(), strict=True) if k]
    return n, n - len(own), hashlib.sha256(b" ".join(own)).hexdigest()


def anchor_summary(rows: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each anchor of two documents or more: its first document, and whether its spans are all equal."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in slices(batch, "text"):
            s = Seeds(own.column("text"), window, k)
            doc = ids(own.column("id"))[s.text]
            order = np.argsort(s.anchor, kind="stable")
            anchor, span, doc = s.anchor[order], signed(s.span[order]), doc[order]
            at = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
            if len(at):
                yield pa.RecordBatch.from_pydict({"anchor": signed(anchor[at]), "lo": np.minimum.reduceat(doc, at), "hi": np.maximum.reduceat(doc, at), "span_lo": np.minimum.reduceat(span, at), "span_hi": np.maximum.reduceat(span, at)})

    found = by_arrow(rows, run, "anchor bigint, lo bigint, hi bigint, span_lo bigint, span_hi bigint")
    summary = found.groupBy("anchor").agg(*(f(c).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"), (F.min, "span_lo"), (F.max, "span_hi"))))
    return summary.where("lo < hi").select("anchor", "lo", (F.col("span_lo") == F.col("span_hi")).alias("uniform"))


def tasks(rows: DataFrame, shared: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document that shares an anchor: what to do at which of its spans; and the stored table behind it.

    A span that an earlier document has as it is goes. Of spans that differ at their anchor, only the first document offers its windows and,
    unless it is the anchor's first, looks them up."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in slices(batch, "text"):
            s = Seeds(own.column("text"), window, k)
            pair = np.unique(np.c_[s.text, signed(s.anchor), signed(s.span)], axis=0) if len(s.text) else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_pydict({"doc": ids(own.column("id"))[pair[:, 0]], "anchor": pair[:, 1], "span": pair[:, 2]})

    met = stored(by_arrow(rows, run, "doc bigint, anchor bigint, span bigint").join(shared, "anchor").where("doc > lo or not uniform"), "met")
    same = met.where("uniform").select("doc", "span", F.lit(REMOVE).alias("todo"))
    mixed = met.where("not uniform").withColumn("at", F.struct("anchor", "span"))
    first = mixed.groupBy("anchor", "span").agg(F.min("doc").alias("first")).select(F.struct("anchor", "span").alias("at"), "first")
    todo = F.when(F.col("doc") > F.col("first"), REMOVE).when(F.col("doc") > F.col("lo"), LOOK_UP).otherwise(OFFER)
    every = same.unionByName(mixed.join(first, "at").select("doc", "span", todo.alias("todo")))
    return every.groupBy("doc").agg(F.collect_list("span").alias("spans"), F.collect_list("todo").alias("todos")), met


STATE = "doc_id bigint, doc bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string, covered array<int>, offered array<int>, h1 array<bigint>, h2 array<bigint>"


def extended(rows: DataFrame, todo: DataFrame, window: int, k: int) -> DataFrame:
    """Documents with all repeats removed that are known by now. Those with windows to look up keep their text; offered: their first words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in slices(batch, "text"):
            s = Seeds(own.column("text"), window, k)
            doc, texts = ids(own.column("id")), own.column("text").to_pylist()
            at = np.searchsorted(s.text, np.arange(len(own) + 1))
            other_runs = Runs(mix(s.word ^ U(0x5851F42D4C957F2D)))
            out: dict[str, list] = {c.split()[0]: [] for c in STATE.split(", ")}
            for i in range(len(own)):
                covered, offered, h1, h2, look = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), [], [], False
                if own.column("spans")[i].is_valid:
                    listed = own.column("spans")[i].values.to_numpy()
                    what = own.column("todos")[i].values.to_numpy()
                    order = np.argsort(listed)
                    listed, what = listed[order], what[order]
                    mine = np.arange(at[i], at[i + 1])
                    span = signed(s.span[mine])
                    place = np.minimum(np.searchsorted(listed, span), len(listed) - 1)
                    act = np.where(listed[place] == span, what[place], 0)
                    first = s.words.first[i]
                    gone = mine[act == REMOVE]
                    covered = np.c_[s.low[gone] - first, s.high[gone] + window - first]
                    other = mine[act >= OFFER]
                    if len(other):
                        look = bool((act == LOOK_UP).any())
                        _, begin = s.windows(other)
                        h1, h2 = (signed(r(begin, begin + window)).tolist() for r in (s.runs, other_runs))
                        offered = begin - first
                n, removed, digest = (int(s.words.count[i]), None, None) if look else kept(texts[i], covered.tolist())
                for c, v in zip(out, (own.column("id")[i].as_py(), int(doc[i]), n, removed, digest, texts[i] if look else None, covered.ravel().tolist(), offered.tolist(), h1, h2), strict=True):
                    out[c].append(v)
            kinds = {"covered": pa.list_(pa.int32()), "offered": pa.list_(pa.int32()), "h1": pa.list_(pa.int64()), "h2": pa.list_(pa.int64()), "text": pa.string(), "kept_sha256": pa.string()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    met = rows.join(todo, F.coalesce(rows["id"], F.lit(int(LAST))) == todo["doc"], "left")
    return by_arrow(met.select("id", "text", "spans", "todos"), run, STATE)


def finished(state: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for row in batch.to_pylist():
            covered = list(zip(row["covered"][::2], row["covered"][1::2], strict=True)) + [(a, a + window) for a in row["starts"] or []]
            out.append((row["doc_id"], *kept(row["text"], covered)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    pending = state.where("kept_sha256 is null").select("uid", "doc_id", "text", "covered").join(starts, "uid", "left").drop("uid")
    return by_arrow(pending, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """A row for each input row: id, n_words, n_removed, kept_sha256.

    A word goes if a window of `window` words covers it whose words also stand in a document with a smaller id. Null and
    empty texts have no words; texts shorter than a window lose nothing. Repeated rows are one document and don't lose words to each
    other; a null id is larger than any other. An empty table gives an empty result. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    shared = stored(anchor_summary(rows, window, anchor), "anchors")
    each, met = tasks(rows, shared, window, anchor)
    todo = stored(each, "anchor-tasks")
    discard(shared, met)  # all that they said is in the tasks
    state = stored(extended(rows, todo, window, anchor).withColumn("uid", F.monotonically_increasing_id()), "extended")
    offers = state.where(F.size("offered") > 0).select("uid", "doc", F.col("kept_sha256").isNull().alias("looks"), F.explode(F.arrays_zip("offered", "h1", "h2")).alias("w"))
    offers = offers.select("uid", "doc", "looks", F.col("w.offered").alias("start"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    first = offers.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select(F.struct("h1", "h2").alias("at"), "lo")
    hit = offers.where("looks").select("uid", "doc", "start", F.struct("h1", "h2").alias("at")).join(first, "at").where("doc > lo")
    starts = hit.groupBy("uid").agg(F.collect_list("start").alias("starts"))
    done = state.where("kept_sha256 is not null").select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(finished(state, starts, window)).withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
     first_doc AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first_doc USING (s) WHERE lo < doc_id),
     word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
     agg AS (SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS kept
             FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
"""
