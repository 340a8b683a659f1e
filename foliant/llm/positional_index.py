"""Benchmark decontamination by a distributed positional inverted index.

The index is a table of segments. A segment holds the postings of about 2 MB of texts: its sorted terms, and each term's
positions. A search takes each test window's rarest term in a segment, shifts its list by the term's offset, and intersects
it with the shifted lists of the other terms, rarest first, for all windows at once. No text crosses the network, and a
common passage costs what its postings cost. Test items are sent to the segments in blocks of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bytewords import ALNUM, U, words
from foliant.llm.shared import by_arrow, read, slices, stored

WINDOW = 10
BLOCK_BYTES = 8 << 20
MOST_AT_ONCE = 1 << 20
WINDOWS_AT_ONCE = 1 << 17

INDEX_SCHEMA = "doc_ids array<bigint>, firsts binary, terms binary, counts binary, gaps binary"
HIT_SCHEMA = "segment string, place int, doc_id bigint, n_words bigint, spans array<int>, items array<string>"


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin."""
    w = words(texts, ALNUM, lower=True)
    return w.hashes(), w.first


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each segment: firsts are each text's first position, gaps the differences between positions sorted by term.
    A segment is a number, whatever it holds; it is fixed once the index is stored.

    Null texts have no words. Ids may be null or repeated: results are by row. Words: runs of ASCII letters (A-Z as a-z), ASCII digits and characters beyond ASCII."""

    def segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            term, first = term_hashes(part.column("text"))
            order = np.argsort(term, kind="stable").astype(np.uint32)
            ordered = term[order]
            at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(term) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_ids": pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), "firsts": [first.astype(np.uint32).tobytes()],
                "terms": [ordered[at].tobytes()], "counts": [np.diff(np.r_[at, len(term)]).astype(np.uint32).tobytes()], "gaps": [np.diff(order, prepend=np.uint32(0)).tobytes()],
            })

    rows = by_arrow(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), segments, INDEX_SCHEMA)
    return rows.select(F.monotonically_increasing_id().cast("string").alias("segment"), "*")


class Segment:
    def __init__(self, row: dict) -> None:
        self.doc_ids = row["doc_ids"]
        self.firsts = np.frombuffer(row["firsts"], np.uint32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], U)
        self.counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.at = np.cumsum(self.counts) - self.counts
        self.positions = np.cumsum(np.frombuffer(row["gaps"], np.uint32), dtype=np.uint32).astype(np.int64)
        #: Term's number and position in one sorted array: a look-up in it is a look-up in the term's list.
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.positions

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term here, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def holds(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = number << 32 | position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, position, side="right") - 1


@dataclass
class Windows:
    """All windows of `window` consecutive words of some items, and whole items of fewer words: the items' words in a row, and where each
    item's begin. Windows are spans of that row, worked out where they are searched for."""

    terms: np.ndarray
    first: np.ndarray
    window: int
    items: list[str | None]

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and item of each window."""
        n = np.diff(self.first)
        count = np.where(n > 0, np.maximum(n - self.window + 1, 1), 0)
        item = np.repeat(np.arange(len(n)), count)
        start = self.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        return start, np.minimum(n[item], self.window), item


    @cached_property
    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word and number of words of each different window, and its items: all in a row, and where each window's begin."""
        start, size, item = self.spans
        key = np.zeros((len(start), 2), U)
        for k in range(self.window):
            term = np.where(k < size, self.terms[np.minimum(start + k, max(len(self.terms) - 1, 0))], U(0)) if len(self.terms) else np.zeros(len(start), U)
            for j, factor in enumerate((U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))):
                key[:, j] = (key[:, j] ^ term) * factor ^ (key[:, j] >> U(29))
        order = np.lexsort((item, key[:, 1], key[:, 0], size))
        key, size, start, item = key[order], size[order], start[order], item[order]
        new = np.r_[True, (key[1:] != key[:-1]).any(1) | (size[1:] != size[:-1])] if len(start) else np.zeros(0, bool)
        kind = np.cumsum(new) - 1
        once = np.r_[True, (kind[1:] != kind[:-1]) | (item[1:] != item[:-1])] if len(start) else new
        return start[new], size[new], item[once], np.searchsorted(kind[once], np.arange(new.sum() + 1))


def windows_of(items: Sequence[str | None], texts: pa.Array, size: int) -> Windows:
    term, first = term_hashes(texts)
    return Windows(term, first.astype(np.int64), size, list(items))


def phrases(seg: Segment, w: Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows, by their number in w.distinct, and where they begin, for all exact occurrences within one text; at most about MOST_AT_ONCE candidates at a time."""
    start, sizes = w.distinct[:2]
    if not len(start) or not len(seg.terms):
        return
    number = seg.number(w.terms)
    missing = np.r_[0, np.cumsum(number < 0)]
    every = np.flatnonzero(missing[start + sizes] == missing[start])
    for alive in np.split(every, range(WINDOWS_AT_ONCE, len(every), WINDOWS_AT_ONCE)) if len(every) else ():
        size = int(sizes[alive].max())
        unused = np.arange(size) >= sizes[alive][:, None]
        own = number[np.minimum(start[alive][:, None] + np.arange(size), len(number) - 1)]
        df = np.where(unused, np.iinfo(np.int64).max, seg.counts[np.maximum(own, 0)])
        order = np.argsort(df, axis=1, kind="stable")
        rarest = np.take_along_axis(own, order[:, :1], 1)[:, 0]
        load = seg.counts[rarest]
        for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(np.cumsum(load) // MOST_AT_ONCE)) + 1):
            n = load[part]
            row = np.repeat(part, n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + seg.at[rarest[row]]
            begin = seg.positions[place] - order[row, 0]
            for k in range(1, size):
                at = order[row, k]
                ok = (begin >= 0) & (unused[row, at] | seg.holds(np.maximum(own[row, at], 0), begin + at))
                row, begin = row[ok], begin[ok]
            ok = begin >= 0
            row, begin = row[ok], begin[ok]
            ok = seg.text_of(begin) == seg.text_of(begin + sizes[alive[row]] - 1)
            yield alive[row[ok]], begin[ok]


def merged_spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of spans as sorted begin, end, begin, end .."""
    if not len(begin):
        return np.zeros(0, np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]]
    return np.c_[begin[new], end[np.r_[new[1:], True]]].ravel()


def search(index: DataFrame, w: Windows) -> DataFrame:
    """A row for each text: its hit spans in words, and the items with occurring windows.

    Hits are united as they are found, so that a task never holds more than a part of them, whatever repeats in a text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, sizes, owner, first = w.distinct
        for row in batch.to_pylist():
            seg = Segment(row)
            n = len(seg.doc_ids)
            # Places are moved on by one for each text before, so that spans of two texts never touch.
            begin, end, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
            for kind, at in phrases(seg, w):
                text = seg.text_of(at)
                both = merged_spans(np.r_[begin, at + text], np.r_[end, at + text + sizes[kind]])
                begin, end = both[::2], both[1::2]
                seen = np.unique(np.r_[seen, np.c_[text, kind]], axis=0)
            spans: list[list[int]] = [[] for _ in range(n)]
            items: list[set[str | None]] = [set() for _ in range(n)]
            of = np.searchsorted(seg.firsts[:n] + np.arange(n), begin, side="right") - 1
            for t, b, e in zip(of.tolist(), begin.tolist(), end.tolist(), strict=True):
                spans[t] += [b - t - int(seg.firsts[t]), e - t - int(seg.firsts[t])]
            for t, k in seen.tolist():
                items[t].update(w.items[i] for i in owner[first[k] : first[k + 1]])
            count = np.diff(seg.firsts)
            yield pa.RecordBatch.from_pydict({
                "segment": [row["segment"]] * n, "place": pa.array(range(n), pa.int32()), "doc_id": pa.array(seg.doc_ids, pa.int64()), "n_words": count,
                "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array([sorted(x, key=lambda i: (i is None, i)) for x in items], pa.list_(pa.string())),
            })

    return by_arrow(index, run, HIT_SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated, and hit_spans and items.

    A word is hit if an occurrence of a test window covers it; a window has `window` words, or all words of a shorter item.
    Null or empty texts have no words and no hits; items without words match nothing; items that share an id count once.
    Items without an id are searched too: their windows hit and contaminate, and together they are one item of n_items, as SQL counts, but have no name in items.
    Repeated rows of the benchmark are one. It is taken in blocks of about block_bytes of text, each sent to all segments as eight bytes a word, so that its size is no limit."""
    index = stored(build_index(docs, id_col, text_col), "positions")
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = None
    for b in range(blocks):
        own = (tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)).toArrow()
        hits = search(index, windows_of(own.column("item").to_pylist(), own.column("text").combine_chunks(), window))
        if blocks > 1:  # written at once, so that the driver holds one block's words at a time; of later blocks only what hits
            hits = stored(hits if b == 0 else hits.where("size(spans) > 0"), "block-hits")
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = found.withColumn("spans", united("spans"))
    items = F.array_sort(F.array_distinct("items"))
    hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0), lambda a, i: a + F.get("spans", i) * F.when(i % 2 == 0, -1).otherwise(1))
    return found.select(
        F.col("doc_id").alias(id_col), "n_words", F.when(F.size("spans") == 0, 0).otherwise(hit).cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.col("spans").alias("hit_spans"), F.array_compact(items).alias("items"),
    )


def united(column: str):
    """Union of the spans that several blocks found, as begin, end, begin, end .."""
    pairs = F.array_sort(F.transform(F.filter(F.transform(column, lambda x, i: F.struct(x.alias("b"), F.get(column, i + 1).alias("e"), i.alias("i"))), lambda p: p["i"] % 2 == 0), lambda p: F.struct(p["b"].alias("b"), p["e"].alias("e"))))

    def add(done, p):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (p["b"] <= last), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last, p["e"])))).otherwise(F.concat(done, F.array(p["b"], p["e"])))

    return F.aggregate(pairs, F.expr("cast(array() as array<int>)"), add)


def proximity(index: DataFrame, terms: Sequence[str], within: int) -> DataFrame:
    """Texts where all terms stand within `within` words of an occurrence of their rarest: segment, place, doc_id, positions of the rarest in the text."""
    wanted, _ = term_hashes(pa.array([" ".join(terms)], pa.string()))
    wanted = np.unique(wanted)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            seg = Segment(row)
            number = seg.number(wanted)
            if not len(wanted) or (number < 0).any():
                continue
            number = number[np.argsort(seg.counts[number], kind="stable")]
            lists = [seg.positions[seg.at[k] : seg.at[k] + seg.counts[k]] for k in number]
            at = lists[0]
            text = seg.text_of(at)
            for other in lists[1:]:
                lo = np.maximum(at - within, seg.firsts[text])
                hi = np.minimum(at + within, seg.firsts[text + 1] - 1)
                ok = np.searchsorted(other, lo) < np.searchsorted(other, hi, side="right")
                at, text = at[ok], text[ok]
            for t in np.unique(text):
                yield pa.RecordBatch.from_pydict({"segment": [row["segment"]], "place": pa.array([t], pa.int32()), "doc_id": pa.array([seg.doc_ids[t]], pa.int64()), "positions": pa.array([(at[text == t] - seg.firsts[t]).tolist()], pa.list_(pa.int32()))})

    return by_arrow(index, run, "segment string, place int, doc_id bigint, positions array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("hit_spans", "items")


ORACLE_SQL = r"""
WITH bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     sized AS (SELECT item, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
     tests AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS window_text FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
     dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
     found AS (SELECT d.doc_id, d.i, d.n, t.item
               FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS window_text
                     FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)) d
               JOIN tests t ON t.n = d.n AND t.window_text = d.window_text),
     hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
