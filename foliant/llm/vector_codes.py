"""Compresses vectors to one code a part, with codebooks by Lloyd's rounds in integers and Hamerly's bounds.

Each part keeps, from round to round, an upper bound of the distance to its entry and a lower bound of that to the second nearest one.
As long as the upper bound is strictly below, the entry is the only nearest one, and nothing is computed; else all entries are compared
in exact integers. Bounds are stored as 32-bit floats rounded outwards, which covers the rounding of all that made them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import discard, read, rejoin_key, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 2**63 - 1
#: Rows whose distances to all entries are in memory at once.
ROWS_AT_ONCE = 2048


def above(x: np.ndarray) -> np.ndarray:
    """32-bit floats strictly above x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def integers(components: np.ndarray, width: int) -> np.ndarray:
    """The same numbers in a type in which squared distances are exact: 64 bits if they fit, else Python's integers."""
    most = max(int(components.max(initial=0)), -int(components.min(initial=0)))
    return components if 4 * most * most * max(width, 1) <= LARGEST else components.astype(object)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    d = x - y
    return (d * d).sum(-1)


def roots(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


@dataclass
class Books:
    """The codebooks of a round, and how far their entries have moved since the round before. entries: [part, entry, position]."""

    entries: np.ndarray
    moves: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Books:
        entries = integers(entries, entries.shape[-1])
        return cls(entries, np.zeros(entries.shape[:2]) if before is None else above(roots(squared(entries, before))).astype(np.float64))

    def others(self) -> np.ndarray:
        """For each entry, the longest move of any other entry of its part."""
        k = self.moves.shape[1]
        spread = np.repeat(self.moves[:, None, :], k, 1)
        spread[:, np.arange(k), np.arange(k)] = 0
        return spread.max(-1, initial=0)

    def halves(self) -> np.ndarray:
        """For each entry, less than half its distance to the nearest other one: what is closer than that has no other nearest entry."""
        e = self.entries
        apart = np.array([[[squared(a, b) for b in part] for a in part] for part in e], dtype=object).astype(np.float64)
        k = e.shape[1]
        apart[:, np.arange(k), np.arange(k)] = np.inf
        return below(np.sqrt(apart.min(-1)) / 2).astype(np.float64)


def assigned(x: np.ndarray, books: Books, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Updates code, upper and lower of all parts in place, and returns how many parts needed all distances. x: [row, part, position]."""
    others, halves = books.others(), books.halves()
    scanned = 0
    for p, entries in enumerate(books.entries):
        own, up, low = code[:, p], upper[:, p].astype(np.float64), lower[:, p].astype(np.float64)
        upper[:, p] = above(up + books.moves[p, own])
        lower[:, p] = below(low - others[p, own])
        safe = np.maximum(lower[:, p].astype(np.float64), halves[p, own])
        open_ = np.flatnonzero(~(upper[:, p] < safe))
        finite = open_[np.isfinite(upper[open_, p])]
        if len(finite):
            upper[finite, p] = above(roots(squared(x[finite, p], entries[code[finite, p]])))
            open_ = open_[~(upper[open_, p] < safe[open_])]
        scanned += len(open_)
        for at in range(0, len(open_), ROWS_AT_ONCE):
            rows = open_[at : at + ROWS_AT_ONCE]
            d2 = squared(x[rows, p][:, None, :], entries[None])
            best = d2.argmin(1)  # the first of equals
            each = np.arange(len(rows))
            code[rows, p] = best
            upper[rows, p] = above(roots(d2[each, best]))
            if d2.shape[1] > 1:
                d2 = d2.astype(np.float64)
                d2[each, best] = np.inf
                lower[rows, p] = below(np.sqrt(d2.min(1)))
            else:
                lower[rows, p] = np.inf
    return scanned


def shaped(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("components").flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(batch.num_rows, PARTS, width), width)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), kind), x.shape[1]).cast(pa.list_(kind))


def state_of(batch: pa.RecordBatch, n_entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    if "code" not in batch.schema.names:
        return np.zeros((n, PARTS), np.int64), np.full((n, PARTS), np.inf, np.float32), np.full((n, PARTS), -np.inf, np.float32)
    code, upper, lower = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS) for c in ("code", "upper", "lower"))
    return code.astype(np.int64), upper.copy(), lower.copy()


def one_round(vectors: DataFrame, books: Books, width: int) -> DataFrame:
    """The vectors with new codes and bounds, stored; and, as rows of their own (high and low halves of each number, whose other columns are null),
    every task's sums and counts by part and entry, with the number of parts scanned after them."""
    n_entries = books.entries.shape[1]
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id bigint, label {label}, components array<bigint>, code array<tinyint>, upper array<float>, lower array<float>, high array<bigint>, low array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scanned = np.zeros((PARTS, n_entries, width + 1), object), 0
        names = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = shaped(batch, width)
            code, upper, lower = state_of(batch, n_entries)
            scanned += assigned(x, books, code, upper, lower)
            for p in range(PARTS):
                own = np.zeros((n_entries, width + 1), x.dtype)
                np.add.at(own, code[:, p], np.concatenate([x[:, p], np.ones((n, 1), x.dtype)], 1))
                sums[p] += own
            nulls = pa.nulls(n, pa.list_(pa.int64()))
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("components"), lists(code, pa.int8()), lists(upper, pa.float32()), lists(lower, pa.float32()), nulls, nulls]
            names = ["vec_id", "label", "components", "code", "upper", "lower", "high", "low"]
            kinds = [c.type for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names)
        if names:
            flat = [*sums.reshape(-1), scanned]
            halves = [[int(v) >> 32 for v in flat], [int(v) & 0xFFFFFFFF for v in flat]]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:6]), *(pa.array([h], pa.list_(pa.int64())) for h in halves)], names)

    return stored(vectors.mapInArrow(run, schema), "vector-codes")


def moved(state: DataFrame, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """Codebooks of the next round: the floor of each entry's mean, and unused entries as they were; and the number of parts scanned.

    What comes to the driver are sums of the codebooks' size, added up by Spark."""
    found = state.where("high IS NOT NULL").select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "v")).groupBy("at").agg(F.sum("v.high").alias("high"), F.sum("v.low").alias("low")).collect()
    shape = (*entries.shape[:2], entries.shape[2] + 1)
    total = np.zeros(int(np.prod(shape)) + 1, object)
    for r in found:
        total[r["at"]] = (r["high"] << 32) + r["low"]
    total, scanned = total[:-1].reshape(shape), total[-1]
    new = entries.astype(object).copy()
    for p, k in zip(*np.nonzero(total[..., -1]), strict=True):
        new[p, k] = [s // total[p, k, -1] for s in total[p, k, :-1]]
    return new.astype(np.int64), scanned


def coded(vectors: DataFrame, books: Books, width: int) -> DataFrame:
    """The last assignment: code, two hex digits a part, and error, at most what a long holds."""
    n_entries = books.entries.shape[1]
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = shaped(batch, width)
            code, upper, lower = state_of(batch, n_entries)
            assigned(x, books, code, upper, lower)
            error = sum(squared(x[:, p], entries[code[:, p]]).astype(object) for p, entries in enumerate(books.entries))
            texts = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts), pa.array([min(int(e), LARGEST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint")


def books_sha256(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in entries.reshape(-1)).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, counts: list[int] | None = None) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each row of vectors (vec_id, embedding, label) without null or non-finite components.

    The dimension is that of the row with the smallest vec_id (null last, then by components); rows of another one, and all rows if it is
    no multiple of the parts, have a null code and error. With fewer rows than entries there are fewer entries, and without rows no result.
    Repeated rows count each. Components beyond 64 bits are cut to them; error and label_error to what a long holds.
    counts, if given, gets the number of parts of each round that bounds did not settle."""
    spark = vectors.sparkSession
    kept = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    kept = stored(kept.select(F.col("vec_id").cast("bigint"), "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("components")), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), "components"]
    first = kept.orderBy(*order).limit(1).collect()
    dimension = len(first[0]["components"]) if first else 0
    width, rest = divmod(dimension, PARTS)
    fits = (F.size("components") == dimension) & F.lit(rest == 0)
    good = kept.where(fits)
    begin = good.orderBy(*order).limit(entries).collect() if first and not rest else []
    label = kept.schema["label"].dataType.simpleString()
    odd = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not begin:
        found, sha = odd, books_sha256(np.zeros(0))
    else:
        books = Books.of(np.array([r["components"] for r in begin], np.int64).reshape(len(begin), PARTS, width).transpose(1, 0, 2))
        state = good
        for _ in range(rounds):
            after = one_round(state, books, width)
            if state is not good:
                discard(state)
            entries_, scanned = moved(after, books.entries)
            if counts is not None:
                counts.append(scanned)
            books, state = Books.of(entries_, books.entries), after.where("high IS NULL").select("vec_id", "label", "components", "code", "upper", "lower")
        last = coded(state, books, width)
        found, sha = last.unionByName(odd), books_sha256(books.entries)
    found = stored(found, "codes")
    if begin and rounds:
        discard(state)
    big = F.col("error").cast("decimal(38,0)")
    sums = found.groupBy("label").agg(F.when(F.sum(big) > LARGEST, LARGEST).otherwise(F.sum(big)).cast("bigint").alias("label_error"))
    sums = sums.select(rejoin_key("label").alias("at"), "label_error")
    out = found.select("vec_id", "code", "error", rejoin_key("label").alias("at")).join(sums, "at")
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _oracle() -> str:
    """The rounds as a chain of tables, every part against every entry."""
    nearest = """SELECT vec_id, label, p, x, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM (
        SELECT t.vec_id, t.label, t.p, t.x, c.k, list_sum(list_transform(list_zip(t.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts t JOIN c{r} c ON c.p = t.p
    ) GROUP BY vec_id, label, p, x"""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * (len(v) // 8) + 1, (p + 1) * (len(v) // 8)) AS x FROM kept, (SELECT unnest(range(8)) AS p))",
        "c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x FROM parts QUALIFY k < 16)",
    ]
    for r in range(ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED ({nearest.format(r=r)})",
            f"m{r} AS MATERIALIZED (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT p, k, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (p, k))",
        ]
    steps += [
        f"a{ROUNDS} AS MATERIALIZED ({nearest.format(r=ROUNDS)})",
        f"books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{ROUNDS})",
        f"codes AS MATERIALIZED (SELECT vec_id, label, string_agg(lpad(printf('%x', k), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes, books"


ORACLE_SQL = _oracle()
