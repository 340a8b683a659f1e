import hashlib
import math

import duckdb
import numpy as np
import pytest

from foliant.llm import vector_codes
from foliant.llm.vector_codes import Books, assigned, compressed

FIELDS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, rounds=6):
    """Lloyd's rounds in Python's integers, every part against every entry."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    parts = [[v[p * w : (p + 1) * w] for p in range(8)] for _, v, _ in kept]
    books = [[parts[k][p] for k in range(min(16, len(kept)))] for p in range(8)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [[min(range(len(books[p])), key=lambda k: (d2(v[p], books[p][k]), k)) for p in range(8)] for v in parts]

    for _ in range(rounds):
        codes = nearest()
        for p in range(8):
            for k in range(len(books[p])):
                own = [v[p] for v, c in zip(parts, codes, strict=True) if c[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = nearest()
    errors = [sum(d2(v[p], books[p][c[p]]) for p in range(8)) for v, c in zip(parts, codes, strict=True)]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in c), e, by_label[label], sha) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(n, d, seed, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, d)) if grid is None else rng.integers(-grid, grid + 1, (n, d)) / 4096
    return [(i, [float(np.float32(v)) for v in row], int(i % 5) if i % 7 else None) for i, row in enumerate(x)]


@pytest.mark.parametrize(("n", "d", "grid"), [(300, 16, None), (300, 8, 2), (200, 16, 1), (9, 24, None)])
def test_equals_brute_force(spark, n, d, grid):
    """Small grids make ties, repeated entries and unused ones."""
    rows = vectors(n, d, n + d, grid)
    assert rows_of(compressed(spark.createDataFrame(rows, FIELDS).repartition(3))) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 8, 3) + [(100, None, 1), (101, [nan] * 8, 1), (102, [0.0] * 7 + [inf], 1), (103, [None] * 8, None), (5, [0.25] * 8, 2), (5, [0.25] * 8, 2), (None, [0.1] * 8, None)]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS code", "2 AS error", "3 AS at", "4 AS components", "5 AS high").repartition(3)
    assert rows_of(compressed(df)) == brute(rows)


def test_other_dimensions_have_no_code(spark):
    rows = vectors(20, 8, 4)
    got = rows_of(compressed(spark.createDataFrame([*rows, (50, [0.5] * 16, 1), (51, [], 77)], FIELDS)))
    odd = [r for r in got if r[0] in (50, 51)]
    assert [r[:3] for r in odd] == [(50, None, None), (51, None, None)] and [r for r in got if r[0] < 50] == brute(rows) and odd[1][3] is None
    assert rows_of(compressed(spark.createDataFrame([(1, [1.0] * 9, 0)], FIELDS)))[0][1:3] == (None, None)


def test_no_rows(spark):
    assert rows_of(compressed(spark.createDataFrame([], FIELDS))) == [] and rows_of(compressed(spark.createDataFrame([(1, None, 0)], FIELDS))) == []
    assert rows_of(compressed(spark.createDataFrame([(1, [0.5] * 8, None)], FIELDS))) == brute([(1, [0.5] * 8, None)])


def test_large_components_stay_exact(spark):
    rows = [(i, [v * (1 + j % 3) for v in row], label) for j, (i, row, label) in enumerate(vectors(60, 8, 6))]
    rows = [(i, [float(np.float32(v * 2.0**30)) for v in row], label) for i, row, label in rows]
    expected = [(*r[:2], min(r[2], 2**63 - 1), min(r[3], 2**63 - 1), r[4]) for r in brute(rows)]
    assert rows_of(compressed(spark.createDataFrame(rows, FIELDS))) == expected


def test_bounds_skip_scans_and_never_change_a_code():
    """Clustered parts: after the first rounds most keep their entries by bounds alone, with the codes of full scans."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (16, 8, 4))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-40, 41, (2000, 8, 4))
    books = Books.of(centres.transpose(1, 0, 2) + 7)
    code, upper, lower = np.zeros((2000, 8), np.int64), np.full((2000, 8), np.inf, np.float32), np.full((2000, 8), -np.inf, np.float32)
    scans = []
    for step in range(5):
        scans.append(assigned(x, books, code, upper, lower))
        full = np.stack([((x[:, p, None] - books.entries[p][None]) ** 2).sum(-1).argmin(1) for p in range(8)], 1)
        assert (code == full).all()
        books = Books.of(books.entries - (1 if step % 2 else 3), books.entries)
    assert scans[0] == 16_000 and sum(scans[1:]) < 100


def test_equal_distances_are_scanned():
    """Two entries at one distance: bounds are equal, not strictly apart, and the lower index stays."""
    x = np.zeros((1, 8, 1), np.int64)
    books = Books.of(np.tile(np.array([[[5], [-5]]]), (8, 1, 1)))
    code, upper, lower = np.ones((1, 8), np.int64), np.full((1, 8), 5, np.float32), np.full((1, 8), 5, np.float32)
    assert assigned(x, books, code, upper, lower) == 8 and not code.any()


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = vector_codes.query(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    sql = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vector_codes.ORACLE_SQL})").fetchall()
    assert rows_of(got) == sorted(sql, key=str)


def test_few_scans_on_the_table(spark):
    counts = []
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    compressed(df, counts=counts)
    assert counts[0] == 500 * 8 and len(counts) == 6 and counts[-1] <= counts[0]
