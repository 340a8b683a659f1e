import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.llm import bucket_histogram as bh

SCHEMA = "grp string, batch int, x bigint, c bigint"


def brute_pack(units):
    """Buckets [low, high, count] of disjoint units (low, high, count) in order, one after the other."""
    n, d, before, out, last = sum(u[2] for u in units), len(units), 0, [], None
    w, r = -(-n // bh.WINDOWS), -(-d // bh.RANKS)
    for rank, (low, high, c) in enumerate(units):
        key = (before // w, rank // r, c >= w)
        if key == last:
            out[-1][1:] = [high, out[-1][2] + c]
        else:
            out.append([low, high, c])
        last, before = key, before + c
    return out


def brute_merge(summaries):
    buckets = [b for s in summaries for b in s]
    units = Counter()
    for k, (low, high, c) in enumerate(buckets):
        meets = any(j != k and b[0] <= high and low <= b[1] for j, b in enumerate(buckets))
        if meets and low < high:
            units[low, low] += c - c // 2
            units[high, high] += c // 2
        else:
            units[low, high] += c
    return brute_pack([(*k, c) for k, c in sorted(units.items())])


def brute_report(values):
    """values: {grp: {batch: [x, ...]}}."""
    out = []
    for grp, batches in values.items():
        own = {b: brute_pack([(x, x, c) for x, c in sorted(Counter(xs).items())]) for b, xs in batches.items()}
        own[-1] = brute_merge(list(own.values()))
        for b, summary in own.items():
            xs = sorted(sum(batches.values(), []) if b < 0 else batches[b])
            if len(xs) < 20:
                continue
            for i in range(1, 10):
                t, before = -(-i * len(xs) // 10), 0
                for low, high, c in summary:
                    if t <= before + c:
                        break
                    before += c
                answer = low if 2 * (t - before) <= c else high
                below, upto = sum(x < answer for x in xs), sum(x <= answer for x in xs)
                off = max(0, below + 1 - t, t - upto)
                out.append((grp, b, i, len(xs), t, xs[t - 1], len(summary), answer, below, upto, off, 1000 * off <= 50 * len(xs)))
    return sorted(out)


def table(spark, values):
    counts = Counter((g, b, x) for g, batches in values.items() for b, xs in batches.items() for x in xs)
    return spark.createDataFrame([(*k, c) for k, c in counts.items()], SCHEMA).repartition(5)


def draws(seed, n, kind):
    rng = random.Random(seed)
    make = {
        "even": lambda: rng.randrange(-5000, 5000),
        "few": lambda: rng.choice([1, 2, 3, 3, 3, 3, 900]),
        "tail": lambda: int(rng.paretovariate(0.6) * 100),
        "heavy": lambda: 7 if rng.random() < 0.97 else rng.randrange(10_000),
        "same": lambda: 5,
    }[kind]
    return [make() for _ in range(n)]


def test_whole_report_equals_brute_force(spark):
    values = defaultdict(dict)
    for k, kind in enumerate(["even", "few", "tail", "heavy", "same"]):
        for b in range(8):
            values[kind][b] = [x + 1000 * b for x in draws(10 * k + b, 40 + 90 * b, kind)]
    values["shifted"] = {b: [x + 8000 * b for x in draws(b, 300, "even")] for b in range(3)}
    values["small"] = {0: [1, 2], 1: list(range(18))}
    values["tiny"] = {0: [3] * 19}
    got = sorted(tuple(r) for r in bh.report(table(spark, values), ["grp"]).collect())
    assert got == brute_report(values)
    assert all(r[-1] for r in got) and {r[0] for r in got} == set(values) - {"tiny"}


@pytest.mark.parametrize("kind", ["even", "few", "tail", "heavy", "same"])
@pytest.mark.parametrize("n", [20, 127, 129, 255, 383, 1000, 6007])
def test_sizes_and_errors_hold(kind, n):
    """The limits on points and the bound of the error, for one summary and for eight merged ones."""
    parts = [draws(k, n, kind) for k in range(8)]
    parts = [[x + 1000 * k for x in p] for k, p in enumerate(parts)]
    own = [brute_pack([(x, x, c) for x, c in sorted(Counter(p).items())]) for p in parts]
    for summary, xs in [*zip(own, parts, strict=True), (brute_merge(own), sum(parts, []))]:
        assert min(4, len(set(xs))) <= len(summary) <= min(len(xs), 400)
        assert sum(b[2] for b in summary) == len(xs) and all(a[1] < b[0] for a, b in zip(summary, summary[1:], strict=False))
        xs, before = sorted(xs), 0
        for low, high, c in summary:
            for t in (before + 1, before + c):
                for answer in (low, high):
                    off = max(0, sum(x < answer for x in xs) + 1 - t, t - sum(x <= answer for x in xs))
                    assert 1000 * off <= 50 * len(xs)
            before += c


def test_merging_again_and_disjoint_buckets(spark):
    """Summaries that overlap nowhere lose nothing, and merging is of one form: what is merged can be merged."""
    values = {"g": {b: [x + 100_000 * b for x in draws(b, 500, "even")] for b in range(4)}}
    cumulative = bh.cumulated(table(spark, values), ["grp"])
    parts = bh.summarised(cumulative, ["grp", "batch"])
    buckets = {(r.low, r.high): r["count"] for r in parts.collect()}
    halves = bh.merged(parts.withColumn("half", F.col("batch") % 2), ["grp", "half"])
    again = bh.merged(halves, ["grp"]).collect()
    assert sum(r["count"] for r in again) == 2000 and all(r.n == 2000 for r in again)
    once = bh.merged(parts, ["grp"]).collect()
    lows, highs = {k[0] for k in buckets}, {k[1] for k in buckets}
    assert all(r.low in lows and r.high in highs for r in once)
    for r in once:
        assert r["count"] == sum(c for (low, high), c in buckets.items() if r.low <= low and high <= r.high)


def test_no_rows_and_nulls(spark):
    assert bh.report(spark.createDataFrame([], SCHEMA), ["grp"]).count() == 0
    clicks = spark.createDataFrame([(1, 7, 2.5), (1, 7, 2.5), (2, None, 1.0), (3, 7, None), (4, 7, float("nan")), (5, 7, float("inf")), (None, 7, -2.5)], "click_id bigint, client_id bigint, value double")
    lines = spark.createDataFrame([(1, 9), (1, 9), (None, 9), (2, 9), (3, 9), (99, 9), (1, None)], "item_id bigint, vendor_id bigint")
    items = spark.createDataFrame([(1, "b", 3.0), (2, None, 3.0), (3, "b", None)], "item_id bigint, brand string, price double")
    got = sorted(tuple(r) for r in bh.shop_values(clicks.selectExpr("*", "1 AS x", "2 AS c", "3 AS batch"), lines.selectExpr("*", "'y' AS brand", "0.5D AS price"), items).collect())
    batch = lambda s: zlib.crc32(s.encode()) % 8
    x = lambda money, b: math.floor(100 * money + 0.5) + 1000 * b
    expected = [("value", "7", batch("1"), x(2.5, batch("1")), 1), ("value", "7", batch(""), x(-2.5, batch("")), 1), ("price", "b", batch("9"), x(3.0, batch("9")), 2), ("price", "b", batch(""), x(3.0, batch("")), 1)]
    assert got == sorted(expected)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = bh.query(spark, sf)
    con = duckdb.connect()
    for t in ("clicks", "sale_lines", "items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = con.execute(f"SELECT {', '.join(got.columns)} FROM ({bh.ORACLE_SQL})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(sql) and len(rows) > 1000 and all(r[-1] for r in rows)
