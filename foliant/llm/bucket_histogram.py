"""Mergeable summaries of distributions: histograms of disjoint buckets (low, high, count), packed greedily.

Distinct values with their counts go into a bucket as long as the count before them lies in one window of the cumulative count (and their
rank in one window of ranks, so that no summary gets too coarse); a value as heavy as a window stands alone and is exact. Bounds are
values of the data. To merge, buckets that overlap no other stay whole, others become their two bounds with half of the count each,
and what results is packed again: so a rank is off by at most half of each bucket that is open there.

Everything is integers. The counts before values come from sums over sorted slices of about one partition each, so no task needs all values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.shared import discard, read, stored

#: Windows of the cumulative count, and of ranks, in a summary: at most twice the first and once the second are its buckets.
WINDOWS, RANKS = 128, 16
#: Permitted error of a rank in thousandths of the rows, batches, quantiles, and rows from which quantiles are asked for.
ERROR, BATCHES, PARTS, LEAST = 50, 8, 10, 20
#: The batch that stands for all of them.
WHOLE = -1


def div(a: Column, b: Column | int) -> Column:
    """The whole quotient of numbers that are not negative."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def at(*keys: str) -> Column:
    """Keys as one column, in which nulls are equal."""
    return F.struct(*keys)


def cumulated(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, batch, x, c: one row for each), stored with the places of x in its batch and in the whole key.

    In the batch: before, the sum of c over smaller x, rank (from 1), n, the sum of all, and d, the number of values. In the whole: whole_before,
    whole_upto, whole_n and first_batch, the first batch that has x. Rows are dealt by range, and what a partition has of a key is a slice; slices are
    summed, and sums added up from slice to slice."""
    dealt = stored(counts.select(*keys, "batch", "x", "c").repartitionByRange(*keys, "x").withColumn("slice", F.spark_partition_id()), "counts")
    parts = dealt.groupBy(*keys, "slice", "batch").agg(F.sum("c").alias("c"), F.count("*").alias("d"))
    of_batch, of_key = Window.partitionBy(*keys, "batch"), Window.partitionBy(*keys)
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_c": earlier(of_batch, "c"), "_d": earlier(of_batch, "d"), "n": F.sum("c").over(of_batch), "m": F.sum("d").over(of_batch)})
    slices = parts.groupBy(*keys, "slice").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("batch", F.struct("_c", "_d", "n", "m")))).alias("_of"))
    slices = slices.select(at(*keys, "slice").alias("_at"), "_of", earlier(of_key, "c").alias("_w"), F.sum("c").over(of_key).alias("whole_n"))
    placed = dealt.withColumn("_at", at(*keys, "slice")).join(slices, "_at").withColumn("_o", F.element_at("_of", F.col("batch")))
    own = Window.partitionBy("_at", "batch").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_at").orderBy("x")
    upto, equal = whole.rangeBetween(Window.unboundedPreceding, Window.currentRow), whole.rangeBetween(0, 0)
    placed = placed.withColumns({"_upto": F.col("_w") + F.sum("c").over(upto), "_equal": F.sum("c").over(equal), "first_batch": F.min("batch").over(equal)})
    placed = placed.withColumns({"_own": F.sum("c").over(own), "_rank": F.row_number().over(own)})
    columns = [(F.col("_o._c") + F.col("_own") - F.col("c")).alias("before"), (F.col("_o._d") + F.col("_rank")).alias("rank"), F.col("_o.n").alias("n"), F.col("_o.m").alias("d"), (F.col("_upto") - F.col("_equal")).alias("whole_before"), F.col("_upto").alias("whole_upto")]
    found = stored(placed.select(*keys, "batch", "x", "c", *columns, "whole_n", "first_batch"), "cumulated")
    discard(dealt)
    return found


def packed(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units (keys, low, high, c, before, rank, n, d; disjoint, in order of before) in buckets: keys, low, high, count, n."""
    window = div(F.col("n") + WINDOWS - 1, WINDOWS)
    ranks = div(F.col("d") + RANKS - 1, RANKS)
    places = [div(F.col("before"), window).alias("_window"), div(F.col("rank") - 1, ranks).alias("_ranks"), (F.col("c") >= window).alias("_heavy")]
    grouped = units.select(*keys, "low", "high", "c", "n", *places).groupBy(*keys, "_window", "_ranks", "_heavy")
    return grouped.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("c").alias("count"), F.max("n").alias("n")).drop("_window", "_ranks", "_heavy")


def summarised(cumulative: DataFrame, keys: list[str]) -> DataFrame:
    """A summary of each of keys (the batch among them) from cumulated(): keys, low, high, count, n. No bucket of several values has twice n / WINDOWS rows."""
    return packed(cumulative.withColumns({"low": F.col("x"), "high": F.col("x")}), keys)


def merged(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One summary for each of keys from all summaries that share it, of the same form.

    What meets in a task are the buckets of the summaries of one key; of very many summaries, merge some at a time, and what results again."""
    of_key = Window.partitionBy(*keys)
    in_order = of_key.orderBy("low", "high", "count")
    reached = F.max("high").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    overlaps = F.coalesce(reached >= F.col("low"), F.lit(False)) | F.coalesce(F.lead("low").over(in_order) <= F.col("high"), F.lit(False))
    unit = lambda low, high, c: F.struct(F.col(low).alias("low"), F.col(high).alias("high"), c.alias("c"))
    halves = F.array(unit("low", "low", F.col("count") - div(F.col("count"), 2)), unit("high", "high", div(F.col("count"), 2)))
    units = summaries.withColumn("_split", overlaps & (F.col("low") < F.col("high")))
    units = units.select(*keys, F.explode(F.when(F.col("_split"), halves).otherwise(F.array(unit("low", "high", F.col("count"))))).alias("u"))
    units = units.groupBy(*keys, "u.low", "u.high").agg(F.sum("u.c").alias("c"))
    upto = of_key.orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.withColumns({"before": F.sum("c").over(upto) - F.col("c"), "rank": F.row_number().over(of_key.orderBy("low")), "n": F.sum("c").over(of_key), "d": F.count("*").over(of_key)})
    return packed(units, keys)


def target(i: Column, n: Column, parts: int) -> Column:
    """ceil(i * n / parts)"""
    return div(i * n + parts - 1, parts)


def reached(parts: int, n: Column, before: Column, upto: Column) -> Column:
    """The numbers i of the quantiles whose target lies in (before, upto]: those with before < i * n / parts <= upto."""
    low, high = div(before * parts, n) + 1, F.least(F.lit(parts - 1), div(upto * parts, n))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("cast(array() as array<bigint>)")).cast("array<int>")


def quantiles(summaries: DataFrame, keys: list[str], parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """keys, n, points (buckets), i, target and answer, of summaries of at least `least` rows: the nearer bound of the bucket in which the target lies."""
    of_key = Window.partitionBy(*keys)
    upto = F.sum("count").over(of_key.orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = summaries.where(F.col("n") >= least).withColumns({"points": F.count("*").over(of_key), "_upto": upto})
    cut = cut.withColumn("_before", F.col("_upto") - F.col("count")).withColumn("i", F.explode(reached(parts, F.col("n"), F.col("_before"), F.col("_upto"))))
    cut = cut.withColumn("target", target(F.col("i"), F.col("n"), parts))
    low = 2 * (F.col("target") - F.col("_before")) <= F.col("count")
    return cut.select(*keys, "n", "points", "i", "target", F.when(low, F.col("low")).otherwise(F.col("high")).alias("answer"))


def judged(answers: DataFrame, cumulative: DataFrame, keys: list[str], parts: int = PARTS, error: int = ERROR) -> DataFrame:
    """answers (keys, batch, of which WHOLE is the whole key) with exact_x, n_below, n_upto, rank_error and within, from cumulated() of the same keys."""
    none = F.expr("cast(array() as array<int>)")
    first = F.col("batch") == F.col("first_batch")
    upto = F.col("before") + F.col("c")
    asked = cumulative.select(*keys, F.col("x").alias("exact_x"), "batch", reached(parts, F.col("n"), F.col("before"), upto).alias("_own"), F.when(first, reached(parts, F.col("whole_n"), F.col("whole_before"), F.col("whole_upto"))).otherwise(none).alias("_whole"))
    asked = asked.where((F.size("_own") > 0) | (F.size("_whole") > 0))
    tell = lambda batch, numbers: F.transform(numbers, lambda i: F.struct(batch.cast("int").alias("batch"), i.alias("i")))
    exact = asked.select(*keys, "exact_x", F.explode(F.concat(tell(F.col("batch"), "_own"), tell(F.lit(WHOLE), "_whole"))).alias("q")).select(at(*keys, "q.batch", "q.i").alias("_at"), "exact_x")
    places = cumulative.select(at(*keys, F.col("x").alias("answer")).alias("_place"), F.col("batch").alias("_batch"), "first_batch", F.col("before").alias("_before"), upto.alias("_upto"), "whole_before", "whole_upto")
    of_whole = F.col("batch") == WHOLE
    found = answers.withColumn("_place", at(*keys, "answer")).join(places, "_place").where(F.col("_batch") == F.when(of_whole, F.col("first_batch")).otherwise(F.col("batch")))
    found = found.withColumns({"n_below": F.when(of_whole, F.col("whole_before")).otherwise(F.col("_before")), "n_upto": F.when(of_whole, F.col("whole_upto")).otherwise(F.col("_upto"))})
    found = found.select(*answers.columns, "n_below", "n_upto", at(*keys, "batch", "i").alias("_at")).join(exact, "_at").drop("_at")
    off = F.greatest(F.lit(0), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return found.withColumn("rank_error", off).withColumn("within", 1000 * F.col("rank_error") <= error * F.col("n"))


def cents(money: Column, batch: Column) -> Column:
    return F.floor(money * 100 + 0.5) + 1000 * batch


def batch_of(id_: Column) -> Column:
    """By the CRC of the number's digits; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % BATCHES).cast("int")


def shop_values(clicks: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream, grp, batch, x and c of both streams; money that is no finite number counts as missing.

    Clicks of one id are repeats, of which one counts. Lines are counted by item and batch before they meet the items."""
    finite = lambda m: m.isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf"))
    once = clicks.groupBy("click_id").agg(F.first("client_id").alias("client_id"), F.first("value").alias("value")).select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch_of(F.col("click_id")).alias("batch"), F.col("value").alias("money"), F.lit(1).cast("bigint").alias("m"))
    sold = lines.where("item_id IS NOT NULL").groupBy("item_id", batch_of(F.col("vendor_id")).alias("batch")).agg(F.count("*").alias("m"))
    priced = sold.join(items.select("item_id", "brand", "price"), "item_id").select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", F.col("price").alias("money"), "m")
    rows = once.unionByName(priced).where(F.col("grp").isNotNull() & finite(F.col("money")))
    return rows.groupBy("stream", "grp", "batch", cents(F.col("money"), F.col("batch")).alias("x")).agg(F.sum("m").alias("c"))


def report(values: DataFrame, keys: list[str]) -> DataFrame:
    """values (keys, batch, x, c) summarised for each batch, the summaries merged into batch WHOLE, and quantiles of all of them held against the values."""
    every = [*keys, "batch"]
    cumulative = cumulated(values, keys)
    batches = stored(summarised(cumulative, every), "summaries")
    answers = quantiles(batches.unionByName(merged(batches, keys).withColumn("batch", F.lit(WHOLE))), every)
    columns = [*every, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within"]
    return judged(answers, cumulative, keys).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, lines, items = (read(spark, sf_dir, t) for t in ("clicks", "sale_lines", "items"))
    return report(stored(shop_values(clicks, lines, items), "values"), ["stream", "grp"])


def _crc(digits: str) -> str:
    """CRC-32 of a string of ASCII in SQL, half a byte at a time."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    half = lambda c: f"xor(({c}) >> 4, ([{', '.join(map(str, table))}]::BIGINT[])[(({c}) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({digits}, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {half(half('xor(a, b)'))}), 4294967295::BIGINT)"


def _pack(units: str, keys: str) -> str:
    return f"""SELECT {keys}, min(low) AS low, max(high) AS high, sum(c)::BIGINT AS count, max(n) AS n FROM {units}
    GROUP BY {keys}, "before" // ((n + {WINDOWS - 1}) // {WINDOWS}), (rank - 1) // ((d + {RANKS - 1}) // {RANKS}), c >= (n + {WINDOWS - 1}) // {WINDOWS}"""


ORACLE_SQL = f"""WITH raw AS (
    SELECT 'value' AS stream, client_id::VARCHAR AS grp, click_id AS id, value AS money FROM (SELECT DISTINCT click_id, client_id, value FROM clicks)
    UNION ALL SELECT 'price', brand, vendor_id, price FROM sale_lines JOIN items USING (item_id)
), batched AS (SELECT stream, grp, ({_crc("id::VARCHAR")} % {BATCHES})::INT AS batch, money FROM raw WHERE grp IS NOT NULL AND money IS NOT NULL AND isfinite(money)),
counts AS MATERIALIZED (SELECT stream, grp, batch, floor(money * 100 + 0.5)::BIGINT + 1000 * batch AS x, count(*) AS c FROM batched GROUP BY ALL),
every AS (SELECT * FROM counts UNION ALL SELECT stream, grp, -1, x, sum(c)::BIGINT FROM counts GROUP BY stream, grp, x),
cumulative AS MATERIALIZED (SELECT *, x AS low, x AS high, (sum(c) OVER (k ORDER BY x) - c)::BIGINT AS "before", row_number() OVER (k ORDER BY x) AS rank, (sum(c) OVER k)::BIGINT AS n, count(*) OVER k AS d FROM every WINDOW k AS (PARTITION BY stream, grp, batch)),
batches AS MATERIALIZED ({_pack("cumulative WHERE batch >= 0", "stream, grp, batch")}),
overlapping AS (SELECT *, coalesce(max(high) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= low, false) OR coalesce(lead(low) OVER k <= high, false) AS o FROM batches WINDOW k AS (PARTITION BY stream, grp ORDER BY low, high, count)),
units AS (SELECT stream, grp, low, high, sum(c)::BIGINT AS c FROM (
    SELECT stream, grp, low, high, count AS c FROM overlapping WHERE NOT (o AND low < high)
    UNION ALL SELECT stream, grp, low, low, count - count // 2 FROM overlapping WHERE o AND low < high
    UNION ALL SELECT stream, grp, high, high, count // 2 FROM overlapping WHERE o AND low < high) GROUP BY stream, grp, low, high),
placed AS (SELECT *, (sum(c) OVER (k ORDER BY low) - c)::BIGINT AS "before", row_number() OVER (k ORDER BY low) AS rank, (sum(c) OVER k)::BIGINT AS n, count(*) OVER k AS d FROM units WINDOW k AS (PARTITION BY stream, grp)),
whole AS ({_pack("placed", "stream, grp")}),
summaries AS (SELECT * FROM batches UNION ALL SELECT stream, grp, -1, low, high, count, n FROM whole),
cut AS (SELECT *, count(*) OVER k AS points, (sum(count) OVER (k ORDER BY low))::BIGINT AS upto FROM summaries WHERE n >= {LEAST} WINDOW k AS (PARTITION BY stream, grp, batch)),
asked AS (SELECT *, (i * n + {PARTS - 1}) // {PARTS} AS target FROM cut, (SELECT unnest(range(1, {PARTS}))::INT AS i)),
answers AS (SELECT stream, grp, batch, i, n, target, points, CASE WHEN 2 * (target - (upto - count)) <= count THEN low ELSE high END AS answer FROM asked WHERE target > upto - count AND target <= upto),
judged AS (SELECT a.stream, a.grp, a.batch, a.i, a.n, a.target, e.x AS exact_x, a.points, a.answer, p."before" AS n_below, p."before" + p.c AS n_upto FROM answers a
    JOIN cumulative e ON (e.stream, e.grp, e.batch) = (a.stream, a.grp, a.batch) AND a.target > e."before" AND a.target <= e."before" + e.c
    JOIN cumulative p ON (p.stream, p.grp, p.batch, p.x) = (a.stream, a.grp, a.batch, a.answer))
SELECT *, greatest(0, n_below + 1 - target, target - n_upto) AS rank_error, 1000 * greatest(0, n_below + 1 - target, target - n_upto) <= {ERROR} * n AS within FROM judged"""
