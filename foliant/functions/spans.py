"""Spans of regular expressions in code points, with Spark's own functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths are summed in blocks, so that many spans in one text don't cost the square of their number.
SUMMED = 64


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str) -> Column:
    """What stands before, between and after the hits."""
    return F.split(text, pattern, -1)


def before(lengths: Column) -> Column:
    """For each length, the sum of those before it."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / SUMMED).cast("int") - 1), lambda b: F.slice(lengths, b * SUMMED + 1, SUMMED))
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + total(x))))
    inside = F.zip_with(parts, F.slice(starts, 1, F.size(starts) - 1), lambda x, s: F.transform(x, lambda v, i: s + total(F.slice(x, 1, i))))
    return F.when(F.size(lengths) > 0, F.flatten(inside)).otherwise(F.expr("cast(array() as array<int>)"))


def summed(x: Column) -> Column:
    """A struct of hits and gaps with the sums before() that spans() takes."""
    lengths = F.zip_with(x["hits"], F.slice(x["gaps"], 1, F.size(x["hits"])), lambda m, g: F.length(m) + F.length(g))
    return F.struct(x["hits"].alias("hits"), x["gaps"].alias("gaps"), before(lengths).alias("sums"))


def spans(found: Column) -> Column:
    """Structs of start, end (exclusive), the hit, the gap before it and the gap after it, of a struct of hits, gaps and the sums before()."""

    def one(m: Column, i: Column) -> Column:
        start = F.get(found["sums"], i) + F.length(F.get(found["gaps"], i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("hit"), F.get(found["gaps"], i).alias("left"), F.get(found["gaps"], i + 1).alias("right"))

    return F.transform(found["hits"], one)


def with_all_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column of spans() for each name: pattern and gate. A gate is implied by every hit; where it isn't true there are none.

    The patterns' hits become one array, so that the expressions which place them stand in the plan once, however many patterns there are."""
    names, texts = list(patterns), F.expr("cast(array() as array<string>)")
    hits_of = {n: f"{n}__hits" for n in names}
    df = df.withColumns({hits_of[n]: F.when(gate, hits(F.col(text), p)).otherwise(texts) for n, (p, gate) in patterns.items()})
    both = (F.struct(F.col(hits_of[n]).alias("hits"), F.when(F.size(hits_of[n]) > 0, gaps(F.col(text), p)).otherwise(texts).alias("gaps")) for n, (p, _) in patterns.items())
    df = df.withColumn("__found", F.array(*both)).drop(*hits_of.values())
    df = df.withColumn("__found", F.transform("__found", summed))
    df = df.withColumn("__found", F.transform("__found", spans))
    return df.withColumns({n: F.get("__found", F.lit(i)) for i, n in enumerate(names)}).drop("__found")


def joined(array: Column) -> Column:
    """kind:start:end of structs, comma-joined."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kind(array: Column, kind: str, order: int) -> Column:
    return F.transform(array, lambda x: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def number_of(array: str, kind: str) -> Column:
    return F.size(F.filter(array, lambda x: x["kind"] == kind)).cast("bigint")
