"""Personal data in whole texts: base patterns, and contextual extraction bootstrapped from what they find.

Base entities are seeds. Every token with a digit or an at sign is an instance; its patterns are its shape, and its shape beside the
word on its left and beside the word on its right. A pattern's score for a kind is the mean confidence of its instances, an instance's confidence the mean
score of its patterns; seeds keep theirs. After a few rounds, instances whose patterns are supported by several different
seeds and score high are identifiers that no base pattern knows. Everything is DataFrame operations; equal instances are one row
with a count before they meet, so that copies neither dominate a pattern nor land in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.shared import read, stored
from foliant.functions.spans import joined, number_of, of_kind, with_all_spans

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the base patterns; they match the same, as no class holds what has to follow it, and never backtrack over long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
INSTANCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

ROUNDS = 3
CONFIDENT = 0.8
#: Different seed values that a pattern needs.
SUPPORT = 5
#: Prior instances without any confidence in each pattern.
DOUBT = 1.0


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Of 16 to 19 digits; false for others."""
    d = F.when(F.length(digits(x)).between(16, 19), F.reverse(digits(x))).otherwise("1")
    value = lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(value(i) > 9, value(i) - 9).otherwise(value(i))) % 10 == 0


def octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.lpad(F.ltrim(p, F.lit("0")), 3, "0"), 1, 3) <= "255"))


def based(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's base spans and instances, with a number for the row; texts stay behind."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("any", F.col("text").rlike("[0-9@]"))
    gates = {
        "email": F.col("any") & F.contains("text", F.lit("@")), "ip": F.col("any") & F.col("text").rlike(r"[0-9]\.[0-9]+\.[0-9]"),
        "card": F.col("any") & F.col("text").rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), "phone": F.col("any") & F.contains("text", F.lit("+")),
    }
    patterns = {k: (p, gates[k]) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)}
    df = with_all_spans(df, "text", patterns | {"instance": (INSTANCE, F.col("any"))})
    keep = {
        "email": F.col("email"), "ip": F.filter("ip", lambda x: octets(x["hit"])),
        "card": F.filter("card", lambda x: F.length(digits(x["hit"])).between(16, 19) & luhn(x["hit"])), "phone": F.filter("phone", lambda x: F.length(digits(x["hit"])).between(8, 15)),
    }
    base = F.concat(*(of_kind(keep[k], k, i) for i, k in enumerate(KINDS)))
    return df.select("doc_id", base.alias("base"), F.transform("instance", instance).alias("instances")).withColumn("uid", F.monotonically_increasing_id())


def key(x: Column, most: int) -> Column:
    """x itself, or its beginning and a digest of the whole if it is longer: different strings have different keys, of a bounded size."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(most)), F.sha2(x, 256)))


def instance(x: Column) -> Column:
    """A token without quotes, brackets and stops around it, its shape, and the words beside it (# for another instance)."""
    lead = F.length(x["hit"]) - F.length(F.ltrim(x["hit"], F.lit("\"'([{<")))
    value = F.rtrim(F.ltrim(x["hit"], F.lit("\"'([{<")), F.lit("\"')]}>.,;:!?"))
    shape = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "0")
    word = lambda side, pattern: key(F.lower(F.regexp_extract(side, pattern, 1)), 40)
    left, right = word(x["left"], r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++$"), word(x["right"], r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)")
    return F.struct(
        (x["start"] + lead).alias("start"), (x["start"] + lead + F.length(value)).alias("end"), key(value, 200).alias("value"), key(shape, 80).alias("shape"),
        F.when(F.trim(x["left"]) == "", "#").otherwise(left).alias("before"), F.when(F.trim(x["right"]) == "", "#").otherwise(right).alias("after"),
    )


def seed_kind(base: Column, x: Column) -> Column:
    """The kind of the first base span that overlaps the instance, or an empty string."""
    over = F.filter(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    return F.coalesce(F.get(over, F.lit(0))["kind"], F.lit(""))


INSTANCE_KEY = ["value", "shape", "before", "after"]


def discovered(base: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """uid, kind, start and end of spans that patterns find beyond the base."""
    occurrence = base.where(F.size("instances") > 0).select("uid", F.explode(F.transform("instances", lambda x: F.struct(x.alias("x"), seed_kind(F.col("base"), x).alias("seed")))).alias("o")).select("uid", "o.x.*", "o.seed").where("end > start")
    seeded = stored(occurrence.groupBy(*INSTANCE_KEY).agg(F.max("seed").alias("seed")).withColumn("instance", F.xxhash64(*INSTANCE_KEY)), "instances")
    kinds = F.explode(F.array(*map(F.lit, KINDS))).alias("kind")
    patterns = F.array(F.concat(F.lit("S:"), "shape"), F.concat_ws("\x01", F.lit("L:"), "before", "shape"), F.concat_ws("\x01", F.lit("R:"), "after", "shape"))
    edges = stored(seeded.select("instance", "value", "seed", F.explode(patterns).alias("pattern")), "pattern-edges")
    confidence = seeded.where("seed != ''").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("confidence"))
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    backing = edges.where("seed != ''").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count_distinct("value").alias("seeds")).where(F.col("seeds") >= support)
    scored = None
    for r in range(rounds):
        held = edges.withColumn("at", F.struct("instance")).join(confidence.select(F.struct("instance").alias("at"), "kind", "confidence"), "at")
        score = held.groupBy("pattern", "kind").agg(F.sum("confidence").alias("sum")).join(size, "pattern").join(backing, ["pattern", "kind"])
        scored = stored(score.select("pattern", "kind", (F.col("sum") / (F.col("n") + DOUBT)).alias("score")), "pattern-scores")
        reached = edges.where("seed = ''").withColumn("at", F.struct("pattern")).join(scored.select(F.struct("pattern").alias("at"), "kind", "score"), "at")
        reached = reached.groupBy("instance", "kind").agg(F.avg("score").alias("confidence"), F.max("score").alias("best"))
        if r == rounds - 1:
            break
        confidence = stored(seeded.where("seed != ''").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("confidence")).unionByName(reached.select("instance", "kind", "confidence")), "confidence")
    best = reached.groupBy("instance").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind")).alias("k")).where(F.col("k.confidence") >= confident)
    found = seeded.join(best, "instance").select(F.struct(*INSTANCE_KEY).alias("at"), F.col("k.kind").alias("kind"))
    return occurrence.where("seed = ''").withColumn("at", F.struct(*INSTANCE_KEY)).join(found, "at").select("uid", "kind", "start", "end")


def order_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans, all of them.

    Null and empty texts have no spans. Ids may be null or repeated: results are by row. Added spans never overlap base ones. An empty table
    gives an empty result. Other columns are not read."""
    base = stored(based(docs, id_col, text_col), "base-spans")
    more = discovered(base).select("uid", F.struct(order_of(F.col("kind")).alias("order"), "kind", "start", "end").alias("s")).groupBy("uid").agg(F.collect_list("s").alias("more"))
    full = base.join(more, "uid", "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<order: int, kind: string, start: int, end: int>>)"))))
    return full.select(
        F.col("doc_id").alias(id_col), *(number_of("base", k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.array_sort("base")), 256).alias("base_sha256"), joined(every).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
