"""Secrets in whole texts: base patterns, and a battery of randomness tests for strings that no pattern knows.

A candidate is a run of at least LEAST characters that keys are written with, letters and digits mixed. Its encoding is inferred (hex, base32,
alphanumeric or base64), and three tests ask whether its characters are drawn evenly and independently from that alphabet: chi-squared of the
counts, the runs of the alphabet's lower and upper half, and the serial correlation of neighbours. What a test rejects is no secret. Short strings
that are not random pass by chance too; how often, decoys tell: long words of the same corpus, and where a length class has too few of them, strings put
together from such words. By the worst of the three tests a candidate's p-value is the share of its own class's decoys that look as random, and within
each class false discoveries among distinct strings are controlled; copies of a string share its fate.
Everything is DataFrame operations; what meets across texts are counts by length class and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.shared import read, rejoin_key, stored
from foliant.functions.spans import joined, number_of, of_kind, with_all_spans

KINDS = ("assign", "access", "hex")

# Possessive forms of the base patterns; they match the same, as no class holds what has to follow it.
ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?+key)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++"
ASSIGN_VALUE = r"(?i)^(?:password|passwd|secret|token|api_?+key)[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"

#: Encodings from the narrowest alphabet to the widest, each in the order that halves and correlation use.
ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "alnum": "0123456789abcdefghijklmnopqrstuvwxyz",
    "alnum62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: A test rejects beyond this many standard deviations.
REJECT = 2.6
#: Steps of a standard deviation by which strings are ranked, and the step of those that a test rejects.
STEPS = 50
REJECTED = int(REJECT * STEPS) + 1
#: Largest expected share of chance passes among the secrets of a length class.
FALSE_DISCOVERIES = 0.05
#: Buckets in which the corpus's words are numbered; and the longest decoy, the least length of the last class.
BUCKETS = 2048
LONGEST = 256


def body(x: Column) -> Column:
    """A candidate without padding, and with base64's other alphabet made the usual one."""
    return F.translate(F.rtrim(x, F.lit("=")), "-_", "+/")


def encoding(x: Column) -> Column:
    out = F.when(x.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(x.rlike("^[A-Z2-7]+$"), "base32").when(x.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "alnum")
    return out.when(x.rlike("^[0-9A-Za-z]+$"), "alnum62").otherwise("base64")


def tested(df: DataFrame) -> DataFrame:
    """df with z_chi, z_runs and z_serial of its column `candidate`: each about standard normal for evenly drawn characters."""
    df = df.withColumn("s", body(F.col("candidate"))).withColumn("encoding", encoding(F.col("s")))
    df = df.withColumn("s", F.when(F.col("encoding") == "hex", F.lower("s")).when(F.col("encoding") == "alnum", F.lower("s")).otherwise(F.col("s")))
    alphabet = F.element_at(F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv)), F.col("encoding"))
    df = df.withColumn("alphabet", alphabet).withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length("s").cast("double"))
    df = df.withColumn("x", F.transform(F.split("s", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1)).withColumn("x", F.filter("x", lambda v: v >= 0))
    count = F.transform(F.split("alphabet", ""), lambda c: (F.col("n") - F.length(F.replace(F.col("s"), c, F.lit("")))).cast("double"))
    expected = F.col("n") / F.col("k")
    chi = F.aggregate(count, F.lit(0.0), lambda a, v: a + (v - expected) * (v - expected)) / expected
    freedom = F.col("k") - 1
    # Of few characters over many cells, chi-squared has this variance, not 2 (k - 1).
    df = df.withColumn("z_chi", (chi - freedom) / F.sqrt(2 * freedom * (1 - 1 / F.col("n"))))
    df = df.withColumn("high", F.transform("x", lambda v: (v >= F.col("k") / 2).cast("double"))).withColumn("ones", F.aggregate("high", F.lit(0.0), lambda a, v: a + v))
    pairs = lambda c, f: F.aggregate(F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), f), F.lit(0.0), lambda a, v: a + v)
    m, ones, zeros = F.col("n"), F.col("ones"), F.col("n") - F.col("ones")
    runs, mean = 1 + pairs(F.col("high"), lambda a, b: (a != b).cast("double")), 1 + 2 * ones * zeros / m
    spread = (mean - 1) * (mean - 2) / (m - 1)
    df = df.withColumn("z_runs", F.when(spread > 0, (runs - mean) / F.sqrt(spread)).otherwise(99.0))
    average, variance = (F.col("k") - 1) / 2, (F.col("k") * F.col("k") - 1) / 12
    return df.withColumn("z_serial", pairs(F.col("x"), lambda a, b: (a - average) * (b - average)) / (variance * F.sqrt(m - 1))).drop("s", "alphabet", "x", "high", "ones")


def step() -> Column:
    """How far the worst of the three tests is from what random characters give, in parts of a standard deviation, rounded up; all that a
    test rejects is one step. Evenness is one-sided: only too uneven counts speak against chance."""
    worst = F.greatest("z_chi", F.abs("z_runs"), F.abs("z_serial"))
    return F.when(worst <= REJECT, F.ceil(worst * STEPS)).otherwise(REJECTED).cast("int")


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n) * 2), F.lit(16)).cast("int")


def based(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's base spans, candidates and decoys, with a number for the row; texts stay behind."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    named = lambda *words: F.greatest(*(F.contains("low", F.lit(w)) for w in words))
    df = with_all_spans(df, "text", {
        "assign": (ASSIGN, named("passw", "secret", "token", "api")), "access": (ACCESS, F.contains("text", F.lit("AKIA"))),
        "hex": (HEX, F.col("text").rlike("[0-9a-f]{32}")), "candidate": (CANDIDATE, F.col("text").rlike(rf"[A-Za-z0-9+/_=-]{{{LEAST}}}")),
    })
    keep = {"assign": F.filter("assign", lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN_VALUE, 1)) >= 8), "access": F.filter("access", lambda x: F.length(x["hit"]) >= 16), "hex": F.col("hex")}
    base = F.concat(*(of_kind(keep[k], k, i) for i, k in enumerate(KINDS)))
    return df.select("doc_id", base.alias("base"), F.transform("candidate", lambda x: x.dropFields("left", "right")).alias("candidates")).withColumn("uid", F.monotonically_increasing_id())


def numbered(words: DataFrame) -> DataFrame:
    """words with number, from 0 without gaps: within buckets of their hash, and before those the sizes of the buckets before, which are BUCKETS rows at most."""
    df = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    before = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("word"), "word"))
    return df.withColumn("rank", rank).join(F.broadcast(before), "bucket").select("word", (F.col("before") + F.col("rank") - 1).alias("number"))


def made_decoys(strings: DataFrame) -> DataFrame:
    """candidate and length_class of decoys for the classes with too few: for each candidate, 1 / FALSE_DISCOVERIES strings of its length, put together from
    long words, each drawn by hash from all of the corpus. Those above the last class's least length get that length: what is longer passes no oftener."""
    n = lambda role: F.count_if(F.col("role") == role)
    few = strings.groupBy("length_class").agg(n("candidate").alias("candidates"), n("decoy").alias("decoys")).where(F.col("candidates") > FALSE_DISCOVERIES * F.col("decoys")).select("length_class")
    words = strings.where("role = 'decoy'").select(F.col("candidate").alias("word"))
    total = words.agg(F.count(F.lit(1)).alias("total")).where("total > 0")
    each = strings.where("role = 'candidate'").join(F.broadcast(few), "length_class").crossJoin(F.broadcast(total))
    each = each.select("length_class", "total", F.xxhash64("candidate").alias("c"), F.least(F.length(body(F.col("candidate"))), F.lit(LONGEST)).alias("n"))
    each = each.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(round(1 / FALSE_DISCOVERIES))))).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / LEAST).cast("int") + 1)))
    draws = each.withColumn("number", F.pmod(F.xxhash64("c", "j", "k"), F.col("total"))).join(numbered(words).withColumn("word", F.left("word", F.lit(LONGEST))), "number")
    made = draws.groupBy("length_class", "c", "n", "j").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), "").alias("text"))
    begin = F.pmod(F.xxhash64("c", "j", F.lit(-1)), F.lit(LEAST)).cast("int") + 1
    return made.select("length_class", F.substring("text", begin, F.col("n")).alias("candidate")).distinct()


def trusted(battery: DataFrame) -> DataFrame:
    """length_class and most, the last step whose strings are secrets, by Benjamini and Hochberg's rule within the class: a string's p-value is the share of the
    class's decoys that come as near to random. Classes without such a step are left out. At most STEPS * REJECT rows of a class meet."""
    n = lambda role: F.count_if(F.col("role") == role).cast("double")
    counts = battery.groupBy("length_class", "step").agg(n("candidate").alias("candidates"), n("decoy").alias("decoys"))
    whole = Window.partitionBy("length_class")
    so_far = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = (F.sum("decoys").over(so_far) + 1) / (F.sum("decoys").over(whole) + 1)
    ranked = counts.select("length_class", "step", p.alias("p"), F.sum("candidates").over(so_far).alias("found"), F.sum("candidates").over(whole).alias("all"))
    return ranked.where((F.col("step") < REJECTED) & (F.col("found") > 0) & (F.col("p") * F.col("all") <= FALSE_DISCOVERIES * F.col("found"))).groupBy("length_class").agg(F.max("step").alias("most"))


def random_strings(base: DataFrame) -> DataFrame:
    """uid, start and end of candidates that pass the battery, in length classes where chance passes are rare."""
    each = base.where(F.size("candidates") > 0).select("uid", "base", F.explode("candidates").alias("c"))
    overlaps = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    each = each.select("uid", "c.start", "c.end", F.col("c.hit").alias("candidate"), overlaps.alias("known"))
    mixed = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    word = F.col("candidate").rlike("^[A-Za-z]+$")
    each = each.withColumn("role", F.when(F.col("known"), None).when(mixed, "candidate").when(word, "decoy")).where("role is not null")
    # Copies of a string are one string: they say no more for or against its length class.
    strings = stored(each.select("candidate", "role").distinct().withColumn("length_class", length_class(F.length(body(F.col("candidate"))))), "random-strings")
    null = made_decoys(strings).withColumn("role", F.lit("decoy"))
    battery = stored(tested(strings.unionByName(null)).select("candidate", "role", "length_class", step().alias("step")), "battery")
    kept = battery.where("role = 'candidate'").join(F.broadcast(trusted(battery)), "length_class").where("step <= most").select(rejoin_key("candidate").alias("at"))
    return each.where("role = 'candidate'").withColumn("at", rejoin_key("candidate")).join(kept, "at").select("uid", "start", "end")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, n_assign, n_access, n_hex and base_sha256 of the base spans, and spans, all of them; added ones are of kind random.

    Null and empty texts have no spans. Ids may be null or repeated: results are by row. Added spans never overlap base ones. Without any
    decoys nothing is added. An empty table gives an empty result. Other columns are not read."""
    base = stored(based(docs, id_col, text_col), "base-secrets")
    place = lambda order, kind: F.struct(F.col("start").alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), F.col("end").alias("end"))
    more = random_strings(base).select("uid", place(len(KINDS), "random").alias("s")).groupBy("uid").agg(F.collect_list("s").alias("more"))
    full = base.join(more, "uid", "left").withColumn("found", F.array_sort(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["kind"].alias("kind"), x["end"].alias("end")))))
    every = F.array_sort(F.concat("found", F.coalesce("more", F.expr("cast(array() as array<struct<start: int, order: int, kind: string, end: int>>)"))))
    return full.select(
        F.col("doc_id").alias(id_col), *(number_of("found", k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("found")), 256).alias("base_sha256"), joined(every).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
