"""Agreement of analyzer results with gold labels, and of pairs with their expected order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.spans import with_all_spans
from foliant.functions.text import alternation, band, line_of, squeeze
from foliant.operators import distribution

BANDS = ("BROKEN", "POOR", "FAIR", "GOOD", "EXCELLENT")


def band_rank(b: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BANDS)), b)


def average_rank(df: DataFrame, value: str, name: str, parts: int = 64) -> DataFrame:
    """df with ranks from 1, equal values sharing the mean of theirs. Ranks come from counts of distinct values, so ties cost nothing; these are
    dealt by `parts` of their quantiles, each of which counts its own while a row for each part says how many come before."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    limits = counts.approxQuantile(value, [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []  # fewer than `parts` numbers
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(limits)))), lambda x: F.col(value) > x)) if limits else F.lit(0)
    counts = counts.withColumn("_part", part)
    totals = counts.groupBy("_part").agg(F.sum("_n").alias("_total"))
    earlier = F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.withColumn("_inside", inside).join(F.broadcast(totals.select("_part", earlier.alias("_earlier"))), "_part")  # at most `parts` rows
    return df.join(ranks.select(value, (F.col("_earlier") + F.col("_inside") - (F.col("_n") - 1) / 2).alias(name)), value)


def agreement(df: DataFrame, score: str = "score", gold: str = "gold") -> DataFrame:
    """One row: n, mean and median absolute error, exact and within-one bands, false high and low shares, and Spearman's correlation (0 for constants)."""
    error = F.abs(F.col(score) - F.col(gold))
    ours, theirs = band(F.col(score)), band(F.col(gold))
    median = distribution.percentiles(df.select(error.alias("e")), "e", [0.5])[0]
    ranked = average_rank(average_rank(df.select(score, gold), score, "_a"), gold, "_b")
    share = lambda of, which: F.coalesce(F.count_if(of & which) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    return ranked.agg(
        F.count("*").alias("n"), F.avg(error).alias("mae"), F.lit(median).cast("double").alias("median_ae"), F.avg((ours == theirs).cast("int")).alias("exact_band"),
        F.avg((F.abs(band_rank(ours) - band_rank(theirs)) <= 1).cast("int")).alias("within_one_band"), share(theirs.isin("POOR", "BROKEN"), F.col(score) >= 70).alias("false_high"),
        share(theirs.isin("GOOD", "EXCELLENT"), F.col(score) < 40).alias("false_low"), F.coalesce(F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")), F.lit(0.0)).alias("spearman"),
    )


def detection(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: precision, recall and false-positive rate; 0 where nothing is counted."""
    part = lambda of, which: F.coalesce(F.count_if(which & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), part(predicted, actual).alias("precision"), part(actual, predicted).alias("recall"), part(~actual, predicted).alias("false_positive_rate"))


def pairwise(pairs: DataFrame, scores: DataFrame, margin: int = 5) -> DataFrame:
    """pairs (pair_id, case_a, case_b), a expected above b, with PASS, FAIL, TIE (closer than the margin) or NOT_EVALUATED."""
    a, b = scores.select(F.col("id").alias("case_a"), F.col("score").alias("score_a")), scores.select(F.col("id").alias("case_b"), F.col("score").alias("score_b"))
    delta = F.col("score_a") - F.col("score_b")
    result = F.when(delta.isNull(), "NOT_EVALUATED").when(F.abs(delta) < margin, "TIE").when(delta > 0, "PASS").otherwise("FAIL")
    return pairs.join(a, "case_a", "left").join(b, "case_b", "left").withColumn("result", result)


def pairwise_verdict(results: DataFrame) -> DataFrame:
    """One row; fails closed: nothing evaluated, anything unevaluated or any failure is no pass."""
    n = lambda r: F.count_if(F.col("result") == r)
    out = results.agg(F.count("*").alias("n"), *(n(r).alias(r.lower()) for r in ("PASS", "FAIL", "TIE", "NOT_EVALUATED")))
    ok = (F.col("pass") > 0) & (F.col("fail") == 0) & (F.col("not_evaluated") == 0)
    return out.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def verbatim_overlap(left: DataFrame, right: DataFrame, text: str = "text", least: int = 20) -> DataFrame:
    """Rows of left whose normalised text, of some length, is a text of right."""
    key = F.lower(squeeze(F.col(text)))
    other = right.select(key.alias("_key")).where(F.length("_key") >= least).distinct()
    return left.withColumn("_key", key).join(other, "_key", "left_semi").drop("_key")


# How the two cases of a contrast pair compare, first case less second: least and most difference; words of missing information
# and of advice, and the gold criteria that they are about.
CONTRASTS = {"A": (0, 100), "B": (-100, -1), "C": (-10, 10), "D": (-100, -20), "E": (-30, 30), "F": (-5, 100), "G": (-15, 15), "H": (-5, 100)}
GOLD = {
    "Zieldefinition": "GOAL_CLARITY", "Kontextqualität": "NECESSARY_CONTEXT", "Eingabendefinition": "INPUT_DEFINITION", "Vorgehensbeschreibung": "ACTIONABILITY", "Ausgabeformat": "OUTPUT_CONTRACT",
    "Qualitätsanforderungen": "CONSTRAINT_RELEVANCE", "Sicherheitsgrenzen": "SAFETY_PRIVACY_BOUNDARIES", "Klarheit": "AMBIGUITY_CONTROL", "Wiederverwendbarkeit": "REUSABILITY",
}
MISSING_WORDS = {
    "Zieldefinition": ("goal", "ziel", "task", "aufgabe", "objective", "deliverable", "what to", "purpose", "zweck"),
    "Kontextqualität": ("context", "kontext", "background", "hintergrund", "audience", "zielgruppe", "system", "environment", "umgebung", "project", "projekt"),
    "Eingabendefinition": ("input", "eingabe", "file", "datei", "source", "quelle", "data", "daten", "parameter", "pull request", "text", "article", "artikel", "notes", "customer", "kunde", "client"),
    "Vorgehensbeschreibung": ("step", "schritt", "procedure", "vorgehen", "how to", "process", "ablauf", "plan", "format"),
    "Ausgabeformat": ("format", "output", "ausgabe", "response", "antwort", "deliverable", "length", "länge", "zeic"),
    "Qualitätsanforderungen": ("quality", "qualität", "criteria", "kriterien", "acceptance", "check", "prüf"),
    "Sicherheitsgrenzen": ("safety", "sicherheit", "privacy", "datenschutz", "boundary", "grenze", "secret", "pii", "personal"),
    "Klarheit": ("clarify", "klar", "specify", "spezifiz", "define", "explicit", "ambigu", "unklar", "bedeut", "what you mean"),
    "Wiederverwendbarkeit": ("reus", "wiederverwend", "template", "placeholder", "parametr", "generic", "generisch"),
}
ADVICE_WORDS = {
    "Zieldefinition": ("ziel", "goal", "your task"), "Kontextqualität": ("kontext", "context"), "Eingabendefinition": ("eingaben", "placeholders", "inputs"), "Vorgehensbeschreibung": ("vorgehen", "procedure", "structure the"),
    "Ausgabeformat": ("ausgabeformat", "output format", "specify the output"), "Qualitätsanforderungen": ("prüfkriterien", "acceptance criteria", "checks"), "Sicherheitsgrenzen": ("grenzen", "boundaries", "define boundaries"),
    "Klarheit": ("lesbarkeit", "readability"), "Wiederverwendbarkeit": ("generischer", "generic"), "Rollendefinition": ("rolle", "role"), "Scope/Zweck": ("scope/zweck", "guideline scope", "scope"),
    "Regel-Spezifität": ("regel-spezifität", "imperative rules", "rules"), "Constraint-Klarheit": ("constraint", "constraints"), "Anwendbarkeit": ("anwendbarkeit", "geltungsbereich", "scope of the guideline", "applies"),
    "Output-Disziplin": ("output-disziplin", "output discipline"), "Konsistenz/Struktur": ("konsistenz", "consistency"),
}
RELATED = {k: (v,) for k, v in GOLD.items()} | {
    "Scope/Zweck": ("GOAL_CLARITY", "NECESSARY_CONTEXT"), "Regel-Spezifität": ("ACTIONABILITY", "AMBIGUITY_CONTROL"), "Constraint-Klarheit": ("CONSTRAINT_RELEVANCE", "INTERNAL_CONSISTENCY"),
    "Anwendbarkeit": ("NECESSARY_CONTEXT",), "Output-Disziplin": ("OUTPUT_CONTRACT",), "Konsistenz/Struktur": ("INTERNAL_CONSISTENCY", "AMBIGUITY_CONTROL"),
}
WEAK_GOLD = 5
CASE_IDS = ("sem-t-", "sem-g-", "sem-r-", "s2-", "s2-h-", "v3-h-", "fmis-", "famb-", "fguid-", "rtpl-", "pcon-", "pguid-", "pred-", "pkey-", "pver-", "fsafe-", "fph-", "bhns-", "bfak-", "bfill-", "bguid-", "dev-tpl-", "dev-rep-")
ANCHORS = ("gold 9", "gold 90", "gold 6", "gold 64", "gold 54", "calibration v2", "error class", "reg3", "debug_dump_dims")
FAMILIES = ("P1", "P2", "P3", "P4", "P5", "P6", "P7")
FAR_SCORES = 15


def first_of(text: Column, words: dict[str, Sequence[str]]) -> Column:
    """The first name one of whose words the text has."""
    out = F
    for name, some in words.items():
        out = out.when(F.lower(text).rlike(alternation(some)), name)
    return out.otherwise(F.lit(None))


def contrast_checks(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """stem and result of each contrast pair: PASS or FAIL by CONTRASTS, NOT_EVALUATED where a case or score is missing, UNKNOWN for other stems.

    cases: id and pair, a letter and 1 or 2; scores: id and score. Of several cases of one label the smallest id counts."""
    one = cases.where("pair is not null").groupBy("pair").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(scores, "id", "left")
    side = lambda k: F.max(F.when(F.endswith("pair", F.lit(k)), F.col("score")))
    pairs = one.groupBy(F.expr("left(pair, length(pair) - 1)").alias("stem")).agg(side("1").alias("one"), side("2").alias("two"), F.count_if(F.col("score").isNull()).alias("missing"), F.sum("n").alias("n"))
    delta = F.col("one") - F.col("two")
    inside = F.coalesce(*(F.when(F.col("stem") == k, delta.between(lo, hi)) for k, (lo, hi) in CONTRASTS.items()))
    result = F.when((F.col("n") < 2) | (F.col("missing") > 0) | delta.isNull(), "NOT_EVALUATED").when(~F.col("stem").isin(*CONTRASTS), "UNKNOWN").when(inside, "PASS").otherwise("FAIL")
    return pairs.select("stem", result.alias("result"))


def routing(df: DataFrame) -> DataFrame:
    """One row: n, accuracy and guideline recall. df: kind (expected), content_kind (null in old results) and guideline_routed."""
    ok = F.when(F.col("content_kind").isNotNull(), F.col("content_kind") == F.col("kind")).otherwise((F.col("kind") == "guideline") == F.col("guideline_routed"))
    rules = F.col("kind") == "guideline"
    return df.agg(F.count("*").alias("n"), F.avg(ok.cast("int")).alias("accuracy"), F.coalesce(F.count_if(rules & (F.col("content_kind") == "guideline")) / F.nullif(F.count_if(rules), F.lit(0)), F.lit(0.0)).alias("guideline_recall"))


def missing_information(df: DataFrame) -> DataFrame:
    """One row: precision, recall and false-positive rate of missing sections. df: missing_sections, missing_information (free texts) and criteria (a map of gold scores).

    A free text is about the first criterion it has a word of. What gold finds satisfied and we find missing counts as false once more, as the rate is defined."""
    wanted = F.array_distinct(F.array_compact(F.transform("missing_information", lambda m: first_of(m, MISSING_WORDS))))
    found = F.array_distinct("missing_sections")
    df = df.withColumns({"_w": wanted, "_f": found})
    satisfied = [(F.coalesce(F.element_at("criteria", gold) >= WEAK_GOLD, F.lit(False)), F.array_contains("_f", name)) for name, gold in GOLD.items()]
    count = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    df = df.select(
        F.size(F.array_intersect("_f", "_w")).alias("tp"), (F.size(F.array_except("_f", "_w")) + count(s & f for s, f in satisfied)).alias("fp"), F.size(F.array_except("_w", "_f")).alias("fn"), count(s & ~f for s, f in satisfied).alias("tn"),
    )
    share = lambda a, b: F.coalesce(F.sum(a) / F.nullif(F.sum(a) + F.sum(b), F.lit(0)), F.lit(0.0))
    return df.agg(share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("fp", "tn").alias("false_positive_rate"))


def usefulness(df: DataFrame) -> DataFrame:
    """One row: advice, useful advice and their share; gaming resistance and terse fairness. df: recommendations, criteria (a map of gold scores), score, adversarial_pattern and tags.

    Advice is useful if a gold criterion that it is about is weak. Adversarial cases must not be EXCELLENT, terse excellent ones not below 70."""
    weak = F.map_keys(F.map_filter("criteria", lambda _, v: v < WEAK_GOLD))
    about = F.create_map(*(x for k, v in RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    topics = F.transform("recommendations", lambda r: first_of(r, ADVICE_WORDS))
    useful = F.size(F.filter(topics, lambda t: F.coalesce(F.arrays_overlap(F.element_at(about, t), F.coalesce(weak, F.expr("cast(array() as array<string>)"))), F.lit(False))))
    adversarial, terse = F.col("adversarial_pattern").isNotNull(), F.array_contains("tags", "terse") & F.array_contains("tags", "excellent")
    share = lambda of, which, empty: F.coalesce(F.count_if(of & which) / F.nullif(F.count_if(of), F.lit(0)), F.lit(empty))
    df = df.withColumns({"_n": F.size("recommendations"), "_u": useful})
    out = df.agg(F.sum("_n").cast("bigint").alias("n_advice"), F.sum("_u").cast("bigint").alias("n_useful"), (1 - share(adversarial, band(F.col("score")) == "EXCELLENT", 0.0)).alias("gaming_resistance"), share(terse, F.col("score") >= 70, 1.0).alias("terse_fairness"))
    return out.withColumn("usefulness", F.col("n_useful") / F.greatest("n_advice", F.lit(1)))


def ordering_accuracy(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """One row: pairs (case_a, case_b) whose scores and gold scores both differ, and the share that both order alike. results: id, score and gold."""
    side = lambda k: results.select(F.col("id").alias(f"case_{k}"), F.col("score").alias(f"s_{k}"), F.col("gold").alias(f"g_{k}"))
    both = pairs.join(side("a"), "case_a").join(side("b"), "case_b").where("case_a != case_b and s_a != s_b and g_a != g_b")
    return both.agg(F.count("*").alias("n"), F.coalesce(F.avg(((F.col("s_a") > F.col("s_b")) == (F.col("g_a") > F.col("g_b"))).cast("int")), F.lit(0.0)).alias("accuracy"))


def contaminated_lines(files: DataFrame, corpus: DataFrame, path: str = "path", text: str = "text", least: int = 20) -> DataFrame:
    """path, line, kind and detail of lines of sources that name a case or a gold value (the first such), and of string literals that are a corpus text of some length."""
    line = files.select(path, F.posexplode(F.split(text, r"\r?\n", -1)).alias("line", "_x")).withColumn("line", F.col("line") + 1)
    named = lambda words: F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("_x"), w)), F.lit(0))
    case, anchor = named(CASE_IDS), named(ANCHORS)
    by_name = line.withColumn("detail", F.coalesce(case, anchor)).where("detail is not null").select(path, "line", F.when(case.isNotNull(), "case-id").otherwise("gold-anchor").alias("kind"), "detail")
    literal = r'"((?:[^"\\]|\\[\s\S])*)"'
    spans = with_all_spans(files.select(path, text), text, {"_s": (literal, F.contains(text, F.lit('"')))})
    inner = lambda x: F.replace(F.replace(F.replace(F.regexp_extract(x, literal, 1), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    found = spans.select(path, F.explode(F.transform("_s", lambda s: F.struct(line_of(F.col(text), s["start"]).alias("line"), F.lower(squeeze(inner(s["hit"]))).alias("_key")))).alias("s")).select(path, "s.*").where(F.length("_key") >= least)
    known = corpus.select(F.lower(squeeze(F.col(text))).alias("_key")).where(F.length("_key") >= least).distinct()
    verbatim = found.join(known, "_key", "left_semi").select(path, "line", F.lit("verbatim-corpus").alias("kind"), F.left("_key", F.lit(80)).alias("detail"))
    return by_name.unionByName(verbatim)


def pairwise_report(pairs: DataFrame, reference: DataFrame, candidate: DataFrame, margin: int = 5, families: Sequence[str] = FAMILIES) -> DataFrame:
    """One row: pass, fail, tie and not_evaluated pairs, accuracy, verdict and reasons why it could not be PASS.

    pairs: pair_id, family_id, case_a (expected above) and case_b; the others: id and score. Closer reference scores than the margin are ties. Repeated pair ids, pairs that
    repeat in either order, missing members, missing families, and nothing scored are no pass."""
    side = lambda t, k, name: t.select(F.col("id").alias(f"case_{k}"), F.col("score").alias(name))
    df = pairs
    for t, name in ((reference, "ref"), (candidate, "cand")):
        df = df.join(side(t, "a", f"{name}_a"), "case_a", "left").join(side(t, "b", f"{name}_b"), "case_b", "left")
    complete = F.col("ref_a").isNotNull() & F.col("ref_b").isNotNull() & F.col("cand_a").isNotNull() & F.col("cand_b").isNotNull()
    status = F.when(~complete, "NOT_EVALUATED").when(F.abs(F.col("ref_a") - F.col("ref_b")) < margin, "TIE").when(F.col("cand_a") > F.col("cand_b"), "PASS").otherwise("FAIL")
    n = lambda s: F.count_if(F.col("_s") == s)
    both = F.struct(F.least("case_a", "case_b"), F.greatest("case_a", "case_b"))
    out = df.withColumn("_s", status).agg(
        n("PASS").alias("pass"), n("FAIL").alias("fail"), n("TIE").alias("tie"), n("NOT_EVALUATED").alias("not_evaluated"), (F.count("pair_id") - F.count_distinct("pair_id")).alias("repeated_ids"),
        (F.count("*") - F.count_distinct(both)).alias("repeated_pairs"), F.array_sort(F.array_except(F.array(*map(F.lit, families)), F.collect_set(F.when(F.col("family_id").isin(*families), F.col("family_id"))))).alias("missing_families"),
    )
    scored = F.col("pass") + F.col("fail")
    reasons = F.array_compact(F.array(
        F.when(F.col("repeated_ids") > 0, "duplicate pair ids"), F.when(F.col("repeated_pairs") > 0, "duplicate pairs"), F.when(F.size("missing_families") > 0, F.concat(F.lit("missing required families: "), F.array_join("missing_families", ", "))),
        F.when(F.col("not_evaluated") > 0, F.concat(F.col("not_evaluated").cast("string"), F.lit(" pair(s) NOT_EVALUATED (missing member)"))), F.when(scored == 0, "0/0 scored pairs"),
    ))
    return out.withColumns({"accuracy": F.try_divide(F.col("pass"), scored), "reasons": reasons}).withColumn("verdict", F.when((F.size("reasons") == 0) & (F.col("fail") == 0), "PASS").otherwise("FAIL"))


def adjudicated(judged: DataFrame) -> DataFrame:
    """judged with needs_third, reasons and the reference: score, band and fit. judged: score_a, score_b, band_a, band_b, fit_a, fit_b, critical_a and critical_b (arrays), and of a third judge
    score_c, band_c and fit_c, null without one. Without need, or a third judge, the reference is the mean of both."""
    crit = lambda k: F.coalesce(F.size(f"critical_{k}") > 0, F.lit(False))
    both = F.col("score_a").isNotNull() & F.col("score_b").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(both & (F.abs(F.col("score_a") - F.col("score_b")) > FAR_SCORES), "score_delta"), F.when(both & (F.abs(band_rank(F.col("band_a")) - band_rank(F.col("band_b"))) > 1), "band_delta"),
        F.when(both & (F.col("fit_a") != F.col("fit_b")), "fit_disagree"), F.when(both & (crit("a") != crit("b")), "critical_disagree"),
    ))
    df = judged.withColumn("reasons", reasons).withColumn("needs_third", F.size("reasons") > 0)
    third = F.col("needs_third") & F.col("score_c").isNotNull()
    mean = F.coalesce(F.bround((F.col("score_a") + F.col("score_b")) / 2, 0).cast("int"), F.col("score_a"), F.col("score_b"))
    score = F.when(third, F.col("score_c")).otherwise(mean)
    fit = F.when(third, F.col("fit_c")).when(both & (F.col("fit_a") != F.col("fit_b")), "PARTIAL").otherwise(F.coalesce("fit_a", "fit_b"))
    band_of = F.when(third, F.col("band_c")).when(both, band(mean)).otherwise(F.coalesce("band_a", "band_b"))
    return df.withColumns({"reference_score": score, "reference_band": band_of, "reference_fit": fit})
