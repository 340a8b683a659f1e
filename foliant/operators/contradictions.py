"""Contradictions inside a document: its mandates, and conflicts between mandates of one topic.

A mandate is a sentence, or a clause of one whose clauses are all mandates, that forbids, requires or commands. It has a polarity by its
negators, a topic by the words it has, and for some topics a value. Everything stays in the document's row: mandates are an array of at most
MOST_MANDATES, and pairs of them are looked at inside it, so that documents never meet and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.gates import Gates
from foliant.functions.text import alternation, pinned, rx, strip, stripped
from foliant.operators.features import NEGATORS

MOST_MANDATES = 60
MOST_WEIGHT = 12
#: Bytes between a negator and the format that it negates, at most.
NEAR = 15

# Words, expressions and weights that results depend on.
EXTRA_NEGATORS = ("none",)
VERBS = (
    "verwende", "achte", "vermeide", "halte", "nutze", "stelle sicher", "erledige", "warte", "überschreite", "fasse", "nenne", "kennzeichne", "prüfe", "melde", "beginne", "sprich", "beantworte",
    "frage", "definiere", "dokumentiere", "erkläre", "antworte", "gib", "schreibe", "erstelle", "ende", "beende", "füge", "zeige", "zitiere", "starte", "schließe", "veröffentliche", "übersetze",
    "use", "avoid", "ensure", "keep", "apply", "do not", "always", "never", "write", "return", "begin", "start", "end", "finish", "include", "exclude", "show", "cite", "state", "explain", "answer", "output", "translate", "publish",
)
SIGNALS = ("immer", "nie", "niemals", "sofort", "erst", "nur", "verboten", "soll", "muss", "must", "always", "never", "immediately", "only", "exactly", "at least", "at most", "mandatory", "required", "verpflichtend", "erforderlich", "obligatorisch")
EXCLUSIVE = r"\b(?:only|nur|never|nie)\b"
LENGTH_BOUND = r"\b(exactly|genau|at least|mindestens|minimum|at most|no more than|höchstens|maximum|maximal)\s+(\d+)\s*(?:words?|wörter|worte)?\b"
EXACT, LEAST = ("exactly", "genau"), ("at least", "mindestens", "minimum")
LANGUAGES = ("german", "deutsch", "englisch", "english", "spanish", "spanisch", "french", "französisch", "italian", "italienisch")
LANGUAGE_TERMS = ("deutsch", "german", "englisch", "english", "ins deutsche", "ins englische", "into german", "into english", "to german", "to english", "auf deutsch", "auf englisch")
GERMAN = ("deutsch", "german", "ins deutsche", "into german", "auf deutsch")
ENGLISH = ("englisch", "english", "ins englische", "into english", "auf englisch")
INFLECTIONS = ("e", "er", "en", "es", "em")
#: Topics and the words that name them, in the order in which they are asked; language comes before all of them.
TOPICS = {
    "length": ("kurz", "lang", "ausführlich", "detailliert", "prägnant", "50 wörter", "500 wörter", "short", "long", "brief", "exhaustive", "detailed", "concise", "50 words", "500 words"),
    "tone": ("formell", "sachlich", "freundlich", "höflich", "informell", "formal", "casual", "friendly", "polite", "informal"),
    "media": ("bild", "bilder", "screenshot", "grafik", "image", "images", "picture", "screenshot", "graphic"),
    "format": ("json", "csv", "markdown", "yaml", "xml", "tabelle", "plain text", "text", "table"),
    "output_data": ("alle daten", "daten ausgeben", "keine daten", "personenbezogene daten", "output all", "all data", "no data", "personal data"),
    "question_scope": ("beantworte alle fragen", "beantworte keine fragen", "keine fragen", "answer all questions", "answer every question", "answer no questions", "ask questions"),
    "secrecy": ("vertraulich", "geheim", "veröffentlichen", "öffentlich", "confidential", "secret", "publish", "public"),
    "quality": ("vollständig", "lückenlos", "keine fehler", "complete", "exhaustive", "no errors", "flawless"),
    "procedure_order": ("sofort", "erst", "warte auf freigabe", "freigabe", "immediately", "first", "wait for approval", "approval"),
    "budget": ("budget", "überschreite niemals", "gib alles aus", "never exceed", "spend all"),
    "voice": ("aktiv", "passiv", "aktiver form", "passiver form", "active voice", "passive voice", "active form", "passive form"),
    "section": ("fazit", "einleitung", "zusammenfassung", "abschnitt", "schlussfolgerung", "conclusion", "summary", "introduction", "section", "final summary"),
    "metric": ("zahlen", "kennzahlen", "werte", "metriken", "zahlenangaben", "numbers", "metrics", "figures", "percent", "growth rate"),
    "unit": ("metrisch", "imperial", "metrische", "imperiale", "metric units", "imperial units", "cm", "meters", "inches", "feet"),
    "inclusion": ("schließe ein", "einschließen", "ausschließen", "include all", "include every", "exclude all", "exclude every"),
    "source_use": ("zitier", "quellen", "referenzier", "verweise", "cite", "sources", "reference"),
    "web_use": ("web", "internet", "online", "web lookup"),
    "prose": ("fließtext", "textform", "prosa", "prose", "plain text explanation", "text explanation"),
    "reasoning": ("gedankengang", "überlegungen", "denkprozess", "begründung", "reasoning", "thought process", "explain your reasoning"),
}
#: Asked where none of TOPICS is named; names of other languages come before them.
MORE_TOPICS = {
    "output_data": ("output any data", "do not output", "don't output", "output no data", "keine daten ausgeben"),
    "question_scope": ("answer none", "none of the question", "do not answer", "don't answer", "answer no", "beantworte keine"),
    "content": ("wetter", "weather", "technisch", "technischen", "begriffe", "terminologie", "politik", "politics", "themen", "topics", "sport"),
}
VALUES = {
    "secrecy": {"confidential": ("vertraulich", "geheim", "confidential", "secret", "nicht weitergeben", "nicht teilen"), "public": ("veröffentlich", "publish", "öffentlich", "public")},
    "length": {"short": ("kurz", "prägnant", "short", "brief", "knapp"), "long": ("ausführlich", "detailliert", "lang", "long", "exhaustive", "vollständig", "in jedem detail", "every detail")},
    "tone": {"formal": ("formell", "sachlich", "formal"), "casual": ("casual", "informell", "freundlich", "friendly", "locker")},
    "format": {"json": ("json",), "csv": ("csv",), "markdown": ("markdown",), "plain text": ("plain text",), "yaml": ("yaml",), "xml": ("xml",), "table": ("table", "tabelle")},
    "voice": {"active": ("aktiv", "active"), "passive": ("passiv", "passive")},
    "unit": {"metric": ("metrisch", "metrische", "metric", "cm", "meters"), "imperial": ("imperial", "imperiale", "inches", "feet")},
    "section": {
        "start": ("beginne mit", "beginn mit", "start with", "begin with", "starte mit", "beginne", "begin", "start", "starte"),
        "end": ("ende mit", "beende mit", "schließe mit", "end with", "finish with", "close with", "ende", "beende", "schließe", "end", "finish", "close"),
    },
}
STRUCTURED = ("csv", "json", "markdown", "table", "xml", "yaml")
#: Class, weight and whether a conflict is critical, in the order in which topics are reported.
CONFLICTS = {
    "language": (1, 6, True), "length": (3, 3, False), "tone": (7, 4, False), "media": (7, 4, False), "format": (2, 4, False), "output_data": (6, 6, True), "question_scope": (5, 4, False),
    "secrecy": (4, 4, False), "quality": (7, 4, False), "procedure_order": (8, 4, False), "budget": (8, 4, False), "voice": (1, 6, True), "section": (1, 6, True), "metric": (6, 6, True),
    "unit": (1, 6, True), "inclusion": (5, 6, True), "source_use": (6, 6, True), "web_use": (6, 6, True), "prose": (2, 6, False), "reasoning": (7, 6, True), "content": (7, 4, False),
}
SAME_PARAGRAPH = ("procedure_order", "budget")
STOPWORDS = (
    "aber", "alle", "allen", "auch", "dass", "dies", "diese", "diesem", "diesen", "dieser", "dieses", "eine", "einem", "einen", "einer", "eines", "immer", "kein", "keine", "keinen", "keiner", "nicht", "oder", "soll", "sollen", "sofort", "über", "unter", "vom", "wenn",
    "werden", "wird", "with", "that", "this", "from", "into", "must", "should", "always", "never", "immediately", "only", "have", "does", "then", "than", "there", "their",
)


def words_of(*lists: Sequence[str]) -> str:
    """An expression for any of the words, the first that fits, with no letter or digit beside it."""
    return rx(r"\b(?:" + "|".join(w.replace(".", r"\.") for words in lists for w in words) + r")\b")


NEGATOR = words_of(NEGATORS, EXTRA_NEGATORS)
MANDATE = words_of(NEGATORS, EXTRA_NEGATORS, SIGNALS, VERBS)
#: Sentences that don't pass have no mandate, in none of their clauses either.
GATES = Gates(MANDATE, ascii_blanks=False)
NO_HITS = "cast(array() as array<struct<label: string, term: string>>)"


def language_term(low: Column, terms: Sequence[str]) -> Column:
    """Whether one of the terms stands there as a word, bare or inflected; compounds don't count."""
    edge = r"[\p{IsAlphabetic}\p{N}]"
    return low.rlike(rf"(?<!{edge})(?:{'|'.join(terms)})(?:{'|'.join(INFLECTIONS)})?(?!{edge})")


def language_value(low: Column) -> Column:
    out = F.when(language_term(low, GERMAN), "german").when(language_term(low, ENGLISH), "english")
    for name in LANGUAGES:
        out = out.when(language_term(low, (name,)), name)
    return out


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines; each cell of a table's line is a block of its own."""
    edge = "\x01\x02\x01"

    def line(x: Column) -> Column:
        cells = F.filter(F.transform(F.split(x, r"\|", -1), strip), lambda c: (c != "") & ~c.rlike("^[-:]+$"))
        return F.when(x == "", edge).when(F.startswith(x, F.lit("|")), F.concat(F.lit(edge), F.array_join(cells, edge), F.lit(edge))).otherwise(x)

    lines = F.transform(stripped(text, F.split(text, "\n", -1)), line)
    return F.filter(F.transform(F.split(F.array_join(lines, "\n"), edge, -1), strip), lambda p: p != "")


def clauses(sentence: Column) -> Column:
    """The clauses of a sentence whose clauses are all mandates, else the sentence."""
    parts = F.filter(F.transform(F.split(sentence, ",", -1), strip), lambda c: c != "")
    return F.when((F.size(parts) >= 2) & F.forall(parts, lambda c: F.lower(c).rlike(MANDATE)), parts).otherwise(F.array(sentence))


def topic(low: Column) -> Column:
    out = F.when(language_term(low, LANGUAGE_TERMS), "language")
    for name, words in TOPICS.items():
        out = out.when(low.rlike(alternation(words)), name)
    out = out.when(language_term(low, LANGUAGES), "language")
    for name, words in MORE_TOPICS.items():
        out = out.when(low.rlike(alternation(words)), name)
    return out


def value_hits(low: Column, name: Column) -> Column:
    """Of a topic with values: the values that the text names, each with the first of its words that is there."""
    out = F.expr(NO_HITS)
    for which, groups in VALUES.items():
        table = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, terms)).alias("terms")) for label, terms in groups.items()))
        hits = F.transform(table, lambda g: F.struct(g["label"].alias("label"), F.get(F.filter(g["terms"], lambda t: F.contains(low, t)), F.lit(0)).alias("term")))
        out = F.when(name == which, F.filter(hits, lambda h: h["term"].isNotNull())).otherwise(out)
    return out


def mandates(docs: DataFrame, text: str = "text", name: str = "mandates", most: int = MOST_MANDATES) -> DataFrame:
    """docs with an array of mandates: text, paragraph (from 0), polarity (1, -1, or 0 for two negators or more), topic, value, hits and low.

    A null text has none. At most `most` are kept, in their order."""
    t = F.coalesce(F.col(text), F.lit(""))
    each = lambda p, i: F.transform(F.filter(stripped(p, F.split(p, "[.!?\n]", -1)), lambda s: s != ""), lambda s: F.struct(s.alias("text"), i.cast("int").alias("paragraph")))
    df = docs.withColumn("_m", F.flatten(F.transform(paragraphs(t), each)))
    df = df.withColumn("_m_gates", GATES.passed_each(F.col("_m.text")))
    some = F.filter("_m", lambda s, i: GATES.may(F.get(F.col("_m_gates"), i), MANDATE))
    parts = F.flatten(F.transform(some, lambda s: F.transform(clauses(s["text"]), lambda c: F.struct(c.alias("text"), F.lower(c).alias("low"), s["paragraph"].alias("paragraph")))))
    df = df.withColumn("_m", F.slice(F.filter(parts, lambda m: m["low"].rlike(MANDATE)), 1, most)).drop("_m_gates")
    df = df.withColumn("_m", F.transform("_m", lambda m: F.struct(m["text"].alias("text"), m["low"].alias("low"), m["paragraph"].alias("paragraph"), topic(m["low"]).alias("topic"), F.regexp_count(m["low"], F.lit(NEGATOR)).alias("negators"))))
    df = df.withColumn("_m", F.transform("_m", lambda m: m.withField("hits", value_hits(m["low"], m["topic"]))))
    polarity = lambda m: F.when(m["negators"] == 0, 1).when(m["negators"] == 1, -1).otherwise(0)
    value = lambda m: F.when(m["topic"] == "language", language_value(m["low"])).otherwise(F.get(m["hits"], F.lit(0))["label"])
    done = F.transform("_m", lambda m: F.struct(m["text"].alias("text"), m["paragraph"].alias("paragraph"), polarity(m).alias("polarity"), m["topic"].alias("topic"), value(m).alias("value"), m["hits"].alias("hits"), m["low"].alias("low")))
    return df.withColumn(name, done).drop("_m")


def pairs(array: Column, ok: Callable[[Column, Column], Column]) -> Column:
    """Structs a, b of elements with a before b, in order, for which ok(a, b) holds."""
    numbered = F.transform(array, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    later = lambda a: F.transform(F.filter(numbered, lambda b: (b["i"] > a["i"]) & F.coalesce(ok(a["m"], b["m"]), F.lit(False))), lambda b: F.struct(a["m"].alias("a"), b["m"].alias("b")))
    return F.flatten(F.transform(numbered, later))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def texts(pair: Column) -> Column:
    """first and second of a pair of mandates; null for null."""
    return F.when(pair.isNotNull(), F.struct(pair["a"]["text"].alias("first"), pair["b"]["text"].alias("second")))


def differing(ms: Column) -> Column:
    return first(pairs(ms, lambda a, b: a["value"] != b["value"]))


def bounds(low: Column) -> Column:
    """Numbers of words that a text asks for, in order: phrase, kind, and least and most."""
    found = F.regexp_extract_all(low, F.lit(rx(LENGTH_BOUND, "i")), F.lit(0))

    def bound(phrase: Column) -> Column:
        label, n = F.lower(F.regexp_extract(phrase, rx(LENGTH_BOUND, "i"), 1)), F.coalesce(F.regexp_extract(phrase, rx(LENGTH_BOUND, "i"), 2).try_cast("bigint"), F.lit(0))
        kind = F.when(label.isin(*EXACT), "exact").when(label.isin(*LEAST), "least").otherwise("most")
        return F.struct(phrase.alias("phrase"), kind.alias("kind"), F.when(kind == "most", -1).otherwise(n).alias("lo"), F.when(kind == "least", (1 << 63) - 1).otherwise(n).alias("hi"))

    return F.transform(found, bound)


def incompatible(a: Column, b: Column) -> Column:
    return (a["kind"] != b["kind"]) & ((a["lo"] > b["hi"]) | (b["lo"] > a["hi"]))


def phrases(pair: Column) -> Column:
    return F.when(pair.isNotNull(), F.struct(pair["a"]["phrase"].alias("first"), pair["b"]["phrase"].alias("second")))


def length_conflict(ms: Column) -> Column:
    """Numbers of words that no text can have, within one mandate before across two."""
    all_bounds = F.flatten(F.transform(ms, lambda m, i: F.transform(bounds(m["text"]), lambda x: x.withField("of", i))))
    return F.coalesce(phrases(first(pairs(all_bounds, lambda a, b: (a["of"] == b["of"]) & incompatible(a, b)))), phrases(first(pairs(all_bounds, lambda a, b: (a["of"] != b["of"]) & incompatible(a, b)))))


def near_negator(m: Column) -> Column:
    """Whether a negator stands within NEAR bytes of the first place of the mandate's value."""
    at = F.instr(m["low"], m["value"])
    begin = F.octet_length(F.substring(m["low"], F.lit(1), at - 1))
    both = F.arrays_zip(F.split(m["low"], NEGATOR, -1).alias("gap"), F.regexp_extract_all(m["low"], F.lit(NEGATOR), F.lit(0)).alias("hit"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.octet_length(x["gap"])
        end = start + F.coalesce(F.octet_length(x["hit"]), F.lit(0))
        distance = F.when(start >= begin, start - begin).otherwise(F.greatest(begin - end, F.lit(0)))
        return F.struct(end.cast("int").alias("at"), (a["near"] | (x["hit"].isNotNull() & (distance <= NEAR))).alias("near"))

    return (at > 0) & F.aggregate(both, F.struct(F.lit(0).alias("at"), F.lit(False).alias("near")), step, lambda a: a["near"])


def format_conflict(ms: Column) -> Column:
    """Two formats that each are the only one, or one format that is asked for and forbidden."""
    marked = F.filter(ms, lambda m: m["value"].isNotNull() & m["low"].rlike(rx(EXCLUSIVE)))
    numbered = F.transform(ms, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    negated = lambda a, b: (a["i"] != b["i"]) & (a["m"]["polarity"] != b["m"]["polarity"]) & (a["m"]["value"] == b["m"]["value"]) & F.when(b["m"]["polarity"] < 0, near_negator(b["m"])).otherwise(near_negator(a["m"]))
    both = F.flatten(F.transform(numbered, lambda a: F.transform(F.filter(numbered, lambda b: F.coalesce(negated(a, b), F.lit(False))), lambda b: F.struct(a["m"].alias("a"), b["m"].alias("b")))))
    return F.coalesce(texts(differing(marked)), texts(first(both)))


def subjects(m: Column) -> Column:
    return F.filter(F.split(m["low"], r"[^\p{IsAlphabetic}\p{N}]+", -1), lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))


def opposite(ms: Column, name: Column) -> Column:
    """The first two mandates of opposite polarity; for some topics they share a paragraph, and a word."""
    local = name.isin(*SAME_PARAGRAPH)
    pair = first(pairs(ms, lambda a, b: (a["polarity"] != b["polarity"]) & (~local | (a["paragraph"] == b["paragraph"]))))
    return F.when(~local | F.arrays_overlap(subjects(pair["a"]), subjects(pair["b"])), texts(pair))


def of_topic(ms: Column, name: Column) -> Column:
    """first and second of a topic's one conflict, or null. ms: its mandates of a clear polarity."""
    plain = opposite(ms, name)
    pair = differing(ms)
    swap = (pair["b"]["value"] == "german") & (pair["a"]["value"] != "german")
    german_first = F.when(swap, F.struct(pair["b"]["text"].alias("first"), pair["a"]["text"].alias("second"))).otherwise(texts(pair))
    both = first(F.filter(ms, lambda m: F.size(m["hits"]) >= 2))
    own = F.when(both.isNotNull(), F.struct(F.get(both["hits"], F.lit(0))["term"].alias("first"), F.get(both["hits"], F.lit(1))["term"].alias("second")))
    valued = F.coalesce(own, texts(pair))
    return F.when(name == "format", format_conflict(ms)).when(name == "language", F.coalesce(german_first, plain)).when(name == "length", F.coalesce(valued, length_conflict(ms), plain)).when(name.isin(*VALUES), F.coalesce(valued, plain)).otherwise(plain)


def many_formats(ms: Column) -> Column:
    """first and second where mandates of one paragraph ask for three structured formats or more."""
    formats = F.filter(ms, lambda m: m["topic"] == "format")
    labels = lambda p: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(formats, lambda m: m["paragraph"] == p), lambda m: F.filter(F.transform(m["hits"], lambda h: h["label"]), lambda x: x.isin(*STRUCTURED))))))
    found = first(F.filter(F.transform(F.array_distinct(F.transform(formats, lambda m: m["paragraph"])), labels), lambda x: F.size(x) >= 3))
    return F.when(found.isNotNull(), F.struct(F.array_join(found, "+").alias("first"), F.lit("single format expected").alias("second")))


def prose_and_format(ms: Column) -> Column:
    one = first(F.filter(ms, lambda m: (m["topic"] == "format") & m["value"].isin(*STRUCTURED)))
    other = first(F.filter(ms, lambda m: m["topic"] == "prose"))
    return F.when(one.isNotNull() & other.isNotNull(), F.struct(one["text"].alias("first"), other["text"].alias("second")))


def conflict(name: Column, cls: Column, weight: Column, critical: Column, pair: Column) -> Column:
    return F.when(pair.isNotNull(), F.struct(name.alias("topic"), cls.alias("class"), weight.alias("weight"), critical.alias("critical"), pair["first"].alias("first"), pair["second"].alias("second")))


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with conflicts (topic, class, weight, critical, first, second; at most one for each topic), conflict_weight (at most MOST_WEIGHT) and has_critical_conflict.

    Formats first, then topics in the order of CONFLICTS. Null and empty texts have none. Columns of the same names are replaced."""
    df = mandates(docs, text, "_mandates")
    lit = lambda name, c, w, crit: F.struct(F.lit(name).alias("topic"), F.lit(c).alias("class"), F.lit(w).alias("weight"), F.lit(crit).alias("critical"))
    present = F.array_distinct(F.transform(F.filter("_mandates", lambda m: m["topic"].isNotNull() & (m["polarity"] != 0)), lambda m: m["topic"]))
    rows = pinned("_present", F.filter(F.array(*(lit(n, *row) for n, row in CONFLICTS.items())), lambda t: F.array_contains(F.col("_present"), t["topic"])))
    df = df.withColumns({"_present": present, "_many": many_formats(F.col("_mandates")), "_prose": prose_and_format(F.col("_mandates"))})
    by_topic = F.transform(rows, lambda t: F.struct(t.alias("t"), F.filter("_mandates", lambda m: (m["topic"] == t["topic"]) & (m["polarity"] != 0)).alias("ms")))
    df = df.withColumn("_by_topic", by_topic)
    df = df.withColumn("_found", F.transform("_by_topic", lambda x: F.struct(x["t"].alias("t"), of_topic(x["ms"], x["t"]["topic"]).alias("pair"))))
    format_done = F.col("_many").isNotNull() | F.col("_prose").isNotNull()
    whole = F.coalesce(conflict(F.lit("format"), F.lit(2), F.lit(4), F.lit(False), F.col("_many")), conflict(F.lit("format"), F.lit(2), F.lit(6), F.lit(True), F.col("_prose")))
    each = F.transform(F.filter("_found", lambda x: (x["t"]["topic"] != "format") | ~format_done), lambda x: conflict(x["t"]["topic"], x["t"]["class"], x["t"]["weight"], x["t"]["critical"], x["pair"]))
    df = df.withColumn("conflicts", F.array_compact(F.concat(F.array(whole), each))).drop("_mandates", "_present", "_many", "_prose", "_by_topic", "_found")
    total = F.aggregate("conflicts", F.lit(0), lambda a, c: a + c["weight"])
    return df.withColumns({"conflict_weight": F.least(total, F.lit(MOST_WEIGHT)), "has_critical_conflict": F.exists("conflicts", lambda c: c["critical"])})
