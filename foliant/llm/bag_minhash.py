"""Near-duplicate texts by BagMinHash: weighted Jaccard similarity of multisets of word shingles.

A shingle's weight is how often it occurs. Each shingle owns a Poisson process of points over (time, weight, register); weight
is cut into dyadic intervals, and inside one a point's place is found bit by bit, as in a binary tree. A register of a text's
signature is the earliest point under the weights of its shingles, so two signatures agree in a register with the weighted
Jaccard similarity as the probability. Points come in order of time and end with the latest register, so that a long text costs
little more than one point for each shingle.

Signatures are banded; texts that share a band are compared with leaders of the band first, and the overlap of multisets decides.
What then still lies in other components than most texts of its band is the query set: it is held against the band's texts in
blocks of a bounded size, by signatures, and likely pairs are verified there by their multisets. So every pair of texts in different components that
shares a band is looked at, while a large group of copies only costs its links to leaders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.bytewords import U, grams, mix, run_hashes, signed, words
from foliant.llm.components import components
from foliant.llm.shared import by_arrow, discard, read, slices, stored

SHINGLE, SIMILAR = 5, 0.8
MASK = (1 << 64) - 1
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Registers of the longer signatures that the last round estimates similarity with, and the share of them that two must have in
#: common for their texts to be compared: 3.9 standard deviations below SIMILAR.
WIDE, LIKELY = 256, 0.7025
#: About as many texts, and shingles, of each side of a block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Leaders that a text is compared with in a round, those first with which it shares most keys.
LEADERS = 3
#: Rounds with leaders before the last round.
ROUNDS = 3


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: the text, the shingle's hash and its count, by text and hash; and each text's number of words.

    Words are what ASCII white space separates, A-Z as a-z. A text of fewer than k words, but not none, is one shingle."""
    w = words(texts, lower=True)
    word = w.hashes()
    n = w.count
    begin, value = grams(w, word, k)
    text = np.searchsorted(w.first, begin, side="right") - 1
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        text, value = np.r_[text, short], np.r_[value, run_hashes(word, w.first[short], w.first[short + 1])]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])]) if len(text) else np.zeros(0, np.int64)
    return text[new], value[new], np.diff(np.r_[new, len(text)]), n


def signatures(text: np.ndarray, value: np.ndarray, count: np.ndarray, n_texts: int, m: int = REGISTERS) -> np.ndarray:
    """[text, register]: the time of the register's earliest point, which identifies the point. Infinite for texts without shingles."""
    best = np.full(n_texts * m, np.inf)
    bound = np.full(n_texts, np.inf)
    of, key, low, span, weight = [], [], [], [], []
    lo, size, j = 0, 1, 0
    while len(own := np.flatnonzero(count > lo)):
        of.append(text[own])
        key.append(mix(value[own] + U(j * 0x9E3779B97F4A7C15 & MASK)))
        low.append(np.full(len(own), lo, np.int64))
        span.append(np.full(len(own), size, np.int64))
        weight.append(count[own])
        lo, size, j = lo + size, lo + size, j + 1
    if not of:
        return best.reshape(n_texts, m)
    of, key, low, span, weight = (np.concatenate(x) for x in (of, key, low, span, weight))
    time, k = np.zeros(len(of)), 0
    while len(of):
        k += 1
        a = mix(key + U(k * 0xD1B54A32D192ED03 & MASK))
        b = mix(a ^ U(0x8CB92BA72F3D8DD7))
        time = time - np.log(((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * span)
        place = low + ((b & U(0xFFFFFFFF)).astype(np.int64) * span >> 32)
        ok = (place < weight) & (time < bound[of])
        at = of[ok] * m + ((b[ok] >> U(32)).astype(np.int64) * m >> 32)
        np.minimum.at(best, at, time[ok])
        touched = np.unique(of)
        bound[touched] = best.reshape(n_texts, m)[touched].max(axis=1)
        live = time < bound[of]
        of, key, low, span, weight, time = of[live], key[live], low[live], span[live], weight[live], time[live]
    return best.reshape(n_texts, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """[text, band]: one number for the registers of each band."""
    value = mix(signature.view(U))
    rows = value.reshape(len(signature), BANDS, ROWS) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], U)
    return mix(rows.sum(axis=2, dtype=U) + np.arange(1, BANDS + 1, dtype=U) * U(0xD6E8FEB86659FD93))


def short(signature: np.ndarray) -> np.ndarray:
    """[text, register]: 16 bits of each register."""
    return (mix(signature.view(U)) >> U(48)).astype(np.uint16)


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(signed(x).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, two hashes of the multiset of shingles, its size, and the keys of the bands; null keys for texts without words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in slices(batch, "text"):
            text, value, count, _ = shingles(own.column("text"), k)
            n = len(own)
            bags = []
            for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
                bag = np.zeros(n, U)
                np.add.at(bag, text, mix(value ^ U(salt)) * count.astype(U))
                bags.append(signed(bag))
            keys = lists(band_keys(signatures(text, value, count, n)))
            size = np.bincount(text, count, n).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"id": own.column("id"), "bag1": bags[0], "bag2": bags[1], "size": size, "keys": pc.if_else(pa.array(size > 0), keys, None)})

    return by_arrow(docs, run, "id bigint, bag1 bigint, bag2 bigint, size bigint, keys array<bigint>")


def bags(docs: DataFrame, k: int) -> DataFrame:
    """id, the shingles' hashes in order and their counts as bytes, and 16 bits of each register of a short and of a longer signature."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own in slices(batch, "text"):
            text, value, count, _ = shingles(own.column("text"), k)
            at = np.searchsorted(text, np.arange(len(own) + 1))
            value_bytes, count_bytes = memoryview(value.tobytes()), memoryview(count.astype(np.uint32).tobytes())
            cut = lambda data, width: [bytes(data[width * a : width * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            registers = [[x.tobytes() for x in short(signatures(text, value, count, len(own), m))] for m in (REGISTERS, WIDE)]
            yield pa.RecordBatch.from_pydict({"id": own.column("id"), "hashes": cut(value_bytes, 8), "counts": cut(count_bytes, 4), "registers": registers[0], "wide": registers[1]})

    return by_arrow(docs, run, "id bigint, hashes binary, counts binary, registers binary, wide binary")


def overlap(a: bytes, a_count: bytes, b: bytes, b_count: bytes) -> float:
    """Weighted Jaccard similarity of two multisets."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    n, m = np.frombuffer(a_count, np.uint32).astype(np.int64), np.frombuffer(b_count, np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.minimum(n, m[at])[y[at] == x].sum())
    return common / (int(n.sum()) + int(m.sum()) - common)


def verified(pairs: DataFrame, bag: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough. A popular b is sent its partners' multisets, and Spark can split it."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols = [batch.column(c) for c in ("hashes", "counts", "b_hashes", "b_counts")]
        ok = np.array([overlap(*(c[i].as_buffer() for c in cols)) >= similar for i in range(batch.num_rows)], bool)
        yield batch.select(["a", "b"]).filter(pa.array(ok))

    own = bag.select(F.col("id").alias("a"), "hashes", "counts")
    other = bag.select(F.col("id").alias("b"), F.col("hashes").alias("b_hashes"), F.col("counts").alias("b_counts"))
    return by_arrow(pairs.select("a", "b").join(own, "a").join(other, "b").select("a", "b", "hashes", "counts", "b_hashes", "b_counts"), run, "a bigint, b bigint")


def placed(keyed: DataFrame, part: DataFrame | None) -> DataFrame:
    """part: id and component of texts that have one by now; others are their own."""
    if part is None:
        return keyed.withColumn("component", F.col("id"))
    return keyed.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))


def leaders(keyed: DataFrame, part: DataFrame | None, seed: int, similar: float) -> DataFrame:
    """Pairs of texts a and leaders b of bands they share, from different components and close enough in size.

    keyed: id, size, key. A leader is chosen by a hash of its id, so that a group's bands mostly have the same ones."""
    keyed = placed(keyed, part)
    first = F.min_by(F.struct("id", "component", "size"), F.xxhash64("id", F.lit(seed)))
    led = keyed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), first.alias("leader")).where("lo < hi")
    met = keyed.withColumn("at", F.struct("key")).join(led.select(F.struct("key").alias("at"), "leader"), "at").where("component != leader.component")
    pairs = met.where(F.least("size", "leader.size") >= similar * F.greatest("size", "leader.size")).groupBy(F.col("id").alias("a"), F.col("leader.id").alias("b")).agg(F.count("*").alias("shared"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= LEADERS).select("a", "b")


def blocks(keyed: DataFrame, part: DataFrame | None, bag: DataFrame) -> DataFrame:
    """For each band with several components: queries, texts outside its largest one, beside targets, all its texts, a block of
    each at a time. Rows of a block have the same key, t and q."""
    keyed = placed(keyed, part)
    inside = keyed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    largest = F.max_by(F.struct("component", "n", "s"), F.struct("n", "component"))
    band = inside.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), largest.alias("main")).where("main.n < n")
    number = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    band = band.select(F.struct("key").alias("at"), F.col("main.component").alias("main"), number(F.col("n"), F.col("s")).alias("ts"), number(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("qs"))
    rows = keyed.withColumn("at", F.struct("key")).join(band, "at").join(bag, "id")
    columns = ["key", "band", "id", "size", "component", "registers", "wide", "hashes", "counts", (F.col("component") == F.col("main")).alias("is_main")]
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    targets = rows.select(*columns, F.lit(False).alias("query"), own("ts").alias("t"), each("qs").alias("q"))
    queries = rows.where("component != main").select(*columns, F.lit(True).alias("query"), own("qs").alias("q"), each("ts").alias("t"))
    at = ["key", "t", "q"]
    return targets.unionByName(queries).repartition(*at).sortWithinPartitions(*at)


def linked(units: DataFrame, similar: float) -> DataFrame:
    """Links between queries and targets in different components. Of a block's pairs whose signatures agree enough, in the first band
    they share, the likelier are verified first, and pairs that other links of the block connect already need none: so a block has
    fewer links than components."""

    def compare(rows: pa.Table) -> list[tuple[int, int]]:
        query = rows.column("query").to_numpy(zero_copy_only=False)
        ids, size, part, main = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "size", "component", "is_main"))
        regs, wide = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint16).reshape(len(ids), -1) for c in ("registers", "wide"))
        band, q, t = rows.column("band")[0].as_py(), np.flatnonzero(query), np.flatnonzero(~query)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(q), 64):
            x = q[a : a + 64]
            ok = (part[x][:, None] != part[t]) & (main[t] | (ids[t] < ids[x][:, None])) & (np.minimum(size[x][:, None], size[t]) >= similar * np.maximum(size[x][:, None], size[t]))
            i, j = np.nonzero(ok)
            i, j = x[i], t[j]
            agree = np.concatenate([(wide[i[b : b + 8192]] == wide[j[b : b + 8192]]).sum(axis=1) for b in range(0, len(i), 8192)] or [np.zeros(0)])
            good = agree >= LIKELY * WIDE
            good[good] = (regs[i[good]] == regs[j[good]]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            found.append((i[good], j[good], agree[good]))
        x, y, agree = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], np.zeros(0))
        hashes, counts, parent, out = rows.column("hashes"), rows.column("counts"), {}, []

        def root(c: int) -> int:
            while c in parent:
                c = parent[c]
            return c

        for k in np.argsort(-agree, kind="stable").tolist():
            i, j = int(x[k]), int(y[k])
            one, other = root(int(part[i])), root(int(part[j]))
            if one != other and overlap(hashes[i].as_buffer(), counts[i].as_buffer(), hashes[j].as_buffer(), counts[j].as_buffer()) >= similar:
                parent[one] = other
                out.append((int(ids[i]), int(ids[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def result(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            at = np.stack([rows.column(c).to_numpy() for c in ("key", "t", "q")])
            cut = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
            found = [p for a, b in zip(cut, cut[1:], strict=False) for p in compare(rows.slice(a, b - a))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            at = np.stack([rows.column(c).to_numpy() for c in ("key", "t", "q")])
            new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0))
            whole = int(new[-1]) + 1 if len(new) else 0
            if whole:
                yield from result(rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None and rest.num_rows:
            yield from result(rest)

    return units.mapInArrow(run, "a bigint, b bigint")


def united(part: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links."""
    if part is None:
        return stored(components(links).select(F.col("node").alias("id"), "component"), "parts")
    named = part.select(F.col("id").alias("a"), F.col("component").alias("a_part"))
    links = links.join(named, "a", "left").join(named.toDF("b", "b_part"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    found = components(links)
    moved = part.join(found.select(F.struct("node").alias("at"), F.col("component").alias("to")), F.struct(part["component"].alias("node")) == F.col("at"), "left").select("id", F.coalesce("to", "component").alias("component"))
    fresh = found.join(part.select(F.col("id").alias("node")), "node", "left_anti").select(F.col("node").alias("id"), "component")
    return stored(moved.union(fresh), "parts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """A row for each input row: id, class_id (smallest id of its class), rep_id (smallest id with the same multiset of shingles), n_shingles and kept.

    Classes are connected components of pairs with a weighted Jaccard similarity of `similar` or more. kept: id is class_id.
    Texts without words (null, empty, blank) are one class. Repeated rows share their id's class. A null id is larger than any
    other; where a multiset occurs with null ids only, class_id and rep_id are null and the row is kept. An empty table gives an
    empty result. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketch = stored(sketches(rows, shingle), "sketches")
    same = ["bag1", "bag2", "size"]
    reps = stored(sketch.groupBy(*same).agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "distinct-bags")
    keyed = reps.where("rep is not null and keys is not null").select(F.col("rep").alias("id"), "size", F.posexplode("keys").alias("band", "key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.struct("key").alias("at"))
    crowd = stored(keyed.withColumn("at", F.struct("key")).join(crowded, "at").select("id", "size", "band", "key"), "crowd")
    bag = stored(bags(rows.join(crowd.select("id").distinct(), "id", "left_semi"), shingle), "bags")
    part: DataFrame | None = None
    for turn in range(ROUNDS + 1):
        found = verified(leaders(crowd, part, turn, similar), bag, similar) if turn < ROUNDS else linked(blocks(crowd, part, bag), similar)
        links = stored(found, "links")
        if not links.isEmpty():
            part = united(part, links)
    discard(crowd, bag)
    if part is not None:
        reps = reps.join(part.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        reps = reps.withColumn("component", F.lit(None).cast("bigint"))
    classes = reps.select(F.struct(*same).alias("at"), "rep", F.coalesce("component", "rep").alias("class_id"))
    out = sketch.select("id", F.struct(*same).alias("at"), "size").join(classes, "at")
    return out.select(F.col("id").alias(id_col), "class_id", F.col("rep").alias("rep_id"), F.col("size").alias("n_shingles"), F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
