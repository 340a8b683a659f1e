"""Packs documents into sequences by bin completion with branch and bound.

Which documents share a sequence depends on their lengths alone. So Spark tokenises and cuts documents into pieces, counts
pieces by length (at most `capacity` numbers, whatever the input), the driver packs this histogram into patterns with
multiplicities, and Spark deals each piece the place that its rank among pieces of its length has in the patterns."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.bytewords import U, Words, words
from foliant.llm.shared import read, slices, stored

CAPACITY = 4096
END_OF_TEXT = 1
CACHED_WORDS = 2_000_000

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local_rank bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of the words that pieces() leaves whole: an apostrophe may begin a contraction, < a special token, and beyond ASCII only
#: the letters of Latin 1 (0xC3 and a second byte) are known to be letters.
WHOLE = np.zeros(256, bool)
WHOLE[[0x27, 0x3C, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


def pieces(texts: pa.Array) -> Words:
    """Words between white space, cut further between letters and other characters where the tokeniser cuts too, in lower case there.

    It never joins characters across these cuts, so each distinct piece needs encoding once: a word with other stops after it or in
    capitals is not a new one."""
    w = words(texts)
    if not len(w.start):
        return w
    buf, n = w.buf, len(w.buf)
    second = np.zeros(n, bool)
    second[1:] = buf[:-1] == 0xC3
    odd = WHOLE[buf] | (second & ((buf == 0x97) | (buf == 0xB7)))  # the signs among the letters
    at = np.zeros(n + 1, np.int64)
    np.cumsum(odd, out=at[1:])
    open_ = at[w.end] == at[w.start]
    mark = np.zeros(n + 1, np.int8)
    mark[w.start[open_]] += 1  # no two words share a start, or an end
    mark[w.end[open_]] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    low = np.where(inside & (((buf >= 0x41) & (buf <= 0x5A)) | (second & (buf >= 0x80) & (buf <= 0x9E))), buf + np.uint8(0x20), buf)
    letter = LETTER[buf]
    cut = np.zeros(n, bool)
    cut[1:] = inside[1:] & inside[:-1] & (letter[1:] != letter[:-1])
    cut[w.start] = True
    start = np.flatnonzero(cut)
    last = np.searchsorted(w.start, start, side="right") - 1
    end = np.minimum(np.r_[start[1:], n], w.end[last])
    return Words(low, w.text_at, start, end, np.searchsorted(start, w.text_at))


#: Texts by which a tokeniser shows whether it cuts and lower-cases as pieces() does.
PROBES = ["Don't STOP, Größe 3.5km/h a1b2 _x_ (hi)\tx  y\n\nÄÖÜ ç×÷ über-all 漢字 don’t", " ".join(f"a{chr(c)}b {chr(c)}A {chr(c) * 2} 1{chr(c)}2" for c in range(0x21, 0x7F))]


@dataclass
class WordTokens:
    """Ids of pieces by the piece's hash; of whole texts, if the tokeniser gives PROBES other ids than their pieces."""

    path: str
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))

    def __post_init__(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.by_piece = all(np.array_equal(*x) for x in zip(self.whole(PROBES), self.of_pieces(pa.array(PROBES)), strict=True))

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return place, self.keys[place] == key

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with END_OF_TEXT after it, and where each text begins."""
        return self.of_pieces(texts) if self.by_piece else self.whole([x or "" for x in texts.to_pylist()])

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[*x.ids, END_OF_TEXT] for x in self.encode(texts, add_special_tokens=False)]
        return np.array([y for x in ids for y in x], np.uint32), np.cumsum([0, *map(len, ids)])

    def of_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w = pieces(texts)
        distinct, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        place, known = self.look_up(distinct)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > CACHED_WORDS:
                self.keys, self.at, self.size, self.flat = self.keys[:0], self.at[:0], self.size[:0], self.flat[:0]
                new = np.arange(len(distinct))
            ids = [x.ids for x in self.encode([w.string(i) for i in first[new]], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            keys, at = np.r_[self.keys, distinct[new]], np.r_[self.at, len(self.flat) + np.cumsum(size) - size]
            sizes, order = np.r_[self.size, size], np.argsort(keys, kind="stable")
            self.flat = np.r_[self.flat, np.fromiter((y for x in ids for y in x), np.uint32, int(size.sum()))]
            self.keys, self.at, self.size = keys[order], at[order], sizes[order]
            place, _ = self.look_up(distinct)
        place = place[inverse]
        size = self.size[place]
        before = np.r_[0, np.cumsum(size)]
        text_at = before[w.first] + np.arange(len(w.first))
        out = np.full(text_at[-1], END_OF_TEXT, np.uint32)
        inner = np.arange(before[-1])
        source = inner + np.repeat(self.at[place] - before[:-1], size)
        out[inner + np.repeat(w.text, size)] = self.flat[source]
        return out, text_at


_tokens: dict[str, WordTokens] = {}


def pieces_of(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int) -> DataFrame:
    """A row for each piece; local_rank counts earlier pieces of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens.setdefault(tokenizer, None) or WordTokens(tokenizer)
        _tokens[tokenizer] = tokens
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for own in slices(batch, "text"):
                ids, at = tokens.documents(own.column("text"))
                total = np.diff(at)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                begin = at[doc] + start
                data = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(doc))
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(ordered, ordered) + seen[ordered]
                np.add.at(seen, length, 1)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": own.column("id").take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc,
                    "part": np.full(len(doc), part, np.int32), "local_rank": rank,
                })

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


class Fillings:
    """What can go beside a largest piece, given how many pieces of each length are left. exact: all undominated fillings, without width and steps."""

    def __init__(self, counts: np.ndarray, width: int, steps: int, exact: bool = False) -> None:
        self.left: list[int] = counts.tolist()
        self.lengths = sum(1 << x for x, n in enumerate(self.left) if n)  # as bits, for a fast search
        self.width, self.steps, self.exact = width, steps, exact

    def use(self, size: int, n: int) -> None:
        self.left[size] -= n
        if self.left[size]:
            self.lengths |= 1 << size
        else:
            self.lengths &= ~(1 << size)

    def largest(self, most: int) -> int:
        """The largest length up to most that is left, or 0."""
        return max((self.lengths & (1 << most + 1) - 1).bit_length() - 1, 0) if most > 0 else 0

    def dominated(self, filling: dict[int, int], slack: int) -> bool:
        """Whether a longer piece can replace one of the filling, or one piece two of it: that would waste less and leave smaller
        pieces. The pieces of the filling itself are not among those left."""
        sizes = list(filling)
        if any(self.largest(min(x + slack, len(self.left) - 1)) > x for x in sizes):
            return True
        pairs = ((x, y) for i, x in enumerate(sizes) for y in sizes[i + (filling[x] < 2) :])
        return any(x + y < len(self.left) and self.largest(min(x + y + slack, len(self.left) - 1)) >= x + y for x, y in pairs)

    def enumerate(self, room: int) -> list[dict[int, int]]:
        """Undominated fillings of the room as numbers of pieces by length, ordered by waste: at most `width`, found in at most
        `steps` steps, trying longer pieces and more of them first. Without any, the greedy filling."""
        found: list[tuple[int, dict[int, int]]] = []
        now: dict[int, int] = {}
        greedy: list[dict[int, int]] = []
        steps = 0

        def go(room: int, most: int) -> None:
            nonlocal steps
            steps += 1
            x = self.largest(min(room, most))
            if not x or not room:
                if not self.largest(room):  # else the filling isn't maximal
                    greedy.append(dict(now)) if not greedy else None
                    if not self.dominated(now, room):
                        found.append((room, dict(now)))
                return
            for n in range(min(self.left[x], room // x), -1, -1):
                if greedy and not self.exact and (steps >= self.steps or len(found) >= self.width):
                    return
                if n:
                    now[x] = n
                    self.use(x, n)
                go(room - n * x, x - 1)
                if n:
                    del now[x]
                    self.use(x, -n)
                if n * x == room and (n == 1 or not self.exact):  # nothing else fills this room better
                    return

        go(room, room)
        return [x for _, x in sorted(found, key=lambda p: p[0])] or greedy


def lower_bound(counts: np.ndarray) -> int:
    """No packing has fewer bins: total length, and Martello and Toth's bound by pieces too long to share."""
    capacity = len(counts) - 1
    size = np.arange(capacity + 1)
    mass, number = np.cumsum(counts * size), np.cumsum(counts)
    best = -(-int(mass[-1]) // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = number[-1] - number[capacity - k]
        middle, mid_mass = number[capacity - k] - number[capacity // 2], mass[capacity - k] - mass[capacity // 2]
        small = mass[capacity // 2] - mass[k - 1]
        best = max(best, int(alone + middle + max(0, -(-(small - (middle * capacity - mid_mass)) // capacity))))
    return best


Pattern = tuple[dict[int, int], int]


def take(space: Fillings, size: int, filling: dict[int, int]) -> Pattern:
    """Uses the filling with a piece of the size as often as the pieces left allow, once in an exact search."""
    pattern = filling | {size: filling.get(size, 0) + 1}
    times = 1 if space.exact else min(space.left[x] // n for x, n in pattern.items())
    for x, n in pattern.items():
        space.use(x, n * times)
    return pattern, times


def best_fit(counts: np.ndarray, width: int, steps: int) -> list[Pattern]:
    """Patterns and their multiplicities: always the largest piece left, and the filling found that wastes least."""
    space, out = Fillings(counts, width, steps), []
    while s := space.largest(len(counts) - 1):
        space.use(s, 1)
        filling = space.enumerate(len(counts) - 1 - s)[0]
        space.use(s, -1)
        out.append(take(space, s, filling))
    return out


def bin_completion(counts: np.ndarray, nodes: int = 3000, width: int = 6, steps: int = 200, per_length: int = 8, exact: bool = False, most_nodes: int = 16_000) -> list[Pattern]:
    """Branch and bound over the histogram, again and again with wider limits while the packing has more bins than the lower bound.

    A search has `width` fillings, found in `steps` steps, beside each largest piece, and ends after `nodes` nodes, or `per_length` for each distinct length
    if that is more; the next has four times the nodes and twice the others, until most_nodes have been tried in all. The best packing stands: a whole one
    in any case. exact: one search without such limits, over all undominated fillings of one bin after another, until no packing can have fewer bins; that
    may take a time exponential in the number of pieces."""
    bins = lambda packing: sum(n for _, n in packing)
    low = lower_bound(counts)
    best = best_fit(counts, 1, 1)
    if bins(best) > low:
        best = min(best, best_fit(counts, width, steps), key=bins)
    if exact:
        return bounded_search(counts, best, low, -1, width, steps, exact=True)
    nodes, tried = max(nodes, per_length * int((counts > 0).sum())), 0
    while bins(best) > low and tried < most_nodes:
        best = bounded_search(counts, best, low, nodes, width, steps)
        tried, nodes, width, steps = tried + nodes, min(4 * nodes, max(most_nodes - tried - nodes, 1)), 2 * width, 2 * steps
    return best


def bounded_search(counts: np.ndarray, best: list[Pattern], low: int, nodes: int, width: int, steps: int, exact: bool = False) -> list[Pattern]:
    """The incumbent or a packing of fewer bins. A branch ends once its waste exceeds what a packing with one bin less than the incumbent could have;
    a dive to a leaf takes at most a node for each distinct length."""
    capacity = len(counts) - 1
    total = int((counts * np.arange(capacity + 1)).sum())
    bins = lambda packing: sum(n for _, n in packing)
    space = Fillings(counts, width, steps, exact)
    packed: list[Pattern] = []
    waste = [0]
    choices: list[Iterator[tuple[int, dict[int, int]]]] = []

    def branch() -> None:
        s = space.largest(capacity)
        space.use(s, 1)
        found = space.enumerate(capacity - s)
        space.use(s, -1)
        choices.append(iter([(s, x) for x in found]))

    if bins(best) > low:
        branch()
    while choices and nodes and bins(best) > low:
        nodes -= 1
        if (choice := next(choices[-1], None)) is None:
            choices.pop()
            if choices:
                pattern, times = packed.pop()
                waste.pop()
                for x, n in pattern.items():
                    space.use(x, -n * times)
            continue
        pattern, times = take(space, *choice)
        packed.append((pattern, times))
        waste.append(waste[-1] + times * (capacity - sum(x * n for x, n in pattern.items())))
        if not space.lengths and bins(packed) < bins(best):
            best = packed[:]
        if space.lengths and waste[-1] <= (bins(best) - 1) * capacity - total:
            branch()
        else:
            choices.append(iter(()))  # undone on the next turn
    return best


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For runs of ranks of a length: the sequence of the first, and the offset of all. Sorted by key, length << 40 | first rank."""
    rank: dict[int, int] = {}
    key, sequence, offset, base = [], [], [], 0
    for pattern, times in patterns:
        at = 0
        for size in (x for x, n in pattern.items() for _ in range(n)):
            key.append(size << 40 | rank.get(size, 0))
            rank[size] = rank.get(size, 0) + times
            sequence.append(base)
            offset.append(at)
            at += size
        base += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return {"key": np.array(key, np.int64)[order], "sequence": np.array(sequence, np.int64)[order], "offset": np.array(offset, np.int64)[order]}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, **search: int) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset. search: limits of bin_completion(), or exact=True.

    Null and empty texts are documents of one token, the end-of-text id. Ids may be null or repeated: every row is packed.
    Ties between pieces of one length go by task and place in it. An empty table gives an empty result. Other columns are not read."""
    pieces = stored(pieces_of(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    table = places(bin_completion(histogram, **search))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(table["key"], batch.column("length").to_numpy() << 40 | rank, side="right") - 1
            out = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": table["sequence"][at] + rank - (table["key"][at] & (1 << 40) - 1), "offset": table["offset"][at]})

    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
