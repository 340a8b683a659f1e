"""Encodes texts into the pieces of a compiled model, with the place of every piece in the original bytes, and decodes them.

Normalisation is done here: at every character the longest key of the model's compiled character map is taken, and each byte of the
result records the byte of the source that it comes from. Pieces are found in the normalised text, whose normaliser is switched off in the
model, and their bounds are carried back through that record."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.shared import by_arrow, read, slices

SPACE, WORD_MARK = 0x20, "▁".encode()
REPLACEMENT = "\N{REPLACEMENT CHARACTER}".encode()
#: Types of pieces in a model file.
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6

DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a serialised message, as they come."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class CharMap:
    """A compiled character map: the length of a double-array trie, the trie, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.strings = np.frombuffer(blob[4 + size :], np.uint8)
        ends = np.flatnonzero(self.strings == 0)
        #: For each place in strings, where the replacement that begins there ends.
        self.ends = ends[np.searchsorted(ends, np.arange(len(self.strings)))] if len(ends) else np.zeros(0, np.int64)

    def longest(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start, the length of the longest key that begins there (0: none) and its replacement's place in strings.

        All starts go down the trie together, a byte a step, as long as any of them has a way on."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return length, value
        units, who = self.units, np.arange(len(starts))
        node = np.full(len(starts), self._offset(units[:1])[0])
        at, step = starts.copy(), 0
        while len(who):
            inside = at < len(buf)
            who, node, at = who[inside], node[inside], at[inside]
            byte = buf[at].astype(np.int64)
            node = node ^ byte
            inside = node < len(units)
            who, node, at, byte = who[inside], node[inside], at[inside], byte[inside]
            unit = units[node]
            same = (unit & 0x800000FF) == byte
            who, node, at, unit = who[same], node[same], at[same], unit[same]
            node = node ^ self._offset(unit)
            step += 1
            leaf = (unit >> 8) & 1 == 1
            length[who[leaf]] = step
            value[who[leaf]] = units[node[leaf]] & 0x7FFFFFFF
            at = at + 1
        return length, value

    @staticmethod
    def _offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 512) >> 6)


@dataclass
class Normalized:
    #: UTF-8
    text: np.ndarray
    #: For each byte, and for the end, the byte of the source it comes from.
    source: np.ndarray


class Normalizer:
    """What a model file says of normalisation, applied with a record of where each byte comes from."""

    def __init__(self, spec: dict[int, int | bytes], suffix: bool = False, symbols: list[bytes] = ()):
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        #: They are passed on as they are.
        self.symbols = re.compile(b"|".join(re.escape(s) for s in sorted(symbols, key=len, reverse=True))) if symbols else None

    def _chunks(self, raw: bytes, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of what is replaced as one, and places in (source, replacements, U+FFFD) of what takes its place, from and to."""
        n, strings = len(buf), len(self.map.strings)
        try:
            raw.decode()
            starts = np.flatnonzero((buf & 0xC0) != 0x80)
            broken = np.zeros(len(starts), bool)
        except UnicodeDecodeError:
            starts, broken = self._characters(raw)
        size = np.diff(starts, append=n)
        length, value = self.map.longest(buf, starts)
        length[broken] = 0
        own = np.zeros(len(starts), bool)
        if self.symbols:
            # At any start that the scan reaches, a symbol goes before the map.
            for k, at in enumerate(starts):
                if found := self.symbols.match(raw, at):
                    length[k], own[k] = found.end() - at, True
        taken = np.ones(len(starts), bool)
        reach = 0
        for k in np.flatnonzero(length > size):
            if starts[k] >= reach:
                reach = starts[k] + length[k]
                taken[k + 1 : np.searchsorted(starts, reach)] = False
        starts, size, length, value, own, broken = (x[taken] for x in (starts, size, length, value, own, broken))
        mapped = (length > 0) & ~own
        begin = np.where(mapped, n + value, starts)
        end = np.where(mapped, n + (self.map.ends[value] if strings else 0), starts + np.where(own, length, size))
        begin[broken], end[broken] = n + strings, n + strings + len(REPLACEMENT)
        return starts, begin, end

    @staticmethod
    def _characters(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the characters of bytes that are not all UTF-8, and which of them are single wrong bytes."""
        starts, broken, at = [], [], 0
        while at < len(raw):
            size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            try:
                good = len(raw[at : at + size].decode()) == 1
            except UnicodeDecodeError:
                good = False
            starts.append(at)
            broken.append(not good)
            at += size if good else 1
        return np.array(starts, np.int64), np.array(broken, bool)

    def __call__(self, raw: bytes) -> Normalized:
        buf = np.frombuffer(raw, np.uint8)
        nothing = Normalized(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        if not len(buf):
            return nothing
        starts, begin, end = self._chunks(raw, buf)
        pool = np.concatenate([buf, self.map.strings, np.frombuffer(REPLACEMENT, np.uint8)])
        size = end - begin
        total = int(size.sum())
        chunk = np.repeat(np.arange(len(starts)), size)
        first = np.cumsum(size) - size
        out = pool[begin[chunk] + np.arange(total) - first[chunk]]
        space = out == SPACE
        begun = 0
        if self.squeeze:
            single = (size == 1) & (pool[np.minimum(begin, len(pool) - 1)] == SPACE)
            if single.all():
                return nothing
            begun = int(starts[np.argmin(single)])
            # Leading spaces of a chunk go if the last chunk with anything in it ends with one, or if there is none.
            full = np.flatnonzero(size)
            after = np.ones(len(starts), bool)
            after[full[1:]] = pool[end[full[:-1]] - 1] == SPACE
            words = np.cumsum(~space)
            leading = words - np.where(first[chunk] > 0, words[first[chunk] - 1], 0) == 0
            kept = ~(space & leading & after[chunk])
        else:
            kept = np.ones(total, bool)
        out, space, source = out[kept], space[kept], starts[chunk[kept]]
        stop = len(buf)
        mark = np.frombuffer(WORD_MARK if self.escape else b" ", np.uint8)
        many = np.where(space, len(mark), 1)
        at = np.cumsum(many) - many
        text, source = np.repeat(out, many), np.repeat(source, many)
        for k, byte in enumerate(mark):
            text[at[space] + k] = byte
        if self.prefix and not self.suffix:
            text, source = np.concatenate([mark, text]), np.concatenate([np.full(len(mark), begun), source])
        if self.squeeze:
            while len(text) >= len(mark) and (text[-len(mark) :] == mark).all():
                stop = int(source[len(text) - len(mark)])
                text, source = text[: -len(mark)], source[: -len(mark)]
        if self.prefix and self.suffix:
            text, source = np.concatenate([text, mark]), np.concatenate([source, np.full(len(mark), stop)])
        return Normalized(text, np.append(source, stop))


@dataclass
class Encoded:
    """Ids of a text, begin and end ids with them, and the bytes [start, end) of the source that each stands for."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Codec:
    """A model file's normaliser, pieces and decoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            model = file.read()
        pieces, spec, trainer = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                spec |= dict(fields(value))
        self.kind = np.array([p.get(3, 1) for p in pieces])
        # A piece for a byte stands for one byte, whatever its name.
        self.size = np.where(self.kind == BYTE, 1, [len(p[1]) for p in pieces])
        self.names = [p[1] for p in pieces]
        self.normalizer = Normalizer(spec, bool(trainer.get(24, 0)), [n for n, k in zip(self.names, self.kind, strict=True) if k == USER_DEFINED])
        # A later field of a message replaces an earlier one: no map, no prefix, spaces as they are.
        plain = bytes([2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.inner = SentencePieceProcessor(model_proto=model + bytes([3 << 3 | 2, len(plain)]) + plain)
        self.own = SentencePieceProcessor(model_proto=model)
        self.first, self.last = ([i] if i >= 0 else [] for i in (self.own.bos_id(), self.own.eos_id()))

    def encode(self, texts: list[bytes]) -> list[Encoded]:
        normal = [self.normalizer(t) for t in texts]
        strings = [x.text.tobytes() for x in normal]
        found = self.inner.encode(strings, num_threads=1) if strings else []
        return [self._placed(ids, x, string, len(raw)) for ids, x, string, raw in zip(found, normal, strings, texts, strict=True)]

    def _placed(self, found: list[int], normal: Normalized, string: bytes, n: int) -> Encoded:
        ids = np.array(found, np.int64)
        kind, size = self.kind[ids], self.size[ids]
        if (kind == UNKNOWN).any():
            size = np.array([len(p.encode()) for p in self.inner.encode(string.decode(), out_type=str)])
        end = np.cumsum(size)
        start = end - size
        a, b = normal.source[start], normal.source[end]
        single = kind == BYTE
        if single.any():
            # The last byte of a character stands for all of it, those before for nothing, at its start.
            lead = np.append(np.flatnonzero((normal.text & 0xC0) != 0x80), len(normal.text))
            which = np.searchsorted(lead, start[single], "right") - 1
            a[single] = normal.source[lead[which]]
            b[single] = np.where(end[single] == lead[which + 1], normal.source[lead[which + 1]], a[single])
        return Encoded(np.concatenate([self.first, ids, self.last]).astype(np.int64), np.concatenate([[0] * len(self.first), a, [n] * len(self.last)]).astype(np.int64), np.concatenate([[0] * len(self.first), b, [n] * len(self.last)]).astype(np.int64))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.own.decode([x.tolist() for x in ids], num_threads=1) if ids else []


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def raw_texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def encode_documents(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with ids array<int>, starts and ends array<bigint>, a span in the UTF-8 bytes of the text for each id.

    Null texts count as empty and have the begin and end ids only. Every other column stays, and columns of these names are replaced;
    rows are taken one by one, so repeated ones stay. Bytes that are not UTF-8 become U+FFFD, a byte each."""
    kept = docs.drop("ids", "starts", "ends")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "ids array<int>", "starts array<bigint>", "ends array<bigint>"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(model or default_model())
        for own in slices(batch, text):
            found = c.encode(raw_texts(own.column(text)))
            bounds = np.cumsum([0, *(len(x.ids) for x in found)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([getattr(x, name) for x in found]), kind)) for name, kind in (("ids", pa.int32()), ("start", pa.int64()), ("end", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *lists], [*own.schema.names, "ids", "starts", "ends"])

    return by_arrow(kept, run, schema)


def decode_documents(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """encoded with decoded, the text that its ids stand for; of null ids, empty. A column of that name is replaced."""
    kept = encoded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "decoded string"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = codec(model or default_model()).decode([np.array(x or [], np.int64) for x in batch.column(ids).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return by_arrow(kept, run, schema)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document, numbers and digests of what encode_documents() and decode_documents() give: doc_id, n_tokens, ids_sha256, decoded_sha256
    and spans_sha256 (of starts and ends by turns, as little-endian 64-bit integers). Lists of ids stay in the task that makes them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(model or default_model())
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for own in slices(batch, "text"):
            found = c.encode(raw_texts(own.column("text")))
            texts = c.decode([x.ids for x in found])
            columns = [
                own.column("doc_id"),
                pa.array([len(x.ids) for x in found], pa.int64()),
                pa.array([sha(x.ids.astype("<u4").tobytes()) for x in found]),
                pa.array([sha(t.encode()) for t in texts]),
                pa.array([sha(np.stack([x.start, x.end], 1).astype("<i8").tobytes()) for x in found]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return by_arrow(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text"), run, DIGEST_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
