"""Words of many texts at once: boundaries, 64-bit hashes and hashes of word runs, as numpy arrays over UTF-8 bytes.

Nothing here loops over words in Python. Hashes depend on the bytes alone, so all executors agree on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BYTE_STEP, WORD_STEP = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93
WORD_BACK = pow(WORD_STEP, -1, 1 << 64)

#: Bytes of words that ASCII white space separates.
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII letters and digits and of all other characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, np.ndarray] = {}


def powers(step: int, n: int) -> np.ndarray:
    """step ** 0 .. step ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(step)
    if have is None or len(have) < n:
        factors = np.full(1 << max(10, (n - 1).bit_length()), step, U)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if len(have) <= 1 << 22:
            _powers[step] = have
    return have[:n]


@dataclass
class Words:
    """The words of a slice of texts. first[d]:first[d + 1] are the words of text d; start and end are bytes in buf."""

    buf: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, U)
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at - self.start, size)
        inner = place - np.repeat(self.start, size)
        value = BYTE_VALUE[self.buf[place]]
        value *= powers(BYTE_STEP, int(size.max()))[inner]
        return mix(np.add.reduceat(value, at) + size.astype(U))

    def string(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins; null is empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_string_view(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(texts: pa.Array, inside: np.ndarray = NOT_WHITE, lower: bool = False) -> Words:
    """inside: for each byte, whether words hold it. lower: A-Z count as a-z."""
    buf, at = text_buffer(texts)
    if lower:
        buf = LOWER[buf]
    ok = inside[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    start = ok & edge[:-1]
    start[1:] |= ok[1:] & ~ok[:-1]
    end = ok & edge[1:]
    end[:-1] |= ok[:-1] & ~ok[1:]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(buf, at, start, end, np.searchsorted(start, at))


class Runs:
    """Hashes of runs begin:end of word hashes; equal runs have equal hashes wherever they stand. Sums are made once."""

    def __init__(self, word: np.ndarray) -> None:
        n = len(word)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(word * powers(WORD_STEP, max(n, 1))[:n], out=self.sums[1:])
        self.back = powers(WORD_BACK, n + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(U))


def run_hashes(word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Runs(word)(begin, end)


def grams(w: Words, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of k words within one text, and their hashes."""
    n = np.maximum(w.count - k + 1, 0)
    at = np.repeat(w.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return at, run_hashes(word, at, at + k)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U else x.astype(np.int64)
