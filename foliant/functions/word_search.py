"""Which of some hundred words stand anywhere in texts: by numpy over the bytes of a batch, as a scan for each word, or an expression of all, costs a hundred times more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are searched at once, but for a longer text.
AT_ONCE = 4 << 20
BLANKS = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


#: ASCII letters, digits and the underscore; and all other ASCII bytes. Bytes of other characters are neither.
WORD = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"))
NO_WORD = ~WORD & (np.arange(256) < 128)


class Words:
    """Words as UTF-8, by their first three bytes; those of one or two bytes apart. A word may come with whether it begins, and ends, at a word's edge."""

    def __init__(self, words: list[str] | list[tuple[str, bool, bool]]):
        self.number = len(words)
        words = [(w, False, False) if isinstance(w, str) else w for w in words]
        self.words = sorted({w.encode() for w, _, _ in words})
        at = {w: i for i, w in enumerate(self.words)}
        self.uses: list[list[tuple[int, bool, bool]]] = [[] for _ in self.words]
        for i, (w, left, right) in enumerate(words):
            self.uses[at[w.encode()]].append((i, left, right))
        self.longest = max(map(len, self.words), default=1)
        heads = [int.from_bytes(w[:3], "big") if len(w) > 2 else -1 for w in self.words]
        self.heads = np.array(sorted({h for h in heads if h >= 0}), np.uint32)
        self.by_head = {int(h): [i for i, x in enumerate(heads) if x == h] for h in self.heads}
        self.short = [i for i, h in enumerate(heads) if h < 0]
        self.is_head = np.zeros(1 << 24, bool)
        self.is_head[self.heads] = True

    def found(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x words: which may be there, as of told()."""
        return self.told(data, offsets)[0].T

    def told(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words x rows, of rows of UTF-8 that lie in data from offsets on: which may be there, and which surely are, as beside other than ASCII it isn't told where words end, and white space in a word may be more than a space.

        Runs of ASCII white space count as one space."""
        data, offsets, odd = squeezed(data, offsets)
        may = np.zeros((self.number, len(offsets) - 1), bool)
        sure = np.zeros_like(may)
        padded = np.concatenate([data, np.zeros(self.longest + 2, np.uint8)])
        wide = padded.astype(np.uint32)
        heads = wide[: len(data)] << 16 | wide[1 : len(data) + 1] << 8 | wide[2 : len(data) + 2]

        def note(i: int, at: np.ndarray) -> None:
            if not len(at):
                return
            row = np.searchsorted(offsets, at, "right") - 1
            end = at + len(self.words[i])
            inside = end <= offsets[row + 1]
            at, end, row = at[inside], end[inside], row[inside]
            first, last = at == offsets[row], end == offsets[row + 1]
            before, behind = padded[at - 1], padded[end]
            plain = odd[at] == odd[end]
            for n, left, right in self.uses[i]:
                open_, told = np.ones(len(at), bool), plain
                if left:
                    open_, told = first | ~WORD[before], told & (first | NO_WORD[before])
                if right:
                    open_, told = open_ & (last | ~WORD[behind]), told & (last | NO_WORD[behind])
                may[n, row[open_]] = True
                sure[n, row[told]] = True

        for i in self.short:
            word = self.words[i]
            note(i, np.flatnonzero(heads >> 8 * (3 - len(word)) == int.from_bytes(word, "big")))
        places = np.flatnonzero(self.is_head[heads])
        own = heads[places]
        order = np.argsort(own, kind="stable")
        places, own = places[order], own[order]
        for h, begin, end in zip(self.heads, np.searchsorted(own, self.heads), np.searchsorted(own, self.heads, "right"), strict=True):
            for i in self.by_head[int(h)] if end > begin else ():
                at = places[begin:end]
                for j, byte in enumerate(self.words[i][3:], 3):
                    at = at[padded[at + j] == byte]
                note(i, at)
        return may, sure


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data and offsets with each run of white space as one space, and before each byte how many runs are more than that."""
    blank = BLANKS[data]
    kept = np.ones(len(data), bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    kept[offsets[:-1][offsets[:-1] < len(data)]] = True
    odd = blank & (data != 32)
    odd[:-1] |= ~kept[1:]
    before = np.concatenate([[0], np.cumsum(kept)])
    return np.where(blank, np.uint8(32), data)[kept], before[offsets], np.concatenate([[0], np.cumsum(odd[kept])])


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of rows, in order; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + AT_ONCE, "right")) - 1)
        own = offsets[begin : end + 1]
        yield data[own[0] : own[-1]], own - own[0]
        begin = end
