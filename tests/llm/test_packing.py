import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from foliant.llm.packing import WordTokens, bin_completion, lower_bound, pack


def bins(sizes, capacity=20, **search):
    counts = np.bincount(np.array(sizes, int), minlength=capacity + 1)
    packed, used = bin_completion(counts, **search), np.zeros(capacity + 1, int)
    for pattern, times in packed:
        assert sum(x * n for x, n in pattern.items()) <= capacity
        for x, n in pattern.items():
            used[x] += n * times
    assert (used == counts).all()
    return sum(n for _, n in packed)


@pytest.mark.parametrize(("sizes", "best"), [([], 0), ([20], 1), ([11, 9, 10, 10], 2), ([12, 7, 7, 6, 5, 3], 2), ([10, 9, 8, 7, 6, 5, 4, 4, 4, 3], 3), ([7] * 6, 3), ([1] * 45, 3)])
def test_best_known_packings(sizes, best):
    assert bins(sizes) == best


def test_close_to_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 21, 60)
        assert bins(sizes) <= lower_bound(np.bincount(sizes, minlength=21)) + 1


def fewest(sizes, capacity):
    """Fewest bins, by the best last bin of every subset."""
    best = [(0, 0)] + [(len(sizes) + 1, 0)] * ((1 << len(sizes)) - 1)
    for subset in range(1, 1 << len(sizes)):
        for i, x in enumerate(sizes):
            if subset >> i & 1:
                n, room = best[subset ^ 1 << i]
                best[subset] = min(best[subset], (n, room - x) if room >= x else (n + 1, capacity - x), key=lambda b: (b[0], -b[1]))
    return best[-1][0]


def test_exact_search_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = rng.integers(3, 15, 11).tolist()
        assert bins(sizes, exact=True) == fewest(sizes, 20) <= bins(sizes)
    for sizes in ([5, 5, 2, 6, 6, 8, 8, 4, 4], [9, 9, 7, 7, 4, 4, 4, 4, 4, 4, 4]):
        assert bins(sizes, exact=True) == fewest(sizes, 20)


def test_search_reaches_leaves_behind_thousands_of_lengths():
    hard = [6, 7, 7, 9, 10, 11, 11, 12]
    pairs = [x for x in range(5001, 8500) if x % 400]
    sizes = [400 * x for x in hard] + pairs + [10_000 - x for x in pairs]
    assert bins(hard, 25) == 3
    assert bins(sizes, 10_000) == len(pairs) + 3


def test_pieces_and_places(table, prose):
    rows = [(1, prose(300, 1)), (2, None), (3, ""), (4, prose(90, 2) + " <|endoftext|> it's ÄÖ é 漢字"), (5, prose(2000, 3)), (None, "null id"), (1, prose(300, 1)), (6, "a" * 5000)]
    capacity = 256
    found = pack(table(rows), capacity=capacity).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(map(str, (tuple(r)[:5] for r in found))) == sorted(map(str, want))
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= -(-sum(w[3] for w in want) // capacity) + 1


def test_empty_table_and_limits(table):
    assert pack(table([])).count() == 0
    assert pack(table([(1, "a b"), (2, "c")]), capacity=4, exact=True).count() == pack(table([(1, "a b"), (2, "c")]), capacity=4, width=2, steps=9, nodes=5).count() == 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokeniser_gives_its_own_ids(prose, name):
    path = public_tokenizers.path(name)
    tokens, tokenizer = WordTokens(path), Tokenizer.from_file(path)
    assert tokens.by_piece == (name == "word_bpe_49k.json")
    texts = [prose(50, 1).title(), "", None, "It's  ÄÖÜ\tx-1, 漢字 <|endoftext|>"]
    ids, at = tokens.documents(pa.array(texts))
    for t, a, b in zip(texts, at, at[1:], strict=False):
        assert ids[a:b].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_wider_searches_find_what_the_first_misses():
    import numpy as np

    from foliant.llm.packing import bin_completion, lower_bound

    counts = np.bincount(np.random.default_rng(1).integers(1000, 2000, 60), minlength=4097)
    found = bin_completion(counts)
    assert sum(n for _, n in found) == 23 and lower_bound(counts) <= 23
    assert sum(n for _, n in bin_completion(counts, most_nodes=3000)) == 24
    used = np.zeros(4097, int)
    for pattern, times in found:
        assert sum(x * n for x, n in pattern.items()) <= 4096
        for x, n in pattern.items():
            used[x] += n * times
    assert (used == counts).all()
