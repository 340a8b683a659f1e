import random
from collections import Counter

import numpy as np
import pyarrow as pa

from foliant.llm.bag_minhash import near_duplicates, shingles, signatures


def bag(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute(rows):
    bags = {i: bag(t) for i, t in rows}
    part = {i: i for i in bags}
    for i in sorted(bags):
        for j in sorted(bags):
            if j < i and (bags[i] == bags[j] or bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8):
                a, b = part[i], part[j]
                part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    return part


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words[:20]) for _ in range(400)), " ".join(rng.choice(words[5:]) for _ in range(300))]
    a, b = (Counter(t.split()) for t in texts)
    text, value, count, _ = shingles(pa.array(texts), 1)
    s = signatures(text, value, count, 2, m=4096)
    assert abs((s[0] == s[1]).mean() - similarity(a, b)) < 0.03


def test_weights_matter():
    text, value, count, _ = shingles(pa.array(["a a a a b", "a b b b b"]), 1)
    s = signatures(text, value, count, 2, m=4096)
    assert abs((s[0] == s[1]).mean() - 2 / 8) < 0.03


def test_matches_brute_force(table, prose):
    rng = random.Random(5)
    rows = [(i, prose(120, 100 + i)) for i in range(40)]
    base = prose(150, 7)
    rows += [(100 + i, edited(base, rng.randrange(0, 9), rng)) for i in range(80)]  # a crowd in which many pairs are below 0.8
    chain = prose(100, 8)
    for i in range(8):  # neighbours are close, ends are not
        rows.append((200 + i, chain))
        chain = edited(chain, 1, rng)
    rows += [(300, None), (301, ""), (302, " \n"), (303, "few words"), (304, "FEW  words"), (305, "few words more"), (306, "na " * 400), (307, "na " * 380), (308, "na " * 200), (309, base), (310, "x" * 60_000)]
    found = {r.doc_id: r for r in near_duplicates(table(rows)).collect()}
    want = brute(rows)
    assert {i: r.class_id for i, r in found.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in found.items())


def test_nulls_repeats_and_empty_table(table):
    assert near_duplicates(table([])).count() == 0
    found = sorted((tuple(r)[:3] for r in near_duplicates(table([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "alone")])).collect()), key=str)
    assert found == sorted([(None, 2, 2), (2, 2, 2), (2, 2, 2), (None, None, None)], key=str)


def test_no_shingle_no_point():
    assert np.isinf(signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 1)).all()
