import hashlib
import random
import re

from foliant.llm.substring_dedup import remove_repeats


def brute(rows, size=13):
    own = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, w in own:
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            first[x] = min(first.get(x, float("inf")), key(d))
    out = []
    for d, w in own:
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < key(d) for p in range(k, k + size)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_brute_force(table, prose):
    rng = random.Random(9)
    passages = [prose(rng.randrange(13, 70), s).split() for s in range(12)]
    rows = []
    for i in range(120):
        w = prose(rng.randrange(5, 80), 1000 + i).split()
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p))
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = p[a : a + rng.randrange(10, 60)]
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(500, None), (501, ""), (502, "la " * 60), (503, "la " * 13), (504, "la " * 12), (None, rows[3][1]), (None, "null " * 20), (7, rows[3][1]), (505, "y" * 60_000 + " " + rows[9][1]), (506, "ä ö ü ß " * 6), (507, "ä ö ü ß " * 5)]
    assert got(remove_repeats(table(rows))) == brute(rows)


def test_shared_by_all(table, prose):
    rows = [(i, prose(6, i) + " " + prose(30, 99) + " " + prose(6, 500 + i)) for i in range(150)]
    assert got(remove_repeats(table(rows))) == brute(rows)


def test_empty_table(table):
    assert got(remove_repeats(table([]))) == []
