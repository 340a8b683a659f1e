import hashlib
import re

from pyspark.sql import functions as F

from foliant.llm.exact_dedup import deduplicate


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), x in zip(rows, norm, strict=True):
        ids = [j for (j, _), y in zip(rows, norm, strict=True) if y == x]
        known = [j for j in ids if j is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(ids), keep is None or i == keep, hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (9, "a b"), (1, None), (2, ""), (None, "a b"), (None, "only"), (7, " "), (8, "\n\n"), (4, "a b "), (6, "x" * 100_000), (10, "x" * 100_000 + "y")]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_brute_force(table):
    assert got(deduplicate(table(ROWS))) == brute(ROWS)


def test_digests_that_clash_do_not_decide(table):
    assert got(deduplicate(table(ROWS), digest=lambda x: F.unhex(F.left(F.sha2(x, 256), F.lit(1))))) == brute(ROWS)


def test_hot_group_and_empty_table(table):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"other {i}") for i in range(50)]
    assert got(deduplicate(table(rows))) == brute(rows)
    assert got(deduplicate(table([]))) == []
