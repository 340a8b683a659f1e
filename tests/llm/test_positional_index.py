import hashlib
import re

import pyarrow as pa

from foliant.llm.positional_index import build_index, contamination, proximity, windows_of


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    tests = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            tests.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, owners in tests.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= owners
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases(prose):
    long = prose(60, 1)
    items = [(1, prose(25, 2)), (2, "Tiny Phrase"), (10, prose(10, 3)), (11, None), (12, "  "), (13, prose(25, 2)), (14, "größe 12 Ü")]
    docs = [(1, long), (2, prose(25, 2).upper()), (3, long + " " + prose(25, 2)[20:120] + ", " + long), (4, "a tiny, PHRASE tiny phrase"), (5, None), (6, ""), (None, prose(10, 3)), (7, prose(10, 3)), (7, prose(9, 3)), (8, "x GRÖßE größe-12 Ü größe 12 Ü"), (9, "z" * 50_000)]
    return docs, items


def test_matches_brute_force(spark, table, prose):
    docs, items = cases(prose)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (1 << 20, 60):
        found = contamination(table(docs), bench, block_bytes=block).select(columns)
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.contaminated for r in contamination(table([(1, "a b")]), none).collect()] == [False]
    assert contamination(table([]), none).count() == 0


def test_proximity(table):
    index = build_index(table([(1, "red a b blue"), (2, "red a b c d e blue"), (3, "blue"), (4, "blue x red")]))
    assert sorted(r.doc_id for r in proximity(index, ["Red", "blue"], 3).collect()) == [1, 4]


def test_items_without_an_id_hit(spark, table, prose):
    bench = spark.createDataFrame([(None, prose(12, 4)), (None, prose(12, 5)), (3, prose(12, 6)), (None, None)], "item_id bigint, text string")
    docs = [(1, f"{prose(12, 4)} and {prose(12, 5)}"), (2, prose(12, 6)), (3, f"{prose(12, 5)} or {prose(12, 6)}"), (4, prose(12, 7))]
    for block in (1 << 20, 60):
        found = sorted(contamination(table(docs), bench, block_bytes=block).collect(), key=lambda r: r.doc_id)
        assert [(r.doc_id, r.n_hit, r.n_items, r.items, r.contaminated) for r in found] == [(1, 24, 1, [], True), (2, 12, 1, ["3"], True), (3, 24, 2, ["3"], True), (4, 0, 0, [], False)]
        assert [r.items_sha256 for r in found] == [hashlib.sha256(x).hexdigest() for x in (b"", b"3", b"3", b"")]


def test_equal_rows_in_equal_batches_stay(spark, prose):
    bench = spark.createDataFrame([(i, prose(12, 20 + i)) for i in range(4)], "item_id bigint, text string")
    docs = spark.createDataFrame([(None, prose(12, 21) + " end")] * 12, "doc_id bigint, text string")
    for block in (1 << 20, 60):
        found = contamination(docs, bench, block_bytes=block).collect()
        assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found] == [(None, 13, 12, ["1"])] * 12


def test_blocks_of_the_benchmark_are_small(prose):
    import pickle

    texts = [prose(1000, i) for i in range(60)]
    w = windows_of(list(range(60)), pa.array(texts), 10)
    assert len(pickle.dumps(w)) < 1.5 * sum(map(len, texts))
    start, size, item = w.spans
    assert len(start) == 60 * 991 and set(size) == {10} and list(item[:992]) == [0] * 991 + [1]


def test_repeated_words_cost_one_window(spark, table):
    import time

    docs = [(1, "same " * 20_000), (2, "a b " * 5_000 + "c"), (3, "same other")]
    bench = spark.createDataFrame([(1, "same " * 2_000), (2, "b a " * 500), (3, "same " * 30), (4, "same " * 9)], "item_id bigint, text string")
    assert len(windows_of(["x", "y"], pa.array(["same " * 2_000, "b a " * 500]), 10).distinct[0]) == 3
    index = build_index(table(docs)).collect()
    begin = time.perf_counter()
    got = {r[0]: r[1:] for r in contamination(table(docs), bench).select("doc_id", "n_words", "n_hit", "items").collect()}
    assert time.perf_counter() - begin < 30 and index
    assert got[1] == (20_000, 20_000, ["1", "3", "4"]) and got[2][:2] == (10_001, 10_000) and got[2][2] == ["2"] and got[3][1] == 0


def test_copies_of_a_benchmark_row_are_one(spark, table, prose):
    docs, items = cases(prose)
    many = spark.createDataFrame([(i, t) for i, t in items for _ in range(300)], "item_id bigint, text string")
    once = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda b, **k: sorted((tuple(r) for r in contamination(table(docs), b, **k).select("doc_id", "n_hit", "n_items", "items_sha256").collect()), key=str)
    assert rows(many) == rows(once) == rows(many, block_bytes=150)


def test_hits_at_the_edges_of_texts_stay_apart(spark, table):
    """Texts of one segment that end and begin with hits."""
    docs = [(i, "one two three") for i in range(6)]
    bench = spark.createDataFrame([(1, "one two three"), (2, "three"), (3, "three one")], "item_id bigint, text string")
    got = contamination(table(docs), bench).select("n_hit", "hit_spans", "items").distinct().collect()
    assert [tuple(r) for r in got] == [(3, [0, 3], ["1", "2"])]
