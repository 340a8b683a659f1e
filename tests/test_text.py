import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.spans import with_all_spans


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


SAMPLES = ["", "a", "hello world", "ÄÖ ß é", "漢字 \U0001f600", "x" * 300]


@pytest.mark.parametrize("s", SAMPLES)
def test_hashes(spark, s):
    units = [int.from_bytes(s.encode("utf-16-be")[i : i + 2], "big") for i in range(0, len(s.encode("utf-16-be")), 2)]
    djb2 = 5381
    for u in units:
        djb2 = (djb2 * 33 & 0xFFFFFFFF) ^ u
    h31 = 0
    for u in units:
        h31 = (h31 * 31 + u) & 0xFFFFFFFF
    assert one(spark, s, T.fnv1a64) == fnv(s.encode())
    assert one(spark, s, T.djb2_hex) == f"{djb2:08X}"
    assert one(spark, s, T.fingerprint) == (f"{len(units)}:{h31:08x}" if s else "empty")


@pytest.mark.parametrize("s", [*SAMPLES, "aä", "ä" * 9, "漢" * 9, "a\U0001f600b", "abcdefghij\U0001f600"])
@pytest.mark.parametrize("most", [1, 5, 10])
def test_truncate_bytes(spark, s, most):
    assert one(spark, s, lambda c: T.truncate_bytes(c, most)) == s.encode()[:most].decode(errors="ignore")


def test_pieces(spark):
    assert one(spark, "# Head\nFirst one. Second! ---\n*** \nthird? ", T.sentences) == ["First one", "Second"] + ["third"]
    assert one(spark, "a; b\n# c", T.router_sentences) == ["a", "b", "# c"]
    assert one(spark, " a\n\n\n\nb \n\n", T.paragraphs) == ["a", "b"]
    assert one(spark, "{b} {a} {b} {c d}", T.placeholders) == ["b", "a"]
    assert one(spark, "Größe, 12 ab", T.tokens) == ["größe", "12", "ab"]
    assert one(spark, "the report and 1234 bananas", lambda c: T.content_tokens(c, ["report"])) == ["bananas"]
    assert one(spark, "shor 12345 ab", T.is_substantive) is False
    assert one(spark, "short table", T.is_substantive) is True
    assert one(spark, "123456789", T.mask_secret) == "1234...6789" and one(spark, "12345678", T.mask_secret) == "***"
    assert one(spark, " a \n b ", T.squeeze) == "a b"
    assert [one(spark, str(n), lambda c: T.band(c.cast("int"))) for n in (85, 84, 55, 40, 39)] == ["EXCELLENT", "GOOD", "FAIR", "POOR", "BROKEN"]
    assert one(spark, "many Reports here", lambda c: T.contains_word(c, ["report"])) is True
    assert one(spark, "reporting", lambda c: T.contains_word(c, ["report"])) is False


def test_spans_and_places(spark):
    text = "ä1\n22 b333\n" + "4 " * 300
    df = with_all_spans(spark.createDataFrame([(text,), ("none",), ("",)], "t string"), "t", {"n": (r"\d+", F.col("t").rlike(r"\d"))})
    rows = df.select("n", F.transform("n", lambda x: F.struct(T.line_of(F.col("t"), x["start"]).alias("line"), T.column_of(F.col("t"), x["start"]).alias("col"))).alias("at")).collect()
    import re

    assert [(x.start, x.end, x.hit) for x in rows[0].n] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", text)]
    assert [tuple(x) for x in rows[0]["at"][:3]] == [(1, 3), (2, 1), (2, 5)]
    assert rows[1].n == rows[2].n == []
