import re

from foliant.llm import secret_scan

LETTERS = "abcdefghijklmnop"


def word(i: int) -> str:
    return "q" * 2 + "".join(LETTERS[i >> 4 * k & 15] for k in range(14))


def test_decoys_are_drawn_from_all_long_words(spark):
    words, candidates = [word(i) for i in range(5000)], [f"{i:04d}" + "Xy7" * 20 for i in range(200)]
    rows = [(w, "decoy", 8) for w in words] + [(c, "candidate", 12) for c in candidates]
    strings = spark.createDataFrame(rows, "candidate string, role string, length_class int")
    made = secret_scan.made_decoys(strings).collect()
    assert {r.length_class for r in made} == {12} and {len(r.candidate) for r in made} == {64} and len(made) == 200 * 20
    used = {w for r in made for w in re.findall("qq[a-p]{14}", r.candidate)}
    assert used <= set(words) and len(used) > 4000


def test_words_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(word(i),) for i in range(3000)], "word string")
    assert sorted(r.number for r in secret_scan.numbered(df).collect()) == list(range(3000))
    assert secret_scan.made_decoys(spark.createDataFrame([("a1" * 20, "candidate", 10)], "candidate string, role string, length_class int")).count() == 0
