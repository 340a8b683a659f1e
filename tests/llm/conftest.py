import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    """Random prose of n words, the same for the same seed."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ed", "ing", "s"]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def table(spark):
    """Documents of (doc_id, text), dealt over several partitions, with extra columns whose names operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        if extra:
            df = df.selectExpr("doc_id", "text", "1 AS id", "'x' AS digest", "2 AS keep_id", "3 AS class_id", "4 AS component", "5 AS uid", "6 AS `start`", "7 AS n", "8 AS spans", "9 AS size")
        return df

    return make
