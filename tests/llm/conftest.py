import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names the operators use themselves.
EXTRA = ("fp", "h", "id", "part", "start", "n", "gone", "found", "text_hash", "more", "_id", "kind", "cue", "ids", "w", "at", "count", "root", "seg", "anchor", "key", "unnamed")


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def with_extra(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"x{c}").alias(c) for c in EXTRA))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows and ids, ties, odd white space and characters."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    passage = prose(rng, 60)
    other = prose(rng, 80)
    rows = [
        (1, "", "en"), (2, None, "en"), (3, " ", None), (None, "a b", "en"), (None, passage, None), (4, long, "en"), (5, "x" * 5000, "en"),
        (6, passage, "en"), (6, passage, "en"), (6, other, "fr"), (7, other[:200] + " " + passage, "fr"), (8, passage + "\n" + passage, "de"),
        (9, "  two  spaces \n\t tabs\r\n\x0b ", "en"), (10, "İ K ſ é ÉÀ 日本語 🙂🙂     \x1c x\x00y don't I'LL 12345 ½ ²", "es"),
        (11, "Thon " * 300, "en"), (12, "\n".join(["same line"] * 40 + ["", " "]), "en"), (13, passage.upper(), "en"),
        (14, passage.replace(" ", "  "), "en"), (15, other[1:], "en"), (16, "\\### <turn> </turn>", "en"), (-3, passage + " tail", "en"),
    ]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return with_extra(spark.createDataFrame(odd_rows, SCHEMA).repartition(3, "text")).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def sample_rows(sample):
    return [tuple(r) for r in sample.collect()]
