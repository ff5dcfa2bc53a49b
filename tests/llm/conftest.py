import random

import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdkl" for b in "aeio" for c in ("n", "st", "r")]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) + "." for _ in range(30)]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}") for i, t in enumerate(prose)]
    rows += [
        (40, None, None, None), (41, "", "en", "src1"), (42, "  \n\t ", "en", None), (43, LONG, "de", "src0"), (44, "x", None, "src2"), (45, "é\U0001f600 <|endoftext|> ▁ \x00\x0b", "de", "src0"),
        (None, prose[0], "en", "src0"), (None, None, None, None), (46, prose[1], "en", "src1"), (46, prose[1], "en", "src1"), (46, prose[2], "de", "src1"), (47, "the " * 300, "en", "src3"), (-5, prose[3] + " more", "en", "src3"),
    ]
    df = spark.createDataFrame([(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows], SCHEMA)
    for name in ("score", "keep", "node", "bucket", "key", "host", "path", "h", "rep", "label", "sequence_id", "size", "shard", "root"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(30)] + [(1, None, None), (None, 1, 1), (2, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
