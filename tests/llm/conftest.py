from __future__ import annotations

import random
import string

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("rank", T.StringType()), T.StructField("bucket", T.StringType())])


def sentence(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows and ids."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    passage = sentence(rng, 70)
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(words[:60] + ["zz"] + words[61:]), "en", "a"), (4, None, "en", "a"), (5, "", None, None),
            (6, " \t\r\n", "de", ""), (7, "one", "en", "b"), (8, "One two three", "en", "b"), (8, "One two three", "en", "b"), (9, "one two three", None, "b"),
            (None, base, "en", "a"), (None, None, None, None), (10, sentence(rng, 30) + " " + passage + " " + sentence(rng, 20), "en", "c"),
            (11, passage + "\n" + sentence(rng, 50), "en", "c"), (12, sentence(rng, 60_000), "en", "a"), (13, "x" * 150_000, "en", "a"), (13, "the same id again with another text", "en", "c"),
            (14, "word " * 300, "en", "c"), (15, "é ß 漢字 😀 " + passage.upper(), "fr", "d"), (16, "a b c d e\na b c d e\n\n \na b c d e", "fr", "d"), (17, base + " " + sentence(rng, 200), "en", "d")]
    for k in range(18, 40):
        rows.append((k, sentence(rng, rng.randint(1, 150), string.ascii_letters + "#*,."), rng.choice(["en", "fr"]), rng.choice("abcd")))
    return [(a, b, c, d, None if b is None else len(b), "r", "k") for a, b, c, d in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
