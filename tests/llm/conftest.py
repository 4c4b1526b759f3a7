"""Tables for the operators of the optional subpackage; the session comes from the folder above."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names the operators use themselves.
        T.StructField("n_words", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("n_removed", T.StringType()),
        T.StructField("blocks", T.StringType()),
    ]
)


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("etaoinsé") for _ in range(rng.randint(1, 7))) for _ in range(words))


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [
        None, "", " \t\n ", "a", "Ab ab AB", "x" * 3000, "ab" * 700, "é" * 500, base, base, base + " end", base.replace(" e", " o", 1),
        "line one is a long line, longer than others\n" * 4 + "tail", prose(rng, 20_000), "\n".join(prose(rng, 12) for _ in range(40)),
        "\x1cfs\x85nel\xa0nbsp\u3000wide <|endoftext|>x<|startoftext|> 'S don't I'LL", "e\u0301 A\u030a Σσς İ \n\u0301mark", "#### $$$ %%% &&& *** ||| <<< >>>", "12 345 ...",
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "a", "B", "é")[i % 4], len(t or ""), *["clash"] * 7) for i, t in enumerate(texts)]
    return [*rows, rows[8], (900, base, None, None, None, *[None] * 7), (None, base, "en", "a", 1, *["clash"] * 7), (None, None, None, None, None, *[None] * 7)]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
