from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHING = ["key", "id", "h", "fp", "tokens", "words", "mask", "n", "size", "_t", "_id", "_row", "root", "keep_id", "digest", "e", "prefix", "_key", "gone", "spans"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "epsilon", "zeta", "eta", "theta", "été", "ñu", "中文", "x"]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 12, 40, 60, 90)]
    rows = [
        (1, base[2], "en", "a", 1), (2, base[2].upper(), "en", "a", 1), (3, base[2] + " more", "fr", "b", 2), (3, base[2] + " more", "fr", "b", 2), (4, None, None, None, None),
        (5, "", "en", "", 0), (6, " \t\n\r\x0b\x0c ", "en", "a", 7), (7, base[3] + "\n" + base[1] + "\n\n" + base[1], "de", "c", 5), (8, base[3].replace("x", "y") + "\n" + base[1], "de", None, 5),
        (9, base[4] + " " + base[4], "es", "c", 9), (None, base[0], "es", "c", 9), (None, None, None, "d", None), (10, "x", "en", "d", 1), (11, " ".join(base * 300), "en", "a", 1), (12, "one two three four", "en", "a", 1), (13, "ONE two\tthree  four", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def copies(spark):
    """Random texts with near copies at all distances, in lines."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        if rows and r.random() < 0.6:
            lines = [line.split(" ") for line in r.choice(rows)[1].split("\n")]
            for line in lines:
                for _ in range(r.randrange(3)):
                    if line:
                        line[r.randrange(len(line))] = r.choice(vocabulary)
            r.shuffle(lines)
        else:
            lines = [[r.choice(vocabulary) for _ in range(r.randrange(1, 30))] for _ in range(r.randrange(1, 5))]
        rows.append((i, "\n".join(" ".join(x) for x in lines), "en", f"s{i % 4}", 0))
    return spark.createDataFrame(rows, DOCS).repartition(3)
