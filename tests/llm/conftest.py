import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """A small table with nulls, empty and long texts, ties, copies, near copies and repeated rows."""
    rnd = random.Random(4)
    out = [(i, sentence(rnd, rnd.choice([1, 2, 3, 4, 5, 6, 8, 11, 40, 120])), rnd.choice(["aa", "bb", None]), rnd.choice(["s1", "s2", None, "Zoe"])) for i in range(120)]
    long = sentence(rnd, 300)
    out += [(200 + i, long, "aa", "s1") for i in range(30)]
    for i in range(40):
        words = long.split()
        for _ in range(rnd.choice([0, 1, 2, 12, 30])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        out.append((300 + i, " ".join(words).upper() if i % 3 else " ".join(words), "bb", "s2"))
    for i in range(30):
        tail = out[rnd.randrange(120)][1].split()
        out.append((400 + i, " ".join(tail[:-1] + [rnd.choice(WORDS)]), None, "s1"))
    out += [(500, None, None, None), (501, "", "aa", ""), (502, " \t\n", "aa", "s1"), (503, sentence(rnd, 9000), "aa", "s2"),
            (504, "é ü <|endoftext|> 中文 😀 x", "bb", "s1"), (505, "!!! 123 ???", "aa", "s1"), (0, out[0][1], out[0][2], out[0][3])]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "text")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "taken", "n", "name", "sketch", "h", "g", "keep_id", "group_size", "kept", "score", "lang_pred", "shard", "piece", "length", "html_", "fingerprint", "spans")
    return docs.select("*", *[F.lit("x").alias(c) for c in names])
