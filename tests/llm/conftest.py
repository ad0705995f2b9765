"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("size", T.StringType()), T.StructField("fingerprint", T.IntegerType()), T.StructField("c0", T.IntegerType()),
])


def odd_rows() -> list[tuple]:
    rng = random.Random(7)
    words = [f"{a}{b}{c}" for a in "blmst" for b in ("a", "ou", "é") for c in ("n", "rd", "ß", "'s")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(300).split(" ")
    texts: list = [None, None, "", "", " ", "\t\n", "one", "one ", " one", "a b c", "a  b\tc", "🙂 ünïcode 東京 text", "x" * 5000, "ab" * 3000, "1" * 300, "<|endoftext|> it's 12345 don't   \n\n end"]
    texts += [prose(rng.randint(1, 60)) for _ in range(40)]
    texts += [texts[20]] * 5 + [prose(20_000)]
    for i in range(12):  # near copies
        near = base.copy()
        near[i * 7] = f"changed{i}"
        texts.append(" ".join(near))
    texts += [
        "mail a.b+c@d-e.co.uk_x@y.zz, ip 10.0.0.256 and 1.2.3.4.5 or 001.002.003.255; card 4111 1111 1111 1111 pay",
        "call +49 (30) 1234-5678. or +1 2 or +123456789012345678 é 4111-1111-1111-1112 5500000000000004x",
        "iban GB82 WEST 1234 5698 7654 32 account, ssn 123-45-6789 social " + "a@b " * 50 + "w@x.yy.",
        "." * 500 + "9" * 400 + " " + "1.1." * 200 + "@" * 50 + "aaa@bb." + "c." * 300 + "dd",
    ]
    rows = [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S3", None, "é"]), None if t is None else len(t), "k", "s", i, i) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, "one", "en", "s1", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(7_000_000_000, texts[25], "en", "s1", 1, "k", "s", 1, 1), (-5, texts[26], "en", "s1", 1, "k", "s", 1, 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
