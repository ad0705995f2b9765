import random

from folioscope.functions import similarity as S
from folioscope.plans import catalog


def table_length(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_ratio(spark):
    pick = random.Random(3)
    texts = ["", None, "decoder", "encoder", "b a", "a b", *("".join(pick.choices("abc é", k=pick.randint(0, 90))) for _ in range(14))]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.ratio("a", "b").alias("r"), S.token_sort_ratio("a", "b").alias("t")).collect()
    assert len(got) == len(pairs)
    for a, b, r, t in got:
        if a is None or b is None:
            assert r is None and t is None
        else:
            assert r == (200 * table_length(a, b) / (len(a) + len(b)) if a or b else 100.0)
            assert (t == 100.0) == (sorted(a.split()) == sorted(b.split()))
    assert {round(r, 1) for a, b, r, _ in got if (a, b) == ("decoder", "encoder")} == {85.7}


def test_query(spark, small):
    parts = spark.read.parquet(f"{small}/part.parquet").select("p_partkey", "p_name").collect()
    got = {r.p_partkey: r.ratio for r in catalog.h3_similarity(spark, small).collect()}
    asked = "small brass widget"
    assert got == {k: 200 * table_length(n, asked) / (len(n) + len(asked)) for k, n in parts}
