"""Every query of the catalog against its SQL."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import predicates
from folioscope.plans import catalog


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    got = catalog.QUERIES[name](spark, small)
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in got.columns]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.collect()) == expected


def test_all_rows_are_ranked(spark):
    """More rows than a page, ties, nulls, and partitions that a range leaves empty."""
    from folioscope.operators import relational

    rows = [(i, None if i % 50 == 0 else float(i * 7919 % 97)) for i in range(1500)]
    got = relational.ranked(spark.createDataFrame(rows, "k int, v double").repartition(5), [F.desc("v"), F.asc("k")]).collect()
    rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {(r.k, r.n) for r in got} == {(k, i + 1) for i, (k, _) in enumerate(rows)} and len(got) == 1500
    big = "/root/testdata/sf0.01"
    assert catalog.QUERIES["e1_ranked"](spark, big).count() == spark.read.parquet(f"{big}/part.parquet").count() > 200


def test_parser():
    assert predicates.parse_query('a "b c" OR NOT d -e') == [[(False, "a"), (False, "b c")], [(True, "d"), (True, "e")]]
    assert predicates.parse_range("1-40, 55, 9-3, x") == [(1, 40), (55, 55), (3, 9)]
