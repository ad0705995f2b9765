"""Likeness of titles against brute force."""

import random

from pyspark.sql import functions as F

from folioscope.functions import similarity as Z
from folioscope.operators import matching as Q
from folioscope.plans import lookups
from folioscope.plans.catalog import ROWS_ONLY


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def words(t):
    return " ".join(sorted(t.split()))


def test_part_scores():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(1, 12))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, e - len(short)) : e] for e in range(1, len(long) + len(short))]
        assert abs(Z.best_window(a, b) - max(ratio(short, w) for w in windows)) < 1e-9
    assert Z.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0 == Z.best_window("brain", "the brain works")
    assert Z.token_set("a b", "c d") == ratio("a b", "c d") and Z.weighted("", "x") == 0.0
    assert Z.weighted("speech decoding", "decoding speech") == 95.0
    assert abs(Z.weighted("speech", "inner speech in the human brain") - 90.0) < 1e-9


def test_points():
    q = "inner speech"
    assert Z.title_points(q, q) == 400 + 220 + 90 and Z.title_points(q, "") == 0
    assert Z.title_points(q, "inner speech now") == 250 + 70 * 12 / 16 + 40 + 220 + 90
    assert Z.title_points(q, "inner voices") == 220 * 5 / 11
    assert abs(Z.title_points("speach", "inner speech") - 176) < 1e-9


def test_no_candidate_is_lost(spark):
    """All pairs by brute force, with edits up to the bound and beyond, at several thresholds."""
    rng = random.Random(5)
    base = [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    asked = []
    for t in base:
        for edits in range(6):
            c = list(t)
            for _ in range(edits):
                at = rng.randrange(len(c) + 1)
                if rng.random() < 0.5 and c:
                    c.pop(min(at, len(c) - 1))
                else:
                    c.insert(at, rng.choice("abc "))
            asked.append("".join(c))
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "title string")
    for least in (96, 90):
        got = {(r.asked, r.known) for r in Q.similar_titles(frame([*asked, None, "", " "]), frame(base), "title", least).collect()}
        expected = {(a, b) for a in asked for b in base if a.strip() and ratio(words(a), words(b)) >= least}
        assert got == expected and len(expected) > 60


def many_titles(n, seed):
    """Titles that share most of their words, as the parts' do; some long, some with letters of other scripts."""
    rng = random.Random(seed)
    pick = lambda values: rng.choice(values)
    return [f"a study of the {pick(['small', 'large', 'red'])} {pick(['ring', 'widget', 'gear'])} brand {rng.randrange(25)} {pick(['tin', 'steel'])} in human listeners {rng.randrange(50)}" + pick(["", "", " βήτα", " ж", " 漢字", " and more" * rng.randrange(4)]) for _ in range(n)]


def test_best_of_many_blocks(spark, monkeypatch):
    """The best known title of each asked one by brute force, ties and blocks included."""
    monkeypatch.setattr(Q, "BLOCK", 40)
    known = [(t, i) for i, t in enumerate(many_titles(150, 1))]
    asked = [t.replace("human", "humman") if i % 2 else t for i, t in enumerate(many_titles(150, 2))] + [" ".join(reversed(known[7][0].split())), "", " ", None, "x"]
    got = {r.term: (r.found, r.place) for r in Q.fuzzy_pairs(spark.createDataFrame([(t,) for t in asked], "term string"), spark.createDataFrame(known, "title string, place long")).collect()}
    expected = {}
    for term in filter(None, map(lambda t: (t or "").strip() and t, asked)):
        best = min((-ratio(words(term), words(t)), p, t) for t, p in known)
        if -best[0] >= 96:
            expected[term] = (best[2], best[1])
    assert got == expected and len(expected) > 60


def test_few_are_scored(monkeypatch):
    """Titles that share most of their words don't have all their pairs scored."""
    calls = []
    scored = Z.score
    monkeypatch.setattr(Z, "score", lambda a, b: calls.append(1) or scored(a, b))
    known = sorted({words(t) for t in many_titles(600, 3)})
    asked = [t.replace("human", "humman") for t in known]
    assert [known[j] for _, j, _ in Q.closest(asked, known, list(range(len(known))), 96)] == known
    assert len(calls) < 4 * len(asked)


def test_lookups(spark, small):
    asked, pool = (df.collect() for df in lookups.asked_and_pool(spark, small))
    by_doi, by_title = {}, {}
    for r in sorted(pool, key=lambda r: r.place):
        if r.doi:
            by_doi.setdefault(r.doi, r.place)
        by_title.setdefault(r.title, r.place)

    def match(doi, title):
        if doi:
            return (by_doi[doi], "doi") if doi in by_doi else (None, "")
        if title in by_title:
            return by_title[title], "title"
        best = min(((-ratio(words(title), words(t)), p) for t, p in by_title.items()), default=(0, None))
        return (best[1], "fuzzy") if -best[0] >= 96 else (None, "")

    expected = {r.p_partkey: match(r.doi, r.title) for r in asked}
    assert {r.p_partkey: (r.place, r.how) for r in ROWS_ONLY["c7_pool_match"](spark, small).collect()} == expected
    assert {how for _, how in expected.values()} == {"doi", "title", "fuzzy", ""}
    assert {r.p_partkey: r.exists for r in ROWS_ONLY["c5_exists_by_likeness"](spark, small).collect()} == {k: bool(how) for k, (_, how) in expected.items()}
    again = {r.p_partkey: bool(match(None, r.title)[1]) if r.doi and not expected[r.p_partkey][1] else False for r in asked}
    assert {r.p_partkey: (r.exists, r.doi_miss) for r in ROWS_ONLY["c6_retry_ladder"](spark, small).collect()} == {k: (bool(expected[k][1]) or again[k], again[k]) for k in expected}


def test_one_search_for_all(spark):
    """A missed DOI's title is searched together with the others', and rows without a key are asked again too."""
    asked = spark.createDataFrame([(1, "10.1/a", "x"), (2, "10.1/z", "the long title of a paper"), (None, "10.1/y", "the long titlle of a paper"), (4, None, "nothing like it")], "k long, doi string, title string")
    pool = spark.createDataFrame([("10.1/a", "the long title of a paper", 1)], "doi string, title string, place long")
    got = Q.retry_ladder(asked, pool, "k")
    assert {(r.k, r.exists, r.doi_miss) for r in got.collect()} == {(1, True, False), (2, True, True), (None, True, True), (4, False, False)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroups") == 1
    assert {(r.k, r.exists) for r in Q.exists(asked, pool, "k").collect()} == {(1, True), (2, False), (None, False), (4, False)}


def test_repaired_names(spark):
    real = spark.createDataFrame([("o", n) for n in ("braindecode", "braindecode.github.io", "a-simple-to-start", "speech-tools", None, "")], "owner string, name string")
    bad = spark.createDataFrame([("o", n) for n in ("ASIMPLE-TOSTART", "brainde", "speech-t", "speech-toolz", "zzzzzz", "ab")] + [("p", "speech-tools")], "owner string, name string")
    got = {(r.owner, r.bad): (r.real, r.how, r.points) for r in Q.repair_names(bad, real, "owner", "name").collect()}
    assert got[("o", "ASIMPLE-TOSTART")] == ("a-simple-to-start", "exact", 100.0) and got[("o", "brainde")] == ("braindecode", "prefix", 92.0)
    assert got[("o", "speech-t")] == ("speech-tools", "prefix", 97.0) and got[("o", "speech-toolz")][:2] == ("speech-tools", "fuzzy")
    assert all(got[k] == (None, None, None) for k in (("o", "zzzzzz"), ("o", "ab"), ("p", "speech-tools")))


def test_names_much_alike():
    """The best real name by brute force, with words, parts and repeated words; few pairs of single words are scored."""
    rng = random.Random(4)
    name = lambda sep: sep.join(rng.choices(["speech", "brain", "decode", "tool", "net", "12", "7", "of"], k=rng.randint(1, 5)))
    for sep in ("-", " ", "  "):
        known = sorted({name(sep) for _ in range(120)})
        asked = [name(sep).replace("o", "0") if i % 2 else name(sep)[: rng.randint(3, 30)] for i in range(120)] + ["speech brain", " ", "brain-decode x"]
        best = [min((-Z.weighted(a, k), k) for k in known) for a in asked]
        assert list(Q.much_alike(asked, known, 90)) == [(i, k, -s) for i, (s, k) in enumerate(best) if -s >= 90]


def test_title_search(spark, small):
    pool = lookups.pool(spark, small).collect()
    query = "small widgett brand 7"
    seeds = [r for r in pool if any(w in r.hay_t for w in ("widgett", "small", "brand"))]
    near = sorted(((-Z.weighted(query, r.hay_t), r.hay_t, r.p_partkey) for r in (seeds if len(seeds) >= 60 else pool)))[:400]
    points = {k: Z.title_points(query, t) - 3 * s for s, t, k in near if -s >= 45}
    floor = max(200, 0.4 * max(points.values()))
    got = ROWS_ONLY["i7_title_search"](spark, small).collect()
    assert {r.p_partkey: r.rel for r in got} == {k: int(p) for k, p in points.items() if p >= floor} and got
    assert [r.rel for r in got] == sorted((r.rel for r in got), reverse=True)
    top = ROWS_ONLY["i8_pasted_id"](spark, small).first()
    assert top.p_partkey in {r.p_partkey for r in pool if "10 1000 p7" in r.hay_k} and top.rel >= 900
    got = ROWS_ONLY["i6_near_titles"](spark, small).collect()
    likely = sorted(((-Z.best_window("smal widgot", r.hay_t), r.hay_t) for r in pool))
    assert [r.rel for r in got] == [int(-s) for s, _ in likely if -s >= 76][:40] and got
    none, fuzzy = Q.search_or_near(lookups.pool(spark, small), F.contains("hay_t", F.lit("small")), "small")
    assert not fuzzy and none.count() > 0
