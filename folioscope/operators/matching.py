"""Approximate matches of titles: exact candidate search by untouched segments, lookups by precedence, and title search.

Titles here are folded (functions.text). A title's words in order are compared; `threshold` is the least score of
100 x 2 x common subsequence / sum of lengths. Two texts of that score differ in few insertions and deletions, so, of the
segments that the known one is cut into, more than that number, one at least stands in the asked one near its own place. Rows meet
by segment: no candidate is lost and no pairs are formed beyond those that share one.

Defined results: null and empty titles match nothing; equal titles score 100; of equal scores the smaller place wins; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.functions import similarity as Z
from folioscope.operators.relational import first_per_key

#: Least likeness of two titles; of a lookup's candidates, how many and how alike, seeds below which all titles are scored, least points, share of the best, closest ones.
TITLE_THRESHOLD = 96
WIDTH, FLOOR, SEEDS, KEEP, SHARE, CLOSEST = 400, 45, 60, 200, 0.4, 8
#: Width of a band of lengths (logarithm), titles of a block, and rows of a block scored at once.
BAND, BLOCK, ROWS = 0.08, 4000, 500
#: Fixed value: least likeness of a misread name.
LIKE = 90
#: Near misses of a search without hits.
NEAR, NEAR_MOST = 76, 40


def _cuts(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of near-equal segments."""
    bounds = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def _edits(total: int, threshold: float) -> int:
    """Insertions and deletions that two texts of this total length can differ in."""
    return int((1 - threshold / 100) * total + 1e-9)


def known_keys(text: str, threshold: float) -> list[str]:
    """A key per segment of a known text; its own length says how many there are."""
    n = len(text)
    widest = _edits(n + int(n * (200 - threshold) / threshold), threshold)
    return [f"{n}:{i}:{text[a : a + size]}" for i, (a, size) in enumerate(_cuts(n, widest + 1))]


def asked_keys(text: str, threshold: float) -> set[str]:
    """The keys of every known text that may be this close: of each possible length, each segment's content at each possible place."""
    m, keys = len(text), set()
    for n in range(int(m * threshold / (200 - threshold)), int(m * (200 - threshold) / threshold) + 2):
        edits = _edits(m + n, threshold)
        if n <= 0 or abs(m - n) > edits:
            continue
        widest = _edits(n + int(n * (200 - threshold) / threshold), threshold)
        for i, (a, size) in enumerate(_cuts(n, widest + 1)):
            for at in range(max(0, a - edits), min(m - size, a + edits) + 1):
                keys.add(f"{n}:{i}:{text[at : at + size]}")
    return keys


def similar_titles(asked: DataFrame, known: DataFrame, title: str, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """(asked title, known title, score) of all distinct pairs of distinct titles that reach the threshold, words in order."""
    ordered = F.array_join(F.array_sort(F.split(F.trim(title), r"\s+")), " ")

    def keyed(df: DataFrame, make, name: str) -> DataFrame:
        rows = df.where(F.trim(F.coalesce(title, F.lit(""))) != "").select(F.col(title).alias("title"), ordered.alias("text")).distinct()

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = [(t, text, k) for t, text in zip(part["title"], part["text"], strict=True) for k in make(text, threshold)]
                yield pd.DataFrame(out, columns=[name, f"{name}_text", "key"])

        return rows.mapInPandas(run, f"{name} string, {name}_text string, key string")

    pairs = keyed(asked, asked_keys, "asked").join(keyed(known, known_keys, "known"), "key").select("asked", "known", "asked_text", "known_text").distinct()
    return pairs.withColumn("score", Z.ratio("asked_text", "known_text")).where(F.col("score") >= threshold).select("asked", "known", "score")


def letters(texts: list[str]) -> np.ndarray:
    """How often each text has each letter; rare letters share their columns, which only raises what texts seem to share."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    column = np.where(codes < 128, codes, 128 + codes % 32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.bincount(row * 160 + column, minlength=160 * len(texts)).reshape(-1, 160)


def closest(asked: list[str], known: list[str], places: list, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(asked, known, score) of each asked text's best known one at the threshold, by number; the smallest place on ties."""
    a, k = letters(asked), letters(known)
    # as many columns of a letter as the known ones have it at most; a product counts what two texts share, which no common subsequence exceeds
    most = k.max(axis=0)
    units = lambda x: np.concatenate([x[:, c, None] > np.arange(most[c]) for c in np.flatnonzero(most)], axis=1).astype(np.float32)
    shared, sizes, total = units(k).T, k.sum(axis=1), a.sum(axis=1)
    for start in range(0, len(asked), ROWS):
        bound = 200 * (units(a[start : start + ROWS]) @ shared).astype(np.float64) / (total[start : start + ROWS, None] + sizes)
        for i, row in enumerate(bound, start):
            likely = np.flatnonzero(row >= threshold - 1e-9)
            found, least = None, threshold
            for j in likely[np.argsort(-row[likely], kind="stable")].tolist():
                if row[j] < least - 1e-9:
                    break
                score = Z.score(asked[i], known[j])
                if score >= least and (found is None or score > least or places[j] < places[found]):
                    found, least = j, score
            if found is not None:
                yield i, found, least


def much_alike(asked: list[str], known: list[str], least: float) -> Iterator[tuple[int, str, float]]:
    """(asked, by number, best known text, its weighted score) from `least`, 90 or more, on; the smaller text on ties.

    Only pairs that can score as much are scored: one is part of the other, they share a word, or their letters, in order or each word once, are as alike.
    """
    once = lambda t: " ".join(sorted(set(t.split())))
    spaced = any(len(t.split()) != 1 or t != t.strip() for t in (*asked, *known))
    forms = [(asked, known, least)]
    if spaced:  # else the words' scores are the texts'
        forms += [([f(t) for t in asked], [f(t) for t in known], least / 0.95) for f in (Z.in_order, once)]
    sides = []
    for x, y, bar in forms:
        a, k = letters(x), letters(y)
        most = k.max(axis=0)
        columns = np.flatnonzero(most)
        units = lambda v, most=most, columns=columns: np.concatenate([np.zeros((len(v), 1), np.float32), *((v[:, c, None] > np.arange(most[c])).astype(np.float32) for c in columns)], axis=1)
        sides.append((a, units, units(k).T, k.sum(axis=1), bar))
    words: dict[str, list[int]] = {}
    for j, t in enumerate(known):
        for w in set(t.split()):
            words.setdefault(w, []).append(j)
    lengths = np.fromiter(map(len, known), np.int64, len(known))
    for start in range(0, len(asked), ROWS):
        likely = None
        for a, units, shared, sizes, bar in sides:
            part = a[start : start + ROWS]
            total = part.sum(axis=1)[:, None] + sizes
            near = 200 * (units(part) @ shared) >= (bar - 1e-3) * total
            likely = near if likely is None else likely | near
        for i, row in enumerate(likely, start):
            text = asked[i]
            close = set(np.flatnonzero(row).tolist()).union(*(words.get(w, ()) for w in set(text.split())))
            # one as part of the other, from half as long again on
            apart = np.flatnonzero(np.maximum(lengths, len(text)) >= 1.5 * np.minimum(lengths, len(text))).tolist()
            close.update(j for j in apart if text in known[j] or known[j] in text)
            best = min(((-Z.weighted(text, known[j]), known[j]) for j in close), default=(0.0, ""))
            if -best[0] >= least:
                yield i, best[1], -best[0]


def fuzzy_pairs(asked: DataFrame, known: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """term -> the most similar known title (the smallest place on ties) from (term) and (title, place).

    Titles of the same words in order are 100 and settled by a join. The others are dealt in blocks of nearly equal lengths; in a pair of
    blocks the letters that two titles share bound their score, and those that could be the best are scored.
    """
    ordered = lambda c: F.array_join(F.array_sort(F.split(F.trim(c), r"\s+")), " ")
    kind = dict(known.dtypes)["place"]
    a = asked.where(F.trim(F.coalesce("term", F.lit(""))) != "").select("term", ordered("term").alias("text")).distinct()
    k = known.where(F.trim(F.coalesce("title", F.lit(""))) != "").groupBy(ordered("title").alias("text")).agg(F.min_by("title", "place").alias("found"), F.min("place").alias("place"))
    a = a.join(k, "text", "left")
    same = a.where("found is not null").select("term", "found", "place")
    a = a.where("found is null").select("term", "text")
    k = k.withColumn("band", F.floor(F.log(F.length("text").cast("double")) / BAND))
    blocks = {r.band: -(-r.n // BLOCK) for r in k.groupBy("band").agg(F.count("*").alias("n")).collect()}
    most = max(1, -(-a.count() // BLOCK))
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    many = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair)), F.col("band")), F.lit(0)) if blocks else F.lit(0)
    known_blocks = k.select("*", part("text", many).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("a"))
    widest = (200 - threshold) / threshold
    size = F.length("text").cast("double")
    bands = F.sequence(F.floor(F.log(size / widest) / BAND - 1e-9), F.floor(F.log(size * widest) / BAND + 1e-9))
    asked_blocks = a.select("*", part("text", F.lit(most)).alias("a"), F.explode(bands).alias("band")).select("*", F.explode(F.when(many > 0, F.sequence(F.lit(0), many.cast("int") - 1))).alias("k"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(closest(left["text"].to_pylist(), right["text"].to_pylist(), right["place"].to_pylist(), threshold)) if len(left) and len(right) else []
        i, j = (pa.array([r[n] for r in out], pa.int64()) for n in (0, 1))
        return pa.table({"term": left["term"].take(i), "found": right["found"].take(j), "place": right["place"].take(j), "score": pa.array([r[2] for r in out], pa.float64())})

    keys = ["band", "a", "k"]
    near = asked_blocks.groupBy(*keys).cogroup(known_blocks.groupBy(*keys)).applyInArrow(best, f"term string, found string, place {kind}, score double")
    return first_per_key(near, ["term"], [F.desc("score"), F.asc("place")]).select("term", "found", "place").unionByName(same)


def pool_match(asked: DataFrame, pool: DataFrame, key: str, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """key, place of the pool row and how it was found, of asked rows (key, doi, title) against a pool (doi, title, place).

    A DOI settles it alone; a title without one is looked up as it is, then by likeness; the pool's first row of a DOI or title counts.
    """
    dois = pool.where(F.coalesce("doi", F.lit("")) != "").groupBy(F.col("doi").alias("_d")).agg(F.min("place").alias("by_doi"))
    titles = pool.where(F.coalesce("title", F.lit("")) != "").groupBy("title").agg(F.min("place").alias("place"))
    rows = asked.join(dois, F.col("doi") == F.col("_d"), "left").join(titles.select(F.col("title").alias("_t"), F.col("place").alias("by_title")), F.col("title") == F.col("_t"), "left")
    has_doi = F.coalesce("doi", F.lit("")) != ""
    open_ = rows.where(~has_doi & F.col("by_title").isNull()).select(F.col("title").alias("term")).where(F.coalesce("term", F.lit("")) != "").distinct()
    near = fuzzy_pairs(open_, titles, threshold).select(F.col("term").alias("_n"), F.col("place").alias("by_likeness"))
    rows = rows.join(near, ~has_doi & F.col("by_title").isNull() & (F.col("title") == F.col("_n")), "left")
    how = F.when(has_doi, F.when(F.col("by_doi").isNotNull(), "doi").otherwise("")).when(F.col("by_title").isNotNull(), "title").when(F.col("by_likeness").isNotNull(), "fuzzy").otherwise("")
    place = F.when(has_doi, F.col("by_doi")).otherwise(F.coalesce("by_title", "by_likeness"))
    return rows.select(key, place.alias("place"), how.alias("how"))


def exists(asked: DataFrame, pool: DataFrame, key: str, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """Whether the pool has each asked row, by the same policy."""
    return pool_match(asked, pool, key, threshold).select(key, (F.col("how") != "").alias("exists"))


def retry_ladder(asked: DataFrame, pool: DataFrame, key: str, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """key, exists, doi_miss: rows whose DOI the pool lacks are asked again by their title alone."""
    dois = pool.where(F.coalesce("doi", F.lit("")) != "").select(F.col("doi").alias("_d")).distinct()
    rows = asked.join(dois, F.col("doi") == F.col("_d"), "left")
    has_doi = F.coalesce("doi", F.lit("")) != ""
    settled = rows.where("_d is not null").select(key, F.lit(True).alias("exists"), F.lit(False).alias("doi_miss"))
    open_ = rows.where("_d is null").select(F.struct(F.col(key).alias("k"), has_doi.alias("missed")).alias("_key"), F.lit(None).cast("string").alias("doi"), "title")
    again = exists(open_, pool, "_key", threshold).select(F.col("_key.k").alias(key), "exists", (F.col("exists") & F.col("_key.missed")).alias("doi_miss"))
    return settled.unionByName(again)


def repair_names(bad: DataFrame, real: DataFrame, owner: str, name: str) -> DataFrame:
    """The real name that a misread one stands for among its owner's: equal but for symbols (100), the only one that it begins (97), the shortest of several (92), or much alike (90 and more); null if none.

    Names with fewer than three letters and digits stand for none; beginnings count from five on.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    a = bad.select(owner, F.col(name).alias("bad"), plain(F.col(name)).alias("_b")).distinct()
    b = real.where(F.coalesce(name, F.lit("")) != "").select(F.col(owner).alias(owner), F.col(name).alias("real"), plain(F.col(name)).alias("_r")).distinct()
    asked, every = a.where(F.length("_b") >= 3), [owner, "bad"]
    first = lambda pairs: first_per_key(pairs.withColumn("like", Z.weighted_ratio("bad", "real")), every, [F.desc("like"), F.asc("real")])
    exact = first(asked.join(b.withColumnRenamed("_r", "_b"), [owner, "_b"])).select(*every, "real", F.lit(100.0).alias("points"), F.lit("exact").alias("how"))
    # beginnings: each real name goes to all its own from five letters on, so that only pairs that begin so meet
    begins = b.where(F.length("_r") >= 5).select(owner, "real", F.length("_r").alias("_n"), F.explode(F.transform(F.sequence(F.lit(5), F.length("_r")), lambda n: F.substring("_r", F.lit(1), n))).alias("_b"))
    shortest = begins.groupBy(owner, "_b").agg(F.count("*").alias("_starts"), F.min("_n").alias("_n"))
    starts = asked.join(exact.select(*every), every, "left_anti").join(begins.join(shortest, [owner, "_b", "_n"]), [owner, "_b"])
    prefix = first(starts).select(*every, "real", F.when(F.col("_starts") == 1, 97.0).otherwise(92.0).alias("points"), F.lit("prefix").alias("how"))
    # the rest against all names of the owner, in blocks
    settled = exact.unionByName(prefix)
    rest = asked.join(settled.select(*every), every, "left_anti").select(*every)
    blocks = lambda rows, n: rows.groupBy(owner).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    sizes = blocks(rest, "_na").join(blocks(b, "_nr"), owner)
    left = rest.join(sizes, owner).select(*every, part("bad", "_na").alias("_pa"), F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)).alias("_pr"))
    right = b.join(sizes, owner).select(owner, "real", part("real", "_nr").alias("_pr"), F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("_pa"))

    def alike(x: pa.Table, y: pa.Table) -> pa.Table:
        out = list(much_alike(x["bad"].to_pylist(), y["real"].to_pylist(), LIKE)) if len(x) and len(y) else []
        i = pa.array([r[0] for r in out], pa.int64())
        return pa.table({owner: x[owner].take(i), "bad": x["bad"].take(i), "real": pa.array([r[1] for r in out], pa.string()), "points": pa.array([r[2] for r in out], pa.float64())})

    keys = [owner, "_pa", "_pr"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(alike, f"`{owner}` {dict(a.dtypes)[owner]}, bad string, real string, points double")
    fuzzy = first_per_key(found, every, [F.desc("points"), F.asc("real")]).select(*every, "real", "points", F.lit("fuzzy").alias("how"))
    return a.select(*every).join(settled.unionByName(fuzzy), every, "left")


def near_titles(rows: DataFrame, query: str, title: str = "hay_t") -> DataFrame:
    """Rows whose title has a part much like a query that found nothing, the best first, `rel` its likeness; none for queries under four characters."""
    scored = rows.withColumn("rel", Z.partial_ratio(F.col(title), F.lit(query))).where((F.col("rel") >= NEAR) & (F.length(F.lit(query)) >= 4))
    return scored.orderBy(F.desc("rel"), title).limit(NEAR_MOST).withColumn("rel", F.col("rel").cast("int"))


def search_or_near(rows: DataFrame, hit: Column, query: str, title: str = "hay_t") -> tuple[DataFrame, bool]:
    """The rows that match, or near titles and True where none does."""
    found = rows.where(hit)
    return (near_titles(rows, query, title), True) if query and found.isEmpty() else (found, False)


def title_search(rows: DataFrame, query: str, order: list[str], title: str = "hay_t", ids: str = "hay_k") -> tuple[DataFrame, bool]:
    """Rows that a folded query may mean, with their points `rel`, best first; True where only the closest few are left.

    Titles that share one of the query's longer words are scored, or all titles where fewer than SEEDS do. What is scored further is bounded by WIDTH.
    """
    terms = query.split()
    words = sorted((w for w in terms if len(w) > 3), key=len, reverse=True) or terms
    seed = F.lit(False)
    for w in words:
        seed = seed | F.contains(title, F.lit(w))
    marked = rows.withColumn("_seed", seed)
    few = marked.where("_seed").limit(SEEDS).count() < SEEDS
    near = (marked if few else marked.where("_seed")).withColumn("_ratio", Z.weighted_ratio(F.lit(query), F.col(title))).where(F.col("_ratio") >= FLOOR)
    near = near.orderBy(F.desc("_ratio"), title, *order).limit(WIDTH)
    by_id = F.lit(len(query) > 5) & F.contains(ids, F.lit(query))
    scored = near.withColumn("rel", Z.title_score(F.lit(query), F.col(title)) + 3 * F.col("_ratio") + F.when(by_id, 900).otherwise(0))
    pasted = rows.where(by_id).withColumns({"_seed": F.lit(False), "_ratio": F.lit(0.0), "rel": F.lit(900.0)})
    every = first_per_key(scored.unionByName(pasted), order, [F.desc("rel")])
    best = every.agg(F.max("rel")).first()[0]
    kept = every.where(F.col("rel") >= max(KEEP, SHARE * (best or 0)))
    fuzzy = best is not None and best < KEEP
    kept = every.orderBy(F.desc("rel"), *order).limit(CLOSEST) if fuzzy else kept
    return kept.withColumn("rel", F.col("rel").cast("int")).drop("_seed", "_ratio").orderBy(F.desc("rel"), *order), fuzzy
