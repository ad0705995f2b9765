"""String similarity from 0 to 100, as Arrow-batched functions: Catalyst has no longest common subsequence.

Defined results: a null on either side gives null; two empty texts are equal (100).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time as the bits of one integer."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def score(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return 200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def in_order(a: str | None) -> str | None:
    return None if a is None else " ".join(sorted(a.split()))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * common subsequence / sum of lengths."""
    return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """`ratio` of the texts with their words in order."""
    return pd.Series([score(in_order(x), in_order(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def best_window(a: str, b: str) -> float:
    """The best `score` of the shorter text against any part of the longer as long as it, parts that the ends cut off included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0
    m, found = len(a), 0.0
    letters = set(a)
    for end in range(1, len(b) + m):
        part = b[max(0, end - m) : min(end, len(b))]
        # a part whose last letter the shorter lacks, or that ends the text's overhang, is no better than its neighbour
        if (part[-1] if end <= len(b) else part[0]) in letters:
            found = max(found, 200 * common_length(a, part) / (m + len(part)))
    return found


def _token_sets(a: str, b: str) -> tuple[str, str, str]:
    """Common words and what each text has besides, in order."""
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set(a: str, b: str) -> float:
    """The best `score` among the common words, and these with either text's others; 100 if one text's words are all in the other."""
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _token_sets(a, b)
    if both and (not left or not right):
        return 100.0
    one, other = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(score(one, other), score(both, one), score(both, other)) if both else score(one, other)


def weighted(a: str, b: str) -> float:
    """Weighted best of whole, part and word scores: parts count the less the more the lengths differ."""
    if not a or not b:
        return 0.0
    stretch = max(len(a), len(b)) / min(len(a), len(b))
    if stretch < 1.5:
        return max(score(a, b), 0.95 * max(score(in_order(a), in_order(b)), token_set(a, b)))
    part = 0.9 if stretch <= 8 else 0.6
    both, left, right = _token_sets(a, b)
    words = 100.0 if both else max(best_window(in_order(a), in_order(b)), best_window(left, right))
    return max(score(a, b), part * best_window(a, b), 0.95 * part * words)


def _column(f):
    """A function of two texts as a column function over Arrow batches."""

    @F.pandas_udf(DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return scored


partial_ratio, token_set_ratio, weighted_ratio = _column(best_window), _column(token_set), _column(weighted)


def typo_credit(term: str, words: set[str], title: str) -> float:
    """What a query's word is worth against a title: as a word 1, inside one 0.6, as a likely typo of one 0.8, else 0."""
    if term in words:
        return 1.0
    if term in title:
        return 0.6
    close = len(term) > 3 and any(abs(len(w) - len(term)) <= 3 and score(term, w) >= 82 for w in words)
    return 0.8 if close else 0.0


def title_points(query: str, title: str) -> float:
    """Points of a folded title for a folded query: equality 400, or the query as its part 250 to 320 and 40 at its start; words by length up to 220, and 90 where nearly all are there."""
    if not title:
        return 0.0
    points = 400.0 if title == query else 250 + 70 * len(query) / len(title) + 40 * title.startswith(query) if query in title else 0.0
    terms, words = query.split(), set(title.split())
    if terms:
        cover = sum(typo_credit(t, words, title) * len(t) for t in terms) / sum(map(len, terms))
        points += 220 * cover + 90 * (cover >= 0.95)
    return points


title_score = _column(title_points)
