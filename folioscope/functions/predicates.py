"""Boolean search: a query parser and a predicate algebra that compile to columns."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import LETTERS

_TOKEN = re.compile(r'(-?)"([^"]*)"|(\S+)')


def fold(literal: str) -> str:
    """The search form of a literal, as text.normalize_text makes it of a column."""
    for letter, plain in LETTERS:
        literal = literal.replace(letter, plain)
    literal = "".join(c for c in unicodedata.normalize("NFKD", literal) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", literal.lower()).strip()


def parse_query(query: str) -> list[list[tuple[bool, str]]]:
    """Clauses of (negated, literal): words are joined by AND, OR starts a clause, NOT or - negates the next literal."""
    clauses: list[list[tuple[bool, str]]] = [[]]
    negate = False
    for minus, phrase, word in _TOKEN.findall(query):
        if word and word.upper() == "OR":
            clauses.append([])
        elif word and word.upper() == "NOT":
            negate = True
        elif word and word.upper() == "AND":
            continue
        else:
            literal = phrase or word.removeprefix("-")
            literal = fold(literal)
            if literal:
                clauses[-1].append((negate or bool(minus) or word.startswith("-"), literal))
            negate = False
    return [c for c in clauses if c]


def matches(hay: Column, clauses: list[list[tuple[bool, str]]]) -> Column:
    """Whether folded text satisfies the parsed query; an empty query matches all."""
    literal = lambda neg, s: ~F.contains(hay, F.lit(s)) if neg else F.contains(hay, F.lit(s))
    return reduce(or_, (reduce(and_, (literal(*x) for x in clause)) for clause in clauses), F.lit(False)) if clauses else F.lit(True)


def once(value: Column, make) -> Column:
    """make(value) with the value worked out once a row, however often `make` names it: filters would repeat it otherwise."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def any_of(hay: Column, *terms: str) -> Column:
    return reduce(or_, (F.contains(hay, F.lit(t.lower())) for t in terms), F.lit(False))


def all_of(hay: Column, *terms: str) -> Column:
    return reduce(and_, (F.contains(hay, F.lit(t.lower())) for t in terms), F.lit(True))


def none_of(hay: Column, *terms: str) -> Column:
    return ~any_of(hay, *terms)


def at_least(n: int, *tests: Column) -> Column:
    return reduce(lambda a, b: a + b, (t.cast("int") for t in tests)) >= n


def relevance(title: Column, hay: Column, clauses: list[list[tuple[bool, str]]], phrase: str) -> Column:
    """Integer score: phrase in title, head or text; terms in title and head."""
    terms = list(dict.fromkeys(s for clause in clauses for neg, s in clause if not neg))
    head, has = F.substring(hay, 1, 1200), F.contains
    score = F.when(title == phrase, 400).when(has(title, F.lit(phrase)), 300).otherwise(0)
    score += F.when(has(head, F.lit(phrase)), 90).when(has(hay, F.lit(phrase)), 60).otherwise(0)
    for t in terms:
        score += F.when(has(title, F.lit(t)), 45).otherwise(0) + F.when(has(head, F.lit(t)), 12).otherwise(0)
    return score + F.when(reduce(and_, (has(title, F.lit(t)) for t in terms), F.lit(bool(terms))), 200).otherwise(0)


def parse_range(spec: str, most: int = 100_000) -> list[tuple[int, int]]:
    """Spans of a spec such as `1-40, 55`; reversed ones are turned round."""
    spans = []
    for part in spec.split(","):
        if m := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+))?\s*", part):
            a, b = int(m[1]), int(m[2] or m[1])
            spans.append((min(a, b), min(max(a, b), min(a, b) + most - 1)))
    return spans


def in_ranges(pos: Column, spans: list[tuple[int, int]]) -> Column:
    return reduce(or_, (pos.between(a, b) for a, b in spans), F.lit(False))


def near_miss(criteria: dict[str, Column]) -> Column:
    """The name of the criterion that fails if exactly one does, else null; an unknown criterion counts as failed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in criteria.items())))
    return F.when(F.size(failed) == 1, F.get(failed, F.lit(0)))
