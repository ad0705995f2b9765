"""Reference lists as rows. An entry's parts follow its style: APA, a quoted title, or authors first; what fits none keeps its longest sentence.

The styles need places in a text and branches on them, so a list is read over Arrow batches, one text at a time.

Defined results: null and empty texts have no entries; entries without a title and a DOI are none; of entries with the same DOI or folded
title the first stays; a list ends at MOST entries, which is the feature's own bound, and `of` says how many there were.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a list at most; the shortest title.
MOST, LEAST = 600, 8
_MARK = re.compile(r"(?m)^[ \t]*(?:\[(\d{1,4})\]|(\d{1,4})[.)])[ \t]+")
_DOI = re.compile(r"10\.\d{4,9}/[-._;()/:a-z0-9]+", re.IGNORECASE)
_URL = re.compile(r"https?://[^\s<>\"']+")
_YEAR = re.compile(r"\b((?:1[5-9]|20)\d{2})\b")
_APA = re.compile(r"^(?P<authors>[^()]{2,400}?)\s*\((?P<year>(?:1[5-9]|20)\d{2})[a-z]?(?:,[^)]*)?\)\.?\s+(?P<title>.+?[.?!])(?:\s+(?P<rest>.*))?$")
_QUOTED = re.compile(r"^(?P<authors>.{0,400}?)[,.]?\s*[\"“](?P<title>[^\"”]+?)[,.]?[\"”]\s*[,.]?\s*(?P<rest>.*)$")
_LED = re.compile(r"^(?P<authors>(?:[^.]|(?<=\b\w)\.|(?<=et al)\.){2,400}?(?:\b\w\.|\bet al\.|[a-z]\.))\s+(?P<title>[A-Z0-9][^.?!]{7,}[.?!])(?:\s+(?P<rest>.*))?$")


def split_entries(text: str) -> list[str]:
    """Entries by markers that count upwards, else by empty lines, else by line."""
    marks = list(_MARK.finditer(text))
    numbers = [int(m[1] or m[2]) for m in marks]
    if len(marks) > 1 and all(a < b for a, b in zip(numbers, numbers[1:], strict=False)):
        ends = [m.start() for m in marks[1:]] + [len(text)]
        parts = [text[m.end() : end] for m, end in zip(marks, ends, strict=True)]
    else:
        parts = re.split(r"\n[ \t]*\n", text)
        parts = parts if len([p for p in parts if p.strip()]) > 1 else text.split("\n")
    return [entry for p in parts if (entry := " ".join(p.split()))]


def parse_entry(entry: str) -> dict:
    """title, authors, year, journal, doi, url of an entry; empty or None where it has none."""
    doi, url, year = _DOI.search(entry), _URL.search(entry), _YEAR.search(entry)
    bare = " ".join(_DOI.sub("", re.sub(r"(?i)\b(?:doi:?\s*|https?://(?:dx\.)?doi\.org/)(?=10\.)", "", _URL.sub(lambda m: m[0] if "doi.org/" in m[0] else "", entry))).split()).strip(" .,;")
    found = next((m for m in (p.match(bare + ".") for p in (_APA, _QUOTED, _LED)) if m), None)
    parts = found.groupdict() if found else {}
    title = parts.get("title") or max(re.split(r"(?<=[.?!])\s+", bare), key=len, default="")
    rest = parts.get("rest") or ""
    journal = re.match(r"(?:In:?\s+)?([A-Z][A-Za-z&:\-. ]{2,80}?)(?=[,;]|\s+\d|\s*\(|\.?$)", rest)
    return {
        "title": title.strip(" .,;\"“”"),
        "authors": (parts.get("authors") or "").strip(" ,;"),
        "year": int(parts.get("year") or year[1]) if parts.get("year") or year else None,
        "journal": journal[1].strip(" .") if journal else "",
        "doi": doi[0].rstrip("./;:)") if doi else "",
        "url": url[0].rstrip(".,;)") if url else "",
    }


def folded(title: str) -> str:
    """The title's identity, as functions.text.normalize_title has it."""
    return " ".join(re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", title).lower()).split())


def entries(text: str | None) -> tuple[int, list[dict]]:
    """How many distinct entries a list has, and the first MOST of them."""
    out, seen = [], set()
    for entry in split_entries(text or ""):
        row = parse_entry(entry)
        names = {n for n in (row["doi"].lower(), folded(row["title"]) if len(row["title"]) >= LEAST else "") if n}
        if names and not names & seen:
            out.append(row)
        seen |= names
    return len(out), out[:MOST]


def parsed_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, of, title, authors, year, journal, doi, url) of the reference lists of texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, whole in zip(part["key"], part["text"], strict=True):
                of, rows = entries(whole)
                out += [(k, n, of, *row.values()) for n, row in enumerate(rows, 1)]
            yield pd.DataFrame(out, columns=["key", "n", "of", "title", "authors", "year", "journal", "doi", "url"]).astype({"year": "Int32"})

    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, n int, of int, title string, authors string, year int, journal string, doi string, url string")
