"""Screens of full texts and abstracts, field extraction with quotes, and mining of parameters near data set names.

The screens are columns: each list of terms is one alternation whose matches do not overlap, counted inside the JVM. Extraction
needs the places of matches, which Catalyst has no function for, so it runs over Arrow batches, a text at a time.

Defined results: null texts count as empty; an empty vocabulary never matches; empty tables give empty results; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vocabulary as V
from folioscope.functions.text import text_or_empty

#: Reasons for leaving a paper out, in order.
REVIEW, RIVAL, NO_ATTENTION, ONLY_ENCODING, ONLY_ACCELERATION, NO_TASK = (
    "review / survey (not a primary model paper)",
    "non-fMRI modality (EEG/MEG/ECoG/fNIRS dominant)",
    "no transformer/attention inside the authors' own model",
    "encoding model only (stimulus -> brain, not brain -> stimulus)",
    "fMRI image reconstruction / acceleration (signal processing, not decoding)",
    "no clear fMRI decoding task",
)
NEVER_NAMED, NO_MACHINERY = "the abstract never names fMRI", "the abstract names no transformer / attention machinery"


@dataclass(frozen=True)
class Vocabulary:
    """Terms of a screen; the defaults are the fixed values."""

    evidence: list[str] = field(default_factory=lambda: V.EVIDENCE)
    rivals: list[str] = field(default_factory=lambda: V.RIVALS)
    built: list[str] = field(default_factory=lambda: V.BUILT)
    pretrained: list[str] = field(default_factory=lambda: V.PRETRAINED)
    ours: list[str] = field(default_factory=lambda: V.OURS)
    tasks: dict[str, list[str]] = field(default_factory=lambda: V.TASKS)
    survey: list[str] = field(default_factory=lambda: V.SURVEY)
    survey_title: list[str] = field(default_factory=lambda: V.SURVEY_TITLE)
    encoding: list[str] = field(default_factory=lambda: V.ENCODING)
    acceleration: list[str] = field(default_factory=lambda: V.ACCELERATION)
    generic: list[str] = field(default_factory=lambda: V.GENERIC)


def alternation(terms: list[str]) -> str:
    return "(?iU)" + "|".join(f"(?:{t})" for t in terms)


def hits(c: Column, terms: list[str]) -> Column:
    """How often any of the terms occurs, without overlaps."""
    return F.regexp_count(c, F.lit(alternation(terms))) if terms else F.lit(0)


def within(c: Column, a: list[str], b: list[str], window: int) -> Column:
    """Whether a match of `a` starts within `window` characters of the start of one of `b`."""
    if not a or not b:
        return F.lit(False)
    left, right = ("|".join(f"(?:{t})" for t in terms) for terms in (a, b))
    return F.rlike(c, F.lit(f"(?isU)(?=(?:{left})).{{0,{window}}}?(?={right})|(?=(?:{right})).{{0,{window}}}?(?={left})"))


def best_task(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Name and score of the best category; the first declared wins ties, none without a hit."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    name = F.lit(None).cast("string")
    for label, score in reversed(scores.items()):
        name = F.when(score == top, label).otherwise(name)
    return F.when(top > 0, name).otherwise("unclassified"), top


def screen_papers(papers: DataFrame, key: str, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Verdict on papers with full text (key, title, abstract, methods, body): counts, criteria, task, include and the first reason against."""
    t, a, m, b = (text_or_empty(F.col(c)) for c in ("title", "abstract", "methods", "body"))
    core, full = F.when(F.length(m) > 400, m).otherwise(b), F.concat(b, F.lit("\n"), m)
    rows = papers.select(key, t.alias("_t"), a.alias("_a"), b.alias("_b"), core.alias("_core"), full.alias("_full"))
    core, full, title, abstract, body = (F.col(c) for c in ("_core", "_full", "_t", "_a", "_b"))
    rows = rows.withColumns({
        "evidence": hits(full, words.evidence), "evidence_core": hits(core, words.evidence), "rival": hits(full, words.rivals), "rival_core": hits(core, words.rivals),
        "built": hits(core, words.built), "pretrained": hits(core, words.pretrained), "near": within(core, words.built + words.pretrained, words.ours, 500),
        "survey": (hits(title, words.survey_title) > 0) | (4 * hits(title, words.survey) + 2 * hits(abstract, words.survey) + hits(F.substring(body, 1, 6000), words.survey) >= 4),
        "encoding": hits(full, words.encoding), "acceleration": hits(full, words.acceleration),
        **{f"_task{i}": 3 * hits(title, p) + 2 * hits(abstract, p) + hits(full, p) for i, p in enumerate(words.tasks.values())},
    })
    e, ec, r, rc = (F.col(c) for c in ("evidence", "evidence_core", "rival", "rival_core"))
    named = (e >= 8) & (ec >= 4) & ((ec >= F.greatest(F.lit(5.0), rc * 0.9)) | (e >= F.greatest(F.lit(10.0), r * 0.75)))
    total = F.col("built") + F.col("pretrained")
    attention = (F.col("built") >= 2) | (total >= 3) | (F.col("near") & ((total >= 2) | (F.col("built") >= 1)))
    task, score = best_task({name: F.col(f"_task{i}") for i, name in enumerate(words.tasks)})
    rows = rows.withColumns({"is_fmri": named, "attention": attention, "task": task, "score": score})
    reason = F.when(F.col("survey"), REVIEW).when(~F.col("is_fmri"), RIVAL).when(~F.col("attention"), NO_ATTENTION)
    reason = reason.when((F.col("score") < 2) & (F.col("encoding") >= 2), ONLY_ENCODING).when((F.col("score") < 2) & (F.col("acceleration") >= 2), ONLY_ACCELERATION).when(F.col("score") < 2, NO_TASK).otherwise("")
    return rows.withColumn("reason", reason).select(key, (F.col("reason") == "").alias("include"), "reason", "task", "score", "evidence", "evidence_core", "rival", "rival_core", "built", "pretrained", "near", "is_fmri", "attention")


def screen_abstracts(papers: DataFrame, key: str, words: Vocabulary = Vocabulary()) -> DataFrame:
    """Verdict on papers with title and abstract alone: one mention counts, and each criterion has its own verdict."""
    rows = papers.select(key, text_or_empty(F.col("title")).alias("_t"), text_or_empty(F.col("abstract")).alias("_a"))
    title, abstract, text = F.col("_t"), F.col("_a"), F.concat("_t", F.lit("\n"), "_a")
    rows = rows.withColumns({
        "evidence": hits(text, words.evidence), "rival": hits(text, words.rivals), "built": hits(text, words.built), "pretrained": hits(text, words.pretrained), "near": within(text, words.built + words.pretrained, words.ours, 300),
        "survey": (hits(title, words.survey_title) > 0) | (4 * hits(title, words.survey) + 2 * hits(abstract, words.survey) >= 4),
        "generic": hits(text, words.generic), "encoding": hits(text, words.encoding), "acceleration": hits(text, words.acceleration),
        **{f"_task{i}": 3 * hits(title, p) + 2 * hits(abstract, p) for i, p in enumerate(words.tasks.values())},
    })
    task, top = best_task({name: F.col(f"_task{i}") for i, name in enumerate(words.tasks)})
    rows = rows.withColumns({"task": task, "score": top + F.col("generic"), "is_fmri": (F.col("evidence") >= 1) & (F.col("evidence") >= F.col("rival")), "attention": F.col("built") + F.col("pretrained") >= 1})
    rows = rows.withColumns({"decoding": F.col("score") >= 2, "primary": ~F.col("survey")})
    reason = F.when(F.col("survey"), REVIEW).when(F.col("evidence") == 0, NEVER_NAMED).when(~F.col("is_fmri"), RIVAL).when(~F.col("attention"), NO_MACHINERY)
    reason = reason.when(~F.col("decoding") & (F.col("encoding") >= 1), ONLY_ENCODING).when(~F.col("decoding") & (F.col("acceleration") >= 1), ONLY_ACCELERATION).when(~F.col("decoding"), NO_TASK).otherwise("")
    return rows.withColumn("reason", reason).select(key, (F.col("reason") == "").alias("include"), "reason", "task", "score", "evidence", "rival", "built", "pretrained", "near", "is_fmri", "attention", "decoding", "primary")


def datasets_in(c: Column, names: dict[str, list[str]] = V.DATASETS, least: int = 2) -> Column:
    """Data sets whose mentions, over all their patterns, number `least` or more, in the vocabulary's order; case matters."""
    found = [F.when(sum((F.regexp_count(text_or_empty(c), F.lit("(?U)" + p)) for p in patterns), F.lit(0)) >= least, name) for name, patterns in names.items()]
    return F.array_compact(F.array(*found))


def borderline(reason: Column, count: Column) -> Column:
    """Left out for want of attention with one or two mentions of it."""
    return (reason == NO_ATTENTION) & count.between(1, 2)


def seconds_or_milliseconds(value: str, unit: str) -> str | None:
    number = float(value)
    if unit.startswith("m") or (not unit and number > 50):
        return f"{number:g} ms"
    return f"{number:g} s" if number < 50 else None


def parameter_value(name: str, found: re.Match) -> str | None:
    """A parameter's match in its canonical form, or None where it can't be one."""
    value = found[1]
    if name in ("TR", "TE"):
        return seconds_or_milliseconds(value, (found[2] or "").lower())
    if name == "Voxel_Size":
        numbers = [float(n) for n in re.findall(r"\d+(?:\.\d+)?", value)]
        left = found.string[max(0, found.start() - 40) : found.start()]
        return None if not numbers or max(numbers) > 5 or re.search(V.NOT_A_VOXEL, left, re.IGNORECASE) else re.sub(r"\s+", "", value)
    return {"Flip_Angle": f"{value}°", "Field_Strength": f"{value}T", "Multiband": f"MB {value}", "N_Slices": f"{value} slices"}.get(name, value)


def mined_parameters(texts: DataFrame, key: str, text: str, names: dict[str, list[str]] = V.DATASETS, parameters: dict[str, str] = V.PARAMETERS, window: int = 700, spots: int = 40) -> DataFrame:
    """(key, dataset, param, value), each once, for parameters within `window` characters of a data set's first `spots` mentions."""
    of, near = {n: [re.compile(p) for p in ps] for n, ps in names.items()}, {n: re.compile(p, re.IGNORECASE) for n, p in parameters.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = set()
            for k, whole in zip(part["key"], part["text"], strict=True):
                for name, patterns in of.items():
                    places = [m.start() for p in patterns for m in p.finditer(whole or "")][:spots]
                    for at in places:
                        chunk = whole[max(0, at - window) : at + window]
                        out |= {(k, name, param, value) for param, p in near.items() for m in p.finditer(chunk) if (value := parameter_value(param, m))}
            yield pd.DataFrame(sorted(out), columns=["key", "dataset", "param", "value"])

    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, dataset string, param string, value string")


def extracted_fields(texts: DataFrame, key: str, text: str, fields: dict[str, list[str]], post: dict | None = None, quote: int = 200) -> DataFrame:
    """(key, field, value, n, first_pos, quote): what the patterns of each field find, the first group or all of the match, through the field's `post` if it has one.

    Values count together whatever their case, the first spelling stays; the quote is the text round the first find, `quote` characters besides it.
    """
    rules, post = {n: [re.compile(p, re.IGNORECASE) for p in ps] for n, ps in fields.items()}, post or {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, whole in zip(part["key"], part["text"], strict=True):
                whole = whole or ""
                for name, patterns in rules.items():
                    seen: dict[str, list] = {}
                    for p in patterns:
                        for m in p.finditer(whole):
                            raw = m[1] if m.re.groups and m[1] is not None else m[0]
                            value = post[name](raw, m) if name in post else raw
                            value = re.sub(r"\s+", " ", value or "").strip()
                            if value:
                                around = whole[max(0, m.start() - quote // 2) : m.end() + quote // 2]
                                seen.setdefault(value.lower(), [value, 0, m.start(), re.sub(r"\s+", " ", around).strip()])[1] += 1
                    out += [(k, name, *row) for row in seen.values()]
            yield pd.DataFrame(out, columns=["key", "field", "value", "n", "first_pos", "quote"])

    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key string, field string, value string, n long, first_pos long, quote string")
