"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

DataFrame functions only. For each kind, regexp_extract_all gives the matches in order and split the pieces between
them; running sums of their lengths are the offsets in code points, and the pieces' ends are the context. The patterns
start with a look-behind (or the end of the match before) and use possessive quantifiers: they match exactly
what the plain forms match leftmost, in time linear in the text, without recursion on long runs.

Base kinds are email, ip (parts at most 255), card (16 to 19 digits, Luhn) and phone (8 to 15 digits); their spans are
always kept. Added kinds are iban (mod 97) and national_id (no checksum: kept only if a context word raises its score).

Defined results: a null text counts as empty and gives no spans; an empty table an empty result; rows that repeat are
scored alike, each for itself; texts are read whole; only identifier and text are read of the input's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import table

#: Code points on either side of a span in which context words count.
CONTEXT = 40
#: Least score of an added span.
LEAST = 0.5

#: kind: (pattern, cheap guard that any match implies, score after the checks, context words, base kind)
KINDS: dict[str, tuple[str, str, float, str, bool]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|correo|courriel", True),
    "ip": (r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|login", True),
    "card": (r"(?=[0-9])[0-9](?:[\x20-]?[0-9]){15,}+", "", 0.8, "card|visa|credit|karte|carte|tarjeta|pay", True),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "tel|phone|call|fax|mobile|ruf", True),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", 0.8, "iban|account|bank|konto|compte|cuenta", False),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security|tax|identity", False),
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))

    def step(total: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(F.reverse(number), i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return (total + F.when(i % 2 == 0, twice).otherwise(d)).cast("int")

    return F.aggregate(places, F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a string of A-Z and 0-9 passes the mod-97 check of account numbers."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        number = digits(value)
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


def _spans_of(kind: str, text: Column, found: Column) -> Column:
    """array<struct<kind, start, end, value, score>> of one kind, from the matches found in order."""
    pattern, _, base_score, words, base = KINDS[kind]
    pieces = F.split(text, pattern, -1)

    def spans(parts: Column) -> Column:
        widths = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        starts = F.aggregate(widths, F.array().cast("array<int>"), lambda acc, w: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + w)))

        def one(starts: Column) -> Column:
            def row(m: Column, i: Column) -> Column:
                near = F.lower(F.concat_ws(" ", F.substring(F.get(parts, i), -CONTEXT, CONTEXT), F.substring(F.get(parts, i + 1), 1, CONTEXT)))
                score = F.lit(base_score) + F.when(near.rlike(words), 0.3).otherwise(0.0)
                return F.struct(F.lit(kind).alias("kind"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("value"), F.least(score, F.lit(1.0)).alias("score"))

            return F.transform(found, row)

        kept = F.filter(F.element_at(F.transform(F.array(starts), one), 1), lambda s: confirmed(kind, s["value"]))
        return kept if base else F.filter(kept, lambda s: s["score"] >= LEAST)

    # a one-element transform binds the pieces once
    return F.element_at(F.transform(F.array(pieces), spans), 1)


EMPTY = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each kind, an array of confirmed spans with value and score, in text order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text.alias("text"))
    found = []
    for kind, (pattern, guard, *_rest) in KINDS.items():
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found.append((F.when(F.contains(F.col("text"), F.lit(guard)), matches) if guard else matches).alias(f"m_{kind}"))
    rows = rows.select("doc_id", "text", *found)
    return rows.select("doc_id", *(F.when(F.size(f"m_{k}") > 0, _spans_of(k, F.col("text"), F.col(f"m_{k}"))).otherwise(F.array().cast(EMPTY)).alias(k) for k in KINDS))


def span_list(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = [k for k, v in KINDS.items() if v[4]]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    every = found.select("doc_id", *counts, *(span_list(F.col(k)).alias(k) for k in KINDS))
    return every.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2(F.concat_ws(",", F.concat(*base)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(*KINDS)).alias("spans"),
    )
