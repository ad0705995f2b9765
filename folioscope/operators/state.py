"""State between runs: problem log, pruning, completion stamps; lookups in order of precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.relational import first_per_key


def problem_log(stored: DataFrame, seen: DataFrame, cleared: DataFrame, key: list[str]) -> DataFrame:
    """The log after a run: first_seen is kept, last_seen refreshed, and problems that succeeded go."""
    rows = stored.select(*key, "first_seen", "last_seen").unionByName(seen.select(*key, F.col("at").alias("first_seen"), F.col("at").alias("last_seen")))
    merged = rows.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return merged.join(cleared.select(*key).distinct(), key, "left_anti")


def prune(stored: DataFrame, snapshot: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """Stored rows that the snapshot still has; a partial snapshot prunes nothing."""
    return stored.join(snapshot.select(key).distinct(), key, "left_semi") if complete else stored


def detach(stored: DataFrame, snapshot: DataFrame, key: str, sources: str, source: str) -> DataFrame:
    """Stored rows after a complete snapshot of one source: a row that it no longer has loses the source, and goes if that was its only one."""
    kept = snapshot.select(F.col(key).alias("_k")).distinct()
    rows = stored.join(kept, F.col(key) == F.col("_k"), "left")
    gone = F.array_contains(sources, source) & F.col("_k").isNull()
    rest = F.when(gone, F.array_remove(sources, source)).otherwise(F.col(sources))
    return rows.withColumn(sources, rest).where(F.size(sources) > 0).drop("_k")


def pending(inputs: DataFrame, stamps: DataFrame, key: str, version: int, signature: str = "sig") -> DataFrame:
    """Rows without a completion stamp of this version and signature."""
    done = stamps.where(F.col("version") == version).select(key, signature).distinct()
    return inputs.join(done, [key, signature], "left_anti")


def exists_exact(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Whether each asked row is known: by DOI alone where it has one, else by title. One equi join for each kind."""
    dois = known.select(F.col("doi").alias("_d")).where("_d is not null").distinct()
    titles = known.select(F.col("title").alias("_t")).where("_t <> ''").distinct()
    rows = asked.join(dois, F.col("doi") == F.col("_d"), "left").join(titles, F.col("title") == F.col("_t"), "left")
    return rows.select(key, F.when(F.col("doi").isNotNull(), F.col("_d").isNotNull()).otherwise(F.col("_t").isNotNull()).alias("known"))


def resolve(asked: DataFrame, legs: list[tuple[str, str, DataFrame]], key: str) -> DataFrame:
    """The target of each asked row by the first leg that has one. A leg: its name, the asked column, (term, target)."""
    found = None
    for place, (how, column, terms) in enumerate(legs):
        hit = asked.select(key, F.col(column).alias("term")).join(terms.select("term", "target"), "term").select(key, "target", F.lit(how).alias("how"), F.lit(place).alias("place"))
        found = hit if found is None else found.unionByName(hit)
    return first_per_key(found, [key], ["place", "target"]).drop("place")


def inferred(papers: DataFrame, uses: DataFrame, agreed: DataFrame, key: str, value: str, group: str) -> DataFrame:
    """A paper's own value, else the agreed one of its group if exactly one of its groups has one; `source` says which."""
    known = uses.select(key, group).distinct().join(agreed.select(group, F.col(value).alias("_v")), group)
    one = known.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.min("_v").alias("_v"))
    rows = papers.join(one, F.col(key) == F.col("_k"), "left")
    own = F.nullif(F.col(value), F.lit(""))
    source = F.when(own.isNotNull(), "own").when(F.col("_n") == 1, "inferred").when(F.col("_n") > 1, "several")
    return rows.select(key, F.coalesce(own, F.when(F.col("_n") == 1, F.col("_v"))).alias(value), source.alias("source"))
