"""Joins, roll-ups, windows and set operations of the literature engine, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.storagelevel import StorageLevel


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def ranked(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """All rows with their number from 1 in the order given: counts of range partitions, then numbers inside each, so no task sorts everything."""
    rows = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    # a row per partition
    before = counts.select(F.col("_part").alias("_of"), (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_before"))
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    numbered = numbered.join(F.broadcast(before), F.col("_part") == F.col("_of"))
    return numbered.withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_of", "_before", "_n")


def tally(edges: DataFrame, key: str, name: str = "lib_cites") -> DataFrame:
    """Rows per key; every occurrence counts."""
    return edges.groupBy(key).agg(F.count("*").alias(name))


def external(edges: DataFrame, library: DataFrame, cited: str, key: str) -> DataFrame:
    """Edges to works outside the library."""
    return edges.join(library.select(F.col(key).alias(cited)).distinct(), cited, "left_anti")


def not_known(df: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that match no known row in any of the columns; nulls and empty strings never match. One anti join per column."""
    for c in columns:
        df = df.join(known.select(c).where((F.col(c).isNotNull()) & (F.col(c) != "")).distinct(), c, "left_anti")
    return df


def author_rollup(authors: DataFrame, works: DataFrame, work: str, author: str, name: str, cites: str) -> DataFrame:
    """Papers and citations per author, the name as first seen."""
    return authors.join(works, work).groupBy(author).agg(F.count("*").alias("papers"), F.sum(cites).cast("long").alias("cites"), F.min_by(name, work).alias("name"))


def unique_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """key to value where the key is unambiguous."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def merge_rows(left: DataFrame, right: DataFrame, key: str, scalars: list[str], sets: list[str]) -> DataFrame:
    """Full outer merge: the first non-empty scalar, the sorted union of sets."""
    a, b = left.alias("a"), right.alias("b")
    pick = [F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.col(f"b.{c}")).alias(c) for c in scalars]
    none = F.array().cast("array<string>")
    both = [F.array_sort(F.array_union(F.coalesce(F.col(f"a.{c}"), none), F.coalesce(F.col(f"b.{c}"), none))).alias(c) for c in sets]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *pick, *both)


def consensus(values: DataFrame, group: list[str], value: str, paper: str, least: int, top: int) -> DataFrame:
    """The values that at least `least` papers agree on, the `top` of each group."""
    agreed = values.groupBy(*group, value).agg(F.countDistinct(paper).alias("n")).where(F.col("n") >= least)
    order = W.partitionBy(*group).orderBy(F.desc("n"), value)
    return agreed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def carry_forward(value: Column, partition: list[str], order: list[str]) -> Column:
    """The last value that was not null, up to this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def gaps(df: DataFrame, partition: str, low: str, high: str, least: float) -> DataFrame:
    """Rows that start more than `least` after everything before them has ended."""
    before = F.max(high).over(W.partitionBy(partition).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("reach", before).where(F.col(low) > F.col("reach") + least)


def tail_run(df: DataFrame, partition: str, pos: str, hit: Column, budget: int, least: int) -> DataFrame:
    """Start and size of the run of hits at the end of each partition, across at most `budget` misses in a row."""
    back = W.partitionBy(partition).orderBy(F.desc(pos))
    rows = df.withColumn("hit", hit).withColumn("_r", F.row_number().over(back))
    last = F.coalesce(F.max(F.when(F.col("hit"), F.col("_r"))).over(back.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("_broken", F.max((F.col("_r") - last > budget).cast("int")).over(back.rowsBetween(W.unboundedPreceding, 0)))
    return rows.where("hit and _broken = 0").groupBy(partition).agg(F.min(pos).alias("start"), F.count("*").alias("hits")).where(F.col("hits") >= least)


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows overlaid by the new ones of their key."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti"))


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write wins."""
    return first_per_key(changes, [key], [F.desc(c) for c in order])


def three_way(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Keys of a merged set: kept where both have it, or one added it; dropped where one that had it dropped it."""
    tag = lambda df, n: df.select(key, F.lit(True).alias(n))
    rows = tag(base, "b").join(tag(mine, "m"), key, "full_outer").join(tag(theirs, "t"), key, "full_outer").na.fill(False, ["b", "m", "t"])
    return rows.where("(b and m and t) or (not b and (m or t))").select(key)


def crawl(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Works reached from the seeds: hops and links from works reached before, level by level. Links that repeat count once."""
    reached = seeds.select(F.col("id"), F.lit(0).alias("hops"), F.lit(0).cast("long").alias("in_links"))
    level = reached
    for hop in range(1, depth + 1):
        found = edges.join(level.select(F.col("id").alias("src")), "src").select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_links"))
        level = found.join(reached.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"), "in_links")
        reached = reached.unionByName(level)
    return reached


def nearest(a: DataFrame, b: DataFrame, key: str, pos: str, window: int) -> DataFrame:
    """Rows of `a` that have a row of `b` of their key within `window`, with its distance. `pos` is a whole number.

    Positions are cut into cells of the window's size and each b goes to three cells, so a hot key spreads over its cells
    and no pairs are formed.
    """
    cell = F.floor(F.col(pos) / window)
    names = a.columns
    left = a.select(F.struct(*names).alias("_a"), F.col(key).alias("_k"), cell.alias("_c"), F.col(pos).alias("_p"), F.lit(None).cast("long").alias("_b"))
    # of the b in a place one is enough
    right = b.select(F.col(key).alias("_k"), cell.alias("_m"), F.col(pos).alias("_p")).distinct()
    right = right.select("_k", F.explode(F.sequence(F.col("_m") - 1, F.col("_m") + 1)).alias("_c"), "_p", F.col("_p").alias("_b"))
    order = W.partitionBy("_k", "_c").orderBy("_p")
    below = F.max("_b").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    above = F.min("_b").over(order.rangeBetween(W.currentRow, W.unboundedFollowing))
    rows = left.unionByName(right, allowMissingColumns=True).withColumns({"_below": below, "_above": above}).where("_a is not null")
    distance = F.least(F.col("_p") - F.col("_below"), F.col("_above") - F.col("_p"))
    return rows.select(*(F.col("_a")[n].alias(n) for n in names), distance.alias("distance")).where(F.col("distance") <= window)


def same_start(asked: DataFrame, known: DataFrame, title: str, least: int = 25) -> DataFrame:
    """Asked rows whose title starts a known one or the other way round, both longer than `least`. Blocks: the first characters."""
    t = known.select(F.col(title).alias("_t")).where(F.length("_t") > least).distinct()
    block = F.substring(F.col(title), 1, least + 1) == F.substring("_t", 1, least + 1)
    either = F.startswith(F.col(title), F.col("_t")) | F.startswith(F.col("_t"), F.col(title))
    return asked.where(F.length(title) > least).join(t, block & either, "left_semi")


def value_counts(values: DataFrame, group: list[str], value: str, pos: str) -> DataFrame:
    """How often each value occurs whatever its case; the first spelling stays."""
    return values.groupBy(*group, F.lower(value).alias("folded")).agg(F.count("*").alias("n"), F.min_by(value, pos).alias("spelling"))


def first_filled(rows: DataFrame, key: str, pos: str, columns: list[str]) -> DataFrame:
    """A row per key: how many there were, and of each column the first value that is not empty."""
    filled = [F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(pos))).alias(c) for c in columns]
    return rows.groupBy(key).agg(F.count("*").alias("n"), *filled)


def blocks(starts: Column, partition: list[str], order: list[str]) -> Column:
    """Number of the block that a row lies in; a row where `starts` holds opens one."""
    return F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that were added, removed or changed between two versions of a table of the same columns."""
    rest = [c for c in before.columns if c != key]
    a = before.select(F.col(key).alias("_a"), F.struct(*rest).alias("_x"))
    b = after.select(F.col(key).alias("_b"), F.struct(*rest).alias("_y"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), kind.alias("change")).where("change is not null")


def word_overlap(left: DataFrame, right: DataFrame, key: str, word: str) -> DataFrame:
    """Precision and recall of the left words as a multiset against the right ones, per key that has both."""
    a = left.groupBy(key, word).agg(F.count("*").alias("_l"))
    b = right.groupBy(key, word).agg(F.count("*").alias("_r"))
    rows = a.join(b, [key, word], "full_outer").na.fill(0, ["_l", "_r"])
    sums = rows.groupBy(key).agg(F.sum(F.least("_l", "_r")).alias("_both"), F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return sums.where("_l > 0 and _r > 0").select(key, F.round(F.col("_both") / F.col("_l"), 6).alias("precision"), F.round(F.col("_both") / F.col("_r"), 6).alias("recall"))
