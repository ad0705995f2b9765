"""Edits of curated lists: rows of (list, key, pos, ...), positions 1 to n in each list. One shuffle by list an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Places before and behind every position.
TOP, BOTTOM = 0.0, float("inf")


def renumber(items: DataFrame, *order: Column | str, of: str = "list") -> DataFrame:
    """Positions 1 to n in the order given, each list by itself."""
    return items.withColumn("pos", F.row_number().over(W.partitionBy(of).orderBy(*(order or ("pos",)))))


def remove(items: DataFrame, keys: DataFrame, of: str = "list", key: str = "key") -> DataFrame:
    """The list without the rows of `keys` (list and key)."""
    return renumber(items.join(keys.select(of, key).distinct(), [of, key], "left_anti"), of=of)


def after(anchor: Column, of: str = "list") -> Column:
    """The place behind the first row that `anchor` marks, as it stands before the edit; without one, the bottom."""
    return F.coalesce(F.min(F.when(anchor, F.col("pos"))).over(W.partitionBy(of)) + 0.5, F.lit(BOTTOM))


def move(items: DataFrame, which: Column, to: Column | float, of: str = "list") -> DataFrame:
    """The rows that `which` marks go to `to` (TOP, BOTTOM, after(...)), in their order."""
    placed = items.withColumn("_to", F.when(which, to if isinstance(to, Column) else F.lit(to)).otherwise(F.col("pos")))
    return renumber(placed, "_to", "pos", of=of).drop("_to")


def set_cell(items: DataFrame, column: str, which: Column, value: Column, how: str = "replace", between: str = "; ") -> DataFrame:
    """Write a text cell of the marked rows: replace, append, prepend or fill (empty cells only)."""
    old = F.nullif(F.col(column), F.lit(""))
    new = {
        "replace": value,
        "append": F.concat_ws(between, old, value),
        "prepend": F.concat_ws(between, value, old),
        "fill": F.coalesce(old, value),
    }[how]
    return items.withColumn(column, F.when(which, new).otherwise(F.col(column)))


def retag(tags: Column, add: list[str], drop: list[str]) -> Column:
    """Tags without those dropped and with those added at the end, each once whatever its case; the first spelling stays."""
    gone, extra = [w.lower() for w in drop], [w for w in add if w]
    every = F.concat(tags, F.array(*(F.lit(w) for w in extra)).cast("array<string>"))
    low = F.transform(every, F.lower)
    return F.filter(every, lambda t, i: ~F.lower(t).isin(gone) & (F.array_position(low, F.lower(t)) == i + 1))


def fill_empty(items: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Empty cells filled from the row of that key in `other`, whose keys are unique; cells with a value stay."""
    known = other.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    filled = items.join(known, F.col(key) == F.col("_k"), "left")
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")))
    return filled.select(*items.columns)


def append(items: DataFrame, new: DataFrame, of: str = "list", key: str = "key", at: str = "bottom") -> DataFrame:
    """Rows of `new` whose key its list does not have yet, in their order, at the bottom or top; the list's own rows stay as they are."""
    fresh = new.join(items.select(of, key).distinct(), [of, key], "left_anti")
    fresh = fresh.withColumn("_t", F.row_number().over(W.partitionBy(of, key).orderBy("pos"))).where("_t = 1").drop("_t")
    side = F.lit(1 if at == "bottom" else -1)
    return renumber(items.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", side)), "_side", "pos", of=of).drop("_side")


def update(items: DataFrame, edits: DataFrame, columns: list[str], of: str = "list", key: str = "key") -> DataFrame:
    """Cells written by key: a null in `edits`, whose keys are unique, leaves the cell as it is."""
    known = edits.select(F.col(of).alias("_l"), F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    rows = items.join(known, (F.col(of) == F.col("_l")) & (F.col(key) == F.col("_k")), "left")
    return rows.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in items.columns))


def rename_tag(tags: Column, old: str, new: str) -> Column:
    """Tags with one of them renamed whatever its case; where the new one is there already the two are one, in the first's place."""
    named = F.transform(tags, lambda t: F.when(F.lower(t) == old.lower(), F.lit(new)).otherwise(t))
    low = F.transform(named, lambda t: F.lower(t))
    return F.filter(named, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def vocabulary(items: DataFrame, colours: DataFrame, of: str = "list") -> DataFrame:
    """(list, name, place, n, colour): the tags in use in order of first use, each with how many rows have it and its colour if `colours` (list, name, colour) has one."""
    used = items.select(of, "pos", F.posexplode("tags").alias("i", "tag")).groupBy(of, F.lower("tag").alias("_n"))
    used = used.agg(F.min_by("tag", F.struct("pos", "i")).alias("name"), F.min(F.struct("pos", "i")).alias("_first"), F.count("*").alias("n"))
    known = colours.select(F.col(of), F.lower("name").alias("_n"), "colour")
    return used.join(known, [of, "_n"], "left").withColumn("place", F.row_number().over(W.partitionBy(of).orderBy("_first"))).select(of, "name", "place", "n", "colour")


def rename_field(fields: Column, old: str, new: str) -> Column:
    """Cells, as a map of column to text, with a column renamed; the new name's own cell wins."""
    return F.when(F.map_contains_key(fields, new) | ~F.map_contains_key(fields, old), drop_field(fields, old)).otherwise(F.transform_keys(fields, lambda k, v: F.when(k == old, F.lit(new)).otherwise(k)))


def drop_field(fields: Column, name: str) -> Column:
    return F.map_filter(fields, lambda k, v: k != name)


def landed(items: DataFrame, picked: DataFrame, existing: str = "skip", of: str = "list", key: str = "key") -> DataFrame:
    """An import: picked rows land at the bottom in their order; those that the list has are skipped, or moved there with `move`."""
    if existing == "move":
        items = remove(items, picked, of, key)
    return append(items, picked, of, key)


def known_first(rows: DataFrame, key: str = "key", most: int | None = None) -> DataFrame:
    """Constraint of a list and its shelf: one row a key, the list's (loc `items`) before the shelf's, by position, and `most` rows a place."""
    order = [F.when(F.col("loc") == "items", 0).otherwise(1), F.col("pos")]
    rows = rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_n", F.row_number().over(W.partitionBy("list", key).orderBy(*order))).where("_n = 1").drop("_n")
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("list", "loc").orderBy("pos")))
    return rows if most is None else rows.where(F.col("pos") <= most)


def view(items: DataFrame, test: Column, of: str = "list") -> DataFrame:
    """The rows that pass, each with the number of its list's rows and of those shown."""
    rows = items.withColumn("total", F.count("*").over(W.partitionBy(of))).where(test)
    return rows.withColumn("shown", F.count("*").over(W.partitionBy(of)))


def copied(items: DataFrame, source: str, name: str, test: Column | None = None, of: str = "list") -> DataFrame:
    """A copy of a list, or of the rows of it that pass, under a new name in the same order; all others as they are."""
    own = items.where(F.col(of) == source)
    return items.unionByName(renumber((own if test is None else own.where(test)).withColumn(of, F.lit(name)), of=of))


def mirrored(items: DataFrame, before: DataFrame, after: DataFrame, columns: list[str], key: str = "key") -> DataFrame:
    """Edits of one list (before, after; unique keys) applied to the rows of the same key in others: a cell that changed is written, an unchanged one left."""
    b = before.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    a = after.select(F.col(key).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in columns))
    edits = b.join(a, F.col("_k") == F.col("_a"))
    rows = items.join(edits, F.col(key) == F.col("_k"), "left")
    new = lambda c: F.when(F.col("_k").isNotNull() & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.col(f"_a_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*(new(c) if c in columns else F.col(c) for c in items.columns))


def picked(base: Column, mine: Column, theirs: Column) -> Column:
    """Mine if I changed it, else theirs."""
    return F.when(mine.eqNullSafe(base), theirs).otherwise(mine)


def merged_rows(base: DataFrame, mine: DataFrame, theirs: DataFrame, columns: list[str], key: str = "key") -> DataFrame:
    """Three versions of a list's rows (key, loc, columns) as one, without order: where a row is goes by the side that moved it, gone counting as a place; each cell by the side that changed it; rows that one side added as they are."""
    side = lambda df, n: df.select(F.col(key), *(F.col(c).alias(f"{n}_{c}") for c in ("loc", *columns)))
    rows = side(base, "b").join(side(mine, "m"), key, "full_outer").join(side(theirs, "t"), key, "full_outer")
    b, m, t = (lambda c: F.col(f"b_{c}")), (lambda c: F.col(f"m_{c}")), (lambda c: F.col(f"t_{c}"))
    old, both = b("loc").isNotNull(), m("loc").isNotNull() & t("loc").isNotNull()
    cell = lambda c: F.when(~both, F.when(m("loc").isNotNull(), m(c)).otherwise(t(c))).when(old, picked(b(c), m(c), t(c))).otherwise(F.coalesce(F.nullif(m(c), F.lit("")), t(c)))
    return rows.select(key, picked(b("loc"), m("loc"), t("loc")).alias("loc"), *(cell(c).alias(c) for c in columns)).where("loc is not null")


def woven(first: list, second: list, keep: set) -> list:
    """The first order's kept keys, and those only the second has behind their nearest kept predecessor there, or on top without one."""
    order, place = [k for k in first if k in keep], None
    here = set(order)
    for k in second:
        if k in keep and k not in here:
            order.insert(0 if place is None else order.index(place) + 1, k)
            here.add(k)
        if k in here:
            place = k
    return order + sorted(keep - here)


def merged_order(base: DataFrame, mine: DataFrame, theirs: DataFrame, kept: DataFrame, of: str = "list", key: str = "key") -> DataFrame:
    """Positions of the kept rows (list, key) of a merge: my order if I changed that of the rows I share with the base, else theirs; a list is one task."""
    import pandas as pd

    tag = lambda df, n: df.select(of, key, "pos", F.lit(n).alias("side"))
    rows = tag(base, "b").unionByName(tag(mine, "m")).unionByName(tag(theirs, "t")).unionByName(kept.select(of, key, F.lit(0).alias("pos"), F.lit("k").alias("side")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        b, m, t, keep = (part[part["side"] == s].sort_values("pos")[key].tolist() for s in "bmtk")
        shared = set(b) & set(m)
        moved = [k for k in m if k in shared] != [k for k in b if k in shared]
        order = woven(m, t, set(keep)) if moved else woven(t, m, set(keep))
        return pd.DataFrame({of: [part[of].iloc[0]] * len(order), key: order, "pos": range(1, len(order) + 1)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(of, key).schema)
    return rows.groupBy(of).applyInPandas(run, fields + ", pos int")


def kept_versions(history: DataFrame, now: DataFrame, most: int = 40, of: str = "list") -> DataFrame:
    """The history (list, rev, ...) with the present rows of each list as its next revision, the last `most` revisions of it."""
    last = history.groupBy(of).agg(F.max("rev").alias("_r"))
    new = now.join(last, of, "left").withColumn("rev", F.coalesce("_r", F.lit(0)) + 1).drop("_r")
    rows = history.unionByName(new.select(*history.columns))
    newest = F.max("rev").over(W.partitionBy(of))
    return rows.withColumn("_new", newest).where(F.col("rev") > F.col("_new") - most).drop("_new")


def restored(history: DataFrame, of: str, name: str, rev: int) -> DataFrame:
    """The rows of one revision of a list."""
    return history.where((F.col(of) == name) & (F.col("rev") == rev)).drop("rev")


def accepted(now: DataFrame, asked: DataFrame, of: str = "list") -> DataFrame:
    """Whether each write (list, if_rev) meets the revision it was made for; one without a revision always does."""
    return asked.join(now.groupBy(of).agg(F.max("rev").alias("_r")), of, "left").select(of, (F.col("if_rev").isNull() | F.col("if_rev").eqNullSafe(F.col("_r"))).alias("ok"))
