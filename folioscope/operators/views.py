"""Views of the collection: report rows, pickers, spatial joins, roll-ups, sorts and pages, as DataFrame plans."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.functions.predicates import in_ranges
from folioscope.functions.text import normalize_doi, tags_match, text_or_empty

#: Columns that only the engine needs.
INTERNAL = ("hay", "hay_t", "hay_k", "rel", "created_sort")
#: Ranges of acquisition parameters in seconds and milliseconds.
PLAUSIBLE = {"TR": (0.3, 6.0, 300.0, 6000.0), "TE": (0.005, 0.12, 5.0, 120.0), "Flip_Angle": (1.0, 180.0), "Voxel_Size": (0.3, 6.0), "Slice_Thickness": (0.3, 10.0)}
#: Sort keys, each the columns it stands for; titles ascend unless told otherwise.
SORTS = {"relevance": ("rel", "lib_cites", "cited_by"), "lib_cites": ("lib_cites", "cited_by"), "cited_by": ("cited_by", "lib_cites"), "year": ("year", "cited_by"), "title": ("title",), "created_at": ("created_at",), "code": ("code", "cited_by")}


def report_rows(works: DataFrame, proxy: str = "") -> DataFrame:
    """The nine columns of a report, from wid, cites, title, year, doi, pdf, cited_by; links only where there is a DOI."""
    doi = normalize_doi(F.col("doi"))
    return works.select(
        "cites",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(no metadata)")).alias("title"),
        "year",
        F.coalesce(F.concat(F.lit(proxy), doi), F.lit("")).alias("proxy"),
        doi.alias("doi"),
        F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.lit("")).alias("link"),
        F.coalesce("pdf", F.lit("")).alias("pdf"),
        "cited_by",
        "wid",
    )


def public(rows: DataFrame) -> DataFrame:
    """The rows without internal columns and those that begin with an underscore."""
    return rows.drop(*(c for c in rows.columns if c in INTERNAL or c.startswith("_")))


def of_managers(sources: Column, managers: list[str]) -> Column:
    """Whether a map of sources has any of the managers; none asked for lets all pass."""
    return F.arrays_overlap(F.map_keys(sources), F.array(*(F.lit(m) for m in managers))) if managers else F.lit(True)


def passes(flags: list[Column], hosts: Column, wanted: list[str], hay: Column, text: str) -> Column:
    """All flags, any of the hosts, and the text as a substring; what is not asked for lets all pass."""
    tests = [F.coalesce(f, F.lit(False)) for f in flags]
    if wanted:
        tests.append(F.arrays_overlap(hosts, F.array(*(F.lit(h) for h in wanted))))
    if text.strip():
        tests.append(F.contains(F.lower(text_or_empty(hay)), F.lit(text.strip().lower())))
    return reduce(and_, tests, F.lit(True))


def pick_rows(rows: DataFrame, keys: list | None = None, spans: list[tuple[int, int]] | None = None, tags: list[str] | None = None, how: str = "any", year_from: int | None = None, year_to: int | None = None, no_year: bool = False, text: str = "") -> DataFrame:
    """Rows of (key, pos, tags, year, hay) by every rule given. A row without a year passes if no bound is set or no_year."""
    tests = []
    if keys is not None:
        tests.append(F.col("key").isin(keys))
    if spans:
        tests.append(in_ranges(F.col("pos"), spans))
    if tags:
        tests.append(tags_match(F.col("tags"), tags, how))
    if year_from is not None or year_to is not None:
        within = F.col("year").between(F.lit(-(10**6) if year_from is None else year_from), F.lit(10**6 if year_to is None else year_to))
        tests.append(F.when(F.col("year").isNull(), F.lit(no_year)).otherwise(within))
    if text.strip():
        tests.append(F.contains(F.lower("hay"), F.lit(text.strip().lower())))
    return rows.where(reduce(and_, tests, F.lit(True)))


def not_junk(hay: Column, doi: Column) -> Column:
    """Whether a pool row says anything: some text, or a DOI."""
    return (F.trim(text_or_empty(hay)) != "") | doi.isNotNull()


def plausible_value(field: str, value: Column) -> Column:
    """Whether every number of a field's value can be that parameter, in the unit that the value names; no number, or an unknown field, passes."""
    if field not in PLAUSIBLE:
        return F.lit(True)
    value = text_or_empty(value)
    seconds, *rest = PLAUSIBLE[field][:2], PLAUSIBLE[field][2:]
    numbers = F.transform(F.regexp_extract_all(value, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    inside = lambda low, high: F.forall(numbers, lambda x: x.between(low, high))
    if not rest[0]:
        return inside(*seconds)
    in_seconds = ~F.contains(value, F.lit("ms")) & F.rlike(value, F.lit(r"\bs\b"))
    return F.when(in_seconds, inside(*seconds)).otherwise(inside(*rest[0]))


def creators(own: Column, index: Column, most: int = 60) -> Column:
    """The manager's creators if it has any, else the index's, the first `most`."""
    return F.slice(F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(F.coalesce(index, F.array().cast("array<string>"))), 1, most)


def pool_merge(pools: list[tuple[str, DataFrame]], key: str, count: str, first: list[str]) -> DataFrame:
    """Pools in order of precedence as one: their names, the sum of `count`, other columns from the first pool that has the key."""
    rows = [p.select(key, count, *first, F.lit(name).alias("pool"), F.lit(i).alias("_place")) for i, (name, p) in enumerate(pools)]
    every = reduce(DataFrame.unionByName, rows)
    names = F.transform(F.array_sort(F.collect_set(F.struct("_place", "pool"))), lambda x: x["pool"])
    return every.groupBy(key).agg(names.alias("pools"), F.sum(count).alias(count), *(F.min_by(c, "_place").alias(c) for c in first))


def attach_captions(figures: DataFrame, captions: DataFrame, page: list[str], share: float = 0.30, gap: float = 150.0) -> DataFrame:
    """(page, figure, caption) where the boxes overlap in x by `share` of the narrower and the caption starts or ends within `gap`. Boxes: id, x1, y1, x2, y2.

    The figure of a page that has only one takes all its captions if none lies near. A page bounds the pairs formed.
    """
    f = figures.select(*page, F.col("id").alias("figure"), *(F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")))
    f = f.withColumn("_figures", F.count("*").over(W.partitionBy(*page)))
    rows = f.join(captions.withColumnRenamed("id", "caption"), page)
    overlap = F.least("f_x2", "x2") - F.greatest("f_x1", "x1")
    below, above = F.col("y1") - F.col("f_y2"), F.col("f_y1") - F.col("y2")
    near = (overlap >= share * F.least(F.col("f_x2") - F.col("f_x1"), F.col("x2") - F.col("x1"))) & (overlap > 0) & (below.between(0, gap) | above.between(0, gap))
    rows = rows.withColumn("_near", near).withColumn("_any", F.max("_near").over(W.partitionBy(*page, "figure")))
    return rows.where("_near or (_figures = 1 and not _any)").select(*page, "figure", "caption")


def hidden_boxes(boxes: DataFrame, page: list[str], same: float = 0.80, inside: float = 0.80, slack: float = 0.10) -> DataFrame:
    """(page, id) of boxes (id, type, x1, y1, x2, y2, conf) that another of their type shows: near equal and more confident, or larger round it and not much less confident."""
    side = lambda n: boxes.select(*page, "type", *(F.col(c).alias(f"{n}_{c}") for c in ("id", "x1", "y1", "x2", "y2", "conf")))
    rows = side("a").join(side("b"), [*page, "type"]).where("a_id <> b_id")
    area = lambda n: F.greatest(F.col(f"{n}_x2") - F.col(f"{n}_x1"), F.lit(0.0)) * F.greatest(F.col(f"{n}_y2") - F.col(f"{n}_y1"), F.lit(0.0))
    span = lambda low, high: F.greatest(F.least(f"a_{high}", f"b_{high}") - F.greatest(f"a_{low}", f"b_{low}"), F.lit(0.0))
    rows = rows.withColumns({"_a": area("a"), "_b": area("b"), "_i": span("x1", "x2") * span("y1", "y2")}).where("_a > 0 and _i > 0")
    near = F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i")) >= same
    weaker = (F.col("a_conf") < F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_id") > F.col("b_id")))
    within = (F.col("_b") > F.col("_a")) & (F.col("_i") / F.col("_a") >= inside) & (F.col("b_conf") >= F.col("a_conf") - slack)
    return rows.where(F.when(near, weaker).otherwise(within)).select(*page, F.col("a_id").alias("id")).distinct()


def insert_new(batch: DataFrame, known: DataFrame, columns: list[str], pos: str) -> DataFrame:
    """Rows of a batch that are new by every column, the earlier rows of the batch counting as known once accepted; empty values never match.

    A row falls to an earlier one that shares a value whether that one itself was accepted or not; a value belongs to its first row.
    """
    rows = batch
    for c in columns:
        rows = rows.join(known.select(c).where(F.coalesce(F.col(c), F.lit("")) != "").distinct(), c, "left_anti")
    for c in columns:
        # rows without the value stand apart, so they neither meet in one window nor fall
        first = rows.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias("_v")).agg(F.min(pos).alias("_first"))
        rows = rows.join(first, F.col(c) == F.col("_v"), "left").where(F.col("_v").isNull() | (F.col(pos) == F.col("_first"))).drop("_v", "_first")
    return rows.select(*batch.columns)


def alias_index(legs: list[tuple[str, DataFrame]]) -> DataFrame:
    """term -> target and how, by the first leg that has the term. A leg: its name and (term, target)."""
    rows = [df.select("term", "target", F.lit(how).alias("how"), F.lit(i).alias("_place")).where(F.coalesce(F.col("term"), F.lit("")) != "") for i, (how, df) in enumerate(legs)]
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy("term").agg(F.min_by(F.struct("target", "how"), F.struct("_place", "target")).alias("one")).select("term", "one.target", "one.how")


def stage_tally(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Per stage column: done, failed, missing, applicable and percent done; na leaves the denominator, 100 without any."""
    long = rows.unpivot([], [F.col(s).cast("string") for s in stages], "stage", "state")
    counts = long.groupBy("stage").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "missing")))
    total = F.col("done") + F.col("failed") + F.col("missing")
    return counts.withColumn("applicable", total).withColumn("pct", F.when(total > 0, F.round(F.col("done") * 100.0 / total, 1)).otherwise(F.lit(100.0)))


def grouped_problems(problems: DataFrame) -> DataFrame:
    """Problems (kind, id, paper, last_seen) by paper, or by id without one: count, kinds in order, latest sight, and ids newest first."""
    newest = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("last_seen", "id")))), lambda x: x["id"])
    grouped = problems.groupBy(F.coalesce(F.nullif("paper", F.lit("")), F.col("id")).alias("group"))
    return grouped.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("kind")).alias("kinds"), F.max("last_seen").alias("last"), newest.alias("ids"))


def kind_tabs(grouped: DataFrame) -> DataFrame:
    """How many groups have each kind."""
    return grouped.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("groups"))


def hashtags(c: Column) -> Column:
    """Words of two characters and more that begin with #."""
    return F.filter(F.split(text_or_empty(c), r"\s+"), lambda w: w.startswith("#") & (F.length(w) > 1))


def links_rollup(links: DataFrame) -> DataFrame:
    """Links (key, link, paper, method, note, pos) by canonical key: papers, how many, methods, first note; those with a method first, then by papers and host."""
    grouped = links.groupBy("link").agg(
        F.sort_array(F.collect_set("paper")).alias("papers"),
        F.count_distinct("paper").alias("n"),
        F.sort_array(F.collect_set(F.nullif("method", F.lit("")))).alias("methods"),
        F.min_by(F.nullif("note", F.lit("")), F.when(F.coalesce("note", F.lit("")) != "", F.col("pos"))).alias("note"),
        F.first("host", ignorenulls=True).alias("host"),
    )
    return grouped.withColumn("order", F.struct((F.size("methods") == 0).alias("a"), (-F.col("n")).alias("b"), F.col("host").alias("c"), F.col("link").alias("d")))


def paper_links(links: DataFrame, vocabulary: list[str], rows: list[str] | None = None) -> DataFrame:
    """Links by paper: how many, distinct sources as first seen, the first that has a place, methods in the vocabulary's order.

    Null sources are none; sources without a place come last. Of one place the first by the columns `rows` comes first, or else the smaller.
    """
    place = F.struct("pos", *(rows or []), "source")
    first = F.min_by("source", F.when(F.col("source").isNotNull() & F.col("pos").isNotNull(), place))
    placed = F.when(F.col("source").isNotNull(), F.struct(F.col("pos").isNull().alias("late"), "pos", *(rows or []), "source"))
    ordered = F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["source"])
    own = links.groupBy("paper").agg(F.count_distinct("link").alias("n"), F.array_distinct(ordered).alias("sources"), first.alias("first_source"), F.collect_set("method").alias("_m"))
    return own.withColumn("methods", F.filter(F.array(*(F.lit(v) for v in vocabulary)), lambda x: F.array_contains("_m", x))).drop("_m")


def flag_pivot(rows: DataFrame, key: str, label: str, confirmed: Column, labels: list[str]) -> DataFrame:
    """A column per label: a tick where any of the key's rows confirms it, a dot where they only infer it, else empty."""
    flags = [F.max(F.when(F.col(label) == v, F.when(confirmed, 2).otherwise(1))).alias(f"_{i}") for i, v in enumerate(labels)]
    grouped = rows.groupBy(key).agg(*flags)
    return grouped.select(key, *(F.when(F.col(f"_{i}") == 2, "✓").when(F.col(f"_{i}") == 1, "·").otherwise("").alias(v) for i, v in enumerate(labels)))


def sections_wide(rows: DataFrame, key: str, header: str, body: str, pos: str) -> DataFrame:
    """A column per header, in order of first appearance; the bodies of a key's repeated header joined by an empty line. Headers: a bounded vocabulary."""
    order = [r[0] for r in rows.groupBy(header).agg(F.min(pos).alias("_p")).orderBy("_p", header).select(header).collect()]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, body))), lambda x: x[body]), "\n\n")
    return rows.groupBy(key).pivot(header, order).agg(joined)


def selection(rows: DataFrame) -> DataFrame:
    """Figure picks (id `key#figure-N`, modalities `a;b`, caption) by key: modalities once each, captions in order, how many."""
    key = F.regexp_replace("id", "#[^#]*$", "")
    mods = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split("modalities", ";"))), lambda m: F.trim(m) != "")))
    captions = F.transform(F.array_sort(F.collect_list(F.struct("pos", "caption"))), lambda x: x["caption"])
    return rows.groupBy(key.alias("key")).agg(mods.alias("mods"), captions.alias("captions"), F.count("*").alias("figures"))


def with_occurrences(rows: DataFrame, key: str, pos: str, first: list[str], filled: list[str], occurrence: str) -> DataFrame:
    """A row per key: `first` from its first row, `filled` from the first that has a value, and every occurrence in order."""
    gap = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(pos))
    seen = F.transform(F.array_sort(F.collect_list(F.struct(pos, occurrence))), lambda x: x[occurrence])
    return rows.groupBy(key).agg(*(F.min_by(c, pos).alias(c) for c in first), *(F.min_by(c, gap(c)).alias(c) for c in filled), seen.alias("occurrences"))


def sort_columns(sort: str = "", direction: str = "") -> list[Column]:
    """Columns of a tiered sort such as `year,title` with `desc,asc`; a missing direction is the key's own, an unknown key counts citations."""
    keys, dirs, out = [k for k in sort.split(",") if k] or ["lib_cites"], direction.split(","), []
    for i, k in enumerate(keys):
        k, given = k if k in SORTS else "lib_cites", dirs[i] if i < len(dirs) else ""
        up = given != "desc" if given else k == "title"
        for c in SORTS[k]:
            value = F.lower(text_or_empty(F.col(c))) if c == "title" else text_or_empty(F.col(c)) if c == "created_at" else F.coalesce(F.col(c), F.lit(0))
            out.append(value.asc() if up else value.desc())
    return out


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[int, DataFrame]:
    """How many rows there are, and one page of them in order."""
    return rows.count(), rows.orderBy(*order).offset(offset).limit(limit)


def capped(rows: DataFrame, order: list[Column], most: int) -> tuple[int, DataFrame]:
    """How many rows there are, and the first `most` in order."""
    return page(rows, order, 0, most)


def list_order(by: str) -> list[Column]:
    """Order of a re-stacked list of (pos, key, year, cites, title, added_at, tags): by is year, year_asc, cites, title, added or tags."""
    pos = F.col("pos").asc()
    signature = F.array_join(F.array_sort(F.transform("tags", F.lower)), "|")
    return {
        "year": [F.coalesce("year", F.lit(0)).desc(), pos],
        "year_asc": [F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)).asc(), pos],
        "cites": [F.coalesce("cites", F.lit(0)).desc(), pos],
        "title": [F.lower(F.coalesce(F.nullif("title", F.lit("")), F.col("key").cast("string"))).asc(), pos],
        "added": [text_or_empty(F.col("added_at")).asc(), pos],
        "tags": [(F.size("tags") <= 0).asc(), F.min("pos").over(W.partitionBy("list", signature)).asc(), pos],
    }[by]


def blanks_last(value: Column, down: bool) -> list[Column]:
    """Order in which blanks sink whatever the direction."""
    blank = value.isNull() | (F.trim(value.cast("string")) == "")
    return [blank.asc(), value.desc() if down else value.asc()]


def retag_three_way(base: Column, mine: Column, theirs: Column) -> Column:
    """Tags of a merge: theirs without what I dropped, and what I added, in lower case."""
    b, m, t = (F.transform(x, F.lower) for x in (base, mine, theirs))
    return F.array_union(F.array_except(t, F.array_except(b, m)), F.array_except(m, b))


def snippets(hits: Column, most: int) -> Column:
    """Spans (start, end), in order, that overlap none chosen before, the first `most`."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(F.array_sort(hits), empty, lambda a, h: F.when((F.size(a) < most) & ((F.size(a) == 0) | (h["start"] >= F.get(a, F.size(a) - 1)["end"])), F.concat(a, F.array(h))).otherwise(a))
