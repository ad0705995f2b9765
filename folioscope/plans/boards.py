"""Queries of curated lists: a brand's parts by key."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.operators import lists as M
from folioscope.plans.catalog import _LIST, lists, query


@query(f"SELECT list, key, CAST(row_number() OVER (PARTITION BY list ORDER BY side, pos) AS INTEGER) AS pos FROM (SELECT list, key, pos, 0 AS side FROM ({_LIST}) WHERE size % 3 > 0 UNION ALL SELECT list, key, key, 1 FROM ({_LIST}) WHERE size % 3 = 0 AND size % 2 = 0)")
def m8_add(t):
    items = M.renumber(lists(t).where("size % 3 > 0"))
    return M.append(items, lists(t).where("size % 2 = 0").withColumn("pos", F.col("key"))).select("list", "key", "pos")


@query(f"SELECT list, key, CASE WHEN size % 4 = 0 THEN 'new' ELSE type END AS type, name FROM ({_LIST})")
def m9_update(t):
    items = lists(t)
    edits = items.where("size % 4 = 0").select("list", "key", F.lit("new").alias("type"), F.lit(None).cast("string").alias("name"))
    return M.update(items, edits, ["type", "name"]).select("list", "key", "type", "name")


def tagged(t):
    return lists(t).withColumn("tags", F.split("name", " "))


@query(f"SELECT key, CASE WHEN split_part(name, ' ', 1) = 'small' THEN CASE WHEN split_part(name, ' ', 2) = 'ring' THEN 'Ring' ELSE 'Ring;' || split_part(name, ' ', 2) END ELSE replace(name, ' ', ';') END AS tags FROM ({_LIST})")
def m10_rename_tag(t):
    return tagged(t).select("key", F.array_join(M.rename_tag(F.col("tags"), "SMALL", "Ring"), ";").alias("tags"))


@query(f"SELECT list, tag AS name, CAST(row_number() OVER (PARTITION BY list ORDER BY min(pos * 10 + i)) AS INTEGER) AS place, count(*) AS n, CASE tag WHEN 'red' THEN '#f00' END AS colour FROM (SELECT list, pos, 0 AS i, split_part(name, ' ', 1) AS tag FROM ({_LIST}) UNION ALL SELECT list, pos, 1, split_part(name, ' ', 2) FROM ({_LIST})) GROUP BY list, tag")
def m11_vocabulary(t):
    rows = tagged(t)
    return M.vocabulary(rows, rows.select("list", F.lit("RED").alias("name"), F.lit("#f00").alias("colour")).distinct())


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'b=1;c=2' ELSE 'b=3' END AS cells FROM part")
def m12_columns(t):
    fields = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("2"), F.lit("x"), F.lit("9"))).otherwise(F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("3")))
    done = M.drop_field(M.rename_field(fields, "a", "b"), "x")
    text = F.array_join(F.transform(F.array_sort(F.map_entries(done)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return t("part").select("p_partkey", text.alias("cells"))


@query(f"SELECT list, key, CAST(row_number() OVER (PARTITION BY list ORDER BY size % 5 = 0, pos) AS INTEGER) AS pos FROM ({_LIST}) WHERE size % 2 > 0 OR size % 5 = 0")
def m13_import_moves(t):
    items = lists(t)
    return M.landed(M.renumber(items.where("size % 2 > 0")), items.where("size % 5 = 0"), "move").select("list", "key", "pos")


@query(f"SELECT list, loc, key, CAST(row_number() OVER (PARTITION BY list, loc ORDER BY pos) AS INTEGER) AS pos FROM (SELECT list, CASE WHEN size % 2 = 0 THEN 'items' ELSE 'staging' END AS loc, key, pos FROM ({_LIST})) QUALIFY row_number() OVER (PARTITION BY list, loc ORDER BY pos) <= 20")
def m14_normalized(t):
    items = lists(t)
    every = items.where("size % 2 = 0").withColumn("loc", F.lit("items")).unionByName(items.withColumn("loc", F.lit("staging"))).unionByName(items.withColumn("loc", F.lit("staging")).withColumn("pos", F.col("pos") + 1000))
    return M.known_first(every, most=20).select("list", "loc", "key", "pos")


@query(f"SELECT list, key, total, count(*) OVER (PARTITION BY list) AS shown FROM (SELECT *, count(*) OVER (PARTITION BY list) AS total FROM ({_LIST})) WHERE size > 30")
def m15_view(t):
    return M.view(lists(t), F.col("size") > 30).select("list", "key", "total", "shown")


@query(f"SELECT list, key, CAST(pos AS INTEGER) AS pos FROM ({_LIST}) UNION ALL SELECT 'copy', key, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) FROM ({_LIST}) WHERE list = 'Brand#7' AND size > 10")
def m16_subset(t):
    return M.copied(lists(t), "Brand#7", "copy", F.col("size") > 10).select("list", "key", "pos")


@query(f"SELECT list, key, CASE WHEN key % 3 = 0 THEN 'edited' ELSE type END AS type, name FROM ({_LIST})")
def m17_mirrored(t):
    items = lists(t)
    before = items.select("key", "type", "name")
    after = before.withColumn("type", F.when(F.col("key") % 3 == 0, "edited").otherwise(F.col("type")))
    return M.mirrored(items, before, after, ["type", "name"]).select("list", "key", "type", "name")


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'staging' ELSE 'items' END AS loc, CASE WHEN p_partkey % 3 = 0 THEN 'mine' WHEN p_partkey % 2 = 0 THEN 'theirs' ELSE p_type END AS type FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0")
def m18_merged_rows(t):
    base = t("part").select(F.col("p_partkey").alias("key"), F.lit("items").alias("loc"), F.col("p_type").alias("type"))
    mine = base.where("key % 7 > 0").withColumn("type", F.when(F.col("key") % 3 == 0, "mine").otherwise(F.col("type")))
    theirs = base.where("key % 11 > 0").withColumn("type", F.when(F.col("key") % 2 == 0, "theirs").otherwise(F.col("type"))).withColumn("loc", F.when(F.col("key") % 5 == 0, "staging").otherwise(F.col("loc")))
    return M.merged_rows(base, mine, theirs, ["type"])


@query(f"SELECT list, key, CAST(row_number() OVER (PARTITION BY list ORDER BY -pos) AS INTEGER) AS pos FROM ({_LIST}) WHERE key % 4 > 0")
def e10_merged_order(t):
    base = lists(t).select("list", "key", "pos")
    mine = base.withColumn("pos", F.row_number().over(W.partitionBy("list").orderBy(F.desc("pos"))))
    return M.merged_order(base, mine, base, base.where("key % 4 > 0"))


@query(f"WITH h AS (SELECT list, key, size % 3 + 1 AS rev FROM ({_LIST})), m AS (SELECT list, max(rev) + 1 AS new FROM h GROUP BY 1), e AS (SELECT list, key, rev FROM h UNION ALL SELECT list, key, new FROM ({_LIST}) JOIN m USING (list)) SELECT list, rev, count(*) AS n FROM e JOIN m USING (list) WHERE rev > new - 2 GROUP BY 1, 2")
def m19_history(t):
    rows = lists(t).select("list", "key")
    history = lists(t).select("list", "key", (F.col("size") % 3 + 1).alias("rev"))
    return M.kept_versions(history, rows, 2).groupBy("list", "rev").agg(F.count("*").alias("n"))


@query(f"SELECT list, list <> 'Brand#7' AS ok FROM (SELECT DISTINCT list FROM ({_LIST}))")
def m20_revisions(t):
    now = lists(t).select("list", F.lit(3).alias("rev"))
    asked = now.select("list").distinct().withColumn("if_rev", F.when(F.col("list") == "Brand#7", 2).when(F.col("list") == "Brand#1", None).otherwise(3))
    return M.accepted(now, asked)
