"""Queries over the driver's tables. The library is the parts of size 1 or 2; a lineitem is a citation of its part by its order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.functions import predicates as P
from folioscope.functions import similarity as Z
from folioscope.functions import text as X
from folioscope.operators import lists as M
from folioscope.operators import relational as R
from folioscope.operators import state as S
from folioscope.operators import views as V
from folioscope.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The module that each query is written in.
MODULE: dict[str, str] = {}

#: Letters folded as functions.text folds them, for the SQL.
_FOLD = "replace(replace(replace(replace(lower(strip_accents(coalesce({0}, ''))), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')"


def norm(c: str) -> str:
    return "trim(regexp_replace(" + _FOLD.format(c) + ", '[^a-z0-9]+', ' ', 'g'))"


TITLE = "concat_ws(' ', p_name, p_brand, p_type)"
DOI = "concat(CASE p_partkey % 5 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN 'doi: ' ELSE '' END, '10.', 1000 + p_size, '/p.', p_partkey, CASE p_partkey % 5 WHEN 2 THEN '/full' WHEN 3 THEN '/figures/3' WHEN 4 THEN '.;' ELSE '' END)"


def query(sql: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        SQL[f.__name__], MODULE[f.__name__] = sql, f.__module__.rpartition(".")[2]
        return f

    return add


def library(t):
    return t("part").where("p_size <= 2")


def works(t):
    return t("part").select("p_partkey", "p_name", "p_size", "p_retailprice", F.expr(TITLE).alias("title"), F.expr(DOI).alias("doi"))


# scans


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (3, 5, 77, 150)")
def a1_scoped_scan(t):
    return t("documents").where(F.col("doc_id").isin(3, 5, 77, 150)).select("doc_id", "lang", "n_chars")


@query(f"SELECT DISTINCT {norm('p_name')} AS title FROM part WHERE p_size <= 2")
def a6_identity_scan(t):
    return library(t).select(X.normalize_title(F.col("p_name")).alias("title")).distinct()


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 40")
def a7_recent(t):
    return t("events").where("ts >= timestamp_ntz '2024-01-10' and event_type <> 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def a8_last_write_wins(t):
    return R.latest(t("events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# filters


@query("SELECT l_orderkey, array_to_string(list_distinct_ordered, ';') AS suppliers FROM (SELECT l_orderkey, list(CAST(s AS VARCHAR) ORDER BY n, s) AS list_distinct_ordered FROM (SELECT l_orderkey, l_suppkey AS s, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1)")
def b1_first_seen_authors(t):
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(pairs, lambda p: p["l_suppkey"].cast("string"))), ";").alias("suppliers"))


@query("SELECT p_partkey FROM part WHERE list_has_all(string_split(lower(p_type), ' '), ['steel', 'large']) OR NOT list_has_any(string_split(lower(p_type), ' '), ['brass', 'tin', 'copper', 'nickel', 'steel'])")
def b6_tags(t):
    tags = F.split("p_type", " ")
    return t("part").where(X.tags_match(tags, ["Steel", "LARGE"], "all") | X.tags_match(tags, ["brass", "tin", "copper", "nickel", "steel"], "none")).select("p_partkey")


@query(f"SELECT doc_id FROM documents WHERE contains(lower(text), 'the on') OR contains(replace({norm('text')}, ' ', ''), 'ofthe')")
def b7_text_filter(t):
    return t("documents").where(F.contains(F.lower("text"), F.lit("the on")) | F.contains(X.fold_text(F.col("text")), F.lit("ofthe"))).select("doc_id")


@query("SELECT p_partkey FROM part WHERE (p_partkey BETWEEN 1 AND 40 OR p_partkey = 55 OR p_partkey BETWEEN 90 AND 120) AND p_size BETWEEN 3 AND 30")
def b8_pick_rows(t):
    return t("part").where(P.in_ranges(F.col("p_partkey"), P.parse_range("1-40, 55, 120-90")) & F.col("p_size").between(3, 30)).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)', 1), lambda x: CAST(x AS DOUBLE) NOT BETWEEN 0.0 AND 500.0)) = 0")
def b12_plausible(t):
    return t("documents").where(X.plausible(F.col("text"), 0.0, 500.0)).select("doc_id")


# joins


@query("SELECT l_partkey, count(*) AS lib_cites FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 2) GROUP BY 1")
def c1_external_tally(t):
    return R.tally(R.external(t("lineitem"), library(t), "l_partkey", "p_partkey"), "l_partkey")


@query("SELECT p_partkey, p_name, lib_cites FROM (SELECT l_partkey, count(*) AS lib_cites FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey")
def c2_tally_with_metadata(t):
    return R.tally(t("lineitem"), "l_partkey").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_name", "lib_cites")


@query(f"WITH w AS (SELECT p_partkey, p_size, {norm('p_name')} AS title, p_brand AS brand FROM part), k AS (SELECT * FROM w WHERE p_size <= 2) SELECT p_partkey FROM w WHERE p_size > 2 AND title NOT IN (SELECT title FROM k) AND brand || p_size NOT IN (SELECT brand || 3 FROM k)")
def c3_exact_anti(t):
    rows = t("part").select("p_partkey", "p_size", X.normalize_title(F.col("p_name")).alias("title"), F.concat("p_brand", F.col("p_size").cast("string")).alias("other"), F.concat("p_brand", F.lit("3")).alias("three"))
    known = rows.where("p_size <= 2").select("title", F.col("three").alias("other"))
    return R.not_known(rows.where("p_size > 2"), known, ["title", "other"]).select("p_partkey")


@query(f"SELECT {norm(TITLE)} AS title, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(*) = 1")
def c9_unique_titles(t):
    return R.unique_lookup(works(t).select(X.normalize_title(F.col("title")).alias("title"), "p_partkey"), "title", "p_partkey")


@query("SELECT s_suppkey, s_name, coalesce(n, 0) AS lines, coalesce(big, 0) AS big_orders, n_name FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey AS k, count(DISTINCT l_orderkey) AS big FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON k = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey")
def c10_surface_join(t):
    lines = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("l_quantity") > 40, F.col("l_orderkey"))).alias("big"))
    rows = t("supplier").join(lines, "s_suppkey", "left").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce("big", F.lit(0)).alias("big_orders"), "n_name")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(a.v, ''), b.v) AS v, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))), ';') AS s FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS v, string_split(p_type, ' ') AS s FROM part WHERE p_partkey % 2 = 0) a FULL OUTER JOIN (SELECT p_partkey AS k, p_name AS v, [p_brand] AS s FROM part WHERE p_partkey % 5 < 3) b ON a.k = b.k")
def c14_full_outer_merge(t):
    p = t("part")
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS v"), F.split("p_type", " ").alias("s"))
    b = p.where("p_partkey % 5 < 3").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"), F.array("p_brand").alias("s"))
    return R.merge_rows(a, b, "k", ["v"], ["s"]).withColumn("s", F.array_join("s", ";"))


@query("SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND least(a.l_quantity + 20, b.l_quantity + 20) - greatest(a.l_quantity, b.l_quantity) >= 0.8 * 20")
def c19_overlapping_boxes(t):
    a = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("x"))
    b = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("y"))
    overlap = F.least(F.col("x") + 20, F.col("y") + 20) - F.greatest("x", "y")
    return a.join(b, "l_orderkey").where((F.col("a") < F.col("b")) & (overlap >= 16)).select("l_orderkey", "a", "b")


# aggregations


@query("WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT l_suppkey, count(*) AS papers, CAST(sum(n) AS BIGINT) AS cites, min(s_name) AS name FROM a JOIN c USING (l_partkey) JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 ORDER BY cites DESC, papers DESC, 1 LIMIT 25")
def d3_author_rollup(t):
    authors = t("lineitem").select("l_partkey", "l_suppkey").distinct().join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return R.author_rollup(authors, R.tally(t("lineitem"), "l_partkey", "n"), "l_partkey", "l_suppkey", "s_name", "n").orderBy(F.desc("cites"), F.desc("papers"), "l_suppkey").limit(25)


@query("SELECT l_linestatus AS stage, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS done, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'A') / count(*), 1) AS pct FROM lineitem GROUP BY 1")
def d5_status_tally(t):
    done = F.count_if(F.col("l_returnflag") == "A")
    return t("lineitem").groupBy(F.col("l_linestatus").alias("stage")).agg(F.count("*").alias("n"), done.alias("done"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.round(done * 100.0 / F.count("*"), 1).alias("pct"))


@query("SELECT user_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS kinds, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY 1")
def d6_grouped_errors(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ";").alias("kinds"), F.max("event_id").alias("last"))


@query("SELECT lang, count(*) FILTER (WHERE source = 'src0') AS src0, count(*) FILTER (WHERE source = 'src1') AS src1, count(*) FILTER (WHERE source = 'src2') AS src2 FROM documents GROUP BY 1")
def d11_pivot(t):
    return t("documents").groupBy("lang").pivot("source", ["src0", "src1", "src2"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT l_suppkey, l_quantity, count(DISTINCT l_orderkey) AS n, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY count(DISTINCT l_orderkey) DESC, l_quantity) AS INTEGER) AS rank FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 2 QUALIFY rank <= 3")
def d12_consensus(t):
    return R.consensus(t("lineitem"), ["l_suppkey"], "l_quantity", "l_orderkey", 2, 3)


@query("SELECT lower(w) AS word, count(*) AS n, min(w) AS spelling FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
def d16_tag_counts(t):
    return t("part").select(F.explode(F.split("p_type", " ")).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.min("w").alias("spelling"))


# windows


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part")
def e1_ranked(t):
    return R.ranked(t("part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_partkey", "n")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS anchor FROM events")
def e3_carry_forward(t):
    return t("events").select("event_id", R.carry_forward(F.when(F.col("event_type") == "purchase", F.col("event_id")), ["user_id"], ["ts", "event_id"]).alias("anchor"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, max(l_quantity) > 15 AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS r FROM lineitem GROUP BY 1, 2),
l AS (SELECT *, coalesce(max(CASE WHEN hit THEN r END) OVER (PARTITION BY l_orderkey ORDER BY r ROWS UNBOUNDED PRECEDING), 0) AS last FROM r),
b AS (SELECT *, max(CASE WHEN r - last > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY r ROWS UNBOUNDED PRECEDING) AS broken FROM l)
SELECT l_orderkey, min(l_linenumber) AS start, count(*) AS hits FROM b WHERE hit AND broken = 0 GROUP BY 1 HAVING count(*) >= 3""")
def e4_tail_run(t):
    return R.tail_run(t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")), "l_orderkey", "l_linenumber", F.col("l_quantity") > 15, 1, 3)


@query("SELECT l_orderkey, l_quantity, reach FROM (SELECT l_orderkey, l_quantity, max(l_quantity + 5) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_quantity + 5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lineitem) WHERE l_quantity > reach + 2")
def e5_gaps(t):
    return R.gaps(t("lineitem").select("l_orderkey", "l_quantity", (F.col("l_quantity") + 5).alias("end")), "l_orderkey", "l_quantity", "end", 2.0).select("l_orderkey", "l_quantity", "reach")


@query("SELECT l_orderkey, bool_and(coalesce(d > 0, true)) AS rising FROM (SELECT l_orderkey, q - lag(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) GROUP BY 1")
def e7_monotone(t):
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    d = F.col("q") - F.lag("q").over(W.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return lines.select("l_orderkey", d.alias("d")).groupBy("l_orderkey").agg(F.every(F.coalesce(F.col("d") > 0, F.lit(True))).alias("rising"))


@query("SELECT conv_id, turn, role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role) AS next_turn FROM conversations")
def e9_next_row(t):
    return t("conversations").select("conv_id", "turn", "role", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn", "role")).alias("next_turn"))


# sorting


@query("SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, lower(p_name), p_partkey LIMIT 50 OFFSET 100")
def f1_tiered_page(t):
    return t("part").orderBy(F.desc("p_size"), F.desc("p_retailprice"), F.lower("p_name"), "p_partkey").offset(100).limit(50).select("p_partkey")


@query("SELECT l_partkey, count(*) AS cites FROM lineitem GROUP BY 1 ORDER BY cites DESC, 1 LIMIT 1000")
def f3_top_cited(t):
    return R.tally(t("lineitem"), "l_partkey", "cites").orderBy(F.desc("cites"), "l_partkey").limit(1000)


# sets


@query("SELECT wid, max(pool) AS pool, CAST(sum(n) AS BIGINT) AS lib_cites, count(*) > 1 AS in_both FROM (SELECT l_partkey AS wid, 'cited_by' AS pool, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1 UNION ALL SELECT l_partkey, 'references', count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) GROUP BY 1")
def g1_pool_merge(t):
    pool = lambda flag: R.tally(t("lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("wid")), "wid", "lib_cites")
    merged = V.pool_merge([("references", pool("R")), ("cited_by", pool("N"))], "wid", "lib_cites", [])
    return merged.select("wid", F.get("pools", F.lit(0)).alias("pool"), "lib_cites", (F.size("pools") > 1).alias("in_both"))


@query("WITH b AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 6), m AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 NOT IN (1, 5)), o AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 NOT IN (2, 5)) SELECT c_custkey FROM customer WHERE (c_custkey IN (FROM b) AND c_custkey IN (FROM m) AND c_custkey IN (FROM o)) OR (c_custkey NOT IN (FROM b) AND (c_custkey IN (FROM m) OR c_custkey IN (FROM o)))")
def g6_three_way(t):
    c = t("customer").select("c_custkey")
    return R.three_way(c.where("c_custkey % 7 <> 6"), c.where("c_custkey % 7 not in (1, 5)"), c.where("c_custkey % 7 not in (2, 5)"), "c_custkey")


# functions


@query("SELECT p_partkey, concat('10.', 1000 + p_size, '/p.', p_partkey) AS doi FROM part")
def h1_normalize_doi(t):
    return works(t).select("p_partkey", X.normalize_doi(F.col("doi")).alias("doi"))


@query(f"SELECT doc_id, md5({norm('text')}) AS folded, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS plain FROM documents")
def h2_folds(t):
    return t("documents").select("doc_id", F.md5(X.normalize_text(F.col("text")).cast("binary")).alias("folded"), F.md5(X.normalize_plain(F.col("text")).cast("binary")).alias("plain"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '^www\\.', ''), '/+$', '') AS k FROM pages")
def h6_link_key(t):
    return t("pages").select("page_id", X.link_key(F.col("url")).alias("k"))


@query("SELECT p_partkey, substring(regexp_replace(regexp_replace(lower(" + TITLE + "), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24) AS slug FROM part")
def h10_slug(t):
    return works(t).select("p_partkey", X.slug(F.col("title"), 24).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE concat(substring(text, 1, 120), ' ... ', right(text, 80)) END AS clipped FROM documents")
def h13_clip(t):
    return t("documents").select("doc_id", X.clip_middle(F.col("text"), 200).alias("clipped"))


@query("SELECT doc_id, CAST(nullif(regexp_extract(text, '((?:19|20)[0-9]{2})', 1), '') AS INTEGER) AS year FROM documents")
def h24_year(t):
    return t("documents").select("doc_id", X.year_in(F.col("text")).alias("year"))


# retrieval


@query(f"SELECT doc_id FROM documents WHERE (contains({norm('text')}, 'the') AND NOT contains({norm('text')}, 'of the')) OR contains({norm('text')}, 'der die')")
def i2_boolean_search(t):
    return t("documents").where(P.once(X.normalize_text(F.col("text")), lambda hay: P.matches(hay, P.parse_query('the -"of the" OR "der die"')))).select("doc_id")


@query(f"WITH d AS (SELECT doc_id, substring({norm('text')}, 1, 60) AS title, {norm('text')} AS hay FROM documents) SELECT doc_id, CASE WHEN title = 'of the' THEN 400 WHEN contains(title, 'of the') THEN 300 ELSE 0 END + CASE WHEN contains(substring(hay, 1, 1200), 'of the') THEN 90 WHEN contains(hay, 'of the') THEN 60 ELSE 0 END + CASE WHEN contains(title, 'of') THEN 45 ELSE 0 END + CASE WHEN contains(title, 'the') THEN 45 ELSE 0 END + CASE WHEN contains(substring(hay, 1, 1200), 'of') THEN 12 ELSE 0 END + CASE WHEN contains(substring(hay, 1, 1200), 'the') THEN 12 ELSE 0 END + CASE WHEN contains(title, 'of') AND contains(title, 'the') THEN 200 ELSE 0 END AS rel FROM d")
def i4_relevance(t):
    rel = P.once(X.normalize_text(F.col("text")), lambda hay: P.relevance(F.substring(hay, 1, 60), hay, P.parse_query("of the"), "of the"))
    return t("documents").select("doc_id", rel.alias("rel"))


@query("SELECT doc_id FROM documents WHERE (CAST(contains(lower(text), 'und') AS INTEGER) + CAST(contains(lower(text), 'die') AS INTEGER) + CAST(contains(lower(text), 'the') AS INTEGER)) >= 2 AND NOT contains(lower(text), 'xyz')")
def i9_predicates(t):
    hay = F.lower("text")
    return t("documents").where(P.at_least(2, *(P.any_of(hay, w) for w in ("und", "die", "the"))) & P.none_of(hay, "xyz")).select("doc_id")


@query("SELECT page_id, count(*) AS links, count(DISTINCT h) AS distinct_links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS h FROM pages) GROUP BY 1")
def j1_links(t):
    found = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("h"))
    return found.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("h").alias("distinct_links"))


@query("SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(*) >= 3")
def l7_repeated_lines(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 3")


# graph and state


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey + 1000000, l_partkey FROM lineitem),
l1 AS (SELECT dst AS id, count(*) AS in_links FROM e WHERE src IN (1, 2) GROUP BY 1),
l2 AS (SELECT dst AS id, count(*) AS in_links FROM e WHERE src IN (SELECT id FROM l1) AND dst NOT IN (1, 2) AND dst NOT IN (SELECT id FROM l1) GROUP BY 1)
SELECT CAST(id AS BIGINT) AS id, 0 AS hops, CAST(0 AS BIGINT) AS in_links FROM (VALUES (1), (2)) v(id) UNION ALL SELECT id, 1, in_links FROM l1 UNION ALL SELECT id, 2, in_links FROM l2""")
def n1_crawl(t):
    lines = t("lineitem")
    e = lines.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"))
    # with more than a million parts a link back may be another's link
    return R.crawl(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), lines.sparkSession.range(1, 3), 2)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def o5_upsert(t):
    c = t("customer").select("c_custkey", "c_mktsegment")
    return R.upsert(c, c.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("new")), "c_custkey")


# quality


@query("SELECT doc_id, round(1 - count(DISTINCT s) / count(*), 6) AS rate FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS s FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), ' ') AS w FROM documents) WHERE len(w) >= 6) GROUP BY 1")
def r2_repeated_shingles(t):
    w = t("documents").select("doc_id", F.split(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), " ").alias("w")).where("size(w) >= 6")
    s = w.select("doc_id", F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.struct(F.xxhash64(F.slice("w", i, 6)).alias("a"), F.xxhash64(F.lit(1), F.slice("w", i, 6)).alias("b"))).alias("s"))
    return s.select("doc_id", F.round(1 - F.size(F.array_distinct("s")) / F.size("s"), 6).alias("rate"))


# lookups by precedence


@query(f"WITH k AS (SELECT {norm('p_name')} AS title, p_brand || p_size AS doi FROM part WHERE p_size <= 2), a AS (SELECT p_partkey, {norm('p_name')} AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand || least(p_size, 5) END AS doi FROM part) SELECT p_partkey, CASE WHEN doi IS NOT NULL THEN doi IN (SELECT doi FROM k) ELSE title IN (SELECT title FROM k) END AS known FROM a")
def c5_exists(t):
    rows = t("part").select("p_partkey", "p_size", X.normalize_title(F.col("p_name")).alias("title"), F.concat("p_brand", F.col("p_size").cast("string")).alias("own"), F.concat("p_brand", F.least("p_size", F.lit(5)).cast("string")).alias("near"))
    asked = rows.select("p_partkey", "title", F.when(F.col("p_partkey") % 3 == 0, F.col("near")).alias("doi"))
    return S.exists_exact(asked, rows.where("p_size <= 2").select("title", F.col("own").alias("doi")), "p_partkey")


@query("WITH a AS (SELECT doc_id, doc_id % 150 AS k, lang FROM documents), hits AS (SELECT doc_id, page_id AS target, 'page' AS how, 0 AS place FROM a JOIN pages ON page_id = k UNION ALL SELECT doc_id, target, 'lang', 1 FROM a JOIN (SELECT lang, min(doc_id) AS target FROM documents GROUP BY 1) USING (lang)) SELECT doc_id, target, how FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, target) = 1")
def c8_resolve(t):
    asked = t("documents").select("doc_id", (F.col("doc_id") % 150).alias("k"), "lang")
    langs = t("documents").groupBy(F.col("lang").alias("term")).agg(F.min("doc_id").alias("target"))
    return S.resolve(asked, [("page", "k", t("pages").select(F.col("page_id").alias("term"), F.col("page_id").alias("target"))), ("lang", "lang", langs)], "doc_id")


# curated lists: a brand's parts by key

_LIST = "SELECT p_brand AS list, p_partkey AS key, p_size AS size, p_type AS type, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part"


def lists(t):
    rows = t("part").select(F.col("p_brand").alias("list"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    return M.renumber(rows, "key")


@query(f"SELECT list, key, CAST(row_number() OVER (PARTITION BY list ORDER BY pos) AS INTEGER) AS pos FROM ({_LIST}) WHERE size % 3 <> 0")
def m1_remove(t):
    items = lists(t)
    return M.remove(items, items.where("size % 3 = 0")).select("list", "key", "pos")


@query(f"SELECT list, key, CAST(row_number() OVER (PARTITION BY list ORDER BY CASE WHEN size > 30 THEN coalesce(a + 0.5, 1e18) ELSE pos END, pos) AS INTEGER) AS pos FROM (SELECT *, min(CASE WHEN size < 10 THEN pos END) OVER (PARTITION BY list) AS a FROM ({_LIST}))")
def m2_move_after(t):
    return M.move(lists(t), F.col("size") > 30, M.after(F.col("size") < 10)).select("list", "key", "pos")


@query(f"SELECT list, key, CAST(row_number() OVER (PARTITION BY list ORDER BY size > 45 DESC, pos) AS INTEGER) AS pos FROM ({_LIST})")
def m3_move_top(t):
    return M.move(lists(t), F.col("size") > 45, M.TOP).select("list", "key", "pos")


@query(f"SELECT list, key, CAST(row_number() OVER (PARTITION BY list ORDER BY lower(name), size DESC, key) AS INTEGER) AS pos FROM ({_LIST})")
def m4_sort(t):
    return M.renumber(lists(t), F.lower("name"), F.desc("size"), "key").select("list", "key", "pos")


@query(f"SELECT key, CASE WHEN size > 20 THEN type || '; big' ELSE type END AS type, CASE WHEN size % 2 = 0 THEN name ELSE 'odd' END AS name FROM ({_LIST})")
def m5_set_cell(t):
    items = lists(t).withColumn("name", F.when(F.col("size") % 2 == 0, F.col("name")).otherwise(F.lit("")))
    items = M.set_cell(M.set_cell(items, "type", F.col("size") > 20, F.lit("big"), "append"), "name", F.lit(True), F.lit("odd"), "fill")
    return items.select("key", "type", "name")


@query(f"SELECT key, array_to_string(list_concat(list_filter(string_split(type, ' '), lambda x: lower(x) NOT IN ('steel', 'large')), ['New']), ';') AS tags FROM ({_LIST})")
def m6_retag(t):
    return lists(t).select("key", F.array_join(M.retag(F.split("type", " "), ["New", "new"], ["STEEL", "large"]), ";").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE CASE WHEN p_partkey % 3 = 0 THEN p_type END END AS name FROM part")
def m7_fill_empty(t):
    rows = t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.lit("")).alias("name"))
    return M.fill_empty(rows, t("part").where("p_partkey % 3 = 0").select("p_partkey", F.col("p_type").alias("name")), "p_partkey", ["name"])


# state between runs


@query("SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def o6_prune(t):
    stored = t("orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return S.prune(stored, t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("SELECT user_id, event_type, min(event_id) AS first_seen, max(event_id) AS last_seen FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 50 = 0) GROUP BY 1, 2")
def o7_problem_log(t):
    e, key = t("events"), ["user_id", "event_type"]
    stored = e.where("event_id % 2 = 0").groupBy(*key).agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"))
    return S.problem_log(stored, e.where("event_id % 2 = 1").withColumnRenamed("event_id", "at"), e.where("event_id % 50 = 0"), key)


@query("SELECT o_orderkey FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_orderstatus = 'O')")
def o4_pending(t):
    orders = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("sig"))
    stamps = orders.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.lit("O")).otherwise(F.lit("old")).alias("sig"), F.lit(2).alias("version"))
    return S.pending(orders, stamps, "o_orderkey", 2).select("o_orderkey")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def o12_sessions(t):
    return changes.sessions(t("events"), "user_id", "ts", "12 hours")


# proximity, merges and blocks


@query("WITH a AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), b AS (SELECT DISTINCT user_id, s FROM a WHERE event_type = 'click') SELECT event_id, min(abs(a.s - b.s)) AS distance FROM a JOIN b USING (user_id) WHERE event_type = 'purchase' AND abs(a.s - b.s) <= 36000 GROUP BY 1")
def c16_nearest_within(t):
    e = t("events").select("event_id", "user_id", "event_type", F.expr("cast(floor(cast(cast(ts as timestamp) as double)) as bigint) as s"))
    return R.nearest(e.where("event_type = 'purchase'").select("event_id", "user_id", "s"), e.where("event_type = 'click'"), "user_id", "s", 36000).select("event_id", "distance")


@query(f"WITH w AS (SELECT p_partkey, p_size, {TITLE} AS title FROM part), k AS (SELECT DISTINCT substring(title, 1, 30) AS t FROM w WHERE p_size <= 25) SELECT p_partkey FROM w WHERE length(title) > 25 AND EXISTS (SELECT 1 FROM k WHERE length(t) > 25 AND substring(t, 1, 26) = substring(title, 1, 26) AND (starts_with(title, t) OR starts_with(t, title)))")
def c21_same_start(t):
    known = works(t).where("p_size <= 25").select(F.substring("title", 1, 30).alias("title"))
    return R.same_start(works(t), known, "title").select("p_partkey")


@query("SELECT user_id, lower(v) AS folded, count(*) AS n, arg_min(v, event_id) AS spelling FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS v FROM events) GROUP BY 1, 2")
def d13_value_counts(t):
    rows = t("events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("v"))
    return R.value_counts(rows, ["user_id"], "v", "event_id")


@query("SELECT p_name, count(*) AS n, arg_min(p_brand, p_partkey) FILTER (WHERE p_size > 10) AS brand, arg_min(p_type, p_partkey) AS type FROM part GROUP BY 1")
def d20_first_filled(t):
    rows = t("part").select("p_name", "p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(F.lit("")).alias("brand"), F.col("p_type").alias("type"))
    return R.first_filled(rows, "p_name", "p_partkey", ["brand", "type"])


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM conversations")
def e6_blocks(t):
    return t("conversations").select("conv_id", "turn", R.blocks(F.col("role") == "user", ["conv_id"], ["turn", "role", "text"]).alias("block"))


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v")
def g2_changes(t):
    p = t("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    later = p.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.lit(1)).otherwise(F.col("v")))
    return R.changes(p.where("k % 7 <> 0"), later, "k")


@query("SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') AS words FROM conversations")
def h25_inverted_index(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return t("conversations").select("conv_id", "turn", X.words_from_positions(X.positions_of_words(words)).alias("words"))


_WORDS = "SELECT {0} AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {1}"


@query(f"WITH a AS (SELECT id, w, count(*) AS l FROM ({_WORDS.format('doc_id', 'documents')}) GROUP BY 1, 2), b AS (SELECT id, w, count(*) AS r FROM ({_WORDS.format('item_id', 'benchmark')}) GROUP BY 1, 2), m AS (SELECT id, sum(least(coalesce(l, 0), coalesce(r, 0))) AS x, sum(l) AS l, sum(r) AS r FROM a FULL JOIN b USING (id, w) GROUP BY 1) SELECT id, round(x / l, 6) AS precision, round(x / r, 6) AS recall FROM m WHERE l > 0 AND r > 0")
def r1_word_overlap(t):
    words = lambda name, key: t(name).select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return R.word_overlap(words("documents", "doc_id"), words("benchmark", "item_id"), "id", "w")


# extraction and screening


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'ds' || lpad(CAST(page_id AS VARCHAR), 6, '0') END AS accessions FROM pages")
def j3_accessions(t):
    own = F.concat(F.lit("DS"), F.lpad(F.col("page_id").cast("string"), 6, "0"))
    text = F.concat_ws(" ", F.lit("data at"), own, F.lit("and again"), own, F.lit("not ds12"))
    urls = F.array("url", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://data.org/"), F.lower(own))).otherwise(F.lit("")))
    return t("pages").select("page_id", F.array_join(X.accessions(text, urls), ";").alias("accessions"))


@query("WITH a AS (SELECT l_suppkey, min(l_returnflag) AS flag FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1), o AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) FILTER (WHERE flag IS NOT NULL) AS n, min(flag) AS flag FROM lineitem LEFT JOIN a USING (l_suppkey) GROUP BY 1) SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN n = 1 THEN flag END AS flag, CASE WHEN o_orderkey % 4 = 0 THEN 'own' WHEN n = 1 THEN 'inferred' WHEN n > 1 THEN 'several' END AS source FROM orders LEFT JOIN o ON k = o_orderkey")
def j8_inferred(t):
    papers = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).otherwise(F.lit("")).alias("flag"))
    uses = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    agreed = t("lineitem").where("l_suppkey % 3 = 0").groupBy("l_suppkey").agg(F.min("l_returnflag").alias("flag"))
    return S.inferred(papers, uses, agreed, "o_orderkey", "flag", "l_suppkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN lower(replace(p_brand, '#', '')) || '/p' || p_partkey END AS repo FROM part")
def j18_repository(t):
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    tail = F.concat(F.lit("/P"), F.col("p_partkey").cast("string"))
    kind = F.col("p_partkey") % 4
    url = F.when(kind == 0, F.concat(F.lit("https://www.github.com/"), brand, tail, F.lit(".git"))).when(kind == 1, F.concat(F.lit("http://github.com/"), brand, tail, F.lit("/tree/main?x=1"))).when(kind == 2, F.concat(F.lit("https://github.com/topics"), tail)).otherwise(F.concat(F.lit("https://github.com/"), brand))
    return t("part").select("p_partkey", X.repository(url, "github.com", ("topics", "orgs")).alias("repo"))


@query("SELECT doc_id, CASE WHEN CAST(quality = 1 AS INTEGER) + CAST(toxic = 0 AS INTEGER) + CAST(n_chars > 500 AS INTEGER) = 2 THEN CASE WHEN quality <> 1 THEN 'quality' WHEN toxic <> 0 THEN 'toxic' ELSE 'length' END END AS miss FROM documents JOIN labels USING (doc_id)")
def k3_near_miss(t):
    tests = {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 0, "length": F.col("n_chars") > 500}
    return t("documents").join(t("labels"), "doc_id").select("doc_id", P.near_miss(tests).alias("miss"))


# queries that SQL can't express; tests/test_similarity.py holds the scores against brute force


def h3_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title's likeness to one title."""
    part, asked = spark.read.parquet(f"{sf_dir}/part.parquet"), F.lit("small brass widget")
    return part.select("p_partkey", Z.ratio("p_name", asked).alias("ratio"), Z.token_sort_ratio("p_name", asked).alias("sorted_ratio"))


ROWS_ONLY: dict[str, Callable[[SparkSession, str], DataFrame]] = {"h3_similarity": h3_similarity}
