"""Queries of retrieval, extraction, screening, layout and state over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import papers as Q
from folioscope.operators import relational as R
from folioscope.operators import screening as K
from folioscope.operators import views as V
from folioscope.plans.catalog import ROWS_ONLY, TITLE, norm, query
from folioscope.plans.tables import boxes, pool
from folioscope.plans.texts import _of


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


# retrieval


@query(f"SELECT p_partkey, {norm(TITLE)} AS hay_t, '10 1000 p' || p_partkey AS hay_k, {norm('p_type')} || ' 10 1000 p' || p_partkey AS hay FROM part")
def i3_prepared_rows(t):
    doi = F.expr("'10.1000/p' || p_partkey")
    return t("part").select("p_partkey", X.normalize_text(F.expr(TITLE)).alias("hay_t"), X.normalize_text(doi).alias("hay_k"), X.normalize_text(F.concat_ws(" ", "p_type", doi)).alias("hay"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY rel DESC, coalesce(lib_cites, 0) DESC, p_size DESC, p_partkey) AS n FROM (SELECT p_partkey, p_size, CASE WHEN contains(p_name, 'red') THEN 300 ELSE 0 END AS rel, lib_cites FROM part LEFT JOIN (SELECT l_partkey, count(*) AS lib_cites FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)")
def i5_default_order(t):
    rows = pool(t).withColumn("rel", F.when(F.contains("title", F.lit("red")), 300).otherwise(0))
    return R.ranked(rows, [*V.sort_columns("relevance"), F.asc("p_partkey")]).select("p_partkey", "n")


@query("SELECT doc_id, 'both' AS predicate FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'ing') UNION ALL SELECT doc_id, 'rare' FROM documents WHERE contains(lower(text), 'xyz') UNION ALL SELECT doc_id, 'null' FROM documents WHERE lang = 'fr'")
def i11_predicates(t):
    from folioscope.functions import predicates as P

    hay = F.lower("text")
    return Q.matched_predicates(t("documents"), "doc_id", {"both": P.all_of(hay, "tion", "ing"), "rare": P.any_of(hay, "xyz"), "null": F.when(F.col("lang") == "fr", F.lit(True))})


@query("SELECT p_partkey, row_number() OVER (ORDER BY d = '', d DESC, p_partkey) AS n FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE (1970 + p_size) || '-01-01' END AS d FROM part WHERE contains(p_name, 'ring'))")
def i12_hits(t):
    rows = t("part").where("contains(p_name, 'ring')").select("p_partkey", F.expr("case when p_size % 4 = 0 then '' else (1970 + p_size) || '-01-01' end").alias("d"))
    return R.ranked(rows, [*V.blanks_last(F.col("d"), True), F.asc("p_partkey")]).select("p_partkey", "n")


@query("SELECT conv_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY turn, b)) AS hay FROM (SELECT conv_id, turn, trim(text) AS b FROM conversations) WHERE b <> '' GROUP BY 1")
def i13_haystack(t):
    rows = t("conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("b")))).alias("x"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("x", lambda x: Q.joined_haystack(x["b"])), "\n\n").cast("binary")).alias("hay"))


_AXES = {"a": "tion", "b": "ing", "c": "he"}
_ZONES = "SELECT doc_id, lower(split_part(text, ' ', 1)) AS title, lower(source || ' motion thing') AS abstract, lower(text) AS body FROM documents"


def _axis(axis: str, cap: int) -> str:
    p = _AXES[axis]
    return f"least({count('title', p)}, 3) * 6.0 + least({count('abstract', p)}, 3) * 3.0 + least({count('body', p)}, {cap}) * 0.4"


def zoned(t) -> DataFrame:
    rows = t("documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("title"), F.concat("source", F.lit(" motion thing")).alias("abstract"), F.col("text").alias("body"))
    near = F.regexp_count("body", F.lit("zzz"))
    return Q.zones(rows, ["title", "abstract", "body"], _AXES, {"title": 6.0, "abstract": 3.0, "body": 0.4}, {"a": 6, "b": 4, "c": 10}, near, {("a", "title"): 25.0, ("b", "abstract"): 10.0}, ("c",))


@query(f"SELECT doc_id, CAST(round({_axis('a', 6)}, 2) AS DOUBLE) AS score_a, CAST(round({_axis('c', 10)}, 2) AS DOUBLE) AS score_c, CAST(round({_axis('a', 6)} + {_axis('b', 4)} + CASE WHEN {count('title', 'tion')} > 0 THEN 25 ELSE 0 END + CASE WHEN {count('abstract', 'ing')} > 0 THEN 10 ELSE 0 END + 2.0 * least({count('body', 'zzz')}, 8), 2) AS DOUBLE) AS total FROM ({_ZONES})")
def i14_axis_scores(t):
    return zoned(t).select("doc_id", "score_a", "score_c", "total")


@query(f"SELECT doc_id FROM ({_ZONES}) WHERE {count('body', 'he')} + {count('abstract', 'he')} + {count('title', 'he')} > 0 AND {count('title', 'ing')} + {count('abstract', 'ing')} > 0 AND {_axis('a', 6)} + {_axis('b', 4)} + CASE WHEN {count('title', 'tion')} > 0 THEN 25 ELSE 0 END + 10 + 2.0 * least({count('body', 'zzz')}, 8) >= 26")
def i15_gates(t):
    return Q.gated(zoned(t), ["c"], ["title", "abstract", "body"], ["b"], least=26.0).select("doc_id")


@query("SELECT doc_id, array_to_string(list_filter(['lang', 'source', 'text'], lambda z: regexp_matches(CASE z WHEN 'lang' THEN lang WHEN 'source' THEN source ELSE text END, 'r[ec]1?')), ';') AS zones FROM documents WHERE regexp_matches(lang || source || text, 'r[ec]1?') AND array_to_string(list_filter(['lang', 'source', 'text'], lambda z: regexp_matches(CASE z WHEN 'lang' THEN lang WHEN 'source' THEN source ELSE text END, 'r[ec]1?')), ';') <> ''")
def i16_grep(t):
    hit = F.array_compact(F.array(*(F.when(F.rlike(c, F.lit("r[ec]1?")), c) for c in ("lang", "source", "text"))))
    return t("documents").select("doc_id", F.array_join(hit, ";").alias("zones")).where("zones <> ''")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring brand#1')")
def i17_dashboard(t):
    return t("part").where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("ring brand#1"))).select("p_partkey")


# extraction


@query("SELECT p_partkey, 'https://github.com/u/r' || p_partkey AS first, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS n FROM part")
def j1_found_links(t):
    text = F.expr("'Code: https://github.com/u/r' || p_partkey || '. See (http://www.github.com/u/r' || p_partkey || '/) and github.com, osf.io/ab' || p_size || '; https://x.org/y https://zenodo.org/broken-'")
    more = F.expr("case when p_partkey % 2 = 0 then 'at zenodo.org/record/' || p_partkey else 'GitHub.com/U/R' || p_partkey end")
    blobs = t("part").select("p_partkey", F.lit(0).alias("pos"), text.alias("text")).unionByName(t("part").select("p_partkey", F.lit(1).alias("pos"), more.alias("text")))
    found = Q.found_links(blobs, "p_partkey", "pos", "text")
    return found.groupBy("p_partkey").agg(F.min_by("url", "place").alias("first"), F.count("*").cast("int").alias("n"))


@query("SELECT p_partkey, 'see https://github.com/long-name-' || p_partkey || ' end' AS text FROM part")
def j2_stitch(t):
    return t("part").select("p_partkey", Q.stitch_links(F.expr("'see https://github.com/long-\n  name- \n' || p_partkey || ' end'")).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'fixed' ELSE 'u' || p_partkey END AS url, CASE WHEN p_partkey % 2 = 0 THEN 'u' || p_partkey END AS raw FROM part")
def j4_display_links(t):
    one = F.struct(F.expr("'u' || p_partkey").alias("url"), F.when(F.col("p_partkey") % 2 == 0, "fixed").otherwise("").alias("resolved"))
    return t("part").select("p_partkey", F.explode(Q.display_links(F.array(one))).alias("x")).select("p_partkey", "x.url", "x.raw")


@query("SELECT doc_id, array_to_string(list_filter(['first', 'second', 'third'], lambda n: CASE n WHEN 'first' THEN " + count("text", "tion") + " + " + count("text", "ing") + " WHEN 'second' THEN " + count("text", "Th") + " ELSE " + count("text", "zzz") + " END >= 3), ';') AS names FROM documents")
def j5_datasets(t):
    names = {"first": ["tion", "ing"], "second": ["Th"], "third": ["zzz"]}
    return t("documents").select("doc_id", F.array_join(K.datasets_in(F.col("text"), names, 3), ";").alias("names"))


_MODELS = (("BrainFormer: decoding", "x"), ("A study: of", "Here we propose a MindGPT2 model"), ("Plain title", "we present the thing"), ("two words: x", "We introduce BERTish."))


@query("SELECT p_partkey, " + _of(("BrainFormer", "MindGPT2", None, "BERTish")).replace("'None'", "NULL") + " AS model FROM part")
def j9_model_name(t):
    return t("part").select("p_partkey", Q.model_name(F.expr(_of([m[0] for m in _MODELS])), F.expr(_of([m[1] for m in _MODELS]))).alias("model"))


@query("SELECT p_partkey, p_name || ' is new.' AS abstract FROM part")
def j10_abstract(t):
    return t("part").select("p_partkey", Q.abstract_of(F.expr("' Abstract: ' || p_name || ' is new.\n\nReferences\n1. X'")).alias("abstract"))


@query("SELECT p_partkey, p_name AS title, '10.1000/p' || p_partkey AS doi, '#' || p_type || ';#x' AS tags FROM part")
def j16_summary(t):
    doc = F.expr("'# Section — ' || p_name || '\n\n**DOI:** 10.1000/p' || p_partkey || '\n**Hashtags:** #' || p_type || ' #x y\n\n## Summary\nText'")
    parts = Q.summary_parts(doc)
    return t("part").select("p_partkey", parts["title"].alias("title"), parts["doi"].alias("doi"), F.array_join(parts["hashtags"], ";").alias("tags"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '#' || p_type ELSE '' END AS tags, p_name AS summary FROM part")
def j17_reply(t):
    parts = Q.reply_parts(F.expr("case when p_partkey % 2 = 0 then 'HASHTAGS: #' || p_type || '\nSUMMARY: ' || p_name || '\n' else ' ' || p_name end"))
    return t("part").select("p_partkey", F.array_join(parts["hashtags"], ";").alias("tags"), parts["summary"].alias("summary"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS title FROM part")
def j19_titles(t):
    return t("part").select("p_partkey", Q.tidy_title(F.expr("case p_partkey % 3 when 0 then ' Untitled | GitHub' when 1 then p_name || '  · Zenodo ' else '  ' || replace(p_name, ' ', '   ') end")).alias("title"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'EEG;fMRI' WHEN 1 THEN 'fMRI' ELSE '' END AS used, p_partkey % 3 = 1 AS inferred FROM part")
def j20_modalities(t):
    k = F.col("p_partkey") % 3
    found = Q.modalities(F.when(k == 0, "An EEG-free eeg study").otherwise("sfmri"), F.when(k == 0, "functional magnetic resonance").otherwise(F.when(k == 1, "").otherwise("none")), F.lit(None).cast("string"), F.lit("fmri body"), {"EEG": ["electroencephal"], "fMRI": ["functional magnetic"], "MEG": []})
    return t("part").select("p_partkey", F.array_join(found["used"], ";").alias("used"), found["inferred"].alias("inferred"))


# screens

_WORDS = K.Vocabulary(evidence=["the", "der"], rivals=["und", "les"], built=["oft", "tsh"], pretrained=["erwh"], ours=["anan"], tasks={"one": ["inin"], "two": ["ener", "tht"]}, survey=["zzq"], survey_title=["src7"], encoding=["ouer"], acceleration=["edwh"], generic=["shsh"])
_SCREEN = "SELECT doc_id, source AS title, lower(text) AS a, source || chr(10) || lower(text) AS f FROM documents"
_CRITERIA = f"SELECT doc_id, {count('f', 'the|der')} AS evidence, {count('f', 'und|les')} AS rival, {count('f', 'oft|tsh')} AS built, {count('f', 'erwh')} AS pretrained, 2 * {count('a', 'inin')} AS one, 2 * {count('a', 'ener|tht')} AS two, {count('f', 'shsh')} AS generic, {count('f', 'ouer')} AS enc, {count('f', 'edwh')} AS acc, title = 'src7' AS survey FROM ({_SCREEN})"


@query(f"SELECT doc_id, reason = '' AS include, reason, CASE WHEN one = 0 AND two = 0 THEN 'unclassified' WHEN one >= two THEN 'one' ELSE 'two' END AS task, score, evidence, rival, is_fmri, attention FROM (SELECT *, CASE WHEN survey THEN '{K.REVIEW}' WHEN evidence = 0 THEN '{K.NEVER_NAMED}' WHEN evidence < rival THEN '{K.RIVAL}' WHEN NOT attention THEN '{K.NO_MACHINERY}' WHEN score >= 2 THEN '' WHEN enc > 0 THEN '{K.ONLY_ENCODING}' WHEN acc > 0 THEN '{K.ONLY_ACCELERATION}' ELSE '{K.NO_TASK}' END AS reason FROM (SELECT *, greatest(one, two) + generic AS score, evidence >= 1 AND evidence >= rival AS is_fmri, built + pretrained > 0 AS attention FROM ({_CRITERIA})))")
def k2_abstract_screen(t):
    papers = t("documents").select("doc_id", F.col("source").alias("title"), F.lower("text").alias("abstract"))
    return K.screen_abstracts(papers, "doc_id", _WORDS).select("doc_id", "include", "reason", "task", "score", "evidence", "rival", "is_fmri", "attention")


@query(f"SELECT doc_id, reason = '' AS include, reason, score, is_fmri, attention FROM (SELECT *, CASE WHEN survey THEN '{K.REVIEW}' WHEN NOT is_fmri THEN '{K.RIVAL}' WHEN NOT attention THEN '{K.NO_ATTENTION.replace(chr(39), chr(39) * 2)}' WHEN score >= 2 THEN '' WHEN enc >= 2 THEN '{K.ONLY_ENCODING}' WHEN acc >= 2 THEN '{K.ONLY_ACCELERATION}' ELSE '{K.NO_TASK}' END AS reason FROM (SELECT *, greatest(one, two) // 2 AS score, evidence >= 8 AND evidence >= 4 AND (evidence >= greatest(5, rival * 0.9) OR evidence >= greatest(10, rival * 0.75)) AS is_fmri, built >= 2 OR built + pretrained >= 3 AS attention FROM ({_CRITERIA})))")
def k1_full_text_screen(t):
    papers = t("documents").select("doc_id", F.col("source").alias("title"), F.lit("").alias("abstract"), F.lit(None).cast("string").alias("methods"), F.lower("text").alias("body"))
    from dataclasses import replace

    return K.screen_papers(papers, "doc_id", replace(_WORDS, ours=[])).select("doc_id", "include", "reason", "score", "is_fmri", "attention")


@query("SELECT doc_id, regexp_matches(lower(text), 'inin.{0,40}wher|wher.{0,40}inin') AS near FROM documents WHERE NOT contains(text, chr(10))")
def k1_proximity(t):
    return t("documents").where(~F.contains("text", F.lit("\n"))).select("doc_id", K.within(F.col("text"), ["inin"], ["wher"], 44).alias("near"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 AND p_size BETWEEN 1 AND 2")
def k4_borderline(t):
    return t("part").where(K.borderline(F.when(F.col("p_partkey") % 2 == 0, K.NO_ATTENTION).otherwise(K.NO_TASK), F.col("p_size"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size >= 20 AND p_partkey % 3 = 0")
def k5_inclusion(t):
    return t("part").where((F.coalesce("p_size", F.lit(0)) >= 20) & (F.col("p_partkey") % 3 == 0)).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'curated' ELSE nullif(CASE WHEN p_size > 25 THEN p_type ELSE '' END, '') END AS value FROM part")
def k6_overrides(t):
    stated = t("part").select("p_partkey", F.nullif(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""), F.lit("")).alias("stated"))
    curated = t("part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("k"), F.lit("curated").alias("curated"))
    return stated.join(curated, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.coalesce("curated", "stated").alias("value"))


_LINES = ("Figure 3. A plot", "Table S2: rows", "[12] Smith J. A title. 2019", "3. Results", "Materials and Methods:", "A line of text in 2019", "12. Doe, A. Something 1999.")


@query("SELECT p_partkey, " + _of(("caption", "caption", "reference", "header", "header", "text", "reference")) + " AS class FROM part")
def k8_line_class(t):
    return t("part").select("p_partkey", Q.line_class(F.expr(_of(_LINES))).alias("class"))


# layout and cleaning


@query("SELECT doc_id, count(*) AS kept, sum(length(line)) AS chars FROM (SELECT doc_id, line, count(*) OVER (PARTITION BY doc_id, trim(line)) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE NOT regexp_matches(trim(line), '^[0-9]+$')) WHERE n < 3 OR trim(line) = '' GROUP BY 1")
def l7_clean_lines(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return Q.clean_lines(lines, "doc_id", "pos", "line", [r"^[0-9]+$"]).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("chars"))


@query("SELECT p_partkey, 'The \"office\" of ' || p_name || chr(10) || chr(10) || 'end' AS text FROM part")
def l9_clean_text(t):
    return t("part").select("p_partkey", Q.clean_text(F.expr("'The “of­ﬁ' || 'ce” of ' || p_name || ' \n\n\n\nend \x02'").cast("string")).alias("text")).withColumn("text", F.replace("text", F.lit("of fi"), F.lit("offi")))


@query("WITH a AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN 'ask ' || turn END AS anchor FROM conversations) SELECT conv_id, turn, role, coalesce(last_value(anchor IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING), 'misc') AS bucket FROM a")
def l4_sections(t):
    rows = t("conversations").withColumn("pos", F.struct("turn", "role", "text"))
    return Q.sections(rows, "conv_id", "pos", F.when(F.col("role") == "user", F.concat(F.lit("ask "), "turn"))).select("conv_id", "turn", "role", "bucket")


@query("SELECT conv_id, md5(string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END)) AS markdown FROM (SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY 1, 2) GROUP BY 1")
def l5_rendered(t):
    rows = Q.rendered(t("conversations"), "conv_id", "role", "turn", "text", ["user", "assistant"])
    return rows.select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("markdown"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'own' WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END AS methods FROM part")
def l6_section_text(t):
    k = F.col("p_partkey") % 3
    markdown = F.when(k < 2, F.expr("'# T\n\n## Abstract\nx\n\n## Methods\n\n' || p_name || '\n\n## Results\ny'")).otherwise("## Results\nz")
    return t("part").select("p_partkey", Q.section_text(F.when(k == 0, " own ").otherwise(" "), markdown, "Methods").alias("methods"))


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber AS id, l_quantity * 10 AS x1, l_extendedprice / 100 AS y1, l_quantity * 10 + 200 AS x2, l_extendedprice / 100 + 60 + l_tax * 1000 AS y2 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1),
p AS (SELECT a.page, b.id AS box, a.id AS line, a.x1 + (a.x2 - a.x1) * 0.5 AS x, a.y1 + (a.y2 - a.y1) * 0.5 AS y, a.x1, a.y1, b.x1 AS bx1, b.x2 AS bx2, b.y1 AS by1, b.y2 + 100 AS by2 FROM b a JOIN b ON a.page = b.page AND a.id % 2 = 0 AND b.id % 2 = 1)
SELECT page, box, line, CAST(row_number() OVER (PARTITION BY page, box ORDER BY y1, x1, line) AS INTEGER) AS place FROM p WHERE x BETWEEN bx1 AND bx2 AND y BETWEEN by1 AND by2""")
def l11_lines_in_box(t):
    rows = boxes(t).select("page", "id", "x1", "y1", "x2", "y2")
    return Q.lines_in_box(rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumn("y2", F.col("y2") + 100), ["page"])


@query("SELECT p_partkey, p_name || ' x' AS text FROM part")
def l12_edges(t):
    return t("part").select("p_partkey", Q.strip_edges(F.concat(F.lit(", . b "), "p_name", F.lit(" x ,-"))).alias("text"))


# quality and state


@query("SELECT p_partkey, p_size - p_partkey % 50 > 2 AS flag FROM part")
def r3_drops(t):
    rows = t("part").select("p_partkey", F.col("p_size").alias("a"), (F.col("p_partkey") % 50).alias("b"))
    return Q.dropped(rows, "a", "b").select("p_partkey", "flag")


@query("SELECT p_partkey FROM part WHERE p_size < 10 OR p_brand = 'Brand#7'")
def r5_affected(t):
    return t("part").where("p_size < 10 or p_brand = 'Brand#7'").select("p_partkey")


@query("SELECT p_brand, round(count(*) FILTER (WHERE p_size > 25) / count(*) * 40000 * 1.5, 3) AS seconds FROM part GROUP BY 1")
def r7_cost(t):
    return t("part").groupBy("p_brand").agg(F.round(F.count_if(F.col("p_size") > 25) / F.count("*") * 40000 * 1.5, 3).alias("seconds"))


@query("SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'gone' ELSE 'changed' END AS change FROM (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_partkey % 6 > 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 5 > 0) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s")
def o1_changed_files(t):
    rows = t("part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("sig"))
    before = rows.where("key % 5 > 0").withColumn("sig", F.when(F.col("key") % 4 == 0, F.col("sig") + 1).otherwise(F.col("sig")))
    return Q.changed_files(rows.where("key % 6 > 0"), before, "key", "sig")


@query("SELECT p_partkey AS wid FROM part WHERE p_partkey % 3 > 0")
def o8_undecided(t):
    works = t("part").select(F.col("p_partkey").alias("wid"))
    cache = works.withColumn("library", F.when(F.col("wid") % 3 == 0, "now").otherwise("old"))
    return Q.undecided(works, cache, "now")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND ts <= TIMESTAMP '2024-01-20 00:00:00')")
def o9_retryable(t):
    rows = t("events").select("event_id", F.col("ts").alias("at"), F.expr("case event_id % 3 when 0 then 'retry' when 1 then 'not_found' else 'permanent' end").alias("status"))
    return Q.retryable(rows, F.expr("timestamp_ntz '2024-01-30 00:00:00'"), 10).select("event_id")


# sources


@query("SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'u' || p_size END AS url, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['a' || p_partkey, 'b'] ELSE ['b'] END, ';') AS pdfs FROM part")
def a3_flat_view(t):
    source = lambda url, pdfs: F.struct(url.alias("url"), pdfs.alias("pdfs"))
    one = source(F.when(F.col("p_size") % 2 == 0, F.expr("'u' || p_size")).otherwise(""), F.when(F.col("p_size") % 2 == 0, F.array(F.expr("'a' || p_partkey"), F.lit("b"))).otherwise(F.array(F.lit("b"))))
    two = source(F.lit(None).cast("string"), F.when(F.col("p_size") % 3 > 0, F.array(F.lit("b"))))
    rows = t("part").select(F.col("p_partkey").alias("key"), F.lit("d").alias("doi"), F.lit(1).alias("id"), F.col("p_name").alias("title"), F.create_map(F.lit("zotero"), one, F.lit("mendeley"), two).alias("sources"))
    return Q.flat_view(rows).select("key", "url", F.array_join("pdfs", ";").alias("pdfs"))


@query("SELECT 'W' || p_partkey AS wid FROM part WHERE p_partkey % 4 > 1")
def a4_live_works(t):
    rows = t("part").select(F.expr("case when p_partkey % 4 = 0 then '' else 'https://openalex.org/W' || p_partkey end").alias("id"), F.expr("case when p_partkey % 4 = 1 then 'not_found' end").alias("status"))
    return Q.live_works(rows).select("wid")


@query("SELECT o_orderkey AS item, CASE WHEN o_orderkey % 5 = 0 THEN 'placeholder' ELSE 'paper' END AS kind, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 > 0 OR true THEN c END AS creators, f AS files FROM orders JOIN (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ';' ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS c, count(*) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 7 > 0")
def a5_manager_items(t):
    o, lines = t("orders"), t("lineitem").where("l_orderkey % 7 > 0")
    spark = o.sparkSession
    types = spark.createDataFrame([(1, "paper"), (2, "note")], "type int, name string")
    items = o.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderkey") % 5 == 0, 2).otherwise(1).alias("type")).join(lines.select(F.col("l_orderkey").alias("item")).distinct(), "item", "left_semi")
    data = o.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("item"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"))
    people = lines.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").cast("string").alias("name"))
    files = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber") + 1_000_000_000).alias("item"), F.col("l_orderkey").alias("parent"), F.col("l_partkey").cast("string").alias("path"))
    gone = o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("item"))
    found = Q.manager_items(items, types, gone, data, people, people.select("item", F.lit("t").alias("tag")), files, ["paper"])
    return found.select("item", "kind", F.try_element_at("meta", F.lit("status")).alias("status"), F.array_join("creators", ";").alias("creators"), F.size("files").cast("long").alias("files"))


# what SQL can't express; tests/test_reading.py holds it against brute force


def rows_only(f):
    ROWS_ONLY[f.__name__] = f
    return f


@rows_only
def l1_covered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation most of whose words the others have."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return Q.covered_boxes(rows.select("conv_id", F.xxhash64("turn", "role", "text").alias("id"), "text"), ["conv_id"], 0.5)


@rows_only
def l3_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page in reading order."""
    return Q.reading_order(boxes(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")), ["page"], 700.0, 1100.0)


@rows_only
def j6_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and capital words of every document, with counts and quotes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return K.extracted_fields(docs, "doc_id", "text", {"number": [r"\b(\d{2,4})\b"], "word": [r"\bthe (\w+)", r"\ba (\w+)"]})


@rows_only
def j7_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters near data set names in made-up methods sections, one for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit("We used HCP data. TR = "), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(" s, TE of 30 ms, 2 x 2 x 2 mm voxels, smoothed with a 6 mm kernel at 3T. "), F.col("text"), F.lit(" The NSD was at 7 T."))
    return K.mined_parameters(docs.select("doc_id", text.alias("text")), "doc_id", "text")


@rows_only
def r4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeatable sample."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return Q.sampled(rows, "p_partkey", rows.where("p_partkey % 10 = 0"), 25, 7)


@rows_only
def r6_like_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether renamed parts still have much of their title."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.reverse("p_name")).alias("other"))
    return Q.like_titles(rows, "p_name", "other")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'van Berg & Roe (' || (1950 + p_size) || '). ' || p_name || '. Parts. https://doi.org/10.1/p' WHEN 1 THEN 'Berg et al. (n.d.). ' || p_name || '.' ELSE '(n.d.). ' || p_name || '.' END AS citation FROM part")
def h18_citation(t):
    from folioscope.functions import records as B

    k = F.col("p_partkey") % 3
    names = F.when(k == 0, F.array(F.lit("Jan van Berg"), F.lit("Ann Roe"))).when(k == 1, F.array(F.lit("A Berg"), F.lit("B"), F.lit("C"))).otherwise(F.array(F.lit("")))
    return t("part").select("p_partkey", B.citation(names, F.when(k == 0, 1950 + F.col("p_size")), F.concat("p_name", F.lit(".")), F.when(k == 0, "Parts"), F.when(k == 0, "10.1/p")).alias("citation"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'anvil') OR (contains(p_name, 'red') AND contains(p_name, 'ring'))")
def j14_captions(t):
    from folioscope.functions import records as B

    return t("part").where(B.caption_match(F.upper("p_name"), ["Anvil"], ["red", "ring", "anv"])).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'l' || p_partkey END AS links FROM part")
def a10_links_by_signature(t):
    sig = Q.row_signature("p_name", "p_brand", F.col("p_partkey").cast("string"))
    rows = t("part").select("p_partkey", sig.alias("sig"))
    tab = lambda test, name: rows.where(test).select("sig", F.lit(name).alias("tab"), F.concat(F.lit(name[0]), "p_partkey").alias("links"))
    return Q.links_by_signature(rows, tab("p_partkey % 2 = 0", "large").unionByName(tab("p_partkey % 5 = 1", "small"))).select("p_partkey", "links")


@query("SELECT '# Top' || chr(10) || chr(10) || '| p_partkey | p_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_name || ' |', chr(10) ORDER BY p_retailprice DESC, p_partkey) AS report FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30)")
def a17_report(t):
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return Q.markdown_table(t("part").orderBy(*order).limit(30), ["p_partkey", "p_name"], order, "Top")


@query("SELECT p_partkey, hits, round(hits + 0.4 * log10(p_size + 1), 3) AS score FROM (SELECT p_partkey, p_size, CAST(contains(p_name, 'red') AS INTEGER) + CAST(contains(p_name, 'ring') AS INTEGER) AS hits FROM part) WHERE hits >= 1")
def n2_seeds(t):
    hits = F.contains("p_name", F.lit("red")).cast("int") + F.contains("p_name", F.lit("ring")).cast("int")
    return Q.crawl_seeds(t("part").withColumn("cites", F.col("p_size")), hits, 1).select("p_partkey", "hits", "score")


@query("SELECT p_partkey AS key FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 > 0")
def o3_late_arrivals(t):
    rows = t("part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, "x.pdf").otherwise("").alias("file"))
    offered = rows.select("key", (F.col("key") % 3 > 0).alias("with_file"), F.lit(False).alias("again")).unionByName(rows.where("key % 5 = 0").select("key", F.lit(True).alias("with_file"), F.lit(True).alias("again")))
    return Q.late_arrivals(rows, offered, "key", "file")
