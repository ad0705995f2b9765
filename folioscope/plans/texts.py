"""Queries of text and record functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import records as B
from folioscope.functions import text as X
from folioscope.plans.catalog import TITLE, query

#: Marked letters of the texts, for DuckDB, which decomposes none by itself.
_MARKED = "".join(c for c in X.MARKED if c < "ɐ")


def title_key(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(regexp_replace(coalesce({c}, ''), '([{_MARKED}])', '\\1 ', 'g'))), '[^a-z0-9]+', ' ', 'g'))"


#: Every view behind a DOI, in both cases, and letters of several blocks, by the part's key.
_VIEWS = ("/full", "/PDF", "/figures/3", "/Figure/1/x", "/tables", "/table/2", "/abstract", "/Abstract", "/epdf", "/fullpdf", "/references", "/reference", "/metrics", "/supplementary", "/suppl/a", "/media", ".;)", "", "/fullness", "/x/pdf")
_LETTERED = ("Müller", "Łódź", "Ðurđa", "þorn", "Åse Ørsted", "naïve Œuvre", "İstanbul ıl", "Ǆungla", "ﬁne", "ǖ ệ Ṩ", "x² №", "plain")


def _of(values, n: str = "p_partkey") -> str:
    return "CASE " + " ".join(f"WHEN {n} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, '10.1234/' || CASE WHEN p_partkey % {len(_VIEWS)} = {len(_VIEWS) - 2} THEN 'p.' || p_partkey || '/fullness' WHEN p_partkey % {len(_VIEWS)} = {len(_VIEWS) - 1} THEN 'p.' || p_partkey || '/x' ELSE 'p.' || p_partkey END AS doi FROM part")
def h1_every_view(t):
    return t("part").select("p_partkey", X.normalize_doi(F.expr(f"'see http://doi.org/10.1234/p.' || p_partkey || {_of(_VIEWS)}")).alias("doi"))


@query(f"SELECT doc_id, md5({title_key('text')}) AS title, md5(replace(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), ' ', '')) AS folded FROM documents")
def h2_title_fold(t):
    return t("documents").select("doc_id", F.md5(X.normalize_title(F.col("text")).cast("binary")).alias("title"), F.md5(X.fold_text(F.col("text")).cast("binary")).alias("folded"))


_FOLDED = ("muller", "lodz", "durda", "thorn", "ase orsted", "naive oeuvre", "istanbul il", "dzungla", "fine", "u e s", "x2 no", "plain")
_TITLED = ("mu ller", "o dz", "ur a", "orn", "a se rsted", "nai ve uvre", "i stanbul l", "dz ungla", "fine", "u e s", "x2 no", "plain")


@query(f"SELECT p_partkey, {_of(_FOLDED)} AS folded, {_of(_TITLED)} AS titled FROM part")
def h2_letters(t):
    c = F.expr(_of(_LETTERED))
    return t("part").select("p_partkey", X.normalize_text(c).alias("folded"), X.normalize_title(c).alias("titled"))


@query(f"SELECT p_partkey, trim(regexp_replace('A: ' || replace({TITLE}, '#', ' ') || ' x y', '\\s+', ' ', 'g')) AS asked FROM part" .replace("'A: '", "'A '"))
def h4_search_title(t):
    return t("part").select("p_partkey", X.search_title(F.expr(f"'A: ' || replace({TITLE}, '#', '|') || ' (x)?[y] '")).alias("asked"))


@query("SELECT p_partkey, '10.1_p_' || p_partkey AS file, base64(encode(p_name)) AS encoded, p_name AS decoded FROM part")
def h5_encodings(t):
    return t("part").select("p_partkey", B.doi_to_filename(F.expr(r"'10.1/p\\' || p_partkey")).alias("file"), B.to_base64(F.col("p_name")).alias("encoded"), B.from_base64(B.to_base64(F.col("p_name"))).alias("decoded"))


_URLS = ("https://www.github.com/a/b).", "user.github.io/p,", "http://raw.githubusercontent.com/x", "//osf.io/abc12/", "https://doi.org/10.5281/zenodo.123;", "https://sub.Figshare.com:443/z?x=1", "https://notgithub.com/a", "https://doi.org/10.1000/xyz", "...", "git.io/q", "ftp.github.com.evil.org/x", "https://me@gitlab.com/a")
_LABELS = ("GitHub", "GitHub", "GitHub", "OSF", "Zenodo", "Figshare", None, None, None, "GitHub", None, "GitLab")
_CLEAN = ("https://www.github.com/a/b", "https://user.github.io/p", "http://raw.githubusercontent.com/x", "https://osf.io/abc12/", "https://doi.org/10.5281/zenodo.123", "https://sub.Figshare.com:443/z?x=1", "https://notgithub.com/a", "https://doi.org/10.1000/xyz", None, "https://git.io/q", "https://ftp.github.com.evil.org/x", "https://me@gitlab.com/a")


@query("SELECT p_partkey, " + _of(_CLEAN).replace("'None'", "NULL") + " AS url, " + _of(_LABELS).replace("'None'", "NULL") + " AS label FROM part")
def h7_host_labels(t):
    url = B.clean_url(F.expr(_of(_URLS)))
    return t("part").select("p_partkey", url.alias("url"), B.host_label(url).alias("label"))


_DEBRIS = ("https://x.org/10.1101/2020.01.02v3.full.pdf", "https://direct.mit.edu/doi/10.1162/jocn_a_02087/118023/Title", "10.1093/a/b/html", "doi 10.1000%2Fabc.abstract", "no doi", "https://direct-mit-edu.proxy.org/10.1162/x/y/z", "10.1007/s1-2_3/v2")
_DOIS = ("10.1101/2020.01.02", "10.1162/jocn_a_02087", "10.1093/a/b", "10.1000/abc", None, "10.1162/x", "10.1007/s1-2_3")


@query("SELECT p_partkey, " + _of(_DOIS).replace("'None'", "NULL") + " AS doi FROM part")
def h8_doi_in_link(t):
    return t("part").select("p_partkey", B.doi_in_link(F.expr(_of(_DEBRIS))).alias("doi"))


@query("SELECT p_partkey, trim(p_name || CASE WHEN p_partkey % 6 = 5 THEN ' & <b>' ELSE '' END) AS line FROM part")
def h9_strip_markdown(t):
    k = F.col("p_partkey") % 6
    line = F.when(k == 0, F.concat(F.lit("  - "), "p_name")).when(k == 1, F.concat(F.lit("> ## "), "p_name")).when(k == 2, F.concat(F.lit("**"), "p_name", F.lit("**"))).when(k == 3, F.concat(F.lit("3) _"), "p_name", F.lit("_"))).when(k == 4, F.concat(F.lit("__"), "p_name", F.lit("__"))).otherwise(F.concat("p_name", F.lit("  &amp;\t&lt;b&gt;")))
    return t("part").select("p_partkey", B.strip_markdown(line).alias("line"))


@query("SELECT p_partkey, substring(trim(regexp_replace(p_name || ': [a/b] ' || p_type || ' ' || p_brand, '[\\[\\]:*?/]', ' ', 'g')), 1, 31) AS sheet FROM part")
def h10_sheet_name(t):
    return t("part").select("p_partkey", B.sheet_name(F.expr("p_name || ': [a/b] ' || p_type || ' ' || p_brand")).alias("sheet"))


_NAMES = ("Jan van der Berg", "Ada Lovelace", "Plato", "", "Ludwig van Beethoven", "de la Cruz", "Maria del Carmen de los Santos", "Ana B. da Silva")
_FAMILY = ("van der Berg", "Lovelace", "Plato", "", "van Beethoven", "la Cruz", "de los Santos", "da Silva")
_GIVEN = ("Jan", "Ada", "", "", "Ludwig", "de", "Maria del Carmen", "Ana B.")


@query("SELECT p_partkey, " + _of(_FAMILY) + " AS family, " + _of(_GIVEN) + " AS given, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' et al.' ELSE '' END AS label FROM part")
def h11_names(t):
    name = B.split_name(F.expr(_of(_NAMES)))
    label = B.first_author(F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(""), "p_name", "p_brand")).otherwise(F.array("p_name")))
    return t("part").select("p_partkey", name["family"].alias("family"), name["given"].alias("given"), label.alias("label"))


@query("SELECT doc_id, md5(CASE WHEN length(c) > 1000 THEN substring(c, 1, 1000) || chr(10) || '[ ... truncated for Excel ... ]' ELSE c END) AS cell FROM (SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS c FROM documents)")
def h12_cell(t):
    return t("documents").select("doc_id", F.md5(B.cell(F.concat(F.col("text"), F.lit("\x01")), 1000).cast("binary")).alias("cell"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name || 's glass blocks yes as', ' '), lambda w: CASE WHEN length(w) > 3 AND w[-1:] = 's' AND w[-2:] <> 'ss' THEN w[:-2] ELSE w END), ' ') AS stem FROM part")
def h14_crude_stem(t):
    return t("part").select("p_partkey", X.crude_stem(F.concat("p_name", F.lit("s glass  blocks yes as"))).alias("stem"))


@query("SELECT p_partkey, ['We follow Smith et al. 2019 with 1.5 s.', 'See Fig. 3 (Eq. 4)!', p_name || ' no stop', 'Is it?'] AS s, 4 AS n FROM part" .replace("['We", "array_to_string(['We").replace("'Is it?'] AS s", "'Is it?'], '|') AS s").replace("p_name || ' no stop', 'Is it?'", "'Item ' || p_name || ' no stop.', 'Is it?'"))
def h15_sentences(t):
    s = B.sentences(F.concat(F.lit("We follow Smith et al. 2019 with 1.5 s. See Fig. 3 (Eq. 4)!  Item "), "p_name", F.lit(" no stop. Is it? ")))
    return t("part").select("p_partkey", F.array_join(s, "|").alias("s"), F.size(s).alias("n"))


@query("SELECT p_partkey, 'The ' || p_name || ' is here! ' AS around FROM part")
def h16_sentence_at(t):
    c = F.concat(F.lit("One. The "), "p_name", F.lit(" is here! And more."))
    return t("part").select("p_partkey", B.sentence_at(c, F.lit(9), F.lit(12)).alias("around"))


@query("SELECT p_partkey, p_name || '; ' || p_brand AS cell FROM part")
def h17_csv_cell(t):
    return t("part").select("p_partkey", B.csv_cell(F.concat(F.lit("\n "), "p_name", F.lit(" \r\n\r\n\t"), "p_brand", F.lit("\n"))).alias("cell"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '2021-03-04' WHEN 1 THEN (1950 + p_size) || '-01-01' WHEN 2 THEN '2019-05-06' WHEN 3 THEN '1998-01-01' ELSE '' END AS date FROM part")
def h19_publication_date(t):
    k = F.col("p_partkey") % 5
    date = B.publication_date(F.when(k == 0, "2021-03-04T00:00"), F.when(k == 1, 1950 + F.col("p_size")), F.when(k == 2, "c 2019-05-06").when(k == 3, "May 1998").otherwise("n.d."))
    return t("part").select("p_partkey", date.alias("date"))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def h20_heading_date(t):
    return t("events").select("event_id", B.heading_date(F.concat(F.lit("# "), F.upper(F.date_format("ts", "ddMMMyyyy")), F.lit(" notes"))).alias("day"))


@query("SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS added FROM orders GROUP BY 1")
def h21_added_at(t):
    stamps = F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return t("orders").groupBy("o_custkey").agg(stamps.alias("s")).select("o_custkey", B.added_at(F.concat("s", F.array(F.lit(""), F.lit(None).cast("string")))).alias("added"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-28 12:00:00' - INTERVAL 7 DAY")
def h22_since(t):
    return t("events").where(F.col("ts") >= B.since(F.expr("timestamp_ntz '2024-01-28 12:00:00'"), 7)).select("event_id")


@query("SELECT p_partkey, CASE WHEN 1500 + p_size * 14 BETWEEN 1600 AND 2199 THEN 1500 + p_size * 14 END AS manager, CASE WHEN 1500 + p_size * 14 < 2100 THEN 1500 + p_size * 14 END AS reference FROM part")
def h24_years(t):
    text = F.expr("'x12345 ' || (1500 + p_size * 14) || ', 99'")
    return t("part").select("p_partkey", B.manager_year(text).alias("manager"), B.reference_year(text).alias("reference"))


@query("SELECT p_partkey, lower(p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END) || CASE WHEN p_partkey % 2 = 0 THEN ' ' || lower(p_brand) ELSE '' END AS hay FROM part")
def h26_haystack(t):
    return t("part").select("p_partkey", B.haystack(F.col("p_name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit(""))).alias("hay"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END AS ocr FROM part")
def h27_engine(t):
    k = F.col("p_partkey") % 3
    texts = F.create_map(F.lit("paddle"), F.when(k == 0, F.col("p_brand")).otherwise(F.lit(" ")), F.lit("rapid"), F.when(k == 1, F.col("p_name")).otherwise(F.lit("")))
    return t("part").select("p_partkey", B.first_filled_engine(texts, ["rapid", "paddle", "none"]).alias("ocr"))


@query("SELECT p_partkey, 'W' || p_partkey AS wid FROM part")
def h28_work_id(t):
    return t("part").select("p_partkey", B.work_id(F.expr("'https://openalex.org/W' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END")).alias("wid"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ';') AS tags FROM (SELECT p_partkey, lower(p_type) AS p_type FROM part)")
def h29_ordered_tags(t):
    tags = F.concat(F.split("p_type", " "), F.split(F.upper("p_type"), " "), F.array(F.lit(" ")))
    return t("part").select("p_partkey", F.lower(F.array_join(B.ordered_tags(tags), ";")).alias("tags"))


@query("SELECT p_brand, sha1(array_to_string(list_sort(list(DISTINCT p_name)), chr(10))) AS library, substring(sha1(array_to_string(list_sort(list(DISTINCT p_type)), chr(10))), 1, 12) AS vocabulary FROM part GROUP BY 1")
def h30_fingerprints(t):
    return t("part").groupBy("p_brand").agg(B.fingerprint(F.collect_set("p_name")).alias("library"), B.fingerprint(F.collect_set("p_type"), 12).alias("vocabulary"))


@query("SELECT p_partkey, array_to_string(list_filter(['Ring', 'Hot', 'Small', 'Bolt'], lambda x: list_contains(string_split(p_name, ' '), lower(x))), ';') AS labels FROM part")
def h32_config_order(t):
    found = F.transform(F.split("p_name", " "), lambda w: F.initcap(w))
    return t("part").select("p_partkey", F.array_join(B.in_config_order(found, ["Ring", "Hot", "Small", "Bolt"]), ";").alias("labels"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS missing FROM events")
def h33_json_path(t):
    return t("events").select("event_id", B.json_path(F.col("props"), "k", "none").alias("k"), B.json_path(F.col("props"), "a.b", "none").alias("missing"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '10.1000/p' || p_partkey WHEN 1 THEN 'nodoi-K' || p_partkey ELSE 'ref-' || substring(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) END AS key FROM part")
def h34_synthetic_key(t):
    k = F.col("p_partkey") % 3
    return t("part").select("p_partkey", B.synthetic_key(F.when(k == 0, F.expr("'doi:10.1000/p' || p_partkey")), F.when(k == 1, F.expr("'K' || p_partkey")), F.col("p_name")).alias("key"))


_NUMBERS = r"'\d+(?:\.\d+)?'"


@query(f"SELECT doc_id, length(c) > 0 AND length(regexp_replace(c, '[^\\p{{L}}]', '', 'g')) < 0.2 * length(c) AS garbled, len(w) >= 4 AND (list_sum(list_transform(w, lambda x: length(x))) > 12.0 * len(w) OR len(list_filter(w, lambda x: length(x) > 18)) > 0.15 * len(w)) AS unspaced FROM (SELECT doc_id, text AS c, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM documents)")
def k7_text_gates(t):
    return t("documents").select("doc_id", B.garbled(F.col("text")).alias("garbled"), B.unspaced(F.col("text")).alias("unspaced"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS ok FROM part")
def k7_text_layer(t):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "(1) A").when(k == 1, "A text layer of plain words").when(k == 2, " abcdefghij klmno pq").otherwise("§±")
    return t("part").select("p_partkey", B.text_layer_ok(text).alias("ok"))
