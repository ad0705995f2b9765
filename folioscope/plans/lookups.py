"""Title lookups over the parts, by likeness; SQL has no such scores, tests/test_matching.py holds them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import matching as Q
from folioscope.plans.catalog import ROWS_ONLY, TITLE

#: Misspelt title words, by the part's key.
TYPO = "CASE WHEN p_partkey % 3 = 0 THEN replace(title, 'human', 'humman') WHEN p_partkey % 3 = 1 THEN concat_ws(' ', reverse(split(title, ' '))) ELSE title END"


def rows_only(f):
    ROWS_ONLY[f.__name__] = f
    return f


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long titles of the parts, folded, with a DOI for every second one."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    long = F.concat_ws(" ", F.lit("a study of the"), F.expr(TITLE), F.lit("in human listeners"), F.col("p_size").cast("string"))
    return rows.select("p_partkey", "p_size", X.normalize_title(long).alias("title"), F.when(F.col("p_partkey") % 2 == 0, X.normalize_doi(F.expr("'10.1000/p' || p_partkey"))).alias("doi"))


def asked_and_pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = titles(spark, sf_dir)
    asked = rows.withColumn("title", F.expr(TYPO)).withColumn("doi", F.when(F.col("p_partkey") % 4 == 0, F.col("doi")))
    return asked.select("p_partkey", "doi", "title"), rows.where("p_size <= 25").select("doi", "title", F.col("p_partkey").alias("place"))


@rows_only
def c5_exists_by_likeness(spark, sf_dir):
    """Whether the pool has each asked title: by DOI alone where there is one, else by likeness."""
    asked, pool = asked_and_pool(spark, sf_dir)
    return Q.exists(asked, pool, "p_partkey")


@rows_only
def c6_retry_ladder(spark, sf_dir):
    """The same, with missed DOIs asked again by title."""
    asked, pool = asked_and_pool(spark, sf_dir)
    return Q.retry_ladder(asked, pool, "p_partkey")


@rows_only
def c7_pool_match(spark, sf_dir):
    """The pool row of each asked title and how it was found."""
    asked, pool = asked_and_pool(spark, sf_dir)
    return Q.pool_match(asked, pool, "p_partkey")


@rows_only
def c17_repair_names(spark, sf_dir):
    """Misread names of a brand's parts against its real ones."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("owner"), "p_partkey", F.expr("replace(p_name, ' ', '-') || '-tool-' || p_size").alias("name"))
    bad = rows.select("owner", F.expr("case p_partkey % 4 when 0 then upper(replace(name, '-', '_')) when 1 then substring(name, 1, 7) when 2 then replace(name, 'o', '0') else 'zz' end").alias("name"))
    return Q.repair_names(bad, rows, "owner", "name")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", X.normalize_text(F.expr(TITLE)).alias("hay_t"), X.normalize_text(F.expr("'10.1000/p' || p_partkey")).alias("hay_k"))


@rows_only
def h3_family(spark, sf_dir):
    """Every score of every title against one."""
    from folioscope.functions import similarity as Z

    asked = F.lit("widget small red brand 7")
    return pool(spark, sf_dir).select("p_partkey", *(f("hay_t", asked).alias(n) for n, f in (("partial", Z.partial_ratio), ("words", Z.token_set_ratio), ("weighted", Z.weighted_ratio), ("points", Z.title_score))))


@rows_only
def i6_near_titles(spark, sf_dir):
    """A search without a hit comes back with near titles."""
    rows = pool(spark, sf_dir)
    found, _ = Q.search_or_near(rows, F.contains("hay_t", F.lit("smal widgot")), "smal widgot")
    return found.select("p_partkey", "rel")


@rows_only
def i7_title_search(spark, sf_dir):
    """A half-remembered title."""
    return Q.title_search(pool(spark, sf_dir), "small widgett brand 7", ["p_partkey"])[0].select("p_partkey", "rel")


@rows_only
def i8_pasted_id(spark, sf_dir):
    """A pasted identifier comes first."""
    return Q.title_search(pool(spark, sf_dir), "10 1000 p7", ["p_partkey"])[0].select("p_partkey", "rel")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up reference list of each part: one entry by title, one by DOI, which a third repeats."""
    text = F.expr("'[1] Doe, A. (1990). On the ' || p_name || ' number ' || p_partkey || '. Journal of Parts, 3, 1-2.\n[2] B. Roe, \"Second ' || p_type || ' of ' || p_partkey || ',\" Parts Letters, 2001. https://doi.org/10.1000/p' || p_partkey || '\n[3] Again. 2001. doi:10.1000/p' || p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.alias("text"))


@rows_only
def j11_references(spark, sf_dir):
    """The lists' entries."""
    from folioscope.operators.references import parsed_references

    return parsed_references(cited(spark, sf_dir), "p_partkey", "text")


@rows_only
def j12_resolved(spark, sf_dir):
    """The entries in the library: by DOI, or by title."""
    rows = j11_references(spark, sf_dir).select(F.concat_ws(":", "key", F.col("n").cast("string")).alias("key"), "doi", X.normalize_title(F.col("title")).alias("title"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    pool_ = parts.select(F.concat(F.lit("10.1000/p"), "p_partkey").alias("doi"), X.normalize_title(F.expr("'On the ' || p_name || ' number ' || p_partkey")).alias("title"), F.col("p_partkey").alias("place"))
    return Q.pool_match(rows, pool_, "key")
