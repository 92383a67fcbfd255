"""Extracts, resolution steps and guards over the driver tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import dates as dt
from quillspark.functions.proximity import terms_regex
from quillspark.operators import resolution as rs
from quillspark.plans import firms as fm
from quillspark.plans import market as mk
from quillspark.plans.registry import query
from quillspark.sources.tables import table

_NAMES = "SELECT o_orderkey, unnest([p_brand || ' INC', p_type || ' ' || p_brand]) AS assignee, year(o_orderdate) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"


def assignments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"), F.explode(F.array(F.concat("p_brand", F.lit(" INC")), F.concat_ws(" ", "p_type", "p_brand"))).alias("assignee"))


@query(f"SELECT assignee, count(DISTINCT o_orderkey) AS n, min(y) AS first_year, max(y) AS last_year FROM ({_NAMES}) GROUP BY assignee HAVING count(DISTINCT o_orderkey) >= 3")
def assignee_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Names with three applications at least, from arrays of assignees; counts are of distinct applications."""
    g = assignments(spark, d).groupBy("assignee").agg(F.countDistinct("o_orderkey").alias("n"), F.min("y").alias("first_year"), F.max("y").alias("last_year"))
    return g.filter("n >= 3")


@query("""WITH p AS (SELECT l_orderkey AS id, list(p_brand) AS names, list(p_type || '/' || p_size) AS codes, min(p_name) FILTER (p_size > 10) AS title FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
  SELECT id, title, array_to_string(list_sort(list_distinct(codes)), ';') AS codes, array_to_string(list_sort(list_distinct(list_filter(names, lambda x: x IN ('Brand#1', 'Brand#2', 'Brand#3')))), '|') AS matched FROM p WHERE len(list_filter(names, lambda x: x IN ('Brand#1', 'Brand#2', 'Brand#3'))) > 0""")
def publication_extract(spark: SparkSession, d: str) -> DataFrame:
    """Publications with any wanted assignee: a title, sorted distinct codes and matched names, packed."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("p_brand").alias("names"), F.collect_set(F.concat_ws("/", "p_type", F.col("p_size").cast("string"))).alias("codes"), F.min(F.when(F.col("p_size") > 10, F.col("p_name"))).alias("title"))
    wanted = lambda x: x.isin("Brand#1", "Brand#2", "Brand#3")
    return p.filter(F.exists("names", wanted)).select("id", "title", F.array_join(F.array_sort("codes"), ";").alias("codes"), F.array_join(F.array_sort(F.filter("names", wanted)), "|").alias("matched"))


SQL_PN = "SELECT DISTINCT upper(split_part(p_name, ' ', 2)) || ' ' || upper(split_part(p_name, ' ', 1)) || CASE WHEN p_partkey % 3 = 0 THEN ' T' WHEN p_partkey % 3 = 1 THEN ' ' || upper(p_type) ELSE ' INC' END AS name FROM part"
_STRICT = fm._STRICT  # noqa: SLF001
SQL_GIVEN = f"SELECT w FROM (SELECT w, count(DISTINCT t[1]) AS f, avg(CAST(len(list_intersect(t, [{_STRICT}])) > 0 AS INT)) AS l FROM (SELECT t, unnest(list_distinct(t[2:])) AS w FROM (SELECT string_split(name, ' ') AS t FROM ({SQL_PN}))) GROUP BY w) WHERE f >= 3 AND l < 0.5"
SQL_PERSON = f"SELECT name, t[1] AS surname FROM (SELECT name, string_split(name, ' ') AS t FROM ({SQL_PN})), (SELECT list(w) AS g FROM ({SQL_GIVEN})) WHERE len(t) BETWEEN 2 AND 4 AND len(list_intersect(t, [{_STRICT}])) = 0 AND len(list_filter(t[2:], lambda x: NOT (list_contains(g, x) OR regexp_full_match(x, '[A-Z]')))) = 0"


def person_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, F.lit(" T")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.upper("p_type"))).otherwise(F.lit(" INC"))
    return p.select(F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(" "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), tail).alias("name")).distinct()


@query(f"SELECT surname, count(*) AS n FROM ({SQL_PERSON}) GROUP BY surname HAVING count(*) >= 2")
def learned_surnames(spark: SparkSession, d: str) -> DataFrame:
    """Given names learned from a dictionary, persons by these, and their frequent surnames."""
    names = person_names(spark, d)
    given = rs.given_names(names, "name", follow=3, legal=0.5)
    return rs.surnames(rs.persons(names, "name", given), 2)


SQL_REVIEW = "SELECT c_mktsegment AS ticker, 'N' || c_nationkey AS assignee, count(*) AS n FROM customer GROUP BY ALL"


@query(f"SELECT ticker, assignee, n, CASE WHEN assignee IN ('N1', 'N2') AND ticker = 'BUILDING' THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision FROM ({SQL_REVIEW}) WHERE n >= 2 AND assignee <> 'N3'")
def adjudication(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on open reviews; what is listed must be under review."""
    review = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("ticker"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("assignee")).agg(F.count("*").alias("n"))
    include = review.filter("ticker = 'BUILDING' AND assignee IN ('N1', 'N2')")
    return rs.adjudicate(review, review.filter("assignee = 'N3'"), include, least=2)


@query("""WITH a AS (SELECT DISTINCT p_type AS ticker, p_brand AS assignee, CASE WHEN p_size > 25 THEN 'parent' ELSE 'subsidiary' END AS tier, 2 AS prio FROM part WHERE p_brand <> 'Brand#9' UNION SELECT DISTINCT p_type, p_brand, 'parent', 1 FROM part WHERE p_size = 7 UNION SELECT 'LARGE', 'Brand#1', 'parent', 0),
  f AS (SELECT ticker, assignee, tier FROM a QUALIFY row_number() OVER (PARTITION BY ticker, assignee ORDER BY prio, tier) = 1)
  SELECT assignee, tier, ticker, NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM f WHERE NOT (starts_with(assignee, 'Brand#1') AND ticker IN ('LARGE', 'SMALL'))
  UNION SELECT assignee, tier, 'LARGE', NULL, '1998-12-31' FROM f WHERE starts_with(assignee, 'Brand#1') AND ticker IN ('LARGE', 'SMALL')
  UNION SELECT assignee, tier, 'SMALL', '1999-01-01', NULL FROM f WHERE starts_with(assignee, 'Brand#1') AND ticker IN ('LARGE', 'SMALL')""")
def alias_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Sources overlaid, vetoed pairs gone, and names of an acquired firm split at the day of the acquisition."""
    p = table(spark, d, "part").select(F.col("p_type").alias("ticker"), F.col("p_brand").alias("assignee"), "p_size")
    auto = p.select("ticker", "assignee", F.when(F.col("p_size") > 25, "T1_EXACT").otherwise("T2_PREFIX").alias("tier")).distinct()
    curated = spark.sql("SELECT 'LARGE' AS ticker, 'Brand#1' AS assignee")
    veto = p.filter("assignee = 'Brand#9'").select("ticker", "assignee").distinct()
    manual = p.filter("p_size = 7").select("ticker", "assignee").distinct()
    a = rs.split_at_acquisition(rs.assemble_aliases(auto, manual, curated, veto), "Brand#1", F.lit("1999-01-01").cast("date"), "LARGE", "SMALL")
    return a.select("assignee", "tier", "ticker", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


@query("SELECT r_name AS ticker, r_regionkey AS permco FROM region UNION SELECT n_name, n_regionkey FROM nation")
def canonical_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Every historical ticker to its firm; fails if one belongs to several."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("permco")).agg(F.collect_set("n_name").alias("t"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("permco"), "r_name")
    roster = n.join(r, "permco").select("permco", F.array_union("t", F.array("r_name")).alias("all_tickers"))
    return rs.canonical_keys(roster).select("ticker", "permco")


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS ai_papers, CAST(sum(coalesce(CAST(l_quantity AS BIGINT), 0)) AS BIGINT) AS total_citations, round(avg(coalesce(CAST(l_quantity AS BIGINT), 0)), 6) AS avg_citations FROM lineitem GROUP BY 1")
def macro_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The monthly series from paper rows; a table without a citation column counts 0 for it."""
    rows = table(spark, d, "lineitem").withColumnRenamed("l_quantity", "cited_by_count")
    cites = F.coalesce(F.col("cited_by_count").cast("bigint"), F.lit(0)) if "cited_by_count" in rows.columns else F.lit(0).cast("bigint")
    return rows.groupBy(dt.month_text(F.col("l_shipdate")).alias("month")).agg(F.count("*").alias("ai_papers"), F.sum(cites).alias("total_citations"), F.round(F.avg(cites), 6).alias("avg_citations"))


@query("""WITH v AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END AS a, CASE WHEN s_suppkey % 11 = 0 THEN 'NaN'::DOUBLE WHEN s_suppkey % 13 = 0 THEN 'Infinity'::DOUBLE ELSE s_acctbal / 2 END AS b FROM supplier)
  SELECT id, round(a, 4) AS a, round(b, 4) AS b FROM v WHERE a IS NOT NULL AND b IS NOT NULL AND isfinite(a) AND isfinite(b)""")
def finite_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose columns are all present, numbers and finite."""
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("a"), F.when(F.col("s_suppkey") % 11 == 0, float("nan")).when(F.col("s_suppkey") % 13 == 0, float("inf")).otherwise(F.col("s_acctbal") / 2).alias("b"))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return v.filter(reduce(and_, map(fine, ("a", "b")))).select("id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"""WITH c AS (SELECT id, unnest(codes) AS code FROM ({fm.SQL_CPC_DOCS})), f AS (SELECT id, CASE WHEN starts_with(code, 'G06F17/27') THEN 'G06F40/' || right(code, 1) ELSE code END AS code FROM c)
  SELECT split_part(code, '/', 1) AS family, count(DISTINCT id) AS docs, count(DISTINCT code) AS codes FROM f GROUP BY 1""")
def adopted_successors(spark: SparkSession, d: str) -> DataFrame:
    """Documents per code family after withdrawn codes were replaced by their successors."""
    c = fm.coded(spark, d).select("id", F.explode("codes").alias("code"))
    new = F.when(F.col("code").startswith("G06F17/27"), F.concat(F.lit("G06F40/"), F.right("code", F.lit(1)))).otherwise(F.col("code"))
    return c.select("id", new.alias("code")).groupBy(F.split_part("code", F.lit("/"), F.lit(1)).alias("family")).agg(F.countDistinct("id").alias("docs"), F.countDistinct("code").alias("codes"))


_TERMS = ("small 1W widget", "blue 1W ring", "re? gear")
_TERM_SQL = (r"(?i)\b(?:small)(?:\W+\w+){0,1}\W+(?:widget)", r"(?i)\b(?:blue)(?:\W+\w+){0,1}\W+(?:ring)", r"(?i)\b(?:re\w?\s+gear)")


@query(" UNION ALL ".join(f"SELECT '{t}' AS term, count(*) AS docs FROM ({fm.SQL_DOCS}) WHERE regexp_matches(text, '{r}')" for t, r in zip(_TERMS, _TERM_SQL, strict=True)))
def term_drivers(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each term alone decides; one pass over the texts."""
    hits = fm.patents(spark, d).select(*(F.col("text").rlike(terms_regex([t])).alias(f"t{i}") for i, t in enumerate(_TERMS)))
    wide = hits.agg(*(F.count_if(f"t{i}").alias(t) for i, t in enumerate(_TERMS)))
    return wide.unpivot([], list(_TERMS), "term", "docs")


@query(f"""WITH p AS ({mk.SQL_PORT}), m AS (SELECT month(m) AS mth, avg(vw) AS mean, count(*) AS n FROM p GROUP BY 1) SELECT mth, n, round(mean, 6) AS mean, round(mean / max(abs(mean)) OVER (), 6) AS scaled, round(100.0 * n / sum(n) OVER (), 4) AS share FROM m""")
def month_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mean return by calendar month, scaled to the largest for a common axis, and each month's share."""
    m = mk.portfolio(spark, d).groupBy(F.month("m").cast("bigint").alias("mth")).agg(F.avg("vw").alias("mean"), F.count("*").alias("n"))
    w = W.partitionBy()
    return m.select("mth", "n", F.round("mean", 6).alias("mean"), F.round(F.col("mean") / F.max(F.abs("mean")).over(w), 6).alias("scaled"), F.round(100.0 * F.col("n") / F.sum("n").over(w), 4).alias("share"))


@query(f"SELECT strftime(m, '%Y-%m') AS month, round(c, 6) AS centered, round(signum, 0) AS direction FROM (SELECT m, vw - avg(vw) OVER () AS c, CAST(sign(vw) AS DOUBLE) AS signum FROM ({mk.SQL_PORT})) QUALIFY row_number() OVER (ORDER BY abs(c) DESC, m) > 3")
def without_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Months but the three most extreme ones."""
    c = mk.portfolio(spark, d).select("m", (F.col("vw") - F.avg("vw").over(W.partitionBy())).alias("c"), F.signum("vw").alias("direction"))
    c = c.withColumn("r", F.row_number().over(W.orderBy(F.desc(F.abs("c")), "m"))).filter("r > 3")
    return c.select(mk.mstr(), F.round("c", 6).alias("centered"), "direction")
