"""Entities, intervals, rules, patents and collapsed firm panels.

Analogues on the driver tables: patents = orders, codes = brand and size of their parts, assignees = part and document names,
validity and fiscal periods = the days between order and shipping of a line, securities = line numbers of a supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import codes as cd
from quillspark.functions import dates as dt
from quillspark.functions import lexicon as lx
from quillspark.functions import names as nm
from quillspark.functions.proximity import terms_regex
from quillspark.operators import intervals as iv
from quillspark.operators import series as s
from quillspark.plans.registry import query
from quillspark.sources.tables import table

# --- intervals -------------------------------------------------------------------------------------------------------

SQL_IV = "SELECT o_custkey AS firm, o_orderkey * 10 + l_linenumber AS id, CAST(least(o_orderdate, l_shipdate) AS DATE) AS a, CAST(greatest(o_orderdate, l_shipdate) AS DATE) AS b, l_extendedprice AS xrd FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
SQL_Q = "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) AS DATE) AS q"


def periods(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.least("o_orderdate", "l_shipdate").cast("date"), F.greatest("o_orderdate", "l_shipdate").cast("date")
    return rows.select(F.col("o_custkey").alias("firm"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("id"), a.alias("a"), b.alias("b"), F.col("l_extendedprice").alias("xrd"))


def quarters(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-10-01").cast("date"), F.expr("interval 3 months"))).alias("q"))


@query(f"SELECT strftime(q, '%Y-%m-%d') AS quarter, count(*) AS n_rows, round(sum(xrd), 2) AS total FROM ({SQL_Q}) JOIN ({SQL_IV}) ON q BETWEEN a AND b GROUP BY 1")
def pit_interval_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sum over the intervals that hold a quarter's first day."""
    hit = iv.active_at(quarters(spark), periods(spark, d), "q", "a", "b")
    return hit.groupBy(F.col("q").cast("string").alias("quarter")).agg(F.count("*").alias("n_rows"), F.round(F.sum("xrd"), 2).alias("total"))


@query(f"""WITH h AS (SELECT q, firm, arg_max(xrd, (a, id, xrd)) AS xrd FROM ({SQL_Q}) JOIN ({SQL_IV}) ON q BETWEEN a AND b GROUP BY q, firm)
  SELECT strftime(q, '%Y-%m-%d') AS quarter, count(*) AS n_firms, round(sum(xrd), 2) AS total FROM h GROUP BY q""")
def asof_latest_active(spark: SparkSession, d: str) -> DataFrame:
    """Per firm only the active interval that started last, then the sum."""
    hit = iv.active_at(quarters(spark), periods(spark, d), "q", "a", "b")
    last = iv.latest_active(hit, ["q", "firm"], "a", ["id", "xrd"], ["xrd"])
    return last.groupBy(F.col("q").cast("string").alias("quarter")).agg(F.count("*").alias("n_firms"), F.round(F.sum("xrd"), 2).alias("total"))


SQL_YEAR = "SELECT o_custkey AS firm, year(o_orderdate) AS fy, sum(o_totalprice) AS xrd, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY ALL"


def fiscal(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("firm"), F.year("o_orderdate").alias("fy")).agg(F.sum("o_totalprice").alias("xrd"), F.max("o_orderdate").cast("date").alias("b"))
    return y.withColumn("a", dt.period_start(F.col("b"), 12))


SQL_FISCAL = f"SELECT *, CAST(b - INTERVAL 12 MONTH + INTERVAL 1 DAY AS DATE) AS a FROM ({SQL_YEAR})"


@query(f"""WITH f AS ({SQL_FISCAL}) SELECT firm, strftime(x, '%Y-%m-%d') AS x, strftime(lead(x) OVER (PARTITION BY firm ORDER BY x, kind, fy), '%Y-%m-%d') AS xend, round(xrd / 1e3, 1) AS y
  FROM (SELECT firm, fy, xrd, a AS x, 0 AS kind FROM f UNION ALL SELECT firm, fy, xrd, b, 1 FROM f)""")
def step_segments(spark: SparkSession, d: str) -> DataFrame:
    """Start and end of each fiscal period as points of a step line, with the next point."""
    f = fiscal(spark, d).withColumn("p", F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(0).alias("kind")), F.struct(F.col("b").alias("x"), F.lit(1).alias("kind")))))
    w = W.partitionBy("firm").orderBy("p.x", "p.kind", "fy")
    return f.select("firm", F.col("p.x").cast("string").alias("x"), F.lead("p.x").over(w).cast("string").alias("xend"), F.round(F.col("xrd") / 1e3, 1).alias("y"))


@query(f"""WITH f AS ({SQL_FISCAL}), e AS (SELECT DISTINCT a AS x FROM f UNION SELECT DISTINCT CAST(b + INTERVAL 1 DAY AS DATE) FROM f)
  SELECT strftime(x, '%Y-%m-%d') AS event, count(*) AS n_firms, round(sum(v), 2) AS total FROM (SELECT x, firm, arg_max(xrd, (a, fy)) AS v FROM e JOIN f ON x BETWEEN a AND b GROUP BY x, firm) GROUP BY x HAVING sum(v) > 0""")
def step_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Total of the latest active period of each firm, at every day where any period starts or has just ended."""
    spells = iv.latest_spells(fiscal(spark, d), ["firm"], "a", "b", ["fy"], "xrd")
    row = lambda first, last, n, value, event: F.struct(first.alias("first"), last.alias("last"), F.lit(n).alias("n_firms"), value.cast("double").alias("xrd"), F.lit(event).alias("events"))
    days = [row(x, x, 0, F.lit(None), 1) for x in (F.col("a"), F.date_add("b", 1))]
    rows = spells.select(F.inline(F.array(row(F.col("first"), F.col("last"), 1, F.col("xrd"), 0), *days)))
    found = iv.daily_sums(rows, "first", "last", ["n_firms", "xrd", "events"], "x").filter("events > 0 AND xrd > 0")
    return found.select(F.col("x").cast("string").alias("event"), "n_firms", F.round("xrd", 2).alias("total"))


@query("""SELECT o_custkey AS firm, year(o_orderdate) AS fy, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value, count(*) AS n_filings FROM orders WHERE o_orderstatus = 'F' AND (o_orderdate - date_trunc('year', o_orderdate)) BETWEEN INTERVAL 30 DAY AND INTERVAL 330 DAY GROUP BY ALL""")
def latest_filing_per_year(spark: SparkSession, d: str) -> DataFrame:
    """Of a firm's filings with a fitting span the latest of each year."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    span = F.datediff(F.col("o_orderdate"), F.trunc("o_orderdate", "YEAR"))
    return o.filter(span.between(30, 330)).groupBy(F.col("o_custkey").alias("firm"), F.year("o_orderdate").cast("bigint").alias("fy")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"), F.count("*").alias("n_filings"))


SQL_ALIAS = """SELECT 0 AS k, 'Brand#1' AS name, 'AAA' AS ticker, NULL AS a, DATE '1997-12-31' AS b, 'parent' AS tier UNION ALL SELECT 1, 'Brand#1', 'BBB', DATE '1998-01-01', NULL, 'parent'
  UNION ALL SELECT 2, 'Brand#2', 'AAA', NULL, NULL, 'subsidiary' UNION ALL SELECT 3, 'Brand#3', 'CCC', DATE '1996-06-01', DATE '2000-06-30', 'subsidiary' UNION ALL SELECT 4, 'Brand#4', 'CCC', NULL, NULL, 'parent'"""
SQL_OWNED = f"SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS filed, p_brand, ticker, tier FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ({SQL_ALIAS}) ON name = p_brand AND (a IS NULL OR l_shipdate >= a) AND (b IS NULL OR l_shipdate <= b)"


def aliases(spark: SparkSession) -> DataFrame:
    """Names of owners with validity; one brand changes hands, both bounds belong to their interval."""
    return spark.sql("SELECT * FROM VALUES ('Brand#1', 'AAA', NULL, DATE'1997-12-31', 'parent'), ('Brand#1', 'BBB', DATE'1998-01-01', NULL, 'parent'), ('Brand#2', 'AAA', NULL, NULL, 'subsidiary'), ('Brand#3', 'CCC', DATE'1996-06-01', DATE'2000-06-30', 'subsidiary'), ('Brand#4', 'CCC', NULL, NULL, 'parent') AS t(name, ticker, a, b, tier)")


def owned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("filed", F.col("l_shipdate").cast("date"))
    return rows.join(aliases(spark), (F.col("p_brand") == F.col("name")) & iv.valid_at(F.col("filed"), F.col("a"), F.col("b")))


@query(f"SELECT ticker, year(filed) AS y, count(*) AS n FROM ({SQL_OWNED}) GROUP BY ALL")
def alias_validity_join(spark: SparkSession, d: str) -> DataFrame:
    """Patents by the owner at their filing date."""
    return owned(spark, d).groupBy("ticker", F.year("filed").cast("bigint").alias("y")).agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT ticker, l_orderkey, filed, l_linenumber, unnest(CASE WHEN tier = 'parent' THEN ['parent_only', 'with_subs'] ELSE ['with_subs'] END) AS version FROM ({SQL_OWNED})),
  k AS (SELECT version, ticker, l_orderkey, arg_min(filed, (l_linenumber, filed)) AS filed FROM o GROUP BY ALL)
  SELECT version, ticker, year(filed) AS y, count(*) AS n FROM k GROUP BY ALL""")
def attribution_versions(spark: SparkSession, d: str) -> DataFrame:
    """Counts with and without subsidiaries; an application published several times counts by its least publication."""
    version = F.when(F.col("tier") == "parent", F.array(F.lit("parent_only"), F.lit("with_subs"))).otherwise(F.array(F.lit("with_subs")))
    best = owned(spark, d).withColumn("version", F.explode(version)).groupBy("version", "ticker", "l_orderkey").agg(F.min_by("filed", F.struct("l_linenumber", "filed")).alias("filed"))
    return best.groupBy("version", "ticker", F.year("filed").cast("bigint").alias("y")).agg(F.count("*").alias("n"))


# --- names -----------------------------------------------------------------------------------------------------------

_SUFFIXES = ("Technologies Inc", "INTERNATIONAL CO LTD", "Systems (OLD) Corp.", "Research Group", "Holdings", "")
SQL_NAMES = f"SELECT p_partkey AS id, trim('The ' || p_name || ' ' || [{', '.join(repr(x) for x in _SUFFIXES)}][1 + p_partkey % 6]) AS name FROM part"
_SHORT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.SHORT_FORMS.items())
_SQL_NORM = r"trim(regexp_replace(regexp_replace(upper({0}), '\((LAST KNOWN|NEW|OLD|DEL|POST|PRE)[^)]*\)', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g'))"
_SQL_CORE = f"""trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_SQL_NORM}, ' '), lambda t: CASE t {_SHORT} ELSE t END), ' '), '(^| )((({"|".join(lx.LEGAL)})( |$))+)$', ''), '^(THE( |$))+', ''))"""


def firm_names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("id"), F.trim(F.concat(F.lit("The "), "p_name", F.lit(" "), suffix)).alias("name"))


@query(f"SELECT id, {_SQL_NORM.format('name')} AS norm, {_SQL_CORE.format('name')} AS core FROM ({SQL_NAMES})")
def entity_core_key(spark: SparkSession, d: str) -> DataFrame:
    return firm_names(spark, d).select("id", nm.norm(F.col("name")).alias("norm"), nm.core(F.col("name")).alias("core"))


SQL_ROSTER = f"SELECT DISTINCT {_SQL_CORE.format('name')} AS core FROM ({SQL_NAMES})"
SQL_DICT = f"SELECT name AS assignee, {_SQL_CORE.format('name')} AS akey, count(*) AS n FROM ({SQL_NAMES}) GROUP BY ALL"
SQL_TIERS = f"""SELECT core, assignee, n, CASE WHEN akey = core THEN 'T1_EXACT' WHEN len(string_split(core, ' ')) = 1 AND length(core) < 5 THEN 'T3_REVIEW' WHEN starts_with(akey, core || ' ') THEN 'T2_PREFIX' ELSE 'T3_REVIEW' END AS tier, akey
  FROM (SELECT * FROM ({SQL_ROSTER}) UNION SELECT split_part(core, ' ', 1) FROM ({SQL_ROSTER})) JOIN ({SQL_DICT}) ON split_part(core, ' ', 1) = split_part(akey, ' ', 1)"""


def tiers(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each core key of the whole roster, blocked by the first word: exact, word-boundary prefix, or for review.

    Single generic or short words aren't taken by prefix.
    """
    named = firm_names(spark, d)
    names = named.groupBy(F.col("name").alias("assignee"), nm.core(F.col("name")).alias("akey")).agg(F.count("*").alias("n"))
    roster = names.select(F.col("akey").alias("core")).distinct()
    roster = roster.union(roster.select(F.split_part("core", F.lit(" "), F.lit(1)))).distinct()
    pairs = roster.withColumn("head", F.split_part("core", F.lit(" "), F.lit(1))).join(names.withColumn("head", F.split_part("akey", F.lit(" "), F.lit(1))), "head")
    risky = ~F.col("core").contains(" ") & (F.col("core").isin(*lx.GENERIC) | (F.length("core") < lx.CORE_MIN))
    prefix = F.startswith("akey", F.concat("core", F.lit(" ")))
    tier = F.when(F.col("akey") == F.col("core"), "T1_EXACT").when(risky, "T3_REVIEW").when(prefix, "T2_PREFIX").otherwise("T3_REVIEW")
    return pairs.select("core", "assignee", "n", tier.alias("tier"), "akey")


@query(f"SELECT core, assignee, n, tier FROM ({SQL_TIERS})")
def entity_tiers(spark: SparkSession, d: str) -> DataFrame:
    return tiers(spark, d).select("core", "assignee", "n", "tier")


_FL = sorted(set(lx.FUNCTIONAL) | set(lx.LEGAL))


@query(f"""WITH t AS ({SQL_TIERS}), h AS (SELECT split_part(core, ' ', 1) AS head, count(DISTINCT core) AS shared FROM t GROUP BY 1)
  SELECT core, assignee, CASE WHEN shared > 1 AND starts_with(akey || ' ', core || ' ') THEN 'CHECK' WHEN shared > 1 THEN 'EXCLUDE' WHEN NOT starts_with(akey || ' ', core || ' ') THEN 'CHECK' WHEN akey = core THEN 'INCLUDE'
    WHEN list_has_all([{', '.join(repr(x) for x in _FL)}], string_split(trim(substr(akey, length(core) + 1)), ' ')) THEN 'INCLUDE' ELSE 'CHECK' END AS suggestion
  FROM t JOIN h ON head = split_part(core, ' ', 1) WHERE tier <> 'T1_EXACT'""")
def entity_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for names under review: by whether the head is shared, the prefix fits, and only functional words follow."""
    t = tiers(spark, d)
    head = F.split_part("core", F.lit(" "), F.lit(1))
    shared = t.groupBy(head.alias("head")).agg(F.countDistinct("core").alias("shared"))
    fits = F.startswith(F.concat("akey", F.lit(" ")), F.concat("core", F.lit(" ")))
    rest = F.split(F.trim(F.substr("akey", F.length("core") + 1)), " ")
    known = F.array(*map(F.lit, _FL))
    word = F.when((F.col("shared") > 1) & fits, "CHECK").when(F.col("shared") > 1, "EXCLUDE").when(~fits, "CHECK").when(F.col("akey") == F.col("core"), "INCLUDE").when(F.forall(rest, lambda x: F.array_contains(known, x)), "INCLUDE").otherwise("CHECK")
    return t.filter("tier <> 'T1_EXACT'").withColumn("head", head).join(shared, "head").select("core", "assignee", word.alias("suggestion"))


_STRICT = ", ".join(repr(x) for x in lx.LEGAL_STRICT)
SQL_TOKENS = rf"""SELECT x, count(DISTINCT t[1]) AS follow, count(*) AS n, avg(CAST(len(list_intersect(t, [{_STRICT}])) > 0 AS INT)) AS legal FROM (SELECT t, unnest(list_distinct(t[2:])) AS x FROM (SELECT string_split(trim(regexp_replace(upper(regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g')), '[^A-Z0-9]+', ' ', 'g')), ' ') AS t FROM documents WHERE text IS NOT NULL)) GROUP BY x"""


def token_stats(rows: DataFrame, name: Column) -> DataFrame:
    """Of each word: how many different first words it follows, and how often its name has a legal form."""
    t = rows.select(F.split(nm.words_of(name), " ").alias("t"))
    rest = F.array_distinct(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))))
    once = t.select(F.element_at("t", 1).alias("first"), nm.has_legal(F.col("t")).alias("legal"), rest.alias("rest"))  # not once a word
    each = once.select("first", "legal", F.explode("rest").alias("x"))
    return each.groupBy("x").agg(F.countDistinct("first").alias("follow"), F.count("*").alias("n"), F.avg(F.col("legal").cast("int")).alias("legal"))


@query(f"SELECT x, follow, n, round(legal, 6) AS legal FROM ({SQL_TOKENS}) WHERE n >= 3")
def token_follow_stats(spark: SparkSession, d: str) -> DataFrame:
    """A document's whole text stands for a name here."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return token_stats(docs, F.regexp_replace("text", r"[^\x00-\x7F]+", " ")).filter("n >= 3").select("x", "follow", "n", F.round("legal", 6).alias("legal"))


SQL_PEOPLE = "SELECT o_orderkey AS id, ['SMITH JOHN', 'RIGETTI CHAD T', 'NOVOZYMES AS', 'UNIV CHUNG YUAN CHRISTIAN', 'ACME', 'LEE ANNA MARIA', 'SMITH WIDGETS'][1 + o_orderkey % 7] AS name FROM orders"
_GIVEN = "['ANNA', 'CHAD', 'CHRISTIAN', 'JOHN', 'MARIA']"
_INST = ", ".join(repr(x) for x in lx.INSTITUTIONS)


@query(f"""SELECT name, count(*) AS n, len(t) BETWEEN 2 AND 4 AND len(list_intersect(t, [{_STRICT}])) = 0 AND len(list_intersect(t, [{_INST}])) = 0
  AND len(list_filter(t[2:], lambda x: NOT (list_contains({_GIVEN}, x) OR regexp_full_match(x, '[A-Z]')))) = 0 AS person FROM (SELECT name, string_split(name, ' ') AS t FROM ({SQL_PEOPLE})) GROUP BY ALL""")
def person_flag(spark: SparkSession, d: str) -> DataFrame:
    names = ("SMITH JOHN", "RIGETTI CHAD T", "NOVOZYMES AS", "UNIV CHUNG YUAN CHRISTIAN", "ACME", "LEE ANNA MARIA", "SMITH WIDGETS")
    rows = table(spark, d, "orders").select(F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("name"))
    given = F.array(*map(F.lit, ("ANNA", "CHAD", "CHRISTIAN", "JOHN", "MARIA")))
    return rows.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", nm.is_person(F.col("name"), given).alias("person"))


_PATTERNS = (("G1", "^small( |$)"), ("G2", "^(red|blue)( |$)"), ("G3", "ring$"))
SQL_GROUPS = "SELECT p_partkey, p_name, p_brand, " + "CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}') THEN '{g}'" for g, p in _PATTERNS) + " END AS parent, p_brand IN ('Brand#1', 'Brand#2') AS ict FROM part"


def grouped_parts(spark: SparkSession, d: str) -> DataFrame:
    parent = F.coalesce(*(F.when(F.col("p_name").rlike(p), g) for g, p in _PATTERNS))
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", parent.alias("parent"), F.col("p_brand").isin("Brand#1", "Brand#2").alias("ict"))


@query(f"""SELECT CASE WHEN parent IS NOT NULL AND ict THEN 'A' WHEN parent IS NOT NULL THEN 'B' WHEN ict THEN 'C' ELSE 'D' END AS grp, strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT l_orderkey) AS papers, count(DISTINCT p_brand) AS n_firms
  FROM lineitem JOIN ({SQL_GROUPS}) ON l_partkey = p_partkey GROUP BY ALL""")
def group_abcd(spark: SparkSession, d: str) -> DataFrame:
    """Groups by ordered patterns (the first that fits) and membership; distinct papers and firms per month."""
    g = F.when(F.col("parent").isNotNull() & F.col("ict"), "A").when(F.col("parent").isNotNull(), "B").when(F.col("ict"), "C").otherwise("D")
    rows = table(spark, d, "lineitem").join(grouped_parts(spark, d).withColumn("grp", g), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("grp", dt.month_text(F.col("l_shipdate")).alias("month")).agg(F.countDistinct("l_orderkey").alias("papers"), F.countDistinct("p_brand").alias("n_firms"))


@query(f"SELECT p_name, count(*) AS n FROM ({SQL_GROUPS}) WHERE p_brand NOT IN (SELECT p_brand FROM ({SQL_GROUPS}) WHERE parent = 'G3' AND p_brand < 'Brand#2') GROUP BY 1")
def unmatched_names(spark: SparkSession, d: str) -> DataFrame:
    """Names without a match, by anti-join."""
    g = grouped_parts(spark, d)
    matched = g.filter("parent = 'G3' AND p_brand < 'Brand#2'").select("p_brand").distinct()
    return g.join(matched, "p_brand", "left_anti").groupBy("p_name").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT c_nationkey AS permco, c_mktsegment AS tic, o_totalprice AS x, date_trunc('month', o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey),
  t AS (SELECT permco, tic, count(*) AS n FROM e GROUP BY ALL)
  SELECT permco, count(*) AS papers, strftime(min(m), '%Y-%m') AS ym_min, strftime(max(m), '%Y-%m') AS ym_max, count(DISTINCT m) AS months, (SELECT string_agg(tic, '|' ORDER BY n DESC, tic) FROM t WHERE t.permco = e.permco) AS all_tickers,
    (SELECT string_agg(DISTINCT tic, ',' ORDER BY tic) FROM t WHERE t.permco = e.permco) AS groups FROM e GROUP BY permco""")
def firm_roster(spark: SparkSession, d: str) -> DataFrame:
    """One row per firm: names by frequency, set of groups, first and last month."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = rows.select(F.col("c_nationkey").alias("permco"), F.col("c_mktsegment").alias("tic"), dt.month(F.col("o_orderdate")).alias("m"))
    t = e.groupBy("permco", "tic").agg(F.count("*").alias("n"))
    by = t.groupBy("permco").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tic"))).alias("t"), F.array_join(F.array_sort(F.collect_set("tic")), ",").alias("groups"))
    by = by.select("permco", F.array_join(F.transform("t", lambda x: x["tic"]), "|").alias("all_tickers"), "groups")
    f = e.groupBy("permco").agg(F.count("*").alias("papers"), F.date_format(F.min("m"), "yyyy-MM").alias("ym_min"), F.date_format(F.max("m"), "yyyy-MM").alias("ym_max"), F.countDistinct("m").alias("months"))
    return f.join(by, "permco")


# --- codes and rules -------------------------------------------------------------------------------------------------

RULES = cd.CodeRules.parse("Brand#1/5 Brand#2/7, Brand#3+ Brand#4/12:Brand#4/27")
C1 = cd.CodeRules.parse("Brand#5+ Brand#6/1:Brand#6/2")
_CODE = "p_brand || '/' || p_size"


def _pad(a: str, b: str) -> str:
    n = f"CAST(greatest(length({a}), length({b})) AS INTEGER)"
    return f"rpad({a}, {n}, '0') >= rpad({b}, {n}, '0')"


def _rule_sql(r: cd.CodeRules, c: str = "code") -> str:
    sub, head = f"split_part({c}, '/', 2)", f"split_part({c}, '/', 1)"
    tests = [f"{c} = '{x}'" for x in r.exact] + [f"starts_with({c}, '{x}')" for x in r.prefix]
    lit = "'{}'"
    tests += [f"({head} = '{h}' AND {_pad(sub, lit.format(lo))} AND {_pad(lit.format(hi), sub)})" for h, lo, hi in r.range]
    return "(" + " OR ".join(tests) + ")"


@query(f"SELECT code, count(*) AS n, {_rule_sql(RULES)} AS block1, {_rule_sql(C1)} AS c1 FROM (SELECT {_CODE} AS code FROM part) GROUP BY ALL")
def code_matcher(spark: SparkSession, d: str) -> DataFrame:
    """Rules are tested once per distinct code."""
    codes = table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("code")).agg(F.count("*").alias("n"))
    return codes.select("code", "n", RULES.matches(F.col("code")).alias("block1"), C1.matches(F.col("code")).alias("c1"))


SQL_DOCS = f"SELECT l_orderkey AS id, list_sort(list_distinct(list({_CODE}))) AS codes, string_agg(p_name, ' ' ORDER BY p_name, p_partkey) AS text, min(l_shipdate) AS filed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"


def patents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as patents: sorted distinct codes, and a text of their parts' names."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    code = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    g = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(code)).alias("codes"), F.array_sort(F.collect_list(F.struct("p_name", "p_partkey"))).alias("t"), F.min("l_shipdate").alias("filed"))
    return g.select("id", "codes", F.array_join(F.transform("t", lambda x: x["p_name"]), " ").alias("text"), "filed")


_K1, _K2 = ["small 1W widget", "re? gear"], ["blue 2D ring", "gizmo+"]
_R1, _R2 = r"(?i)\b(?:(?:(?:small)(?:\W+\w+){0,1}\W+(?:widget))|(?:(?:re\w?\s+gear)))", r"(?i)\b(?:(?:(?:blue)(?:\W+\w+){0,2}\W+(?:ring)|(?:ring)(?:\W+\w+){0,2}\W+(?:blue))|(?:(?:gizmo\w*)))"
SQL_RULES = f"""SELECT *, len(list_filter(codes, lambda code: {_rule_sql(RULES)})) > 0 AS b1, regexp_matches(text, '{_R1}') AS k1, regexp_matches(text, '{_R2}') AND len(list_filter(codes, lambda code: {_rule_sql(C1)})) > 0 AS k2c FROM ({SQL_DOCS})"""


def classified(spark: SparkSession, d: str) -> DataFrame:
    """Decision by codes, or deciding terms, or general terms together with a code; and what it rests on."""
    p = patents(spark, d)
    flags = p.select("*", F.exists("codes", RULES.matches).alias("b1"), F.col("text").rlike(terms_regex(_K1)).alias("k1"), (F.exists("codes", C1.matches) & F.col("text").rlike(terms_regex(_K2))).alias("k2c"))
    basis = F.concat_ws(",", F.when(F.col("b1"), "block1"), F.when(F.col("k1"), "block2"), F.when(F.col("k2c"), "block3"))
    return flags.withColumn("basis", basis)


@query(f"SELECT id, codes[1:10] AS codes, concat_ws(',', CASE WHEN b1 THEN 'block1' END, CASE WHEN k1 THEN 'block2' END, CASE WHEN k2c THEN 'block3' END) AS basis FROM ({SQL_RULES}) WHERE b1 OR k1 OR k2c".replace("codes[1:10] AS codes", "array_to_string(codes[1:10], ';') AS codes"))
def rule_blocks(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).filter("b1 OR k1 OR k2c").select("id", F.array_join(F.slice("codes", 1, 10), ";").alias("codes"), "basis")


@query(f"SELECT basis, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN b1 THEN 'block1' END, CASE WHEN k1 THEN 'block2' END, CASE WHEN k2c THEN 'block3' END) AS basis FROM ({SQL_RULES})) GROUP BY 1")
def block_overlap(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).groupBy("basis").agg(F.count("*").alias("n"))


_HEADS = ("G06N3/", "G06N20/", "G06F17/27", "G06V1/", "H04L9/", "G10L1/", "A61B5/")
SQL_CPC = f"[{', '.join(repr(x) for x in _HEADS)}][1 + l_partkey % 7] || l_suppkey % 10"
SQL_CPC_DOCS = f"SELECT l_orderkey AS id, min(year(l_shipdate)) AS y, list_sort(list_distinct(list({SQL_CPC}))) AS codes FROM lineitem GROUP BY l_orderkey"


def coded(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("l_partkey") % 7 + 1).cast("int")), (F.col("l_suppkey") % 10).cast("string"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.year("l_shipdate")).cast("bigint").alias("y"), F.array_sort(F.collect_set(code)).alias("codes"))


_FIELD_SQL = "CASE " + " ".join(f"WHEN len(list_filter(codes, lambda c: {' OR '.join(f'''starts_with(c, '{p}')''' for p in ps)})) > 0 THEN '{n}'" for n, ps in lx.FIELDS) + " ELSE 'other' END"


@query(f"SELECT {_FIELD_SQL} AS field, y, count(*) AS n FROM ({SQL_CPC_DOCS}) GROUP BY ALL")
def field_label(spark: SparkSession, d: str) -> DataFrame:
    return coded(spark, d).groupBy(cd.field_label(F.col("codes")).alias("field"), "y").agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT unnest(list_filter(codes, lambda c: starts_with(c, 'G06F17/27'))) AS old FROM ({SQL_CPC_DOCS})), n AS (SELECT old, count(*) AS docs FROM o GROUP BY old),
  p AS (SELECT d.id, o.old, x.new FROM (SELECT id, codes FROM ({SQL_CPC_DOCS})) d, unnest(list_filter(d.codes, lambda c: starts_with(c, 'G06F17/27'))) AS o(old), unnest(list_filter(d.codes, lambda c: NOT starts_with(c, 'G06F17/27'))) AS x(new)),
  c AS (SELECT old, new, count(*) AS together FROM p GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY together DESC, new) AS k FROM c)
  SELECT old, new, together, docs, round(together / docs, 6) AS share, CAST(row_number() OVER (PARTITION BY old ORDER BY k) AS BIGINT) AS rank FROM r JOIN n USING (old) WHERE k <= 30 AND together / docs >= 0.05 QUALIFY row_number() OVER (PARTITION BY old ORDER BY k) <= 8""")
def cooccurrence_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Codes that stand beside a withdrawn one: the first 30 by count, those with a sufficient share, eight at most."""
    docs = coded(spark, d)
    old = lambda c: c.startswith("G06F17/27")
    each = docs.select("codes", F.explode(F.filter("codes", old)).alias("old"))
    n = each.groupBy("old").agg(F.count("*").alias("docs"))
    c = each.select("old", F.explode(F.filter("codes", lambda c: ~old(c))).alias("new")).groupBy("old", "new").agg(F.count("*").alias("together"))
    k = c.withColumn("k", F.row_number().over(W.partitionBy("old").orderBy(F.desc("together"), "new"))).filter("k <= 30").join(n, "old")
    k = k.withColumn("share", F.col("together") / F.col("docs")).filter("share >= 0.05").withColumn("rank", F.row_number().over(W.partitionBy("old").orderBy("k")).cast("bigint")).filter("rank <= 8")
    return k.select("old", "new", "together", "docs", F.round("share", 6).alias("share"), "rank")


@query(f"""SELECT code, CASE WHEN starts_with(code, 'G06F17/27') THEN 'nlp' WHEN starts_with(code, 'G06N') THEN 'ml' ELSE 'none' END AS family, count(*) AS n FROM (SELECT DISTINCT unnest(codes) AS code FROM ({SQL_CPC_DOCS}))
  WHERE code NOT IN (SELECT unnest(codes) FROM ({SQL_CPC_DOCS}) WHERE y >= 2001) OR starts_with(code, 'G06') GROUP BY ALL""")
def dead_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes that the current scheme doesn't have (by anti-join), and rule families."""
    docs = coded(spark, d)
    all_ = docs.select(F.explode("codes").alias("code")).distinct()
    gone = all_.join(docs.filter("y >= 2001").select(F.explode("codes").alias("code")).distinct(), "code", "left_anti")
    rows = gone.union(all_.filter("code LIKE 'G06%'")).distinct()
    family = F.when(F.col("code").startswith("G06F17/27"), "nlp").when(F.col("code").startswith("G06N"), "ml").otherwise("none")
    return rows.groupBy("code", family.alias("family")).agg(F.count("*").alias("n"))


@query(f"SELECT y, count(*) FILTER (len(list_filter(codes, lambda c: starts_with(c, 'G06N'))) > 0) AS ml, count(*) FILTER (len(list_filter(codes, lambda c: starts_with(c, 'G06F17/27'))) > 0) AS nlp, count(*) FILTER (len(list_filter(codes, lambda c: starts_with(c, 'G10L'))) > 0) AS speech FROM ({SQL_CPC_DOCS}) GROUP BY y")
def family_drift(spark: SparkSession, d: str) -> DataFrame:
    """Documents per year with any code of a family; one pass."""
    has = lambda p: F.count_if(F.exists("codes", lambda c: c.startswith(p)))
    return coded(spark, d).groupBy("y").agg(has("G06N").alias("ml"), has("G06F17/27").alias("nlp"), has("G10L").alias("speech"))


# --- collapsed panels ------------------------------------------------------------------------------------------------

SQL_SEC = "SELECT l_suppkey AS permco, l_linenumber AS permno, year(l_shipdate) * 12 + month(l_shipdate) AS t, year(l_shipdate) AS y, sum(l_extendedprice) AS cap, avg(l_discount) - 0.0437 AS ret, count(*) AS papers FROM lineitem GROUP BY ALL"
SQL_MULTI = f"SELECT permco, t, y, arg_max(ret, (cap, -permno)) AS ret, CAST(sum(papers) AS BIGINT) AS papers, count(*) AS n_securities FROM ({SQL_SEC}) GROUP BY ALL"


def securities(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("permco"), F.col("l_linenumber").alias("permno"), dt.month_index(F.col("l_shipdate")).alias("t"), F.year("l_shipdate").cast("bigint").alias("y")).agg(F.sum("l_extendedprice").alias("cap"), (F.avg("l_discount") - 0.0437).alias("ret"), F.count("*").alias("papers"))


def firm_months(spark: SparkSession, d: str) -> DataFrame:
    """Several securities of a firm: the return of the largest, the sum of the papers."""
    return securities(spark, d).groupBy("permco", "t", "y").agg(F.max_by("ret", F.struct("cap", -F.col("permno"))).alias("ret"), F.sum("papers").alias("papers"), F.count("*").alias("n_securities"))


@query(f"SELECT permco, CAST(t AS BIGINT) AS t, round(ret, 6) AS ret, papers, n_securities FROM ({SQL_MULTI})")
def multi_security_collapse(spark: SparkSession, d: str) -> DataFrame:
    return firm_months(spark, d).select("permco", F.col("t").cast("bigint").alias("t"), F.round("ret", 6).alias("ret"), "papers", "n_securities")


SQL_INDEX = f"SELECT t, avg(ret) AS idx FROM ({SQL_MULTI}) GROUP BY t"
SQL_ANNUAL = f"SELECT permco, y, product(1 + ret) - 1 AS r, product(1 + idx) - 1 AS ri, CAST(sum(papers) AS BIGINT) AS papers, count(*) AS months FROM ({SQL_MULTI}) JOIN ({SQL_INDEX}) USING (t) GROUP BY ALL"


def annual(spark: SparkSession, d: str) -> DataFrame:
    f = firm_months(spark, d)
    idx = f.groupBy("t").agg(F.avg("ret").alias("idx"))
    return f.join(idx, "t").groupBy("permco", "y").agg(s.compounded(F.col("ret")).alias("r"), s.compounded(F.col("idx")).alias("ri"), F.sum("papers").alias("papers"), F.count("*").alias("months"))


@query(f"SELECT permco, y, round(r, 6) AS ret, round(ri, 6) AS idx, round(r - ri, 6) AS excess, months FROM ({SQL_ANNUAL})")
def annual_compounding(spark: SparkSession, d: str) -> DataFrame:
    return annual(spark, d).select("permco", "y", F.round("r", 6).alias("ret"), F.round("ri", 6).alias("idx"), F.round(F.col("r") - F.col("ri"), 6).alias("excess"), "months")


SQL_AI = f"SELECT l_suppkey AS permco, year(l_shipdate) AS y, count(DISTINCT l_orderkey) AS n_all, count(DISTINCT l_orderkey) FILTER ({_rule_sql(RULES)}) AS n_ai FROM (SELECT l_suppkey, l_shipdate, l_orderkey, {_CODE} AS code FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL"
SQL_BAL = f"""SELECT permco, y, coalesce(n_ai, 0) AS n_ai, coalesce(n_all, 0) AS n_all, n_ai / n_all AS ai_share, r, r - ri AS excess, CAST(y >= 2000 AS INT) AS truncated FROM (SELECT permco, y FROM (SELECT s_suppkey AS permco FROM supplier), (SELECT unnest(range(1995, 2003)) AS y)) LEFT JOIN ({SQL_AI}) USING (permco, y) LEFT JOIN ({SQL_ANNUAL}) USING (permco, y)"""


def balanced(spark: SparkSession, d: str) -> DataFrame:
    """All firms and years: counts are 0 where there is nothing, returns stay missing."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ai = RULES.matches(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))
    n = rows.groupBy(F.col("l_suppkey").alias("permco"), F.year("l_shipdate").cast("bigint").alias("y")).agg(F.countDistinct("l_orderkey").alias("n_all"), F.countDistinct(F.when(ai, F.col("l_orderkey"))).alias("n_ai"))
    years = spark.range(1995, 2003).select(F.col("id").alias("y"))
    grid = s.filled_grid([table(spark, d, "supplier").select(F.col("s_suppkey").alias("permco")), years], n, ["permco", "y"], {"n_ai": 0, "n_all": 0})
    b = grid.join(annual(spark, d), ["permco", "y"], "left")
    return b.select("permco", "y", "n_ai", "n_all", F.try_divide("n_ai", "n_all").alias("ai_share"), "r", (F.col("r") - F.col("ri")).alias("excess"), (F.col("y") >= 2000).cast("int").alias("truncated"))


@query(f"SELECT permco, y, n_ai, n_all, round(ai_share, 4) AS ai_share, round(r, 6) AS ret, round(excess, 6) AS excess, truncated FROM ({SQL_BAL})")
def balanced_panel(spark: SparkSession, d: str) -> DataFrame:
    return balanced(spark, d).select("permco", "y", "n_ai", "n_all", F.round("ai_share", 4).alias("ai_share"), F.round("r", 6).alias("ret"), F.round("excess", 6).alias("excess"), "truncated")


@query(f"SELECT count(*) AS n, count(r) AS n_ret, count_if(n_all > 0) AS n_pat, count_if(n_ai > 0) AS n_ai, round(avg(ai_share), 6) AS mean_share, round(sum(n_ai) / sum(n_all), 6) AS total_share FROM ({SQL_BAL})")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return balanced(spark, d).agg(F.count("*").alias("n"), F.count("r").alias("n_ret"), F.count_if(F.col("n_all") > 0).alias("n_pat"), F.count_if(F.col("n_ai") > 0).alias("n_ai"), F.round(F.avg("ai_share"), 6).alias("mean_share"), F.round(F.sum("n_ai") / F.sum("n_all"), 6).alias("total_share"))


@query("""WITH o AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1), w AS (SELECT s_nationkey AS k, count(*) * 10 AS n FROM supplier WHERE s_nationkey <> 4 GROUP BY 1)
  SELECT k, coalesce(o.n, 0) AS old_n, coalesce(w.n, 0) AS new_n, coalesce(w.n, 0) < coalesce(o.n, 0) AS dropped FROM o FULL JOIN w USING (k)""")
def regression_guard(spark: SparkSession, d: str) -> DataFrame:
    """Counts against a baseline over all keys of either; a drop is a failure."""
    o = table(spark, d, "customer").filter("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("o"))
    w = table(spark, d, "supplier").filter("s_nationkey <> 4").groupBy(F.col("s_nationkey").alias("k")).agg((F.count("*") * 10).alias("w"))
    j = o.join(w, "k", "full_outer").fillna(0)
    return j.select("k", F.col("o").alias("old_n"), F.col("w").alias("new_n"), (F.col("w") < F.col("o")).alias("dropped"))


# --- sets, arrays, dates, strings ------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
  SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("except", a.subtract(b)))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(avg(value), 6) AS mean, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY ALL""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON column by schema, and the last event of each group."""
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"] % 10)
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("""SELECT l_orderkey AS id, list_sort(list_distinct(list(p_type))) AS types, len(list_filter(list(p_size), lambda x: x > 45)) > 0 AS any_large, len(list_filter(list(p_size), lambda x: x <= 5)) = 0 AS all_above, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""".replace("list_sort(list_distinct(list(p_type))) AS types", "array_to_string(list_sort(list_distinct(list(p_type))), ';') AS types"))
def array_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("p_type").alias("t"), F.collect_list("p_size").alias("z"), F.count("*").alias("n"))
    return g.select("id", F.array_join(F.array_sort(F.array_distinct("t")), ";").alias("types"), F.exists("z", lambda x: x > 45).alias("any_large"), F.forall("z", lambda x: x > 5).alias("all_above"), "n")


@query("""SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label,
  CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS idx, strftime(o_orderdate - INTERVAL 12 MONTH, '%Y-%m-%d') AS year_before, strftime(o_orderdate - INTERVAL 3 MONTH + INTERVAL 1 DAY, '%Y-%m-%d') AS quarter_start, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before FROM orders""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    text = lambda c, n: c.cast("string").alias(n)
    return o.select("id", text(dt.month(F.col("d")), "month"), text(F.trunc("d", "quarter"), "quarter"), dt.quarter_text(F.col("d")).alias("label"), dt.month_index(F.col("d")).cast("bigint").alias("idx"), text(F.add_months("d", -12), "year_before"), text(dt.period_start(F.col("d"), 3), "quarter_start"), text(F.date_sub("d", 1), "day_before"))


@query(r"""SELECT p_partkey AS id, regexp_replace(p_name || ' (United States)', '\s*\([^)]+\)\s*$', '') AS no_country, trim(regexp_replace(regexp_replace(upper(p_name || ', Inc.'), '[,.]', '', 'g'), '\s+(INC|CORP|CORPORATION|LTD|LIMITED|LLC|CO|COMPANY|PLC|HOLDINGS|GROUP)$', '')) AS clean,
  lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, split_part(p_name, ' ', 1) AS first_token, len(string_split(p_name, ' ')) AS n_tokens, printf('%+.4f', p_retailprice) AS printed FROM part""")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), nm.without_country(F.concat("p_name", F.lit(" (United States)"))).alias("no_country"), nm.clean_once(F.concat("p_name", F.lit(", Inc."))).alias("clean"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_token"), F.size(F.split("p_name", " ")).cast("bigint").alias("n_tokens"), F.format_string("%+.4f", "p_retailprice").alias("printed"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, dup FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 50) AS dup, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 50 ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1 AND dup >= 2""")
def dedup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key by an explicit order, of keys with two rows at least."""
    li = table(spark, d, "lineitem").withColumn("k", F.col("l_partkey") % 50)
    dup = li.withColumn("dup", F.count("*").over(W.partitionBy("l_orderkey", "k")))
    return s.first_match(dup.filter("dup >= 2"), ["l_orderkey", "k"], F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "dup")


@query("""WITH s AS (SELECT p_brand AS name, 'AAA' AS t, 1 AS prio FROM part WHERE p_size < 10 UNION SELECT p_brand, 'BBB', 2 FROM part WHERE p_size < 20 UNION SELECT p_brand, 'CCC', 0 FROM part WHERE p_size = 30)
  SELECT name, t FROM (SELECT name, t, row_number() OVER (PARTITION BY name ORDER BY prio) AS r FROM s WHERE (name, t) NOT IN (SELECT 'Brand#3', 'CCC')) WHERE r = 1""")
def overlay_with_veto(spark: SparkSession, d: str) -> DataFrame:
    """Sources laid over each other by priority, after pairs that were vetoed are gone."""
    p = table(spark, d, "part")
    src = lambda where, t, prio: p.filter(where).select(F.col("p_brand").alias("name"), F.lit(t).alias("t"), F.lit(prio).alias("prio")).distinct()
    all_ = src("p_size < 10", "AAA", 1).unionByName(src("p_size < 20", "BBB", 2)).unionByName(src("p_size = 30", "CCC", 0))
    veto = spark.sql("SELECT 'Brand#3' AS name, 'CCC' AS t")
    return s.first_match(all_.join(veto, ["name", "t"], "left_anti"), ["name"], F.col("prio")).select("name", "t")
