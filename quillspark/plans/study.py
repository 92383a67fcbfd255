"""Steps of the study on the driver tables: paper filter, publication texts, denominators, concordance, tests with errors.

Analogues: papers and publications = orders, their categories, titles and codes = those of their lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import codes as cd
from quillspark.functions import dates as dt
from quillspark.functions import lexicon as lx
from quillspark.functions.proximity import terms_regex
from quillspark.functions.tail_columns import f_upper, sql_f_upper, sql_t_two_sided, t_two_sided
from quillspark.operators import resolution as rs
from quillspark.operators import series as s
from quillspark.plans import estimation as et
from quillspark.plans import firms as fm
from quillspark.plans import market as mk
from quillspark.plans.registry import query
from quillspark.sources.remote import first_reported
from quillspark.sources.tables import table

# --- papers ----------------------------------------------------------------------------------------------------------

_CATEGORIES = (*lx.SUBFIELD, "math.CO", "cs.DB", "econ.EM")
SQL_PAPERS = f"SELECT l_orderkey AS id, string_agg(DISTINCT [{', '.join(map(repr, _CATEGORIES))}][1 + l_partkey % {len(_CATEGORIES)}], ' ') AS categories, min(l_shipdate) AS updated, CAST(sum(l_quantity) AS BIGINT) AS cited FROM lineitem GROUP BY 1"
_AI = r"\b(" + "|".join(c.replace(".", r"\.") for c in lx.AI_CATEGORIES) + r")\b"


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their categories, blank between, the date of the last update and citations."""
    category = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("l_partkey") % len(_CATEGORIES) + 1).cast("int"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_set(category), " ").alias("categories"), F.min("l_shipdate").alias("updated"), F.sum("l_quantity").cast("bigint").alias("cited"))


def is_ai(categories: Column) -> Column:
    """Whether any of the categories, whole words, is an AI category."""
    return categories.rlike(_AI)


@query(f"SELECT strftime(updated, '%Y-%m') AS month, count(*) AS ai_papers, CAST(sum(cited) AS BIGINT) AS total_citations, round(avg(cited), 6) AS avg_citations FROM ({SQL_PAPERS}) WHERE updated >= DATE '1996-01-01' AND regexp_matches(categories, '{_AI}') GROUP BY 1")
def ai_paper_months(spark: SparkSession, d: str) -> DataFrame:
    """Papers since a date that have an AI category, and their citations, by month."""
    ai = papers(spark, d).filter((F.col("updated") >= "1996-01-01") & is_ai(F.col("categories")))
    return ai.groupBy(dt.month_text(F.col("updated")).alias("month")).agg(F.count("*").alias("ai_papers"), F.sum("cited").alias("total_citations"), F.round(F.avg("cited"), 6).alias("avg_citations"))


_LABEL = "CASE " + " ".join(f"WHEN list_contains(c, '{c}') THEN '{lx.SUBFIELD[c]}'" for c in lx.SUBFIELD_ORDER) + " END"


@query(f"SELECT subfield, year(updated) AS y, count(*) AS n FROM (SELECT {_LABEL} AS subfield, updated FROM (SELECT string_split(categories, ' ') AS c, updated FROM ({SQL_PAPERS}))) WHERE subfield IS NOT NULL GROUP BY ALL")
def paper_subfields(spark: SparkSession, d: str) -> DataFrame:
    """One subfield per paper: that of its first category in the order of priority; papers without any are left out."""
    has = F.split("categories", " ")
    label = reduce(lambda rest, c: F.when(F.array_contains(has, c), lx.SUBFIELD[c]).otherwise(rest), reversed(lx.SUBFIELD_ORDER), F.lit(None).cast("string"))
    return papers(spark, d).withColumn("subfield", label).dropna(subset=["subfield"]).groupBy("subfield", F.year("updated").cast("bigint").alias("y")).agg(F.count("*").alias("n"))


# --- publications ----------------------------------------------------------------------------------------------------

SQL_FILED = "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y%m%d') END"
_LANGUAGE = "CASE l_returnflag WHEN 'N' THEN 'en' WHEN 'R' THEN 'zh' ELSE 'de' END"


def filed(o: DataFrame) -> Column:
    """Filing dates as digits; some are missing or lack the day."""
    return F.when(o["o_orderkey"] % 17 == 0, None).when(o["o_orderkey"] % 13 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))


def first_in_language(texts: Column, language: str) -> Column:
    """The first text of a language among (language, text) in order; null if there is none."""
    return F.get(F.filter(texts, lambda t: t["language"] == language), F.lit(0))["text"]


def joined_text(title: Column, abstract: Column) -> Column:
    """Title, a blank, abstract; a missing part is empty, the blank stays."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def whole_date(digits: Column) -> Column:
    """A date of eight digits (yyyyMMdd); null for missing, shorter or invalid ones."""
    return F.when(F.length(digits) >= 8, F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date"))


@query(f"""WITH t AS (SELECT l_orderkey AS id, list(struct_pack(language := {_LANGUAGE}, title := p_name, abstract := p_type) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
  f AS (SELECT id, list_filter(x, lambda e: e.language = 'en')[1].title AS title, list_filter(x, lambda e: e.language = 'de')[1].abstract AS abstract FROM t), o AS (SELECT o_orderkey AS id, {SQL_FILED} AS fd FROM orders)
  SELECT id, title, coalesce(title, '') || ' ' || coalesce(abstract, '') AS text, CAST(left(fd, 4) AS BIGINT) AS filing_year FROM f JOIN o USING (id) WHERE fd IS NOT NULL AND length(fd) >= 8""")
def publication_text(spark: SparkSession, d: str) -> DataFrame:
    """Publications with a whole filing date: the first title in one language, the first abstract in another, and both as one text."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    language = F.when(F.col("l_returnflag") == "N", "en").when(F.col("l_returnflag") == "R", "zh").otherwise("de")
    entry = lambda c: F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", language.alias("language"), F.col(c).alias("text"))
    t = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(entry("p_name"))).alias("titles"), F.array_sort(F.collect_list(entry("p_type"))).alias("abstracts"))
    f = t.select("id", first_in_language(F.col("titles"), "en").alias("title"), first_in_language(F.col("abstracts"), "de").alias("abstract"))
    orders = table(spark, d, "orders")
    o = orders.select(F.col("o_orderkey").alias("id"), whole_date(filed(orders)).alias("filed")).filter("filed IS NOT NULL")
    return f.join(o, "id").select("id", "title", joined_text(F.col("title"), F.col("abstract")).alias("text"), F.year("filed").cast("bigint").alias("filing_year"))


@query(f"""WITH x AS (SELECT ticker, l_orderkey // 3 AS application, year(filed) AS y, l_orderkey, l_linenumber FROM ({fm.SQL_OWNED})),
  f AS (SELECT ticker, application, arg_min(y, (l_orderkey, l_linenumber, y)) AS y FROM x GROUP BY ALL) SELECT ticker, y, count(*) AS n FROM f GROUP BY ALL""")
def first_seen_denominators(spark: SparkSession, d: str) -> DataFrame:
    """Applications of a firm by the year of the row that names them first, in the order of publications; each counts once."""
    x = fm.owned(spark, d).withColumn("application", F.expr("l_orderkey div 3"))
    f = x.groupBy("ticker", "application").agg(F.min_by(F.year("filed"), F.struct("l_orderkey", "l_linenumber", F.year("filed"))).alias("y"))
    return f.groupBy("ticker", F.col("y").cast("bigint").alias("y")).agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT DISTINCT parent, p_brand AS ticker, l_orderkey AS work, l_shipdate AS published, l_returnflag <> 'N' AS preprint FROM lineitem JOIN ({fm.SQL_GROUPS}) ON l_partkey = p_partkey WHERE parent IS NOT NULL)
  SELECT parent, ticker, strftime(published, '%Y-%m') AS month, count(*) AS n_papers, count(*) FILTER (preprint) AS n_preprints FROM w GROUP BY ALL""")
def firm_month_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers of a firm in a month: rows get their parent first, then a paper counts once for each firm and date."""
    rows = table(spark, d, "lineitem").join(fm.grouped_parts(spark, d).filter("parent IS NOT NULL"), F.col("l_partkey") == F.col("p_partkey"))
    w = rows.select("parent", F.col("p_brand").alias("ticker"), F.col("l_orderkey").alias("work"), F.col("l_shipdate").alias("published"), (F.col("l_returnflag") != "N").alias("preprint")).distinct()
    return w.groupBy("parent", "ticker", dt.month_text(F.col("published")).alias("month")).agg(F.count("*").alias("n_papers"), F.count_if("preprint").alias("n_preprints"))


# --- codes and terms -------------------------------------------------------------------------------------------------

_CODES = tuple(f"{old}{sub}" for old, _ in lx.SUCCESSORS for sub in ("00", "10")) + tuple(dict.fromkeys(f"{new}{'/' * (not new.endswith('/'))}{sub}" for _, targets in lx.SUCCESSORS for new in targets for sub in ("00", "10"))) + ("H04L9/00", "A61B5/00")
_OLD = lx.SUCCESSORS[:6]
SQL_SCHEME = f"[{', '.join(map(repr, _CODES))}][1 + (l_partkey * 3 + l_suppkey) % {len(_CODES)}]"
SQL_SCHEME_DOCS = f"SELECT o_custkey AS id, list_distinct(list({SQL_SCHEME})) AS codes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
_IS_OLD = "(" + " OR ".join(f"starts_with({{0}}, '{old}')" for old, _ in _OLD) + ")"
_ALLOWED = "CASE " + " ".join(f"WHEN starts_with(old, '{old}') THEN " + " OR ".join(f"starts_with(new, '{t}')" for t in targets) for old, targets in lx.SUCCESSORS) + " ELSE false END"


def scheme_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents (here customers) with codes of the old and the current scheme."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    code = F.element_at(F.array(*map(F.lit, _CODES)), ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % len(_CODES) + 1).cast("int"))
    return rows.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(code).alias("codes"))


SQL_CONC = f"""WITH d AS ({SQL_SCHEME_DOCS}), o AS (SELECT id, codes, unnest(list_filter(codes, lambda c: {_IS_OLD.format("c")})) AS old FROM d), n AS (SELECT old, count(*) AS docs FROM o GROUP BY old),
  p AS (SELECT old, unnest(list_filter(codes, lambda c: NOT {_IS_OLD.format("c")})) AS new FROM o), c AS (SELECT old, new, count(*) AS together FROM p GROUP BY ALL),
  k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY old ORDER BY together DESC, new) <= {lx.CONCORDANCE_RANKED}),
  a AS (SELECT old, new, together, docs, together / docs AS share FROM k JOIN n USING (old) WHERE together / docs >= {lx.CONCORDANCE_SHARE} AND ({_ALLOWED}))
  SELECT *, row_number() OVER (PARTITION BY old ORDER BY together DESC, new) AS rank FROM a QUALIFY rank <= {lx.CONCORDANCE_MOST}"""


def concordance(docs: DataFrame, withdrawn: tuple[str, ...], *, share: float = lx.CONCORDANCE_SHARE, ranked: int = lx.CONCORDANCE_RANKED, most: int = lx.CONCORDANCE_MOST) -> DataFrame:
    """Successors of codes with withdrawn prefixes: of the codes that stand beside one most often, those that are allowed and have the share."""
    each = docs.select("codes", F.explode(F.filter("codes", lambda c: cd.any_prefix(c, withdrawn))).alias("old"))
    n = each.groupBy("old").agg(F.count("*").alias("docs"))
    c = each.select("old", F.explode(F.filter("codes", lambda c: ~cd.any_prefix(c, withdrawn))).alias("new")).groupBy("old", "new").agg(F.count("*").alias("together"))
    w = W.partitionBy("old").orderBy(F.desc("together"), "new")
    k = c.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= ranked).join(n, "old").withColumn("share", F.col("together") / F.col("docs"))
    a = k.filter((F.col("share") >= share) & cd.successor_allowed(F.col("old"), F.col("new")))
    return a.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= most).select("old", "new", "together", "docs", "share", "rank")


_OLD_PREFIXES = tuple(old for old, _ in _OLD)


@query(f"SELECT old, new, together, docs, round(share, 6) AS share, rank, share >= {lx.CONCORDANCE_ADOPT} AS adopted FROM ({SQL_CONC})")
def concordance_targets(spark: SparkSession, d: str) -> DataFrame:
    """Allowed successors with a share of 0.30, eight at most, and whether they are adopted (0.50)."""
    c = concordance(scheme_docs(spark, d), _OLD_PREFIXES)
    return c.select("old", "new", "together", "docs", F.round("share", 6).alias("share"), "rank", (F.col("share") >= lx.CONCORDANCE_ADOPT).alias("adopted"))


_PHRASES = (
    "artificial intelligence for machines", "neural network", "a decision model", "deep learning of features", "genetic algorithms", "support vector machines", "training data sets", "stochastic technique", "speech recognition",
    "recommendation system", "hidden markov model", "a plain valve", "predictive analytics", "objective functions", "learning in an algorithm", "embedding layer", "overfitting", "clusters of pumps",
)
SQL_PHRASED = f"SELECT l_orderkey AS id, string_agg([{', '.join(map(repr, _PHRASES))}][1 + (l_partkey + l_linenumber) % {len(_PHRASES)}], '. ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM lineitem GROUP BY 1"


def phrased(spark: SparkSession, d: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(_PHRASES) + 1).cast("int"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", phrase.alias("p")))).alias("x"))
    return rows.select("id", F.array_join(F.transform("x", lambda e: e["p"]), ". ").alias("text"))


@query(f"SELECT k1, k2, count(*) AS n FROM (SELECT regexp_matches(text, '{terms_regex(lx.K1)}') AS k1, regexp_matches(text, '{terms_regex(lx.K2)}') AS k2 FROM ({SQL_PHRASED})) GROUP BY ALL")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """Texts by whether a deciding and a general search term of the study's lists occurs."""
    t = phrased(spark, d).select(F.col("text").rlike(terms_regex(lx.K1)).alias("k1"), F.col("text").rlike(terms_regex(lx.K2)).alias("k2"))
    return t.groupBy("k1", "k2").agg(F.count("*").alias("n"))


_YEARS = tuple(range(1995, 2003))


@query(f"""WITH y AS (SELECT o_custkey AS firm, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT firm, sum(n) AS total FROM y GROUP BY firm ORDER BY total DESC, firm LIMIT 20)
  SELECT firm, CAST(total AS BIGINT) AS total, {", ".join(f"CAST(coalesce(sum(n) FILTER (y = {y}), 0) AS BIGINT) AS y{y}" for y in _YEARS)} FROM y JOIN t USING (firm) GROUP BY firm, total""")
def top_firm_year_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Firms by years for the twenty firms with most patents (ties by key), and their totals."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("firm"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    top = n.groupBy("firm").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "firm").limit(20)
    wide = n.join(top, "firm").groupBy("firm", "total").pivot("y", list(_YEARS)).agg(F.sum("n")).fillna(0)
    return wide.select("firm", "total", *(F.col(str(y)).alias(f"y{y}") for y in _YEARS))


@query(f"""WITH t AS ({fm.SQL_TIERS}), r AS (SELECT split_part(core, ' ', 1) AS head, count(*) AS firms FROM ({fm.SQL_ROSTER}) GROUP BY 1), v AS (SELECT * FROM t WHERE tier <> 'T1_EXACT'), o AS (SELECT split_part(akey, ' ', 1) AS head, count(*) AS orgs FROM v GROUP BY 1),
  j AS (SELECT core, assignee, akey, n, split_part(core, ' ', 1) AS head, coalesce(firms, 0) AS head_firms, coalesce(orgs, 0) AS head_orgs, starts_with(akey || ' ', core || ' ') AS fits, trim(substr(akey, length(core) + 1)) AS rest
    FROM v LEFT JOIN r ON r.head = split_part(core, ' ', 1) LEFT JOIN o ON o.head = split_part(core, ' ', 1))
  SELECT core, assignee, n, head_firms, head_orgs, CASE WHEN head_firms > 1 AND fits THEN 'head of several firms, whole prefix fits' WHEN head_firms > 1 THEN 'head of several firms, second word differs' WHEN NOT fits THEN 'own head, not the whole prefix' WHEN rest = '' THEN 'same core'
    WHEN list_has_all([{', '.join(repr(x) for x in fm._FL)}], string_split(rest, ' ')) THEN 'own head and functional words: ' || rest ELSE 'own head, but further words: ' || rest END AS why FROM j""")  # noqa: SLF001
def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Names under review with the reason of the suggestion, and how many firms and names share the first word."""
    t = fm.tiers(spark, d)
    head = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    named = fm.nm.core(F.col("name"))
    firms = fm.firm_names(spark, d).select(named.alias("core")).distinct().groupBy(head("core").alias("head")).agg(F.count("*").alias("head_firms"))
    v = t.filter("tier <> 'T1_EXACT'").withColumn("head", head("core"))
    orgs = v.groupBy(head("akey").alias("head")).agg(F.count("*").alias("head_orgs"))
    j = v.join(firms, "head", "left").join(orgs, "head", "left").fillna(0, ["head_firms", "head_orgs"])
    return j.select("core", "assignee", "n", "head_firms", "head_orgs", rs.reason(F.col("core"), F.col("akey"), F.col("head_firms"), fm._FL).alias("why"))  # noqa: SLF001


# --- tests with errors -----------------------------------------------------------------------------------------------

SERIES = ("x_raw", "vw", "ew")
SQL_SERIES = f"SELECT d.m, month(d.m) AS mth, x_raw, vw, ew FROM ({mk.SQL_DESEASON}) d JOIN ({mk.SQL_PORT}) p ON d.m = p.m"


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS series, k AS groups, n, round(ssb / sst, 6) AS share, round(f, 6) AS f, round({sql_f_upper("f", "k - 1.0", "n - k * 1.0")}, 6) AS p FROM (SELECT *, (ssb / (k - 1)) / ((sst - ssb) / (n - k)) AS f FROM
    (SELECT sum(a.n * (a.mean - t.mean) * (a.mean - t.mean)) AS ssb, count(*) AS k, any_value(t.n) AS n, any_value(t.sst) AS sst FROM (SELECT mth, count({c}) AS n, avg({c}) AS mean FROM ({SQL_SERIES}) WHERE {c} IS NOT NULL GROUP BY mth) a,
    (SELECT count({c}) AS n, avg({c}) AS mean, var_samp({c}) * (count({c}) - 1) AS sst FROM ({SQL_SERIES})) t))""" for c in SERIES))  # fmt: skip
def anova_table(spark: SparkSession, d: str) -> DataFrame:
    """Analysis of variance by calendar month of growth and both returns: F, its probability and the share explained."""
    rows = mk.deseasoned(spark, d).select("m", "mth", "x_raw").join(mk.portfolio(spark, d).select("m", "vw", "ew"), "m")
    long = rows.unpivot(["m", "mth"], list(SERIES), "series", "v").dropna()
    a = long.groupBy("series", "mth").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("ssw"))
    mean = F.sum(F.col("n") * F.col("mean")).over(W.partitionBy("series")) / F.sum("n").over(W.partitionBy("series"))
    t = a.withColumn("between", F.col("n") * (F.col("mean") - mean) ** 2).groupBy("series").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("between").alias("ssb"), F.sum("ssw").alias("ssw"))
    t = t.withColumn("f", (F.col("ssb") / (F.col("groups") - 1)) / (F.col("ssw") / (F.col("n") - F.col("groups"))))
    p = f_upper(F.col("f"), F.col("groups") - 1, F.col("n") - F.col("groups"))
    return t.select("series", "groups", "n", F.round(F.col("ssb") / (F.col("ssb") + F.col("ssw")), 6).alias("share"), F.round("f", 6).alias("f"), F.round(p, 6).alias("p"))


LAGS = 4
_BARTLETT = " + ".join(["sum(z * z)", *(f"2 * {1 - k / (LAGS + 1)} * sum(z * z{k})" for k in range(1, LAGS + 1))])


def sql_hac(rows: str, keys: str, y: str = "y", x: str = "x") -> str:
    """keys, n, b and se of the slope of y on x with Newey-West errors, per keys and ordered by m."""
    lags = ", ".join(f"coalesce(lag(z, {k}) OVER (PARTITION BY {keys} ORDER BY m), 0) AS z{k}" for k in range(1, LAGS + 1))
    return f"""SELECT {keys}, count(*) AS n, any_value(b) AS b, sqrt({_BARTLETT}) AS se FROM (SELECT {keys}, b, z, {lags} FROM (SELECT {keys}, m, b, ({x} - mx) / sxx * ({y} - a - b * {x}) AS z FROM
    (SELECT {keys}, m, {y}, {x}, regr_slope({y}, {x}) OVER w AS b, regr_intercept({y}, {x}) OVER w AS a, avg({x}) OVER w AS mx, regr_sxx({y}, {x}) OVER w AS sxx FROM ({rows}) WINDOW w AS (PARTITION BY {keys})))) GROUP BY {keys}"""


def hac(rows: DataFrame, keys: list[str], y: str = "y", x: str = "x", lags: int = LAGS) -> DataFrame:
    """keys, n, b and se of the slope of y on x with Newey-West errors, per keys and ordered by m: windows and one aggregate."""
    group, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("m")
    f = rows.select(*keys, "m", y, x, F.regr_slope(y, x).over(group).alias("b"), F.regr_intercept(y, x).over(group).alias("a"), F.avg(x).over(group).alias("mx"), F.regr_sxx(y, x).over(group).alias("sxx"))
    z = f.select(*keys, "m", "b", ((F.col(x) - F.col("mx")) / F.col("sxx") * (F.col(y) - F.col("a") - F.col("b") * F.col(x))).alias("z"))
    z = z.select("*", *(F.lag("z", k, 0.0).over(order).alias(f"z{k}") for k in range(1, lags + 1)))
    var = F.sum(F.col("z") ** 2)
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.sum(F.col("z") * F.col(f"z{k}"))
    return z.groupBy(*keys).agg(F.count("*").alias("n"), F.first("b").alias("b"), F.sqrt(var).alias("se"))


def _round(*names: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in names]


SQL_DEMEANED = f"SELECT z.m, size, spread AS y, x_demean AS x FROM ({mk.SQL_SIZE}) z JOIN ({mk.SQL_DESEASON}) v ON z.m = v.m WHERE x_demean IS NOT NULL AND spread IS NOT NULL"


@query(f"""WITH h AS ({sql_hac(SQL_DEMEANED, "size")}), p AS (SELECT *, {sql_t_two_sided("b / se", "n - 2.0")} AS p FROM h), r AS (SELECT *, count(*) OVER () * p / row_number() OVER (ORDER BY p, size) AS q FROM p)
  SELECT size, n, round(b, 6) AS b, round(b / se, 6) AS t, round(p, 6) AS p, round(least(1.0, min(q) OVER (ORDER BY p DESC, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjusted FROM r""")
def size_quintile_hac(spark: SparkSession, d: str) -> DataFrame:
    """Spread on demeaned growth per size quintile, with Newey-West errors and p values adjusted over the five."""
    rows = mk.size_spread(spark, d).select("m", "size", F.col("spread").alias("y")).join(mk.deseasoned(spark, d).select("m", F.col("x_demean").alias("x")), "m").dropna()
    h = hac(rows, ["size"]).withColumn("t", F.col("b") / F.col("se")).withColumn("p", t_two_sided(F.col("t"), F.col("n") - 2))
    return s.benjamini_hochberg(h, "p", [], ["size"]).select("size", "n", *_round("b", "t", "p", "p_adjusted"))


_CUTS = ("1996-01", "1998-01", "2000-01")
SQL_SPLIT = "SELECT cut, m, vw, x_demean AS x, CAST(strftime(m, '%Y-%m') >= cut AS INT) AS post FROM (SELECT d.m, vw, x_demean FROM ({0}) d JOIN ({1}) p ON d.m = p.m WHERE x_demean IS NOT NULL), (SELECT unnest([{2}]) AS cut)".format(mk.SQL_DESEASON, mk.SQL_PORT, ", ".join(map(repr, _CUTS)))
_ZL = ", ".join(f"coalesce(lag(z, {k}) OVER (PARTITION BY cut ORDER BY m), 0) AS z{k}" for k in range(1, LAGS + 1))
_SEG = sql_hac(SQL_SPLIT.replace("vw, x_demean AS x", "vw AS y, x_demean AS x", 1), "cut, post")


@query(f"""WITH r AS ({SQL_SPLIT}), f AS (SELECT *, regr_slope(vw, x) OVER w AS b, regr_intercept(vw, x) OVER w AS a, avg(x) OVER w AS mx, regr_sxx(vw, x) OVER w AS sxx FROM r WINDOW w AS (PARTITION BY cut, post)),
  z AS (SELECT cut, m, post, b, (2 * post - 1) * (x - mx) / sxx * (vw - a - b * x) AS z FROM f), l AS (SELECT *, {_ZL} FROM z),
  v AS (SELECT cut, count(*) AS n, any_value(b) FILTER (post = 1) - any_value(b) FILTER (post = 0) AS b, sqrt({_BARTLETT}) AS se FROM l GROUP BY cut), g AS ({_SEG}),
  p AS (SELECT *, {sql_t_two_sided("b / se", "n - 4.0")} AS p FROM v), q AS (SELECT *, count(*) OVER () * p / row_number() OVER (ORDER BY p, cut) AS q FROM p)
  SELECT q.cut, q.n, round(e.b, 6) AS b_before, round({sql_t_two_sided("e.b / e.se", "e.n - 2.0")}, 6) AS p_before, round(l.b, 6) AS b_after, round({sql_t_two_sided("l.b / l.se", "l.n - 2.0")}, 6) AS p_after, round(q.b, 6) AS b, round(q.b / q.se, 6) AS t, round(q.p, 6) AS p,
  round(least(1.0, min(q) OVER (ORDER BY q.p DESC, q.cut DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjusted, CASE WHEN q.p < 0.05 THEN 'significant' WHEN q.p < 0.1 THEN 'marginal' ELSE 'not significant' END AS verdict
  FROM q JOIN g e ON e.cut = q.cut AND e.post = 0 JOIN g l ON l.cut = q.cut AND l.post = 1""")
def interaction_hac(spark: SparkSession, d: str) -> DataFrame:
    """Whether the slope changes at fixed cuts: both segments and the interaction, with Newey-West errors over the whole series.

    The interaction is the difference of the segments' slopes; a month's influence on it is that on its segment's slope, signed.
    """
    j = mk.deseasoned(spark, d).select("m", F.col("x_demean").alias("x")).join(mk.portfolio(spark, d).select("m", F.col("vw").alias("y")), "m").dropna()
    r = j.withColumn("cut", F.explode(F.array(*map(F.lit, _CUTS)))).withColumn("post", (F.date_format("m", "yyyy-MM") >= F.col("cut")).cast("int"))
    seg = hac(r, ["cut", "post"]).withColumn("p", t_two_sided(F.col("b") / F.col("se"), F.col("n") - 2))
    side = lambda k, n: seg.filter(F.col("post") == k).select("cut", F.col("b").alias(f"b_{n}"), F.col("p").alias(f"p_{n}"))
    w, order = W.partitionBy("cut", "post"), W.partitionBy("cut").orderBy("m")
    z = r.withColumn("b", F.regr_slope("y", "x").over(w)).withColumn("e", F.col("y") - F.regr_intercept("y", "x").over(w) - F.col("b") * F.col("x"))
    z = z.select("cut", "m", "post", "b", ((2 * F.col("post") - 1) * (F.col("x") - F.avg("x").over(w)) / F.regr_sxx("y", "x").over(w) * F.col("e")).alias("z"))
    z = z.select("*", *(F.lag("z", k, 0.0).over(order).alias(f"z{k}") for k in range(1, LAGS + 1)))
    var = F.sum(F.col("z") ** 2)
    for k in range(1, LAGS + 1):
        var = var + 2 * (1 - k / (LAGS + 1)) * F.sum(F.col("z") * F.col(f"z{k}"))
    v = z.groupBy("cut").agg(F.count("*").alias("n"), (F.max(F.when(F.col("post") == 1, F.col("b"))) - F.max(F.when(F.col("post") == 0, F.col("b")))).alias("b"), F.sqrt(var).alias("se"))
    v = v.withColumn("t", F.col("b") / F.col("se")).withColumn("p", t_two_sided(F.col("t"), F.col("n") - 4))
    out = s.benjamini_hochberg(v, "p", [], ["cut"]).join(side(0, "before"), "cut").join(side(1, "after"), "cut")
    return out.select("cut", "n", *_round("b_before", "p_before", "b_after", "p_after", "b", "t", "p", "p_adjusted"), s.verdict(F.col("p")).alias("verdict"))


SQL_CITED = f"""SELECT m, y, xc - avg(xc) OVER (PARTITION BY month(m)) AS x, 1 AS one FROM (SELECT v.m, vw AS y, ln(q) - lag(ln(q)) OVER (ORDER BY v.m) AS xc FROM ({mk.SQL_VOLUME}) v JOIN ({mk.SQL_PORT}) p ON v.m = p.m WHERE strftime(v.m, '%Y-%m') <= '1999-12') WHERE xc IS NOT NULL"""


@query(f"SELECT n, round(b, 6) AS b, round(b / se, 6) AS t, round({sql_t_two_sided('b / se', 'n - 2.0')}, 6) AS p FROM ({sql_hac(SQL_CITED, 'one')})")
def citation_regression(spark: SparkSession, d: str) -> DataFrame:
    """Return on citation growth in the months whose citations are mature: filtered, then differenced, then less calendar-month means."""
    rows = mk.volume(spark, d).select("m", "q").join(mk.portfolio(spark, d).select("m", F.col("vw").alias("y")), "m").filter(F.date_format("m", "yyyy-MM") <= "1999-12")
    c = rows.withColumn("xc", s.log_change(F.col("q"), W.orderBy("m"))).filter("xc IS NOT NULL")
    c = c.select("m", "y", (F.col("xc") - F.avg("xc").over(W.partitionBy(F.month("m")))).alias("x"), F.lit(1).alias("one"))
    h = hac(c, ["one"]).withColumn("t", F.col("b") / F.col("se"))
    return h.select("n", *_round("b", "t"), F.round(t_two_sided(F.col("t"), F.col("n") - 2), 6).alias("p"))


SQL_FACTS = f"SELECT o_custkey AS firm, [{', '.join(map(repr, lx.RD_TAGS))}, 'Other'][1 + (o_custkey + o_orderkey % 2) % 4] AS tag, year(o_orderdate) AS fy, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderdate AS DATE) - CAST(300 + o_orderkey % 100 AS INT) AS a, CAST(o_orderdate AS DATE) AS b, o_orderstatus AS form, o_orderkey AS id, o_totalprice AS value FROM orders"


@query(f"""WITH f AS ({SQL_FACTS}), k AS (SELECT *, list_position([{', '.join(map(repr, lx.RD_TAGS))}], tag) AS place FROM f WHERE tag <> 'Other' QUALIFY place = min(place) OVER (PARTITION BY firm))
  SELECT firm, fy, tag, CAST(b - a AS BIGINT) AS days, value FROM k WHERE form <> 'P' AND b - a BETWEEN 340 AND 380 QUALIFY row_number() OVER (PARTITION BY firm, fy ORDER BY filed DESC, id DESC) = 1""")
def rd_facts(spark: SparkSession, d: str) -> DataFrame:
    """Yearly facts: a firm's first reported tag, forms of the right kind, periods of 340 to 380 days, the latest filing of each year."""
    o = table(spark, d, "orders")
    tag = F.element_at(F.array(*map(F.lit, (*lx.RD_TAGS, "Other"))), ((F.col("o_custkey") + F.col("o_orderkey") % 2) % 4 + 1).cast("int"))
    day = F.col("o_orderdate").cast("date")
    f = o.select(F.col("o_custkey").alias("firm"), tag.alias("tag"), F.year("o_orderdate").cast("bigint").alias("fy"), day.alias("b"), F.date_sub(day, (300 + F.col("o_orderkey") % 100).cast("int")).alias("a"), F.col("o_orderstatus").alias("form"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    days = F.datediff("b", "a")
    k = first_reported(f, "firm", "tag").filter((F.col("form") != "P") & days.between(340, 380))
    return s.first_match(k, ["firm", "fy"], F.desc("b"), F.desc("id")).select("firm", "fy", "tag", days.cast("bigint").alias("days"), "value")


# --- inputs of figures -----------------------------------------------------------------------------------------------


@query(f"SELECT CAST(floor(ret / 0.25) AS BIGINT) AS bin, count(*) AS n FROM ({mk.SQL_RET}) GROUP BY 1")
def figure_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Returns in bins of 0.25."""
    return mk.returns(spark, d).groupBy(F.floor(F.col("ret") / 0.25).alias("bin")).agg(F.count("*").alias("n"))


_FIVE = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "high": 1.0}


@query(f"SELECT ticker, count(*) AS n, {', '.join(f'round(quantile_cont(ret, {q}), 6) AS {k}' for k, q in _FIVE.items())} FROM ({mk.SQL_RET}) GROUP BY ticker")
def figure_box(spark: SparkSession, d: str) -> DataFrame:
    """Box plot of returns per ticker."""
    g = mk.returns(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.percentile("ret", list(_FIVE.values())).alias("q"))
    return g.select("ticker", "n", *(F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(_FIVE)))


@query(f"SELECT ticker, subfield, count(*) AS n, round(corr(y, x), 6) AS r FROM ({et.SQL_PAIRS}) GROUP BY ALL")
def figure_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of returns with growth, ticker by subfield."""
    return et.pairs(spark, d).groupBy("ticker", "subfield").agg(F.count("*").alias("n"), F.round(F.corr("y", "x"), 6).alias("r"))


@query(f"SELECT strftime(m, '%Y-%m') AS month, subfield, n, CAST(sum(n) OVER (PARTITION BY m ORDER BY subfield) AS BIGINT) AS top, round(n / sum(n) OVER (PARTITION BY m), 6) AS share FROM ({mk.SQL_TYPES})")
def figure_stacked(spark: SparkSession, d: str) -> DataFrame:
    """Stacked areas of subfields by month: counts, upper edges and shares."""
    w = W.partitionBy("m")
    upto = w.orderBy("subfield").rowsBetween(W.unboundedPreceding, 0)
    return mk.subfields(spark, d).select(mk.mstr(), "subfield", "n", F.sum("n").over(upto).alias("top"), F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


# --- impulse responses -----------------------------------------------------------------------------------------------


def _irf_grid(y: DataFrame, x: DataFrame, keys: list[str]) -> DataFrame:
    return et.per_pair(y.join(x, ["m", *[k for k in x.columns if k in y.columns and k != "m"]]).dropna(), keys, et.es.irf, {"h": "int", "irf": "double", "lower": "double", "upper": "double", "order": "int", "star": "string"})


@query()
def irf_grids(spark: SparkSession, d: str) -> DataFrame:
    """Impulse responses of returns to growth over all grids: macro, firm, own papers, subfield by firm, own subfield by firm.

    Series that are too short or don't vary give no rows; groups are estimated in parallel, each with its own fixed seed.
    """
    w = s.by(["ticker"], ["m"])
    ret = mk.returns(spark, d).select("ticker", "m", F.col("ret").alias("y"))
    port = mk.portfolio(spark, d).select("m", F.col("vw").alias("y"))
    macro = mk.growth(spark, d).select("m", F.col("g").alias("x"))
    own = mk.firm_subfields(spark, d)
    own_all = own.groupBy("ticker", "m").agg(F.sum("n").alias("n")).withColumn("x", s.log_change(F.col("n"), w)).select("ticker", "m", "x")
    sub = mk.subfields(spark, d).withColumn("x", s.log_change(F.col("n"), s.by(["subfield"], ["m"]))).select("subfield", "m", "x")
    own_sub = own.withColumn("x", s.log_change(F.col("n") + 1, s.by(["ticker", "subfield"], ["m"]))).select("ticker", "subfield", "m", "x")
    none = F.lit("all")
    parts = {
        "macro": _irf_grid(port.withColumn("ticker", none), macro, ["ticker"]).withColumn("subfield", none),
        "firm": _irf_grid(ret, macro, ["ticker"]).withColumn("subfield", none),
        "own": _irf_grid(ret, own_all, ["ticker"]).withColumn("subfield", none),
        "subfield": _irf_grid(ret, sub, ["ticker", "subfield"]),
        "own_subfield": _irf_grid(ret, own_sub, ["ticker", "subfield"]),
    }
    out = [p.select(F.lit(k).alias("grid"), "ticker", "subfield", "h", "irf", "lower", "upper", "order", "star") for k, p in parts.items()]
    return reduce(DataFrame.unionByName, out)
