"""Returns, portfolios, growth and panels.

Analogues on the driver tables: ticker = market segment, price = order total, volume = line items shipped in a month,
subfield = part type, firm = customer, supplier or nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import dates as dt
from quillspark.functions import lexicon as lx
from quillspark.operators import series as s
from quillspark.plans.registry import query
from quillspark.sources.tables import table

WEIGHTS = {"AUTOMOBILE": 0.30, "BUILDING": 0.25, "FURNITURE": 0.10, "HOUSEHOLD": 0.19, "MACHINERY": 0.20}
"""Static portfolio weights; they needn't sum to one."""
_W = "CASE ticker " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"

SQL_MONTHLY = "SELECT c_mktsegment AS ticker, date_trunc('month', o_orderdate) AS m, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
SQL_RET = f"SELECT * FROM (SELECT ticker, m, price, ln(price) - lag(ln(price)) OVER (PARTITION BY ticker ORDER BY m) AS ret FROM ({SQL_MONTHLY})) WHERE ret IS NOT NULL"
SQL_PORT = f"SELECT m, sum({_W} * ret) / sum({_W}) AS vw, avg(ret) AS ew, stddev_samp(ret) AS vol, count(*) AS n FROM ({SQL_RET}) GROUP BY m"
SQL_VOLUME = "SELECT date_trunc('month', l_shipdate) AS m, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL"
SQL_GROWTH = f"SELECT m, n, ln(n) - lag(ln(n)) OVER (ORDER BY m) AS g FROM ({SQL_VOLUME})"
SQL_TYPES = "SELECT date_trunc('month', l_shipdate) AS m, p_type AS subfield, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"
SQL_JOINED = f"SELECT p.m, vw, ew, g FROM ({SQL_PORT}) p JOIN ({SQL_GROWTH}) v ON p.m = v.m WHERE g IS NOT NULL"


def mstr(c: str = "m") -> Column:
    return dt.month_text(F.col(c)).alias("month")


def monthly_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_mktsegment").alias("ticker"), dt.month(F.col("o_orderdate")).alias("m"), F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderkey")
    return s.last_in_period(rows, ["ticker", "m"], "price", ["o_orderdate", "o_orderkey"])


def returns(spark: SparkSession, d: str) -> DataFrame:
    w = s.by(["ticker"], ["m"])
    return monthly_prices(spark, d).withColumn("ret", s.log_change(F.col("price"), w)).filter("ret IS NOT NULL")


def portfolio(spark: SparkSession, d: str) -> DataFrame:
    w = F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p))[F.col("ticker")]
    return returns(spark, d).groupBy("m").agg(s.weighted_mean(F.col("ret"), w).alias("vw"), F.avg("ret").alias("ew"), F.stddev_samp("ret").alias("vol"), F.count("*").alias("n"))


def volume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(dt.month(F.col("l_shipdate")).alias("m")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def growth(spark: SparkSession, d: str) -> DataFrame:
    """Log growth of monthly volume; a table of months, so one ordered window is fine."""
    return volume(spark, d).withColumn("g", s.log_change(F.col("n"), W.orderBy("m"))).select("m", "n", "g")


def subfields(spark: SparkSession, d: str) -> DataFrame:
    """Distinct orders per month and subfield: an order counts once in each of its subfields."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", dt.month(F.col("l_shipdate")).alias("m"), F.col("p_type").alias("subfield")).distinct().groupBy("m", "subfield").agg(F.count("*").alias("n"))


def joined(spark: SparkSession, d: str) -> DataFrame:
    return portfolio(spark, d).join(growth(spark, d).select("m", "g"), "m").filter("g IS NOT NULL").select("m", "vw", "ew", "g")


@query(f"SELECT ticker, strftime(m, '%Y-%m') AS month, price, round(ret, 6) AS ret FROM ({SQL_RET})")
def monthly_log_return(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).select("ticker", mstr(), "price", F.round("ret", 6).alias("ret"))


@query(f"SELECT strftime(m, '%Y-%m') AS month, round(vw, 6) AS vw, round(ew, 6) AS ew, round(vol, 6) AS vol, n FROM ({SQL_PORT})")
def portfolio_vw_ew_vol(spark: SparkSession, d: str) -> DataFrame:
    return portfolio(spark, d).select(mstr(), *(F.round(c, 6).alias(c) for c in ("vw", "ew", "vol")), "n")


@query(f"SELECT year(m) || 'Q' || quarter(m) AS quarter, round(sum(vw), 6) AS vw, round(sum(ew), 6) AS ew, round(avg(vol), 6) AS vol, count(*) AS months FROM ({SQL_PORT}) GROUP BY 1")
def portfolio_quarter_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = portfolio(spark, d).groupBy(dt.quarter_text(F.col("m")).alias("quarter"))
    return g.agg(F.round(F.sum("vw"), 6).alias("vw"), F.round(F.sum("ew"), 6).alias("ew"), F.round(F.avg("vol"), 6).alias("vol"), F.count("*").alias("months"))


@query(f"""WITH v AS ({SQL_VOLUME}) SELECT strftime(m, '%Y-%m') AS month, n, round(ln(n) - lag(ln(n)) OVER (ORDER BY m), 6) AS growth,
  round(ln(1 + CASE WHEN m <= (SELECT max(m) FROM v) - INTERVAL 24 MONTH THEN q END) - lag(ln(1 + CASE WHEN m <= (SELECT max(m) FROM v) - INTERVAL 24 MONTH THEN q END)) OVER (ORDER BY m), 6) AS quantity_growth FROM v""")
def macro_growth(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of the last 24 months are incomplete and count as missing."""
    v = volume(spark, d)
    cut = F.add_months(F.max("m").over(W.partitionBy()), -24)
    clean = v.withColumn("q", F.when(F.col("m") <= cut, F.col("q")))
    w = W.orderBy("m")
    return clean.select(mstr(), "n", F.round(s.log_change(F.col("n"), w), 6).alias("growth"), F.round(F.log1p("q") - F.lag(F.log1p("q")).over(w), 6).alias("quantity_growth"))


@query(f"""SELECT count(*) AS n, round(regr_slope(vw, g), 6) AS slope, round(regr_intercept(vw, g), 6) AS intercept, round(regr_r2(vw, g), 6) AS r2,
  round(corr(vw, g), 6) AS corr, round(avg(vw), 6) AS mean_return, round(avg(vw) / (stddev_samp(vw) / sqrt(count(*))), 6) AS t_mean FROM ({SQL_JOINED})""")
def flagship_return_on_growth(spark: SparkSession, d: str) -> DataFrame:
    """Monthly weighted portfolio return regressed on volume growth."""
    r = lambda c, n: F.round(c, 6).alias(n)
    return joined(spark, d).agg(
        F.count("*").alias("n"), r(F.regr_slope("vw", "g"), "slope"), r(F.regr_intercept("vw", "g"), "intercept"), r(F.regr_r2("vw", "g"), "r2"), r(F.corr("vw", "g"), "corr"),
        r(F.avg("vw"), "mean_return"), r(F.avg("vw") / (F.stddev_samp("vw") / F.sqrt(F.count("*"))), "t_mean"),
    )


_ORDER = ("LARGE", "MEDIUM", "PROMO", "SMALL", "ECONOMY", "STANDARD")


@query("""SELECT month, subfield, count(*) AS n FROM (SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m') AS month,
  CASE WHEN bool_or(p_type = 'LARGE') THEN 'LARGE' WHEN bool_or(p_type = 'MEDIUM') THEN 'MEDIUM' WHEN bool_or(p_type = 'PROMO') THEN 'PROMO' WHEN bool_or(p_type = 'SMALL') THEN 'SMALL' WHEN bool_or(p_type = 'ECONOMY') THEN 'ECONOMY' ELSE 'STANDARD' END AS subfield
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) GROUP BY ALL""")
def subfield_single_label(spark: SparkSession, d: str) -> DataFrame:
    """One label per order, the first in order of priority; as paper labels by category."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    has = rows.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ts"), *(F.bool_or(F.col("p_type") == t).alias(t) for t in _ORDER))
    label = F.lit(_ORDER[-1])
    for t in reversed(_ORDER[:-1]):
        label = F.when(F.col(t), t).otherwise(label)
    return has.select(dt.month_text(F.col("ts")).alias("month"), label.alias("subfield")).groupBy("month", "subfield").agg(F.count("*").alias("n"))


@query(f"SELECT strftime(m, '%Y-%m') AS month, subfield, n FROM ({SQL_TYPES})")
def subfield_multi_label(spark: SparkSession, d: str) -> DataFrame:
    return subfields(spark, d).select(mstr(), "subfield", "n")


@query(f"""WITH t AS ({SQL_TYPES}), p AS (SELECT m, {", ".join(f"coalesce(sum(n) FILTER (subfield = '{t}'), 0) AS {t}" for t in _ORDER)} FROM t GROUP BY m)
  SELECT strftime(m, '%Y-%m') AS month, {", ".join(f"CAST({t} AS BIGINT) AS {t}, round(ln(1 + {t}) - lag(ln(1 + {t})) OVER (ORDER BY m), 6) AS d_{t}" for t in _ORDER)} FROM p""")
def subfield_wide_growth(spark: SparkSession, d: str) -> DataFrame:
    wide = subfields(spark, d).groupBy("m").pivot("subfield", list(_ORDER)).agg(F.sum("n")).fillna(0)
    w = W.orderBy("m")
    cols = [c for t in _ORDER for c in (F.col(t), F.round(F.log1p(t) - F.lag(F.log1p(t)).over(w), 6).alias(f"d_{t}"))]
    return wide.select(mstr(), *cols)


@query("SELECT category, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS category FROM part) GROUP BY category")
def category_frequency(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "part").select(F.explode(F.split(F.trim("p_name"), r"\s+")).alias("category"))
    return cats.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query("""SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, c_mktsegment AS ticker, count(*) AS n, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(sum(o_totalprice), 2) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((y), (y, q), (ticker), (y, q, ticker))""")
def desc_by_grain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.year("o_orderdate").cast("bigint").alias("y"), F.quarter("o_orderdate").cast("bigint").alias("q"), F.col("c_mktsegment").alias("ticker"), F.col("o_totalprice").alias("x"))
    sets = [["y"], ["y", "q"], ["ticker"], ["y", "q", "ticker"]]
    cols = [F.col(c) for c in ("y", "q", "ticker")]
    g = rows.groupingSets([[F.col(c) for c in k] for k in sets], *cols)
    return g.agg(F.count("*").alias("n"), F.round(F.avg("x"), 2).alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.round(F.sum("x"), 2).alias("total"))


@query("""WITH f AS (SELECT c_nationkey AS firm, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  g AS (SELECT firm, m FROM (SELECT DISTINCT firm FROM f), (SELECT DISTINCT m FROM f))
  SELECT firm, strftime(m, '%Y-%m') AS month, coalesce(n, 0) AS n, lag(coalesce(n, 0)) OVER (PARTITION BY firm ORDER BY m) AS n_lag1, round(ln(1 + coalesce(n, 0)) - lag(ln(1 + coalesce(n, 0))) OVER (PARTITION BY firm ORDER BY m), 6) AS growth FROM g LEFT JOIN f USING (firm, m)""")
def firm_month_panel(spark: SparkSession, d: str) -> DataFrame:
    """All firms and months; months without orders have 0."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = rows.groupBy(F.col("c_nationkey").alias("firm"), dt.month(F.col("o_orderdate")).alias("m")).agg(F.count("*").alias("n"))
    p = s.filled_grid([f.select("firm").distinct(), f.select("m").distinct()], f, ["firm", "m"], {"n": 0})
    w = s.by(["firm"], ["m"])
    return p.select("firm", mstr(), "n", F.lag("n").over(w).alias("n_lag1"), F.round(F.log1p("n") - F.lag(F.log1p("n")).over(w), 6).alias("growth"))


SQL_FIRM_SUB = "SELECT c_mktsegment AS ticker, p_type AS subfield, date_trunc('month', l_shipdate) AS m, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"


def firm_subfields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keys = rows.select("o_orderkey", F.col("c_mktsegment").alias("ticker"), F.col("p_type").alias("subfield"), dt.month(F.col("l_shipdate")).alias("m")).distinct()
    return keys.groupBy("ticker", "subfield", "m").agg(F.count("*").alias("n"))


@query(f"""WITH f AS ({SQL_FIRM_SUB}), g AS (SELECT * FROM (SELECT DISTINCT ticker FROM f), (SELECT DISTINCT subfield FROM f), (SELECT DISTINCT m FROM f))
  SELECT ticker, subfield, strftime(m, '%Y-%m') AS month, coalesce(n, 0) AS n, lag(coalesce(n, 0)) OVER (PARTITION BY ticker, subfield ORDER BY m) AS n_lag1 FROM g LEFT JOIN f USING (ticker, subfield, m)""")
def firm_subfield_panel(spark: SparkSession, d: str) -> DataFrame:
    f = firm_subfields(spark, d)
    p = s.filled_grid([f.select(c).distinct() for c in ("ticker", "subfield", "m")], f, ["ticker", "subfield", "m"], {"n": 0})
    return p.select("ticker", "subfield", mstr(), "n", F.lag("n").over(s.by(["ticker", "subfield"], ["m"])).alias("n_lag1"))


@query(f"""WITH f AS ({SQL_FIRM_SUB}), g AS (SELECT ticker, subfield, n, ln(n) - lag(ln(n)) OVER (PARTITION BY ticker, subfield ORDER BY m) AS x FROM f)
  SELECT ticker, subfield, count(*) AS months, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 5) AS active, round(stddev_samp(x), 6) AS sd_growth FROM g GROUP BY ALL""")
def activity_summary(spark: SparkSession, d: str) -> DataFrame:
    g = firm_subfields(spark, d).withColumn("x", s.log_change(F.col("n"), s.by(["ticker", "subfield"], ["m"])))
    return g.groupBy("ticker", "subfield").agg(F.count("*").alias("months"), F.sum("n").alias("total"), F.count_if(F.col("n") > 5).alias("active"), F.round(F.stddev_samp("x"), 6).alias("sd_growth"))


SQL_CAP = "SELECT o_custkey AS permno, date_trunc('month', o_orderdate) AS m, year(o_orderdate) * 12 + month(o_orderdate) AS t, sum(o_totalprice) AS cap FROM orders GROUP BY ALL"


def caps(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("permno"), dt.month(F.col("o_orderdate")).alias("m"), dt.month_index(F.col("o_orderdate")).alias("t")).agg(F.sum("o_totalprice").alias("cap"))


@query(f"""WITH c AS ({SQL_CAP}) SELECT a.permno, strftime(a.m, '%Y-%m') AS month, round(a.cap, 2) AS cap, round(b.cap, 2) AS w_calendar, round(lag(a.cap) OVER (PARTITION BY a.permno ORDER BY a.t), 2) AS w_row FROM c a LEFT JOIN c b ON a.permno = b.permno AND a.t = b.t + 1""")
def calendar_lag_weights(spark: SparkSession, d: str) -> DataFrame:
    """The size one month earlier, missing after a gap, beside the size one row earlier. One window; no self-join."""
    w = s.by(["permno"], ["t"])
    return caps(spark, d).select("permno", mstr(), F.round("cap", 2).alias("cap"), F.round(s.calendar_lag("cap", "t", w), 2).alias("w_calendar"), F.round(F.lag("cap").over(w), 2).alias("w_row"))


_CODES = ("334111", "511210", "541512", "236220", "0", "325412", "518210", "448140", "513210", "621111", "517911", "722511")
"""Industry codes that stand in for those of firms; 0 means missing."""
SQL_CODE = f"[{', '.join(repr(c) for c in _CODES)}][1 + (l_partkey * 7 + month(l_shipdate)) % {len(_CODES)}]"
SQL_FIRM_CODES = f"SELECT l_suppkey AS permno, date_trunc('month', l_shipdate) AS m, l_orderkey, l_linenumber, l_quantity AS qty, nullif({SQL_CODE}, '0') AS code FROM lineitem"
_V1 = f"left(code, 4) IN ({', '.join(map(repr, lx.TECH_PREFIX4_V1))})"
_V2 = f"(left(code, 4) IN ({', '.join(map(repr, lx.TECH_PREFIX4_V2))}) OR code IN ({', '.join(map(repr, lx.TECH_CODES_V2))}))"


def firm_codes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    at = (F.col("l_partkey") * 7 + F.month("l_shipdate")) % len(_CODES)
    code = F.element_at(F.array(*map(F.lit, _CODES)), (at + 1).cast("int"))
    return li.select(F.col("l_suppkey").alias("permno"), dt.month(F.col("l_shipdate")).alias("m"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.nullif(code, F.lit("0")).alias("code"))


def tech_v1(code: Column) -> Column:
    return F.substring(code, 1, 4).isin(*lx.TECH_PREFIX4_V1)


def tech_v2(code: Column) -> Column:
    return F.substring(code, 1, 4).isin(*lx.TECH_PREFIX4_V2) | code.isin(*lx.TECH_CODES_V2)


@query(f"SELECT coalesce(code, 'missing') AS code, count(*) AS n, count(*) FILTER ({_V1}) AS v1, count(*) FILTER ({_V2}) AS v2 FROM ({SQL_FIRM_CODES}) GROUP BY ALL")
def tech_flags(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each code both versions of the technology flag take in; none of a missing code."""
    c = firm_codes(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.count_if(tech_v1(F.col("code"))).alias("v1"), F.count_if(tech_v2(F.col("code"))).alias("v2"))
    return c.withColumn("code", F.coalesce("code", F.lit("missing")))


SQL_COLLAPSE = f"""SELECT permno, count(code) AS valid, avg(CASE WHEN code IS NOT NULL THEN CAST({_V2} AS INT) END) AS share, arg_max({_V2}, (m, l_orderkey, l_linenumber, code)) FILTER (code IS NOT NULL) AS last_flag, bool_or({_V2}) AS ever FROM ({SQL_FIRM_CODES}) GROUP BY permno"""


def collapse(spark: SparkSession, d: str) -> DataFrame:
    f = firm_codes(spark, d).withColumn("flag", tech_v2(F.col("code")))
    order = F.when(F.col("code").isNotNull(), F.struct("m", "l_orderkey", "l_linenumber", "code"))
    return f.groupBy("permno").agg(F.count("code").alias("valid"), F.avg(F.col("flag").cast("int")).alias("share"), F.max_by("flag", order).alias("last_flag"), F.bool_or("flag").alias("ever"))


@query(f"""WITH f AS ({SQL_COLLAPSE}), k AS (SELECT permno, code FROM (SELECT permno, code, row_number() OVER (PARTITION BY permno ORDER BY count(*) DESC, code) AS r FROM ({SQL_FIRM_CODES}) WHERE code IS NOT NULL GROUP BY permno, code) WHERE r = 1)
  SELECT permno, valid, round(share, 6) AS share, share >= 0.5 AS tech, last_flag, ever, share > 0.2 AND share < 0.8 AS ambiguous, code AS modal_code FROM f LEFT JOIN k USING (permno)""")
def firm_collapse(spark: SparkSession, d: str) -> DataFrame:
    """One row per firm: share of technology months, majority flag (a tie is technology), last and ever flags, modal code."""
    k = s.mode_of(firm_codes(spark, d), ["permno"], "code", "modal_code")
    f = collapse(spark, d).join(k, "permno", "left")
    return f.select("permno", "valid", F.round("share", 6).alias("share"), (F.col("share") >= 0.5).alias("tech"), "last_flag", "ever", ((F.col("share") > 0.2) & (F.col("share") < 0.8)).alias("ambiguous"), "modal_code")


SQL_FIRM_RET = f"""SELECT permno, m, t, cap, w, cap / prev - 1 AS ret, tech FROM (SELECT *, lag(cap) OVER p AS prev, CASE WHEN t - lag(t) OVER p = 1 THEN lag(cap) OVER p END AS w FROM (SELECT l_suppkey AS permno, date_trunc('month', l_shipdate) AS m, year(l_shipdate) * 12 + month(l_shipdate) AS t, sum(l_extendedprice) AS cap FROM lineitem GROUP BY ALL) WINDOW p AS (PARTITION BY permno ORDER BY t)) JOIN (SELECT permno, share >= 0.5 AS tech FROM ({SQL_COLLAPSE})) USING (permno) WHERE w IS NOT NULL AND tech IS NOT NULL"""


def firm_returns(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    c = li.groupBy(F.col("l_suppkey").alias("permno"), dt.month(F.col("l_shipdate")).alias("m"), dt.month_index(F.col("l_shipdate")).alias("t")).agg(F.sum("l_extendedprice").alias("cap"))
    w = s.by(["permno"], ["t"])
    c = c.withColumn("w", s.calendar_lag("cap", "t", w)).withColumn("ret", F.col("cap") / F.lag("cap").over(w) - 1)
    tech = collapse(spark, d).select("permno", (F.col("share") >= 0.5).alias("tech"))
    return c.join(tech, "permno").filter("w IS NOT NULL AND tech IS NOT NULL")


SQL_SPREAD = f"""SELECT m, {", ".join(f"sum(w * ret) FILTER ({c}) / sum(w) FILTER ({c}) AS {n}_vw, avg(ret) FILTER ({c}) AS {n}_ew, count(*) FILTER ({c}) AS n_{n}" for n, c in (("tech", "tech"), ("nontech", "NOT tech")))} FROM ({SQL_FIRM_RET}) GROUP BY m"""


def spread(spark: SparkSession, d: str) -> DataFrame:
    """Weighted and plain means of both groups by conditional aggregates: one shuffle by month, combined in tasks first."""
    aggs = []
    for n, c in (("tech", F.col("tech")), ("nontech", ~F.col("tech"))):
        ret, w = F.when(c, F.col("ret")), F.when(c, F.col("w"))
        aggs += [s.weighted_mean(ret, w).alias(f"{n}_vw"), F.avg(ret).alias(f"{n}_ew"), F.count_if(c).alias(f"n_{n}")]
    return firm_returns(spark, d).groupBy("m").agg(*aggs)


@query(f"SELECT strftime(m, '%Y-%m') AS month, round(tech_vw, 6) AS tech_vw, round(nontech_vw, 6) AS nontech_vw, round(tech_vw - nontech_vw, 6) AS spread_vw, round(tech_ew - nontech_ew, 6) AS spread_ew, n_tech, n_nontech FROM ({SQL_SPREAD})")
def tech_spread(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d).select(mstr(), F.round("tech_vw", 6).alias("tech_vw"), F.round("nontech_vw", 6).alias("nontech_vw"), F.round(F.col("tech_vw") - F.col("nontech_vw"), 6).alias("spread_vw"), F.round(F.col("tech_ew") - F.col("nontech_ew"), 6).alias("spread_ew"), "n_tech", "n_nontech")


SQL_SIZE = f"""WITH f AS ({SQL_FIRM_RET}), c AS (SELECT m, quantile_cont(w, [0.2, 0.4, 0.6, 0.8]) AS q FROM f GROUP BY m),
  b AS (SELECT f.*, 1 + CAST(w > q[1] AS INT) + CAST(w > q[2] AS INT) + CAST(w > q[3] AS INT) + CAST(w > q[4] AS INT) AS size FROM f JOIN c USING (m))
  SELECT m, size, count(*) AS n, sum(w * ret) FILTER (tech) / sum(w) FILTER (tech) - sum(w * ret) FILTER (NOT tech) / sum(w) FILTER (NOT tech) AS spread FROM b GROUP BY m, size"""


def size_spread(spark: SparkSession, d: str) -> DataFrame:
    b = s.quantile_bucket(firm_returns(spark, d), "w", ["m"], 5, "size")
    one = lambda c: s.weighted_mean(F.when(c, F.col("ret")), F.when(c, F.col("w")))
    return b.groupBy("m", "size").agg(F.count("*").alias("n"), (one(F.col("tech")) - one(~F.col("tech"))).alias("spread"))


@query(f"SELECT strftime(m, '%Y-%m') AS month, size, n, round(spread, 6) AS spread FROM ({SQL_SIZE})")
def size_quintile_spread(spark: SparkSession, d: str) -> DataFrame:
    return size_spread(spark, d).select(mstr(), "size", "n", F.round("spread", 6).alias("spread"))


SQL_DESEASON = f"""SELECT m, month(m) AS mth, n, g AS x_raw, g - avg(g) OVER (PARTITION BY month(m)) AS x_demean, ln(n) - lag(ln(n), 12) OVER (ORDER BY m) AS x_yoy,
  CASE WHEN count(g) OVER w >= 3 THEN g - avg(g) OVER w END AS x_roll FROM ({SQL_GROWTH}) WINDOW w AS (PARTITION BY month(m) ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def deseasoned(spark: SparkSession, d: str) -> DataFrame:
    """Growth raw, less its calendar-month mean, over twelve months, and less the mean of earlier same months (three at least)."""
    g = growth(spark, d).withColumn("mth", F.month("m"))
    return g.select("m", "mth", "n", F.col("g").alias("x_raw"), s.demeaned("g", "mth").alias("x_demean"), (F.ln("n") - F.lag(F.ln("n"), 12).over(W.orderBy("m"))).alias("x_yoy"), (F.col("g") - s.prior_mean("g", ["mth"], "m", 3)).alias("x_roll"))


@query(f"SELECT strftime(m, '%Y-%m') AS month, {', '.join(f'round({c}, 6) AS {c}' for c in ('x_raw', 'x_demean', 'x_yoy', 'x_roll'))} FROM ({SQL_DESEASON})")
def deseason(spark: SparkSession, d: str) -> DataFrame:
    return deseasoned(spark, d).select(mstr(), *(F.round(c, 6).alias(c) for c in ("x_raw", "x_demean", "x_yoy", "x_roll")))


@query(f"SELECT strftime(m, '%Y-%m') AS month, round(exp(sum(ew) OVER (ORDER BY m)) - 1, 6) AS cum_return, CAST(sum(n) OVER (ORDER BY m) AS BIGINT) AS cum_n FROM ({SQL_PORT})")
def cumulative_return(spark: SparkSession, d: str) -> DataFrame:
    w = W.orderBy("m").rowsBetween(W.unboundedPreceding, 0)
    return portfolio(spark, d).select(mstr(), F.round(F.exp(F.sum("ew").over(w)) - 1, 6).alias("cum_return"), F.sum("n").over(w).alias("cum_n"))


@query(f"""SELECT round(min(vw), 6) AS min, round(quantile_cont(vw, 0.25), 6) AS q1, round(median(vw), 6) AS median, round(avg(vw), 6) AS mean, round(quantile_cont(vw, 0.75), 6) AS q3, round(max(vw), 6) AS max, round(pow(1 + avg(vw), 12) - 1, 6) AS annualised FROM ({SQL_PORT})""")
def return_summary(spark: SparkSession, d: str) -> DataFrame:
    p = portfolio(spark, d)
    r = lambda c, n: F.round(c, 6).alias(n)
    return p.agg(r(F.min("vw"), "min"), r(F.percentile("vw", 0.25), "q1"), r(F.median("vw"), "median"), r(F.avg("vw"), "mean"), r(F.percentile("vw", 0.75), "q3"), r(F.max("vw"), "max"), r(F.pow(1 + F.avg("vw"), 12) - 1, "annualised"))


@query(f"""WITH y AS (SELECT c_mktsegment AS grp, year(o_orderdate) AS y, count(*) AS n, count(DISTINCT o_custkey) AS n_firms FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT grp, y, n, n_firms, round(100.0 * n / max(n) FILTER (y = 1996) OVER (PARTITION BY grp), 4) AS index_1996, round(100.0 * n / sum(n) OVER (PARTITION BY y), 4) AS share FROM y""")
def index_base_year(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = rows.groupBy(F.col("c_mktsegment").alias("grp"), F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_firms"))
    base = F.max(F.when(F.col("y") == 1996, F.col("n"))).over(W.partitionBy("grp"))
    return y.select("grp", "y", "n", "n_firms", F.round(100.0 * F.col("n") / base, 4).alias("index_1996"), F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("y")), 4).alias("share"))


@query("""WITH p AS (SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT year(l_shipdate) AS y, count(*) AS k FROM lineitem WHERE l_suppkey IN (0, 1, 2, 3, 4, 5) GROUP BY 1)
  SELECT y, n, coalesce(k, 0) AS k, round(n / lag(n) OVER (ORDER BY y) - 1, 6) AS n_yoy, round(k / lag(k) OVER (ORDER BY y) - 1, 6) AS k_yoy FROM p LEFT JOIN f USING (y)""")
def yoy_premise_check(spark: SparkSession, d: str) -> DataFrame:
    """Yearly growth of all volume beside that of six firms; one pass."""
    six = F.col("l_suppkey").isin(*range(6))
    y = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("y")).agg(F.count("*").alias("n"), F.count_if(six).alias("k"))
    w = W.orderBy("y")
    rate = lambda c: F.round(F.nullif(F.col(c), F.lit(0)) / F.nullif(F.lag(c).over(w), F.lit(0)) - 1, 6)
    return y.select("y", "n", "k", rate("n").alias("n_yoy"), rate("k").alias("k_yoy"))


_COLS6 = [f"firm_{i}" for i in range(6)]


@query("SELECT year(l_shipdate) AS y, " + ", ".join(f"count(*) FILTER (l_suppkey = {i}) AS firm_{i}" for i in range(6)) + " FROM lineitem WHERE l_suppkey < 6 GROUP BY 1")
def firm_year_matrix(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_suppkey < 6").select(F.year("l_shipdate").cast("bigint").alias("y"), F.concat(F.lit("firm_"), F.col("l_suppkey").cast("string")).alias("firm"))
    return li.groupBy("y").pivot("firm", _COLS6).count().fillna(0)


@query("""SELECT o_custkey AS firm, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY n DESC, firm LIMIT 20""")
def topk_firms(spark: SparkSession, d: str) -> DataFrame:
    """The twenty firms with most orders; ties by key."""
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("firm")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.orderBy(F.desc("n"), "firm").limit(20)


@query(f"""SELECT strftime(m, '%Y-%m') AS month, metric, round(value, 6) AS value FROM (SELECT m, vw, ew, vol FROM ({SQL_PORT})) UNPIVOT INCLUDE NULLS (value FOR metric IN (vw, ew, vol))""")
def unpivot_metrics(spark: SparkSession, d: str) -> DataFrame:
    long = portfolio(spark, d).unpivot("m", ["vw", "ew", "vol"], "metric", "value")
    return long.select(mstr(), "metric", F.round("value", 6).alias("value"))
