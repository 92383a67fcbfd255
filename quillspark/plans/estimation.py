"""Estimates: those that SQL can express as aggregates and windows, and those per group in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.tail_columns import sql_f_upper, sql_t_two_sided
from quillspark.operators import estimators as es
from quillspark.operators import series as s
from quillspark.plans import market as mk
from quillspark.plans import regression_sql as sq
from quillspark.plans.registry import query
from quillspark.sources.tables import table

SQL_G = f"SELECT m, mth, x_raw FROM ({mk.SQL_DESEASON}) WHERE x_raw IS NOT NULL"


@query(f"""WITH g AS ({SQL_G}), a AS (SELECT mth, count(*) AS n, avg(x_raw) AS mean FROM g GROUP BY mth), t AS (SELECT count(*) AS n, avg(x_raw) AS mean, var_samp(x_raw) * (count(*) - 1) AS sst FROM g),
  b AS (SELECT sum(a.n * (a.mean - t.mean) * (a.mean - t.mean)) AS ssb, count(*) AS k FROM a, t) SELECT k AS groups, n, round(ssb / sst, 6) AS share, round((ssb / (k - 1)) / ((sst - ssb) / (n - k)), 6) AS f FROM b, t""")
def anova_month(spark: SparkSession, d: str) -> DataFrame:
    """One-way analysis of variance of growth by calendar month, from grouped sums."""
    g = mk.deseasoned(spark, d).filter("x_raw IS NOT NULL")
    a = g.groupBy("mth").agg(F.count("*").alias("n"), F.sum("x_raw").alias("s"), F.sum(F.col("x_raw") ** 2).alias("q"))
    t = a.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n")).alias("ssb"), (F.sum("q") - F.sum("s") ** 2 / F.sum("n")).alias("sst"))
    f = (F.col("ssb") / (F.col("groups") - 1)) / ((F.col("sst") - F.col("ssb")) / (F.col("n") - F.col("groups")))
    return t.select("groups", "n", F.round(F.col("ssb") / F.col("sst"), 6).alias("share"), F.round(f, 6).alias("f"))


@query(f"""WITH g AS (SELECT m, x_raw - avg(x_raw) OVER () AS x FROM ({SQL_G})) SELECT count(*) AS n, round(sum(x * p) / sum(x * x), 6) AS acf1 FROM (SELECT x, lag(x) OVER (ORDER BY m) AS p FROM g)""")
def acf1(spark: SparkSession, d: str) -> DataFrame:
    g = mk.deseasoned(spark, d).filter("x_raw IS NOT NULL").select("m", (F.col("x_raw") - F.avg("x_raw").over(W.partitionBy())).alias("x"))
    return g.withColumn("p", F.lag("x").over(W.orderBy("m"))).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("p")) / F.sum(F.col("x") ** 2), 6).alias("acf1"))


@query(f"SELECT ticker, count(*) AS n, round(avg(ret), 6) AS mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) AS t FROM ({mk.SQL_RET}) GROUP BY ticker")
def ttest_mean(spark: SparkSession, d: str) -> DataFrame:
    return mk.returns(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("*"))), 6).alias("t"))


_Z = " + ".join(f"2 * {1 - k / 5} * sum(z * z{k})" for k in range(1, 5))
SQL_HAC = f"""WITH j AS ({mk.SQL_JOINED}), f AS (SELECT regr_slope(vw, g) AS b, regr_intercept(vw, g) AS a, count(*) AS n, avg(g) AS mx, regr_sxx(vw, g) AS sxx, regr_r2(vw, g) AS r2 FROM j),
  z AS (SELECT m, (g - mx) / sxx * (vw - a - b * g) AS z FROM j, f), l AS (SELECT z, {", ".join(f"coalesce(lag(z, {k}) OVER (ORDER BY m), 0) AS z{k}" for k in range(1, 5))} FROM z)
  SELECT n, round(b, 6) AS b, round(sqrt(sum(z * z) + {_Z}), 6) AS se, round(b / sqrt(sum(z * z) + {_Z}), 6) AS t, round(r2, 6) AS r2 FROM l, f GROUP BY n, b, r2"""


@query(SQL_HAC)
def hac_simple(spark: SparkSession, d: str) -> DataFrame:
    """Newey-West error of one slope by windows: z is the influence of a month, its lag products have Bartlett weights."""
    j = mk.joined(spark, d)
    all_ = W.partitionBy()
    f = j.select("m", "vw", "g", F.regr_slope("vw", "g").over(all_).alias("b"), F.regr_intercept("vw", "g").over(all_).alias("a"), F.avg("g").over(all_).alias("mx"), F.regr_sxx("vw", "g").over(all_).alias("sxx"), F.regr_r2("vw", "g").over(all_).alias("r2"))
    z = f.withColumn("z", (F.col("g") - F.col("mx")) / F.col("sxx") * (F.col("vw") - F.col("a") - F.col("b") * F.col("g")))
    w = W.orderBy("m")
    z = z.select("*", *(F.lag("z", k, 0.0).over(w).alias(f"z{k}") for k in range(1, 5)))
    var = F.sum(F.col("z") ** 2)
    for k in range(1, 5):
        var = var + 2 * (1 - k / 5) * F.sum(F.col("z") * F.col(f"z{k}"))
    out = z.agg(F.count("*").alias("n"), F.first("b").alias("b"), var.alias("v"), F.first("r2").alias("r2"))
    return out.select("n", F.round("b", 6).alias("b"), F.round(F.sqrt("v"), 6).alias("se"), F.round(F.col("b") / F.sqrt("v"), 6).alias("t"), F.round("r2", 6).alias("r2"))


SQL_PV = "SELECT ticker, month(o) AS lagno, 1.0 / (1 + abs(sum(x))) AS p FROM (SELECT c_mktsegment AS ticker, o_orderdate AS o, c_acctbal / 1e4 - 0.45 AS x FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL"


@query(f"""WITH p AS ({SQL_PV}), r AS (SELECT *, count(*) OVER (PARTITION BY ticker) * p / row_number() OVER (PARTITION BY ticker ORDER BY p, lagno) AS q FROM p)
  SELECT ticker, lagno, round(p, 6) AS p, round(least(1, min(q) OVER (PARTITION BY ticker ORDER BY p DESC, lagno DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_adjusted, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars FROM r""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Benjamini-Hochberg within families."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = rows.groupBy(F.col("c_mktsegment").alias("ticker"), F.month("o_orderdate").cast("bigint").alias("lagno")).agg((1 / (1 + F.abs(F.sum(F.col("c_acctbal") / 1e4 - 0.45)))).alias("p"))
    q = s.benjamini_hochberg(p, "p", ["ticker"], ["lagno"])
    return q.select("ticker", "lagno", F.round("p", 6).alias("p"), F.round("p_adjusted", 6).alias("p_adjusted"), s.stars(F.col("p")).alias("stars"))


SQL_FY = "SELECT c_nationkey AS firm, year(o_orderdate) AS y, count(*) AS n, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def firm_years(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("firm"), F.year("o_orderdate").cast("bigint").alias("y")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"))


def _rank(c: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


@query(f"SELECT y, count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT y, {_rank('n', 'y')} AS a, {_rank('price', 'y')} AS b FROM ({SQL_FY})) GROUP BY y HAVING count(*) >= 3")
def spearman_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation with mean ranks of ties, per group of three rows at least."""
    r = firm_years(spark, d).dropna().select("y", s.average_rank("n", "y").alias("a"), s.average_rank("price", "y").alias("b"))
    return r.groupBy("y").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("rho")).filter("n >= 3")


@query(f"""WITH j AS (SELECT vw, g, row_number() OVER (ORDER BY m) AS i, m FROM ({mk.SQL_JOINED})), n AS (SELECT count(*) AS n, regr_syy(vw, g) - regr_sxy(vw, g) * regr_sxy(vw, g) / regr_sxx(vw, g) AS rss0 FROM j),
  k AS (SELECT unnest(range(CAST(floor(0.15 * n) AS BIGINT), CAST(ceil(0.85 * n) AS BIGINT) + 1)) AS k FROM n),
  r AS (SELECT k, i >= k AS late, regr_syy(vw, g) - regr_sxy(vw, g) * regr_sxy(vw, g) / regr_sxx(vw, g) AS rss FROM j, k GROUP BY ALL), t AS (SELECT k, sum(rss) AS rss1 FROM r GROUP BY k)
  SELECT strftime(m, '%Y-%m') AS month, k, round(((rss0 - rss1) / 2) / (rss1 / (n - 4)), 5) AS f FROM t, n JOIN j ON i = k""")
def supf_scan(spark: SparkSession, d: str) -> DataFrame:
    """F statistic of a break at every candidate month, by prefix sums (one ordered pass, no grid of months)."""
    j = mk.joined(spark, d)
    every = W.partitionBy()
    before = W.orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    terms = {"c": F.lit(1.0), "x": F.col("g"), "y": F.col("vw"), "xx": F.col("g") ** 2, "xy": F.col("g") * F.col("vw"), "yy": F.col("vw") ** 2}
    p = j.select("m", F.row_number().over(W.orderBy("m")).cast("bigint").alias("k"), *(F.sum(v).over(before).alias(f"a_{k}") for k, v in terms.items()), *(F.sum(v).over(every).alias(f"t_{k}") for k, v in terms.items()))
    p = p.select("*", *((F.col(f"t_{k}") - F.col(f"a_{k}")).alias(f"b_{k}") for k in terms))

    def rss(side: str):  # noqa: ANN202
        v = {k: F.col(f"{side}_{k}") for k in terms}
        xx, xy, yy = (v[a] - v[b] * v[c] / v["c"] for a, b, c in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
        return yy - xy * xy / xx

    n = F.col("t_c")
    p = p.filter((F.col("k") >= F.floor(0.15 * n)) & (F.col("k") <= F.ceil(0.85 * n)))
    split = rss("a") + rss("b")
    return p.select(mk.mstr(), "k", F.round(((rss("t") - split) / 2) / (split / (n - 4)), 5).alias("f"))


_CUTS = ("1996-01", "1998-01", "2000-01")


@query(" UNION ALL ".join(f"SELECT '{c}' AS cut, round(regr_slope(vw, g) FILTER (strftime(m, '%Y-%m') < '{c}'), 6) AS b_before, round(regr_slope(vw, g) FILTER (strftime(m, '%Y-%m') >= '{c}'), 6) AS b_after, count(*) FILTER (strftime(m, '%Y-%m') < '{c}') AS n_before FROM ({mk.SQL_JOINED})" for c in _CUTS))
def split_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Slopes before and after fixed cuts; the interaction is their difference."""
    j = mk.joined(spark, d).withColumn("cut", F.explode(F.array(*map(F.lit, _CUTS))))
    early = F.date_format("m", "yyyy-MM") < F.col("cut")
    side = lambda c, n: F.round(F.regr_slope(F.when(c, F.col("vw")), F.when(c, F.col("g"))), 6).alias(n)
    return j.groupBy("cut").agg(side(early, "b_before"), side(~early, "b_after"), F.count_if(early).alias("n_before"))


@query(f"SELECT strftime(m, '%Y-%m') AS month, round(b, 6) AS b, n FROM (SELECT m, regr_slope(vw, g) OVER w AS b, count(*) OVER w AS n FROM ({mk.SQL_JOINED}) WINDOW w AS (ORDER BY m ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)) WHERE n = 36")
def rolling_slope(spark: SparkSession, d: str) -> DataFrame:
    w = W.orderBy("m").rowsBetween(-35, 0)
    r = mk.joined(spark, d).select("m", F.regr_slope("vw", "g").over(w).alias("b"), F.count("*").over(w).alias("n")).filter("n = 36")
    return r.select(mk.mstr(), F.round("b", 6).alias("b"), "n")


@query(f"SELECT size, count(*) AS n, round(regr_slope(spread, g), 6) AS b, round(regr_r2(spread, g), 6) AS r2 FROM ({mk.SQL_SIZE}) z JOIN ({mk.SQL_GROWTH}) v ON z.m = v.m WHERE g IS NOT NULL AND spread IS NOT NULL GROUP BY size")
def size_quintile_slopes(spark: SparkSession, d: str) -> DataFrame:
    z = mk.size_spread(spark, d).select("m", "size", "spread").join(mk.growth(spark, d).select("m", "g"), "m").dropna()
    return z.groupBy("size").agg(F.count("*").alias("n"), F.round(F.regr_slope("spread", "g"), 6).alias("b"), F.round(F.regr_r2("spread", "g"), 6).alias("r2"))


SQL_PANEL = f"SELECT ticker, m, r.ret - avg(r.ret) OVER p AS y, g - avg(g) OVER p AS x FROM ({mk.SQL_RET}) r JOIN ({mk.SQL_GROWTH}) v USING (m) WHERE g IS NOT NULL WINDOW p AS (PARTITION BY ticker)"


@query(f"""WITH d AS ({SQL_PANEL}), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n FROM d), c AS (SELECT ticker, sum(x * (y - b * x)) AS e FROM d, b GROUP BY ticker)
  SELECT n, (SELECT count(*) FROM c) AS firms, round(b, 6) AS b, round(sqrt((SELECT sum(e * e) FROM c) * n / (n - 1)) / sxx, 6) AS se FROM b""")
def panel_fe(spark: SparkSession, d: str) -> DataFrame:
    """Firm fixed effects by demeaning, error clustered by firm with n / (n - k)."""
    j = mk.returns(spark, d).join(mk.growth(spark, d).select("m", "g").dropna(), "m")
    w = j.select("ticker", s.demeaned("ret", "ticker").alias("y"), s.demeaned("g", "ticker").alias("x"))
    # the score of a firm is sum(xy) - b sum(xx), so two sums per firm are enough
    c = w.groupBy("ticker").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") ** 2).alias("xx"), F.count("*").alias("n"))
    every = W.partitionBy()
    c = c.select("*", (F.sum("xy").over(every) / F.sum("xx").over(every)).alias("b"))
    out = c.agg(F.sum("n").alias("n"), F.count("*").alias("firms"), F.first("b").alias("b"), F.sum((F.col("xy") - F.col("b") * F.col("xx")) ** 2).alias("e2"), F.sum("xx").alias("sxx"))
    return out.select("n", "firms", F.round("b", 6).alias("b"), F.round(F.sqrt(F.col("e2") * F.col("n") / (F.col("n") - 1)) / F.col("sxx"), 6).alias("se"))


# --- per group in numpy ----------------------------------------------------------------------------------------------


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """ticker, subfield, m, y (return) and x (growth of the subfield): one group per pair."""
    x = mk.subfields(spark, d).withColumn("x", s.log_change(F.col("n"), s.by(["subfield"], ["m"]))).filter("x IS NOT NULL").select("subfield", "m", "x")
    return mk.returns(spark, d).select("ticker", "m", F.col("ret").alias("y")).join(x, "m")


def per_pair(df: DataFrame, keys: list[str], estimate: Callable[[np.ndarray, np.ndarray], list[dict]], columns: dict[str, str]) -> DataFrame:
    """Runs an estimator on the ordered series of each group; groups it can't use give no rows."""
    names = list(columns)
    types = dict(df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{k} {t}" for k, t in columns.items()])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        rows = estimate(pdf["y"].to_numpy(float), pdf["x"].to_numpy(float))
        return es.frame(rows, names, **{k: pdf[k].iloc[0] for k in keys})

    return df.groupBy(*keys).applyInPandas(run, schema)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits."""
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _one(row: dict | None) -> list[dict]:
    return [] if row is None else [row]


SQL_PAIRS = f"""SELECT ticker, subfield, m, y, x, row_number() OVER p AS i, count(*) OVER (PARTITION BY ticker, subfield) AS len, {", ".join(f"lag(x, {k}) OVER p AS x{k}" for k in range(1, 12))}, lag(y, 1) OVER p AS y1, lag(y, 2) OVER p AS y2 FROM
  (SELECT r.ticker, v.subfield, r.m, r.ret AS y, v.x FROM ({mk.SQL_RET}) r JOIN (SELECT subfield, m, ln(n) - lag(ln(n)) OVER (PARTITION BY subfield ORDER BY m) AS x FROM ({mk.SQL_TYPES})) v ON r.m = v.m WHERE v.x IS NOT NULL) WINDOW p AS (PARTITION BY ticker, subfield ORDER BY m)"""
"""Pairs with their lags; `len` months each."""
_ARDL = ["x", "x1", "x2", "x3", "y1"]
_ARDL_TERMS = [(i, [c for c in _ARDL if c != x] + [x]) for i, x in enumerate(_ARDL[:4])] + [(-1, ["x1 - x", "x2 - x", "x3 - x", "y1", "x"])]
_KEYS = "ticker, subfield"


@query(" UNION ALL ".join(
    f"""SELECT {_KEYS}, CAST({term} AS INT) AS term, round(b, 6) AS b, round(se, 6) AS se, round({sql_t_two_sided("b / se", "n - 6.0")}, 6) AS p, n, round(r2, 6) AS r2 FROM ({sq.coefficient(f"SELECT * FROM ({SQL_PAIRS}) WHERE i > 3 AND len >= 30", _KEYS, columns, 3)})""" for term, columns in _ARDL_TERMS))
def ardl_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distributed lags 0 to 3 with the first own lag, per pair; term -1 is the sum of effects."""
    return rounded(per_pair(pairs(spark, d), ["ticker", "subfield"], es.ardl, {"term": "int", "b": "double", "se": "double", "p": "double", "n": "bigint", "r2": "double"}))


_CUM = " UNION ALL ".join(f"""SELECT {_KEYS}, CAST({h} AS INT) AS h, b AS effect, se, n FROM ({sq.coefficient(f"SELECT * FROM ({SQL_PAIRS}) WHERE i >= {h} AND len >= 36", _KEYS, [*(f"x{i} - x" for i in range(1, h)), "x"], 6, adjust=True)})""" for h in range(1, 13))
SQL_CUM = f"SELECT *, {sq.normal_two_sided('effect / se')} AS p FROM ({_CUM})"
_STARS = "CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars"


def effects(spark: SparkSession, d: str) -> DataFrame:
    out = per_pair(pairs(spark, d), ["ticker", "subfield"], es.cumulative, {"h": "int", "effect": "double", "se": "double", "p": "double", "n": "bigint"})
    return out.withColumn("stars", s.stars(F.col("p")))


@query(f"SELECT {_KEYS}, h, round(effect, 6) AS effect, round(se, 6) AS se, round(p, 6) AS p, n, {_STARS} FROM ({SQL_CUM})")
def cum_effect_1_12(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative effects over 1 to 12 months per pair, with stars."""
    return rounded(effects(spark, d))


@query(f"""SELECT {_KEYS}, h, round(effect, 6) AS effect, round(se, 6) AS se, round(p, 6) AS p, n, {_STARS} FROM (SELECT * FROM ({SQL_CUM}) WHERE effect IS NOT NULL AND NOT isnan(effect) QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY abs(effect) DESC, h) = 1)
  ORDER BY abs(effect) DESC, {_KEYS} LIMIT 20""")
def best_horizon(spark: SparkSession, d: str) -> DataFrame:
    """The horizon of the largest absolute effect per pair, and the twenty largest."""
    best = s.first_match(effects(spark, d).filter("effect IS NOT NULL AND NOT isnan(effect)"), ["ticker", "subfield"], F.desc(F.abs("effect")), F.col("h"))
    return rounded(best.orderBy(F.desc(F.abs("effect")), "ticker", "subfield").limit(20))


def _granger_sql(direction: str, rows: str) -> str:
    lags = f"SELECT * FROM (SELECT *, row_number() OVER p AS i, count(*) OVER (PARTITION BY {_KEYS}) AS len, lag(y, 1) OVER p AS ya, lag(y, 2) OVER p AS yb, lag(x, 1) OVER p AS xa, lag(x, 2) OVER p AS xb FROM ({rows}) WINDOW p AS (PARTITION BY {_KEYS} ORDER BY m)) WHERE i > 2 AND len >= 10"
    f = "((a.rss - b.rss) / 2) / (b.rss / (b.n - 5))"
    return f"""SELECT {_KEYS}, '{direction}' AS direction, round(f, 6) AS f, round({sql_f_upper("f", "2.0", "n - 5.0")}, 6) AS p, n FROM (SELECT b.*, {f} AS f FROM ({sq.rss(lags, _KEYS, ["ya", "yb"])}) a JOIN ({sq.rss(lags, _KEYS, ["ya", "yb", "xa", "xb"])}) b USING ({_KEYS}))"""


@query(_granger_sql("x_to_y", f"SELECT {_KEYS}, m, y, x FROM ({SQL_PAIRS})") + " UNION ALL " + _granger_sql("y_to_x", f"SELECT {_KEYS}, m, x AS y, y AS x FROM ({SQL_PAIRS})"))
def granger(spark: SparkSession, d: str) -> DataFrame:
    """Both directions per pair."""
    both = lambda y, x: [r | {"direction": k} for k, r in (("x_to_y", es.granger(y, x)), ("y_to_x", es.granger(x, y))) if r]
    return rounded(per_pair(pairs(spark, d), ["ticker", "subfield"], both, {"direction": "string", "f": "double", "p": "double", "n": "bigint"}))


SQL_UNIT = f"SELECT ticker, m, y, lag(y) OVER p AS level, y - lag(y) OVER p AS dy, row_number() OVER p - 1.0 AS trend, count(*) OVER (PARTITION BY ticker) AS len FROM (SELECT ticker, m, ln(price) AS y FROM ({mk.SQL_MONTHLY})) WINDOW p AS (PARTITION BY ticker ORDER BY m)"


def _adf_sql(k: int) -> str:
    """Tests of the series whose length calls for k - 1 lagged differences."""
    lags = "".join(f", lag(dy, {i}) OVER (PARTITION BY ticker ORDER BY m) AS d{i}" for i in range(1, k))
    rows = f"SELECT ticker, m, dy AS y, level, trend, len{''.join(f', d{i}' for i in range(1, k))} FROM (SELECT *{lags} FROM ({SQL_UNIT})) WHERE trend >= {k} AND len >= 10 AND CAST(floor(pow(len - 1, 1.0 / 3)) AS INT) + 1 = {k}"
    quantile = lambda j: sq.interpolated("size", [f"{n}.0" for n in es.ADF_N], [f"({row[j]})" for row in es.ADF_Q])
    found = f"SELECT f.ticker, t, n + {k - 1} AS size, n + {k} AS len FROM ({sq.plain_t(rows, 'ticker', ['trend', *(f'd{i}' for i in range(1, k)), 'level'])}) f"
    cut = f"SELECT *, {', '.join(f'{quantile(j)} AS q{j}' for j in range(len(es.ADF_P)))} FROM ({found})"
    return f"SELECT ticker, round(t, 6) AS t, round({sq.interpolated('t', [f'q{j}' for j in range(len(es.ADF_P))], [str(p) for p in es.ADF_P])}, 6) AS p, CAST({k - 1} AS INT) AS lags, CAST(len AS BIGINT) AS n FROM ({cut})"


@query(" UNION ALL ".join(map(_adf_sql, range(3, 8))))
def adf(spark: SparkSession, d: str) -> DataFrame:
    """Unit-root tests of the returns and prices of each ticker."""
    y = mk.monthly_prices(spark, d).select("ticker", "m", F.ln("price").alias("y"), F.lit(0.0).alias("x"))
    return rounded(per_pair(y, ["ticker"], lambda y, x: _one(es.adf(y)), {"t": "double", "p": "double", "lags": "int", "n": "bigint"}))


@query()
def var_irf(spark: SparkSession, d: str) -> DataFrame:
    """Impulse responses of each ticker's return to volume growth, with bootstrap bands."""
    y = mk.returns(spark, d).select("ticker", "m", F.col("ret").alias("y")).join(mk.growth(spark, d).select("m", F.col("g").alias("x")).dropna(), "m")
    return per_pair(y, ["ticker"], es.irf, {"h": "int", "irf": "double", "lower": "double", "upper": "double", "order": "int", "star": "string"})


@query()
def deseason_stl(spark: SparkSession, d: str) -> DataFrame:
    """Growth of the seasonally adjusted log volume."""
    v = mk.volume(spark, d).select("m", F.ln("n").alias("lp"), F.lit(1).alias("one"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        lp = pdf["lp"].to_numpy(float)
        seasonal = es.stl_periodic(lp) if len(lp) >= 24 else np.full(len(lp), np.nan)
        x = np.append(np.nan, np.diff(lp - seasonal))
        return pd.DataFrame({"m": pdf["m"], "seasonal": seasonal, "x_stl": [None if np.isnan(a) else a for a in x]})

    return v.groupBy("one").applyInPandas(run, "m date, seasonal double, x_stl double").select(mk.mstr(), "seasonal", "x_stl")


@query()
def bootstrap_p(spark: SparkSession, d: str) -> DataFrame:
    """The largest break statistic and its residual-bootstrap p value; repetitions are spread over tasks, each with its seed."""
    j = mk.joined(spark, d).groupBy().agg(F.array_sort(F.collect_list(F.struct("m", "vw", "g"))).alias("z"))
    reps = spark.range(0, 2000, 1, 16).withColumnRenamed("id", "seed")
    rows = reps.join(j.select(F.transform("z", lambda r: r["vw"]).alias("y"), F.transform("z", lambda r: r["g"]).alias("x")))

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            if len(pdf):
                y, x = np.array(pdf["y"].iloc[0]), np.array(pdf["x"].iloc[0])
                yield pd.DataFrame({"draw": es.sup_f_draws(y, x, pdf["seed"].to_numpy()), "sup": float(es.sup_f(y, x)[1].max())})

    out = rows.mapInPandas(run, "draw double, sup double")
    return out.agg(F.count("*").alias("reps"), F.first("sup").alias("sup_f"), F.avg((F.col("draw") >= F.col("sup")).cast("double")).alias("p"), F.percentile("draw", 0.95).alias("critical_95"))


SPECS = {"all": "true", "before_1999": "year(m) < 1999", "from_1999": "year(m) >= 1999", "without_1998": "year(m) <> 1998", "without_january": "month(m) <> 1"}


_SQL_X = f"SELECT *, row_number() OVER (ORDER BY abs(g) DESC, m) AS extreme FROM ({mk.SQL_JOINED})"
_SQL_SPECS = " UNION ALL ".join(f"SELECT '{k}' AS spec, '{w}' AS weighting, m, {w} AS y, g AS x FROM ({_SQL_X}) WHERE {cond}" for k, cond in {**SPECS, "without_top3": "extreme > 3"}.items() for w in ("vw", "ew"))


@query(f"""SELECT spec, weighting, round(b, 6) AS b, round(se, 6) AS se, round(b / se, 6) AS t, round(p, 6) AS p, n, round(r2, 6) AS r2, CASE WHEN p < 0.05 THEN 'significant' WHEN p < 0.1 THEN 'marginal' ELSE 'not significant' END AS verdict
  FROM (SELECT *, {sql_t_two_sided("b / se", "n - 2.0")} AS p FROM ({sq.coefficient(_SQL_SPECS, "spec, weighting", ["x"], 4)}))""")
def fragility_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Slope with Newey-West error in every specification and both weightings, also without the three most extreme months."""
    j = mk.joined(spark, d).withColumn("extreme", F.row_number().over(W.orderBy(F.desc(F.abs("g")), "m")))
    parts = [j.filter(w).withColumn("spec", F.lit(k)) for k, w in {**SPECS, "without_top3": "extreme > 3"}.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    long = rows.unpivot(["spec", "m", "g"], ["vw", "ew"], "weighting", "y").withColumnRenamed("g", "x")
    out = per_pair(long, ["spec", "weighting"], lambda y, x: _one(es.hac_line(y, x)), {"b": "double", "se": "double", "t": "double", "p": "double", "n": "bigint", "r2": "double"})
    return rounded(out.withColumn("verdict", s.verdict(F.col("p"))))


_SQL_WIN = f'WITH j AS (SELECT m, vw, g, row_number() OVER (ORDER BY m) AS i FROM ({mk.SQL_JOINED})) SELECT e.i AS "end", j.m, j.vw AS y, j.g AS x FROM j JOIN j e ON j.i BETWEEN e.i - 35 AND e.i WHERE e.i >= 36'


@query(f"""SELECT strftime(m, '%Y-%m') AS month, round(b, 6) AS b, round(b - 2 * se, 6) AS lower, round(b + 2 * se, 6) AS upper FROM ({sq.coefficient(_SQL_WIN, '"end"', ["x"], 4)}) JOIN (SELECT m, row_number() OVER (ORDER BY m) AS "end" FROM ({mk.SQL_JOINED})) USING ("end")""")
def rolling_hac(spark: SparkSession, d: str) -> DataFrame:
    """Slope and band of two errors over the 36 months up to each month."""
    j = mk.joined(spark, d).select("m", F.row_number().over(W.orderBy("m")).alias("i"), "vw", "g")
    win = j.withColumn("end", F.explode(F.sequence(F.col("i"), F.col("i") + 35)))
    full = win.join(win.groupBy("end").agg(F.count("*").alias("c")).filter("c = 36").select("end"), "end")
    out = per_pair(full.select("end", "m", F.col("vw").alias("y"), F.col("g").alias("x")), ["end"], lambda y, x: _one(es.hac_line(y, x)), {"b": "double", "se": "double", "t": "double", "p": "double", "n": "int", "r2": "double"})
    return rounded(out.join(j.select(F.col("i").alias("end"), "m"), "end").select(mk.mstr(), "b", (F.col("b") - 2 * F.col("se")).alias("lower"), (F.col("b") + 2 * F.col("se")).alias("upper")))
