"""SQL for least squares with several regressors: columns are made orthogonal one after another by windows.

The coefficient of a regressor is that of its residual on the others, and a row's influence on it is residual times error; so standard
errors of one coefficient need no matrix. A sum of coefficients is the coefficient of one regressor after the others had it subtracted.
"""

from __future__ import annotations

from quillspark.functions.tail_columns import STEPS


def orthogonal(rows: str, keys: str, regressors: list[str], y: str = "y") -> str:
    """keys, m, r (the last regressor, without the others and the mean), v (y without the others and the mean), w (y without the mean)."""
    w = f"OVER (PARTITION BY {keys})"
    names = [f"c{i}" for i in range(len(regressors))]
    sql = f"SELECT {keys}, m, {', '.join(f'({x}) - avg({x}) {w} AS {n}' for x, n in zip(regressors, names, strict=True))}, {y} - avg({y}) {w} AS v, {y} - avg({y}) {w} AS w FROM ({rows})"
    for i, p in enumerate(names[:-1]):
        left = [*names[i + 1 :], "v"]
        sql = f"SELECT {keys}, m, {', '.join(f'{c} - {p} * (sum({c} * {p}) {w} / sum({p} * {p}) {w}) AS {c}' for c in left)}, w FROM ({sql})"
    return f"SELECT {keys}, m, {names[-1]} AS r, v, w FROM ({sql})"


def coefficient(rows: str, keys: str, regressors: list[str], lags: int, *, adjust: bool = False) -> str:
    """keys, n, b, se and r2 of the last regressor, with Newey-West errors (Bartlett weights), ordered by m."""
    w = f"OVER (PARTITION BY {keys})"
    k = len(regressors) + 1
    weights = " + ".join(["sum(z * z)", *(f"2 * {1 - i / (lags + 1)} * sum(z * z{i})" for i in range(1, lags + 1))])
    lagged = ", ".join(f"coalesce(lag(z, {i}) OVER (PARTITION BY {keys} ORDER BY m), 0) AS z{i}" for i in range(1, lags + 1))
    fitted = f"SELECT {keys}, m, b, w, v - b * r AS u, r * (v - b * r) / sum(r * r) {w} AS z FROM (SELECT *, sum(r * v) {w} / sum(r * r) {w} AS b FROM ({orthogonal(rows, keys, regressors)}))"
    scale = f" * count(*) / (count(*) - {k})" if adjust else ""
    return f"SELECT {keys}, count(*) AS n, any_value(b) AS b, sqrt(greatest(0.0, ({weights}){scale})) AS se, 1 - sum(u * u) / sum(w * w) AS r2 FROM (SELECT *, {lagged} FROM ({fitted})) GROUP BY {keys}"


def plain_t(rows: str, keys: str, regressors: list[str]) -> str:
    """keys, n and t of the last regressor, with the ordinary error."""
    k = len(regressors) + 1
    fitted = f"SELECT *, sum(r * v) OVER (PARTITION BY {keys}) / sum(r * r) OVER (PARTITION BY {keys}) AS b FROM ({orthogonal(rows, keys, regressors)})"
    return f"SELECT {keys}, count(*) AS n, any_value(b) / sqrt(sum((v - b * r) * (v - b * r)) / (count(*) - {k}) / sum(r * r)) AS t FROM ({fitted}) GROUP BY {keys}"


def rss(rows: str, keys: str, regressors: list[str]) -> str:
    """keys, n and the sum of squared errors."""
    fitted = f"SELECT *, sum(r * v) OVER (PARTITION BY {keys}) / sum(r * r) OVER (PARTITION BY {keys}) AS b FROM ({orthogonal(rows, keys, regressors)})"
    return f"SELECT {keys}, count(*) AS n, sum((v - b * r) * (v - b * r)) AS rss FROM ({fitted}) GROUP BY {keys}"


def normal_two_sided(z: str) -> str:
    x = f"abs({z}) * i / {STEPS}.0"
    area = f"list_sum(list_transform(range(0, {STEPS + 1}), lambda i: (CASE WHEN i IN (0, {STEPS}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * exp(-0.5 * ({x}) * ({x}))))"
    return f"greatest(0.0, 1 - 2 * abs({z}) / {3 * STEPS}.0 / sqrt(2 * pi()) * {area})"


def interpolated(x: str, xs: list[str], ys: list[str]) -> str:
    """Linear interpolation of x in ascending xs; constant outside."""
    inner = " ".join(f"WHEN {x} < {b} THEN {p} + ({q} - {p}) * ({x} - {a}) / ({b} - {a})" for a, b, p, q in zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True))
    return f"CASE WHEN {x} <= {xs[0]} THEN {ys[0]} {inner} ELSE {ys[-1]} END"
