"""Tail probabilities as Column expressions and as the same integrals in SQL.

The regularised incomplete beta function is an integral of sin and cos powers after t = sin(x)**2, which Simpson's rule takes with
STEPS steps to far more digits than results are rounded to.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000


def _area(upto: Column, a: Column, b: Column) -> Column:
    """Integral of sin(x)**a * cos(x)**b from 0 to upto, but for a factor of a third of the step."""

    def value(acc: Column, i: Column) -> Column:
        x = upto * i / STEPS
        weight = F.when((i == 0) | (i == STEPS), 1.0).otherwise(F.when(i % 2 == 1, 4.0).otherwise(2.0))
        return acc + weight * F.pow(F.sin(x), a) * F.pow(F.greatest(F.cos(x), F.lit(0.0)), b)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), value)


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """Probability of an F statistic of d1 and d2 degrees above f."""
    d1, d2 = d1.cast("double"), d2.cast("double")
    whole = F.lit(1.5707963267948966)
    angle = F.asin(F.sqrt(d2 / (d2 + d1 * f)))
    return angle / whole * _area(angle, d2 - 1, d1 - 1) / _area(whole, d2 - 1, d1 - 1)


def t_two_sided(t: Column, df: Column) -> Column:
    return f_upper(t * t, F.lit(1.0), df)


def sql_f_upper(f: str, d1: str, d2: str) -> str:
    def area(upto: str) -> str:
        x = f"({upto}) * i / {STEPS}.0"
        return f"list_sum(list_transform(range(0, {STEPS + 1}), lambda i: (CASE WHEN i IN (0, {STEPS}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * pow(sin({x}), ({d2}) - 1.0) * pow(greatest(cos({x}), 0.0), ({d1}) - 1.0)))"

    angle = f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))"
    return f"({angle} / (pi() / 2) * {area(angle)} / {area('pi() / 2')})"


def sql_t_two_sided(t: str, df: str) -> str:
    return sql_f_upper(f"({t}) * ({t})", "1.0", df)
