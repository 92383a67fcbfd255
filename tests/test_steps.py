"""Step totals: odd rows against the SQL, sums over intervals against brute force, and no pairs of events and firms."""

import random
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import intervals as iv
from quillspark.plans import all_oracles, all_queries
from tests.oracle import same

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def odd_orders():
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, *range(12)]), "F", rnd.choice([None, None, 0.5, 100.25, 2000.75]), datetime(1996, 1, 1) + timedelta(days=rnd.randrange(1500)), "1") for i in range(150)]
    days = [datetime(2000, 2, 29), datetime(2001, 2, 28), datetime(2003, 12, 31), datetime(2004, 1, 1), datetime(2004, 12, 31)]
    rows += [(200 + i, 50, "F", p, t, "1") for i, (t, p) in enumerate(zip(days, [10.0, None, 5.0, None, 7.0], strict=True))]
    return [*rows, (300, 60, "F", 0.004, datetime(1980, 5, 1), "1"), (301, 61, "F", None, datetime(1985, 5, 1), "1"), (302, 62, "F", -3.0, datetime(1960, 3, 1), "1"), (303, 62, "F", 4.0, None, "1")]


@pytest.fixture
def orders(spark, tmp_path):
    spark.createDataFrame(odd_orders(), ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_step_aggregate_of_odd_rows(spark, orders):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet/*.parquet'")
    same(spark, con, orders, all_queries()["step_aggregate"], all_oracles()["step_aggregate"])


def test_step_aggregate_has_no_row_per_event_and_firm(spark, orders):
    df = all_queries()["step_aggregate"](spark, orders)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [x#" in line and ", firm#" in line.split("]")[0]]


def test_daily_sums(spark):
    rnd = random.Random(3)
    first = date(1969, 11, 1)
    spans = [(first + timedelta(days=a), first + timedelta(days=a + n - 1), v) for a, n, v in ((rnd.randrange(400), rnd.choice([0, 1, 2, 3, 64, 365, 366, 1000]), rnd.randrange(1, 99)) for _ in range(300))]
    frame = spark.createDataFrame(spans, "a date, b date, v int").withColumn("n", F.lit(1))
    found = iv.daily_sums(frame, "a", "b", ["n", "v"], "x")
    days = [first + timedelta(days=x) for x in range(-3, 1500)]
    want = {x: (len(hit), sum(hit)) for x in days if (hit := [v for a, b, v in spans if a <= x <= b])}
    assert {r.x: (r.n, r.v) for r in found.collect()} == want
