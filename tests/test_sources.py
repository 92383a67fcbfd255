import datetime as dt
import json
import logging

import pytest
from pyspark.sql import functions as F

from quillspark.operators import intervals as iv
from quillspark.functions import codes as cd
from quillspark.sources import remote
from quillspark.sources import tables as io
from quillspark.streaming.monthly import append_to, monthly_counts, session_counts, sliding_counts, stream_table


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'symbol,title\n A1 ,"two\nlines, ""quoted"""\n,none\nB2,caf\xe9\n')
    rows = io.read_csv(spark, str(tmp_path / "a.csv"), "symbol string, title string", ["title"], multi_line=True).collect()
    assert rows[0].title == 'two\nlines, "quoted"'
    assert rows[2].title == "caf�"
    (tmp_path / "b.csv").write_text("symbol,title\n A1 , one \n,none\n")
    assert [tuple(r) for r in io.read_symbols(spark, str(tmp_path / "b.csv")).collect()] == [("A1", "one")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "update_date": "2016-01-01", "x": {"y": 1}}\n{"id": "2", "update_date": "2017-01-01"}\n')
    assert [r.id for r in io.read_json_lines(spark, str(tmp_path / "a.json"), "id string, update_date string", "update_date >= '2017-01-01'").collect()] == ["2"]
    assert io.read_config('{"a": [1]}') == {"a": [1]}


def test_publish_fails_closed(spark, tmp_path):
    out = str(tmp_path / "t")
    assert io.publish(spark.range(3), out, expect_rows=3) == 3
    with pytest.raises(ValueError, match="3 rows, not 4"):
        io.publish(spark.range(3), out, expect_rows=4)
    assert io.publish(spark.range(5).withColumn("g", F.col("id") % 2), out, partition_by=["g"]) == 5
    assert spark.read.parquet(out).filter("g = 1").count() == 2
    with pytest.raises(ValueError, match="unknown"):
        io.require_subset(spark.range(3), spark.range(2), ["id"], "unknown")
    io.require_subset(spark.range(2), spark.range(3), ["id"], "unknown")
    assert io.require_schema(spark.range(1), "id bigint").count() == 1
    with pytest.raises(ValueError, match="columns are"):
        io.require_schema(spark.range(1), "id int")


def test_fallback_and_memo(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(2)

    for _ in range(2):
        assert io.memoised(spark, str(tmp_path / "m"), make).count() == 2
    assert made == [1]
    assert io.first_available(lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.range(1)).count() == 1
    with pytest.raises(ValueError, match="no source"):
        io.first_available()
    io.export_csv(spark.range(2), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 1
    assert "Range" in io.cost(spark.range(2))
    assert io.union_pages([spark.range(1).select("id"), spark.range(1).withColumn("x", F.lit(1))]).columns == ["id", "x"]


def test_intervals(spark):
    d = dt.date
    points = spark.createDataFrame([(d(2020, 1, 31),), (d(2020, 3, 1),), (d(2021, 1, 1),)], "q date")
    spans = spark.createDataFrame([(1, 1, d(2019, 1, 1), d(2020, 1, 31), 5.0), (1, 2, d(2020, 1, 15), d(2020, 6, 1), 7.0), (2, 3, d(2020, 3, 1), d(2020, 3, 1), 9.0)], "firm int, id int, a date, b date, x double")
    hit = iv.active_at(points, spans, "q", "a", "b")
    assert sorted((str(r.q), r.id) for r in hit.collect()) == [("2020-01-31", 1), ("2020-01-31", 2), ("2020-03-01", 2), ("2020-03-01", 3)]
    last = iv.latest_active(hit, ["q", "firm"], "a", ["id"], ["x"])
    assert sorted((str(r.q), r.firm, r.x) for r in last.collect()) == [("2020-01-31", 1, 7.0), ("2020-03-01", 1, 7.0), ("2020-03-01", 2, 9.0)]
    v = spark.createDataFrame([(d(2016, 1, 31), None, d(2016, 1, 31)), (d(2016, 2, 1), None, d(2016, 1, 31)), (d(2016, 2, 1), d(2016, 2, 1), None)], "f date, a date, b date")
    assert [r.v for r in v.select(iv.valid_at(F.col("f"), F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, True]
    assert sorted(str(r.e) for r in iv.edges(spans.filter("firm = 2"), "a", "b", "e").collect()) == ["2020-03-01", "2020-03-01"]


def _stream(spark, tmp_path, rows, make):
    schema = "ts timestamp, k string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    append_to(make(stream_table(spark, str(tmp_path / "in"), schema, "value > 0")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_monthly_stream(spark, tmp_path):
    """A row per month and key; the last month is still open, and with a month of grace the one before, too."""
    rows = [(dt.datetime(2024, 1, day, 12), "a", 1.0) for day in (1, 2, 31)] + [(dt.datetime(2024, 1, 5), "b", 1.0), (dt.datetime(2024, 2, 20), "a", 2.0), (dt.datetime(2024, 2, 21), "a", -1.0), (dt.datetime(2024, 3, 1), "a", 4.0)]
    found = _stream(spark, tmp_path, rows, lambda e: monthly_counts(e, "ts", "k"))
    assert sorted((str(r.month), r.k, r.n, r.value) for r in found) == [("2024-01-01", "a", 3, 3.0), ("2024-01-01", "b", 1, 1.0), ("2024-02-01", "a", 1, 2.0)]
    (tmp_path / "late").mkdir()
    found = _stream(spark, tmp_path / "late", rows, lambda e: monthly_counts(e, "ts", "k", 1))
    assert sorted((str(r.month), r.k, r.n) for r in found) == [("2024-01-01", "a", 3), ("2024-01-01", "b", 1)]


def test_sliding_and_sessions(spark, tmp_path):
    at = lambda *x: dt.datetime(2024, 1, *x)
    rows = [(at(1, 10, 0), "a", 1.0), (at(1, 10, 20), "a", 1.0), (at(1, 12, 0), "a", 1.0), (at(9, 0, 0), "a", 1.0)]
    found = _stream(spark, tmp_path, rows, lambda e: session_counts(e, "ts", "k"))
    assert sorted((r.start, r.end, r.n) for r in found) == [(at(1, 10, 0), at(1, 10, 50), 2), (at(1, 12, 0), at(1, 12, 30), 1)]
    (tmp_path / "s").mkdir()
    found = _stream(spark, tmp_path / "s", rows, lambda e: sliding_counts(e, "ts", "k", "2 days", "1 day"))
    assert sorted((r.start.day, r.n) for r in found) == [(1, 3), (31, 3)]


def test_facts_with_fallback(spark, tmp_path):
    def put(cik, tag, values):
        (tmp_path / f"CIK{cik:010}").mkdir(exist_ok=True)
        facts = [{"start": "2020-01-01", "end": "2020-12-31", "filed": f"2021-02-0{i + 1}", "fy": 2020, "fp": "FY", "form": "10-K", "val": v} for i, v in enumerate(values)]
        (tmp_path / f"CIK{cik:010}" / f"{tag}.json").write_text(json.dumps({"units": {"USD": facts}}))

    put(1, "A", [5, 6])
    put(1, "B", [7])
    put(2, "A", [])
    put(2, "B", [8])
    spark.dataSource.register(remote.FactsSource)
    df = spark.read.format("reported_facts").option("base", f"file://{tmp_path}").option("firms", "X=1, Y=2,Z=3").option("tags", "A,B").option("pause", "0").load()
    assert sorted((r.ticker, r.tag, r.value) for r in df.collect()) == [("X", "A", 5.0), ("X", "A", 6.0), ("Y", "B", 8.0)]
    both = spark.createDataFrame([("X", "B", 1), ("X", "A", 2), ("Y", "B", 3), ("Y", "C", 4)], "f string, t string, v int")
    assert sorted(r.v for r in remote.first_reported(both, "f", "t", ["A", "B"]).collect()) == [2, 3]


def test_pages_resume(spark, tmp_path):
    asked, fail = [], {2}

    def fetch(page):
        asked.append(page)
        return spark.range(10 * page, 10 * page + (3 if page in fail else 5))

    path = str(tmp_path / "pages")
    with pytest.raises(ValueError, match="3 rows, not 5"):
        remote.download_pages(spark, fetch, [5, 5, 5], path, retries=2, pause=0)
    assert asked == [0, 1, 2, 2]
    fail.clear()
    assert remote.download_pages(spark, fetch, [5, 5, 5], path, pause=0) == 15
    assert asked == [0, 1, 2, 2, 2]


def test_latest_job(spark):
    job = lambda name, at, ok, df: remote.Job(name, at, ok, lambda: df)
    jobs = [job("old", "2024-01-01", True, spark.range(1)), job("new", "2024-03-01", True, spark.range(1).toDF("x")), job("broken", "2024-04-01", False, spark.range(1)), job("fits", "2024-02-01", True, spark.range(2))]
    assert remote.latest_job(jobs, "id bigint").name == "fits"
    with pytest.raises(ValueError, match="no finished job"):
        remote.latest_job(jobs, "y int")


def test_config_rules_and_log(tmp_path, capsys):
    rules = cd.build_rules({"block": "A/1 B+ C/1:C/9"}, {"k1": ["deep 1W learning+"]})
    io.write_config(str(tmp_path / "rules.json"), rules)
    back = io.read_config((tmp_path / "rules.json").read_text())
    assert back == rules
    assert cd.rules_of(back, "block") == cd.CodeRules.parse("A/1 B+ C/1:C/9")
    with pytest.raises(KeyError), io.diagnostics(str(tmp_path / "log.txt")) as say:
        say.info("one %d", 1)
        raise KeyError
    assert (tmp_path / "log.txt").read_text() == "one 1\n"
    assert "one 1" in capsys.readouterr().err
    assert not logging.getLogger("quillspark").handlers


def test_failed_publish_keeps_the_old_table(spark, tmp_path):
    out = str(tmp_path / "t")
    io.publish(spark.range(3), out)
    with pytest.raises(ValueError, match="2 rows"):
        io.publish(spark.range(2), out, expect_rows=9)
    assert spark.read.parquet(out).count() == 3
    io.publish(spark.range(4), out, expect_rows=4)
    assert spark.read.parquet(out).count() == 4
    assert not (tmp_path / "t.old").exists()
