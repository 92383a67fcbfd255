import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import codes as cd
from quillspark.functions import dates as dt
from quillspark.functions import lexicon as lx
from quillspark.functions import names as nm
from quillspark.functions import tail_columns as tc
from quillspark.functions.proximity import term_regex, terms_regex
from quillspark.functions.tails import f_upper, normal_two_sided, t_two_sided
from quillspark.operators import series as s
from quillspark.plans import study


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("name", "core"),
    [
        ("HEWLETT PACKARD ENTERPRISE CO", "HEWLETT PACKARD ENTPR"),
        ("The X HOLDINGS INC", "X"),
        ("ZEBRA TECHNOLOGIES CORP", "ZEBRA TECH"),
        ("Foo (NEW) Ltd.", "FOO"),
        ("Inc", ""),
        ("", ""),
        ("Salesforce, Inc.", "SALESFORCE"),
        ("Newco", "NEWCO"),
    ],
)
def test_core(spark, name, core):
    assert one(spark, name, nm.core) == core


def test_clean_once_strips_one_suffix(spark):
    assert one(spark, "X Holdings Inc.", nm.clean_once) == "X HOLDINGS"
    assert one(spark, "Salesforce (United States)", nm.without_country) == "Salesforce"


@pytest.mark.parametrize(("name", "person"), [("RIGETTI CHAD T", True), ("NOVOZYMES AS", False), ("UNIV CHUNG CHAD", False), ("CHAD", False), ("A CHAD CHAD CHAD CHAD", False)])
def test_person(spark, name, person):
    assert one(spark, name, lambda c: nm.is_person(c, F.array(F.lit("CHAD")))) is person


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("a deep_learning net", True),
        ("Deep-Learning", True),
        ("neural based networks", True),
        ("neural a b network", False),
        ("connectionism", True),
        ("chatbots", True),
        ("a support vector machine", True),
        ("réseau neural", False),
        ("computational intelligence", True),
        ("computer intelligence", False),
        ("computation of intelligence", True),
    ],
)
def test_terms(spark, text, hit):
    assert one(spark, text, lambda c: c.rlike(terms_regex(lx.K1))) is hit


def test_either_order(spark):
    p = terms_regex(lx.K2)
    assert one(spark, "algorithm that is stochastic", lambda c: c.rlike(p)) is True
    assert one(spark, "stochastic gradient method", lambda c: c.rlike(p)) is True
    assert one(spark, "an embeddings table", lambda c: c.rlike(p)) is True
    assert (len(lx.K1), len(lx.K2)) == (45, 18)
    with pytest.raises(ValueError, match="two slots"):
        term_regex("a 1D b 1D c")


RULES = cd.CodeRules.parse("G06N3/02, G06N20+ G06F17/27:G06F17/2795 G06K9/1:G06K11/2")


@pytest.mark.parametrize(("code", "hit"), [("G06N3/02", True), ("G06N3/021", False), ("G06N20/10", True), ("G06F17/2775", True), ("G06F17/30", False), ("G06F17/279", True), ("G06K9/77", True), ("G06K10/1", False), ("H04L", False)])
def test_rules(spark, code, hit):
    assert one(spark, code, RULES.matches) is hit


@given(st.text("0123456789", min_size=1, max_size=5), st.text("0123456789", min_size=1, max_size=5), st.text("0123456789", min_size=1, max_size=5))
def test_range_is_decimal_order(lo, hi, x):
    """Padding with zeros compares as digits behind a point."""
    n = max(map(len, (lo, hi, x)))
    padded = lo.ljust(n, "0") <= x.ljust(n, "0") <= hi.ljust(n, "0")
    assert padded == (float(f"0.{lo}") <= float(f"0.{x}") <= float(f"0.{hi}"))


def test_labels(spark):
    label = lambda *c: spark.createDataFrame([(list(c),)], "x array<string>").select(cd.field_label(F.col("x")).alias("y")).first().y
    assert label("H04L1/1", "G06N20/00") == "machine_learning"
    assert label("G06V1/1", "G06N3/04") == "neural_network"
    assert label("H04L1/1") == label() == "other"
    ok = spark.range(1).select(cd.successor_allowed(F.lit("G06F17/2705"), F.lit("G06F40/1")).alias("a"), cd.successor_allowed(F.lit("A01B"), F.lit("A01B")).alias("b")).first()
    assert (ok.a, ok.b) == (True, False)


def test_dates(spark):
    assert str(one(spark, "2024-02-29", lambda c: F.add_months(c.cast("date"), -12))) == "2023-02-28"
    assert str(one(spark, "2007-09-29", lambda c: dt.period_start(c.cast("date"), 12))) == "2006-09-30"
    assert str(one(spark, "2024/3/5", lambda c: dt.any_format(c, "yyyy-MM-dd", "yyyy/M/d"))) == "2024-03-05"
    assert one(spark, "nonsense", lambda c: dt.any_format(c, "yyyy-MM-dd")) is None


def test_tails():
    assert abs(t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(f_upper(3.0, 2, 20) - 0.07253815) < 1e-7
    assert abs(normal_two_sided(1.959963985) - 0.05) < 1e-8
    assert abs(t_two_sided(0.0, 5) - 1) < 1e-12


def test_no_term_needs_escapes():
    assert all(re.compile(term_regex(t)) for t in (*lx.K1, *lx.K2))


def test_tails_as_columns(spark):
    rows = [(0.3, 3.0, 40.0), (4.36, 2.0, 103.0), (9.91, 11.0, 95.0), (1e-9, 1.0, 5.0), (200.0, 1.0, 30.0)]
    df = spark.createDataFrame(rows, "f double, a double, b double").select("*", tc.f_upper(F.col("f"), F.col("a"), F.col("b")).alias("p"), tc.t_two_sided(F.sqrt("f"), F.col("b")).alias("t"))
    for r in df.collect():
        assert r.p == pytest.approx(f_upper(r.f, r.a, r.b), abs=1e-8)
        assert r.t == pytest.approx(t_two_sided(r.f**0.5, r.b), abs=1e-8)


def test_adjusted_p_values(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    assert [round(r.p_adjusted, 6) for r in s.benjamini_hochberg(df, "p", [], ["i"]).orderBy("i").collect()] == [0.05, 0.05, 0.05, 0.05, 0.5]


def test_publication_parts(spark):
    df = spark.createDataFrame([("20200131", "t", None), ("202001", None, "a"), ("20209999", "t", "a"), (None, None, None)], "d string, t string, a string")
    found = [(str(r.d), r.x) for r in df.select(study.whole_date(F.col("d")).alias("d"), study.joined_text(F.col("t"), F.col("a")).alias("x")).collect()]
    assert found == [("2020-01-31", "t "), ("None", " a"), ("None", "t a"), ("None", " ")]
