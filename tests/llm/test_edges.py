"""Null and very large ids, repeated rows, empty and very long texts, clashing columns and empty tables, for every operator."""

import random

import pytest

from quillspark.llm import decontaminate, exact, jaccard, language, lines, mixing, quality, substrings, suffixes
from tests.llm import brute

BIG = 1 << 60
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    a, passage = text(150), text(30)
    near = a.split(" ")
    near[70] = "changed"
    long = text(560_000)
    assert len(long) > 3 << 20
    return [
        (BIG + 1, a),
        (BIG + 3, " ".join(near)),
        (BIG + 5, f"{text(40)} {passage} {text(40)}"),
        (2, f"{text(20)}\n{passage}\n{text(9)}"),
        (BIG + 7, a.upper()),
        (11, ""),
        (12, " \n\n"),
        (13, long),
        (14, f"{passage} {long[:3000]}"),
        (15, f"x\n{passage} more\nx"),
        (16, "\x00" * 300),
        (17, "\x00" * 202),
        (18, None),
    ]


def table(spark, rows):
    """With null ids, a repeated row, and columns that are called like results."""
    null = [(None, rows[0][1]), (None, rows[2][1])]
    df = spark.createDataFrame([*rows, *null, rows[1]], SCHEMA).repartition(3)
    return df.selectExpr("*", "'s' AS score", "1 AS n_words", "2 AS n_removed", "'x' AS component_id", "3 AS token", "4 AS bucket", "5 AS key", "6 AS _key", "'en' AS lang", "7 AS lang_pred", "'src' AS source")


def split(found):
    """Results of named documents, all alike for repeated rows, and those of null ids."""
    out = {}
    for r in found:
        if r[0] is not None:
            assert out.setdefault(r[0], tuple(r)[1:]) == tuple(r)[1:]
    return out, [tuple(r)[1:] for r in found if r[0] is None]


def test_suffix_array_dedup(spark, rows):
    found, null = split(suffixes.remove_repeats(table(spark, rows), with_text=False).drop("kept").collect())
    assert found == brute.without_strings(rows)
    assert found[BIG + 3][1] > 0
    assert found[16][1] == 299  # all but the first byte
    assert [n[1] for n in null] == [0, 0]


def test_substring_dedup(spark, rows):
    found, null = split(substrings.remove_repeats(table(spark, rows), with_text=False).drop("text").collect())
    assert found == brute.without_windows(rows)
    assert found[BIG + 3][1] > 0
    assert [n[1] for n in null] == [0, 0]


def test_jaccard_join(spark, rows):
    found, null = split(jaccard.link(table(spark, rows)).collect())
    assert found == brute.components(rows, 5, 80)
    assert found[BIG + 3][1] == BIG + 1
    assert [n[1] for n in null] == [None, None]


def test_line_dedup(spark, rows):
    found, null = split(lines.line_report(table(spark, rows)).collect())
    assert found == brute.removed_lines(rows)
    assert found[15][2] == "1,2"
    assert [n[1] for n in null] == [0, 0]
    kept = lines.drop_lines(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert kept.count() == len(rows) + 3


def test_line_dedup_of_many_near_copies(spark):
    """Hundreds of variants of one line, long lines, and lines that only candidates beyond the first are similar to."""
    rng = random.Random(1)
    words = [f"v{i}" for i in range(60)]
    variants = []
    for i in range(250):
        w = list(words)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(60)] = f"u{rng.randrange(400)}"
        variants.append((1000 - i, " ".join(w) + ("\nsame line here" if i % 3 == 0 else "")))
    variants += [(2000 + i, " ".join(f"z{(i * 7 + j) % 900}" for j in range(300 + i % 90))) for i in range(60)]
    found = {r.doc_id: tuple(r)[1:] for r in lines.line_report(spark.createDataFrame(variants, SCHEMA).repartition(4)).collect()}
    assert found == brute.removed_lines(variants)


def test_line_dedup_is_native(spark, monkeypatch):
    """No Python on executors; rows that repeat a doc_id with other texts; all blanks between words; sets of up to 20 words."""
    rng = random.Random(3)
    blank = [" ", "\t", "\v", "\f", "\r", "  "]
    docs = []
    for i in range(120):
        w = [f"a{j}" for j in range(rng.randrange(1, 21))]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"b{rng.randrange(6)}"
        docs.append((i, rng.choice(blank).join(w) + "\n \t\n" + rng.choice(["the", "", f"x{i} y z\u00a0z"])))
    df = spark.createDataFrame(docs, SCHEMA)
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, lambda *a, **b: pytest.fail("Python on executors"))
    found = {r.doc_id: tuple(r)[1:] for r in lines.line_report(df).collect()}
    assert found == brute.removed_lines(docs)
    near = [(1, "q r s t u v"), (5, "q r s t u v"), (5, "k l m n o p"), (9, "k l m n o p z")]
    gone = {(r.doc_id, r.line_no, r.match_doc) for r in lines.line_matches(spark.createDataFrame(near, SCHEMA)).collect()}
    assert gone == {(5, 0, 1), (9, 0, 5)}


def test_decontamination(spark, rows):
    items = [(1, rows[0][1]), (BIG, "w1 w2"), (None, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = table(spark, rows)
    found = decontaminate.winnow(df, bench, keep=df.columns)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "kept_doc_id", "text", "score", "kept_n_words", "n_removed", "component_id", "token", "bucket", "key", "_key", "lang", "lang_pred", "source"]
    got, null = split(found.select(*found.columns[:6]).collect())
    expected = brute.decontaminated(rows, items)
    assert got == expected
    assert sorted(null) == sorted([expected[BIG + 1], expected[BIG + 5]])


def test_exact_dedup(spark, rows):
    df = table(spark, rows)
    found = exact.exact_groups(df)
    kept = {}
    for r in found.collect():
        kept.setdefault(r.text_sha256, []).append(r)
    for group in kept.values():
        last = max((r.doc_id for r in group if r.doc_id is not None), default=None)
        assert all((r.keep_id, r.group_size, r.kept) == (last, len(group), r.doc_id == last) for r in group)
    assert exact.drop_copies(df).count() == len(kept)


def test_models(spark, rows):
    df = table(spark, rows)
    model = language.fit(df)
    found = language.identify(df, model, keep=["lang_pred", "score"])
    assert found.columns == ["doc_id", "lang_pred", "score", "kept_lang_pred", "kept_score"]
    assert {r.lang_pred for r in found.collect()} == {"en", "und"}
    rated = quality.rate(df, quality.fit(df, spark.createDataFrame([(2, 1), (15, 0), (None, 1)], "doc_id bigint, quality int")), keep=["score"])
    assert rated.count() == df.count()
    assert all(0 <= r.score <= 1 for r in rated.collect())


def test_mixing(spark, rows):
    found = mixing.mix(table(spark, rows)).collect()
    size = {d: len(brute.BLANK.findall(brute.raw(t))) for d, t in rows}
    size[BIG + 3] *= 2  # the repeated row counts twice
    assert {r.doc_id: r.size for r in found if r.doc_id is not None} == size
    assert all(0 <= r.taken <= 2 * r.size for r in found)


def test_pipeline(spark, rows, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    df = table(spark, [r for r in rows if r[0] != 13])
    bench = spark.createDataFrame([(1, rows[3][1].split("\n")[1])], "item_id bigint, text string")
    for name, part in (("full", df), ("empty", df.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "full"))
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "full")).collect()} == {BIG + 3}
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
