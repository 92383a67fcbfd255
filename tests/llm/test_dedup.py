import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, exact, jaccard, lines, substrings, suffixes
from tests.llm import brute

EMPTY = "doc_id bigint, text string"


@pytest.fixture(scope="module", params=[0, 1])
def docs(request):
    return brute.corpus(request.param)


def test_decontamination(spark, docs, monkeypatch):
    items = [(i, t) for i, (_, t) in enumerate(docs[:12])] + [(50, "One"), (51, None), (52, ""), (53, "the of"), (7, "w1 w2 w3")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = brute.decontaminated(docs, items)
    for size in (1 << 20, 300):  # one block, many blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found = decontaminate.winnow(brute.frame(spark, docs).drop("n_words"), bench, keep=["text", "key"])
        assert {r.doc_id: tuple(r)[1:6] for r in found.collect()} == expected
    none = decontaminate.winnow(brute.frame(spark, docs).drop("n_words"), bench.limit(0))
    assert not any(r.contaminated or r.n_items for r in none.collect())
    assert decontaminate.winnow(spark.createDataFrame([], EMPTY), bench).count() == 0


def test_suffix_array_dedup(spark, docs):
    found = suffixes.remove_repeats(brute.frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.without_strings(docs)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in found)
    assert suffixes.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0


def test_suffix_array_of_short_strings(spark, docs):
    found = suffixes.remove_repeats(brute.frame(spark, docs), length=20, gram=6, sketch_bits=20).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == brute.without_strings(docs, 20)


def test_substring_dedup(spark, docs):
    found = substrings.remove_repeats(brute.frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute.without_windows(docs)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in found)
    assert substrings.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0


def test_full_sketch_loses_nothing(spark, docs):
    """With far too few counters everything is grouped, to the same result."""
    found = substrings.remove_repeats(brute.frame(spark, docs), window=5, gram=2, sketch_bits=20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute.without_windows(docs, 5)


def test_jaccard_join(spark, docs):
    found = jaccard.link(brute.frame(spark, docs), shingle=4, numerator=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.components(docs)
    found = jaccard.link(brute.frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.components(docs, 5, 80)
    assert jaccard.link(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_jaccard_join_of_large_groups(spark, monkeypatch, block):
    """Chains of near copies whose ends don't link, in groups that are split into blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(30):
        w = list(words)
        for j in range(i):
            w[(7 * j) % 120] = f"u{j}"
        rows.append((100 - i, " ".join(w)))
    rows += [(200 + i, " ".join(words[: 60 + i])) for i in range(0, 40, 3)]
    rows += [(300, rows[3][1].upper()), (301, None), (302, "")]
    found = jaccard.link(spark.createDataFrame(rows, EMPTY).repartition(4), shingle=4, numerator=70).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.components(rows, num=70)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50, 0, -1)] + [(100, 200), (200, 200), (7, 7)]
    found = jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in found.collect()} == {**{i: 1 for i in range(1, 52)}, 100: 100, 200: 100}


@pytest.mark.parametrize(("bits", "capacity"), [(64, 8192), (3, 2)])
def test_exact_dedup(spark, docs, bits, capacity):
    rows = [*docs, (9999, "LOWER CASE"), (docs[0][0], docs[0][1]), (None, docs[1][1]), (None, "no id"), (None, "NO ID"), ((1 << 62) + 1, "big"), ((1 << 62) + 3, "BIG")]
    groups = {}
    for d, t in rows:
        groups.setdefault(brute.raw(t).translate(brute.UPPER), []).append(d)
    last = {b: max((d for d in g if d is not None), default=None) for b, g in groups.items()}
    options = {"hash_bits": bits, "capacity": capacity, "max_depth": 6}
    found = exact.exact_groups(brute.frame(spark, rows), **options)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_words", "key", "bucket"]
    expected = []
    for d, t in rows:
        b = brute.raw(t).translate(brute.UPPER)
        expected.append((d, last[b], len(groups[b]), d == last[b], brute.sha(b)))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=repr) == sorted(expected, key=repr)
    stays = exact.drop_copies(brute.frame(spark, rows), **options)
    assert stays.columns == brute.frame(spark, rows).columns
    assert sorted((r.doc_id for r in stays.collect()), key=repr) == sorted(last.values(), key=repr)
    assert exact.exact_groups(spark.createDataFrame([], EMPTY)).count() == 0
    assert exact.drop_copies(spark.createDataFrame([], EMPTY)).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    found = exact.Directory(keys, 1000, 50)
    sizes = keys.withColumn("bucket", found.bucket("key")).groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.expr(f"shiftrightunsigned(key, {64 - found.depth})")).alias("a"), F.max(F.expr(f"shiftrightunsigned(key, {64 - found.depth})")).alias("b")).orderBy("a").collect()
    assert max(r.n for r in sizes) <= 50
    assert sum(r.n for r in sizes) == 1000
    assert len(sizes) > 20
    assert all(x.b < y.a for x, y in zip(sizes, sizes[1:], strict=False))  # a bucket is a range of keys
    assert all(r.bucket <= r.a for r in sizes)


def test_directory_doubles_while_a_bucket_is_overfull(spark):
    """Keys of one narrow range, which the first doublings don't split."""
    keys = spark.range(64).select(F.expr("shiftleft(id, 50)").alias("key"))
    found = exact.Directory(keys, 64, 4, max_depth=14)
    assert found.depth == 12
    assert max(r["count"] for r in keys.groupBy(found.bucket("key")).count().collect()) <= 4


def test_owners_get_buckets_of_the_directory(spark):
    """Each bucket has one owner and as many keys as fit; all texts of a key are chained there."""
    rows = [(i, f"text {i % 200}") for i in range(600)]
    docs = spark.createDataFrame(rows, EMPTY)
    index = exact.Index(exact.keyed(docs, 64).select(F.col("_key").alias("key")), capacity=8)
    entries = index.entries(docs)
    assert entries.count() == 200
    assert entries.select("_bucket").distinct().count() >= 25
    assert max(r["count"] for r in entries.groupBy("_bucket").count().collect()) <= 8
    files = entries.select("_bucket", F.input_file_name().alias("f")).distinct()
    assert files.count() == entries.select("_bucket").distinct().count()
    assert {r._bucket for r in entries.select("_bucket", index.directory.bucket().alias("b")).filter("_bucket = b").collect()} == {r._bucket for r in entries.collect()}


def test_line_dedup(spark, docs):
    found = lines.line_report(brute.frame(spark, docs)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == brute.removed_lines(docs)
    texts = {r.doc_id: r.text for r in lines.drop_lines(brute.frame(spark, docs)).collect()}
    gone = {d: {int(i) for i in x.split(",") if i} for d, (_, _, x) in brute.removed_lines(docs).items()}
    assert texts == {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}
    assert lines.line_report(spark.createDataFrame([], EMPTY)).count() == 0
