"""Queries over whole small tables against brute force: no key, text or name is left out."""

import re
from collections import defaultdict

import pytest

from quillspark.functions import lexicon as lx
from quillspark.plans import all_queries


@pytest.fixture
def run(spark, tmp_path):
    def write(name, **tables):
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        return [r.asDict() for r in all_queries()[name](spark, str(tmp_path)).collect()]

    return write


def test_tokens_of_whole_texts(run):
    filler = "word " * 60
    texts = [f"Ann {filler}deep", f"Bob {filler}deep GmbH", f"Ann {filler}é deep once", "Cid deep", None, "Ann rare deep rare"]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    found = run("token_follow_stats", documents=(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    first, legal = defaultdict(set), defaultdict(list)
    for t in filter(None, texts):
        words = re.sub("[^A-Z0-9]+", " ", re.sub(r"[^\x00-\x7F]+", " ", t).upper()).strip().split(" ")
        for x in set(words[1:]):
            first[x].add(words[0])
            legal[x].append(bool(set(words) & set(lx.LEGAL_STRICT)))
    want = {x: (len(first[x]), len(f), pytest.approx(sum(f) / len(f), abs=1e-6)) for x, f in legal.items() if len(f) >= 3}
    assert want["DEEP"][:2] == (3, 5)
    assert {r["x"]: (r["follow"], r["n"], r["legal"]) for r in found} == want
