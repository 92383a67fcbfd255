import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, language, mixing, quality
from quillspark.llm.queries import QUERIES
from quillspark.llm.text import NOT_SPACE, Rolling, Words, window_min
from tests.llm import brute

DATA = "/root/testdata/sf0.01"


def test_window_min_and_hashes():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 69, 300, 301):
        assert window_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
    twice = np.concatenate([x, x])
    r = Rolling(twice)
    assert (r.all(13)[:288] == r.all(13)[300:588]).all()
    assert r.at(np.array([5, 305]), np.array([40, 40])).tolist() == [r.all(40)[5]] * 2


def test_viterbi_is_the_plain_one():
    rng = np.random.default_rng(1)
    counts = np.array([0, 5, 1, 40, 0, 17, 40])
    score = rng.normal(size=(counts.sum(), 4)).round(1).astype(np.float32)
    first = np.cumsum(counts) - counts
    found = language.viterbi(score, first, counts, 2.0)
    for f, c in zip(first, counts, strict=True):
        if c:
            path = brute.plain_viterbi(score[f : f + c].astype(float), 2.0)
            worth = lambda p: sum(score[f + i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            assert worth(found[f : f + c].tolist()) == pytest.approx(worth(path), abs=1e-4)


def test_scripts_of_characters():
    text = "aZ é ß ×÷ Ж λ א ع ह বাংলা த ไ ひ漢 한 ắ 𠀀 1!"
    found = language.scripts_of(np.frombuffer(text.encode(), np.uint8))
    names = ["", *language.SCRIPTS]
    at, got = 0, []
    for c in text:
        got.append((c, names[found[at]]))
        assert not found[at + 1 : at + len(c.encode())].any()
        at += len(c.encode())
    expected = dict.fromkeys("aZéßắ", "Latin") | {"Ж": "Cyrillic", "λ": "Greek", "א": "Hebrew", "ع": "Arabic", "ह": "Devanagari", "த": "Tamil", "ไ": "Thai", "ひ": "Kana", "漢": "Han", "한": "Hangul", "𠀀": "Han"} | dict.fromkeys("বাংলা", "Bengali")
    assert got == [(c, expected.get(c, "")) for c in text]


def test_scripts_keep_languages_apart(spark):
    """Languages of different scripts, also where UTF-8's first bytes are the same."""
    texts = {"hi": "यह हिन्दी है और यह भी", "bn": "এটা বাংলা ভাষা এবং এটাও", "ta": "இது தமிழ் மொழி இதுவும்", "th": "นี่คือ ภาษา ไทย", "vi": "đây là tiếng việt những", "ja": "これは にほんご です", "zh": "这是 中文 句子"}
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts.items())], "doc_id bigint, text string, lang string")
    model = language.fit(df)
    tests = [(0, "हिन्दी"), (1, "ভাষা"), (2, "மொழி"), (3, "ไทย"), (4, "tiếng"), (5, "です"), (6, "中文"), (7, "ক"), (8, "ฮ")]
    found = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(tests, "doc_id bigint, text string"), model).collect()}
    assert [found[i] for i in range(9)] == ["hi", "bn", "ta", "th", "vi", "ja", "zh", "bn", "th"]


def test_language_is_the_plain_one(spark):
    """Scores, labels, prediction and share against plain Python over the same counts."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat est sur la table", "fr"), ("это кошка", "ru"), ("the dog and the hat", "en")])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(df)
    langs = sorted({lang for _, _, lang in rows})
    bucket = lambda a, b, c: (((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> (32 - language.BUCKETS)
    grams = lambda w: [bucket(*x) for x in zip(b" " + w, w, w[1:] + b" ", strict=False)]
    script = lambda w: int(language.scripts_of(np.frombuffer(w, np.uint8)).max())
    words = lambda t: brute.BLANK.findall(brute.raw(t).translate(brute.UPPER))
    count = {lang: np.full(1 << language.BUCKETS, language.SMOOTH) for lang in langs}
    seen = np.zeros((language.N_SCRIPTS, len(langs)))
    for _, t, lang in rows:
        for w in words(t):
            if script(w):
                seen[script(w), langs.index(lang)] += 1
                for g in grams(w):
                    count[lang][g] += 1
    logs = np.stack([np.log(count[x] / count[x].sum()) for x in langs], 1)
    ratio = logs - logs.mean(1, keepdims=True)

    def score(w):
        s = script(w)
        if not s:
            return np.zeros(len(langs))
        x = np.clip(sum(ratio[g] for g in grams(w)), -language.CAP, language.CAP)
        here = seen[s] >= language.LEAST_SHARE * np.maximum(seen.sum(0), 1e-9)
        return x + (np.where(here, 0, language.OUT) if seen[s].sum() and here.any() else 0)

    tests = [(0, "the hat und die katze"), (1, "chat 12 table кошка"), (2, "zzz"), (3, "der hund the cat the mat le chat")]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(tests, "doc_id bigint, text string"), model, penalty=1.5, with_spans=True).collect()}
    for i, t in tests:
        w = words(t)
        scores = np.stack([score(x) for x in w])
        path = brute.plain_viterbi(scores, 1.5)
        votes = np.bincount([p for p, x in zip(path, w, strict=True) if script(x)], minlength=len(langs))
        best = max(range(len(langs)), key=lambda k: (votes[k], scores[:, k].sum()))
        assert (found[i].lang_pred, found[i].score) == (langs[best], pytest.approx(votes[best] / votes.sum()))
        assert [s.lang for s in found[i].spans for _ in range(s.words)] == [langs[p] for p in path]


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat with the hat", "en"), (2, "der hund und die katze auf der matte", "de"), (3, "это русский текст о кошке", "ru"), (4, None, "en"), (5, "123 !!! €", None), (6, "", "de")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(df)
    assert model.langs == ["de", "en", "ru"]
    tests = [(1, "the cat"), (2, "und die hund"), (3, "кошке"), (4, None), (5, "1 2 € ×"), (6, ""), (7, "der hund und die katze auf der matte the cat sat on the mat with the hat"), (8, "ª"), (9, "the " * 30000)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(tests, "doc_id bigint, text string"), model, penalty=2.0, with_spans=True).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 9)] == ["en", "de", "ru", "und", "und", "und", "en"]
    assert [(s.lang, s.words) for s in found[7].spans] == [("de", 8), ("en", 9)]
    assert found[8].lang_pred in model.langs
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = language.fit(df.limit(0))
    assert [r.lang_pred for r in language.identify(df.limit(1), nothing).collect()] == ["und"]
    assert language.identify(df.limit(0), model).count() == 0


def test_more_languages_than_a_byte_can_name(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + (i * 7 + j) % 26)}x{i}" for j in range(30)), f"l{i:03}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.identify(df, language.fit(df), keep=["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in found) > 190


def test_kept_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "the cat sat", "en", 7, 0.5)], "doc_id bigint, text string, lang string, lang_pred int, score double")
    model = language.fit(df)
    found = language.identify(df, model, keep=df.columns)
    assert found.columns == ["doc_id", "lang_pred", "score", "kept_doc_id", "text", "lang", "kept_lang_pred", "kept_score"]
    assert tuple(found.first())[3:] == (1, "the cat sat", "en", 7, 0.5)
    rated = quality.rate(df, quality.fit(df, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")), keep=["score"])
    assert (rated.columns, rated.first().kept_score) == (["doc_id", "score", "predicted", "kept_score"], 0.5)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = QUERIES["op4_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = QUERIES["op5_quality_ranking"](spark, DATA).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([r.predicted == r.quality for r in found]) > 0.93
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in found)


def test_pair_loss_and_cut():
    rng = np.random.default_rng(3)
    score, good, bad = rng.normal(size=6), np.array([0, 1, 1, 5]), np.array([2, 3, 4, 4])
    loss, slope = quality.pair_loss(score, good, bad)
    plain = lambda s: sum(np.log1p(np.exp(s[b] - s[g])) for g, b in zip(good, bad, strict=True)) / 4
    assert loss == pytest.approx(plain(score))
    for i in range(6):
        step = np.eye(6)[i] * 1e-6
        assert slope[i] == pytest.approx((plain(score + step) - plain(score - step)) / 2e-6, abs=1e-6)
    g, b = rng.integers(0, 5, 20), rng.integers(0, 5, 20)
    right = [g[k:].sum() / g.sum() + b[:k].sum() / b.sum() for k in range(21)]
    assert right[quality.best_cut(g, b)] == pytest.approx(max(right))


def test_scores_and_threshold_are_the_plain_ones(spark):
    """Raw scores from features and a word-by-word sum; the threshold against every possible one."""
    rows = [(i, ("good fine words here now " * (1 + i % 4) if i % 2 else "zz!! 99 ## zz " * (1 + i % 3)).strip(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    ranker = quality.fit(df, df)
    scored = quality.raw_scores(df, ranker)
    raw = {r.doc_id: r.raw for r in scored.collect()}
    for i, t, _ in rows[:6]:
        b = np.frombuffer(t.encode(), np.uint8)
        w = Words(b, np.array([0, len(b)]), NOT_SPACE, True)
        w.raw = b
        x = np.clip((quality.features(w, np.array([0, len(b)]))[0] - ranker.mean) / ranker.spread, -8, 8)
        total = float(x @ ranker.w[: quality.N_FEATURES])
        words = [w.hash[k] for k in range(len(w.hash))]
        for h in [*words, *Rolling(w.hash).all(2)]:
            cell = int(h) >> (64 - quality.HASH_BITS)
            total += (1 - 2 * (int(h) & 1)) / (len(words) + quality.DAMPING) * ranker.w[quality.N_FEATURES + cell] / ranker.unit[cell]
        assert raw[i] == pytest.approx(total, rel=1e-6, abs=1e-6)
    ranker.calibrate(scored, df)
    right = lambda cut: np.mean([raw[i] >= cut for i, _, q in rows if q]) + np.mean([raw[i] < cut for i, _, q in rows if not q])
    assert right(ranker.threshold) == pytest.approx(max(right(c) for c in [*raw.values(), np.inf]))
    out = quality.rate(df, ranker).collect()
    assert all((r.score >= 0.3) == (r.predicted == 1) == (raw[r.doc_id] >= ranker.threshold) for r in out)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 20000), (3, "y")], "doc_id bigint, text string")
    ranker = quality.fit(df, spark.createDataFrame([(1, None), (2, 7)], "doc_id bigint, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.rate(df, ranker).collect())
    assert quality.rate(df.limit(0), ranker).count() == 0


def test_mixing(spark):
    docs = brute.corpus(3)
    rows = [(d, t, (None, "b", "a", "c")[d % 4]) for d, t in docs]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    one, two = (sorted(map(tuple, mixing.mix(x).collect())) for x in (df, df.repartition(7)))
    assert one == two
    size = {d: len(brute.BLANK.findall(brute.raw(t))) for d, t, _ in rows}
    by = {}
    for d, _, s in rows:
        by.setdefault(s, []).append(d)
    totals = {s: sum(size[d] for d in ds) for s, ds in by.items()}
    weights = dict(zip(sorted((s for s in by if s), key=str) + [None] * (None in by), (3, 1, 2, 3), strict=False))
    left, target, free = 1.5 * sum(totals.values()), {}, dict(weights)
    while True:
        over = [s for s in free if left * free[s] / sum(free.values()) > 2 * totals[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * totals[s]
            free.pop(s)
        left = 1.5 * sum(totals.values()) - sum(target.values())
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    taken = dict.fromkeys(by, 0)
    source = {d: s for d, _, s in rows}
    for d, n, total, want, got in one:
        assert n == size[d]
        assert total == totals[source[d]]
        assert want == pytest.approx(target[source[d]])
        assert 0 <= got <= 2 * n
        taken[source[d]] += got
    assert all(abs(taken[s] - target[s]) <= 0.01 * sum(totals.values()) for s in by)
    plan = mixing.schedule(df, n_slots=64)[0].collect()
    per_slot = {}
    for r in plan:
        per_slot.setdefault(r.slot, [set(), 0])
        per_slot[r.slot][0].add(r.key)
        per_slot[r.slot][1] += r.tokens
    block = -(-3 * sum(totals.values()) // 128)
    assert all(len(keys) == 1 and n <= block for keys, n in per_slot.values())
    assert mixing.mix(df.limit(0)).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")).collect()] == [(1, 0, 0, 0.0, 0)]


TURNS = [(1, 1, "assistant", "hi </turn>\n<turn:user>\nno"), (1, 0, "user", "\\b \\l <x>"), (1, 2, "assistant", ""), (2, 0, None, None), (2, 0, "assistant", "日本 ok\n"), (None, 5, "tool>\n", "x")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS formatted", "'y' AS layout2")
    formatted = chat.format_turns(chat.canonical(df))
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, None):
        turns = sorted((t, r or "", x or "") for c, t, r, x in TURNS if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss.encode()))
    for r in formatted.collect():
        assert r.formatted.count("<turn:") == r.formatted.count("</turn>\n")
        assert found[r.conv_id].formatted_chars == len(r.formatted)
    assert chat.read_back(chat.format_turns(chat.canonical(df.limit(0)))).count() == 0


RECORDS = [
    (1, '{"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}', "messages", [("user", "a"), ("assistant", "b")]),
    (2, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
    (3, '{"instruction": "i", "input": "x", "output": "o"}', "instruction_input", [("user", "i\nx"), ("assistant", "o")]),
    (4, '{"output": "o", "instruction": "i"}', "instruction", [("user", "i"), ("assistant", "o")]),
    (5, '{"prompt": "p", "response": null}', "prompt", [("user", "p"), ("assistant", "")]),
    (6, '{"question": "q", "answer": "a"}', "question", [("user", "q"), ("assistant", "a")]),
    (7, '{"strange": 1}', None, [(None, None)]),
    (8, "not json", None, [(None, None)]),
    (9, None, None, [(None, None)]),
    (10, '{"turns": [{"speaker": "bot", "text": "t"}]}', "turns", [("assistant", "t")]),
    (11, '{"id": 5, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}, {"role": "tool"}]}', "messages", [("user", "a"), ("assistant", "b"), ("tool", None)]),
    (12, '{"messages": []}', "messages", [(None, None)]),
    (13, '{"prompt": "p", "response": "r", "id": 1, "system": null}', "system_prompt", [("system", ""), ("user", "p"), ("assistant", "r")]),
    (14, '{"messages": "text", "prompt": "p", "completion": "c"}', "completion", [("user", "p"), ("assistant", "c")]),
    (15, '{"messages": [1, 2]}', None, [(None, None)]),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, r) for i, r, _, _ in RECORDS], "conv_id bigint, record string")
    rows = {}
    for r in chat.canonical(df).orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, (r.layout, []))[1].append((r.role, r.text))
    assert rows == {i: (layout, turns) for i, _, layout, turns in RECORDS}
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.range(1))
    assert chat.fingerprint({"a": "text", "b": ["text"]}) == chat.fingerprint({"b": ["text"], "a": "text"}) != chat.fingerprint({"a": "text"})
    assert {r.conv_id: r.reject_reason for r in chat.rejects(df).collect()} == {7: "no mapping", 8: "not JSON", 9: "not JSON", 15: "no mapping"}
    formatted = {r.conv_id: r for r in chat.format_turns(chat.canonical(df)).collect()}
    assert set(formatted) == {i for i, _, layout, _ in RECORDS if layout}
    assert (formatted[12].formatted, formatted[12].loss_spans) == ("", [])
    same = spark.createDataFrame([(1, 0, "human", "x"), (1, 0, "human", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert [r.role for r in chat.canonical(same).collect()] == ["human", "human"]  # rows keep their roles
