"""Plain versions of the operators, straight from their contracts."""

import hashlib
import random
import re
from collections import defaultdict

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def raw(text):
    return (text or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def corpus(seed=0, n=40):
    """Documents with copies, near copies, shared passages, periodic, empty, null, very long and odd texts."""
    rng = random.Random(seed)
    words = ["the", "Of", "naïve", "x1", "ßu", "und", "re", "日本", "a.b", "e-f"] + [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = text(40)
    base = [text(rng.randint(1, 120)) for _ in range(n // 2)]
    docs = [*base, None, "", " \t\n", "one", "Two three", "aaaa " * 60, "A" * 300, text(3000), passage, "\x00\x01 \x7f" * 20, "lower CASE", "LOWER case"]
    for _ in range(n):
        t = rng.choice(base).split(" ")
        if rng.random() < 0.5 and len(t) > 3:
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.4:
            at = rng.randrange(len(t))
            t[at:at] = passage.split(" ")
        docs.append(rng.choice([" ", "\n", "  "]).join(t))
    ids = rng.sample(range(-5, 10 * len(docs)), len(docs))
    return list(zip(ids, docs, strict=True))


def frame(spark, rows, extra=True):
    """With further columns whose names clash with those of results."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    return df.selectExpr("*", "doc_id % 3 AS n_words", "'x' AS key", "1 AS bucket") if extra else df


def decontaminated(docs, items, window=13):
    table = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(raw(text).translate(UPPER))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            table[tuple(w[j : j + n])].add(str(i))
    out = {}
    for d, text in docs:
        w = ALNUM.findall(raw(text).translate(UPPER))
        hit, names = bytearray(len(w)), set()
        for n in {len(k) for k in table}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in table:
                    hit[j : j + n] = b"\1" * n
                    names |= table[tuple(w[j : j + n])]
        out[d] = (len(w), sum(hit), len(names), sha(",".join(sorted(names)).encode()), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def without_strings(docs, length=100):
    seen, out = set(), {}
    for d, text in sorted(docs):
        b = raw(text)
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def without_windows(docs, window=13):
    first, out = {}, {}
    words = {d: BLANK.findall(raw(t)) for d, t in docs}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    for d, w in words.items():
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = b"\1" * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), len(w) - len(kept), sha(b" ".join(kept)))
    return out


def shingles(text, n=4):
    w = BLANK.findall(raw(text).translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, n=4, num=85, den=100):
    sets = {d: shingles(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def removed_lines(docs, num=4, den=5):
    lines = []
    for d, text in sorted(docs):
        lines += [(d, i, set(BLANK.findall(raw(x)))) for i, x in enumerate((text or "").split("\n"))]
    gone = defaultdict(list)
    for k, (d, i, s) in enumerate(lines):
        if s and any(t and den * len(s & t) >= num * len(s | t) for _, _, t in lines[:k]):
            gone[d].append(i)
    return {d: (len((t or "").split("\n")), len(gone[d]), ",".join(map(str, gone[d]))) for d, t in docs}


def plain_viterbi(score, penalty):
    n, m = score.shape
    v, back = score[0].copy(), []
    for t in range(1, n):
        best = v.argmax()
        come = [j if v[j] >= v[best] - penalty else best for j in range(m)]
        back.append(come)
        v = [max(v[j], v[best] - penalty) + score[t, j] for j in range(m)]
        import numpy as np

        v = np.array(v)
    path = [int(v.argmax())]
    for come in reversed(back):
        path.append(int(come[path[-1]]))
    return path[::-1]
