"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import back, carried
from quillspark.llm.text import NOT_SPACE, Words, buffers, chunks

FIT_DOCS = 20_000
"""At most about so many labelled documents are read to fit the model, chosen by a hash of doc_id."""
BUCKETS = 16
SMOOTH, CAP, PENALTY, OUT = 0.5, 6.0, 8.0, -40.0
LEAST_SHARE = 0.01

# Scripts by ranges of code points, Latin first.
SCRIPTS = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "Armenian": ((0x531, 0x58A), (0xFB13, 0xFB17)),
    "Hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)),
    "Syriac": ((0x700, 0x74F),),
    "Thaana": ((0x780, 0x7BF),),
    "Devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "Bengali": ((0x980, 0x9FF),),
    "Gurmukhi": ((0xA00, 0xA7F),),
    "Gujarati": ((0xA80, 0xAFF),),
    "Oriya": ((0xB00, 0xB7F),),
    "Tamil": ((0xB80, 0xBFF),),
    "Telugu": ((0xC00, 0xC7F),),
    "Kannada": ((0xC80, 0xCFF),),
    "Malayalam": ((0xD00, 0xD7F),),
    "Sinhala": ((0xD80, 0xDFF),),
    "Thai": ((0xE00, 0xE7F),),
    "Lao": ((0xE80, 0xEFF),),
    "Tibetan": ((0xF00, 0xFFF),),
    "Myanmar": ((0x1000, 0x109F),),
    "Georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)),
    "Cherokee": ((0x13A0, 0x13FF), (0xAB70, 0xABBF)),
    "Khmer": ((0x1780, 0x17FF),),
    "Mongolian": ((0x1800, 0x18AF),),
    "Kana": ((0x3041, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "Han": ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
    "Hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
}
N_SCRIPTS = len(SCRIPTS) + 1
"""Scripts are numbered from 1 in this order; 0 is none. The script of a word is the highest number among its characters."""
_RANGES = sorted((first, last, i) for i, ranges in enumerate(SCRIPTS.values(), 1) for first, last in ranges)
_FIRST, _LAST, _SCRIPT = (np.array(x, np.uint32) for x in zip(*_RANGES, strict=True))
_ASCII = np.zeros(256, np.uint8)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def scripts_of(data: np.ndarray) -> np.ndarray:
    """The script of each character of UTF-8 bytes, at its first byte; 0 elsewhere."""
    out = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        b = np.concatenate([data, np.zeros(3, np.uint8)])
        byte = lambda i: b[lead + i].astype(np.uint32)
        tail = lambda i: byte(i) & np.uint32(63)
        two, three = (byte(0) & np.uint32(31)) << np.uint32(6) | tail(1), (byte(0) & np.uint32(15)) << np.uint32(12) | tail(1) << np.uint32(6) | tail(2)
        four = (byte(0) & np.uint32(7)) << np.uint32(18) | tail(1) << np.uint32(12) | tail(2) << np.uint32(6) | tail(3)
        code = np.where(byte(0) < 0xE0, two, np.where(byte(0) < 0xF0, three, four))
        at = np.searchsorted(_FIRST, code, "right") - 1
        out[lead] = np.where((at >= 0) & (code <= _LAST[at]), _SCRIPT[at], 0)
    return out


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the three bytes around each byte of each word (space at its ends), and where words begin among them."""
    size = w.ends - w.starts
    begin = np.cumsum(size) - size
    place = np.repeat(w.starts - begin, size) + np.arange(size.sum())
    here = w.data[place].astype(np.uint32)
    prior, after = np.empty_like(here), np.empty_like(here)
    prior[1:], after[:-1] = here[:-1], here[1:]
    prior[begin] = after[begin + size - 1] = 32
    code = (prior << np.uint32(16)) | (here << np.uint32(8)) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS)).astype(np.int64), begin


def _scripts(w: Words, begin: np.ndarray) -> np.ndarray:
    """The script of each word; 0 without a letter."""
    return np.maximum.reduceat(scripts_of(w.data)[_inside(w)], begin) if len(begin) else np.zeros(0, np.uint8)


def _inside(w: Words) -> np.ndarray:
    size = w.ends - w.starts
    return np.repeat(w.starts - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    data, offsets = buffers(batch["text"])
    for lo, hi in chunks(offsets):  # only the scores of a chunk are in memory
        o = offsets[lo : hi + 1]
        yield lo, hi, Words(data[o[0] : o[-1]], o - o[0], NOT_SPACE, True, hashes=False)


class Model:
    """Log-likelihood ratios of byte trigrams, the candidates of each script, and the most frequent language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        self.first = max(range(len(self.langs)), key=lambda i: counts[self.langs[i]][1].sum()) if self.langs else 0
        if self.langs:
            c = np.stack([counts[x][0] for x in self.langs], 1).astype(np.float64) + SMOOTH
            logs = np.log(c / c.sum(0))
            self.ratio = (logs - logs.mean(1, keepdims=True)).astype(np.float32)
            seen = np.stack([counts[x][1] for x in self.langs], 1).astype(np.float64)
            allowed = seen >= LEAST_SHARE * seen.sum(0)
            allowed |= ~allowed.any(1, keepdims=True)
            self.out = np.where(allowed & (seen.sum(1, keepdims=True) > 0), 0, np.where(seen.sum(1, keepdims=True) > 0, OUT, 0)).astype(np.float32)
            self.out[0] = 0
            if len(self.langs) > np.iinfo(np.int16).max:
                raise ValueError(f"{len(self.langs)} languages are more than labels can name")

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word for each language, and its script."""
        grams, begin = _grams(w)
        if not len(begin):
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.uint8)
        script = _scripts(w, begin)
        score = np.stack([np.add.reduceat(self.ratio[grams, i], begin) for i in range(len(self.langs))], 1)
        np.clip(score, -CAP, CAP, out=score)
        score[script == 0] = 0
        return score + self.out[script], script


def viterbi(score: np.ndarray, first: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of each document through its words' scores, where every switch costs the penalty.

    Documents advance together, a word at a time, longest first.
    """
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    n = len(counts)
    longest = int(counts[0]) if n else 0
    active = np.searchsorted(-counts, -np.arange(longest), "left")
    label = np.zeros(len(score), np.int16)
    if not longest:
        return label
    switch = np.full(len(score), -1, np.int16)  # where a state that lost to best - penalty comes from
    lost = np.zeros(score.shape, bool)
    v = score[first[: active[0]]].astype(np.float64)
    last = np.zeros(active[0], np.int16)
    for t in range(1, longest):
        k = active[t]
        if k < len(v):
            last[k : len(v)] = v[k:].argmax(1)
            v = v[:k]
        at = first[:k] + t
        best = v.argmax(1)
        bar = v[np.arange(k), best] - penalty
        worse = v < bar[:, None]
        switch[at], lost[at] = best, worse
        v = np.where(worse, bar[:, None], v) + score[at]
    last[: len(v)] = v.argmax(1)
    state = last.copy()
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        s = state[:k]
        label[at] = s
        if t:
            state[:k] = np.where(lost[at, s], switch[at], s)
    return label


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Counts trigrams and scripts per language over labelled documents (doc_id, text, lang).

    Of more than fit_docs rows a part is taken by a hash of doc_id. Counts reach the driver as one vector per language.
    """
    labelled = labelled.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    n = labelled.count()
    if n > fit_docs:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(fit_docs / n * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for lo, hi, w in _words(batch):
                grams, begin = _grams(w)
                if not len(begin):
                    continue
                script, size = _scripts(w, begin), w.ends - w.starts
                for lang in set(langs[lo:hi].tolist()):
                    mine = (langs[lo:hi] == lang)[w.doc] & (script > 0)
                    c, s = totals.setdefault(lang, (np.zeros(1 << BUCKETS, np.int64), np.zeros(N_SCRIPTS, np.int64)))
                    c += np.bincount(grams[np.repeat(mine, size)], minlength=1 << BUCKETS)
                    s += np.bincount(script[mine], minlength=N_SCRIPTS)
        if totals:
            blobs = [np.concatenate([np.flatnonzero(c), c[c > 0], s]).astype(np.int64).tobytes() for c, s in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(blobs, pa.binary())], names=["lang", "counts"])

    def read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(blob, np.int64)
        k = (len(x) - N_SCRIPTS) // 2
        c = np.zeros(1 << BUCKETS, np.int64)
        c[x[:k]] = x[k : 2 * k]
        return c, x[2 * k :]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, blob in zip(batch["lang"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                c, s = read(blob)
                a, b = totals.get(lang, (0, 0))
                totals[lang] = a + c, b + s
        if totals:
            blobs = [np.concatenate([np.flatnonzero(c), c[c > 0], s]).astype(np.int64).tobytes() for c, s in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(blobs, pa.binary())], names=["lang", "counts"])

    rows = labelled.mapInArrow(count, "lang string, counts binary").repartition(8, "lang").mapInArrow(add, "lang string, counts binary").collect()
    return Model({r.lang: read(r.counts) for r in rows})


def identify(documents: DataFrame, model: Model, *, penalty: float = PENALTY, keep: list[str] | None = None, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of each document, then the columns named in keep, and with_spans its spans.

    Words are `[^\\x20\\x09-\\x0D]+`. A word's script leaves the languages that use it; its score for these sums the
    log-likelihood ratios of its byte trigrams, within limits. Viterbi with a cost for each switch labels all words;
    runs of a label are the spans (lang, first word, number of words). The language with most words that have a letter
    is the prediction, at a tie the one with the higher sum of scores, and score is its share of them.
    A text that is null or has no letter gives `und` with score 0, as does a model without languages.
    Repeated rows give repeated results.
    """
    renamed, names = carried(documents, keep)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = renamed.select(F.col("doc_id").cast("bigint").alias("doc_id"), *dict.fromkeys(["text", *names]))
    schema = "doc_id bigint, lang_pred string, score double" + (", spans array<struct<lang:string,start:bigint,words:bigint>>" if with_spans else "")
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in (source.schema[k] for k in names))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for lo, hi, w in _words(batch):
                part = batch.slice(lo, hi - lo)
                found = _predicted(m, w, part["text"], penalty, with_spans)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *found, *(part[k] for k in names)], names=["doc_id", "lang_pred", "score", *(["spans"] if with_spans else []), *names])

    return back(source.mapInArrow(label, schema), keep)


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))


def _predicted(m: Model, w: Words, texts: pa.Array, penalty: float, with_spans: bool) -> list[pa.Array]:
    """lang_pred, score and, if asked for, spans of some documents."""
    n, n_langs = w.n_docs, len(m.langs)
    if not n_langs:
        return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), *([pa.array([[]] * n, SPANS)] if with_spans else [])]
    score, script = m.scores(w)
    letters = _letters(w, texts)
    first = np.cumsum(w.counts) - w.counts
    labels = viterbi(score, first, w.counts, penalty)
    has = script > 0
    votes = np.bincount(w.doc[has] * n_langs + labels[has], minlength=n * n_langs).reshape(n, n_langs)
    sums = np.stack([np.bincount(w.doc, score[:, i], n).astype(float) for i in range(n_langs)], 1)
    sums[:, m.first] += 1e-9
    top = np.lexsort((sums, votes), 1)[:, -1]
    total = votes.sum(1)
    share = np.where(letters, np.where(total > 0, votes[np.arange(n), top] / np.maximum(total, 1), 1 / n_langs), 0.0)
    out = [pa.array([m.langs[k] if ok else "und" for k, ok in zip(top, letters, strict=True)], pa.string()), pa.array(share, pa.float64())]
    if with_spans:
        out.append(pa.array([_spans(labels[f : f + c], m.langs) for f, c in zip(first, w.counts, strict=True)], SPANS))
    return out


def _letters(w: Words, texts: pa.Array) -> np.ndarray:
    """Whether documents have a letter; only those without an ASCII letter are read character by character."""
    ascii_letter = ((w.data >= 0x61) & (w.data <= 0x7A)).astype(np.int64)
    upto = np.append(0, np.cumsum(ascii_letter))
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    out = upto[ends] > upto[ends - sizes]
    for i in np.flatnonzero(~out & (sizes > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def _spans(labels: np.ndarray, langs: list[str]) -> list[dict]:
    if not len(labels):
        return []
    edges = np.append(np.flatnonzero(np.diff(labels, prepend=-1)), len(labels))
    return [{"lang": langs[labels[a]], "start": int(a), "words": int(b - a)} for a, b in zip(edges[:-1], edges[1:], strict=True)]


