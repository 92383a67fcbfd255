"""Quality classification by Bradley-Terry ranking.

A document's score is linear in its features: shares of byte classes, word statistics and hashed words and word pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import back, carried
from quillspark.llm.text import NOT_SPACE, Rolling, U, Words, buffers, chunks, grouped_order

FIT_ROWS, MAX_PAIRS = 20_000, 200_000
"""At most so many labelled documents are read to fit the weights, the first by a hash of doc_id, and so many pairs of them compared."""
PAIRS_EACH, STEPS, RATE, DECAY, HASH_DECAY = 40, 400, 0.2, 1e-3, 1e-2
SEED, CUT, BINS = 7, 0.3, 4096
HASH_BITS, DAMPING = 9, 32
"""Hashed words and pairs fall in 2**HASH_BITS cells with a sign; short texts count as if they had DAMPING more words."""

KINDS = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "stop": b".,;:?",
    "loud": b"!",
    "mark": b"#$%&*@^~+=<>",
    "bar": b"|_\\/-",
    "quote": b"\"'()[]{}",
    "line": b"\n",
    "high": range(0x80, 0x100),
}
"""Classes of bytes whose shares are features."""
NAMES = [*KINDS, "log_words", "word_size", "distinct", "same_as_before", "bare_ends", "long_words", "same_two_before", "top_word"]
N_FEATURES = 2 * len(NAMES)


def features(w: Words, offsets: np.ndarray) -> np.ndarray:
    """A row per document: shares of byte classes and word statistics, and their square roots."""
    data = w.raw
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    out = np.zeros((n, len(NAMES)))
    code = np.full(256, len(KINDS), np.int64)
    for i, chars in enumerate(KINDS.values()):
        code[list(chars)] = i
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc_of_byte * (len(KINDS) + 1) + code[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    out[:, : len(KINDS)] = kinds[:, : len(KINDS)] / np.maximum(size, 1)[:, None]
    words = np.maximum(w.counts, 1).astype(np.float64)
    length = (w.ends - w.starts).astype(np.float64)
    mean = lambda flag: np.bincount(w.doc, flag, n) / words
    out[:, len(KINDS)] = np.log1p(w.counts) / 10
    out[:, len(KINDS) + 1] = mean(length) / 20
    order = grouped_order(w.doc, w.hash, n)
    h, d = w.hash[order], w.doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
    out[:, len(KINDS) + 2] = np.bincount(d[new], minlength=n) / words
    same = lambda k: np.append(np.zeros(min(k, len(w.hash)), bool), (w.hash[k:] == w.hash[:-k]) & (w.doc[k:] == w.doc[:-k]))
    out[:, len(KINDS) + 3] = mean(same(1))
    if len(w.ends):
        last = w.data[w.ends - 1]
        out[:, len(KINDS) + 4] = mean(((last >= 0x61) & (last <= 0x7A)) | (last >= 0x80))
    out[:, len(KINDS) + 5] = mean(length > 20)
    out[:, len(KINDS) + 6] = mean(same(2))
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    out[:, len(KINDS) + 7] = top / words
    return np.concatenate([out, np.sqrt(out)], 1)


def hashed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, cell and signed value of each word and each pair of neighbouring words (lower case)."""
    at = np.flatnonzero(w.windows(2))
    h = np.concatenate([w.hash, Rolling(w.hash).at(at, 2)])
    doc = np.concatenate([w.doc, w.doc[at]])
    value = (1.0 - 2.0 * (h & U(1)).astype(np.float64)) / (w.counts + DAMPING)[doc]
    return doc, (h >> U(64 - HASH_BITS)).astype(np.int64), value


def pair_loss(score: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss log(1 + exp(bad - good)) of pairs of documents, and its derivative by each document's score."""
    diff = np.clip(score[good] - score[bad], -30, 30)
    g = -1 / (1 + np.exp(diff)) / len(good)
    return float(np.log1p(np.exp(-diff)).mean()), np.bincount(good, g, len(score)) - np.bincount(bad, g, len(score))


def best_cut(good: np.ndarray, bad: np.ndarray) -> int:
    """The edge k for which most is right when bins from k on are taken, good and bad ones weighing the same in all. Of neighbouring edges
    that are equally good, which empty bins lie between, the middle one."""
    right = 1 - np.append(0, np.cumsum(good)) / good.sum() + np.append(0, np.cumsum(bad)) / bad.sum()
    first = int(right.argmax())
    last = first + int(np.argmax(np.append(right[first:] < right[first] - 1e-12, True))) - 1
    return (first + last) // 2


class Ranker:
    """Weights learnt from preference pairs, and the score quantile that is the threshold."""

    def __init__(self, x: np.ndarray, cells: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        self.unit = np.sqrt(np.einsum("ij,ij->j", cells, cells, dtype=np.float64) / len(x)) + 1e-4 if len(x) else np.ones(1 << HASH_BITS)
        self.w = np.zeros(N_FEATURES + (1 << HASH_BITS))
        self.threshold, self.scale, self.quantile = 0.0, 1.0, 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(bad):
            own, unit = np.clip((x - self.mean) / self.spread, -8, 8).astype(np.float32), self.unit.astype(np.float32)
            decay = np.where(np.arange(len(self.w)) < N_FEATURES, DECAY, HASH_DECAY)
            rng = np.random.default_rng(SEED)
            n = min(MAX_PAIRS, PAIRS_EACH * max(len(good), len(bad)))
            one, two = rng.choice(good, n), rng.choice(bad, n)
            m, v = np.zeros(len(self.w)), np.zeros(len(self.w))
            for step in range(1, STEPS + 1):  # the loss and a small weight decay, by Adam
                w = self.w.astype(np.float32)
                slope = pair_loss(own @ w[:N_FEATURES] + cells @ (w[N_FEATURES:] / unit), one, two)[1].astype(np.float32)
                g = np.concatenate([slope @ own, slope @ cells / unit]) + decay * self.w
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                self.w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def raw(self, w: Words, offsets: np.ndarray) -> np.ndarray:
        """Scores of some documents, without bounds."""
        doc, cell, value = hashed(w)
        own = np.clip((features(w, offsets) - self.mean) / self.spread, -8, 8) @ self.w[:N_FEATURES]
        return own + np.bincount(doc, value * (self.w[N_FEATURES:] / self.unit)[cell], w.n_docs)

    def calibrate(self, scored: DataFrame, labels: DataFrame) -> Ranker:
        """Sets the threshold at the quantile of all labelled scores (doc_id, raw) that separates their labels best, from a histogram."""
        rows = scored.select("doc_id", "raw").join(_labelled(labels), "doc_id")
        lo, hi, kinds = rows.agg(F.min("raw"), F.max("raw"), F.count_distinct("quality")).first()
        if kinds != 2 or hi <= lo:
            return self
        width = (hi - lo) / BINS
        bins = F.least(F.lit(BINS - 1), F.floor((F.col("raw") - lo) / width)).cast("int")
        count = np.zeros((2, BINS))
        for r in rows.groupBy(bins.alias("bin"), "quality").agg(F.count("*").alias("n")).collect():
            count[r.quality, r.bin] = r.n
        k = best_cut(count[1], count[0])
        self.threshold = lo + k * width
        every = count.sum(0)
        self.quantile = float(every[:k].sum() / every.sum())
        far = np.abs(lo + (np.arange(BINS) + 0.5) * width - self.threshold)
        order = np.argsort(far)
        self.scale = max(1e-6, float(far[order][np.searchsorted(np.cumsum(every[order]), every.sum() / 2)]) / 2)
        return self


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))


def _words(batch: pa.RecordBatch, most_docs: int = 2000) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """The words of parts of a batch, with and without case folded, of at most so many documents."""
    data, offsets = buffers(batch["text"])
    for a, b in chunks(offsets):
        for lo in range(a, b, most_docs):
            hi = min(b, lo + most_docs)
            o = offsets[lo : hi + 1]
            w = Words(data[o[0] : o[-1]], o - o[0], NOT_SPACE, True)
            w.raw = data[o[0] : o[-1]]
            yield lo, hi, w, o - o[0]


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ranker:
    """Fits weights on labelled documents (labels: doc_id, quality 0 or 1), the first fit_rows labels by a hash of doc_id.

    The chosen labels are at most fit_rows rows and go out to the documents; what comes back are their features, hashed ones as
    non-zero cells. Labels of other values and null are put aside; a document with contradicting labels counts with each.
    """
    chosen = _labelled(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, offsets in _words(batch):
                doc, cell, value = hashed(w)
                k = hi - lo
                dense = np.bincount(doc * (1 << HASH_BITS) + cell, value, k << HASH_BITS).astype(np.float32).reshape(k, -1)
                sparse = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r != 0].astype(np.float16).tobytes() for r in dense]
                x = [r.tobytes() for r in features(w, offsets)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(sparse, pa.binary()), batch["quality"].slice(lo, k)], names=["x", "cells", "y"])

    found = sorted((bytes(r.x), bytes(r.cells), r.y) for r in rows.mapInArrow(measure, "x binary, cells binary, y int").collect())
    x = np.array([np.frombuffer(r[0]) for r in found]).reshape(-1, N_FEATURES)
    cells = np.zeros((len(found), 1 << HASH_BITS), np.float32)
    for i, (_, blob, _) in enumerate(found):
        k = len(blob) // 4
        cells[i, np.frombuffer(blob, np.uint16, k)] = np.frombuffer(blob, np.float16, k, 2 * k)
    return Ranker(x, cells, np.array([r[2] for r in found], int))


def raw_scores(documents: DataFrame, ranker: Ranker, keep: list[str] | None = None) -> DataFrame:
    """doc_id and raw score of each document, then the columns named in keep."""
    renamed, kept = carried(documents, keep)
    shared = documents.sparkSession.sparkContext.broadcast(ranker)
    source = renamed.select(F.col("doc_id").cast("bigint").alias("doc_id"), *dict.fromkeys(["text", *kept]))
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in (source.schema[k] for k in kept))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, offsets in _words(batch):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(shared.value.raw(w, offsets)), *(part[k] for k in kept)], names=["doc_id", "raw", *kept])

    return back(source.mapInArrow(score, "doc_id bigint, raw double" + extra), keep)


def rated(scored: DataFrame, ranker: Ranker) -> DataFrame:
    """Raw scores as score (0 to 1, CUT at the threshold) and predicted (1 if score >= CUT); other columns follow."""
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (F.col("raw") - ranker.threshold) / ranker.scale + math.log(CUT / (1 - CUT))))
    rows = scored.withColumn("raw", 1 / (1 + F.exp(-z)))
    rest = [F.col(f"`{c}`") for c in scored.columns if c not in ("doc_id", "raw")]
    return rows.select("doc_id", F.col("raw").alias("score"), (F.col("raw") >= CUT).cast("int").alias("predicted"), *rest)


def rate(documents: DataFrame, ranker: Ranker, keep: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= CUT) of each document, then the columns named in keep.

    Only the text counts. Null is empty; an empty text has the features of no words and gets a score like any other. Repeated
    rows give repeated results, ties equal scores. Other columns are ignored; one in keep that is called like a result comes back as
    `kept_` and its name.
    """
    keep = keep or []
    clash = {c: f"kept_{c}" for c in keep if c in ("score", "predicted")}
    out = rated(raw_scores(documents, ranker, keep), ranker)
    names = ["doc_id", "score", "predicted", *(clash.get(c, c) for c in out.columns[3:])]
    return out.toDF(*names)
