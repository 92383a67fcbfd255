"""Substring dedup: count-min prefilter, then exact groups of the windows that may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.repeats import RECORDS, build_sketch, by_bucket, doc_bucket, marked, owned_bucket, pack, passed_on, runs, text_values, to_owners, with_marks
from quillspark.llm.shared import partitions, saved
from quillspark.llm.text import NOT_SPACE, U, Rolling, Words, buffers, chunks, mix, numbers, window_min

WINDOW, GRAM, SKETCH_BITS = 13, 6, 27
SECOND = 0x632BE59BD9B4E019
FLUSH = 2_000_000
SEEN = np.dtype([("hash", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("at", "<u4")])
"""A window: 128 bits of hashes of its words, and where it starts."""
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string"


def _least(w: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows inside documents, and the least gram hash of each."""
    at = np.flatnonzero(w.windows(window))
    return at, window_min(Rolling(w.hash).all(gram), window - gram + 1)[at]


def remove_repeats(documents: DataFrame, *, window: int = WINDOW, gram: int = GRAM, sketch_bits: int = SKETCH_BITS, with_text: bool = True) -> DataFrame:
    """Documents without the words that a window of a document with a smaller doc_id has already.

    Words are `[^\\x20\\x09-\\x0D]+`. A window's key in the sketch is the least of its `gram`-gram hashes, a function
    of its words alone; a partition adds a key once for each stretch of windows that share the gram. So equal windows
    in two documents count two at least, and the sketch never estimates less than the true number of documents.
    The second pass groups exactly (by 128 bits, two independent hashes of the words) only windows that are estimated to repeat. Each task first
    keeps just the smallest doc_id of a window it has met, which resolves the later ones on the spot: a window that a
    third of all rows share reaches its group once per task. 2**(sketch_bits + 1) bits go out to the executors; on far
    larger inputs the sketch fills up and more windows are grouped, none is lost.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with_text, text (kept words joined by one space). Null and empty texts
    have no words and lose none. doc_id should be unique; rows that repeat it count as one document for windows, and each loses the
    words of all marked places. Rows with a null doc_id lose nothing and take nothing from others. Other columns are ignored.
    """
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = source.filter("doc_id IS NOT NULL")

    def keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = Words(data, offsets, NOT_SPACE, False)
        at, least = _least(w, gram, window)
        doc = w.doc[at]
        return least[np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))[: len(least)]]

    shared = spark.sparkContext.broadcast(build_sketch(named.select("text"), text_values(keys), sketch_bits))
    n = partitions(spark)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows that may repeat, the smallest document of each; and marks of the rest. Marks have bucket -1 - b."""
        held, size = [], 0
        for batch in batches:
            data, offsets = buffers(batch["text"])
            ids = numbers(batch["doc_id"])
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                w = Words(data[o[0] : o[-1]], o - o[0], NOT_SPACE, False)
                at, least = _least(w, gram, window)
                at = at[shared.value.maybe_repeated(least)]
                rows = np.empty(len(at), SEEN)
                rows["hash"], rows["more"] = Rolling(w.hash).at(at, window), Rolling(mix(w.hash ^ U(SECOND))).at(at, window)
                rows["doc"], rows["at"] = ids[lo:hi][w.doc[at]], at - w.first[w.doc[at]]
                held.append(rows)
                size += len(rows)
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, later = _split(np.concatenate(held))
        yield from pack(owned_bucket(rows["hash"], n), rows)
        later = runs(later)
        yield from passed_on(pack(doc_bucket(later["doc"], n), later))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_bucket(batches):
            if isinstance(found, pa.RecordBatch):
                yield found
            else:
                _, later = _split(np.concatenate([np.frombuffer(x, SEEN) for x in found]))
                later = runs(later)
                yield from pack(doc_bucket(later["doc"], n), later)

    marks = saved(to_owners(named.mapInArrow(emit, RECORDS), n).mapInArrow(group, RECORDS), "marks")

    def finish(batch: pa.RecordBatch, by: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n_words, n_removed, digests, texts = [], [], [], []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = (text or "").encode().split()
            n_words.append(len(words))
            if doc in by:
                words = list(compress(words, ~marked(by[doc], window, len(words))))
            n_removed.append(n_words[-1] - len(words))
            text = b" ".join(words)
            texts.append(text if with_text else None)
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return with_marks(source, marks, n, finish, SCHEMA)


def _split(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each window's smallest document, and the rest."""
    order = np.lexsort((rows["at"], rows["doc"], rows["more"], rows["hash"]))
    rows = rows[order]
    new = np.append(True, (rows["hash"][1:] != rows["hash"][:-1]) | (rows["more"][1:] != rows["more"][:-1]))[: len(rows)]
    least = rows["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
    return rows[rows["doc"] == least], rows[rows["doc"] != least]
