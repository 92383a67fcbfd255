"""Suffix-array dedup of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.repeats import MARK, RECORDS, Sketch, build_sketch, by_bucket, doc_bucket, marked, owned_bucket, pack, passed_on, runs, text_values, to_owners, unpack, with_marks
from quillspark.llm.shared import partitions, saved
from quillspark.llm.text import SYMBOL, U, Rolling, buffers, chunks, numbers, window_min

LENGTH, GRAM, SKETCH_BITS = 100, 32, 27
FLUSH_BYTES = 24 << 20
SORT_ROWS, SLICE = 50_000, 8192
PHRASE = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u2"), ("t", "<u2")])
"""n strings from byte `at` of a document whose trigger starts t bytes behind that."""
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _phrases(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parse: first string start, number of string starts and trigger of each phrase; and all gram hashes.

    The trigger of a string of `length` bytes is its least rolling `gram`-gram hash, the leftmost if several; a phrase
    is a stretch of string starts with the same trigger place, taken with the bytes of its last string. So phrases overlap
    by length - 1 bytes, end where a trigger leaves or a lesser one enters, and depend on nothing outside them.
    """
    roll = Rolling(SYMBOL[data])
    grams = roll.all(gram)
    least = window_min(grams, length - gram + 1)
    edge = np.zeros(len(data) + 1, np.int32)
    ends = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    np.add.at(edge, offsets[:-1], 1)
    np.add.at(edge, ends, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(at):
        return roll, at, at, np.zeros(0, U), grams
    m, g = least[at], grams[at]
    new = np.append(True, (at[1:] != at[:-1] + 1) | (m[1:] != m[:-1]) | (g[:-1] == m[:-1]))
    begin = np.flatnonzero(new)
    return roll, at[begin], np.diff(np.append(begin, len(at))), m[begin], grams


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after another."""
    before = np.cumsum(size) - size
    return data[np.repeat(start - before, size) + np.arange(size.sum())]


def remove_repeats(documents: DataFrame, *, length: int = LENGTH, gram: int = GRAM, sketch_bits: int = SKETCH_BITS, with_text: bool = True) -> DataFrame:
    """Documents without the bytes of any `length`-byte string that starts earlier in the corpus as well.

    Earlier means a smaller doc_id, or the same document and a smaller start; strings do not cross documents.
    Prefix-free parsing, spread over the cluster:
    - rolling-hash triggers cut every document into overlapping phrases; equal strings have their trigger at the same
      offset, so equal passages parse alike except at their two ends;
    - a count-min sketch of the triggers drops phrases whose trigger occurs once: none of their strings repeats;
    - the parse is owned by tasks by trigger, in SUBS buckets each. Of equal phrases (128 bits of hashes) the first in corpus order
      stays and the others' strings go. A task first keeps only the first of the equal phrases it has met and resolves the rest on
      the spot, so however frequent a phrase is, its owner gets it once per task;
    - triggers that have several phrases go out as a bitmap, and their phrases come with their bytes. A phrase is a dictionary entry (up
      to the trigger's end) and the parse's suffix from there on, as far as a string can reach. Per trigger the owner builds the suffix
      array of the dictionary entries, which all end in the trigger and so are ordered backwards from there, and that of the parse's
      suffixes, each with its common prefixes. A string with l bytes up to the trigger's end is equal to another if their entries have
      l bytes in common and their suffixes length - l; both arrays give these classes for every l, and combined in corpus order they
      leave the first string of each class. Bytes are compared exactly.
    Removed strings come back to the texts by doc_id. Bytes are judged on the input.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with_text, kept (bytes).
    Null counts as empty; shorter texts than `length` lose nothing. doc_id should be unique: rows that repeat it and
    the text are taken for the same document, and each loses what one would. Rows with a null doc_id lose nothing and take nothing from others. Other columns are ignored.
    """
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = source.filter("doc_id IS NOT NULL")
    triggers = text_values(lambda data, offsets: _phrases(data, offsets, length, gram)[3])
    n = partitions(spark)
    twice = spark.sparkContext.broadcast(build_sketch(named.select("text"), triggers, sketch_bits))
    parsed = saved(_pass(named, twice, n, length, gram, False), "parse")
    several = build_sketch(parsed.filter("bucket = -1").select("records"), lambda batch: iter(unpack(batch, np.dtype("<u8"))), sketch_bits, 1)
    dictionary = saved(_pass(named, spark.sparkContext.broadcast(several), n, length, gram, True), "dictionary")
    marks = parsed.filter("bucket >= 0").unionByName(dictionary)

    def finish(batch: pa.RecordBatch, by: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        data, offsets = buffers(batch["text"])
        n_removed, n_spans, digests, kept = [], [], [], []
        for i, doc in enumerate(batch["doc_id"].to_pylist()):
            text, spans = data[offsets[i] : offsets[i + 1]], 0
            if doc in by:
                gone = marked(by[doc], length, len(text))
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                n_removed.append(int(gone.sum()))
                text = text[~gone]
            else:
                n_removed.append(0)
            n_spans.append(spans)
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text.tobytes() if with_text else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_marks(source, marks, n, finish, SCHEMA)


def _pass(source: DataFrame, sketch: Broadcast, n: int, length: int, gram: int, with_bytes: bool) -> DataFrame:
    """Marks of repeated strings by bucket of doc_id. Without bytes: later ones of equal phrases, and in bucket -1 the
    triggers that have several phrases. With bytes: equal strings of a trigger's different phrases."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = buffers(batch["text"])
            ids = numbers(batch["doc_id"])
            for lo, hi in chunks(offsets):
                o = offsets[lo : hi + 1]
                held.append(_candidates(data[o[0] : o[-1]], o - o[0], ids[lo:hi], sketch.value, length, gram))
                size += len(held[-1][0])
                if size > FLUSH_BYTES:
                    yield from _dictionary(held, n, length, with_bytes)
                    held, size = [], 0
        if held:
            yield from _dictionary(held, n, length, with_bytes)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_bucket(batches):
            if isinstance(found, pa.RecordBatch):
                yield found
                continue
            count = [struct.unpack("<I", x[:4])[0] for x in found]
            rows = np.concatenate([np.frombuffer(x, PHRASE, k, 4) for x, k in zip(found, count, strict=True)])
            if with_bytes:
                texts = np.concatenate([np.frombuffer(x, np.uint8, offset=4 + k * PHRASE.itemsize) for x, k in zip(found, count, strict=True)])
                gone = _repeated(rows, texts, length, gram)
            else:
                gone, several = _later(rows)
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([several.tobytes()], pa.binary())], names=["bucket", "records"])
            yield from pack(doc_bucket(gone["doc"], n), gone)

    return to_owners(source.mapInArrow(parse, RECORDS), n).mapInArrow(order, RECORDS)


def _candidates(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, sketch: Sketch, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, phrases whose trigger may repeat, and the phrases' starts in the bytes."""
    roll, start, count, trigger, grams = _phrases(data, offsets, length, gram)
    ok = sketch.maybe_repeated(trigger)
    start, count, trigger = start[ok], count[ok], trigger[ok]
    doc = np.searchsorted(offsets, start, "right") - 1
    rows = np.empty(len(start), PHRASE)
    rows["trigger"], rows["phrase"], rows["doc"], rows["at"], rows["n"] = trigger, roll.at(start, count + length - 1), ids[doc], start - offsets[doc], count
    for a in range(0, len(start), 1 << 14):
        rows["t"][a : a + (1 << 14)] = np.argmin(grams[start[a : a + (1 << 14), None] + np.arange(length - gram + 1)], 1)
    return data, rows, start


def _first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by trigger, phrase and place in the corpus; flags of the first of equal phrases in that order."""
    order = np.lexsort((rows["at"], rows["doc"], rows["phrase"], rows["trigger"]))
    r = rows[order]
    return order, np.append(True, (r["trigger"][1:] != r["trigger"][:-1]) | (r["phrase"][1:] != r["phrase"][:-1]))[: len(r)]


def _later_marks(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks of all but the first of equal phrases. A repeated row's phrase isn't later than itself."""
    r = rows[order]
    least = r[np.flatnonzero(first)][np.cumsum(first) - 1]
    later = r[(r["doc"] != least["doc"]) | (r["at"] != least["at"])]
    out = np.empty(len(later), MARK)
    for k in MARK.names:
        out[k] = later[k]
    return out


def _dictionary(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, length: int, with_bytes: bool) -> Iterator[pa.RecordBatch]:
    """One row per bucket of triggers: phrases (with their bytes); without bytes also marks of the later copies, in buckets -1 - b."""
    base = np.cumsum([0, *(len(d) for d, _, _ in held)])
    rows = np.concatenate([r for _, r, _ in held])
    start = np.concatenate([s + b for (_, _, s), b in zip(held, base[:-1], strict=True)])
    order, first = _first(rows)
    if not with_bytes:
        later = _later_marks(rows, order, first)
        yield from passed_on(pack(doc_bucket(later["doc"], n), later))
    rows, start = rows[order[first]], start[order[first]]
    bucket = owned_bucket(rows["trigger"], n)
    order = np.argsort(bucket, kind="stable")
    rows, start, bucket = rows[order], start[order], bucket[order]
    data = np.concatenate([d for d, _, _ in held]) if with_bytes else np.zeros(0, np.uint8)
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(rows))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        text = _gather(data, start[a:b], rows["n"][a:b].astype(np.int64) + length - 1).tobytes() if with_bytes else b""
        blob = struct.pack("<I", b - a) + rows[a:b].tobytes() + text
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "records"])


def _later(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of all but the first of equal phrases, and the triggers that have several phrases."""
    order, first = _first(rows)
    trigger = rows["trigger"][order[first]]
    return _later_marks(rows, order, first), np.unique(trigger[1:][trigger[1:] == trigger[:-1]])


def _repeated(rows: np.ndarray, text: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Marks of the repeated strings of different phrases with one trigger."""
    size = rows["n"].astype(np.int64) + length - 1
    place = np.cumsum(size) - size
    order, first = _first(rows)
    rows, place = rows[order[first]], place[order[first]]
    many = np.append(rows["trigger"][1:] == rows["trigger"][:-1], False)
    many |= np.append(False, many[:-1])
    rows, place = rows[many], place[many]
    new = np.append(True, rows["trigger"][1:] != rows["trigger"][:-1])[: len(rows)]
    starts, lo = np.append(np.flatnonzero(new), len(rows)), 0
    out = [np.empty(0, MARK)]
    while lo < len(starts) - 1:  # triggers with some ten thousand phrases together
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SORT_ROWS, "right")) - 1)
        out.append(_combined(rows[starts[lo] : starts[hi]], place[starts[lo] : starts[hi]], text, length, gram))
        lo = hi
    return np.concatenate(out)


def _suffix_array(owner: np.ndarray, text: np.ndarray, place: np.ndarray, step: int, limit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of `width` bytes from each place (backwards if step is -1), within each owner, and for each in that order how
    many bytes it has in common with the one before (-1 for an owner's first). Bytes past limit count as 0."""
    keyed = np.empty((len(place), 4 + width), np.uint8)
    keyed[:, :4] = owner.astype(">u4").view(np.uint8).reshape(-1, 4)
    for a in range(0, len(place), SLICE):
        at = place[a : a + SLICE, None] + step * np.arange(width)
        inside = np.arange(width) < limit[a : a + SLICE, None]
        keyed[a : a + SLICE, 4:] = np.where(inside, text[np.where(inside, at, 0)], 0)
    order = np.argsort(keyed.view(f"S{4 + width}").ravel(), kind="stable")
    common = np.full(len(order), -1)
    for a in range(1, len(order), SLICE):
        here, before = order[a : a + SLICE], order[a - 1 : a + SLICE - 1][: len(order) - a]
        differ = keyed[here, 4:] != keyed[before, 4:]
        same = np.where(differ.any(1), differ.argmax(1), width)
        common[a : a + SLICE] = np.where(owner[here] == owner[before], same, -1)
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number for each string: equal for those of one owner whose first `depth` bytes are equal."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _combined(rows: np.ndarray, place: np.ndarray, text: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Combines the suffix arrays of the dictionary and the parse of some triggers; marks of all but the first of equal strings."""
    order = np.lexsort((rows["at"], rows["doc"]))  # corpus order; each l has its strings in it
    rows, place = rows[order], place[order]
    owner = np.unique(rows["trigger"], return_inverse=True)[1]
    n, t = rows["n"].astype(np.int64), rows["t"].astype(np.int64)
    end = place + t + gram
    left = _suffix_array(owner, text, end - 1, -1, t + gram, length)
    right = _suffix_array(owner, text, end, 1, n + length - 1 - t - gram, length - gram)
    found = [np.empty(0, [("doc", "<i8"), ("at", "<u4")])]
    for l in range(gram, length + 1):  # noqa: E741
        rel = t + gram - l
        has = np.flatnonzero((rel >= 0) & (rel < n))
        if len(has) < 2:
            continue
        key = (_classes(*left, l)[has] << 32) | _classes(*right, length - l)[has]
        by = np.argsort(key, kind="stable")
        again = has[by[1:][key[by[1:]] == key[by[:-1]]]]
        part = np.empty(len(again), found[0].dtype)
        part["doc"], part["at"] = rows["doc"][again], rows["at"][again] + rel[again]
        found.append(part)
    return runs(np.concatenate(found))
