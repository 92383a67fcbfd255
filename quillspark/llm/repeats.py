"""Shared parts of the two repeated-passage operators: a mergeable sketch and packed exchanges."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Bitmap, partitions, saved
from quillspark.llm.text import U, buffers, chunks, cover, mix, numbers

BLOCK_BITS = 20
"""Cells in a block of the sketch, as a power of two: 1,048,576 bits are 128 KiB."""


class Sketch:
    """A count-min sketch of two rows whose counters saturate at two: what is left of it is a bit per cell, "two or more".

    An estimate of one means that the value occurs at most once; none that occurs twice is missed.
    """

    def __init__(self, bits: int, repeated: np.ndarray) -> None:
        self.bits, self.repeated = bits, repeated

    @staticmethod
    def cells(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The two cells of each value; the second row lies behind the first. Mixed first, as minima of hashes are small."""
        values = mix(values)
        return (values >> U(64 - bits)).astype(np.uint32), (((values * U(0xC2B2AE3D27D4EB4F)) >> U(64 - bits)) | U(1 << bits)).astype(np.uint32)

    def maybe_repeated(self, values: np.ndarray) -> np.ndarray:
        a, b = self.cells(values, self.bits)
        bit = lambda c: (self.repeated[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1
        return (bit(a) & bit(b)).astype(bool)


def text_values(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """of(bytes, offsets) over the texts of a batch, in chunks."""

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offsets = buffers(batch["text"])
        for lo, hi in chunks(offsets):
            o = offsets[lo : hi + 1]
            yield of(data[o[0] : o[-1]], o - o[0])

    return values


def build_sketch(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int = 2) -> Sketch:
    """Merges the partitions' sketches of the values of batches, one block of cells in a task at a time.

    With least 1 the bits say "one or more".

    A partition sends each block as the cells it has met (four bytes each) with those it met twice first.
    What reaches the driver is 2**(bits + 1) bits, whatever the input.
    """
    spark = rows.sparkSession
    n_blocks = 1 << (bits + 1 - BLOCK_BITS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            cells, count = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(cells >> np.uint32(BLOCK_BITS), np.arange(n_blocks + 1))
            low, twice = cells & np.uint32((1 << BLOCK_BITS) - 1), count >= least
            rows = [(b, low[cut[b] : cut[b + 1]], twice[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut))]
            blobs = [struct.pack("<I", int(t.sum())) + c[t].tobytes() + c[~t].tobytes() for _, c, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "cells"])

        for batch in batches:
            for found in values(batch):
                held.extend(Sketch.cells(found, bits))
                size += 2 * len(found)
                if size > 8_000_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["cells"], strict=True):
                once, more = state.setdefault(block, (np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)))
                raw = blob.as_buffer()
                n = struct.unpack("<I", raw[:4])[0]
                cells = np.frombuffer(raw, np.uint32, offset=4)
                more[cells[:n]] = True
                more |= once & cover_bits(cells)
                once[cells] = True
        for block, (_, more) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())], names=["block", "cells"])

    def cover_bits(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BLOCK_BITS, bool)
        out[cells] = True
        return out

    tasks = min(n_blocks, partitions(spark))
    merged = rows.mapInArrow(local, "block int, cells binary").repartitionById(tasks, F.col("block") % tasks).mapInArrow(merge, "block int, cells binary").collect()
    table = np.zeros((n_blocks, 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in merged:
        table[row.block] = np.frombuffer(row.cells, np.uint8)
    return Sketch(bits, table.ravel())


def rarity_counts(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How many values fall in each of 2**bits ranges, over all rows: tasks' counters are added up block by block."""
    spark, block_bits = rows.sparkSession, 14
    n_blocks = 1 << (bits - block_bits)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for found in values(batch):
                counts += np.bincount((found >> U(64 - bits)).astype(np.int64), minlength=len(counts))
        parts = counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64).reshape(n_blocks, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_blocks, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                part = np.frombuffer(blob, np.uint32 if len(blob) == 4 << block_bits else np.uint64).astype(np.int64)
                total[block] = total.get(block, 0) + part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    tasks = min(n_blocks, partitions(spark))
    found = rows.mapInArrow(local, "block int, counts binary").repartitionById(tasks, F.col("block") % tasks).mapInArrow(add, "block int, counts binary").collect()
    out = np.zeros((n_blocks, 1 << block_bits), np.int64)
    for r in found:
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


RECORDS = "bucket int, records binary"
MARK = np.dtype([("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
"""n windows from position `at` of a document are to go."""
SUBS = 4
"""An owner gets its keys in so many buckets, one after another, and holds one at a time. Tasks send a row per bucket, so it is small."""


def runs(rows: np.ndarray) -> np.ndarray:
    """Marks of the window starts in rows (doc, at), neighbours joined."""
    rows = rows[np.lexsort((rows["at"], rows["doc"]))]
    at = rows["at"].astype(np.int64)
    new = np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (at[1:] > at[:-1] + 1))[: len(rows)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1 if len(first) else first
    out = np.empty(len(first), MARK)
    out["doc"], out["at"], out["n"] = rows["doc"][first], at[first], at[last] - at[first] + 1
    return out


def marked(marks: np.ndarray, window: int, size: int) -> np.ndarray:
    """Flags of the positions that the marked windows cover."""
    at = np.minimum(marks["at"].astype(np.int64), size)
    return cover(at, np.minimum(marks["n"].astype(np.int64) + window - 1, size - at), size)


def pack(bucket: np.ndarray, records: np.ndarray, least: int = 1) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that has records (a structured array)."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    if len(edges):
        blobs = [x.tobytes() for x in np.split(records, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "records"])


def owned_bucket(key: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a key (64 bits, mixed): owner * SUBS + one of the owner's buckets."""
    return ((key % U(n)) * U(SUBS) + (key // U(n)) % U(SUBS)).astype(np.int32)


def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks that are on their way to a document's bucket b, as bucket -1 - b: they pass through a grouping step unread."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(-1 - batch["bucket"].to_numpy(), pa.int32()), batch["records"]], names=["bucket", "records"])


def to_owners(rows: DataFrame, n: int) -> DataFrame:
    """Deals packed rows to the task of their bucket, sorted by bucket; -1 - b goes to task b."""
    owner = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.expr(f"cast(bucket div {SUBS} as int)"))
    return rows.repartitionById(n, owner).sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | list[pa.Buffer]]:
    """From an owner's sorted rows: batches of marks that pass through, under their own bucket, and the records of each bucket in turn."""
    held: list[pa.Buffer] = []
    last = -1
    for batch in batches:
        bucket = batch["bucket"].to_numpy()
        n = int(np.searchsorted(bucket, 0))
        if n:
            yield from passed_on([batch.slice(0, n)])
        for b, x in zip(bucket[n:].tolist(), batch["records"].slice(n), strict=True):
            if b != last and held:
                yield held
                held = []
            last = b
            held.append(pa.py_buffer(x.as_buffer().to_pybytes()))  # the batch's memory isn't kept
    if held:
        yield held


def unpack(batch: pa.RecordBatch, dtype: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in batch["records"]]


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(U) + U(0x9E37)) % U(n)).astype(np.int32)


def with_marks(documents: DataFrame, marks: DataFrame, n_buckets: int, finish: Callable[[pa.RecordBatch, dict[int, np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the marks of documents to their texts; finish(batch of doc_id and text, marks by doc_id) gives the result's batches.

    Only texts that have marks move (by a bitmap of bounded size): they and their marks are dealt by a hash of doc_id, marks come first
    in a task. All other texts are finished where they are. A null doc_id has no marks.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(x["doc"]) for x in unpack(batch, MARK)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["doc_id"])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"]
            yield pa.RecordBatch.from_arrays([pa.array(doc_bucket(numbers(ids), n_buckets)), ids, batch["text"], pa.nulls(len(ids), pa.binary())], names=["bucket", "doc_id", "text", "records"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        by: dict[int, np.ndarray] | None = None
        for batch in batches:
            is_mark = batch["records"].is_valid().to_numpy(zero_copy_only=False)
            n = int(is_mark.sum())  # marks are sorted first
            if n:
                assert by is None, "marks come before texts"
                held.extend(x.copy() for x in unpack(batch.slice(0, n), MARK))
            if n < len(is_mark):
                if by is None:
                    by = _by_doc(held)
                    held = []
                yield from finish(batch.slice(n), by)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from finish(batch, {})

    source = documents.select("doc_id", "text")
    marked_ids = saved(marks.mapInArrow(ids, "doc_id bigint").distinct(), "marked")
    bitmap = Bitmap(marked_ids, marked_ids.count())
    left = source.filter(bitmap.may_have("doc_id")).mapInArrow(bucketed, "bucket int, doc_id bigint, text string, records binary")
    right = marks.select("bucket", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "records")
    dealt = left.unionByName(right).repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions(F.col("records").isNull())
    return source.filter(~bitmap.may_have("doc_id")).mapInArrow(alone, schema).unionByName(dealt.mapInArrow(joined, schema))


def _by_doc(held: list[np.ndarray]) -> dict[int, np.ndarray]:
    if not held:
        return {}
    all_ = np.concatenate(held)
    all_ = all_[np.argsort(all_["doc"], kind="stable")]
    edges = np.flatnonzero(np.diff(all_["doc"], prepend=all_["doc"][0] - 1))
    return {int(x["doc"][0]): x for x in np.split(all_, edges[1:])}
