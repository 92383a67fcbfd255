"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import back, carried
from quillspark.llm.text import ALNUM, CHUNK_BYTES, Rolling, Words, buffers, chunks, cover, find, window_min

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


class ItemIndex:
    """Fingerprints and windows of a block of benchmark items, as sorted arrays."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram = window, gram
        self.names = [str(i) for i, _ in items]
        prints, found = [np.zeros(0, np.uint64)], {}
        for no, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = Words(raw, np.array([0, len(raw)]), ALNUM, True)
            n = min(window, len(w.hash))
            if n:
                r = Rolling(w.hash)
                if n == window:
                    prints.append(window_min(r.all(gram), window - gram + 1))
                found.setdefault(n, []).append((r.all(n), np.full(len(w.hash) - n + 1, no)))
        self.prints = np.unique(np.concatenate(prints))
        self.tables = {}
        for n, parts in found.items():
            hashes, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            uniq, begin = np.unique(hashes, return_index=True)
            self.tables[n] = uniq, np.append(begin, len(hashes)), owner

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flags of the hit words, and pairs of document and item numbers."""
        hit, docs, items = np.zeros(len(w.hash), bool), [], []
        r = Rolling(w.hash)
        for n, (uniq, begin, owner) in self.tables.items():
            at = np.flatnonzero(w.windows(n))
            if n == self.window:  # windows that share a fingerprint with an item, then extended to all their words
                least = window_min(r.all(self.gram), n - self.gram + 1)
                at = at[find(least[at], self.prints) >= 0]
            place = find(r.at(at, n), uniq)
            at, place = at[place >= 0], place[place >= 0]
            if len(at):
                hit |= cover(at, n, len(hit))
                sizes = begin[place + 1] - begin[place]
                within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                docs.append(np.repeat(w.doc[at], sizes))
                items.append(owner[np.repeat(begin[place], sizes) + within])
        return hit, np.concatenate([np.zeros(0, int), *docs]), np.concatenate([np.zeros(0, int), *items])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in lists of at most BLOCK_BYTES of text (or a single longer item)."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(row.text or "")
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    yield block


def winnow(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, least_share: int = 20, keep: list[str] | None = None) -> DataFrame:
    """One row per document: how much of it occurs in benchmark items.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Each window of `window` words keeps
    its least `gram`-gram hash; windows of documents whose fingerprint is an item's are extended to all their
    words and kept where these are an item's window. Any shared stretch of `window` words has a common
    fingerprint, so none is missed. Items of fewer words are one window each.

    The items are the stated query set: they go out in blocks of at most BLOCK_BYTES, each against all rows.
    Documents stay whole in one row and nothing is shuffled.

    Nulls and empty texts have no words: n_words 0, not contaminated. Repeated rows give repeated results.
    An empty benchmark hits nothing. Extra columns are ignored, or carried along when named in `keep`; one called like a result
    comes back as `kept_` and its name. A null doc_id is a document of its own.
    """
    spark = documents.sparkSession
    renamed, kept = carried(documents, keep)
    source = renamed.select(F.col("doc_id").cast("bigint").alias("doc_id"), *dict.fromkeys(["text", *kept]))
    shares = [spark.sparkContext.broadcast(ItemIndex(block, window, gram)) for block in _blocks(benchmark)]
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in (source.schema[k] for k in kept))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in _chunked(batch):
                hit, docs, items, names = np.zeros(len(w.hash), bool), [], [], []
                for share in shares:
                    h, d, i = share.value.hits(w)
                    hit |= h
                    docs.append(d)
                    items.append(i + len(names))
                    names.extend(share.value.names)
                    if len(shares) > 1:
                        del share._value  # one block in memory at a time; .value reads it again
                result = _result(part["doc_id"], w, hit, np.concatenate(docs), np.concatenate(items), names, least_share)
                yield pa.RecordBatch.from_arrays([*result, *(part[k] for k in kept)], names=[*_NAMES, *kept])

    return back(source.mapInArrow(scan, SCHEMA + extra), keep)


_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    data, offsets = buffers(batch["text"])
    for lo, hi in chunks(offsets, CHUNK_BYTES):
        o = offsets[lo : hi + 1]
        yield batch.slice(lo, hi - lo), Words(data[o[0] : o[-1]], o - o[0], ALNUM, True)


def _digest(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _result(ids: pa.Array, w: Words, hit: np.ndarray, docs: np.ndarray, items: np.ndarray, names: list[str], least_share: int) -> list[pa.Array]:
    n_hit = np.bincount(w.doc[hit], minlength=w.n_docs)
    owned: dict[int, set[str]] = {}
    for d, i in np.unique(np.stack([docs, items]), axis=1).T.tolist() if len(docs) else []:
        owned.setdefault(d, set()).add(names[i])
    none = _digest(set())
    n_items = np.array([len(owned.get(d, ())) for d in range(w.n_docs)], np.int64)
    digests = [_digest(owned[d]) if d in owned else none for d in range(w.n_docs)]
    return [ids, pa.array(w.counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(n_items), pa.array(digests, pa.string()), pa.array((n_hit > 0) & (least_share * n_hit >= w.counts))]
