"""Vectorised words, rolling hashes and window minima over the buffers of Arrow string columns.

Everything works on a whole Arrow batch at once: the column's bytes are one uint8 array, documents are
ranges of it, words are found with a table of 256 flags. Hashes are 64-bit polynomial sums (odd base,
so they can be rolled and divided) finished by a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
"""Bytes of [^\\x20\\x09-\\x0D]+ words."""
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
"""Bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ words, after lower-casing A-Z."""
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix finisher)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


SYMBOL = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n. Those of a chunk are kept, not those of a longer text."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        up, down = np.full(size, BASE, U), np.full(size, pow(BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        if size > 4 * CHUNK_BYTES:
            return up[:n], down[:n]
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def scratch(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays to work in until the next call; those of a chunk's size are kept."""
    if n > 4 * CHUNK_BYTES:
        return np.empty(n, U), np.empty(n, U)
    if len(_powers.get("one", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _powers.update(one=np.empty(size, U), two=np.empty(size, U))
    return _powers["one"][:n], _powers["two"][:n]


class Rolling:
    """Hashes of any stretch of a symbol sequence, by differences of prefix sums."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def all(self, n: int) -> np.ndarray:
        """The hash of every n consecutive symbols."""
        if len(self.sums) <= n:
            return np.zeros(0, U)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n] + U(n))

    def at(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The hash of the n symbols from each start."""
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start] + np.asarray(n).astype(U))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()), b"" if "binary" in str(column.type) else "")
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def numbers(column: pa.Array) -> np.ndarray:
    """A bigint column as int64, exactly; nulls are 0 (to_numpy would turn a column with nulls into floats)."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document is a range by itself."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of several documents: byte ranges, document numbers and, unless turned off, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool, hashes: bool = True) -> None:
        if lower:
            data = np.take(LOWER, data)
        word = np.take(table, data)
        inner = offsets[:-1][offsets[:-1] < len(data)]
        before = np.empty_like(word)
        if len(word):
            before[0], before[1:] = False, word[:-1]
            before[inner] = False
        self.data, self.starts = data, np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        if len(word):
            after[-1], after[:-1] = False, word[1:]
            after[inner[inner > 0] - 1] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.n_docs = len(offsets) - 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        if not hashes:
            return
        size = self.ends - self.starts
        if not len(size):
            self.hash = np.zeros(0, U)
            return
        up, down = powers(len(data) + 1)
        sums, product = scratch(len(data) + 1)
        np.take(SYMBOL, data, out=product[1:], mode="clip")
        np.multiply(product[1:], up[: len(data)], out=product[1:])
        sums[0] = 0
        np.cumsum(product[1:], out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] ^ size.astype(U))

    def windows(self, n: int) -> np.ndarray:
        """Flags of the word positions at which n words of one document start; as long as Rolling.all(n)."""
        if len(self.doc) < n:
            return np.zeros(0, bool)
        return self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]


def grouped_order(group: np.ndarray, key: np.ndarray, n_groups: int) -> np.ndarray:
    """The order by group, then key. Few groups are dealt out by a radix sort, which numpy has for 16 bits."""
    order = np.argsort(key)
    return order[np.argsort(group[order].astype(np.uint16 if n_groups <= 1 << 16 else np.int64), kind="stable")]


def cover(starts: np.ndarray, n: np.ndarray | int, size: int) -> np.ndarray:
    """Flags of the positions in any [start, start + n)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def find(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in the sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)
