"""N-gram Jaccard join with set-relation skipping, and connected components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.repeats import Sketch, build_sketch, by_bucket, owned_bucket, pack, to_owners
from quillspark.llm.shared import partitions, saved
from quillspark.llm.text import NOT_SPACE, U, Rolling, Words, buffers, chunks, grouped_order, mix, numbers

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
COUNTER_BITS, COUNTER_BLOCK = 20, 14
DOC_BITS = 25
BLOCK = 2048
"""Members of a candidate group or cluster that one task compares; larger ones are split into blocks."""
POSTING = np.dtype([("token", "<u8"), ("doc", "<i8"), ("size", "<i4"), ("at", "<i4")])


class Sets:
    """The shingle sets of several documents: 58-bit shingle hashes, grouped by document and ascending in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int) -> None:
        w = Words(data, offsets, NOT_SPACE, True)
        roll = Rolling(w.hash)
        at = np.flatnonzero(w.windows(n))
        short = np.flatnonzero((w.counts > 0) & (w.counts < n))
        token = np.concatenate([roll.at(at, n), roll.at(w.first[short], w.counts[short])]) >> U(6)
        doc = np.concatenate([w.doc[at], short])
        order = grouped_order(doc, token, w.n_docs)
        token, doc = token[order], doc[order]
        new = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))[: len(token)]
        self.token, self.doc = token[new], doc[new]
        self.size = np.bincount(self.doc, minlength=w.n_docs)
        self.first = np.cumsum(self.size) - self.size
        one, two = mix(self.token), mix(self.token ^ U(0x5851F42D4C957F2D))
        up = np.append(U(0), np.cumsum(one)), np.append(U(0), np.cumsum(two))
        self.sign = np.stack([x[self.first + self.size] - x[self.first] for x in up], 1).view(np.int64)

    def bits(self, i: int) -> bytes:
        """Parities of the set's tokens in 2**k >= 2 * size cells, at least 64."""
        n = max(64, 1 << int(2 * self.size[i] - 1).bit_length()) if self.size[i] else 64
        cells = np.bincount((self.token[self.first[i] : self.first[i] + self.size[i]] & U(n - 1)).astype(np.int64), minlength=n) & 1
        return np.packbits(cells.astype(bool), bitorder="little").tobytes()


def needed(total: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The least common size of two linked sets with `total` elements together."""
    return -(-num * total // (num + den))


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = buffers(batch["text"])
    for lo, hi in chunks(offsets):
        o = offsets[lo : hi + 1]
        yield lo, hi, Sets(data[o[0] : o[-1]], o - o[0], n)


def _survey(source: DataFrame, n: int) -> DataFrame:
    """doc_id, signature, size and parity bits of every document; and in rows with a block, counts of shingles by hash."""
    blocks = 1 << (COUNTER_BITS - COUNTER_BLOCK)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for lo, hi, s in _sets(batch, n):
                counts += np.bincount((s.token >> U(58 - COUNTER_BITS)).astype(np.int64), minlength=len(counts))
                k = hi - lo
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), batch["doc_id"].slice(lo, k), pa.array(s.sign[:, 0]), pa.array(s.sign[:, 1]), pa.array(s.size.astype(np.int32)), pa.array([s.bits(i) for i in range(k)], pa.binary())], names=["block", "doc_id", "s1", "s2", "size", "bits"])
        parts = counts.reshape(blocks, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), *(pa.nulls(blocks, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "doc_id", "s1", "s2", "size", "bits"])

    return source.mapInArrow(scan, "block int, doc_id bigint, s1 bigint, s2 bigint, size int, bits binary")


def _levels(survey: DataFrame) -> np.ndarray:
    """Rarity level of each hash range: how often its shingles occur against the mean, in doublings, none below four times.

    A counter holds many rare shingles; only common ones stand out, and these have to come last in the order.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(blob, np.int64)
        for block, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "bits"])

    spark = survey.sparkSession
    tasks = min(1 << (COUNTER_BITS - COUNTER_BLOCK), partitions(spark))
    rows = survey.filter("block IS NOT NULL").select("block", "bits").repartitionById(tasks, F.col("block") % tasks).mapInArrow(add, "block int, bits binary").collect()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in rows:
        counts[r.block << COUNTER_BLOCK : (r.block + 1) << COUNTER_BLOCK] = np.frombuffer(r.bits, np.int64)
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / max(counts.mean(), 1))) - 1, 0, 31).astype(np.uint8)


def _postings(source: DataFrame, levels: Broadcast, n: int, num: int, den: int, buckets: int, asked: Broadcast | None = None) -> DataFrame:
    """Prefixes of the sets in order of rarity, dealt by token; of equal sets in a task only the first, and those that are asked for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # at most a signature for each row of the task
        for batch in batches:
            ids = numbers(batch["doc_id"])
            always = np.zeros(len(ids), bool) if asked is None else asked.value.maybe_repeated(mix(ids.view(U)))
            for lo, hi, s in _sets(batch, n):
                fresh = np.zeros(hi - lo, bool)
                for i, sign in enumerate(s.sign):
                    if s.size[i] and ((key := sign.tobytes()) not in seen or always[lo + i]):
                        seen.add(key)
                        fresh[i] = True
                key = (levels.value[(s.token >> U(58 - COUNTER_BITS)).astype(np.int64)].astype(U) << U(58)) | s.token
                order = grouped_order(s.doc, key, hi - lo)
                doc = s.doc[order]
                place = np.arange(len(doc)) - s.first[doc]
                size = s.size[doc]
                prefix = (place <= size - -(-num * size // den)) & fresh[doc]
                rows = np.empty(int(prefix.sum()), POSTING)
                rows["token"], rows["doc"], rows["size"], rows["at"] = s.token[order][prefix], ids[lo:hi][doc[prefix]], size[prefix], place[prefix]
                yield from pack(owned_bucket(mix(rows["token"]), buckets), rows)

    return to_owners(source.mapInArrow(scan, "bucket int, records binary"), buckets)


def _groups(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, doc): every list of a token names its least document as hub. Two documents that share a token meet at its hub."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_bucket(batches):
            pairs = _hub_pairs(np.concatenate([np.frombuffer(x, POSTING) for x in held]), num, den)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["hub", "doc"])

    found = postings.mapInArrow(lists, "hub bigint, doc bigint").distinct()
    sizes = found.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(sizes, "hub").select("hub", "doc", "n")


def _hub_pairs(r: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs (hub, doc) of a bucket's lists."""
    r = r[np.lexsort((r["size"], r["token"]))]
    same = r["token"][1:] == r["token"][:-1]
    a, b = r[:-1], r[1:]  # neighbours by size: who can't link with either, links with nobody in the list
    total = a["size"].astype(np.int64) + b["size"]
    near = same & (num * b["size"].astype(np.int64) <= den * a["size"].astype(np.int64))
    pair = same & ~np.append(False, same[:-1]) & ~np.append(same[1:], False)  # lists of two: their places decide, too
    near &= ~pair | (np.minimum(a["size"] - a["at"], b["size"] - b["at"]) >= needed(total, num, den))
    r = r[np.append(near, False) | np.append(False, near)]
    if not len(r):
        return np.zeros((0, 2), np.int64)
    new = np.append(True, r["token"][1:] != r["token"][:-1])
    hub = np.minimum.reduceat(r["doc"], np.flatnonzero(new))[np.cumsum(new) - 1]
    return np.unique(np.stack([hub, r["doc"]], 1), axis=0)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _may_link(s: int, x: int, w: int, t: int, y: int, v: int, num: int, den: int) -> bool:
    """Whether sets of sizes s <= t may link, from parities x in w cells and y in v >= w cells: they differ in as many elements at least."""
    while v > w:
        v >>= 1
        y = (y ^ (y >> v)) & ((1 << v) - 1)
    return (x ^ y).bit_count() <= s + t - 2 * needed(s + t, num, den)


def _survivors(groups: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (hub, doc) that may link, by a bound from sizes and parities, as far as they connect more of a group.

    Two sets differ in at least as many elements as their parities. Groups of more than BLOCK go on whole.
    """
    n = partitions(groups.sparkSession)
    rows = groups.filter(F.col("n") <= BLOCK).join(info.select(F.col("doc_id").alias("doc"), "size", "bits"), "doc").select("hub", "doc", "n", "size", "bits")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs, docs = [], []
        for group in _runs(batches, ["hub"]):
            items = sorted((s, d, int.from_bytes(b, "little"), 8 * len(b)) for s, d, b in zip(group["size"].to_pylist(), group["doc"].to_pylist(), group["bits"].to_pylist(), strict=True))
            forest = Forest(len(items))
            for i, (s, a, x, w) in enumerate(items):
                for j in range(i + 1, len(items)):
                    t, b, y, v = items[j]
                    if num * t > den * s:
                        break
                    if forest.root(i) == forest.root(j):
                        continue
                    if _may_link(s, x, w, t, y, v, num, den):
                        forest.join(i, j)
                        hubs.append(a)
                        docs.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(docs, pa.int64())], names=["hub", "doc"])

    small = rows.repartition(n, "hub").sortWithinPartitions("hub").mapInArrow(test, "hub bigint, doc bigint")
    return small.unionByName(groups.filter(F.col("n") > BLOCK).select("hub", "doc"))


def _clusters(survivors: DataFrame) -> DataFrame:
    """doc, hub and n: documents that candidates connect form a cluster, so each is compared in one place.

    The hub is the document with most pairs.
    """
    found = components(survivors.select(F.col("hub").alias("a"), F.col("doc").alias("b"))).withColumnRenamed("node", "doc")
    ends = survivors.select(F.explode(F.array("hub", "doc")).alias("hub"))
    often = ends.groupBy("hub").agg(F.count("*").alias("c")).join(found.withColumnRenamed("doc", "hub"), "hub")
    hubs = often.groupBy("component").agg(F.max(F.struct("c", "hub"))["hub"].alias("hub"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    return found.join(hubs, "component").join(sizes, "component").select("doc", "hub", "n")


def _doc_sketch(docs: DataFrame) -> Sketch:
    """Documents (column doc) as a bitmap of fixed size."""

    def ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(np.unique(batch["doc"].to_numpy(zero_copy_only=False)).view(U))

    return build_sketch(docs.select("doc"), ids, DOC_BITS, 1)


def _members(source: DataFrame, clusters: DataFrame) -> DataFrame:
    """hub, block, doc, n and text of the clusters' documents; only these are shuffled (by a bitmap of fixed size)."""
    spark = source.sparkSession
    wanted = spark.sparkContext.broadcast(_doc_sketch(clusters.select("doc")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = numbers(batch["doc_id"])
            yield batch.filter(pa.array(wanted.value.maybe_repeated(mix(doc.view(U)))))

    texts = source.mapInArrow(scan, "doc_id bigint, text string").withColumnRenamed("doc_id", "doc")
    last = (F.ceil(F.col("n") / BLOCK) - 1).cast("int")
    own = F.pmod(F.xxhash64("doc"), last + 1).cast("int")
    blocks = F.when(F.col("doc") == F.col("hub"), F.sequence(F.lit(0), last)).otherwise(F.array(own))  # the hub is in all
    return clusters.join(texts, "doc").withColumn("block", F.explode(blocks)).select("hub", "block", "doc", "n", "text")


def _read(group: pa.Table, n: int) -> tuple[list[int], list[np.ndarray]]:
    """Documents and sets of a group; a repeated doc_id counts once."""
    rows = list({d: i for i, d in reversed(list(enumerate(group["doc"].to_pylist())))}.values())[::-1]
    group = group.take(rows)
    sets: list[np.ndarray] = []
    for batch in group.select(["text"]).combine_chunks().to_batches():
        for _, _, s in _sets(batch, n):
            sets += [s.token[f : f + k].copy() for f, k in zip(s.first, s.size, strict=True)]
    return group["doc"].to_pylist(), sets


class Block:
    """The sets of a block as index lists: sets by size, and for each token the places of its sets."""

    def __init__(self, docs: list[int], sets: list[np.ndarray], num: int, den: int) -> None:
        order = sorted(range(len(docs)), key=lambda i: (len(sets[i]), docs[i]))
        self.docs, self.num, self.den = [docs[i] for i in order], num, den
        sets = [sets[i] for i in order]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.n = len(sets)
        self.vocabulary, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        self.first = np.append(0, np.cumsum(self.size))
        self.tokens = [ranks[a:b] for a, b in zip(self.first[:-1], self.first[1:], strict=True)]
        self.entries = np.sort(ranks.astype(np.int64) * self.n + np.repeat(np.arange(self.n), self.size))
        self.reference: tuple[np.ndarray, np.ndarray] | None = None

    def _count(self, tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of the tokens each set has; lists are skipped to the places lo to hi."""
        begin = np.searchsorted(self.entries, tokens * self.n + lo)
        size = np.searchsorted(self.entries, tokens * self.n + hi) - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.entries[at] % self.n, minlength=self.n)

    def links(self, tokens: np.ndarray, size: int) -> np.ndarray:
        """Places of the sets that link with a set of these tokens (of the vocabulary) and this size.

        If it differs little from the set asked for before, the counts of that are corrected by the difference;
        otherwise the lists are read, only in the places of sets of a fitting size.
        """
        lo = int(np.searchsorted(self.size, -(-self.num * size // self.den)))
        hi = int(np.searchsorted(self.size, self.den * size // self.num, "right"))
        if self.reference is not None:
            old, counts = self.reference
            gone, come = np.setdiff1d(old, tokens, True), np.setdiff1d(tokens, old, True)
            if 2 * (len(gone) + len(come)) < len(tokens):
                counts = counts - self._count(gone, 0, self.n) + self._count(come, 0, self.n)
                self.reference = tokens, counts
                return self._linked(counts, size, lo, hi)
        skip = 2 * (hi - lo) < self.n
        counts = self._count(tokens, lo, hi) if skip else self._count(tokens, 0, self.n)
        self.reference = None if skip else (tokens, counts)
        return self._linked(counts, size, lo, hi)

    def _linked(self, counts: np.ndarray, size: int, lo: int, hi: int) -> np.ndarray:
        fits = self.den * counts[lo:hi] >= self.num * (size + self.size[lo:hi] - counts[lo:hi])
        return lo + np.flatnonzero(fits)


class Forest:
    """Union-find over places."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.count = [1] * n

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        if self.count[i] < self.count[j]:
            i, j = j, i
        self.parent[j] = i
        self.count[i] += self.count[j]
        return True


def _connect(block: Block, start: int) -> tuple[list[tuple[int, int]], Forest]:
    """A spanning forest of the block's links.

    The start's links come first. Then only sets outside the largest tree are asked for: links inside a tree add
    nothing, and every link between trees has an end that is asked.
    """
    forest, edges, asked = Forest(block.n), [], set()

    def ask(i: int) -> None:
        asked.add(i)
        for j in block.links(block.tokens[i], int(block.size[i])).tolist():
            if forest.join(i, j):
                edges.append((block.docs[i], block.docs[j]))

    ask(start)
    while True:
        roots = [forest.root(i) for i in range(block.n)]
        largest = max(set(roots), key=lambda r: (forest.count[r], -r))
        rest = [i for i in range(block.n) if roots[i] != largest and i not in asked]
        if not rest:
            return edges, forest
        for i in rest:
            if forest.root(i) != forest.root(largest):
                ask(i)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["kind", "hub", "a", "b"])


EDGES = "kind int, hub bigint, a bigint, b bigint"


def _links(source: DataFrame, clusters: DataFrame, info: DataFrame, levels: Broadcast, shingle: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect what the links of all clusters connect."""
    n = 2 * partitions(source.sparkSession)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: edges; kind 1: members of a split cluster that their block doesn't connect with the hub."""
        out: list[tuple] = []
        for group in _runs(batches, ["hub", "block"]):
            hub, total = group["hub"][0].as_py(), group["n"][0].as_py()
            docs, sets = _read(group, shingle)
            block = Block(docs, sets, num, den)
            start = block.docs.index(hub)
            edges, forest = _connect(block, start)
            out.extend((0, hub, a, b) for a, b in edges)
            if total > BLOCK:
                out.extend((1, hub, d, None) for i, d in enumerate(block.docs) if forest.root(i) != forest.root(start))
            if len(out) > 10_000:
                yield _batch_of(out)
                out = []
        yield _batch_of(out)

    members = _members(source, clusters)
    first = saved(members.repartition(n, "hub", "block").sortWithinPartitions("hub", "block").mapInArrow(within, EDGES), "links")
    edges = first.filter("kind = 0").select("a", "b")
    loose = saved(first.filter("kind = 1").select(F.col("a").alias("doc")).distinct(), "loose")
    return edges if loose.isEmpty() else edges.unionByName(_loose_links(source, loose, info, levels, shingle, num, den))


def _loose_links(source: DataFrame, loose: DataFrame, info: DataFrame, levels: Broadcast, shingle: int, num: int, den: int) -> DataFrame:
    """All links of the loose documents, through the lists of their prefixes: what passes the filters there is compared with them, and
    nothing else. So the work is that of their candidates, not of pairs of blocks."""
    spark = source.sparkSession
    n = partitions(spark)
    asked = spark.sparkContext.broadcast(_doc_sketch(loose))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in by_bucket(batches):
            for part in _asked_pairs(np.concatenate([np.frombuffer(x, POSTING) for x in found]), asked.value, num, den):
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["hub", "doc"])

    met = _postings(source, levels, shingle, num, den, n, asked).mapInArrow(pairs, "hub bigint, doc bigint").distinct()
    side = lambda d, s: info.select(F.col("doc_id").alias(d), F.col("size").alias(f"{s}_size"), F.col("bits").alias(f"{s}_bits")).dropDuplicates([d])
    both = met.join(side("hub", "x"), "hub").join(side("doc", "y"), "doc").select("hub", "doc", "x_size", "x_bits", "y_size", "y_bits")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s, x, t, y in zip(*(batch[c].to_pylist() for c in ("x_size", "x_bits", "y_size", "y_bits")), strict=True):
                (s, x), (t, y) = sorted(((s, x), (t, y)), key=lambda z: (z[0], len(z[1])))
                good.append(_may_link(s, int.from_bytes(x, "little"), 8 * len(x), t, int.from_bytes(y, "little"), 8 * len(y), num, den))
            yield batch.select(["hub", "doc"]).filter(pa.array(good, pa.bool_()))

    left = saved(both.mapInArrow(test, "hub bigint, doc bigint"), "loose-pairs")
    sizes = left.groupBy("hub").agg((F.count("*") + 1).alias("n"))
    stars = left.join(sizes, "hub").select("doc", "hub", "n").unionByName(sizes.select(F.col("hub").alias("doc"), "hub", "n"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _runs(batches, ["hub", "block"]):
            hub = group["hub"][0].as_py()
            block = Block(*_read(group, shingle), num, den)
            i = block.docs.index(hub)
            out.extend((0, hub, hub, block.docs[j]) for j in block.links(block.tokens[i], int(block.size[i])).tolist() if j != i)
            if len(out) > 10_000:
                yield _batch_of(out)
                out = []
        yield _batch_of(out)

    members = _members(source, stars).repartition(2 * n, "hub", "block").sortWithinPartitions("hub", "block")
    return saved(members.mapInArrow(ask, EDGES).select("a", "b"), "loose-links")


def _asked_pairs(r: np.ndarray, asked: Sketch, num: int, den: int) -> Iterator[np.ndarray]:
    """Pairs (asked document, other) of a bucket's lists that pass the length and positional filters."""
    r = r[np.lexsort((r["size"], r["token"]))]
    size, at = r["size"].astype(np.int64), r["at"].astype(np.int64)
    key = (np.cumsum(np.append(False, r["token"][1:] != r["token"][:-1])) << 32) | size
    want = np.flatnonzero(asked.maybe_repeated(mix(r["doc"].astype(np.int64).view(U))))
    base = (key[want] >> 32) << 32
    lo = np.searchsorted(key, base | -(-num * size[want] // den))
    count = np.searchsorted(key, base | np.minimum(den * size[want] // num, (1 << 32) - 1), "right") - lo
    total, a = np.append(0, np.cumsum(count)), 0
    while a < len(want):
        b = max(a + 1, int(np.searchsorted(total, total[a] + 2_000_000, "right")) - 1)
        i = np.repeat(want[a:b], count[a:b])
        j = np.arange(len(i)) - np.repeat(total[a:b] - total[a], count[a:b]) + np.repeat(lo[a:b], count[a:b])
        ok = (r["doc"][i] != r["doc"][j]) & (np.minimum(size[i] - at[i], size[j] - at[j]) >= needed(size[i] + size[j], num, den))
        yield np.unique(np.stack([r["doc"][i[ok]], r["doc"][j[ok]]], 1), axis=0)
        a = b


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of an undirected graph given as rows (a, b).

    Every round a node takes the least label around it and then the label of its label, so paths shorten by halves.
    A node with very many edges meets only sums per task and joins whose other side has it once.
    """
    both = saved(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        least = saved(least, "labels")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = saved(least.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if new.filter("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def link(documents: DataFrame, *, shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the least doc_id that links lead to, its own included.

    A set holds the distinct shingles of `shingle` words (`[^\\x20\\x09-\\x0D]+` after lower-casing A-Z) of a whole text; of
    fewer words all are one shingle. Sets link when their Jaccard similarity is numerator / denominator or more.
    Null and empty texts have no shingles and link with nothing, nor do rows with a null doc_id, whose component_id is null. Rows
    that repeat a doc_id are one node; they should have the same text. Other columns are ignored.

    - Equal sets (128-bit signature) link by one star each, whatever their number; a task indexes one of them.
    - Sets are ordered by rarity (merged counters), their prefixes go to the owners of their tokens. Linked sets share
      a prefix token; the least document of a token's list is its hub, and documents that meet in a list meet in its
      hub's group. A group is as long as its lists: pairs are never written out.
    - A bound from parities of the sets leaves only documents that may link with another of the group. What candidates
      connect is a cluster; only its texts move, each to one place. Clusters are compared in blocks of index lists by
      size: lists are skipped to fitting sizes, and counts of a set are derived from those of the similar set before it.
      Only sets outside the largest tree of a block are asked for, as a link inside a tree adds nothing to components;
      every link between different trees is found.
    - Clusters of more than BLOCK members are dealt to several tasks by blocks, the hub to each. For members that their block
      doesn't connect with the hub all links are found through the lists of their prefixes; the rest is connected through the hub.
    """
    spark = documents.sparkSession
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    survey = saved(_survey(source, shingle), "sets")
    every = survey.filter("block IS NULL")
    source, info = source.filter("doc_id IS NOT NULL"), every.filter("doc_id IS NOT NULL")
    levels = spark.sparkContext.broadcast(_levels(survey))
    groups = saved(_groups(_postings(source, levels, shingle, numerator, denominator, partitions(spark)), numerator, denominator), "groups")
    survivors = saved(_survivors(groups, info, numerator, denominator), "survivors")
    clusters = saved(_clusters(survivors), "clusters")
    equal = info.filter("size > 0").groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    stars = info.join(equal, ["s1", "s2", "size"]).select(F.col("doc_id").alias("a"), "b")
    found = components(_links(source, clusters, info, levels, shingle, numerator, denominator).unionByName(stars))
    rows = every.select("doc_id", F.col("size").cast("bigint").alias("n_shingles")).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
