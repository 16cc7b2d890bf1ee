"""N-gram Jaccard self-join with a prefix tree.

Every document becomes the ordered set of the 64-bit hashes of its word n-grams.
In any global order two documents with Jaccard similarity of at
least ``num/den`` share ``k`` n-grams or more among the first
``n - ceil(n * num / den) + k`` of each, for every ``k``; and, from a similarity of
0.7 on, two neighbouring n-grams among the first ``2 + (2 n - m) / 3`` or so, where ``m`` is the
size of the smallest set that may link. The steps:

1. one pass over the whole texts makes a fingerprint of each set, the two least n-grams of each
   quarter of the hashes, and counts n-grams, those
   of the first 60 % of each set in the order of the hash. Frequent n-grams, a bounded number, go to the end of the
   global order. Documents that have two least n-grams in common stand under the first of them in the next
   pass, so that most near copies don't meet again for each of their n-grams.
2. a second pass gives the neighbours in each prefix. Documents that have two neighbouring n-grams
   in common are connected; one n-gram that two texts share by chance, or
   a passage, seldom has the same neighbour in both. The connected groups are the candidates. No
   pair is emitted, each document gets an edge to the first one that has the same neighbours.
3. the sets of a block of candidates are stored in a trie in the global order.
   A traversal carries the partial overlaps of all sets with the path and drops
   those that the remaining lengths can't lift over the threshold, and subtrees
   in which nothing is left or everything is connected already. Small groups fill a block together;
   a large group is cut into blocks, each of which also gets a few pivots of the group, so that
   one copy of each set connects what is alike.
4. what large groups still hold apart (documents of different components in different blocks that have
   neighbours in common) is compared by pairs of blocks, in which the
   largest component of a group is never compared with itself.

What passes 1 and 2 shuffle is packed: a row holds 32-bit codes of many documents for one of as many
buckets of the hash as keep a bucket to about ``BUCKET`` codes; equal codes of a batch are sent once.

Equal sets are classes: they are one member of a trie and never make pairs. Only the links that
components need are looked for, so no number of links is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, broadcast_if_small, connected_components, cut
from .shingles import mix, shingle_sets

NUM, DEN = 80, 100
BLOCK_DOCS, BLOCK_SHINGLES = 512, 500_000
#: Pivots of a large group, about.
PIVOTS = 32
#: Codes of a bucket, about; documents and codes that are packed together.
BUCKET, BATCH_DOCS, BATCH_CODES = 2_000_000, 4096, 400_000
#: Texts that are Python objects at a time.
AT_ONCE = 512
#: Ids of candidates that may be broadcast: 8 bytes each.
BROADCAST_IDS = 1_000_000

#: N-grams met this often are frequent; the number is doubled until no more than the second are.
FREQUENT, MOST_FREQUENT = 10, 1 << 18
#: Share of a set, in hundredths, whose n-grams are counted.
COUNTED = 60
_EMPTY = np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(np.int64)))


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _packs(batches: Iterator[pa.RecordBatch], width: int, of) -> Iterator[tuple[np.ndarray, list[np.ndarray], list]]:
    """Ids, codes and what else ``of`` gives of documents, for as many as are packed together."""
    held, codes, more, size = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for i, s in enumerate(shingle_sets(_texts(part.column(1)), width)):
                c, x = of(s)
                held.append(ids[i])
                codes.append(c)
                more.append(x)
                size += len(c)
                if size > BATCH_CODES or len(codes) == BATCH_DOCS:
                    yield np.array(held, np.int64), codes, more
                    held, codes, more, size = [], [], [], 0
    if codes:
        yield np.array(held, np.int64), codes, more


def _coded(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit code of 64-bit hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), h.astype(np.uint32)


def _keyed(h: np.ndarray, buckets: int) -> np.ndarray:
    bucket, code = _coded(h, buckets)
    return (bucket.astype(np.uint64) << np.uint64(32)) | code


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges of a sorted array of buckets."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else _EMPTY


def _least(n: int, num: int, den: int) -> int:
    """The fewest n-grams that a set shares with one it links with."""
    return -(-n * num // den)


_SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, least array<long>, bucket int, once binary, often binary, times binary"


def _sketch(width: int, buckets: int):
    """A row a document with the fingerprint of its set, and rows of packed codes to count."""

    def of(s: np.ndarray) -> tuple[np.ndarray, tuple]:
        quarter = np.searchsorted(s, np.arange(5, dtype=np.float64) * 2.0**62).tolist()
        at = np.array([a for a, b in zip(quarter[:-1], quarter[1:], strict=True) if b - a > 1], np.int64)
        least = mix(s[at] * np.uint64(0x9FB21C651E98DF25) + s[at + 1]) if len(at) else _EMPTY
        return s[: -(-len(s) * COUNTED // 100)].copy(), (len(s), s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s * np.uint64(0xC2B2AE3D27D4EB4F) ^ (s >> np.uint64(29)), initial=np.uint64(0)), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SKETCH.split(", ")]
        for ids, codes, more in _packs(batches, width, of):
            n, f1, f2 = (np.array([x[i] for x in more], np.uint64).view(np.int64) for i in range(3))
            nothing = [pa.nulls(len(ids), k) for k in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(f1), pa.array(f2), _lists([x[3] for x in more]), *nothing], names=names)
            key, times = np.unique(_keyed(_flat(codes), buckets), return_counts=True)
            rows = []
            for bucket, at in _by_bucket((key >> np.uint64(32)).astype(np.int64)):
                code, many = key[at].astype(np.uint32), times[at] > 1
                rows.append((bucket, code[~many].tobytes(), code[many].tobytes(), times[at][many].astype(np.uint32).tobytes()))
            nothing = [pa.nulls(len(rows), k) for k in (*[pa.int64()] * 4, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*nothing, *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary())))], names=names)

    return run


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def _counts(key: tuple, table: pa.Table) -> pa.Table:
    """``g, n`` of the frequent codes of a bucket."""
    once, often = np.unique(_joined(table["once"], np.uint32), return_counts=True), _joined(table["often"], np.uint32)
    code, at = np.unique(np.concatenate((once[0], often)), return_inverse=True)
    n = np.bincount(at, np.concatenate((once[1], _joined(table["times"], np.uint32))), len(code)).astype(np.int64)
    some = n >= FREQUENT
    return pa.table({"g": pa.array((np.int64(key[0].as_py()) << 32) | code[some].astype(np.int64)), "n": pa.array(n[some])})


_PAIRS = "bucket int, ids binary, sizes binary, codes binary, near binary"


def _pairs(width: int, num: int, den: int, frequent, buckets: int):
    """Rows of packed neighbours: the documents of a bucket, how many each has there, and their codes.

    Of those that several documents of a batch have, the first one's are sent; ``near`` are the edges to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (ids, codes, _) in enumerate(_packs(batches, width, lambda s: (neighbours(s, frequent.value, num, den), None))):
            key, owner = _keyed(_flat(codes), buckets), np.repeat(np.arange(len(ids)), [len(c) for c in codes])
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            first = np.repeat(owner[begin], np.diff(begin, append=len(key)))
            edge = np.unique(owner[first != owner] * max(1, len(ids)) + first[first != owner])
            near = np.stack((ids[edge // max(1, len(ids))], ids[edge % max(1, len(ids))]), axis=1)
            near = np.unique(near[near[:, 0] != near[:, 1]], axis=0)
            key, owner = key[begin], owner[begin]
            bucket = (key >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket * max(1, len(ids)) + owner, kind="stable")
            key, owner, bucket = key[order], owner[order], bucket[order]
            rows = []
            for b, at in _by_bucket(bucket):
                own = owner[at]
                begin = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
                rows.append((b, ids[own[begin]].tobytes(), np.diff(begin, append=len(own)).astype(np.uint32).tobytes(), key[at].astype(np.uint32).tobytes(), b""))
            if len(near):
                rows.append((turn % buckets, b"", b"", b"", near.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), *[pa.binary()] * 4))], names=[x.split()[0] for x in _PAIRS.split(", ")])

    return run


def _stars(table: pa.Table) -> pa.Table:
    """Edges ``a, b`` from each document of a bucket to the first one that has the same code."""
    ids, edges = _joined(table["ids"], np.int64), [_joined(table["near"], np.int64).reshape(-1, 2)]
    # code and place of the document in one number, sorted in place
    both = _joined(table["codes"], np.uint32).astype(np.uint64)
    both <<= np.uint64(32)
    both |= np.repeat(np.arange(len(ids), dtype=np.uint64), _joined(table["sizes"], np.uint32))
    both.sort()
    shared = np.zeros(len(both) + 1, bool)  # codes that the one before has too
    np.equal(both[1:] >> np.uint64(32), both[:-1] >> np.uint64(32), out=shared[1:-1])
    some = shared[1:] | shared[:-1]
    both = both[some]
    if len(both):
        owner = ids[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        begin = np.flatnonzero(~shared[:-1][some])
        first = np.repeat(np.minimum.reduceat(owner, begin), np.diff(begin, append=len(both)))
        edges.append(np.stack((owner, first), axis=1)[first != owner])
    edges = np.unique(np.concatenate(edges), axis=0)
    return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})


def neighbours(s: np.ndarray, frequent: tuple[np.ndarray, int], num: int, den: int) -> np.ndarray:
    """Hashes of the neighbouring n-grams in a set's prefix, of which one is shared with each set that it links with.

    Frequent n-grams (given as sorted keys of so many buckets) come last. Of a set's first ``p`` n-grams ``p - d`` are shared, if it has ``d`` of its
    own, and each n-gram that only one of the two sets has parts one pair of shared neighbours; so
    ``p = 2 + 2 d + e`` leaves one, if the other has ``e`` of its own. For low thresholds there is no such ``p`` and single n-grams are given.
    """
    if len(frequent[0]) and len(s):
        key = _keyed(s, frequent[1])
        last = frequent[0][np.minimum(np.searchsorted(frequent[0], key), len(frequent[0]) - 1)] == key
        s = np.concatenate((s[~last], s[last]))
    n, least = len(s), _least(len(s), num, den)
    if 10 * num < 7 * den:
        return s[: n - least + 1]
    p = min(n, 2 + max(0, (2 * den - num) * n - (2 * num - den) * least) // (num + den))
    return mix(s[: max(0, p - 1)] * np.uint64(0x9FB21C651E98DF25) + s[1:p])


_SETS = "doc_id long, shingles array<long>"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            ids, sets = batch.column(0), []
            at = size = 0
            for s in shingle_sets(_texts(batch.column(1)), width):  # few large sets a batch, so that memory stays bounded
                sets.append(s)
                size += len(s)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), _lists(sets)], names=["doc_id", "shingles"])
                    at, sets, size = at + len(sets), [], 0
            yield pa.RecordBatch.from_arrays([ids.slice(at), _lists(sets)], names=["doc_id", "shingles"])

    return run


def _labelled(num: int, den: int, frequent):
    """``doc_id, label, slot`` and all neighbours of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [neighbours(s, frequent.value, num, den) for s in _as_sets([batch.column(3)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(pairs)], names=["doc_id", "label", "slot", "pairs"])

    return run


def _as_sets(chunks: list[pa.ListArray]) -> list[np.ndarray]:
    out = []
    for chunk in chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False).view(np.uint64), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


class Trie:
    """Sets of integer tokens in one global order, with shared beginnings stored once.

    A node is a range of the sorted sets and the depth they share. ``join`` calls
    ``link(query, members)`` for sets whose overlap reaches the threshold.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order = np.array(order, dtype=np.int64)
        self.sets, self.sizes = [sets[i] for i in order], sizes[self.order]
        self.num, self.den = num, den
        self.common = np.array([0] + [self._shared(a, b) for a, b in zip(self.sets, self.sets[1:], strict=False)], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in self.sets])
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.int32)
        self.span = int(flat.max()) + 1 if len(flat) else 1
        self.who = owner[np.argsort(flat, kind="stable")]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=self.span))))
        self.keys, self.end = owner.astype(np.int64) * self.span, np.cumsum([len(s) for s in self.sets])
        self.keys += flat

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        return int(differ[0]) if len(differ) else k

    def join(self, labels: np.ndarray, link) -> None:
        """``labels`` (by position in ``order``) are kept up to date by ``link``: queries alike with all of a subtree leave it."""
        m = len(self.sets)
        stack = [(0, m, 0, np.zeros(m, np.int64), np.arange(m))] if m else []
        length = np.array([len(s) for s in self.sets])
        while stack:
            lo, hi, depth, overlap, queries = stack.pop()
            if not (below := labels[lo:hi] != labels[lo]).any():
                keep = labels[queries] != labels[lo]
                overlap, queries = overlap[keep], queries[keep]
            if not len(queries) or (hi - lo == 1 and below.any()):
                continue
            deep = int(self.common[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
            if deep > depth:
                path = self.sets[lo][depth:deep]
                got = np.bincount(np.concatenate([self.who[self.begin[t] : self.begin[t + 1]] for t in path]), minlength=m)
                overlap = overlap + got[queries]
                rest = self.end[queries] - np.searchsorted(self.keys, queries * self.span + int(path[-1]), side="right")
                most = overlap + np.minimum(rest, int(length[lo:hi].max()) - deep)
                keep = most * (self.num + self.den) >= self.num * (self.sizes[queries] + int(self.sizes[lo:hi].min()))
                overlap, queries = overlap[keep], queries[keep]
                if not len(queries):
                    continue
            ends = lo
            while ends < hi and length[ends] == deep:
                ends += 1
            for j in range(lo, ends):
                good = (overlap * (self.num + self.den) >= self.num * (self.sizes[queries] + self.sizes[j])) & (queries != j)
                link(j, queries[good])
            if ends < hi:
                cuts = np.flatnonzero(self.common[ends + 1 : hi] == deep) + ends + 1
                for a, b in zip([ends, *cuts.tolist()], [*cuts.tolist(), hi], strict=True):
                    stack.append((a, b, deep, overlap, queries))


def group_labels(ids: np.ndarray, sets: list[np.ndarray], num: int = NUM, den: int = DEN, known: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest id that links of ``num/den`` Jaccard similarity lead to.

    Equal ids are one node and so are equal sets and those of one label in ``known``; empty sets link with nothing.
    """
    rank = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[rank] = np.arange(len(ids))
    by_id, by_set, by_label = {}, {}, {}
    if known is not None:  # the smallest of each label stands for it
        for i in rank.tolist():
            label[i] = label[by_label.setdefault(int(known[i]), i)]

    def union(a: int, b: int) -> None:
        if a != b:
            label[label == max(a, b)] = min(a, b)

    for i, (d, s) in enumerate(zip(ids.tolist(), sets, strict=True)):
        union(label[i], label[by_id.setdefault(d, i)])
        if len(s):
            union(label[i], label[by_set.setdefault(blake2b(s, digest_size=16).digest(), i)])
    alive = np.array(sorted(by_set.values()), dtype=np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    # hashes of one set only can't overlap; the others are numbered in the global order
    flat = np.concatenate([sets[i] for i in alive]) if len(alive) else _EMPTY.copy()
    flat.sort()
    shared = np.unique(flat[1:][flat[1:] == flat[:-1]])
    del flat
    tokens = []
    for i in alive:
        at = np.minimum(np.searchsorted(shared, sets[i]), max(0, len(shared) - 1))
        tokens.append((at[shared[at] == sets[i]] if len(shared) else at[:0]).astype(np.int32))
    while len(alive):  # tokens of one set only can't overlap; sets with too few others can't link
        flat = np.concatenate(tokens)
        often = np.bincount(flat, minlength=int(flat.max()) + 1 if len(flat) else 1) > 1
        kept = [t[often[t]] for t in tokens]
        enough = np.array([len(t) for t in kept]) * den >= num * sizes[alive]
        same = bool(enough.all()) and len(flat) == sum(map(len, kept))
        alive, tokens = alive[enough], [t for t, ok in zip(kept, enough, strict=True) if ok]
        if same:
            break
    if len(alive) > 1:
        trie = Trie(tokens, sizes[alive], num, den)
        at = alive[trie.order]
        current = label[at].copy()

        def link(j: int, found: np.ndarray) -> None:
            for q in found.tolist():
                if current[q] != current[j]:
                    union(label[at[q]], label[at[j]])
                    current[:] = label[at]

        trie.join(current, link)
    return ids[rank][label]


def _join_block(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids, known = table.column("doc_id").to_numpy(), table.column("label").to_numpy()
        label = group_labels(ids, _as_sets(table.column("shingles").chunks), num, den, known)
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(label, pa.int64())})

    return run


def _frequent(counted: DataFrame, buckets: int):
    """Keys of the most frequent n-grams, sorted, as a broadcast of ``MOST_FREQUENT`` at most (2 MB), and the buckets they are of."""
    least = FREQUENT
    while counted.where(F.col("n") >= least).count() > MOST_FREQUENT:
        least *= 2
    found = np.array([r["g"] for r in counted.where(F.col("n") >= least).select("g").collect()], np.int64).view(np.uint64)
    return counted.sparkSession.sparkContext.broadcast((np.sort(found), buckets))


def _numbers(size: str, block_docs: int, block_shingles: int):
    """How many blocks documents fill, of which ``size`` is the column of set sizes."""
    return F.greatest(F.lit(1), F.ceil(F.count("*") / block_docs), F.ceil(F.coalesce(F.sum(size), F.lit(0)) / block_shingles)).cast("int")


def _slots(number: str | Column, salt: str = ""):
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(number) if isinstance(number, str) else number).cast("int")


def _within_blocks(sets: DataFrame, groups: DataFrame, blocks: DataFrame, num: int, den: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Links ``a, b`` within blocks: small groups share one, large ones fill several, each with the group's pivots."""
    small = blocks.where("blocks = 1").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    bins = max(1, -(-small["docs"] // block_docs), -(-small["total"] // block_shingles))
    few = F.greatest(F.lit(1.0), F.least(F.lit(float(PIVOTS)), block_shingles / 4 / (F.col("total") / F.col("docs"))))
    pivot = F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.ceil(F.col("docs") / few)) == 0
    where_to = groups.join(blocks, "candidate").withColumns({"large": F.col("blocks") > 1, "pivot": pivot, "slot": _slots("blocks")})
    placed = sets.join(broadcast_if_small(where_to, groups.count(), BROADCAST_IDS // 8), "doc_id")
    bin_of = F.pmod(F.xxhash64("candidate"), F.lit(bins))
    where = F.when(~F.col("large"), F.array(F.lit(0))).when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("slot"))
    placed = placed.select("doc_id", F.col("doc_id").alias("label"), "shingles", "large", F.when(F.col("large"), F.col("candidate")).otherwise(bin_of).alias("home"), F.explode(where).alias("slot"))
    return placed.groupBy("large", "home", "slot").applyInArrow(_join_block(num, den), "a long, b long").where("a <> b")


def _between_blocks(parted: DataFrame, frequent, num: int, den: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Links ``a, b`` between the documents ``doc_id, label, slot, shingles`` of different labels and slots, by pairs of blocks."""
    pairs = parted.select("doc_id", "label", "slot", "shingles").mapInArrow(_labelled(num, den, frequent), "doc_id long, label long, slot int, pairs array<long>")
    posting = pairs.select("doc_id", "label", "slot", F.explode("pairs").alias("g"))
    met = posting.groupBy("g").agg(F.min("doc_id").alias("b"), F.min("label").alias("l"), F.max("label").alias("m"), F.min("slot").alias("s"), F.max("slot").alias("t")).where("l <> m and s <> t").select("g", "b")
    stars = posting.join(met, "g").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    groups = cut(connected_components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("candidate")).join(parted.select("doc_id", "label", F.size("shingles").alias("n")), "doc_id"))
    first = groups.groupBy("candidate", "label").agg(F.count("*").alias("k")).groupBy("candidate").agg(F.max(F.struct("k", "label")).getField("label").alias("first"))
    sided = groups.join(first, "candidate").withColumn("rest", F.col("label") != F.col("first"))
    number = sided.groupBy("candidate", "rest").agg(_numbers("n", block_docs // 2, block_shingles // 2).alias("blocks")).groupBy("candidate").agg(F.coalesce(F.max(F.when(~F.col("rest"), F.col("blocks"))), F.lit(0)).alias("wide"), F.coalesce(F.max(F.when(F.col("rest"), F.col("blocks"))), F.lit(0)).alias("tall"))
    mine = _slots(F.when(F.col("rest"), F.col("tall")).otherwise(F.col("wide")), "between")
    cell = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    upto = lambda n: F.filter(F.sequence(F.lit(-1), n - 1), lambda x: x >= 0)
    # a block of the first label (counted below 0) meets each block of the rest; those meet one another
    cells = F.when(~F.col("rest"), F.transform(upto(F.col("tall")), lambda j: cell(-1 - F.col("mine"), j))).otherwise(
        F.concat(F.transform(upto(F.col("wide")), lambda i: cell(-1 - i, F.col("mine"))), F.transform(F.filter(upto(F.col("tall")), lambda j: (F.col("tall") == 1) | (j != F.col("mine"))), lambda j: cell(F.least(j, F.col("mine")), F.greatest(j, F.col("mine")))))
    )
    placed = sided.join(number, "candidate").withColumn("mine", mine).select("doc_id", "label", "candidate", F.explode(cells).alias("cell"))
    placed = parted.select("doc_id", "shingles").join(placed, "doc_id").select("doc_id", "label", "shingles", "candidate", "cell")
    return placed.groupBy("candidate", "cell").applyInArrow(_join_block(num, den), "a long, b long").where("a <> b")


def ngram_components(docs: DataFrame, width: int = 5, num: int = NUM, den: int = DEN, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id, linked``.

    ``component_id`` is the smallest doc_id reachable by links, ``class_id`` the
    smallest with the same set. Null or wordless text: 0 shingles, its own
    component. A null doc_id gives null ids and links with nothing; rows that
    repeat a doc_id are one node and all returned. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    with Scratch(spark) as scratch:
        size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = 1 + size // (8 * BUCKET)  # about a shingle every 5 bytes, of which COUNTED hundredths are sent
        with Scratch(spark) as early:
            every = early.table(known.mapInArrow(_sketch(width, buckets), _SKETCH))
            frequent = _frequent(cut(every.where("bucket is not null").groupBy("bucket").applyInArrow(_counts, "g long, n long")), buckets)
            sketch = scratch.table(every.where("bucket is null").select("doc_id", "n_shingles", "f1", "f2", "least"))
        same = sketch.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("m")).where("class_id <> m").drop("m")
        classes = cut(sketch.join(same, ["f1", "f2", "n_shingles"]).select("doc_id", "class_id").where("class_id <> doc_id").distinct())
        again = sketch.groupBy("doc_id").count().where("count > 1").select("doc_id")  # they may have other texts too
        copies = classes.select("doc_id").join(again, "doc_id", "left_anti")
        least = sketch.select("doc_id", F.explode("least").alias("g"))
        heads = least.groupBy("g").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("m")).where("b <> m").select("g", "b")
        heads = cut(least.join(heads, "g").groupBy("doc_id").agg(F.min("b").alias("head")).where("head <> doc_id"))
        under = known.join(broadcast_if_small(heads, heads.count(), BROADCAST_IDS // 2), "doc_id", "left").select(F.coalesce("head", "doc_id").alias("doc_id"), "text")
        packed = under.mapInArrow(_pairs(width, num, den, frequent, buckets), _PAIRS)
        edges = packed.groupBy("bucket").applyInArrow(_stars, "a long, b long").union(heads.select("doc_id", "head"))
        groups = connected_components(edges)
        groups = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("candidate")).join(copies, "doc_id", "left_anti")
        alone = groups.groupBy("candidate").agg(F.count("*").alias("k")).where("k = 1").select("candidate")
        groups = cut(groups.join(alone, "candidate", "left_anti"))
        n_groups = groups.count()
        few = broadcast_if_small(groups.select("doc_id"), n_groups, BROADCAST_IDS)
        sets = scratch.table(known.join(few, "doc_id").mapInArrow(_sets(width), _SETS))
        sized = groups.join(sketch.select("doc_id", F.col("n_shingles").alias("n")).distinct(), "doc_id")
        blocks = cut(sized.groupBy("candidate").agg(F.count("*").alias("docs"), F.sum("n").alias("total"), _numbers("n", block_docs, block_shingles).alias("blocks")))
        links = cut(_within_blocks(sets, groups, blocks, num, den, block_docs, block_shingles))
        linked = connected_components(links)
        large = groups.join(blocks.where("blocks > 1").select("candidate", "blocks"), "candidate").join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        large = large.select("doc_id", "candidate", F.coalesce("component", "doc_id").alias("label"), _slots("blocks").alias("slot"))
        parted = large.groupBy("candidate").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("candidate")
        parted = cut(large.join(parted, "candidate", "left_semi").select("doc_id", "label", "slot"))
        n_parted = parted.count()
        if n_parted:
            parted = scratch.table(sets.join(broadcast_if_small(parted, n_parted, BROADCAST_IDS // 4), "doc_id"))
            links = links.union(cut(_between_blocks(parted, frequent, num, den, block_docs, block_shingles)))
        linked = connected_components(links.union(classes.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))))
        linked = linked.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
        out = sketch.select("doc_id", "n_shingles").join(linked, "doc_id", "left").join(classes, "doc_id", "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.col("component_id").isNotNull().alias("linked"))
        out = cut(out)
    nameless = docs.where("doc_id is null").mapInArrow(_count_only(width), "n_shingles long")
    return out.union(nameless.select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False)))


def _count_only(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(_texts(batch.column(1)), width)], pa.int64())], names=["n_shingles"])

    return run


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each linked group: the one with the smallest doc_id.

    Of rows that repeat a doc_id one stays, whatever their texts; rows without a
    doc_id all stay.
    """
    keep = ngram_components(docs, **how).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    n = keep.count()
    out = docs.join(broadcast_if_small(keep, n, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if again:
        named = out.where("doc_id is not null").dropDuplicates(["doc_id"])
        out = named.union(out.where("doc_id is null"))
    return out


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same over all pairs, for tables small enough for that.
ORACLE_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then ['#' || array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as f from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(node, reach) as (select doc_id, doc_id from w union select r.node, e.b from r join e on r.reach = e.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, coalesce(k.class_id, w.doc_id) as class_id, w.doc_id in (select a from e) as linked
from w left join n on n.doc_id = w.doc_id join (select node, min(reach) as component_id from r group by node) c on c.node = w.doc_id left join (select f, min(doc_id) as class_id from n group by f) k on k.f = n.f
"""
