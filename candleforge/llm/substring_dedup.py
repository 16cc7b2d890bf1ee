"""Repeated windows of words, found by partitions of super-k-mers.

The minimiser of a window is the smallest hash of its six-word runs. Consecutive windows of
a document that share it are a super-k-mer: it travels as one packed string to the bucket of its
minimiser, where its windows are sorted by hash and equal neighbours are compared word by word.
Two windows of equal words have equal minimisers, so that

* a super-k-mer whose minimiser stands nowhere else stays at home: only (minimiser, document, place)
  is counted for it, and no string travels;
* a bucket of more than ``HOT`` super-k-mers is dealt to several places. Each marks what it holds twice and hands on
  one row for each distinct window; only windows that it holds once have to be asked for in the others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, cut
from .shingles import mix, text_groups, word_spans

#: Words of a window, and of the runs whose hashes make the minimisers.
WIDTH, RUN = 35, 6
#: Super-k-mers of a bucket that are sorted in one place; larger buckets are dealt to several.
HOT = 512
#: Packed bytes that are sorted together.
CHUNK = 2 << 20

_U = np.uint64
_FIRST, _SECOND = _U(0x9FB21C651E98DF25), _U(0xC2B2AE3D27D4EB4F)


def _rolled(h: np.ndarray, k: int, by: np.uint64 = _FIRST) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * by + h[i : n + i]
    return mix(out)


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minima of all runs of ``k`` values, by doubling."""
    n, have = len(x) - k + 1, 1
    while 2 * have <= k:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[k - have : k - have + n])


def super_kmers(h: np.ndarray, first: np.ndarray, last: np.ndarray, width: int = WIDTH, run: int = RUN) -> tuple[np.ndarray, ...]:
    """``(start, n, minimiser, weight)`` of the super-k-mers of documents whose words are ``first:last`` in ``h``.

    ``start`` is the place of the first window in ``h`` and ``n`` the number of windows,
    ``width - run + 1`` at most. ``weight`` is 2 if the minimiser stands twice within the super-k-mer, else 1.
    """
    span = width - run + 1
    runs = _rolled(h, run)
    if len(runs) < span:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    least = _sliding_min(runs, span)
    per = np.maximum(0, last - first - width + 1)
    offset = np.concatenate(([0], np.cumsum(per)))
    at = np.arange(offset[-1]) + np.repeat(first - offset[:-1], per)  # the windows within documents
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = value[1:] != value[:-1]
    new[offset[:-1][per > 0]] = True
    begin = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(new | (place % span == 0))
    n = np.diff(np.append(begin, len(at)))
    start, value = at[begin], value[begin]
    reach = np.arange(span)
    left = start + np.argmax(runs[start[:, None] + reach] == value[:, None], axis=1)
    end = start + n - 1
    right = end + span - 1 - np.argmax(runs[end[:, None] + reach[::-1]] == value[:, None], axis=1)
    return start, n, value, 1 + (left != right).astype(np.int64)


def _worded(texts: list[bytes | None]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of bounded size: index of the first, bytes, word starts, ends and hashes, first and last word of each text."""
    for lo, hi in text_groups(texts):
        part = [t or b"" for t in texts[lo:hi]]
        ends = np.cumsum([len(t) + 1 for t in part])
        data = b"\n".join(part) + b"\n"
        s, e, h = word_spans(data, fold=False)
        first = np.searchsorted(s, np.concatenate(([0], ends[:-1])))
        yield lo, data, s, e, h, first, np.append(first[1:], len(h))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _minimisers(width: int, run: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, _, _, _, h, first, last in _worded(batch.column(2).to_pylist()):
                start, _, value, weight = super_kmers(h, first, last, width, run)
                doc = np.searchsorted(first, start, side="right") - 1
                yield pa.RecordBatch.from_arrays([_signed(value), pa.array(a[lo + doc]), pa.array(b[lo + doc]), pa.array((start - first[doc]).astype(np.int32)), pa.array(weight.astype(np.int32))], names=["minimiser", "a", "b", "start", "weight"])

    return each


_PACKED = "minimiser long, part int, parts int, a long, b long, start int, words binary"


def _packed(width: int, run: int):
    """The super-k-mers of the listed starts as packed strings; a bucket of several parts is dealt by documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            wanted = batch.column(3).to_pylist()
            for lo, data, s, e, h, first, last in _worded(batch.column(2).to_pylist()):
                asked = np.array([(x["start"] + f, x["parts"]) for i, f in enumerate(first.tolist()) for x in wanted[lo + i]], np.int64).reshape(-1, 2)
                asked = asked[np.argsort(asked[:, 0])]
                start, n, value, _ = super_kmers(h, first, last, width, run)
                keep = np.searchsorted(start, asked[:, 0])
                start, n, value, parts = start[keep], n[keep], value[keep], asked[:, 1]
                doc = np.searchsorted(first, start, side="right") - 1
                part = (mix(b[lo + doc].astype(np.int64).view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
                starts, ends = s.tolist(), e.tolist()
                words = [b" ".join([data[starts[i] : ends[i]] for i in range(x, y)]) for x, y in zip(start.tolist(), (start + n + width - 1).tolist(), strict=True)]
                columns = [_signed(value), pa.array(part), pa.array(parts.astype(np.int32)), pa.array(a[lo + doc]), pa.array(b[lo + doc]), pa.array((start - first[doc]).astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["minimiser", "part", "parts", "a", "b", "start", "words"])

    return each


def repeated_windows(packed: list[bytes], width: int = WIDTH, parted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each packed super-k-mer the bit mask of its windows that stand at another place of ``packed``, too.

    Windows are sorted by hash; neighbours of one hash are compared by their bytes. Of the super-k-mers that are
    ``parted``, a place of each distinct window follows: two digests, the super-k-mer, the window in it and whether it stands there alone.
    """
    size = np.array([len(p) for p in packed], np.int64)
    data = b"\n".join(packed) + b"\n"
    s, e, h = word_spans(data, fold=False)
    first = np.searchsorted(s, np.concatenate(([0], np.cumsum(size + 1)[:-1])))
    per = np.append(first[1:], len(h)) - first - width + 1
    row = np.repeat(np.arange(len(packed)), per)
    bit = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    at = first[row] + bit
    w = _rolled(h, width)[at]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    met = np.zeros(len(order), bool)
    met[1:] |= same
    met[:-1] |= same
    lo, hi = s[at], e[at + width - 1]
    p, q = order[:-1][same], order[1:][same]
    equal = np.array([data[i:j] == data[k:m] for i, j, k, m in zip(lo[p].tolist(), hi[p].tolist(), lo[q].tolist(), hi[q].tolist(), strict=True)], bool)
    again = np.zeros(len(order), bool)
    again[order[met]] = True
    for x in np.unique(w[p[~equal]]):  # windows of other words under one hash: by their words
        by_words = defaultdict(list)
        for i in np.flatnonzero(w == x).tolist():
            by_words[data[lo[i] : hi[i]]].append(i)
        for group in by_words.values():
            again[group] = len(group) > 1
    mask = np.zeros(len(packed), np.int64)
    np.bitwise_or.at(mask, row[again], np.int64(1) << bit[again])
    some = np.flatnonzero(np.zeros(len(row), bool) if parted is None else parted[row])
    one, two = w[some], _rolled(h, width, _SECOND)[at[some]]
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    kept = order[new]
    return mask, one[kept], two[kept], row[some[kept]], bit[some[kept]], ~again[some[kept]]


_MARKS = "a long, b long, start int, mask long, w1 long, w2 long, lone boolean"


def _buckets(width: int):
    """Marks of sorted buckets, and the distinct windows of those dealt to several places; whole buckets are gathered up to ``CHUNK`` bytes."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        mask, one, two, row, bit, lone = repeated_windows([r[6] for r in rows], width, np.array([r[2] > 1 for r in rows]))
        found = np.flatnonzero(mask)
        a, b, start = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        at = np.concatenate((found, row))
        start = start[at] + np.concatenate((np.zeros(len(found), np.int64), bit))
        marked = np.arange(len(at)) < len(found)
        some = [np.concatenate((np.zeros(len(found), x.dtype), x)) for x in (one.view(np.int64), two.view(np.int64), lone)]
        columns = [pa.array(a[at]), pa.array(b[at]), pa.array(start.astype(np.int32)), pa.array(np.concatenate((mask[found], np.zeros(len(row), np.int64))), mask=~marked)] + [pa.array(x, mask=marked) for x in some]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "start", "mask", "w1", "w2", "lone"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > CHUNK and row[:2] != rows[-1][:2]:
                    yield marks(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield marks(rows)

    return each


def _without(width: int):
    """``doc_id, n_words, n_removed, removed, text`` of documents with their marks."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for lo, data, s, e, _, first, last in _worded(batch.column(1).to_pylist()):
                starts, ends = s.tolist(), e.tolist()
                for i, (x, y) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                    edges = np.zeros(y - x + 1, np.int64)
                    for m in marks[lo + i] or ():
                        bits = np.flatnonzero(np.array(list(reversed(f"{m['mask']:b}"))) == "1") + m["start"]
                        np.add.at(edges, bits, 1)
                        np.add.at(edges, bits + width, -1)
                    gone = np.concatenate(([False], np.cumsum(edges)[:-1] > 0, [False]))
                    turn = np.flatnonzero(gone[1:] != gone[:-1])
                    out[0].append(y - x)
                    out[1].append(int(gone.sum()))
                    out[2].append([{"first": int(p), "words": int(q - p)} for p, q in zip(turn[::2], turn[1::2], strict=True)])
                    kept = gone[1:-1]
                    out[3].append(b" ".join([data[starts[j] : ends[j]] for j, g in zip(range(x, y), kept.tolist(), strict=True) if not g]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], span), pa.array(out[3], pa.binary())], names=["doc_id", "n_words", "n_removed", "removed", "text"])

    return each


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents under a key of two numbers; rows that repeat an id and its text share the key."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-1)).alias("a"), F.xxhash64("text", doc_id).alias("b"), F.col("text").cast("binary").alias("text"), doc_id.alias("doc_id"))


def remove_repeats(docs: DataFrame, scratch: Scratch, width: int = WIDTH, run: int = RUN, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, text``, a row for each document: its words outside repeated windows.

    A word is a maximal run outside space and ``\\x09-\\x0D``. A window is ``width`` consecutive words of one
    document; the words of each window whose words also start anywhere else in the table, the same document and
    overlapping places included, are removed. Windows are judged on the input, so all copies go.
    ``removed`` lists the removed spans (``first`` word from 0, ``words``); ``text`` is the kept words joined by a space.
    Null and wordless texts have no words and shorter ones no windows; they stay. Rows that repeat
    an id or a whole row are documents of their own, rows without an id too. A table without rows gives none, texts of
    any length are read whole, other columns aren't read. The result reads tables of ``scratch``.
    """
    if not 1 <= width - run + 1 <= 62:
        raise ValueError("a window has 1 to 62 runs")
    keyed = _keyed(docs)
    places = keyed.select("a", "b", "text").mapInArrow(_minimisers(width, run), "minimiser long, a long, b long, start int, weight int")
    parts = F.ceil(F.col("rows") / hot).cast("int").alias("parts")
    met = places.groupBy("minimiser").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).where("n > 1").select("minimiser", parts)
    asked = places.join(met, "minimiser").groupBy("a", "b").agg(F.collect_set(F.struct("start", "parts")).alias("asked"))
    every = scratch.table(keyed.join(asked, ["a", "b"], "left"))
    some = every.where("asked is not null")
    strings = some.select("a", "b", "text", "asked").mapInArrow(_packed(width, run), _PACKED)
    sorted_ = strings.repartition("minimiser", "part").sortWithinPartitions("minimiser", "part").mapInArrow(_buckets(width), _MARKS)
    found = scratch.table(sorted_)
    windows = found.where("mask is null")
    elsewhere = windows.groupBy("w1", "w2").agg(F.count("*").alias("places")).where("places > 1").select("w1", "w2")
    lone = windows.where("lone").join(elsewhere, ["w1", "w2"]).select("a", "b", "start", F.lit(1).cast("long").alias("mask"))
    marks = found.where("mask is not null").select("a", "b", "start", "mask").union(lone).groupBy("a", "b").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    marked = some.join(marks, ["a", "b"], "left").select("doc_id", "text", "marks")
    rest = every.where("asked is null").select("doc_id", "text", F.lit(None).cast("array<struct<start:int,mask:bigint>>").alias("marks"))
    shape = "doc_id long, n_words long, n_removed long, removed array<struct<first:int,words:int>>, text binary"
    return marked.union(rest).mapInArrow(_without(width), shape).withColumn("text", F.col("text").cast("string"))


def kept_digest(text: str = "text") -> Column:
    """Lowercase hexadecimal SHA-256 of a text."""
    return F.sha2(F.col(text).cast("binary"), 256)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch)
        return cut(out.select("doc_id", "n_words", "n_removed", kept_digest().alias("kept_sha256")))


ORACLE_SQL = """
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
p as (select r, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
k as (select r, i, sha256(array_to_string(w[i:i + 34], ' ')) as k from p join d using (r)),
m as (select r, i from k where k in (select k from k group by k having count(*) > 1)),
g as (select distinct r, i + j as i from m, range(35) as t(j)),
l as (select r, list(i) as gone from g group by r),
o as (select doc_id, w, coalesce(gone, []) as gone from d left join l using (r))
select doc_id, len(w) as n_words, len(gone) as n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(gone, i)), ' ')) as kept_sha256 from o
"""
