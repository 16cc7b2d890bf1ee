"""Token ids in binary shards, compressed with a Re-Pair grammar.

Documents are dealt to shards by ranges of doc_id and encoded; a shard is a row of
blocks in the order of doc_id. In each block the frequent pairs of neighbouring ids
are replaced by nonterminals, thousands in a round, until no pair is left that is frequent, never
across a document's end.

File format (Parquet, a row a block): ``part, block`` give the order; ``payload`` are
the symbols as little-endian unsigned 32-bit integers (16-bit if ``wide`` is
false), ``rules`` the two symbols of each nonterminal, numbered from ``first_rule``, as
32-bit integers, and ``lengths`` the ids that each of them expands to; ``doc_id``,
``doc_at`` and ``doc_tokens`` give each document's first symbol and number of ids,
so that one document is decoded without the rest of the block.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, cut
from .shingles import text_groups

END = 2
BLOCK = 1 << 20
RULES_A_ROUND, LEAST_COUNT = 3000, 12
#: Words that an encoder remembers, and that go through the library at once.
CACHE, AT_ONCE, JOINED = 1_000_000, 4096, 64

#: Stands between texts while they are split together.
_MARK = "\ue000"
#: What Python's white space and the tokenizer's may not agree on, and beginnings of special strings.
_WHOLE = ("<|", _MARK, "\x0b", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: White space beyond ASCII, on which both agree.
_WIDE = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Classes of bytes: white space, small letters, digits, what else is ASCII, an apostrophe, no ASCII.
_SPACE, _LETTER, _DIGIT, _OTHER, _QUOTE, _HIGH = range(6)
_CLASS = np.full(256, _HIGH, np.uint8)
_CLASS[:128] = _OTHER
_CLASS[97:123], _CLASS[48:58], _CLASS[39], _CLASS[[9, 10, 12, 13, 32]] = _LETTER, _DIGIT, _QUOTE, _SPACE
#: Whether a word begins at a byte of the second class behind one of the first: behind white space, and where the
#: tokenizer parts pieces whatever stands around: at the end of letters, at digits, before letters but not behind an apostrophe.
_BEGINS = np.zeros((6, 6), bool)
_BEGINS[_SPACE, 1:] = True
_BEGINS[_LETTER, [_DIGIT, _OTHER, _QUOTE]] = True
_BEGINS[_DIGIT, [_DIGIT, _LETTER, _OTHER, _QUOTE]] = True
_BEGINS[[_OTHER, _QUOTE], _DIGIT] = True
_BEGINS[_OTHER, _LETTER] = True
_BEGINS = _BEGINS.ravel()


def _words(text: str) -> pa.DictionaryArray:
    """The words of ``text`` with A-Z lowered, parted where pieces of the tokenizer are parted for certain."""
    for x in _WIDE:
        if x in text:
            text = text.replace(x, " ")
    buf = np.frombuffer(text.encode().translate(_LOWER), np.uint8)
    kind = _CLASS[buf]
    begins = _BEGINS[np.concatenate(([_SPACE], kind[:-1])).astype(np.uint8) * np.uint8(6) + kind]
    held = kind != _SPACE
    bytes_held = buf[held]
    at = np.append(np.flatnonzero(begins[held]), len(bytes_held)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(bytes_held)]).dictionary_encode()


def _gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``values`` that begin and are as long as given, one behind another."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    return values[np.repeat((begin - (ends - size)).astype(kind), size) + np.arange(total, dtype=kind)]


class WordEncoder:
    """Ids of texts from a tokenizer that ignores case and whose pieces never cross white space.

    Each distinct word goes through the library once for as long as the (bounded)
    cache holds it; texts with special strings or unusual control characters go
    through it whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {_MARK: 0}
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone are one piece each and go through the library joined; its end-of-word ids part them again."""
        letters = [w for w in words if w.isalpha()]
        for at in range(0, len(letters), AT_ONCE):
            groups = [letters[i : i + JOINED] for i in range(at, min(at + AT_ONCE, len(letters)), JOINED)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.is_end[ids]) + 1
                if len(ends) == len(group) and ends[-1] == len(ids):
                    self._add(group, ids, np.diff(ends, prepend=0))
                else:
                    self._learn_apart(group)
        rest = [w for w in words if not w.isalpha()]
        for at in range(0, len(rest), AT_ONCE):
            self._learn_apart(rest[at : at + AT_ONCE])

    def _learn_apart(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self._add(words, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.index), self.n_ids + len(ids)
        self.ids, self.begin, self.size = self._grown(self.ids, n), self._grown(self.begin, k + len(words)), self._grown(self.size, k + len(words))
        self.ids[self.n_ids : n] = ids
        self.begin[k : k + len(words)] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[k : k + len(words)] = sizes
        self.n_ids = n
        self.index.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo, hi in text_groups(texts, 1 << 22):
            whole = {i for i in range(lo, hi) if texts[i] and any(x in texts[i] for x in _WHOLE)}
            plain = ["" if i in whole else texts[i] or "" for i in range(lo, hi)]
            found = _words(f"\n{_MARK}\n".join([*plain, ""]))
            flat = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            known = list(map(self.index.get, flat))
            new = [k for k, i in enumerate(known) if i is None]
            if len(self.index) + len(new) > CACHE:
                self._clear()
                known = list(map(self.index.get, flat))
                new = [k for k, i in enumerate(known) if i is None]
            if new:
                self._learn([flat[k] for k in new])
                for k in new:
                    known[k] = self.index[flat[k]]
            at = np.array(known, np.int64)[found.indices.to_numpy()]
            size = self.size[at]
            ends = np.cumsum(size, dtype=np.int64)
            ids = _gathered(self.ids, self.begin[at], size)
            edge = np.concatenate(([0], ends[at == 0]))
            for i in range(lo, hi):
                out.append(np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) if i in whole else ids[edge[i - lo] : edge[i - lo + 1]])
        return out


@lru_cache(maxsize=2)
def encoder(file: str) -> WordEncoder:
    """The encoder of a worker process, whose cache later tasks find; Spark's tasks use the cores, so the library's threads would only cost time."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(file)


_BUCKETS = 1 << 19


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(2654435761)) ^ (right * np.uint32(2246822519))) >> np.uint32(13)


def compress(ids: np.ndarray, starts: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols, rules, lengths, starts)``: Re-Pair of ``ids``, whose documents begin at ``starts``.

    A round counts all neighbouring pairs, takes the most frequent and replaces
    them from the left where they don't overlap. Rounds end when no pair stands ``LEAST_COUNT`` times.
    """
    seq = ids.astype(np.uint32)
    head = np.zeros(len(seq) + 1, bool)
    head[starts] = True
    rules, lengths, known = [], [], first_rule
    length = np.ones(first_rule, np.int64)
    every = False  # whether all buckets are looked through, because the fullest held no frequent pair
    while len(seq) >= 2:
        bucket = _bucket(seq[:-1], seq[1:]).astype(np.intp)
        count = np.bincount(bucket, minlength=_BUCKETS)
        # a pair is no oftener than its bucket, so the best pairs are in the fullest buckets
        full = np.cumsum(np.bincount(np.minimum(count, 4095), minlength=4096)[::-1])[::-1]  # buckets that are as full, or fuller
        least = LEAST_COUNT if every else max(LEAST_COUNT, int(np.flatnonzero(full >= 2 * RULES_A_ROUND)[-1]))
        at = np.flatnonzero((count >= least)[bucket] & ~head[1 : len(seq)])
        code = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        pair, times = np.unique(code, return_counts=True)
        best = np.flatnonzero(times >= LEAST_COUNT)
        best = np.sort(best[np.argsort(-times[best], kind="stable")[:RULES_A_ROUND]])
        if not len(best):
            if least == LEAST_COUNT:
                break
            every = True
            continue
        every = False
        pair, times = pair[best], times[best]
        left, right = (pair >> np.uint64(32)).astype(np.uint32), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        own = _bucket(left, right)
        table = np.full(_BUCKETS, -1, np.int32)
        table[own[np.argsort(times, kind="stable")]] = np.argsort(times, kind="stable")
        kept = np.flatnonzero(table[own] == np.arange(len(pair)))  # of pairs in one bucket, the rarer ones wait
        pair, left, right = pair[kept], left[kept], right[kept]
        table[own[kept]] = np.arange(len(kept))
        slot = table[bucket[at]]
        hit = (slot >= 0) & (pair[slot] == code)
        at, slot = at[hit], slot[hit]
        new_run = np.concatenate(([True], np.diff(at) != 1))
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run_start) % 2 == 0
        at, slot = at[take], slot[take]
        rules.append(np.stack((left, right), axis=1))
        lengths.append(length[left] + length[right])
        length = np.concatenate((length, lengths[-1]))
        seq[at] = known + slot
        known += len(pair)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, head = seq[keep], np.append(head[:-1][keep], False)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), np.concatenate(lengths) if lengths else np.zeros(0, np.int64), np.flatnonzero(head)


def _expand_passes(seq: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids of a few symbols; each pass expands all nonterminals by one level."""
    while len(seq) and len(rules):
        big = seq >= first_rule
        if not big.any():
            break
        at = np.cumsum(1 + big) - 1 - big
        out = np.empty(len(seq) + int(big.sum()), np.uint32)
        out[at[~big]] = seq[~big]
        pair = rules[seq[big] - first_rule]
        out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids of ``symbols``. For many, each nonterminal is expanded once, those of lower levels first."""
    seq = symbols.astype(np.uint32)
    if len(seq) < len(rules) or not len(rules):
        return _expand_passes(seq, rules, first_rule)
    level = np.zeros(first_rule + len(rules), np.int32)
    while True:
        new = 1 + level[rules].max(axis=1)
        if (new == level[first_rule:]).all():
            break
        level[first_rule:] = new
    flat, begin, size = np.arange(first_rule, dtype=np.uint32), np.arange(len(level)), np.ones(len(level), np.int64)
    for k in range(1, int(level.max()) + 1):
        of = np.flatnonzero(level == k)
        both = rules[of - first_rule].astype(np.int64)
        size[of] = size[both].sum(axis=1)
        begin[of] = len(flat) + np.cumsum(size[of]) - size[of]
        flat = np.concatenate((flat, _gathered(flat, begin[both.ravel()], size[both.ravel()])))
    return np.concatenate([_gathered(flat, begin[x], size[x]) for x in np.split(seq, range(1 << 20, len(seq), 1 << 20))])


_BLOCKS = "part int, block int, first_rule int, wide boolean, payload binary, rules binary, lengths binary, doc_id array<long>, doc_at array<long>, doc_tokens array<long>, n_tokens long"


def _block(part: int, block: int, docs: list[tuple[int | None, np.ndarray]], first_rule: int) -> pa.RecordBatch:
    sizes = np.array([len(x) for _, x in docs], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    seq, rules, lengths, at = compress(np.concatenate([x for _, x in docs]), starts, first_rule)
    wide = bool(len(seq) and first_rule + len(rules) > 65536)
    one = lambda x, kind: pa.array([x], kind)
    return pa.RecordBatch.from_arrays(
        [
            one(part, pa.int32()), one(block, pa.int32()), one(first_rule, pa.int32()), one(wide, pa.bool_()), one(seq.astype("<u4" if wide else "<u2").tobytes(), pa.binary()), one(rules.astype("<u4").tobytes(), pa.binary()), one(lengths.astype("<i8").tobytes(), pa.binary()),
            one([d for d, _ in docs], pa.list_(pa.int64())), one(at.tolist(), pa.list_(pa.int64())), one(sizes.tolist(), pa.list_(pa.int64())), one(int(sizes.sum()), pa.int64()),
        ],
        names=[x.split()[0] for x in _BLOCKS.split(", ")],
    )


def _encode(file: str, end: int, block_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(file)
        first_rule = words.tokenizer.get_vocab_size()
        part, block, docs, total = TaskContext.get().partitionId(), 0, [], 0
        tail = np.array([end], np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_groups(texts, 1 << 22):
                for d, x in zip(ids[lo:hi], words.encode(texts[lo:hi]), strict=True):
                    docs.append((d, np.concatenate((x, tail))))
                    total += len(x) + 1
                    if total >= block_size:
                        yield _block(part, block, docs, first_rule)
                        block, docs, total = block + 1, [], 0
        if docs:
            yield _block(part, block, docs, first_rule)

    return run


def encode_blocks(docs: DataFrame, file: str, end: int = END, block_size: int = BLOCK) -> DataFrame:
    """The blocks of ``docs`` in ascending doc_id (nulls first; rows that repeat an id in the order of a hash of the text).

    Null text counts as empty: such a document is the end id alone. Other columns
    aren't read; no rows, no blocks.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = given.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return dealt.mapInArrow(_encode(file, end, block_size), _BLOCKS)


class Block:
    """A block read back, for random access by document or by position."""

    def __init__(self, row: dict):
        self.first_rule = row["first_rule"]
        self.symbols = np.frombuffer(row["payload"], "<u4" if row["wide"] else "<u2")
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.doc_id, self.doc_at, self.doc_tokens = row["doc_id"], [*row["doc_at"], len(self.symbols)], row["doc_tokens"]

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.doc_at[k] : self.doc_at[k + 1]], self.rules, self.first_rule)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block; only the symbols that hold them are expanded."""
        size = np.ones(len(self.symbols), np.int64)
        big = self.symbols >= self.first_rule
        size[big] = self.lengths[self.symbols[big].astype(np.int64) - self.first_rule]
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop))
        first = int(ends[a] - size[a]) if a < len(ends) else 0
        return expand(self.symbols[a : b + 1], self.rules, self.first_rule)[start - first : stop - first]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row)
            ids = expand(block.symbols, block.rules, block.first_rule).astype("<u4")
            n = np.array(block.doc_tokens, np.int64)
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_id, pa.int64()), pa.array([row["part"]] * k, pa.int32()), pa.array([row["block"]] * k, pa.int32()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "block", "at", "n_tokens", "ids_crc32"])


def read_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, part, block`` of each document, from the ids decoded from ``blocks``."""
    rows = blocks.mapInArrow(_read, "doc_id long, part int, block int, at long, n_tokens long, ids_crc32 long")
    # a row a block, of a million ids or more each
    size = blocks.select("part", "block", "n_tokens")
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = size.select("part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("block_start"))
    begin = within.join(before, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("begin"))
    return rows.join(begin, ["part", "block"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "block")


def op3_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        return cut(read_blocks(scratch.table(encode_blocks(docs, P.path("word_bpe_49k.json")))))
