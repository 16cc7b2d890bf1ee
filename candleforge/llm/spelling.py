"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

Words are counted over all documents and met through an inverted index of positional q-grams. The letters of a word
are cut into segments of two or three; one edit lies in one segment, so near words agree in all q-grams before
and behind it, counted from the word's beginning and end. These runs of q-grams and the length are the
index's posting lists, each in one place: its words are merged by the bigrams of the open segment and its borders
through a heap, under the limits of position and length, and pairs that share as many bigrams as one edit leaves are
verified. A list of more than ``HOT`` words is dealt out again by its bigrams, of which near words share at least one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefix_trie import CRC, CRC_TABLE
from .shared import Scratch, cut

#: Least letters and occurrences of a word, and the share of documents' runs that are misspelt on purpose.
LETTERS, TIMES, ONE_IN = 5, 3, 97
#: Letters of a segment at most, and words of a posting list that are merged in one place.
SEGMENT, HOT = 3, 2000
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000

_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BEGIN, _END = "\x02", "\x03"


def text_words(text: str | None, doc_id: int | None, one_in: int = ONE_IN) -> Iterator[tuple[str, int]]:
    """The words of a document with their counts; runs whose CRC-32 ``one_in`` divides lose a letter."""
    given = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lowered = (text or "").encode().translate(_LOWER).decode()
    for run, k in Counter(_RUN.findall(lowered)).items():
        h = zlib.crc32(run.encode(), given)
        if h % one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, k


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for word, k in text_words(text.as_py(), doc_id):
                if len(word) >= LETTERS:
                    total[word] += k
            if len(total) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                total.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, n`` of the words of at least ``times`` occurrences in all documents.

    Null texts have none; a null id counts as an empty one. Texts are read whole, other columns aren't read.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def segments(length: int) -> list[tuple[int, int]]:
    """Bounds of the segments of a word, as even as can be."""
    n = -(-length // SEGMENT)
    return [(length * i // n, length * (i + 1) // n) for i in range(n)]


def posting_keys(word: str) -> Iterator[tuple[int, bool, str]]:
    """``(list, longer, open)`` of a word: among words of its length and one more, and one letter longer among words of one less.

    ``open`` is what the list leaves open, with a letter on each side of it.
    """
    framed = _BEGIN + word + _END
    for longer in (False, True):
        length = len(word) - longer
        if length < LETTERS:
            continue
        for i, (lo, hi) in enumerate(segments(length)):
            key = f"{length} {i} {word[:lo]} {word[hi + longer :]}".encode()
            yield int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big", signed=True), longer, framed[lo : hi + longer + 2]


_POSTING = "list long, longer boolean, open string, word string, n long"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            rows = [(*x, w, n) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in posting_keys(w)]
            kinds = (pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["list", "longer", "open", "word", "n"])


def is_one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at:] == b[at + 1 :] if len(b) == len(a) + 1 else len(a) == len(b) and at < len(a) and a[at + 1 :] == b[at + 1 :]


def near_pairs(words: list[tuple[bool, str, str]]) -> Iterator[tuple[int, int]]:
    """Places of near words among ``(longer, open, word)`` of one posting list.

    A word's bigrams name the postings of the words before it, which a heap merges: who comes up as often as an
    edit allows is verified. Two longer words meet in a list of their own length.
    """
    postings: dict[tuple[str, int], list[int]] = defaultdict(list)
    order = sorted(range(len(words)), key=lambda i: words[i][0])
    for place, j in enumerate(order):
        longer, opened, word = words[j]
        grams = [(opened[p : p + 2], p) for p in range(len(opened) - 1)]
        # a bigram behind the inserted letter stands one place further on
        lists = [postings[g, p - shift] for g, p in grams for shift in ((0, 1) if longer else (0,)) if (g, p - shift) in postings]
        least = len(grams) - 2
        for other, hits in groupby(heapq.merge(*lists)):
            if sum(1 for _ in hits) >= least and is_one_edit(words[order[other]][2], word):
                yield order[other], j
        if not longer:
            for g in grams:
                postings[g].append(place)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of sorted posting lists."""
    carry = None
    names = ["a", "n_a", "b", "n_b"]

    def pairs(table: pa.Table) -> pa.RecordBatch:
        lists = table.column(0).to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1]))) if len(lists) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(lists)))
        begin, size = begin[size > 1], size[size > 1]
        table = table.take(pa.array(np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)))
        rows = list(zip(*(table.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
        n = table.column(4).to_pylist()
        out, at = [], 0
        for k in size.tolist():
            for i, j in near_pairs(rows[at : at + k]):
                i, j = at + i, at + j
                out.append((rows[i][2], n[i], rows[j][2], n[j]))
            at += k
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i % 2 == 0 else pa.int64()) for i in range(4)], names=names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        lists = table.column(0).to_numpy()
        if not len(lists):
            continue
        last = int(np.searchsorted(lists, lists[-1]))  # lists are sorted; the last may go on
        carry = table.slice(last)
        if last:
            yield pairs(table.slice(0, last))
    if carry is not None:
        yield pairs(carry)


def _by_bigram(postings: DataFrame) -> DataFrame:
    """Rows of hot lists under a list for each bigram; a longer word also under those of one place before."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("open") - 1), lambda p: F.substring(F.col("open"), p, F.lit(2))))
    grams = postings.select("list", "longer", "open", "word", "n", at.alias("p", "gram"))
    places = F.when(F.col("longer"), F.array(F.col("p"), F.col("p") - 1)).otherwise(F.array(F.col("p")))
    return grams.withColumn("p", F.explode(places)).select(F.xxhash64("list", "p", "gram").alias("list"), "longer", "open", "word", "n")


def near_words(words: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of ``words (word, n)``, each word once, that differ by one edit; a row a pair."""
    postings = words.select("word", "n").mapInArrow(_postings, _POSTING)
    large = scratch.table(postings.groupBy("list").agg(F.count("*").alias("words")).where(F.col("words") > hot).select("list"))
    cool = postings
    if not large.isEmpty():
        cool = postings.join(large, "list", "left_anti").union(_by_bigram(postings.join(large, "list", "left_semi")))
    shape = "a string, n_a long, b string, n_b long"
    found = cool.select("list", "longer", "open", "word", "n").repartition("list").sortWithinPartitions("list").mapInArrow(_merged, shape)
    # the same two words in the same order, whatever the list
    first = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return found.select(pick("a", "b").alias("a"), pick("n_a", "n_b").alias("n_a"), pick("b", "a").alias("b"), pick("n_b", "n_a").alias("n_b")).distinct()


def spelling_groups(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, a row for each word of :func:`word_counts`.

    ``n_near`` counts the words one edit away. ``form`` is the one of largest count ``form_n`` (of equal ones the first in code-point
    order), if that is at least twice the word's, else null. ``root`` follows the forms to their end. Without documents or words the result is
    empty; repeated rows count again. The result reads tables of ``scratch``.
    """
    words = scratch.table(word_counts(docs))
    pairs = near_words(words, scratch, hot)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    near = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))
    follows = F.col("form_n") >= 2 * F.col("n")
    near = scratch.table(near.select("word", "n", "n_near", F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n")))
    # counts double from step to step, so that a few rounds of doubling reach every root
    links = scratch.table(near.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.table(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return near.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return cut(spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch))


_BYTES = "list_transform(range(0, length(x), 2), lambda i: ('0x' || x[i + 1:i + 2])::bigint)"

ORACLE_SQL = f"""
with recursive {CRC_TABLE},
t as (select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
g as (select run, hex(encode(doc_id || ':' || run)) as x, count(*) as k from t group by all),
h as (select run, k, {CRC.format(_BYTES)} as h from g, crc),
e as (select k, case when h % {ONE_IN} = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run) + 2)::int) else run end as word from h),
w as (select word, sum(k)::bigint as n from e where length(word) >= {LETTERS} group by word having sum(k) >= {TIMES}),
v as (select word, n, i, substring(word, 1, i) || substring(word, i + 2) as rest from (select word, n, unnest(range(length(word)))::int as i from w)),
p as (select a.word, b.word as other, b.n as m from v a join v b on a.i = b.i and a.rest = b.rest and a.word <> b.word
      union select a.word, b.word, b.n from v a join w b on a.rest = b.word
      union select b.word, a.word, a.n from v a join w b on a.rest = b.word),
b as (select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from p group by word),
f as (select w.word, case when m >= 2 * n then other end as form, n, coalesce(n_near, 0) as n_near, case when m >= 2 * n then m end as form_n from w left join b using (word)),
r as (select word, word as root from f where form is null union all select f.word, r.root from f join r on f.form = r.word)
select word, form, root, n, n_near, form_n from f join r using (word)
"""
