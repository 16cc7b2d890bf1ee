"""Prefix tries of conversations as LOUDS bit vectors.

Conversations become sequences of turn labels (128-bit digests of role and text); equal
sequences are merged into one with a weight. A sequence belongs to the shard of its first turn, or, while
that prefix has more than ``HEAVY`` turns below it, of its first 2, 4, 8 ... turns. Shards are built level
by level in numpy: nodes in level order, a LOUDS bit vector (a one for each child, then a zero) and arrays of
labels, several small shards in one forest. Parents and numbers of children are read back from the bits, and
leaves and savings are added up in reverse level order. The levels above the shards are merged by themselves, by
grouped sums over the shards' totals, so that no task holds more than one shard beside a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, cut

#: Turns of distinct sequences below a prefix of one shard, and of the shards that one forest gathers.
HEAVY, CHUNK = 1024, 200_000
#: Turns that a conversation may take from the first of its block of conversations.
BLOCK, HEAD = 100, 6
#: Letters of a piece of joined ids.
PIECE = 1 << 16

_EMPTY = hashlib.sha256(b"").hexdigest()


def label(role: str = "role", text: str = "text") -> Column:
    """The digest of a turn, 16 bytes; null role or text is empty."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation as ``struct<turn, label, chars>`` in order.

    Turns are ordered by ``turn``, null first, and equal ones by their label. Rows without a conversation
    are left out. A conversation is a row, of 28 bytes a turn.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), label().alias("label"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """``own`` with the first h turns taken from conversation ``c - c % 100``, h = crc32(c) % 6."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.slice("turns", 1, HEAD - 1).alias("head"))
    both = own.withColumn("block", block).join(heads, "block", "left")
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _level(at: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children that ``(at, label)`` make: the number of each row's child, and a row of each child."""
    order = np.lexsort((two, one, at))
    a, x, y = at[order], one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    child = np.empty(len(order), np.int64)
    child[order] = np.cumsum(new) - 1
    return child, order[new]


def louds(root: np.ndarray, depth: np.ndarray, labels: np.ndarray, chars: np.ndarray, begin: np.ndarray, length: np.ndarray, weight: np.ndarray, conv: np.ndarray) -> dict[str, np.ndarray]:
    """The forest of sequences in level order.

    Sequence i is ``labels[begin[i] : begin[i] + length[i]]`` and stands below ``root[i]``, which is ``depth[i]`` turns deep.
    Returned are the bits, and for each node its label, letters of its turn, members, smallest member and the
    sequence that ends there, or -1.
    """
    roots = int(root.max()) + 1
    one = np.zeros(roots, np.int64)
    one[root] = np.arange(len(root))
    last = begin[one] + depth[one] - 1
    keys, letters, members, least, ends, parents = [labels[last]], [chars[last]], [], [], [], []
    here, base, t, alive = root.copy(), 0, 0, np.arange(len(root))
    size = roots
    while True:
        at = here[alive] - base
        members.append(np.zeros(size, np.int64))
        np.add.at(members[-1], at, weight[alive])
        least.append(np.full(size, np.iinfo(np.int64).max))
        np.minimum.at(least[-1], at, conv[alive])
        stop = length[alive] == depth[alive] + t
        ends.append(np.full(size, -1, np.int64))
        ends[-1][at[stop]] = alive[stop]
        alive = alive[~stop]
        if not len(alive):
            break
        place = begin[alive] + depth[alive] + t
        child, rows = _level(here[alive], labels[place, 0], labels[place, 1])
        parents.append(here[alive][rows])
        keys.append(labels[place[rows]])
        letters.append(chars[place[rows]])
        base += size
        size = len(rows)
        here[alive] = base + child
        t += 1
    nodes = base + size
    children = np.bincount(np.concatenate(parents) if parents else np.zeros(0, np.int64), minlength=nodes)
    bits = np.ones(int(children.sum()) + nodes, np.uint8)
    bits[np.cumsum(children + 1) - 1] = 0
    join = np.concatenate
    return {"bits": bits, "labels": join(keys), "chars": join(letters), "members": join(members), "least": join(least), "ends": join(ends)}


_TRIES = "nodes long, bits binary, labels binary, chars binary, members binary, least binary, roots array<struct<prefix:binary,chars:array<int>>>, ends array<struct<node:int,digest:binary>>"
_ROOTS = pa.list_(pa.struct([("prefix", pa.binary()), ("chars", pa.list_(pa.int32()))]))
_ENDS = pa.list_(pa.struct([("node", pa.int32()), ("digest", pa.binary())]))


def _forest(rows: list[dict]) -> pa.RecordBatch:
    """A row of ``_TRIES`` for whole shards."""
    root = np.cumsum([0] + [int(x["shard"] != y["shard"]) for x, y in zip(rows[1:], rows[:-1], strict=True)])
    length = np.array([len(r["chars"]) for r in rows], np.int64)
    labels = np.frombuffer(b"".join([r["labels"] for r in rows]), ">u8").astype(np.uint64).reshape(-1, 2)
    chars = np.concatenate([np.array(r["chars"], np.int64) for r in rows])
    depth, weight, conv = (np.array([r[k] for r in rows], np.int64) for k in ("depth", "n", "conv_id"))
    trie = louds(root, depth, labels, chars, np.cumsum(length) - length, length, weight, conv)
    heads = {int(g): r for g, r in zip(root.tolist(), rows, strict=True)}
    roots = [{"prefix": r["labels"][: 16 * r["depth"]], "chars": r["chars"][: r["depth"]]} for _, r in sorted(heads.items())]
    ends = [{"node": i, "digest": rows[trie["ends"][i]]["digest"]} for i in np.flatnonzero(trie["ends"] >= 0).tolist()]
    raw = [np.packbits(trie["bits"]).tobytes(), trie["labels"].astype(">u8").tobytes()] + [trie[k].astype("<i8").tobytes() for k in ("chars", "members", "least")]
    columns = [pa.array([len(trie["chars"])], pa.int64())] + [pa.array([x], pa.binary()) for x in raw] + [pa.array([roots], _ROOTS), pa.array([ends], _ENDS)]
    return pa.RecordBatch.from_arrays(columns, names=["nodes", "bits", "labels", "chars", "members", "least", "roots", "ends"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, turns = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if turns > CHUNK and row["shard"] != rows[-1]["shard"]:
                yield _forest(rows)
                rows, turns = [], 0
            rows.append(row)
            turns += len(row["chars"])
    if rows:
        yield _forest(rows)


def parents(bits: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(parent of each node that isn't a root, children of each node, roots)`` from the bits of a forest."""
    bits = np.unpackbits(bits)
    bits = bits[: int(np.flatnonzero(np.cumsum(bits == 0) == nodes)[0]) + 1]
    zeros = np.cumsum(bits == 0)
    parent = zeros[bits == 1]
    return parent, np.bincount(parent, minlength=nodes), nodes - len(parent)


def _rollup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of forests with the sums of their subtrees."""
    for batch in batches:
        for trie in batch.to_pylist():
            nodes = trie["nodes"]
            parent, children, roots = parents(np.frombuffer(trie["bits"], np.uint8), nodes)
            chars, members, least = (np.frombuffer(trie[k], "<i8") for k in ("chars", "members", "least"))
            leaves, saved = (children == 0).astype(np.int64), (members - 1) * chars
            depth = np.empty(nodes, np.int64)
            depth[:roots] = [len(r["chars"]) for r in trie["roots"]]
            levels = [(0, roots)]
            while levels[-1][1] < nodes:
                lo, hi = levels[-1]
                levels.append((hi, hi + int(children[lo:hi].sum())))
                depth[hi : levels[-1][1]] = depth[parent[hi - roots : levels[-1][1] - roots]] + 1
            for lo, hi in reversed(levels[1:]):
                up = parent[lo - roots : hi - roots]
                np.add.at(leaves, up, leaves[lo:hi])
                np.add.at(saved, up, saved[lo:hi])
            above = np.full(nodes, -1, np.int64)
            above[roots:] = least[parent]
            inner = np.arange(nodes) >= roots
            digest: list[bytes | None] = [None] * nodes
            for e in trie["ends"]:
                digest[e["node"]] = e["digest"]
            tail = [None] * (nodes - roots)
            columns = [
                pa.array(least), pa.array(depth), pa.array(above, mask=~inner), pa.array(members), pa.array(children.astype(np.int64)), pa.array(leaves), pa.array(saved), pa.array(digest, pa.binary()),
                pa.array([r["prefix"] for r in trie["roots"]] + tail, pa.binary()), pa.array([r["chars"] for r in trie["roots"]] + tail, pa.list_(pa.int32())),
            ]
            whole = pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "digest", "prefix", "prefix_chars"])
            for at in range(0, nodes, 1 << 16):
                yield whole.slice(at, 1 << 16)


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, digest binary, prefix binary, prefix_chars array<int>"


def _digest(labels: Column | str, turns: Column | None = None) -> Column:
    """The digest of the first ``turns`` labels (of all)."""
    return F.unhex(F.md5(labels if turns is None else F.substring(labels, 1, turns * 16)))


def build_tries(distinct: DataFrame, scratch: Scratch, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """``(tries, short)`` of distinct sequences ``(digest, n, conv_id, labels, chars)``.

    ``tries`` are forests of whole shards (bits, labels, letters, members, smallest members, roots and ends); ``short``
    are the sequences that end above all shards.
    """
    rest, depth, shards, short = distinct, 1, None, None
    while True:
        ended = rest.where(F.size("chars") < depth)
        short = ended if short is None else short.union(ended)
        rest = rest.where(F.size("chars") >= depth).withColumn("shard", _digest(F.col("labels"), F.lit(depth)))
        sizes = rest.groupBy("shard").agg(F.sum(F.size("chars") - depth + 1).alias("turns"))
        large = scratch.table(sizes.where(F.col("turns") > heavy).select("shard"))
        none = large.isEmpty()
        light = (rest if none else rest.join(large, "shard", "left_anti")).select(*distinct.columns, "shard", F.lit(depth).alias("depth"))
        shards = light if shards is None else shards.union(light)
        if none:
            break
        rest = scratch.table(rest.join(large, "shard", "left_semi").select(*distinct.columns))
        depth *= 2
    dealt = shards.repartition("shard").sortWithinPartitions("shard")
    return scratch.table(dealt.mapInArrow(_forests, _TRIES)), short


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(digest, conv_id)`` as pieces of comma-joined ids."""
    kind = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    key, ids, size = None, [], 0
    out: list[dict] = []
    for batch in batches:
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (digest != key or size > PIECE):
                out.append({"digest": key, "first": ids[0], "ids": ",".join(map(str, ids))})
                ids, size = [], 0
            key = digest
            ids.append(conv)
            size += 8
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, kind)
            out = []
    if ids:
        out.append({"digest": key, "first": ids[0], "ids": ",".join(map(str, ids))})
    yield pa.RecordBatch.from_pylist(out, kind)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(digest, ends_sha256)`` of sorted pieces; only one hash is open at a time."""
    kind = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
    key, now, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest == key:
                now.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append({"digest": key, "ends_sha256": now.hexdigest()})
            key, now = digest, hashlib.sha256(ids.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, kind)
            out = []
    if now is not None:
        out.append({"digest": key, "ends_sha256": now.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, kind)


def ends_of(ended: DataFrame) -> DataFrame:
    """``digest, ends_sha256``: the hash of all ids with a digest, ascending and comma-joined.

    Ids are joined in ranges, in parallel; a hash runs over its pieces in order, so they meet in one
    task, but are streamed.
    """
    pieces = ended.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_joined, "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest binary, ends_sha256 string")


def _upper(totals: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes above the shards from ``totals``: ``prefix, chars, top, n_convs, conv_id, n_leaves, saved_tokens``, each for depths 0 to ``top``."""
    each = totals.withColumn("depth", F.explode(F.sequence(F.lit(0), "top")))
    each = each.select(F.substring("prefix", F.lit(1), F.col("depth") * 16).alias("prefix"), F.slice("chars", F.lit(1), F.col("depth")).alias("chars"), "depth", "n_convs", "conv_id", "n_leaves", "saved_tokens")
    # a prefix has one array of letters, so that any is right
    nodes = each.groupBy("prefix", "depth").agg(F.first("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    nodes = scratch.table(nodes)
    above = lambda df: df.where("depth > 0").select(_digest(F.col("prefix"), F.col("depth") - 1).alias("above"))
    children = above(nodes.select("prefix", "depth")).union(above(roots.select("prefix", "depth"))).groupBy("above").agg(F.count("*").alias("n_children"))
    nodes = nodes.withColumn("digest", _digest(F.col("prefix"))).join(children.withColumnRenamed("above", "digest"), "digest", "left")
    nodes = scratch.table(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    letters = F.coalesce(F.try_element_at("chars", F.lit(-1)), F.lit(0)).cast("long")
    own = nodes.select("prefix", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * letters).alias("own"))
    sums = own.withColumn("up", F.explode(F.sequence(F.lit(0), "depth"))).groupBy(_digest(F.col("prefix"), F.col("up")).alias("digest")).agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    return nodes.join(sums, "digest").select("digest", "prefix", F.col("depth").cast("long").alias("depth"), "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"))


def trie_nodes(sequences: DataFrame, scratch: Scratch, heavy: int = HEAVY) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``, a row for each node.

    ``sequences`` are ``(conv_id, turns)``, each id once, with turns of ``label`` and ``chars``. A node is a
    distinct sequence of first turns; ``conv_id`` is its smallest member, ``saved_tokens`` the letters that its
    subtree's turns are spared. Empty sequences are members of the root alone; without rows there is no
    node. The result reads tables of ``scratch``.
    """
    labels = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["label"])), ""))
    rows = sequences.select("conv_id", labels.alias("labels"), F.transform("turns", lambda t: t["chars"]).alias("chars")).withColumn("digest", _digest(F.col("labels")))
    rows = scratch.table(rows)
    distinct = scratch.table(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("labels").alias("labels"), F.first("chars").alias("chars")))
    tries, short = build_tries(distinct, scratch, heavy)
    nodes = scratch.table(tries.mapInArrow(_rollup, _NODES))
    roots = nodes.where("prefix is not null")
    zero = F.lit(0).cast("long")
    totals = roots.select("prefix", F.col("prefix_chars").alias("chars"), (F.col("depth") - 1).cast("int").alias("top"), "n_convs", "conv_id", "n_leaves", "saved_tokens")
    totals = totals.union(short.select("labels", "chars", F.size("chars").alias("top"), "n", "conv_id", zero, zero))
    upper = scratch.table(_upper(totals, roots, scratch))
    parent = upper.select(F.col("digest").alias("above"), F.col("conv_id").alias("of"))
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "digest"]
    tops = roots.withColumn("above", _digest(F.col("prefix"), F.col("depth").cast("int") - 1)).drop("parent_conv_id").join(parent.withColumnRenamed("of", "parent_conv_id"), "above", "left").select(*shape)
    high = upper.withColumn("above", F.when(F.col("depth") > 0, _digest(F.col("prefix"), F.col("depth").cast("int") - 1))).join(parent.withColumnRenamed("of", "parent_conv_id"), "above", "left").select(*shape)
    every = nodes.where("prefix is null").select(*shape).union(tops).union(high)
    closed, open_ = every.where("digest is not null"), every.where("digest is null")
    closed = closed.join(ends_of(rows.select("digest", "conv_id")), "digest", "left").select(*shape[:-1], F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    return closed.union(open_.select(*shape[:-1], F.lit(_EMPTY).alias("ends_sha256")))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return cut(trie_nodes(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), scratch))


#: CRC-32 of a list of bytes in SQL; ``{0}`` is an expression for the list, a table ``crc`` has the rows of its table.
CRC = "xor(list_reduce({0}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"
CRC_TABLE = "crc as (select list(v order by n) as t from (select n, list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, n) as v from range(256) as x(n)))"

ORACLE_SQL = f"""
with {CRC_TABLE},
g as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, md5(length(role) || ':' || role || text)) as own from g group by conv_id),
h as (select conv_id, own, {CRC.format("list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)")} % 6 as h from o, crc),
r as (select a.conv_id, coalesce(b.own, [])[1:a.h] || a.own[a.h + 1:] as s from h a left join h b on b.conv_id = a.conv_id - a.conv_id % 100),
p as (select conv_id, d, s[1:d] as pre, len(s) as n from (select conv_id, s, unnest(range(len(s) + 1)) as d from r)),
v as (select pre, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(case when n = d then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from p group by pre, d),
k as (select pre[1:d - 1] as pre, d - 1 as d, count(*) as n_children from v where d > 0 group by all),
w as (select pre, d, (n_children is null)::bigint as leaf, case when d = 0 then 0 else (n_convs - 1) * length(pre[d].text) end as own from v left join k using (pre, d)),
s as (select pre[1:j] as pre, j as d, sum(leaf) as n_leaves, sum(own) as saved_tokens from (select *, unnest(range(d + 1)) as j from w) group by all)
select v.conv_id, v.d as depth, u.conv_id as parent_conv_id, v.n_convs, coalesce(n_children, 0) as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, v.ends_sha256
from v left join k using (pre, d) join s using (pre, d) left join v u on v.d > 0 and u.d = v.d - 1 and u.pre = v.pre[1:v.d - 1]
"""
