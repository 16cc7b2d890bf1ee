"""Near-copies among embeddings: spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample; every vector is indexed. A vector belongs
to its nearest cell, and a cell's vectors are packed into rows of a table, once. Packs are met by
a cartesian product, which reads them again instead of shuffling copies of vectors:
two vectors with cosine ``c`` are ``sqrt(2 - 2 c)`` apart, so those on two sides of the plane between
their cells have distances to it that sum up to that at most. Packs whose least distances exceed it
aren't paired, and within a pair only rows are multiplied whose distances don't.
With ``margin = sqrt(2 - 2 c) / 2``, the default, no link is lost, however the vectors lie.

Equal vectors are one class with a multiplicity. What leaves a pair of packs is a number of links
and a label a vector, no pairs. The shuffled and written bytes are a few times the vectors
themselves, whatever their number of neighbours; the products grow faster than the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, broadcast_if_small, connected_components, cut

COSINE = 0.9
#: The documented bounds of the index: sampled vectors, cells and vectors a cell aimed at; a pack has ``WIDE`` times so many rows.
SAMPLE, MOST_CELLS, CELL_ROWS, BLOCK_ROWS = 20_000, 2048, 500, 1024
#: What rounding may take from a vector's distance to a plane.
SLACK = 1e-8
WIDE = 8
#: Rows of a pack that are multiplied at once, and linked pairs that are looked at in doubles.
STEP, AT_ONCE = 128, 1 << 16


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of the unit rows of ``x``; an empty cell keeps its centroid."""
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9, None]
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of ``x`` as binaries, which cost Spark far less than arrays."""
    at = (np.arange(len(x) + 1) * x.itemsize * x.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    x = pa.concat_arrays(column.chunks)
    at = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)
    return np.frombuffer(x.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0])).view(kind).reshape(len(x), -1)


def _gaps(centroids: np.ndarray, cell: int) -> np.ndarray:
    """Distances of a centroid to all, infinite to equal ones: no plane parts these."""
    gap = np.linalg.norm(centroids - centroids[cell], axis=1)
    return np.where(gap > 1e-9, gap, np.inf)


#: ``v`` are the components as they were given, floats or doubles.
_PLACED = "vec_id long, n long, dim int, home int, v binary"


def _place(centroids: np.ndarray, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                for at in range(0, some.num_rows, 1024):
                    part = some.slice(at, 1024)
                    given = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    home = (_unit(given) @ centroids.T).argmax(axis=1) if len(centroids) and centroids.shape[1] == dim else np.zeros(len(given))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(home.astype(np.int32)), _packed(given)], names=["vec_id", "n", "dim", "home", "v"])

    return run


#: ``least`` has the least distance of the pack's vectors from the plane to each cell.
_PACKS = "dim int, home int, part int, ids binary, counts binary, v binary, least array<double>"


def _pack(centroids: np.ndarray, kind: type):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, home, part = (k.as_py() for k in key)
        given = _unpacked(table.column("v"), kind)
        least = np.zeros(1)
        if len(centroids) and centroids.shape[1] == dim:
            least = np.full(len(centroids), np.inf)
            for at in range(0, len(given), 1024):
                p = _unit(given[at : at + 1024]) @ centroids.T
                least = np.minimum(least, (p[:, home][:, None] - p).min(axis=0))
            least = np.maximum(0.0, least) / _gaps(centroids, home)
        one = lambda name: pa.array([table.column(name).to_numpy().astype(np.int64).tobytes()], pa.binary())
        columns = [pa.array([dim], pa.int32()), pa.array([home], pa.int32()), pa.array([part], pa.int32()), one("vec_id"), one("n"), pa.array([given.tobytes()], pa.binary()), pa.array([least.tolist()], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=["dim", "home", "part", "ids", "counts", "v", "least"])

    return run


def linked(x: np.ndarray, y: np.ndarray, x_single: np.ndarray, y_single: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cosines of the unit rows of ``x`` and ``y`` reach ``cosine``: singles decide what is clear of their rounding, doubles the rest."""
    product, slack = x_single @ y_single.T, (x.shape[1] + 4) * 1.2e-7
    close = product >= cosine - slack
    if close.any():
        i, j = np.nonzero(close & (product < cosine + slack))
        for at in range(0, len(i), AT_ONCE):
            a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
            close[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
    return close


def _labels(label: np.ndarray, close: np.ndarray, split: int) -> np.ndarray:
    """The smallest of the labels that each row and column of ``close`` reaches through it."""
    top = np.iinfo(np.int64).max
    while True:
        a, b = label[:split], label[split:]
        a = np.minimum(a, np.where(close, b[None, :], top).min(axis=1, initial=top))
        new = np.concatenate((a, np.minimum(b, np.where(close, a[:, None], top).min(axis=0, initial=top))))
        if (new == label).all():
            return label
        label = new


def compare(home: tuple, other: tuple | None, normal: np.ndarray | None, cosine: float, reach: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, links, labels)`` of the linked rows of two packs, or of one if ``other`` is None.

    A pack is ``(ids, multiplicity, unit, unit in singles)``. ``normal`` is the unit normal of the plane between
    their cells, towards ``home``. A row of no links carries what two labels have in common.
    """
    ids, n, x, x_single = home
    m, alone = len(ids), other is None
    others, k, y, y_single = home if alone else other
    links, label = np.zeros(m + (0 if alone else len(others)), np.int64), ids.copy() if alone else np.concatenate((ids, others))
    rows, columns, right = np.arange(m), np.arange(len(others)), None
    if normal is not None:
        left, right = np.maximum(0.0, x @ normal), np.maximum(0.0, -(y @ normal))
        rows, columns = np.argsort(left), np.argsort(right)
        left, right = left[rows], right[columns]
        rows, columns = rows[left + right[0] <= reach], columns[right + left[0] <= reach]
        y, y_single = y[columns], y_single[columns]
    bridges = []
    for at in range(0, len(rows), STEP):
        i, j = rows[at : at + STEP], columns
        if right is not None:
            j = columns[: np.searchsorted(right[: len(columns)], reach - left[at], side="right")]
        close = linked(x[i], y[: len(j)], x_single[i], y_single[: len(j)], cosine)
        if not close.any():
            continue
        apart = close & (i[:, None] != j[None, :]) if alone else close
        a, b = apart.any(axis=1), apart.any(axis=0)
        some, split = np.concatenate((i[a], j[b] if alone else m + j[b])), int(a.sum())
        if not split:
            continue
        links[i] += apart @ k[j]
        if not alone:
            links[m + j] += n[i] @ apart
        old = label[some]
        new = _labels(old, close[np.ix_(a, b)], split)
        joined = np.unique(np.stack((old, new))[:, old != new], axis=1)
        label[some] = new
        bridges.append((joined[0], np.zeros(joined.shape[1], np.int64), joined[1]))
    some = links > 0
    return [((ids if alone else np.concatenate((ids, others)))[some], links[some], label[some]), *bridges]


def _compare_packs(centroids: np.ndarray, kind: type, cosine: float, reach: float):
    def pack(row: dict, side: str) -> tuple:
        x = _unit(np.frombuffer(row[f"{side}_v"], kind).reshape(-1, row["dim"]))
        return np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_counts"], np.int64), x, x.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, home = None, None
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                row = {name: batch.column(k)[at] for k, name in enumerate(batch.schema.names)}
                row = {name: x.as_buffer() if isinstance(x, pa.BinaryScalar) else x.as_py() for name, x in row.items()}
                a, b = ((row["dim"], row[f"{side}_home"], row[f"{side}_part"]) for side in "ab")
                if a != last:  # the product meets a pack with one after another
                    last, home = a, pack(row, "a")
                normal = None
                if a[1] != b[1]:
                    gap = _gaps(centroids, a[1])[b[1]]
                    normal = (centroids[a[1]] - centroids[b[1]]) / gap
                found += compare(home, None if a == b else pack(row, "b"), normal, cosine, reach)
            some = [x for x in found if len(x[0])]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*some, strict=True)], names=["vec_id", "links", "label"])

    return run


def near_copies(vectors: DataFrame, cosine: float = COSINE, margin: float | None = None, id_column: str = "vec_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each vector: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are kept. Vectors of different length never link. Rows that repeat
    an id count as other vectors but are one node; a null id links with nothing.
    Labels and other columns aren't read.
    """
    spark = vectors.sparkSession
    if margin is None:
        margin = float(np.sqrt(2 - 2 * cosine) / 2)
    reach = 2 * margin + SLACK
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    good = good.select("vec_id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(17), "v", F.size("v")).alias("g"), F.size("v").alias("dim"), "v")
    with Scratch(spark) as scratch:
        keyed = scratch.table(good.drop("v"))
        classes = scratch.table(keyed.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim")))
        named = classes.drop("dim").withColumnRenamed("rep", "vec_id")
        common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
        centroids = np.zeros((0, 0))
        if common:
            dim, count = common[0]["dim"], common[0]["count"]
            draw = F.pmod(F.xxhash64(F.col("rep"), F.lit("cells")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / count) * (1 << 30))
            drawn = classes.where((F.col("dim") == dim) & draw).select("h", "g", F.col("rep").alias("vec_id")).limit(2 * SAMPLE)
            got = sorted(good.join(F.broadcast(drawn), ["h", "g", "vec_id"]).dropDuplicates(["h", "g", "vec_id"]).select("vec_id", "v").collect())
            if got:
                sample = _unit(np.array([r["v"] for r in got]))
                centroids = k_means(sample, max(1, min(MOST_CELLS, -(-count // CELL_ROWS))))
        one_each = named.groupBy("vec_id").agg(F.min(F.struct("h", "g", "n")).alias("c")).select("vec_id", "c.*")
        reps = good.join(one_each, ["h", "g", "vec_id"]).dropDuplicates(["h", "g", "vec_id"]).select("vec_id", "n", "dim", "v")
        placed = scratch.table(reps.mapInArrow(_place(centroids, kind), _PLACED))
        cells = cut(placed.groupBy("dim", "home").agg(F.ceil(F.count("*") / (WIDE * block_rows)).cast("int").alias("parts")))
        dealt = placed.join(broadcast_if_small(cells, cells.count(), 1 << 16), ["dim", "home"])
        dealt = dealt.select("dim", "home", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "n", "v")
        packs = scratch.table(dealt.groupBy("dim", "home", "part").applyInArrow(_pack(centroids, kind), _PACKS))
        side = lambda s: packs.select(*(F.col(c).alias(f"{s}_{c}") for c in packs.columns))
        # each two packs once, in the order that an even or odd sum gives, so that both sides' partitions have as much to do
        order = lambda s: F.struct(f"{s}_home", f"{s}_part")
        even = F.pmod(F.col("a_home") + F.col("a_part") + F.col("b_home") + F.col("b_part"), F.lit(2)) == 0
        once = (even & (order("a") <= order("b"))) | (~even & (order("a") > order("b")))
        near = F.get("a_least", F.col("b_home")) + F.get("b_least", F.col("a_home")) <= reach
        # two comparisons, since an equality would shuffle all packs of a length to one task
        pairs = side("a").crossJoin(side("b").hint("shuffle_replicate_nl")).where((F.col("a_dim") <= F.col("b_dim")) & (F.col("a_dim") >= F.col("b_dim")) & once & near)
        pairs = pairs.select(F.col("a_dim").alias("dim"), *(f"{s}_{c}" for s in "ab" for c in ("home", "part", "ids", "counts", "v")))
        found = pairs.mapInArrow(_compare_packs(centroids, kind, cosine, reach), "vec_id long, links long, label long")
        found = cut(found.groupBy("vec_id", "label").agg(F.sum("links").alias("links")))
        links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
        component = connected_components(found.select(F.col("vec_id").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "rep").withColumnRenamed("component", "c")
        member = keyed.select("vec_id", "h", "g").join(classes.drop("dim"), ["h", "g"])
        member = member.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(component, "rep", "left")
        good_rows = member.select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("c", "rep").alias("component_id"))
        good_rows = cut(good_rows)
    rest = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good_rows.union(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same over all pairs, for tables small enough for that.
ORACLE_SQL = """
with recursive v as (select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9),
r(node, reach) as (select vec_id, vec_id from embeddings union select r.node, l.b from r join l on r.reach = l.a),
c as (select node, min(reach) as component_id from r group by node)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept from embeddings e join c on c.node = e.vec_id
"""
