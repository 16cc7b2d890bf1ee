"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the greatest length are cut into pieces; nothing is dropped.
Pieces are dealt to shards by a hash of id, piece and length; a shard is sorted by them and packed in
runs of a bounded number of pieces, so that the bins depend on the rows alone, not on how Spark reads them:
by falling length, every piece goes to the open bin that it leaves the least room
in; if none has room, a bin is opened of the length that costs least for what can
still fill it. This is done for several rules for opening, the cheapest packing is
taken, and finally each bin shrinks to the least permitted length of its contents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Permitted lengths and what a sequence of each costs: its positions, its attention and a fixed part.
CAPACITIES = {c: c + c * c / 16384 + 32 for c in (512, 1024, 2048, 4096)}
SHARD_ROWS = 50_000


def best_fit(lengths: np.ndarray, capacities: Mapping[int, float], opening: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(bin of each item, used length of each bin)``; bins are opened with lengths of ``opening``."""
    order = np.argsort(-lengths, kind="stable")
    greatest = max(capacities)
    left_count = np.bincount(lengths, minlength=greatest + 1)[: greatest + 1].astype(np.int64)
    mass = np.cumsum(left_count * np.arange(greatest + 1))  # of all items up to a length
    room: list[list[int]] = [[] for _ in range(greatest + 1)]
    rooms, opened, used, where = 0, [], [], np.zeros(len(lengths), np.int64)
    placed_of_length, current = 0, -1
    for i in order.tolist():
        n = int(lengths[i])
        if n != current:
            current, placed_of_length = n, 0
        fits = rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                rooms ^= 1 << r
        else:
            b, best = len(used), None
            for c in opening:
                if c >= n:
                    rest = c - n
                    # what is left are items no longer than this one
                    filler = int(mass[min(rest, n)]) - (n * (placed_of_length + 1) if rest >= n else 0)
                    price = capacities[c] / (n + min(rest, filler))
                    if best is None or price <= best[0]:
                        best = (price, c)
            c = best[1] if best else min(c for c in capacities if c >= n)
            opened.append(c)
            used.append(0)
            r = c
        placed_of_length += 1
        where[i] = b
        used[b] += n
        if r > n:
            if not room[r - n]:
                rooms |= 1 << (r - n)
            room[r - n].append(b)
    return where, np.array(used, np.int64)


def downsize(used: np.ndarray, capacities: Mapping[int, float]) -> np.ndarray:
    sizes = np.array(sorted(capacities), np.int64)
    return sizes[np.searchsorted(sizes, used)] if len(used) else np.zeros(0, np.int64)


def pack(lengths: np.ndarray, capacities: Mapping[int, float] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin of each item, used length, final length of each bin)`` of the cheapest packing found."""
    sizes = sorted(capacities)
    best = None
    for opening in [sizes, *([c] for c in sizes[1:])]:
        where, used = best_fit(lengths, capacities, opening)
        final = downsize(used, capacities)
        cost = sum(capacities[c] for c in final.tolist())
        if best is None or cost < best[0]:
            best = (cost, where, used, final)
    return best[1:] if best else (np.zeros(0, np.int64),) * 3


_BINS = "bin_id long, capacity int, used int, doc_id long, piece int, piece_start long, piece_length int"


def _pack_shard(capacities: Mapping[int, float], most: int):
    def packed(given: list[pa.RecordBatch], base: int) -> pa.Table:
        rows = pa.Table.from_batches(given)
        where, used, final = pack(rows.column("piece_length").to_numpy(), capacities)
        order = np.lexsort((np.arange(len(where)), where))
        table = pa.table({"bin_id": pa.array(where + base), "capacity": pa.array(final[where], pa.int32()), "used": pa.array(used[where], pa.int32()), **{n: rows.column(n) for n in ("doc_id", "piece", "piece_start", "piece_length")}})
        return table.take(pa.array(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while n + batch.num_rows >= most:  # a full run of the shard
                held.append(batch.slice(0, most - n))
                batch = batch.slice(most - n)
                yield from (table := packed(held, base)).to_batches(max_chunksize=10_000)
                base, held, n = table.column("bin_id")[-1].as_py() + 1, [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield from packed(held, base).to_batches(max_chunksize=10_000)

    return run


def pack_documents(docs: DataFrame, length, capacities: Mapping[int, float] = CAPACITIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece: ``bin_id, capacity, used, doc_id, piece, piece_start, piece_length``.

    ``length`` is a column of the lengths of ``docs``; null or less than 1 counts
    as 1 (the end mark). Null ids and repeated rows are packed like others; a table
    without rows gives no bins. Equal lengths keep the order of id (nulls first) and piece. Columns other than
    the id and those of ``length`` aren't read. Texts of any length are packed whole, in as many pieces as it takes.
    """
    greatest = max(capacities)
    size = F.greatest(F.coalesce(length.cast("long"), F.lit(1)), F.lit(1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    pieces = rows.select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / greatest).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * greatest
    pieces = pieces.select("doc_id", "piece", start.alias("piece_start"), F.least(F.col("size") - start, F.lit(greatest)).cast("int").alias("piece_length"))
    shards = max(1, -(-docs.count() // shard_rows))
    keys = ["doc_id", "piece", "piece_length"]
    return pieces.repartition(shards, *keys).sortWithinPartitions(*keys).mapInArrow(_pack_shard(dict(capacities), shard_rows), _BINS)


def word_length(text: str = "text"):
    """Words of a text and one end mark."""
    return F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")) + 1


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, word_length())
