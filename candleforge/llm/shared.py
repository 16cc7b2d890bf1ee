"""Scratch tables in the shared folder, connected components and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none, one is set; on a cluster a folder has to be named, since the
    driver's own isn't seen by executors.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="candleforge-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


class Scratch:
    """Tables written to the shared folder, dropped together when the operator has its result.

    A table survives the loss of executors and cuts the lineage. ``with`` drops
    everything on exit, so a result has to be cut by :func:`cut` before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.drop()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are ``most`` at most; else as it is, to be shuffled."""
    return F.broadcast(df) if rows <= most else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of the undirected graph ``edges(a, b)`` of longs.

    ``component`` is the smallest node reachable. A round merges every node into its
    smallest neighbour, follows these steps twice and relabels the edges, so that
    at least half of the nodes that still have edges vanish. Minima are combined before
    they are shuffled; a node with very many edges is only a large side of a
    join, which adaptive execution splits. Loops and repeated edges don't matter;
    null ends are left out; without edges the result is empty.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        e = scratch.table(edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = None
        for _ in range(max_rounds):
            ends = e.union(e.select("b", "a"))
            step = scratch.table(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")))
            for _ in range(2):
                step = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("up")), "to", "left").select("node", F.coalesce("up", "to").alias("to"))
            step = scratch.table(step)
            if labels is None:
                labels = step.withColumnRenamed("to", "component")
            else:
                labels = labels.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = scratch.table(labels)
            moved = e.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            e = scratch.table(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
            if e.isEmpty():
                return cut(labels)
    raise RuntimeError(f"not connected after {max_rounds} rounds")
