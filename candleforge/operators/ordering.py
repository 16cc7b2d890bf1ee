"""Ranks and running totals over a whole table, in as many tasks as it has ranges."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: computed once, and ranges that are drawn by a sample stay."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="candleforge-"))
    return df.checkpoint(eager=True)


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``part``, its range in ``order``, and ``place``, its row's place there from 0."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))


def _before(parts: DataFrame, value: Column, name: str) -> DataFrame:
    """``part, name``: ``value`` over the parts before, a row a part."""
    return parts.select("part", value.over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the number of each row in ``order`` from 1; the order has to decide between all rows."""
    rows = in_ranges(df, *order)
    offset = _before(rows.groupBy("part").agg(F.count("*").alias("n")), F.sum("n"), "offset")
    return rows.join(F.broadcast(offset), "part").withColumn(name, F.coalesce("offset", F.lit(0)) + F.col("place") + 1).drop("part", "place", "offset")


def running_equity(trades: DataFrame, *order: Column, value: str = "profit") -> DataFrame:
    """``trades`` with ``equity``, the total of ``value`` up to each row in ``order``, and ``high``, the greatest so far."""
    rows = in_ranges(trades, *order)
    up_to = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = _before(rows.groupBy("part").agg(F.sum(value).alias("s")), F.sum("s"), "offset")
    rows = rows.join(F.broadcast(offset), "part").withColumn("equity", F.coalesce("offset", F.lit(0.0)) + F.sum(value).over(up_to)).drop("offset")
    most = _before(rows.groupBy("part").agg(F.max("equity").alias("m")), F.max("m"), "most")
    return rows.join(F.broadcast(most), "part").withColumn("high", F.greatest("most", F.max("equity").over(up_to))).drop("part", "place", "most")
