"""Intervals that don't overlap: after each one chosen comes the first that begins behind its end.

No loop walks over them: each interval finds the one that would follow it by an ordered pass, and the chain from the first
is marked by pointers of 1, 2, 4 ... steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candleforge.operators.ordering import in_ranges, kept


def with_next(intervals: DataFrame) -> DataFrame:
    """``intervals (series, begin, end)`` with ``next``, the least ``begin`` of the series behind ``end``; null without one, or if ``end`` is null.

    Beginnings and ends stand in one order that is dealt to ranges. Within a range the latest beginning is carried down, and a row a
    series and range tells what the ranges before it have.
    """
    begins = intervals.select("series", F.col("begin").alias("at"), F.lit(1).alias("kind"), F.col("begin").alias("found"))
    ends = intervals.where("end is not null").select("series", F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("found")).distinct()
    rows = in_ranges(begins.union(ends), F.col("series"), F.col("at").desc(), F.col("kind"))
    before = Window.partitionBy("part", "series").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("part", "series").agg(F.min("found").alias("least"))
    earlier = Window.partitionBy("series").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "series", F.min("least").over(earlier).alias("carried"))
    seen = rows.withColumn("found", F.last("found", ignorenulls=True).over(before)).where("kind = 0").join(parts, ["part", "series"])
    return intervals.join(seen.select("series", F.col("at").alias("end"), F.coalesce("found", "carried").alias("next")), ["series", "end"], "left").select(*intervals.columns, "next")


def chosen(intervals: DataFrame) -> DataFrame:
    """The rows of ``intervals`` (with ``series``, long ``begin`` and ``end``; a beginning once a series) that are chosen, with ``number`` from 1 in each series.

    An interval without end is the last of its series. Other columns stay; an empty table gives none.
    """
    links = kept(with_next(intervals.select("series", "begin", "end")).select("series", "begin", "next"))
    jumps, steps = [links], links
    while not steps.where("next is not null").isEmpty():
        ahead = steps.select("series", F.col("begin").alias("next"), F.col("next").alias("then"))
        steps = kept(steps.join(ahead, ["series", "next"], "left").select("series", "begin", F.col("then").alias("next")))
        jumps.append(steps)
    marked = kept(links.groupBy("series").agg(F.min("begin").alias("begin")))
    # every distance from the first is a sum of powers of two
    for step in reversed(jumps):
        reached = step.join(marked, ["series", "begin"], "left_semi").where("next is not null").select("series", F.col("next").alias("begin"))
        marked = kept(marked.union(reached).distinct())
    numbered = marked.withColumn("number", F.row_number().over(Window.partitionBy("series").orderBy("begin")).cast("long"))
    return intervals.join(numbered, ["series", "begin"]).select(*intervals.columns, "number")
