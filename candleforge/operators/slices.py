"""Indicators of one long series in many tasks.

A series is cut at the beginnings of days into slices. Each slice gets the bars before it that bounded windows
look back to; how many, the plan's stages tell. Windows that look back to the beginning are combined from the slice's own
bars and a state: sums, counts, maxima, last values and decayed means of each slice are taken
by one aggregation a stage, and carried from slice to slice, a row a slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candleforge.functions.compiler import SlicedPlan, State
from candleforge.functions.indicators import build
from candleforge.operators.kernels import with_kernels
from candleforge.operators.ordering import in_ranges, kept

#: Series whose cuts are broadcast: a row of a few numbers a slice each.
BROADCAST_SERIES = 10_000
KEYS = ["symbol", "timeframe"]


def indexed_in_ranges(bars: DataFrame) -> DataFrame:
    """``bars`` with ``bar_index`` counted from 0 in each series, by ranges of time instead of a task a series."""
    rows = in_ranges(bars, *[F.col(c) for c in (*KEYS, "datetime")])
    parts = rows.groupBy(*KEYS, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*KEYS, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(parts, [*KEYS, "part"]).withColumn("bar_index", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _cuts(bars: DataFrame, plan: SlicedPlan, slices: int) -> DataFrame:
    """A row a series with its slices: ``cuts array<struct<slice, start, end, from, edge0, ...>>``.

    ``edge{n}`` is the bar from which the columns below stage n are whole; ``from`` is where the slice's copies of earlier bars begin.
    """
    days = bars.groupBy(*KEYS, F.to_date("datetime").alias("day")).agg(F.min("bar_index").alias("first"), F.max("bar_index").alias("last"))
    days = days.groupBy(*KEYS).agg(F.sort_array(F.collect_list("first")).alias("days"), (F.max("last") + 1).alias("n"))
    at = "transform(sequence(0, {0} - 1), i -> array_max(filter(days, d -> d <= n * i div {0})))"
    starts = days.withColumn("starts", F.array_distinct(F.expr(at.format(int(slices)))))
    rows = starts.select(*KEYS, "days", "n", "starts", F.posexplode("starts").alias("slice", "start")).withColumn("end", F.coalesce(F.expr("get(starts, slice + 1)"), F.col("n")))
    edge = "start"
    for stage in reversed(range(len(plan.stages))):
        back, whole = plan.bars_back[stage], plan.days_back[stage]
        at = edge
        if back or whole >= 0:
            # the beginning of the day of the first bar needed, and whole days before it; the inner array keeps the bar from being worked out anew for each day
            at = f"transform(array({edge} - {back}), a -> get(days, greatest(size(filter(days, d -> d <= a)) - 1 - {max(whole, 0)}, 0)))[0]"
        edge = f"edge{stage}"
        rows = rows.withColumn(edge, F.expr(at))
    rows = rows.withColumn("from", F.col(edge))
    used = [f"edge{stage}" for stage in sorted(plan.states)]
    return rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("slice", "start", "end", "from", *used))).alias("cuts"))


def sliced(bars: DataFrame, plan: SlicedPlan, slices: int) -> DataFrame:
    """A row for each bar of each slice, with ``slice``, ``start_`` (its first own bar), edges and, for own bars, segments of the stages with states.

    The segment is the last slice whose edge has been passed: the slices behind it count the bar by their state.
    """
    cuts = _cuts(bars, plan, slices)
    cuts = kept(cuts)
    small = cuts.count() <= BROADCAST_SERIES
    rows = bars.join(F.broadcast(cuts) if small else cuts, KEYS)
    here = F.explode(F.filter("cuts", lambda c: (c["from"] <= F.col("bar_index")) & (F.col("bar_index") < c["end"]))).alias("cut")
    out = rows.select(*bars.columns, here, *[F.expr(f"size(filter(cuts, c -> c.edge{n} <= bar_index)) - 1").cast("int").alias(f"segment{n}_") for n in plan.states])
    edges = [F.col(f"cut.edge{n}").alias(f"edge{n}_") for n in plan.states]
    return out.select(*bars.columns, F.col("cut.slice").alias("slice"), F.col("cut.start").alias("start_"), *edges, *[f"segment{n}_" for n in plan.states])


def _totals(states: list[State], stage: int) -> tuple[dict[str, str], dict[str, str]]:
    """Columns below, and aggregates of a piece (a segment's own bars in one slice) for each state."""
    behind = f"over (partition by symbol, timeframe, slice, segment{stage}_ order by bar_index rows between 1 following and unbounded following)"
    below, out = {}, {}
    for s in states:
        below[f"x_{s.name}"] = s.x
        x = f"x_{s.name}"
        if s.kind == "mean":
            below[f"k_{s.name}"] = f"count({s.x}) {behind}"
            decayed = f"sum({1 - s.keep!r} * {x} * power({s.keep!r}, k_{s.name}))"
            out[s.name] = f"struct(count({x}) as m, {decayed} as d, min_by({x}, case when {x} is not null then bar_index end) as first)"
        elif s.kind == "last":
            out[s.name] = f"max_by({x}, case when {x} is not null then bar_index end)"
        else:
            out[s.name] = f"{s.kind}({x})"
    return below, out


def _fold(s: State, kind: str) -> str:
    """The state after the pieces ``p`` in order."""
    if s.kind == "mean":
        begin = f"e.d + power({s.keep!r}, e.m - 1) * {s.keep!r} * e.first"
        return f"aggregate(transform(p, v -> v.{s.name}), cast(null as double), (y, e) -> case when e.m = 0 then y when y is null then {begin} else power({s.keep!r}, e.m) * y + e.d end)"
    step = {"sum": "case when e is null then y else coalesce(y, 0) + e end", "count": "coalesce(y, 0) + e", "max": "greatest(y, e)", "last": "coalesce(e, y)"}[s.kind]
    return f"aggregate(transform(p, v -> v.{s.name}), cast(null as {kind}), (y, e) -> cast({step} as {kind}))"


def _with_states(source: DataFrame, plan: SlicedPlan, stage: int) -> DataFrame:
    """``source`` with the states of a stage, for which the stages below it are evaluated once."""
    states, spark = plan.states[stage], source.sparkSession
    below, aggregates = _totals(states, stage)
    own = spark.sql(plan.sql("{source}", below, f"symbol, timeframe, slice, bar_index, segment{stage}_ as segment", stages=stage, where="bar_index >= start_"), source=source)
    pieces = own.groupBy(*KEYS, "segment", "slice").agg(*[F.expr(x).alias(n) for n, x in aggregates.items()])
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    ordered = pieces.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("segment", "slice", *aggregates)), True).alias("all"))
    ordered = ordered.withColumn("slice", F.explode(F.array_distinct(F.expr("transform(all, v -> v.slice)"))))
    known = ordered.withColumn("p", F.expr("filter(all, v -> v.segment < slice)"))
    values = kept(known.select(*KEYS, "slice", *[F.expr(_fold(s, kinds[s.name])).alias(s.name) for s in states]))
    return source.join(values, [*KEYS, "slice"])


def evaluate(bars: DataFrame, outputs: Callable[[SlicedPlan], dict[str, str]], slices: int, keys: str = "symbol, datetime") -> DataFrame:
    """The expressions that ``outputs`` builds on a plan, on each bar, by ``slices`` slices a series (fewer if it has fewer days).

    Equal to the plan's own SQL but for the last bits of sums. Supertrend, parabolic stop and patterns are passes over a whole
    series and come before the cut. Series without bars give no rows.
    """
    plan = SlicedPlan()
    columns = outputs(plan)
    bars = with_kernels(bars, " ".join([*columns.values(), *plan.made]))
    source = kept(sliced(bars, plan, slices))
    for stage in sorted(plan.states):
        source = _with_states(source, plan, stage)
    return bars.sparkSession.sql(plan.sql("{source}", columns, keys, where="bar_index >= start_"), source=source)


def indicators(bars: DataFrame, names: list[str], slices: int) -> DataFrame:
    """The named indicators with default parameters on each bar."""
    return evaluate(bars, lambda plan: {f"v_{n}" if n in bars.columns or n in ("hour", "month", "weekday") else n: build(plan, n) for n in names}, slices)
