"""Indicators and pattern marks on the last bars of a series, as a chart asks for them.

How many earlier bars an expression needs is told by the plan: bounded windows add up from stage to stage, recursive means
take as many as leave less than ``TOLERANCE`` of what came before, and days begin with their first bar. Only
these bars are read. Sums and last values since the beginning need the whole series, which is read then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions.compiler import Plan
from candleforge.functions.indicators import build
from candleforge.operators import patterns
from candleforge.operators.kernels import with_kernels

TOLERANCE = 1e-12
KEYS = ["symbol", "timeframe"]


@dataclass
class TailPlan(Plan):
    """Stages that also count what their means look back, and whether anything needs the whole series."""

    whole: bool = False

    def running(self, kind: str, x: str, before: bool = False) -> str:
        self.whole = True
        return super().running(kind, x, before)

    def ewm(self, x: str, alpha: float) -> str:
        out = super().ewm(x, alpha)
        if alpha < 1:
            at = self.level[out]
            self.bars_back[at] = max(self.bars_back[at], ceil(log(TOLERANCE) / log(1 - alpha)))
        return out

    def warm_up(self) -> tuple[int, int] | None:
        """``(bars, days)`` before the first bar wanted, the days on top of the bars; None for all of them."""
        if self.whole:
            return None
        return sum(self.bars_back), sum(d + 1 for d in self.days_back if d >= 0)


def last_bars(bars: DataFrame, k: int) -> DataFrame:
    """``symbol, timeframe, first``: the index of the first of the last ``k`` bars of each series, from the indices alone."""
    return bars.groupBy(*KEYS).agg(F.greatest(F.max("bar_index") - k + 1, F.lit(0)).alias("first"))


def tail(bars: DataFrame, k: int, outputs: Callable[[Plan], dict[str, str]], series: tuple[str, str] | None = None, keys: str = "symbol, datetime") -> DataFrame:
    """The expressions that ``outputs`` builds, on the last ``k`` bars of each series, or of one ``(symbol, timeframe)``.

    Equal to the evaluation of whole series up to ``TOLERANCE`` of what means remember. For one series the bars are cut by
    a number, which reaches the scan; for all by a join with a row a series. Fewer than ``k`` bars are all given.
    """
    plan = TailPlan()
    columns = outputs(plan)
    wanted = " ".join([*columns.values(), *plan.made])
    needed = plan.warm_up()
    if series is not None:
        bars = bars.where((F.col("symbol") == series[0]) & (F.col("timeframe") == series[1]))
    if with_kernels(bars, wanted) is not bars:
        needed = None
        bars = with_kernels(bars, wanted)
    first = last_bars(bars, k)
    if needed and needed[1]:
        # whole days: the beginning of the day of the first bar, and as many days before as the stages name
        days = bars.groupBy(*KEYS, F.to_date("datetime").alias("day")).agg(F.min("bar_index").alias("begin")).groupBy(*KEYS).agg(F.sort_array(F.collect_list("begin")).alias("days"))
        back = f"get(days, greatest(size(filter(days, d -> d <= first - {needed[0]})) - {needed[1]}, 0))"
        first = first.join(days, KEYS).select(*KEYS, "first", F.least(F.expr(back), "first").alias("from"))
    else:
        first = first.withColumn("from", F.col("first") - (needed[0] if needed else F.col("first")))
    if series is not None:
        row = first.first()
        if row is None:
            return bars.sparkSession.sql(plan.sql("{bars}", columns, keys), bars=bars)
        read, end = bars.where(F.col("bar_index") >= row["from"]), str(row["first"])
    else:
        read, end = bars.join(first.withColumnRenamed("first", "first_"), KEYS).where("bar_index >= from"), "first_"
    return bars.sparkSession.sql(plan.sql("{bars}", columns, keys, where=f"bar_index >= {end}"), bars=read)


def chart(bars: DataFrame, k: int, wanted: dict[str, tuple[str, dict]], series: tuple[str, str] | None = None) -> DataFrame:
    """The last ``k`` bars with a column for each of ``wanted``, ``name: (indicator, parameters)``."""
    return tail(bars, k, lambda plan: {name: build(plan, i, **p) for name, (i, p) in wanted.items()}, series, keys="symbol, timeframe, bar_index, datetime, open, high, low, close, volume")


def marks(bars: DataFrame, k: int) -> DataFrame:
    """Chart patterns whose event is on one of the last ``k`` bars, with its time; their passes read whole series."""
    found = patterns.detect(bars)
    times = bars.select(*KEYS, F.col("bar_index").alias("event_bar"), F.col("datetime").alias("event_time"))
    return found.join(last_bars(bars, k), KEYS).where("event_bar >= first").drop("first").join(times, [*KEYS, "event_bar"])
