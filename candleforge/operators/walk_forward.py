"""Walk-forward tests over the trades of many series: each window ranks the series by its training part and proves them on its test part.

Trades are dealt to their windows by numbers (an equality of keys, no range join), a trade to as many as hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candleforge.operators.analysis import NO_LOSS

#: Fixed weights of the score: share of windows passed, factor, win rate, profit against drawdown, number of trades, profit.
SCORE = {"passed": 35.0, "factor": 20.0, "wins": 10.0, "drawdown": 20.0, "trades": 5.0, "profit": 0.1}
#: What a test needs to pass.
LEAST_FACTOR, LEAST_TRADES = 1.0, 5


@dataclass(frozen=True)
class Windows:
    """``train`` units to fit and ``test`` to prove, each window ``step`` later; units are days, months or years from the first day on."""

    train: int = 10
    test: int = 1
    step: int = 1
    unit: str = "year"

    def __post_init__(self) -> None:
        if min(self.train, self.test, self.step) < 1:
            raise ValueError("train, test and step take one unit at least")
        if self.unit not in ("day", "month", "year"):
            raise ValueError(f"unknown unit: {self.unit}")

    def number(self, at: Column, first: Column) -> Column:
        """Whole units from the day ``first`` to ``at``."""
        day = F.to_date(at)
        return F.datediff(day, first) if self.unit == "day" else F.floor(F.months_between(day, first) / (12 if self.unit == "year" else 1)).cast("int")

    def begin(self, first: Column, units: Column) -> Column:
        return F.date_add(first, units) if self.unit == "day" else F.add_months(first, units * (12 if self.unit == "year" else 1))


def calendar(rows: DataFrame, windows: Windows, time: str = "entry_time") -> DataFrame:
    """``window_id, number, train_start, train_end, test_start, test_end``: all windows that end by the last day of ``rows``; ends are exclusive."""
    days = rows.agg(F.min(F.to_date(time)).alias("first"), F.max(F.to_date(time)).alias("last"))
    most = windows.number(F.col("last"), F.col("first")) - (windows.train + windows.test)
    each = days.where(most >= 0).select("first", F.explode(F.sequence(F.lit(0), most, F.lit(windows.step))).alias("number"))
    at = lambda n: windows.begin(F.col("first"), F.col("number") + n)
    return each.select((F.col("number") / windows.step + 1).cast("long").alias("window_id"), "number", at(0).alias("train_start"), at(windows.train).alias("train_end"), at(windows.train).alias("test_start"), at(windows.train + windows.test).alias("test_end"), "first")


def parts(trades: DataFrame, windows: Windows, time: str = "entry_time") -> DataFrame:
    """``window_id, series, part, trades, net_profit, win_rate, profit_factor, max_dd`` of each series in the ``train`` and ``test`` part of each window; parts without trades are left out."""
    dates = calendar(trades, windows, time)
    whole = dates.agg(F.first("first").alias("first"), F.max("number").alias("most"))
    numbered = trades.crossJoin(F.broadcast(whole)).withColumn("unit", windows.number(F.col(time), F.col("first")))  # a single row
    # the windows that hold a unit begin at most train + test - 1 units before it, at a multiple of the step
    lo = F.ceil(F.greatest(F.col("unit") - (windows.train + windows.test - 1), F.lit(0)) / windows.step).cast("int") * windows.step
    hi = F.least(F.col("unit"), F.col("most"))
    held = numbered.where(lo <= hi).withColumn("number", F.explode(F.sequence(lo, hi, F.lit(windows.step))))
    held = held.withColumn("part", F.when(F.col("unit") < F.col("number") + windows.train, "train").otherwise("test"))
    key = ["number", "series", "part"]
    up_to = Window.partitionBy(*key).orderBy("exit_time", "trade_number").rowsBetween(Window.unboundedPreceding, 0)
    run = held.withColumn("equity", F.sum("profit").over(up_to)).withColumn("high", F.max("equity").over(up_to))
    gain, loss = F.sum(F.greatest("profit", F.lit(0.0))), F.sum(F.greatest(-F.col("profit"), F.lit(0.0)))
    found = run.groupBy(*key).agg(F.count("*").alias("trades"), F.sum("profit").alias("net_profit"), (F.count(F.when(F.col("profit") > 0, 1)) * 100 / F.count("*")).alias("win_rate"), gain.alias("gain"), loss.alias("loss"), F.max(F.col("high") - F.col("equity")).alias("max_dd"))
    factor = F.when(F.col("loss") > 0, F.try_divide("gain", "loss")).when(F.col("gain") > 0, NO_LOSS).otherwise(0.0)
    return found.select((F.col("number") / windows.step + 1).cast("long").alias("window_id"), "series", "part", "trades", "net_profit", "win_rate", factor.alias("profit_factor"), "max_dd")


_MEASURES = ["trades", "net_profit", "win_rate", "profit_factor", "max_dd"]


def proven(trades: DataFrame, windows: Windows, top: int | None = 1, by: str = "net_profit", least_train: int = 1, least_factor: float = LEAST_FACTOR, least_trades: int = LEAST_TRADES, time: str = "entry_time") -> DataFrame:
    """A row for each window and each of its ``top`` series (all, if None), with ``train_*`` and ``test_*`` measures, ``rank`` and ``passed``.

    Series need ``least_train`` trades in the training part; the best by ``by`` come first, ties by series. A test passes with the
    factor, the trades and a profit; without trades all its measures are 0. Windows without trained series have no row.
    """
    x = parts(trades, windows, time)
    side = lambda p: x.where(F.col("part") == p).select("window_id", "series", *[F.col(c).alias(f"{p}_{c}") for c in _MEASURES])
    order = Window.partitionBy("window_id").orderBy(F.round(f"train_{by}", 6).desc(), "series")
    train = side("train").where(F.col("train_trades") >= least_train).withColumn("rank", F.row_number().over(order).cast("long"))
    train = train if top is None else train.where(F.col("rank") <= top)
    both = train.join(side("test"), ["window_id", "series"], "left").fillna(0)
    passed = (F.col("test_profit_factor") >= least_factor) & (F.col("test_trades") >= least_trades) & (F.col("test_net_profit") > 0)
    dates = calendar(trades, windows, time).select("window_id", "train_start", "train_end", "test_start", "test_end")
    return both.withColumn("passed", passed).join(dates, "window_id")


def _score(windows: Column) -> dict[str, Column]:
    """Aggregates of tests over ``windows`` of them."""
    return {
        "total_windows": windows, "passed_windows": F.count(F.when(F.col("passed"), 1)), "oos_total_profit": F.coalesce(F.sum("test_net_profit"), F.lit(0.0)),
        "oos_avg_pf": F.coalesce(F.sum("test_profit_factor"), F.lit(0.0)) / windows, "oos_avg_win_rate": F.coalesce(F.sum("test_win_rate"), F.lit(0.0)) / windows,
        "oos_worst_dd": F.coalesce(F.max("test_max_dd"), F.lit(0.0)), "oos_total_trades": F.coalesce(F.sum("test_trades"), F.lit(0)),
    }


def _scored(x: DataFrame) -> DataFrame:
    """With the pass rate, the mean profit and ``wf_score``, from 0 to 190; 0 without trades."""
    bound = lambda c, most: F.greatest(F.lit(0.0), F.least(c, F.lit(most)))
    profit, dd = F.col("oos_total_profit"), F.col("oos_worst_dd")
    terms = {
        "passed": F.col("pass_rate"), "factor": bound(F.col("oos_avg_pf") / 2, 2.0), "wins": bound(F.col("oos_avg_win_rate") / 60, 2.0),
        "drawdown": F.when(dd <= 0, 1.0).otherwise(bound(F.try_divide(profit, dd), 5.0)), "trades": F.least(F.col("oos_total_trades") / 100, F.lit(2.0)), "profit": bound(profit, 100.0),
    }
    score = sum((terms[k] * w for k, w in SCORE.items()), F.lit(0.0))
    x = x.withColumn("pass_rate", F.coalesce(F.try_divide("passed_windows", "total_windows"), F.lit(0.0))).withColumn("oos_avg_profit", F.coalesce(F.try_divide("oos_total_profit", "total_windows"), F.lit(0.0)))
    return x.withColumn("wf_score", F.round(F.when(F.col("oos_total_trades") > 0, score).otherwise(0.0) + 1e-9, 6))


def summary(rows: DataFrame) -> DataFrame:
    """One row for all rows of :func:`proven`: windows, passes, means of the tests and ``wf_score``."""
    n = F.greatest(F.count("*"), F.lit(1))
    return _scored(rows.agg(*[v.alias(k) for k, v in (_score(n) | {"total_windows": F.count("*")}).items()]))


def scores(trades: DataFrame, windows: Windows, least_factor: float = LEAST_FACTOR, least_trades: int = LEAST_TRADES, time: str = "entry_time") -> DataFrame:
    """``series, wf_score`` and what it is made of, for each series over the tests of all windows; windows in which it doesn't trade count."""
    n = calendar(trades, windows, time).agg(F.count("*").alias("windows"))
    tests = parts(trades, windows, time).where("part = 'test'").select("series", *[F.col(c).alias(f"test_{c}") for c in _MEASURES])
    passed = (F.col("test_profit_factor") >= least_factor) & (F.col("test_trades") >= least_trades) & (F.col("test_net_profit") > 0)
    every = trades.select("series").distinct().join(tests.withColumn("passed", passed), "series", "left").crossJoin(F.broadcast(n))  # a single row
    one = F.greatest(F.first("windows"), F.lit(1))
    return _scored(every.groupBy("series").agg(*[v.alias(k) for k, v in (_score(one) | {"total_windows": F.first("windows")}).items()]))
