"""Series in slices and the last bars of a chart against whole series."""

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleforge.functions.compiler import Plan
from candleforge.functions.indicators import build
from candleforge.operators import bars as B
from candleforge.operators import slices, tails
from candleforge.plans import market_queries as M
from tests.test_market import frame, series

#: Families that look back to the beginning by each kind of state, and by days.
STATEFUL = ["ind_averages", "ind_structure", "ind_volume", "ind_days"]


@pytest.fixture(scope="module")
def bars(spark):
    """A long series of half hours with gaps, a short one, and one of a single day."""
    long = series(1500, seed=7)
    long["datetime"] = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=30 * i + (1440 * (i // 200))) for i in range(len(long))]
    x = frame(spark, long).unionByName(frame(spark, series(130, seed=8).assign(symbol="Y"))).unionByName(frame(spark, series(9, seed=9).assign(symbol="Z")))
    return x.persist()


def whole(spark, bars, names):
    plan = Plan()
    out = {f"c{i}": build(plan, n) for i, n in enumerate(names)}
    return spark.sql(plan.sql("{b}", out), b=bars).toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)


def same(a, b, names, tolerance=1e-6):
    assert len(a) == len(b)
    for i, n in enumerate(names):
        x, y = a[f"c{i}"].astype(float).to_numpy(), b[f"c{i}"].astype(float).to_numpy()
        assert np.allclose(x, y, rtol=tolerance, atol=tolerance, equal_nan=True), (n, np.flatnonzero(~np.isclose(x, y, rtol=tolerance, atol=tolerance, equal_nan=True))[:5])


@pytest.mark.parametrize("family", STATEFUL)
def test_slices_equal_whole_series(spark, bars, family):
    names = M.FAMILIES[family]
    got = slices.evaluate(bars, lambda plan: {f"c{i}": build(plan, n) for i, n in enumerate(names)}, 6).toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)
    same(whole(spark, bars, names), got, names)


def test_one_series_is_many_tasks(spark, bars):
    """The slices of one series stand in several partitions, each bar is an own bar of one slice, and copies are bounded by the look-back."""
    plan = slices.SlicedPlan()
    build(plan, "sma", length=20)
    build(plan, "obv")
    cut = slices.sliced(bars.where("symbol = 'X'"), plan, 8)
    own = cut.where("bar_index >= start_")
    assert own.count() == 1500 and own.select("bar_index").distinct().count() == 1500
    assert cut.select("slice").distinct().count() == 8
    assert cut.count() < 1500 + 8 * (20 + 3 * 48)
    dealt = cut.repartition(8, "symbol", "timeframe", "slice").select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt > 2
    text = slices.evaluate(bars, lambda p: {"x": build(p, "obv")}, 8)._jdf.queryExecution().executedPlan().toString()
    assert "slice" in text.split("Window")[1] and "hashpartitioning(symbol" in text


def test_indices_in_ranges_equal_those_of_a_window(spark, bars):
    plain = bars.drop("bar_index").repartition(5)
    got = {(r.symbol, r.datetime): r.bar_index for r in slices.indexed_in_ranges(plain).collect()}
    assert got == {(r.symbol, r.datetime): r.bar_index for r in B.indexed(plain).collect()} and len(got) == 1639


TAIL = ["sma", "rsi", "stochastic_d", "vwap", "adr", "atr_rolling_mean", "ichimoku_senkou_b", "fvg_bullish", "obv", "supertrend_line"]


@pytest.mark.parametrize("names", [TAIL[:4], TAIL[4:8], TAIL[8:]])
def test_tails_equal_whole_series(spark, bars, names):
    from candleforge.operators.kernels import with_kernels

    build_all = lambda plan: {f"c{i}": build(plan, n) for i, n in enumerate(names)}
    plan = Plan()
    want = whole(spark, with_kernels(bars, " ".join(build_all(plan).values())), names)
    want = want.groupby("symbol").tail(40).reset_index(drop=True)
    got = tails.tail(bars, 40, build_all).toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)
    same(want, got, names, 1e-8)


def test_a_tail_reads_what_it_needs(spark, bars, tmp_path):
    bars.where("symbol = 'X'").coalesce(1).sortWithinPartitions("bar_index").write.parquet(str(tmp_path / "x"))
    stored = spark.read.parquet(str(tmp_path / "x"))
    plan = tails.TailPlan()
    build(plan, "sma", length=20)
    assert plan.warm_up() == (19, 0)
    build(plan, "rsi")
    assert plan.warm_up()[0] > 300
    build(plan, "obv")
    assert plan.warm_up() is None
    got = tails.chart(stored, 10, {"mean": ("sma", {"length": 20})}, ("X", "1h"))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"bar_index#\d+L? >= 1471", text.split("FileScan")[0]) and "IsNotNull(bar_index)" in text
    assert [r.bar_index for r in got.orderBy("bar_index").collect()] == list(range(1490, 1500))
    assert tails.chart(stored, 10, {"mean": ("sma", {})}, ("none", "1h")).count() == 0


def test_marks_are_the_latest_pattern_events(spark, bars):
    from candleforge.operators import patterns

    want = [(r.symbol, r.pattern_id, r.status, r.event_bar) for r in patterns.detect(bars).collect() if r.event_bar >= {"X": 1500, "Y": 130, "Z": 9}[r.symbol] - 60]
    got = [(r.symbol, r.pattern_id, r.status, r.event_bar) for r in tails.marks(bars, 60).collect()]
    assert sorted(got) == sorted(want) and got
