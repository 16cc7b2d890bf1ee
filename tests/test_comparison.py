"""Signals and strategies beside each other, and the oldest conditions, on small tables."""

import datetime

import pytest

from candleforge.functions.compiler import Plan
from candleforge.operators import comparison
from candleforge.plans.combined import Combined, combined
from tests.test_market import frame, series

AT = [datetime.datetime(2024, 1, 1, h) for h in range(8)]


def test_signals_against_others(spark):
    shape = "symbol string, datetime timestamp_ntz, signal boolean"
    ours = spark.createDataFrame([("x", AT[0], True), ("x", AT[1], True), ("x", AT[2], False), ("x", AT[3], None), ("x", AT[4], True), ("x", AT[5], False), ("x", AT[5], True)], shape)
    theirs = spark.createDataFrame([("x", AT[0], True), ("x", AT[1], False), ("x", AT[2], True), ("x", AT[3], False), ("x", AT[5], True), ("y", AT[6], True)], shape)
    got = {(r.symbol, r.datetime.hour): r.verdict for r in comparison.compared(ours, theirs).collect()}
    assert got == {("x", 0): "both", ("x", 1): "ours_only", ("x", 2): "theirs_only", ("x", 3): "neither", ("x", 4): "missing", ("x", 5): "both", ("y", 6): "missing"}
    raw = spark.createDataFrame([("2024-01-01T00:00:00Z", "1.5"), ("2024-01-01T10:00:00+09:00", None), ("2024-01-01T11:00:00+09:00", " "), ("never", "1")], "time string, `low of it` string")
    got = comparison.from_chart(raw, "x", "low of it").orderBy("datetime").collect()
    assert [(r.datetime.hour, r.signal) for r in got] == [(9, True), (10, False), (11, False)]


def test_equity_on_a_common_axis_and_halves(spark):
    rows = [("a", k, AT[0], AT[k], float(k)) for k in range(5)] + [("b", 0, AT[0], AT[1], -2.0)]
    got = comparison.equity_by_share(spark.createDataFrame(rows, "series string, trade_number long, entry_time timestamp_ntz, exit_time timestamp_ntz, profit double")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, 0.0, 0.0), ("a", 2, 25.0, 1.0), ("a", 3, 50.0, 3.0), ("a", 4, 75.0, 6.0), ("a", 5, 100.0, 10.0), ("b", 1, 0.0, -2.0)]
    x = comparison.halves(frame(spark, series(101)), 0.7).toPandas()
    assert sorted(x.groupby("symbol").bar_index.agg(["min", "max"]).itertuples()) == [("X|in", 0, 69), ("X|out", 0, 30)]
    with pytest.raises(ValueError):
        comparison.halves(frame(spark, series(10)), 0.95)


def test_the_oldest_conditions(spark):
    x = series(300)
    plan = Plan()
    both = combined(plan, Combined(use_rsi=True, rsi_above=True, use_session=True, session_start=22, session_end=3, use_weekday=True, days=("tuesday",)), rsi=50)
    got = spark.sql(plan.sql("{b}", {"s": both, "none": combined(plan, Combined()), "never": combined(plan, Combined(use_weekday=True, days=()))}), b=frame(spark, x)).toPandas()
    assert got.none.all() and not got.never.any() and got.s.any()
    hit = got[got.s].datetime.dt
    assert set(hit.hour) <= {22, 23, 0, 1, 2} and set(hit.weekday) == {1}
    with pytest.raises(ValueError, match="threshold"):
        combined(plan, Combined(use_atr=True, atr_above=True))
    with pytest.raises(ValueError, match="unknown day"):
        combined(plan, Combined(use_weekday=True, days=("sunday",)))
