"""Rankings, running totals and walk-forward against pandas, and the older filters against plain readings."""

import datetime

import numpy as np
import pandas as pd
import pytest

from candleforge.functions.compiler import SPARK, Plan
from candleforge.operators import ordering
from candleforge.operators import rankings as R
from candleforge.operators.backtest import Bars, Simulator, Strategy, walk_forward
from candleforge.plans import signals

F = ordering.F


def results_frame(rng, n):
    x = pd.DataFrame({"series": [f"s{i:03d}" for i in range(n)], "trades": rng.integers(1, 200, n).astype(float)})
    for c in ("profit_factor", "net_profit", "max_dd", "win_rate", "expected_value", "year_stability", "month_stability", "overall_stability", "walk_forward_score", "recovery_factor", "max_consecutive_losses"):
        x[c] = rng.integers(0, 40, n) / 4
    return x


def test_weighted_ranking_equals_pandas(spark):
    x = results_frame(np.random.default_rng(1), 300)
    x["walk_forward_score"] = 0.0
    given = spark.createDataFrame(x).repartition(7)
    limits = R.Thresholds(trades=20, profit_factor=1.0, max_dd=9.0, win_rate=2.0)
    y = x[(x.trades >= 20) & (x.profit_factor >= 1) & (x.max_dd <= 9) & (x.win_rate >= 2)].copy()
    total = 0
    for k, w in R.WEIGHTS.items():
        lo, hi = y[k].min(), y[k].max()
        total = total + w * (1.0 if hi == lo else (hi - y[k]) / (hi - lo) if k == "max_dd" else (y[k] - lo) / (hi - lo))
    y["rank_score"] = (total + 1e-9).round(6)
    y = y.sort_values(["rank_score", "profit_factor", "net_profit", "year_stability", "month_stability", "win_rate", "series"], ascending=[False] * 6 + [True])
    got = R.weighted(given, limits).toPandas().sort_values("rank")
    assert got.series.tolist() == y.series.tolist() and got["rank"].tolist() == list(range(1, len(y) + 1))
    assert np.allclose(got.rank_score, y.rank_score, atol=2e-6)
    assert R.weighted(given, limits, top=5).count() == 5


def test_ten_rankings_and_exclusions(spark):
    x = results_frame(np.random.default_rng(2), 120)
    given = spark.createDataFrame(x)
    got = R.ten_rankings(given).toPandas()
    for name, order in R.RANKINGS.items():
        keys = order.split()
        want = x.sort_values([*(k.lstrip("-") for k in keys), "series"], ascending=[*(k[0] != "-" for k in keys), True]).series.tolist()
        assert got[got.ranking == name].sort_values("rank").series.tolist() == want
    out = R.Exclusions(minimum_trades=50, maximum_drawdown=8, maximum_consecutive_losses=9, minimum_pf=1).excluded(given.columns)
    want = x[(x.trades >= 50) & (x.max_dd <= 8) & (x.max_consecutive_losses <= 9) & (x.profit_factor >= 1)].series.tolist()
    assert sorted(r.series for r in given.where(~out).collect()) == want
    sided = spark.createDataFrame([("a", "long", "x"), ("b", "short", "y"), ("c", None, "x")], "series string, direction string, session_name string")
    left = lambda **k: [r.series for r in sided.where(~R.Exclusions(**k).excluded(sided.columns)).collect()]
    assert left(exclude_long=True) == ["b", "c"] and left(exclude_short=True) == ["a", "c"] and left(only_session="x") == ["a", "c"]


def test_running_totals_over_ranges(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": rng.permutation(5000), "profit": rng.integers(-50, 50, 5000).astype(float)})
    got = ordering.running_equity(spark.createDataFrame(x).repartition(5), F.col("k")).toPandas().sort_values("k")
    want = x.sort_values("k").profit.cumsum()
    assert np.allclose(got.equity, want) and np.allclose(got.high, want.cummax())
    assert ordering.ranked(spark.createDataFrame(x).limit(0), F.col("k")).count() == 0


def test_walk_forward_runs_on_the_windows_alone(spark):
    rng = np.random.default_rng(5)
    n, begin = 600, datetime.datetime(2024, 1, 1)
    close = 100 + rng.normal(0, 1, n).cumsum()
    x = pd.DataFrame({"symbol": "a", "bar_index": np.arange(n), "datetime": [begin + datetime.timedelta(hours=i) for i in range(n)], "open": close + rng.normal(0, 0.3, n), "close": close, "long_signal": rng.random(n) < 0.2})
    x["high"], x["low"] = x[["open", "close"]].max(axis=1) + 0.5, x[["open", "close"]].min(axis=1) - 0.5
    grid = {f"rr{r}": Strategy(direction="long", rr=r, first_bar=1) for r in (1.0, 2.0, 3.0)}
    windows = [(begin + datetime.timedelta(days=a), begin + datetime.timedelta(days=a + 10), begin + datetime.timedelta(days=a + 15)) for a in (0, 5)]
    got = walk_forward(spark.createDataFrame(x).withColumn("datetime", F.col("datetime").cast("timestamp_ntz")), grid, windows, top=2).toPandas()

    def profits(name, lo, hi):
        part = x[(x.datetime >= lo) & (x.datetime < hi)].reset_index(drop=True)
        return [t["profit"] for t in Simulator(Bars.of(part), grid[name]).run()]

    def factor(p):
        gain, loss = sum(v for v in p if v > 0), -sum(v for v in p if v < 0)
        return gain / loss if loss else 999.0 if gain else 0.0

    for w, (a, b, c) in enumerate(windows, 1):
        train = {k: profits(k, a, b) for k in grid}
        best = sorted((k for k in grid if train[k]), key=lambda k: (-round(factor(train[k]), 6), -round(sum(train[k]), 6), k))[:2]
        rows = got[got.window == w].sort_values("rank")
        assert rows.param_id.tolist() == best
        for r in rows.itertuples():
            test = profits(r.param_id, b, c)
            assert (r.train_trades, r.test_trades) == (len(train[r.param_id]), len(test))
            assert r.test_net_profit == pytest.approx(sum(test), abs=1e-4)


def test_judgement_and_rating(spark):
    rows = [(0, 0.0, 0.0, 0.0), (3, 1.0, 1.3, 5.0), (3, 1.0, 1.3, 5.1), (3, 1.0, 1.1, 1.0), (3, -1.0, 0.5, 1.0)]
    judged = R.judged(spark.createDataFrame(rows, "test_trades long, test_net_profit double, test_profit_factor double, test_max_dd double"))
    assert [r.judgement for r in judged.collect()] == ["NO_TRADE", "PASS", "CAUTION", "CAUTION", "FAIL"]
    one = R.overall(judged).first()
    assert (one.tests, one.pass_rate, one.negative_tests, one.rating) == (5, 20.0, 1, "D")
    assert R.overall(judged.where("judgement = 'PASS'")).first().rating == "B"


@pytest.mark.parametrize(("start", "end", "intraday", "hours"), [(9, 18, True, set(range(9, 18))), (22, 3, True, {22, 23, 0, 1, 2}), (9, 9, True, set(range(24))), (9, 18, False, set(range(24)))])
def test_sessions(spark, start, end, intraday, hours):
    bars = spark.sql("select 's' as symbol, '1h' as timeframe, id as bar_index, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) as datetime, 1d as open, 2d as high, 0d as low, 1.5d as close, 1d as volume from (select cast(id as int) as id from range(24))")
    plan = Plan(SPARK)
    x = signals.FILTERS["use_session_filter"](plan, {**signals.DEFAULTS, "session_start": start, "session_end": end, "intraday": intraday})
    got = spark.sql(plan.sql("{bars}", {"ok": x}), bars=bars)
    assert {r.datetime.hour for r in got.where("ok").collect()} == hours


def test_limits_of_none_or_less_are_no_limits():
    plan = Plan(SPARK)
    for most, free in ((0, True), (-1, True), (5, False)):
        for name, key in (("use_max_body_filter", "max_body_pips"), ("use_max_wick_filter", "max_wick_pips")):
            assert (signals.FILTERS[name](plan, {**signals.DEFAULTS, key: most}) == "true") == free
