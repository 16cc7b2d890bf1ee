"""Indicators, trees, backtests and bars against pandas, hand-built bars and the SQL form."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candleforge.functions import indicators as I
from candleforge.functions.compiler import SPARK, Plan
from candleforge.operators import analysis as A
from candleforge.operators import bars as B
from candleforge.operators import search
from candleforge.operators.patterns import NAMES
from candleforge.operators.backtest import Bars, Simulator, Strategy
from candleforge.plans import market_queries, strategy_queries
from candleforge.plans.conditions import evaluate, parse
from candleforge.sources import files

SF = "/root/testdata/sf0.001"


def series(n=600, seed=1):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    open_ = np.concatenate(([close[0]], close[:-1])) + rng.normal(0, 0.2, n)
    high, low = np.maximum(open_, close) + rng.random(n), np.minimum(open_, close) - rng.random(n)
    t = pd.date_range("2024-01-01", periods=n, freq="h")
    return pd.DataFrame({"symbol": "X", "timeframe": "1h", "datetime": t, "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 100, n).astype(float), "bar_index": np.arange(n)})


def frame(spark, x):
    return spark.createDataFrame(x).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


def values(spark, x, **named):
    plan = Plan(SPARK)
    out = {k: I.build(plan, n, **p) for k, (n, p) in named.items()}
    from candleforge.operators.kernels import with_kernels

    source = with_kernels(frame(spark, x), " ".join([*out.values(), *plan.made]))
    return spark.sql(plan.sql("{bars}", out), bars=source).toPandas().sort_values("datetime").reset_index(drop=True)


def close_to(a, b, tol=1e-7):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    assert np.nanmax(np.abs(a - b)) < tol


def test_recursive_means_equal_pandas(spark):
    x = series(3000)
    got = values(spark, x, e=("ema", {"length": 50}), long=("ema", {"length": 300}), atr=("atr", {"length": 14}), rsi=("rsi", {"length": 14}), ha=("ha_bullish", {}), macd=("macd_signal", {}))
    close_to(got.e, x.close.ewm(span=50, adjust=False).mean())
    close_to(got.long, x.close.ewm(span=300, adjust=False).mean())
    before = x.close.shift()
    tr = pd.concat([x.high - x.low, (x.high - before).abs(), (x.low - before).abs()], axis=1).max(axis=1)
    close_to(got.atr, tr.ewm(alpha=1 / 14, adjust=False).mean())
    d = x.close.diff().fillna(0)
    up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    rsi = (100 - 100 / (1 + up / down)).where(~((up == 0) & (down == 0)))
    close_to(got.rsi[1:], rsi[1:], 1e-6)
    line = x.close.ewm(span=12, adjust=False).mean() - x.close.ewm(span=26, adjust=False).mean()
    close_to(got.macd, line.ewm(span=9, adjust=False).mean())
    ha_close = (x.open + x.high + x.low + x.close) / 4
    o = [(x.open[0] + x.close[0]) / 2]
    for v in ha_close[:-1]:
        o.append((o[-1] + v) / 2)
    assert (got.ha == (ha_close > o).astype(float)).all()


def test_rolling_values_equal_pandas(spark):
    x = series(400)
    got = values(spark, x, sd=("close_rolling_std", {"length": 20}), rank=("percentile_rank_body", {"window": 30}), cci=("cci", {"period": 20}), up=("aroon_up", {"period": 14}), fit=("linreg_value", {"length": 20}), corr=("correlation_oscillator", {"length": 20}))
    close_to(got.sd, x.close.rolling(20).std(), 1e-6)
    body = (x.close - x.open).abs()
    close_to(got["rank"], body.rolling(30).rank(pct=True) * 100)
    tp = (x.high + x.low + x.close) / 3
    close_to(got.cci, (tp - tp.rolling(20).mean()) / (0.015 * tp.rolling(20).apply(lambda v: np.abs(v - v.mean()).mean(), raw=True)), 1e-5)
    close_to(got.up, x.high.rolling(15).apply(lambda v: 100 * v.argmax() / 14, raw=True))
    close_to(got.fit, x.close.rolling(20).apply(lambda v: np.polyval(np.polyfit(np.arange(20), v, 1), 19), raw=True), 1e-5)
    close_to(got["corr"], x.close.rolling(20).corr(pd.Series(np.arange(400.0))), 1e-5)


def test_stateful_lines_by_hand():
    from candleforge.operators.kernels import sar, supertrend

    h, l, c = (np.array(x, float) for x in ([11, 11, 20, 30, 30], [9, 9, 10, 28, 5], [10, 10, 19, 29, 6]))
    line, side = supertrend(h, l, c, 1, 1.0)
    assert side.tolist() == [-1, -1, 1, 1, -1] and line[0] == 12 and line[2] == 8
    line, side = sar(h, l, c, 0.02, 0.02, 0.2)
    assert line[0] == 9 and side.tolist() == [1, 1, 1, 1, -1] and line[4] == 30


def test_no_indicator_looks_ahead(spark):
    x = series(330, 5)
    names = [n for n in I.REGISTRY if not n.startswith(("percentile", "bb_sq", "bb_ex")) and n not in NAMES]
    some = {f"c{i}": (n, {}) for i, n in enumerate(names[::3])}
    full, part = values(spark, x, **some), values(spark, x[:300], **some)
    for c in some:
        a, b = full[c][:300].to_numpy(float), part[c].to_numpy(float)
        assert ((np.abs(a - b) < 1e-6) | (np.isnan(a) & np.isnan(b))).all(), some[c]


@pytest.mark.parametrize("name", ["ind_price_time", "ind_structure", "ind_days", "ind_candles_multi", "ind_retests"])
def test_families_equal_their_sql(spark, name):
    got = market_queries.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    want = con.sql(market_queries.oracle_sql()[name]).df()
    key = ["symbol", "datetime"]
    a, b = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    for c in a.columns[2:]:
        close_to(a[c], b[c], 1e-5)


def test_registry_is_whole():
    assert len(I.REGISTRY) == 383
    with pytest.raises(ValueError):
        I.build(Plan(), "no_such_thing")
    with pytest.raises(ValueError):
        I.build(Plan(), "ema", size=3)


def test_trees_treat_the_unknown_as_false(spark):
    x = series(30)
    unknown = {"indicator": "sma", "operator": ">", "value": 0.0, "params": {"length": 20}}
    got = evaluate(frame(spark, x), {"a": unknown, "b": {"op": "NOT", "children": [unknown]}, "c": {"indicator": "sma", "operator": "crosses_above", "value": 0.0, "params": {"length": 20}}}).toPandas().sort_values("bar_index")
    assert got.a.tolist() == [False] * 19 + [True] * 11
    assert got.b.tolist() == [True] * 19 + [False] * 11
    assert got.c.tolist() == [i == 19 for i in range(30)]
    for bad in ({"op": "AND", "children": []}, {"op": "XOR", "children": [unknown]}, {**unknown, "operator": "~"}, {**unknown, "indicator": "nope"}, {**unknown, "literal_mode": "x"}):
        with pytest.raises(ValueError):
            parse(bad)


def test_other_timeframes_are_known_when_finished(spark):
    x = series(60)
    got = evaluate(frame(spark, x), {"a": {"indicator": "close", "operator": ">", "value": 0.0, "timeframe": "4h"}}).toPandas().sort_values("bar_index")
    assert got.a.tolist() == [False] * 4 + [True] * 56


def bars_of(rows, **flags):
    n = len(rows)
    x = pd.DataFrame(rows, columns=["open", "high", "low", "close"])
    x["datetime"] = pd.date_range("2024-01-01", periods=n, freq="h")
    for k, at in flags.items():
        x[k] = [i in at for i in range(n)]
    return Bars.of(x)


FLAT = [10, 10.5, 9.5, 10]
CALM = [10, 10.4, 9.6, 10]


def test_exits_and_reentry():
    rows = [FLAT, CALM, [10, 13, 9.8, 12], FLAT, CALM, [10, 10.2, 8, 9], FLAT]
    s = Strategy(direction="long", rr=2.0, first_bar=0)
    trades = Simulator(bars_of(rows, long_signal={0, 1, 2, 3}), s).run()
    # the bar that a position leaves on takes no signal
    assert [(t["signal_bar_index"], t["exit_bar_index"], t["exit_reason"]) for t in trades] == [(0, 2, "TP"), (3, 5, "SL")]
    assert trades[0]["profit"] == 1.0 and trades[1]["profit"] == -0.5
    both = Simulator(bars_of(rows, long_signal={0, 1, 2, 3}), Strategy(direction="long", rr=2.0, first_bar=0, allow_concurrent_positions=True)).run()
    assert len(both) == 4
    worst = Simulator(bars_of([FLAT, [10, 12, 9, 10]], long_signal={0}), s).run()
    assert worst[0]["exit_reason"] == "SL_and_TP_SL_first"


def test_orders_both_sides_and_guards():
    rows = [FLAT, CALM, [10, 10.4, 9.2, 10], [10, 12, 9.8, 11]]
    s = Strategy(direction="long", entry_method="limit", order_offset_pips=0.5, pip_size=1.0, sl_basis="fixed_pips", sl_fixed_pips=1.0, rr=1.0, first_bar=0)
    t = Simulator(bars_of(rows, long_signal={0}), s).run()
    assert [(x["entry_bar_index"], x["entry_price"], x["exit_bar_index"], x["exit_reason"]) for x in t] == [(2, 9.5, 3, "TP")]
    both = Strategy(direction="both", sl_basis="fixed_pips", sl_fixed_pips=1, pip_size=1.0, first_bar=0)
    assert not Simulator(bars_of(rows, long_signal={0}, short_signal={0}), both).run()
    with pytest.raises(ValueError):
        Strategy(direction="up")
    lose = [FLAT, [10, 10.5, 9, 9.5], FLAT, [10, 10.5, 9, 9.5], FLAT, [10, 10.5, 9, 9.5], FLAT]
    g = Strategy(direction="long", first_bar=0, consecutive_loss_stop_count=1, consecutive_loss_stop_bars=100)
    assert len(Simulator(bars_of(lose, long_signal=set(range(7))), g).run()) == 1


def test_concurrent_form_equals_the_pass(spark):
    x = strategy_queries.concurrent_trades(spark, "/root/testdata/sf0.01").toPandas()
    bars = evaluate(market_queries.hourly(spark, "/root/testdata/sf0.01"), {"long_signal": strategy_queries._CONCURRENT}, pip=1.0).toPandas()
    want = []
    for symbol, b in bars.groupby("symbol"):
        s = Strategy(direction="long", rr=1.5, first_bar=50, allow_concurrent_positions=True)
        want += [(symbol, t["signal_bar_index"], t["exit_bar_index"], t["exit_reason"]) for t in Simulator(Bars.of(b.sort_values("bar_index")), s).run() if t["signal_bar_index"] >= 50]
    assert sorted(map(tuple, x[["symbol", "signal_bar_index", "exit_bar_index", "exit_reason"]].to_numpy().tolist())) == sorted(want)


def test_concurrent_positions_are_held_until_their_exit(spark, monkeypatch):
    x = series(4000, 5)
    calm = slice(100, 3500)  # hardly moves for 3,400 bars
    x.loc[x.index[calm], "open"] = x.loc[x.index[calm], "close"] = x.close[99]
    x.loc[x.index[calm], "high"], x.loc[x.index[calm], "low"] = x.close[99] + 0.01, x.close[99] - 0.01
    x["long_signal"] = np.arange(len(x)) % 7 == 0
    monkeypatch.setattr(strategy_queries, "evaluate", lambda *a, **b: frame(spark, x))
    got = strategy_queries.concurrent_trades(spark, SF).toPandas()
    s = Strategy(direction="long", rr=1.5, first_bar=50, allow_concurrent_positions=True)
    want = [(t["signal_bar_index"], t["exit_bar_index"], t["exit_reason"]) for t in Simulator(Bars.of(x), s).run()]
    assert max(b - a for a, b, _ in want) > 3000
    assert sorted(map(tuple, got[["signal_bar_index", "exit_bar_index", "exit_reason"]].to_numpy().tolist())) == sorted(want)


def test_bars_are_cleaned_merged_and_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time (EET),Open,High,Low,Close,Volume\n2024.01.01 00:00:00,10,9,11,10.5,1\n2024.01.01 01:00:00,10,11,9,,1\n2024.01.01 02:00:00,1,2,0.5,1.5,\n2024.01.01 02:00:00,7,8,6,7,\n")
    raw = files.read_csv(spark, str(tmp_path / "a.csv"), "USDJPY", "1h", "EET")
    got = B.cleaned(raw).orderBy("datetime").toPandas()
    assert got.datetime.astype(str).tolist() == ["2024-01-01 07:00:00", "2024-01-01 09:00:00"]
    assert got.high[0] == 11 and got.low[0] == 9 and got.close[1] == 1.5
    stored = B.indexed(B.cleaned(raw))
    files.write_table(stored, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t"), "USDJPY", "1h", start="2024-01-01 08:00:00").count() == 1
    new = stored.withColumn("close", F.lit(0.0)).union(stored.limit(1).withColumn("datetime", F.expr("timestamp_ntz'2030-01-01'")))
    assert B.merged(stored, new).count() == 3
    assert B.checked(stored).first()["n_gaps"] == 0
    with pytest.raises(ValueError):
        files.renamed(spark.createDataFrame([(1,)], "open int"))


def test_search_is_distinct_and_finds():
    space = {"a": [1, 2, 3], "b": [1, 2]}
    assert len(list(search.grid(space))) == 6 and len(search.sampled(space, 10)) == 6
    assert search.values(0, 1, 0.25) == [0, 0.25, 0.5, 0.75, 1.0]
    best = search.evolve({"x": list(range(20)), "y": list(range(20))}, lambda xs: [-(p["x"] - 7) ** 2 - (p["y"] - 3) ** 2 for p in xs])[0]
    assert best[0] >= -4
    assert search.estimate_density({"x": list(range(10))}, lambda p: -abs(p["x"] - 4), 40)[0][0] >= -1
    trees = search.random_trees([{"indicator": "rsi", "operators": [">", "<"], "values": [30.0, 50.0, 70.0]}], 20)
    assert len(trees) == 20 and all(parse(t.to_dict()) == t for t in trees)


def test_streamed_bars_equal_batch(spark, tmp_path):
    from candleforge.streaming.bars import stream_bars

    ticks = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    ticks.write.parquet(str(tmp_path / "in"))
    q = stream_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.symbol, r.datetime.replace(tzinfo=None)): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("streamed").collect()}
    want = {(r.symbol, r.datetime): (r.open, r.high, r.low, r.close, r.volume) for r in market_queries.hourly(spark, SF).collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())


def test_summary_by_hand(spark):
    t = pd.Timestamp("2024-01-01")
    rows = [("a", i, t + pd.Timedelta(days=i), t + pd.Timedelta(days=i), p) for i, p in enumerate([2.0, -1.0, -2.0, 4.0])]
    x = spark.createDataFrame(pd.DataFrame(rows, columns=["series", "trade_number", "entry_time", "exit_time", "profit"]))
    r = A.run(A.SUMMARY, x).first()
    assert (r.trades, r.wins, r.net_profit, r.max_dd) == (4, 2, 3.0, 3.0) and math.isclose(r.profit_factor, 2.0, abs_tol=1e-6)
    s = A.run(A.STREAKS, x).first()
    assert (s.max_consecutive_wins, s.max_consecutive_losses) == (1, 2)
