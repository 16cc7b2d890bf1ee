"""Chart patterns on hand-built series, and that later bars change nothing."""

import numpy as np
import pytest

from candleforge.operators import patterns as C
from candleforge.plans.conditions import evaluate
from candleforge.plans.market_queries import hourly


def path(*levels, step=6, noise=0.0, seed=0):
    x = np.concatenate([np.linspace(a, b, step, endpoint=False) for a, b in zip(levels, levels[1:], strict=False)] + [[levels[-1]]])
    x = x + np.random.default_rng(seed).normal(0, noise, len(x))
    return x + 0.1, x - 0.1


def kinds(high, low, status="candidate"):
    return {e[0] for e in C.events(high, low) if e[1] == status}


def test_double_tops_and_bottoms():
    high, low = path(90, 100, 80, 110, 95, 108, 70, step=12)
    assert {"double_top_zigzag"} <= kinds(high, low) and "double_top_zigzag" in kinds(high, low, "confirmed")
    # the mirror image
    assert "double_bottom_zigzag" in kinds(-low, -high, "confirmed")
    high, low = path(90, 100, 80, 110, 95, 108, 100, 130, step=12)
    assert "double_top_zigzag" in kinds(high, low, "invalidated")


def test_shapes():
    high, low = path(80, 50, 100, 80, 100, 80, 100, 60, step=12)
    assert {"double_top_shape", "triple_top_shape"} <= kinds(high, low)
    high, low = path(80, 50, 100, 85, 115, 85, 100, 60, step=12)
    assert "head_and_shoulders_shape" in kinds(high, low, "confirmed")
    high, low = path(80, 50, 100, 80, 100, 80, 100, 120, step=12)
    assert "ascending_box_shape" in kinds(high, low)


def test_channels_and_flags():
    high, low = path(50, 0, 100, 80, 110, 90, 120, 100, 130, 100, step=10)
    assert "ascending_channel" in kinds(high, low)
    high, low = path(0, 100, 40, 90, 50, 80, 60, 100, step=10)
    assert {"converging_triangle"} <= kinds(high, low) | kinds(-low, -high)
    high, low = path(50, 0, 200, 180, 196, 176, 192, 172, 240, step=14)
    assert any("bullish" in k and ("flag" in k or "pennant" in k) for k in kinds(high, low))


def test_impulse():
    high, low = path(110, 100, 120, 110, 150, 130, 160, 120, step=8)
    assert "impulse_wave_bullish" in kinds(high, low, "confirmed")


@pytest.mark.parametrize("more", [1, 5, 50, 200])
def test_later_bars_change_nothing(more):
    rng = np.random.default_rng(8)
    x = 100 + np.cumsum(rng.normal(0, 1, 1200))
    high, low = x + rng.random(1200), x - rng.random(1200)
    n = 1000
    short = [e for e in C.events(high[:n], low[:n]) if e[2] < n]
    long = [e for e in C.events(high[: n + more], low[: n + more]) if e[2] < n]
    assert sorted(map(str, short)) == sorted(map(str, long)) and len({e[0] for e in short}) >= 15


def test_parameters_reach_the_detectors(spark):
    assert {n: C.FAMILY[n].__name__ for n in ("double_top_zigzag", "triple_top", "abcd_bullish", "abc_bearish", "impulse_wave_bullish", "ranging_channel", "bearish_pennant", "bearish_flag_shape")} == {"double_top_zigzag": "double_zigzag", "triple_top": "reversals", "abcd_bullish": "abcd", "abc_bearish": "abc", "impulse_wave_bullish": "impulses", "ranging_channel": "channels", "bearish_pennant": "flags", "bearish_flag_shape": "shapes"}
    bars = hourly(spark, "/root/testdata/sf0.01")
    trees = {f"n{k}": {"indicator": "double_top_zigzag", "operator": "==", "value": 1.0, "params": {"state": "candidate", "length": k}} for k in (5, 10, 20)}
    got = evaluate(bars, trees, pip=1.0).toPandas()
    plain = evaluate(bars, {"n": {"indicator": "double_top_zigzag", "operator": "==", "value": 1.0, "params": {"state": "candidate"}}}, pip=1.0).toPandas()
    assert got.n10.sum() == plain.n.sum() > 0 and got.n5.sum() > got.n10.sum() > got.n20.sum()
    one = bars.where("symbol = 'click'").toPandas().sort_values("bar_index") if bars.where("symbol = 'click'").count() else bars.toPandas().sort_values(["symbol", "bar_index"])
    first = one[one.symbol == one.symbol.iloc[0]]
    want = {e[2] for e in C.events(first.high.to_numpy(), first.low.to_numpy(), (C.double_zigzag,), length=5) if e[0] == "double_top_zigzag" and e[1] == "candidate"}
    assert set(np.flatnonzero(got[got.symbol == first.symbol.iloc[0]].sort_values("datetime").n5)) == want
    with pytest.raises(ValueError):
        evaluate(bars, {"x": {"indicator": "double_top_zigzag", "operator": "==", "value": 1.0, "params": {"unheard_of": 1}}}, pip=1.0)


def test_columns(spark):
    bars = hourly(spark, "/root/testdata/sf0.01")
    found = C.detect(bars).groupBy("pattern_type", "status").count().collect()
    assert len({r.pattern_type for r in found}) >= 20 and {r.pattern_type for r in found} <= set(C.NAMES) and len(C.NAMES) == 52
    out = C.with_patterns(bars, ["double_top_zigzag", "abc_bullish"])
    assert out.count() == bars.count()
    assert out.selectExpr("sum(double_top_zigzag) a").first().a > 0
    assert C.with_patterns(bars, ["abc_bearish"], "candidate").selectExpr("sum(abc_bearish) a").first().a > 0
    with pytest.raises(ValueError):
        C.with_patterns(bars, ["diamond"])
    with pytest.raises(ValueError):
        C.with_patterns(bars, ["triple_top"], "over")
