"""Derived indicators: distances, slopes, statistics, events, volume and regression."""

from __future__ import annotations

import json
import zlib
from math import log10

from candleforge.operators.patterns import NAMES, STATES, parameters

from . import indicators as I
from .compiler import Plan, flag
from .indicators import BODY, LOWER, RANGE, TYPICAL, UPPER, define, indicator, ratio

# distances from levels

_LEVELS = {
    "ema": (("length", 200), lambda p, length: I.ema(p, length)),
    "sma": (("length", 200), lambda p, length: I.sma(p, length)),
    "vwap": (None, lambda p: I.vwap(p)),
    "pivot": (None, lambda p: I.build(p, "pivot")),
    "prev_day_high": (None, lambda p: I.yesterday(p)["high"]),
    "prev_day_low": (None, lambda p: I.yesterday(p)["low"]),
    "donchian_upper": (("length", 20), lambda p, length: I.channel(p, length)[0]),
    "donchian_lower": (("length", 20), lambda p, length: I.channel(p, length)[1]),
}
for _price in ("close", "high", "low"):
    for _level, (_given, _f) in _LEVELS.items():
        if _given:
            define(f"dist_{_price}_{_level}", (lambda _f, _price, _default: lambda p, length=_default: f"abs({_price} - {_f(p, length)})")(_f, _price, _given[1]))
        else:
            define(f"dist_{_price}_{_level}", (lambda _f, _price: lambda p: f"abs({_price} - {_f(p)})")(_f, _price))
    for _side, _i in (("upper", 0), ("lower", 2)):
        define(f"dist_{_price}_bb_{_side}", lambda p, period=20, num_std=2.0, _price=_price, _i=_i: f"abs({_price} - {I.bands(p, period, num_std)[_i]})")
    define(f"dist_{_price}_supertrend", lambda p, length=10, multiplier=3.0, _price=_price: f"abs({_price} - {supertrend(p, length, multiplier)[0]})")


def supertrend(p: Plan, length: int, multiplier: float) -> tuple[str, str]:
    """Columns that :func:`candleforge.operators.kernels.with_kernels` adds below the plan."""
    name = f"supertrend_{int(length)}_{str(float(multiplier)).replace('.', '_')}"
    I.KERNELS[name] = ("supertrend", {"length": int(length), "multiplier": float(multiplier)})
    return f"{name}_line", f"{name}_direction"


def sar(p: Plan, af_start: float, af_step: float, af_max: float) -> tuple[str, str]:
    name = "sar_" + "_".join(str(float(x)).replace(".", "_") for x in (af_start, af_step, af_max))
    I.KERNELS[name] = ("sar", {"af_start": float(af_start), "af_step": float(af_step), "af_max": float(af_max)})
    return f"{name}_line", f"{name}_direction"


for _i, _n in enumerate(("line", "direction")):
    define(f"supertrend_{_n}", lambda p, length=10, multiplier=3.0, _i=_i: supertrend(p, length, multiplier)[_i])
    define(f"parabolic_sar_{_n}", lambda p, af_start=0.02, af_step=0.02, af_max=0.2, _i=_i: sar(p, af_start, af_step, af_max)[_i])
for _side, _to in (("bullish", 1), ("bearish", -1)):
    define(f"supertrend_flip_{_side}", lambda p, length=10, multiplier=3.0, _to=_to: flag("{0} = {1} and {2} = {3}".format(supertrend(p, length, multiplier)[1], _to, p.prev(supertrend(p, length, multiplier)[1]), -_to)))


def _zone(p: Plan, formed: str, level: str) -> str:
    return p.known(p.let(f"case when {formed} then {level} end"))


def zones(p: Plan) -> dict[str, tuple[str, str, bool]]:
    """Formation, level and side of the latest zone of each kind."""
    return {
        "order_block_bullish": (I.block_bull(p), _zone(p, I.block_bull(p), "least(open, close)"), True),
        "order_block_bearish": (I.block_bear(p), _zone(p, I.block_bear(p), "greatest(open, close)"), False),
        "fvg_bullish": (I.gap_bull(p), _zone(p, I.gap_bull(p), p.prev("high", 2)), True),
        "fvg_bearish": (I.gap_bear(p), _zone(p, I.gap_bear(p), p.prev("low", 2)), False),
    }


def _retest(p: Plan, kind: str) -> str:
    formed, level, up = zones(p)[kind]
    touched = p.let(f"coalesce({f'low <= {level}' if up else f'high >= {level}'}, false) and not {formed}")
    start = p.last_index(formed)
    return flag(f"{touched} and {start} is not null and coalesce({p.last_index(touched, before=True)} < {start}, true)")


for _k in ("order_block_bullish", "order_block_bearish", "fvg_bullish", "fvg_bearish"):
    define(f"dist_{_k}", lambda p, _k=_k: f"abs(close - {zones(p)[_k][1]})")
    define(_k.replace("bullish", "first_retest_bullish").replace("bearish", "first_retest_bearish"), lambda p, _k=_k: _retest(p, _k))
define("dist_bos_bullish", lambda p, length=5: f"abs(close - {I.swings(p, 'high', length)[1]})")
define("dist_bos_bearish", lambda p, length=5: f"abs(close - {I.swings(p, 'low', length)[1]})")

# slopes

_SLOPES = {
    "ema": ({"length": 200}, I.ema), "vwap": ({}, I.vwap), "supertrend": ({"length": 10, "multiplier": 3.0}, lambda p, length, multiplier: supertrend(p, length, multiplier)[0]), "rsi": ({"length": 14}, I.rsi), "adx": ({"length": 14}, I.adx),
    "macd": ({"fast": 12, "slow": 26, "signal": 9}, lambda p, fast, slow, signal: I.macd(p, fast, slow, signal)[0]), "atr": ({"length": 14}, I.atr), "obv": ({}, lambda p: obv(p)), "mfi": ({"period": 14}, lambda p, period: mfi(p, period)),
}


def _with_defaults(names: dict[str, object], make):
    """A builder whose signature shows ``names`` as parameters."""
    import inspect

    def build(p: Plan, **params: object) -> str:
        return make(p, **{**names, **params})

    build.__signature__ = inspect.Signature([inspect.Parameter("p", inspect.Parameter.POSITIONAL_OR_KEYWORD), *[inspect.Parameter(k, inspect.Parameter.KEYWORD_ONLY, default=v) for k, v in names.items()]])  # type: ignore[attr-defined]
    return build


for _n, (_params, _f) in _SLOPES.items():
    for _way, _op in (("rising", ">"), ("falling", "<")):

        def _slope(p: Plan, lookback: int, _f=_f, _op=_op, **params: object) -> str:
            x = p.let(_f(p, **params))
            return flag(f"({x} - {p.prev(x, lookback)}) {_op} {'' if _op == '>' else '-'}1e-9")

        def _steady(p: Plan, n: int, _f=_f, _op=_op, **params: object) -> str:
            x = p.let(_f(p, **params))
            return f"cast({p.streak(f"({x} - {p.prev(x)}) {_op} {'' if _op == '>' else '-'}1e-9", n)} as double)"

        define(f"{_n}_{_way}", _with_defaults({**_params, "lookback": 1}, _slope))
        define(f"{_n}_consecutive_{_way}", _with_defaults({**_params, "n": 3}, _steady))

define("ema_slope", lambda p, length=200, lookback=5: f"({I.ema(p, length)} - {p.prev(I.ema(p, length), lookback)})")
define("ema_slope_degrees", lambda p, length=200, lookback=5: f"degrees(atan({ratio(ema_slope(p, length, lookback), f'{I.atr(p, 14)} * {int(lookback)}')}))")
ema_slope = I.REGISTRY["ema_slope"]
define("ema_roc", lambda p, length=200, lookback=5: f"(100 * {ratio(ema_slope(p, length, lookback), f'abs({p.prev(I.ema(p, length), lookback)})')})")
define("atr_roc", lambda p, length=14, lookback=1: f"(100 * {ratio(f'{I.atr(p, length)} - {p.prev(I.atr(p, length), lookback)}', f'abs({p.prev(I.atr(p, length), lookback)})')})")
for _n, _x, _op in (("higher_high", "high", ">"), ("higher_low", "low", ">"), ("lower_high", "high", "<"), ("lower_low", "low", "<")):
    define(_n, lambda p, lookback=5, _x=_x, _op=_op: flag("{0} {1} {2}".format(I.swings(p, _x, lookback)[0], _op, I.swings(p, _x, lookback)[2])))
for _n, _x in (("equal_high", "high"), ("equal_low", "low")):
    define(_n, lambda p, swing_lookback=5, tolerance_atr_mult=0.3, _x=_x: flag("abs({0} - {1}) <= {2!r} * {3}".format(I.swings(p, _x, swing_lookback)[0], I.swings(p, _x, swing_lookback)[2], float(tolerance_atr_mult), I.atr(p, 14))))

# positions and statistics


@indicator()
def bb_percent_b(p: Plan, period: int = 20, num_std: float = 2.0) -> str:
    hi, _, lo = I.bands(p, period, num_std)
    return ratio(f"close - {lo}", f"{hi} - {lo}")


@indicator()
def donchian_percent_position(p: Plan, length: int = 20) -> str:
    hi, lo = I.channel(p, length)
    return ratio(f"close - {lo}", f"{hi} - {lo}")


define("dist_to_ema_atr_ratio", lambda p, ema_length=200, atr_length=14: ratio(f"abs(close - {I.ema(p, ema_length)})", I.atr(p, atr_length)))
define("dist_close_ema_pct", lambda p, length=200: f"(100 * {ratio(f'abs(close - {I.ema(p, length)})', 'close')})")
define("rolling_mean_high", lambda p, length=20: p.roll("avg", "high", length))
define("rolling_mean_low", lambda p, length=20: p.roll("avg", "low", length))


def _rolled(p: Plan, f: str, x: str, n: int, exclude_current: int) -> str:
    x = p.let(x)
    return p.roll_previous(f, x, n) if exclude_current else p.roll(f, x, n)


for _n, _f in (("avg_body_size", "avg"), ("max_body_size", "max"), ("min_body_size", "min"), ("body_size_std", "stddev_samp")):
    define(_n, lambda p, length=20, exclude_current=0, _f=_f: _rolled(p, _f, BODY, length, exclude_current))
define("avg_upper_wick", lambda p, length=20: p.roll("avg", p.let(UPPER), length))
define("avg_lower_wick", lambda p, length=20: p.roll("avg", p.let(LOWER), length))
define("atr_rolling_mean", lambda p, atr_length=14, window=20: p.roll("avg", I.atr(p, atr_length), window))
define("atr_deviation", lambda p, atr_length=14, window=20: f"({I.atr(p, atr_length)} - {p.roll('avg', I.atr(p, atr_length), window)})")
define("close_rolling_std", lambda p, length=20: p.roll("stddev_samp", "close", length))
define("historical_volatility", lambda p, period=20, annualization_factor=252.0: f"({p.roll('stddev_samp', p.let(f'ln({ratio("close", p.prev("close"))})'), period)} * sqrt({float(annualization_factor)!r}) * 100)")
define("rsi_rolling_mean", lambda p, rsi_length=14, window=20: p.roll("avg", I.rsi(p, rsi_length), window))
define("rsi_deviation", lambda p, rsi_length=14, window=20: f"({I.rsi(p, rsi_length)} - {p.roll('avg', I.rsi(p, rsi_length), window)})")
define("adx_rolling_mean", lambda p, adx_length=14, window=20: p.roll("avg", I.adx(p, adx_length), window))
define("macd_rolling_mean", lambda p, window=20: p.roll("avg", I.macd(p)[0], window))


def rank_of(p: Plan, x: str, n: int) -> str:
    """Percentile rank of the last of ``n`` values among them, ties by their mean rank."""
    w = p.last_n(n)
    items = p.let(p.dialect.collected(x, w))
    below, same = p.dialect.count_where(items, f"v < {x}"), p.dialect.count_where(items, f"v = {x}")
    return p.let(f"case when {p.let(f'count({x}) {w}')} = {int(n)} and {x} is not null then 1e2 * ({below} + ({same} + 1) / 2e0) / {int(n)} end")


define("percentile_rank_rsi", lambda p, rsi_length=14, window=100: rank_of(p, I.rsi(p, rsi_length), window))
define("percentile_rank_atr", lambda p, atr_length=14, window=200: rank_of(p, I.atr(p, atr_length), window))
define("percentile_rank_body", lambda p, window=50: rank_of(p, p.let(BODY), window))


def zscore(p: Plan, x: str, n: int) -> str:
    return ratio(f"{x} - {p.roll('avg', x, n)}", p.roll("stddev_samp", x, n))


define("zscore_close", lambda p, window=20: zscore(p, "close", window))
define("zscore_rsi", lambda p, rsi_length=14, window=20: zscore(p, I.rsi(p, rsi_length), window))
define("zscore_atr", lambda p, atr_length=14, window=20: zscore(p, I.atr(p, atr_length), window))
define("is_max_body_of_n", lambda p, window=100: flag(f"{p.let(BODY)} = {p.roll('max', p.let(BODY), window)}"))
define("is_min_atr_of_n", lambda p, atr_length=14, window=50: flag(f"{I.atr(p, atr_length)} = {p.roll('min', I.atr(p, atr_length), window)}"))
define("is_max_rsi_of_n", lambda p, rsi_length=14, window=200: flag(f"{I.rsi(p, rsi_length)} = {p.roll('max', I.rsi(p, rsi_length), window)}"))
define("nr4", lambda p: flag(f"{p.let(RANGE)} = {p.roll('min', p.let(RANGE), 4)}"))
define("nr7", lambda p: flag(f"{p.let(RANGE)} = {p.roll('min', p.let(RANGE), 7)}"))

# events


@indicator()
def bb_width(p: Plan, period: int = 20, num_std: float = 2.0) -> str:
    hi, mid, lo = I.bands(p, period, num_std)
    return p.let(ratio(f"{hi} - {lo}", mid))


define("bb_width_percent", lambda p, period=20, num_std=2.0: f"({bb_width(p, period, num_std)} * 100)")


def _squeezed(p: Plan, period: int, num_std: float, window: int, percentile: float) -> str:
    return p.let(f"coalesce({rank_of(p, bb_width(p, period, num_std), window)} <= {float(percentile)!r}, false)")


define("bb_squeeze", lambda p, period=20, num_std=2.0, window=100, percentile=10.0: flag(_squeezed(p, period, num_std, window, percentile)))
define("bb_expansion", lambda p, period=20, num_std=2.0, window=100, percentile=10.0: flag(f"{p.prev(_squeezed(p, period, num_std, window, percentile))} and {bb_width(p, period, num_std)} > {p.prev(bb_width(p, period, num_std))}"))


def _divergence(p: Plan, x: str, length: int, top: bool) -> str:
    f, op, back = ("max", ">", "<") if top else ("min", "<", ">")
    return flag(f"close {op} {p.roll_previous(f, 'high' if top else 'low', length)} and {x} {back} {p.roll_previous(f, x, length)}")


for _side, _top in (("bearish", True), ("bullish", False)):
    define(f"rsi_divergence_{_side}", lambda p, length=20, rsi_length=14, _top=_top: _divergence(p, I.rsi(p, rsi_length), length, _top))
    define(f"macd_divergence_{_side}", lambda p, length=20, _top=_top: _divergence(p, I.macd(p)[0], length, _top))


def _order(p: Plan, count: int, lengths: list[int], op: str) -> str:
    if not 3 <= int(count) <= 5:
        raise ValueError("count must be 3 to 5")
    e = [I.ema(p, n) for n in lengths[: int(count)]]
    return p.let("coalesce(" + " and ".join(f"{a} {op} {b}" for a, b in zip(e, e[1:], strict=False)) + ", false)")


for _side, _op in (("bullish", ">"), ("bearish", "<")):
    define(f"ema_perfect_order_{_side}", lambda p, count=4, length_1=20, length_2=50, length_3=100, length_4=200, length_5=300, _op=_op: flag(_order(p, count, [length_1, length_2, length_3, length_4, length_5], _op)))
    define(
        f"ema_perfect_order_broken_{_side}",
        lambda p, count=4, length_1=20, length_2=50, length_3=100, length_4=200, length_5=300, _op=_op: flag(f"{p.prev(_order(p, count, [length_1, length_2, length_3, length_4, length_5], _op))} and not {_order(p, count, [length_1, length_2, length_3, length_4, length_5], _op)}"),
    )


def _pullback(p: Plan, length: int, up: bool) -> str:
    hi, lo = I.channel(p, length)
    broke = p.let(f"coalesce({f'close > {hi}' if up else f'close < {lo}'}, false)")
    start = p.last_index(broke)
    back = p.let(f"coalesce(close {'<' if up else '>'} {p.prev('close')}, false) and not {broke} and {start} is not null")
    return flag(f"{back} and coalesce({p.last_index(back, before=True)} < {start}, true)")


define("first_pullback_after_breakout_bullish", lambda p, length=20: _pullback(p, length, True))
define("first_pullback_after_breakout_bearish", lambda p, length=20: _pullback(p, length, False))

# more oscillators and volume


@indicator()
def cci(p: Plan, period: int = 20) -> str:
    x = p.let(TYPICAL)
    mean, items = p.roll("avg", x, period), p.let(p.dialect.collected(x, p.last_n(period)))
    spread = p.let(f"{p.dialect.sum_of(items, f'abs(v - {mean})')} / {int(period)}")
    return ratio(f"{x} - {mean}", f"0.015 * {spread}")


define("williams_r", lambda p, period=14: f"(-100 * {ratio(f'{p.roll("max", "high", period)} - close', f'{p.roll("max", "high", period)} - {p.roll("min", "low", period)}')})")


def _aroon(p: Plan, period: int, x: str) -> str:
    n = int(period) + 1
    items, best = p.let(p.dialect.collected(x, p.last_n(n))), p.roll("max" if x == "high" else "min", x, n)
    return p.let(f"case when {best} is not null then 1e2 * ({p.dialect.position(items, best)} - 1) / {int(period)} end")


define("aroon_up", lambda p, period=14: _aroon(p, period, "high"))
define("aroon_down", lambda p, period=14: _aroon(p, period, "low"))
define("aroon_oscillator", lambda p, period=14: f"({_aroon(p, period, 'high')} - {_aroon(p, period, 'low')})")
define("choppiness_index", lambda p, period=14: f"(100 * log10({ratio(p.roll('sum', I.true_range(p), period), f'{p.roll("max", "high", period)} - {p.roll("min", "low", period)}')}) / {log10(period)!r})")


def keltner(p: Plan, period: int, atr_period: int, multiplier: float) -> tuple[str, str, str]:
    mid, width = I.ema(p, period), I.atr(p, atr_period)
    return f"({mid} + {float(multiplier)!r} * {width})", mid, f"({mid} - {float(multiplier)!r} * {width})"


for _i, _n in enumerate(("upper", "middle", "lower")):
    define(f"keltner_{_n}", lambda p, period=20, atr_period=10, multiplier=2.0, _i=_i: keltner(p, period, atr_period, multiplier)[_i])


@indicator()
def obv(p: Plan) -> str:
    return p.running("sum", p.let(f"coalesce(sign(close - {p.prev('close')}), 0) * volume"))


@indicator()
def mfi(p: Plan, period: int = 14) -> str:
    x = p.let(TYPICAL)
    step = p.let(f"{x} - {p.prev(x)}")
    up, down = (p.roll("sum", p.let(f"case when {step} {op} 0 then {x} * volume else 0.0 end"), period) for op in (">", "<"))
    return p.let(f"case when {up} is null then null when {down} = 0 then 100.0 else 100 - 100 / (1 + {up} / nullif({down}, 0)) end")


def money_flow(p: Plan) -> str:
    return p.let(f"coalesce({ratio('(close - low) - (high - close)', RANGE)}, 0) * volume")


@indicator()
def cmf(p: Plan, period: int = 20) -> str:
    flow, volume = p.roll("sum", money_flow(p), period), p.roll("sum", "volume", period)
    return f"(case when {volume} = 0 then 0.0 else {flow} / nullif({volume}, 0) end)"


@indicator()
def ad_line(p: Plan) -> str:
    return p.running("sum", money_flow(p))


define("chaikin_oscillator", lambda p, short_length=3, long_length=10: f"({p.ewm(ad_line(p), 2 / (short_length + 1))} - {p.ewm(ad_line(p), 2 / (long_length + 1))})")


def _ttm(p: Plan, bb_period: int, bb_num_std: float, kc_period: int, kc_atr_period: int, kc_multiplier: float) -> str:
    hi, _, lo = I.bands(p, bb_period, bb_num_std)
    top, _, bottom = keltner(p, kc_period, kc_atr_period, kc_multiplier)
    return p.let(f"coalesce({hi} < {top} and {lo} > {bottom}, false)")


define("ttm_squeeze", lambda p, bb_period=20, bb_num_std=2.0, kc_period=20, kc_atr_period=10, kc_multiplier=1.5: flag(_ttm(p, bb_period, bb_num_std, kc_period, kc_atr_period, kc_multiplier)))
define("ttm_squeeze_release", lambda p, bb_period=20, bb_num_std=2.0, kc_period=20, kc_atr_period=10, kc_multiplier=1.5: flag("{0} and not {1}".format(p.prev(_ttm(p, bb_period, bb_num_std, kc_period, kc_atr_period, kc_multiplier)), _ttm(p, bb_period, bb_num_std, kc_period, kc_atr_period, kc_multiplier))))


def line_fit(p: Plan, length: int) -> tuple[str, str]:
    """``(slope, value at the last bar)`` of the least squares line through ``length`` closes."""
    n = int(length)
    mean = p.roll("avg", "close", n)
    weighted = p.roll("avg", p.let("close * bar_index"), n)
    centre = f"(bar_index - {(n - 1) / 2!r})"
    slope = p.let(f"({weighted} - {centre} * {mean}) / {(n * n - 1) / 12!r}")
    return slope, p.let(f"{mean} + {slope} * {(n - 1) / 2!r}")


define("linreg_value", lambda p, length=20: line_fit(p, length)[1])
define("linreg_slope_atr_ratio", lambda p, length=20, atr_length=14: ratio(line_fit(p, length)[0], I.atr(p, atr_length)))
define("linreg_angle_degrees", lambda p, length=20, atr_length=14: f"degrees(atan({ratio(line_fit(p, length)[0], I.atr(p, atr_length))}))")
define("linreg_upper", lambda p, length=20, num_std=2.0: f"({line_fit(p, length)[1]} + {float(num_std)!r} * {p.roll('stddev_samp', 'close', length)})")
define("linreg_lower", lambda p, length=20, num_std=2.0: f"({line_fit(p, length)[1]} - {float(num_std)!r} * {p.roll('stddev_samp', 'close', length)})")


def heikin(p: Plan) -> tuple[str, str, str, str]:
    """Heikin-Ashi open, high, low and close; the open is a recursive mean of earlier closes."""
    close = p.let("(open + high + low + close) / 4")
    o = p.ewm(p.let(f"case when bar_index = 0 then (open + close) / 2 else {p.prev(close)} end"), 0.5)
    return o, p.let(f"greatest(high, {o}, {close})"), p.let(f"least(low, {o}, {close})"), close


define("ha_bullish", lambda p: flag("{3} > {0}".format(*heikin(p))))
define("ha_bearish", lambda p: flag("{3} < {0}".format(*heikin(p))))
define("ha_strong_bullish", lambda p, threshold=0.05: flag("{3} > {0} and (least({0}, {3}) - {2}) / nullif({1} - {2}, 0) <= {4}".format(*heikin(p), threshold)))
define("ha_strong_bearish", lambda p, threshold=0.05: flag("{3} < {0} and ({1} - greatest({0}, {3})) / nullif({1} - {2}, 0) <= {4}".format(*heikin(p), threshold)))
for _side, _op in (("bullish", ">"), ("bearish", "<")):
    define(f"volume_climax_{_side}", lambda p, lookback=20, body_mult=2.0, volume_mult=2.0, _op=_op: flag(f"close {_op} open and {BODY} > {float(body_mult)!r} * {p.roll_previous('avg', p.let(BODY), lookback)} and volume > {float(volume_mult)!r} * {p.roll_previous('avg', 'volume', lookback)}"))
define("bull_power", lambda p, length=13: f"(high - {I.ema(p, length)})")
define("bear_power", lambda p, length=13: f"(low - {I.ema(p, length)})")


@indicator()
def cmo(p: Plan, length: int = 14) -> str:
    step = p.let(f"close - {p.prev('close')}")
    up, down = (p.roll("sum", p.let(f"greatest({s}{step}, 0)"), length) for s in ("", "-"))
    return f"(case when {up} + {down} = 0 then 0.0 else 100 * ({up} - {down}) / nullif({up} + {down}, 0) end)"


@indicator()
def connors_rsi(p: Plan, rsi_length: int = 3, streak_length: int = 2, percent_rank_length: int = 100) -> str:
    way = p.let(f"coalesce(sign(close - {p.prev('close')}), 0)")
    turn = p.let(f"coalesce({p.prev(way)} <> {way}, true)")
    # bars since the last change of direction; none while the price stands still
    run = p.let(f"cast({way} * (bar_index - {p.last_index(turn)} + 1) as double)")
    change = p.let(f"100 * {ratio(f'close - {p.prev("close")}', p.prev('close'))}")
    return f"(({I.rsi(p, rsi_length)} + {I._rsi_of(p, run, streak_length)} + {rank_of(p, change, percent_rank_length)}) / 3)"


@indicator()
def coppock_curve(p: Plan, long_roc: int = 14, short_roc: int = 11, wma_length: int = 10) -> str:
    roc = lambda n: f"100 * {ratio(f'close - {p.prev("close", n)}', p.prev('close', n))}"
    x = p.let(f"{roc(long_roc)} + {roc(short_roc)}")
    n = int(wma_length)
    return "((" + " + ".join(f"{n - k} * {p.prev(x, k) if k else x}" for k in range(n)) + f") / {n * (n + 1) / 2})"


def correlation(p: Plan, a: str, b: str, n: int) -> str:
    w = p.last_n(n)
    return p.let(f"case when count({a}) {w} = {int(n)} and count({b}) {w} = {int(n)} and stddev_samp({a}) {w} > 0 and stddev_samp({b}) {w} > 0 then corr({a}, {b}) {w} end")


define("correlation_close_ema", lambda p, length=20, ema_length=20: correlation(p, "close", I.ema(p, ema_length), length))
define("correlation_oscillator", lambda p, length=20: correlation(p, "close", p.let("cast(bar_index as double)"), length))


# chart patterns


def pattern(name: str, state: str, **params: float) -> str:
    """The column that :func:`candleforge.operators.kernels.with_kernels` adds for a pattern's state; ``params`` are its detector's."""
    if state not in STATES:
        raise ValueError(f"unknown state: {state}")
    given = {k: type(v)(params.get(k, v)) for k, v in parameters(name).items()}
    column = f"pattern_{name}_{state}"
    if given != parameters(name):
        column += f"_{zlib.crc32(json.dumps(given, sort_keys=True).encode()):08x}"
    I.KERNELS[column] = ("pattern", {"name": name, "state": state, "params": given})
    return column


for _n in NAMES:
    define(_n, _with_defaults({"state": "confirmed", **parameters(_n)}, lambda p, _n=_n, **params: pattern(_n, **params)))
