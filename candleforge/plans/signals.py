"""The older signal path: one trigger and any of the filters, all for short trades."""

from __future__ import annotations

from candleforge.functions import indicators as I
from candleforge.functions.compiler import Plan
from candleforge.functions.derived import supertrend
from candleforge.functions.indicators import build


def _cloud_top(p: Plan) -> str:
    return f"greatest({build(p, 'ichimoku_senkou_a')}, {build(p, 'ichimoku_senkou_b')})"


#: Triggers by name; ``s`` are the settings.
TRIGGERS = {
    "breakout": lambda p, s: f"close > open and close > {p.roll_previous('max', 'high', s['breakout_bars'])}",
    "donchian_breakout": lambda p, s: f"close > {p.roll_previous('max', 'high', s['donchian_period'])}",
    "ema_cross": lambda p, s: p.fresh(f"close > {I.ema(p, s['ema_length'])}"),
    "macd_cross": lambda p, s: p.fresh("{} > {}".format(*I.macd(p))),
    "bollinger_touch": lambda p, s: f"close >= {I.bands(p, 20, 2.0)[0]}",
    "ichimoku_cloud_breakout": lambda p, s: p.fresh(f"close > {_cloud_top(p)}"),
    "ichimoku_tk_cross": lambda p, s: p.fresh("{} > {}".format(*I.cloud(p)[:2])),
    "stochastic_kd_cross": lambda p, s: p.fresh(f"{build(p, 'stochastic_k')} > {build(p, 'stochastic_d')}"),
    "stochastic_level_cross": lambda p, s: p.fresh(f"{build(p, 'stochastic_k')} > {float(s['stochastic_level'])!r}"),
    **{n: (lambda n: lambda p, s: f"{build(p, n)} = 1")(n) for n in ("fvg_bearish", "order_block_bearish", "bos_bearish", "choch_bearish", "liquidity_sweep_bearish", "supertrend_flip_bearish")},
    "adx_di_cross_bearish": lambda p, s: p.fresh(f"{I.minus_di(p)} > {I.plus_di(p)}"),
}


def _session(p: Plan, s: dict) -> str:
    """Hours from start to end, over midnight if need be; equal ends and bars of a day or longer let everything pass."""
    h, a, b = "extract(hour from datetime)", int(s["session_start"]), int(s["session_end"])
    if not s["intraday"]:
        return "true"
    return f"({h} >= {a} and {h} < {b})" if a < b else f"({h} >= {a} or {h} < {b})"


def _limit(x: str, most: float, pip: float) -> str:
    """At most so many pips; none or less is no limit."""
    return "true" if most <= 0 else f"{x} <= {float(most) * pip!r}"


#: Filters by flag, in the order in which they apply.
FILTERS = {
    "use_session_filter": _session,
    "use_min_body_filter": lambda p, s: f"close - open >= {float(s['min_body_pips']) * s['pip_size']!r}",
    "use_max_body_filter": lambda p, s: _limit("abs(close - open)", s["max_body_pips"], s["pip_size"]),
    "use_max_wick_filter": lambda p, s: _limit("(high - low)", s["max_wick_pips"], s["pip_size"]),
    "use_ema_distance_filter": lambda p, s: f"close > {I.ema(p, s['ema_length'])} and close - {I.ema(p, s['ema_length'])} >= {float(s['ema_distance_pips']) * s['pip_size']!r}",
    "use_rsi_filter": lambda p, s: f"{I.rsi(p, 14)} > {float(s['rsi_min'])!r}",
    "use_donchian_filter": lambda p, s: f"close > {I.donchian_mid(p, s['donchian_period'])}",
    "use_bollinger_filter": lambda p, s: f"close > {I.bands(p, 20, 2.0)[1]}",
    "use_macd_filter": lambda p, s: "{} > {}".format(*I.macd(p)),
    "use_ichimoku_filter": lambda p, s: f"close > {_cloud_top(p)}",
    "use_stochastic_filter": lambda p, s: f"{build(p, 'stochastic_k')} > {build(p, 'stochastic_d')}",
    "use_pivot_filter": lambda p, s: f"close > {build(p, 'pivot_r1')}",
    "use_prev_high_filter": lambda p, s: f"close > {I.yesterday(p)['high']}",
    "use_prev_low_filter": lambda p, s: f"close > {I.yesterday(p)['low']}",
    "use_round_number_filter": lambda p, s: f"{build(p, 'dist_to_round_number', pip_size=s['pip_size'])} <= {float(s['round_number_pips'])!r}",
    "use_weekday_filter": lambda p, s: f"{p.dialect.weekday('datetime')} in ({', '.join(str(d) for d in s['weekdays'])})",
    **{f"use_{n}_filter": (lambda n: lambda p, s: f"{build(p, n + '_bearish')} = 1")(n) for n in ("fvg", "order_block", "bos", "choch", "liquidity_sweep")},
    "use_supertrend_filter": lambda p, s: f"{supertrend(p, 10, 3.0)[1]} = -1",
    "use_adx_filter": lambda p, s: f"{I.adx(p)} > {float(s['adx_threshold'])!r}",
}
#: Settings where a strategy gives none.
DEFAULTS = {"breakout_bars": 20, "donchian_period": 20, "ema_length": 200, "stochastic_level": 80, "session_start": 9, "session_end": 18, "min_body_pips": 5, "max_body_pips": 0, "max_wick_pips": 0, "ema_distance_pips": 5, "rsi_min": 50, "round_number_pips": 30, "weekdays": (0, 1, 2, 3, 4), "adx_threshold": 25, "pip_size": 0.01, "intraday": True}


def candidate(plan: Plan, trigger: str, filters: list[str], **settings: object) -> str:
    """The trigger and all the filters; what is unknown is false."""
    if trigger not in TRIGGERS:
        raise ValueError(f"unknown trigger: {trigger}")
    s = {**DEFAULTS, **settings}
    parts = [TRIGGERS[trigger](plan, s), *(FILTERS[f](plan, s) for f in filters)]
    return " and ".join(f"coalesce({x}, false)" for x in parts)
