"""The indicator registry: names, parameters and their SQL.

A builder takes a :class:`~candleforge.functions.compiler.Plan` and the parameters and returns an
expression. Tests give 1 or 0; values are null until they are known.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from .compiler import Plan, flag

REGISTRY: dict[str, Callable[..., str]] = {}
#: Names that need a stateful pass over the series and are columns of :mod:`candleforge.operators.kernels`.
KERNELS: dict[str, tuple[str, dict[str, float]]] = {}
SOURCES = {"close": "close", "open": "open", "high": "high", "low": "low", "hl2": "((high + low) / 2)", "hlc3": "((high + low + close) / 3)", "ohlc4": "((open + high + low + close) / 4)"}
TYPICAL = "((high + low + close) / 3)"
BODY, RANGE = "abs(close - open)", "(high - low)"
UPPER, LOWER = "(high - greatest(open, close))", "(least(open, close) - low)"


def indicator(*names: str):
    def add(f: Callable[..., str]) -> Callable[..., str]:
        for n in names or (f.__name__.rstrip("_"),):
            REGISTRY[n] = f
        return f

    return add


def define(name: str, f: Callable[..., str]) -> None:
    REGISTRY[name] = f


def parameters(name: str) -> dict[str, object]:
    """The parameters of an indicator and their defaults."""
    if name not in REGISTRY:
        raise ValueError(f"unknown indicator: {name}")
    return {k: v.default for k, v in list(inspect.signature(REGISTRY[name]).parameters.items())[1:] if v.default is not inspect.Parameter.empty and not k.startswith("_")}


def build(plan: Plan, name: str, **params: object) -> str:
    known = parameters(name)
    if bad := set(params) - set(known):
        raise ValueError(f"{name} has no parameter {sorted(bad)[0]}")
    return REGISTRY[name](plan, **params)


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


# prices and time

for _n in ("close", "open", "high", "low"):
    define(_n, lambda p, _n=_n: f"cast({_n} as double)")
define("hour", lambda p: "cast(extract(hour from datetime) as double)")
define("month", lambda p: "cast(extract(month from datetime) as double)")
define("weekday", lambda p: f"cast({p.dialect.weekday('datetime')} as double)")
define("candle_body", lambda p: "(close - open)")


def _minutes(p: Plan, zone: str) -> str:
    local = p.let(p.dialect.zoned("datetime", zone))
    return f"(extract(hour from {local}) * 60 + extract(minute from {local}))"


def _hours(p: Plan, zone: str | None, lo: int, hi: int) -> str:
    h = "extract(hour from datetime)" if zone is None else f"extract(hour from {p.let(p.dialect.zoned('datetime', zone))})"
    return flag(f"{h} >= {lo} and {h} < {hi}")


define("killzone_asian", lambda p: _hours(p, None, 8, 10))
define("killzone_london", lambda p: _hours(p, "Europe/London", 7, 10))
define("killzone_newyork", lambda p: _hours(p, "America/New_York", 7, 10))
define("killzone_london_close", lambda p: _hours(p, "Europe/London", 15, 17))
define("minutes_since_london_open", lambda p: f"cast({_minutes(p, 'Europe/London')} - 420 as double)")
define("minutes_since_ny_open", lambda p: f"cast({_minutes(p, 'America/New_York')} - 420 as double)")


# means, bands, oscillators


@indicator()
def ema(p: Plan, length: int = 200) -> str:
    return p.ewm("close", 2 / (length + 1))


@indicator()
def sma(p: Plan, length: int = 200) -> str:
    return p.roll("avg", "close", length)


def _rsi_of(p: Plan, x: str, length: int) -> str:
    change = p.let(f"coalesce({x} - {p.prev(x)}, 0)")
    up, down = p.ewm(p.let(f"greatest({change}, 0)"), 1 / length), p.ewm(p.let(f"greatest(-({change}), 0)"), 1 / length)
    return p.let(f"case when {down} = 0 and {up} = 0 then null when {down} = 0 then 100.0 else 100.0 - 100.0 / (1 + {up} / nullif({down}, 0)) end")


@indicator()
def rsi(p: Plan, length: int = 14) -> str:
    return _rsi_of(p, "close", length)


def true_range(p: Plan) -> str:
    c = p.prev("close")
    return p.let(f"greatest(high - low, abs(high - {c}), abs(low - {c}))")


@indicator()
def atr(p: Plan, length: int = 14) -> str:
    return p.ewm(true_range(p), 1 / length)


for _n, _f, _c in (("highest_high", "max", "high"), ("lowest_low", "min", "low"), ("highest_close", "max", "close"), ("lowest_close", "min", "close")):
    define(_n, lambda p, length=20, _f=_f, _c=_c: p.roll_previous(_f, _c, length))


def channel(p: Plan, length: int) -> tuple[str, str]:
    return p.roll_previous("max", "high", length), p.roll_previous("min", "low", length)


@indicator()
def donchian_mid(p: Plan, length: int = 20) -> str:
    hi, lo = channel(p, length)
    return f"(({hi} + {lo}) / 2)"


def bands(p: Plan, period: int, num_std: float, source: str = "close") -> tuple[str, str, str]:
    if source not in SOURCES:
        raise ValueError(f"unknown source: {source}")
    x = p.let(SOURCES[source]) if source != "close" else "close"
    mid, sd = p.roll("avg", x, period), p.roll("stddev_samp", x, period)
    return p.let(f"{mid} + {float(num_std)!r} * {sd}"), mid, p.let(f"{mid} - {float(num_std)!r} * {sd}")


for _n, _i in (("upper", 0), ("middle", 1), ("lower", 2)):
    define(f"bollinger_{_n}", lambda p, period=20, num_std=2.0, source="close", _i=_i: bands(p, period, num_std, source)[_i])


def macd(p: Plan, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[str, str]:
    line = p.let(f"{p.ewm('close', 2 / (fast + 1))} - {p.ewm('close', 2 / (slow + 1))}")
    return line, p.ewm(line, 2 / (signal + 1))


define("macd_line", lambda p, fast=12, slow=26, signal=9: macd(p, fast, slow, signal)[0])
define("macd_signal", lambda p, fast=12, slow=26, signal=9: macd(p, fast, slow, signal)[1])
define("macd_histogram", lambda p, fast=12, slow=26, signal=9: "({} - {})".format(*macd(p, fast, slow, signal)))


@indicator()
def stochastic_k(p: Plan, k_period: int = 14, d_period: int = 3, smooth: int = 3) -> str:
    lo, hi = p.roll("min", "low", k_period), p.roll("max", "high", k_period)
    return p.roll("avg", p.let(f"100 * {ratio(f'close - {lo}', f'{hi} - {lo}')}"), smooth)


@indicator()
def stochastic_d(p: Plan, k_period: int = 14, d_period: int = 3, smooth: int = 3) -> str:
    return p.roll("avg", stochastic_k(p, k_period, d_period, smooth), d_period)


def _directional(p: Plan, length: int) -> tuple[str, str]:
    up, down = p.let(f"high - {p.prev('high')}"), p.let(f"{p.prev('low')} - low")
    plus = p.let(f"case when {up} > {down} and {up} > 0 then {up} else 0.0 end")
    minus = p.let(f"case when {down} > {up} and {down} > 0 then {down} else 0.0 end")
    tr = p.ewm(true_range(p), 1 / length)
    return p.let(f"100 * {ratio(p.ewm(plus, 1 / length), tr)}"), p.let(f"100 * {ratio(p.ewm(minus, 1 / length), tr)}")


@indicator()
def plus_di(p: Plan, length: int = 14) -> str:
    return _directional(p, length)[0]


@indicator()
def minus_di(p: Plan, length: int = 14) -> str:
    return _directional(p, length)[1]


@indicator()
def adx(p: Plan, length: int = 14) -> str:
    a, b = _directional(p, length)
    return p.ewm(p.let(f"100 * {ratio(f'abs({a} - {b})', f'{a} + {b}')}"), 1 / length)


# market structure


def gap_bull(p: Plan) -> str:
    return p.let(f"coalesce({p.prev('high', 2)} < low, false)")


def gap_bear(p: Plan) -> str:
    return p.let(f"coalesce({p.prev('low', 2)} > high, false)")


def block_bull(p: Plan) -> str:
    o, c = p.prev("open"), p.prev("close")
    return p.let(f"coalesce({c} < {o} and close > open and {BODY} > abs({c} - {o}), false)")


def block_bear(p: Plan) -> str:
    o, c = p.prev("open"), p.prev("close")
    return p.let(f"coalesce({c} > {o} and close < open and {BODY} > abs({c} - {o}), false)")


define("fvg_bullish", lambda p: flag(gap_bull(p)))
define("fvg_bearish", lambda p: flag(gap_bear(p)))
define("order_block_bullish", lambda p: flag(block_bull(p)))
define("order_block_bearish", lambda p: flag(block_bear(p)))


def swing(p: Plan, x: str, length: int) -> str:
    """The level of a swing point on the bar that confirms it, else null."""
    n = int(length)
    w = p.rows(f"{n} preceding", f"{n} following")
    top = p.let(f"coalesce(case when count({x}) {w} = {2 * n + 1} then {x} = {'max' if x == 'high' else 'min'}({x}) {w} end, false)")
    first = p.let(f"case when {top} and not coalesce({p.prev(top)}, false) then {x} end")
    return p.prev(first, n)


def swings(p: Plan, x: str, length: int) -> tuple[str, str, str]:
    """``(level on confirmation, last level, the one before it)``."""
    at = swing(p, x, length)
    earlier = p.running("last", at, before=True)
    return at, p.known(at), p.known(p.let(f"case when {at} is not null then {earlier} end"))


def _structure(p: Plan, up: bool, length: int, break_basis: str, turn: bool) -> str:
    if break_basis not in ("close", "wick"):
        raise ValueError(f"unknown break_basis: {break_basis}")
    x = "high" if up else "low"
    _, recent, previous = swings(p, x, length)
    price = "close" if break_basis == "close" else x
    broke = p.fresh(f"{price} {'>' if up else '<'} {recent}")
    with_trend = f"{recent} {'>=' if up else '<='} {previous}"
    return flag(f"{broke} and {f'not ({with_trend})' if turn else f'({with_trend})'}")


for _side, _up in (("bullish", True), ("bearish", False)):
    define(f"bos_{_side}", lambda p, length=5, break_basis="close", _up=_up: _structure(p, _up, length, break_basis, False))
    for _n in ("choch", "mss"):
        define(f"{_n}_{_side}", lambda p, length=5, break_basis="close", _up=_up: _structure(p, _up, length, break_basis, True))
define("liquidity_sweep_bullish", lambda p, length=5: flag("low < {0} and close > {0}".format(swings(p, "low", length)[1])))
define("liquidity_sweep_bearish", lambda p, length=5: flag("high > {0} and close < {0}".format(swings(p, "high", length)[1])))


def _flip(p: Plan, up: bool, origin: str) -> str:
    """A zone of an opposite block that was closed through since it formed and is touched again."""
    formed = block_bear(p) if up else block_bull(p)
    level = p.known(p.let(f"case when {formed} then {p.prev(p.let(origin))} end"))
    broke = p.last_index(p.let(f"coalesce(close {'>' if up else '<'} {level}, false)"))
    return flag(f"{broke} >= {p.last_index(formed)} and {f'low <= {level}' if up else f'high >= {level}'}")


define("breaker_block_bullish", lambda p: _flip(p, True, "greatest(open, close)"))
define("breaker_block_bearish", lambda p: _flip(p, False, "least(open, close)"))
define("mitigation_block_bullish", lambda p: _flip(p, True, "open"))
define("mitigation_block_bearish", lambda p: _flip(p, False, "open"))


# days


def _day(p: Plan) -> str:
    return p.let(p.dialect.day("datetime"))


def _in_day(p: Plan, aggregate: str, x: str, last: str = "current row") -> str:
    return p.in_day(aggregate, x, _day(p), last)


def yesterday(p: Plan, period: int = 14) -> dict[str, str]:
    """High, low, close and average range of the existing day before, on each bar of a day."""
    day = _day(p)
    first = p.let(f"coalesce({p.prev(day)} <> {day}, true)")
    high, low, close = (p.in_day(f, x, day, "unbounded following") for f, x in (("max", "high"), ("min", "low"), ("last_value", "close")))
    number = p.running("sum", f"cast({first} as int)")
    out = {}
    last = {k: p.let(f"case when {first} then {p.prev(x)} end") for k, x in (("high", high), ("low", low), ("close", close))}
    for k, x in last.items():
        out[k] = p.known(x)
    # the average over days: running sums of a day's range, counted on its first bar
    span = p.let(f"case when {first} then {high} - {low} end")
    total = p.running("sum", span)
    before = p.let(f"case when {first} then {total} - {span} end")
    earlier = p.days_ago(before, period, first)
    out["adr"] = p.known(p.let(f"case when {first} and {number} > {int(period)} then ({before} - {earlier}) / {int(period)} end"))
    return out


define("prev_day_high", lambda p: yesterday(p)["high"])
define("prev_day_low", lambda p: yesterday(p)["low"])
define("prev_day_mid", lambda p: "(({high} + {low}) / 2)".format(**yesterday(p)))
define("adr", lambda p, adr_period=14: yesterday(p, adr_period)["adr"])
PIVOT = "(({high} + {low} + {close}) / 3)"
WOODIE = "(({high} + {low} + 2 * {close}) / 4)"
#: Fixed formulas of pivot levels from the previous day's prices.
LEVELS = {
    "pivot": PIVOT, "pivot_r1": f"(2 * {PIVOT} - {{low}})", "pivot_s1": f"(2 * {PIVOT} - {{high}})",
    "woodie_pivot": WOODIE, "woodie_r1": f"(2 * {WOODIE} - {{low}})", "woodie_s1": f"(2 * {WOODIE} - {{high}})",
    "woodie_r2": f"({WOODIE} + {{high}} - {{low}})", "woodie_s2": f"({WOODIE} - {{high}} + {{low}})",
    "woodie_r3": f"({{high}} + 2 * ({WOODIE} - {{low}}))", "woodie_s3": f"({{low}} - 2 * ({{high}} - {WOODIE}))",
    "woodie_r4": f"({{high}} + 2 * ({WOODIE} - {{low}}) + {{high}} - {{low}})", "woodie_s4": f"({{low}} - 2 * ({{high}} - {WOODIE}) - {{high}} + {{low}})",
    "fib_pivot": PIVOT,
}
for _i, _x in enumerate((12, 6, 4, 2), 1):
    LEVELS[f"camarilla_r{_i}"], LEVELS[f"camarilla_s{_i}"] = f"({{close}} + ({{high}} - {{low}}) * 1.1 / {_x})", f"({{close}} - ({{high}} - {{low}}) * 1.1 / {_x})"
for _i, _x in enumerate((0.382, 0.618, 1.0), 1):
    LEVELS[f"fib_pivot_r{_i}"], LEVELS[f"fib_pivot_s{_i}"] = f"({PIVOT} + {_x} * ({{high}} - {{low}}))", f"({PIVOT} - {_x} * ({{high}} - {{low}}))"
for _n, _x in LEVELS.items():
    define(_n, lambda p, _x=_x: p.let(_x.format(**yesterday(p))))


@indicator()
def vwap(p: Plan) -> str:
    return ratio(_in_day(p, "sum", p.let(f"{TYPICAL} * volume")), _in_day(p, "sum", "volume"))


define("today_range_pct_of_adr", lambda p, adr_period=14: f"(100 * {ratio(_in_day(p, 'max', 'high') + ' - ' + _in_day(p, 'min', 'low'), yesterday(p, adr_period)['adr'])})")
define("today_range_position", lambda p: ratio(f"close - {_in_day(p, 'min', 'low')}", f"{_in_day(p, 'max', 'high')} - {_in_day(p, 'min', 'low')}"))
define("today_new_high", lambda p: flag(f"high > {_in_day(p, 'max', 'high', '1 preceding')}"))
define("today_new_low", lambda p: flag(f"low < {_in_day(p, 'min', 'low', '1 preceding')}"))


# cloud, retracement


def cloud(p: Plan, tenkan_period: int = 9, kijun_period: int = 26, senkou_b_period: int = 52) -> tuple[str, str, str, str]:
    mid = lambda n: p.let(f"({p.roll('max', 'high', n)} + {p.roll('min', 'low', n)}) / 2")
    a, b = mid(tenkan_period), mid(kijun_period)
    return a, b, p.let(f"({a} + {b}) / 2"), mid(senkou_b_period)


define("ichimoku_tenkan", lambda p, tenkan_period=9, kijun_period=26, senkou_b_period=52: cloud(p, tenkan_period, kijun_period, senkou_b_period)[0])
define("ichimoku_kijun", lambda p, tenkan_period=9, kijun_period=26, senkou_b_period=52: cloud(p, tenkan_period, kijun_period, senkou_b_period)[1])
for _n, _i in (("a", 2), ("b", 3)):
    define(f"ichimoku_senkou_{_n}", lambda p, tenkan_period=9, kijun_period=26, senkou_b_period=52, _i=_i: p.prev(cloud(p, tenkan_period, kijun_period, senkou_b_period)[_i], kijun_period))


@indicator()
def ichimoku_price_vs_cloud(p: Plan, tenkan_period: int = 9, kijun_period: int = 26, senkou_b_period: int = 52) -> str:
    a, b = (p.prev(x, kijun_period) for x in cloud(p, tenkan_period, kijun_period, senkou_b_period)[2:])
    return f"(case when {a} is null or {b} is null then 0.0 when close > greatest({a}, {b}) then 1.0 when close < least({a}, {b}) then -1.0 else 0.0 end)"


for _side, _op in (("bullish", ">"), ("bearish", "<")):
    define(f"ichimoku_kumo_twist_{_side}", lambda p, tenkan_period=9, kijun_period=26, senkou_b_period=52, _op=_op: flag(p.fresh(f" {_op} ".join(cloud(p, tenkan_period, kijun_period, senkou_b_period)[2:]))))
define("ichimoku_chikou_signal", lambda p, kijun_period=26: f"coalesce(cast(sign(close - {p.prev('close', kijun_period)}) as double), 0.0)")


@indicator()
def fib_level(p: Plan, length: int = 20, ratio: float = 0.618) -> str:
    hi, lo = channel(p, length)
    return f"({hi} - {float(ratio)!r} * ({hi} - {lo}))"


define("dist_to_fib", lambda p, length=20, ratio=0.618: f"abs(close - {fib_level(p, length, ratio)})")
define("dist_to_round_number", lambda p, pip_size=0.01, round_interval=1.0: f"(abs(close - {p.dialect.half_even(f'close / {float(round_interval)!r}')} * {float(round_interval)!r}) / {float(pip_size)!r})")
