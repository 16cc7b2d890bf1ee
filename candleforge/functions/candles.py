"""Candlestick patterns.

A bearish pattern is the bullish one on the mirrored series, in which prices are negated
and highs and lows change places; :class:`Bars` gives the bars of either.
"""

from __future__ import annotations

from .compiler import Plan, flag
from .indicators import BODY, LOWER, RANGE, UPPER, atr, define

BODY_SHARE, UPPER_SHARE, LOWER_SHARE = (f"({x} / nullif({RANGE}, 0))" for x in (BODY, UPPER, LOWER))


class Bars:
    """Prices of the bar ``k`` bars ago, mirrored if ``up`` is false."""

    def __init__(self, plan: Plan, up: bool):
        self.plan, self.up = plan, up

    def _at(self, x: str, k: int) -> str:
        v = self.plan.prev(x, k) if k else x
        return v if self.up else f"(-{v})"

    def o(self, k: int = 0) -> str:
        return self._at("open", k)

    def c(self, k: int = 0) -> str:
        return self._at("close", k)

    def h(self, k: int = 0) -> str:
        return self._at("high" if self.up else "low", k)

    def l(self, k: int = 0) -> str:  # noqa: E743
        return self._at("low" if self.up else "high", k)

    def rises(self, k: int = 0) -> str:
        return f"{self.c(k)} > {self.o(k)}"

    def falls(self, k: int = 0) -> str:
        return f"{self.c(k)} < {self.o(k)}"

    def body(self, k: int = 0) -> str:
        return f"abs({self.c(k)} - {self.o(k)})"

    def share(self, k: int = 0) -> str:
        """Body by range."""
        return f"({self.body(k)} / nullif({self.h(k)} - {self.l(k)}, 0))"


def both(bullish: str, bearish: str, rule) -> None:
    """Register ``rule(bars, **params)`` for a pattern and its mirror image."""
    import inspect

    for name, up in ((bullish, True), (bearish, False)):

        def build(plan: Plan, _up: bool = up, **params: object) -> str:
            return flag(" and ".join(f"({x})" for x in rule(Bars(plan, _up), **params)))

        kept = [inspect.Parameter("plan", inspect.Parameter.POSITIONAL_OR_KEYWORD), *list(inspect.signature(rule).parameters.values())[1:]]
        build.__signature__ = inspect.Signature(kept)  # type: ignore[attr-defined]
        define(name, build)


def _mean_before(p: Plan, x: str, n: int) -> str:
    return p.roll_previous("avg", p.let(x), n)


define("bullish_candle", lambda p: flag("close > open"))
define("bearish_candle", lambda p: flag("close < open"))
for _side, _op in (("bullish", ">"), ("bearish", "<")):
    define(f"large_{_side}_candle", lambda p, lookback=20, multiplier=1.5, _op=_op: flag(f"close {_op} open and {BODY} > {float(multiplier)!r} * {_mean_before(p, BODY, lookback)}"))
    define(f"small_{_side}_candle", lambda p, lookback=20, multiplier=0.5, _op=_op: flag(f"close {_op} open and {BODY} < {float(multiplier)!r} * {_mean_before(p, BODY, lookback)}"))
    define(f"marubozu_{_side}", lambda p, body_ratio_threshold=0.95, _op=_op: flag(f"close {_op} open and {BODY_SHARE} >= {body_ratio_threshold}"))
    define(f"consecutive_{_side}_candles", lambda p, n=3, _op=_op: f"cast({p.streak(f'close {_op} open', n)} as double)")
define("doji", lambda p, body_ratio_threshold=0.1: flag(f"{BODY_SHARE} < {body_ratio_threshold}"))
define("long_upper_wick", lambda p, wick_ratio_threshold=0.6: flag(f"{UPPER_SHARE} >= {wick_ratio_threshold}"))
define("long_lower_wick", lambda p, wick_ratio_threshold=0.6: flag(f"{LOWER_SHARE} >= {wick_ratio_threshold}"))
define("no_upper_wick", lambda p, threshold=0.05: flag(f"{UPPER_SHARE} <= {threshold}"))
define("no_lower_wick", lambda p, threshold=0.05: flag(f"{LOWER_SHARE} <= {threshold}"))
define("pin_bar_bullish", lambda p, body_ratio_max=0.3, wick_ratio_min=0.6: flag(f"{BODY_SHARE} <= {body_ratio_max} and {LOWER_SHARE} >= {wick_ratio_min}"))
define("pin_bar_bearish", lambda p, body_ratio_max=0.3, wick_ratio_min=0.6: flag(f"{BODY_SHARE} <= {body_ratio_max} and {UPPER_SHARE} >= {wick_ratio_min}"))
for _n in ("hammer", "hanging_man"):
    define(_n, lambda p, body_ratio_max=0.3, lower_wick_ratio_min=0.6, upper_wick_ratio_max=0.1: flag(f"{BODY_SHARE} <= {body_ratio_max} and {LOWER_SHARE} >= {lower_wick_ratio_min} and {UPPER_SHARE} <= {upper_wick_ratio_max}"))
for _n in ("inverted_hammer", "shooting_star"):
    define(_n, lambda p, body_ratio_max=0.3, upper_wick_ratio_min=0.6, lower_wick_ratio_max=0.1: flag(f"{BODY_SHARE} <= {body_ratio_max} and {UPPER_SHARE} >= {upper_wick_ratio_min} and {LOWER_SHARE} <= {lower_wick_ratio_max}"))
define("long_legged_doji", lambda p, body_ratio_threshold=0.1, wick_ratio_min=0.35: flag(f"{BODY_SHARE} < {body_ratio_threshold} and {UPPER_SHARE} >= {wick_ratio_min} and {LOWER_SHARE} >= {wick_ratio_min}"))
define("dragonfly_doji", lambda p, body_ratio_threshold=0.1, lower_wick_ratio_min=0.6, upper_wick_ratio_max=0.1: flag(f"{BODY_SHARE} < {body_ratio_threshold} and {LOWER_SHARE} >= {lower_wick_ratio_min} and {UPPER_SHARE} <= {upper_wick_ratio_max}"))
define("gravestone_doji", lambda p, body_ratio_threshold=0.1, upper_wick_ratio_min=0.6, lower_wick_ratio_max=0.1: flag(f"{BODY_SHARE} < {body_ratio_threshold} and {UPPER_SHARE} >= {upper_wick_ratio_min} and {LOWER_SHARE} <= {lower_wick_ratio_max}"))
define("spinning_top", lambda p, body_ratio_max=0.3, wick_ratio_min=0.3: flag(f"{BODY_SHARE} <= {body_ratio_max} and {UPPER_SHARE} >= {wick_ratio_min} and {LOWER_SHARE} >= {wick_ratio_min}"))
define("body_larger_than_average", lambda p, lookback=20, multiplier=1.5: flag(f"{BODY} > {float(multiplier)!r} * {_mean_before(p, BODY, lookback)}"))
define("wick_ratio_at_least", lambda p, threshold_pct=50.0: flag(f"({UPPER} + {LOWER}) / nullif({RANGE}, 0) * 100 >= {threshold_pct}"))
define("body_ratio_at_least", lambda p, threshold_pct=50.0: flag(f"{BODY_SHARE} * 100 >= {threshold_pct}"))
define("consecutive_higher_highs", lambda p, n=3: f"cast({p.streak(f'high > {p.prev("high")}', n)} as double)")
define("consecutive_lower_lows", lambda p, n=3: f"cast({p.streak(f'low < {p.prev("low")}', n)} as double)")
define("outside_bar", lambda p: flag(f"high > {p.prev('high')} and low < {p.prev('low')}"))
define("inside_bar", lambda p, min_mother_range_atr_mult=0.0: flag(f"high < {p.prev('high')} and low > {p.prev('low')}" + (f" and {p.prev('high')} - {p.prev('low')} >= {float(min_mother_range_atr_mult)!r} * {atr(p, 14)}" if min_mother_range_atr_mult > 0 else "")))
define("belt_hold_bullish", lambda p, lower_wick_ratio_max=0.05, body_ratio_min=0.7: flag(f"close > open and {LOWER_SHARE} <= {lower_wick_ratio_max} and {BODY_SHARE} >= {body_ratio_min}"))
define("belt_hold_bearish", lambda p, upper_wick_ratio_max=0.05, body_ratio_min=0.7: flag(f"close < open and {UPPER_SHARE} <= {upper_wick_ratio_max} and {BODY_SHARE} >= {body_ratio_min}"))


def _gap(b: Bars, min_gap_atr_mult: float = 0.0) -> list[str]:
    wide = [f"{b.o()} - {b.h(1)} >= {float(min_gap_atr_mult)!r} * {atr(b.plan, 14)}"] if min_gap_atr_mult > 0 else []
    return [f"{b.o()} > {b.h(1)}", *wide]


def _engulfing(b: Bars, tolerance_pct: float = 0.0) -> list[str]:
    slack = f"{float(tolerance_pct)!r} * {b.body(1)}"
    return [b.falls(1), b.rises(), f"{b.o()} <= {b.c(1)} + {slack}", f"{b.c()} >= {b.o(1)} - {slack}"]


def _harami(b: Bars, containment_tolerance: float = 0.0) -> list[str]:
    slack = f"{float(containment_tolerance)!r} * {b.body(1)}"
    return [b.falls(1), b.rises(), f"{b.c()} <= {b.o(1)} + {slack}", f"{b.o()} >= {b.c(1)} - {slack}"]


def _confirmed(pattern):
    def rule(b: Bars, **params) -> list[str]:
        before = b.plan.let("coalesce(" + " and ".join(f"({x})" for x in pattern(b, **params)) + ", false)")
        return [b.plan.prev(before), f"{b.c()} > {b.c(1)}"]

    import inspect

    rule.__signature__ = inspect.signature(pattern)  # type: ignore[attr-defined]
    return rule


def _tweezer(b: Bars, tolerance_pct: float = 0.1) -> list[str]:
    spans = f"(nullif({b.h()} - {b.l()}, 0) + nullif({b.h(1)} - {b.l(1)}, 0)) / 2"
    return [f"abs({b.l()} - {b.l(1)}) <= {float(tolerance_pct)!r} * {spans}", b.falls(1), b.rises()]


def _kicker(b: Bars, body_ratio_threshold: float = 0.7, require_gap: int = 1) -> list[str]:
    return [b.falls(1), b.rises(), f"{b.share()} >= {body_ratio_threshold}", f"{b.o()} {'>' if require_gap else '>='} {b.o(1)}"]


def _star(b: Bars, small_body_ratio: float = 0.3, close_position_ratio: float = 0.5, require_gap: int = 0) -> list[str]:
    # the second gap is an overlap of the third bar's low with the middle bar, as it has always been
    gaps = [f"{b.h(1)} < {b.l(2)}", f"{b.l()} < {b.h(1)}"] if require_gap else []
    return [b.falls(2), f"{b.share(1)} < {small_body_ratio}", b.rises(), f"{b.body()} > 0.5 * {b.body(2)}", f"{b.c()} > {b.c(2)} + ({b.o(2)} - {b.c(2)}) * {float(close_position_ratio)!r}", *gaps]


def _baby(b: Bars, small_body_ratio: float = 0.1) -> list[str]:
    return [b.falls(2), f"{b.share(1)} < {small_body_ratio}", f"{b.h(1)} < {b.l(2)}", b.rises(), f"{b.l()} > {b.h(1)}"]


def _three(b: Bars, min_body_ratio: float = 0.0) -> list[str]:
    strong = [f"{b.share(k)} >= {min_body_ratio}" for k in range(3)] if min_body_ratio > 0 else []
    steps = [f"{b.c(k)} > {b.c(k + 1)} and {b.o(k)} > {b.o(k + 1)} and {b.o(k)} < {b.c(k + 1)}" for k in range(2)]
    return [*(b.rises(k) for k in range(3)), *steps, *strong]


def _methods(b: Bars, max_middle_body_ratio: float = 1.0) -> list[str]:
    inside = [f"{b.h(k)} <= {b.h(4)} and {b.l(k)} >= {b.l(4)}" for k in (1, 2, 3)]
    small = [f"{b.share(k)} <= {max_middle_body_ratio}" for k in (1, 2, 3)] if max_middle_body_ratio < 1 else []
    return [b.rises(4), *inside, *small, b.rises(), f"{b.c()} > {b.h(4)}"]


def _strike(b: Bars) -> list[str]:
    return [*(b.falls(k) for k in (1, 2, 3)), f"{b.c(1)} < {b.c(2)} and {b.c(2)} < {b.c(3)}", b.rises(), f"{b.o()} < {b.c(1)} and {b.c()} > {b.o(3)}"]


def _tasuki(b: Bars) -> list[str]:
    return [b.rises(2), b.rises(1), f"{b.o(1)} > {b.h(2)}", b.falls(), f"{b.o()} < {b.c(1)} and {b.o()} > {b.o(1)}", f"{b.c()} > {b.h(2)}"]


both("gap_up", "gap_down", _gap)
both("engulfing_bullish", "engulfing_bearish", _engulfing)
both("harami_bullish", "harami_bearish", _harami)
both("tweezer_bottom", "tweezer_top", _tweezer)
both("kicker_bullish", "kicker_bearish", _kicker)
both("morning_star", "evening_star", _star)
both("abandoned_baby_bullish", "abandoned_baby_bearish", _baby)
both("three_white_soldiers", "three_black_crows", _three)
both("rising_three_methods", "falling_three_methods", _methods)
both("three_inside_up", "three_inside_down", _confirmed(_harami))
both("three_outside_up", "three_outside_down", _confirmed(_engulfing))
both("three_line_strike_bullish", "three_line_strike_bearish", _strike)
both("tasuki_gap_upside", "tasuki_gap_downside", _tasuki)
