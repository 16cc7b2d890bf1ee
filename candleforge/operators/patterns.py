"""Chart patterns: pivots of a series, detectors over the pivots, and what becomes of each pattern.

Every detector looks at the newest pivots on a bar where one was added or moved, and
only at bars up to it. A pattern becomes a candidate on that bar, is confirmed when its neck is
crossed and invalidated when its limit is, whichever comes first. The rules follow the
published descriptions of the families; those of the shape family are kept to their geometry
(see the README for what that leaves out).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("candidate", "confirmed", "invalidated")


@dataclass
class Pivot:
    bar: int
    price: float
    side: int  # 1 high, -1 low; 2 and -2 beyond the one of its side before
    ratio: float = float("nan")

    @property
    def up(self) -> int:
        return (self.side > 0) - (self.side < 0)


@dataclass(frozen=True)
class Found:
    kind: str
    bar: int
    neck: float
    limit: float
    way: int  # 1 if it is confirmed upwards
    points: tuple[tuple[int, float], ...]
    level: int = 0


class Pivots:
    """Newest first; a pivot knows how its leg compares with the leg before."""

    def __init__(self, keep: int):
        self.keep, self.items = keep, []

    def add(self, bar: int, price: float, up: int) -> Pivot:
        p = Pivot(bar, price, up)
        if len(self.items) >= 2:
            last, before = self.items[0].price, self.items[1].price
            p.ratio = round(abs(last - price) / abs(before - last), 3) if before != last else float("nan")
            if up * price > up * before:
                p.side = 2 * up
        self.items.insert(0, p)
        del self.items[self.keep :]
        return p

    def replace(self, bar: int, price: float, up: int) -> Pivot:
        del self.items[0]
        return self.add(bar, price, up)

    def higher(self) -> Pivots:
        """The pivots of the next level: record highs and lows, with what lies between where sides would repeat."""
        out = Pivots(self.keep)
        held: dict[int, Pivot] = {}
        for p in reversed(self.items):
            up = p.up
            if abs(p.side) < 2:
                if out.items and (up not in held or p.price * up > held[up].price * up):
                    held[up] = p
                continue
            if out.items:
                last = out.items[0]
                if last.up == up:
                    if up * last.price < up * p.price:
                        del out.items[0]
                    elif -up in held:
                        out.add(held[-up].bar, held[-up].price, -up)
                    else:
                        continue
                elif up in held and -up in held and up * held[up].price > up * p.price:
                    out.add(held[up].bar, held[up].price, up)
                    out.add(held[-up].bar, held[-up].price, -up)
                held.clear()
            out.add(p.bar, p.price, up)
        if len(out.items) >= len(self.items):
            out.items.clear()
        return out


def extremes(high: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bars that are the highest, and the lowest, of the last ``length``."""
    top = pd.Series(high).rolling(length).max().to_numpy()
    bottom = pd.Series(low).rolling(length).min().to_numpy()
    return high == top, low == bottom


def walk(high: np.ndarray, low: np.ndarray, length: int, keep: int = 50, forced: bool = True) -> Iterator[tuple[int, Pivots]]:
    """The bars on which a pivot is added or moved, with the pivots then known."""
    tops, bottoms = extremes(high, low, length)
    known = Pivots(keep)
    for i in np.flatnonzero(tops | bottoms) if not forced else range(length - 1, len(high)):
        i = int(i)
        top, bottom = bool(tops[i]), bool(bottoms[i])
        if not known.items:
            if top or bottom:
                known.add(i, high[i] if top else low[i], 1 if top else -1)
                yield i, known
            continue
        up = known.items[0].up
        same, other = (top, bottom) if up > 0 else (bottom, top)
        changed = False
        value = high[i] if up > 0 else low[i]
        if same and up * value >= up * known.items[0].price:
            known.replace(i, value, up)
            changed = True
        if other and (not changed or up > 0):
            known.add(i, low[i] if up > 0 else high[i], -up)
            changed = True
        elif forced and not changed and i - known.items[0].bar >= length:
            window = (low if up > 0 else high)[i - length + 1 : i + 1]
            at = i - length + 1 + int(len(window) - 1 - np.argmin(window[::-1]) if up > 0 else len(window) - 1 - np.argmax(window[::-1]))
            if at > known.items[0].bar:
                known.add(at, float(low[at] if up > 0 else high[at]), -up)
                changed = True
        if changed:
            yield i, known


def points(pivots: list[Pivot]) -> tuple[tuple[int, float], ...]:
    return tuple((p.bar, float(p.price)) for p in reversed(pivots))


# families


def double_zigzag(high: np.ndarray, low: np.ndarray, length: int = 10, max_risk_ratio: float = 30.0) -> Iterator[Found]:
    for i, known in walk(high, low, length, 10, forced=False):
        if len(known.items) < 4:
            continue
        c, b, a = known.items[1:4]
        risk, reward = abs(c.price - a.price), abs(c.price - b.price)
        if risk + reward == 0 or 100 * risk / (risk + reward) >= max_risk_ratio:
            continue
        if a.side == 2 and b.side < 0 and c.side == 1:
            yield Found("double_top_zigzag", i, b.price, a.price, -1, points([c, b, a]))
        if a.side == -2 and b.side > 0 and c.side == -1:
            yield Found("double_bottom_zigzag", i, b.price, a.price, 1, points([c, b, a]))


def reversals(high: np.ndarray, low: np.ndarray, zigzag_length: int = 8, error_percent: float = 13.0, shoulder_start: float = 0.1, shoulder_end: float = 0.5, depth: int = 50) -> Iterator[Found]:
    tap = lambda r: abs(r - 1) <= error_percent / 100
    shoulder = lambda r: shoulder_start <= r <= shoulder_end
    newest = -1
    for i, known in walk(high, low, zigzag_length, depth):
        if known.items[0].bar == newest:
            continue
        newest, level, number = known.items[0].bar, known, 0
        while len(level.items) > 4:
            c, b, a, x = level.items[:4]
            head = 1 / shoulder_end <= a.ratio <= 1 / shoulder_start
            shoulders = shoulder(c.ratio) and tap(b.ratio) and head and shoulder(x.ratio)
            top = x.up < 0
            name = None
            if tap(c.ratio) and tap(b.ratio) and tap(a.ratio) and shoulder(x.ratio):
                name = "triple_top" if top else "triple_bottom"
            elif shoulders:
                name = "head_and_shoulders" if top else "inverse_head_and_shoulders"
            elif shoulder(c.ratio) and tap(b.ratio):
                name = "inverted_cup_and_handle" if top else "cup_and_handle"
            if name:
                used = level.items[: 4 if "cup" in name else 6]
                outer = [p.price for p in used if p.up == (1 if top else -1)]
                inner = [p.price for p in used[:4] if p.up == (-1 if top else 1)]
                yield Found(name, i, min(inner) if top else max(inner), max(outer) if top else min(outer), -1 if top else 1, points(used), number)
            level, number = level.higher(), number + 1


def abcd(high: np.ndarray, low: np.ndarray, zigzag_length: int = 13, min_abc_ratio: float = 0.5, max_abc_ratio: float = 1.0) -> Iterator[Found]:
    """A leg, a part of it back, and the projected leg's end as target; the first point is the stop."""
    last = None
    for i, known in walk(high, low, zigzag_length, 50):
        if len(known.items) < 3:
            continue
        c, b, a = known.items[:3]
        if not min_abc_ratio <= c.ratio <= max_abc_ratio or not c.ratio:
            continue
        way = 1 if b.up > 0 else -1
        target = c.price + (b.price - c.price) / c.ratio
        now = high[i] if way > 0 else low[i]
        done = (now - c.price) / (target - c.price) if target != c.price else 1.0
        if 0 <= done < 0.382 and (a.bar, b.bar) != last:
            last = (a.bar, b.bar)
            yield Found("abcd_bullish" if way > 0 else "abcd_bearish", i, target, a.price, way, points([c, b, a]))


def abc(high: np.ndarray, low: np.ndarray, zigzag_length: int = 13, target_ratio: float = 1.0, stop_ratio: float = 0.0, depth: int = 200) -> Iterator[Found]:
    seen: set[tuple[int, int, int]] = set()
    for i, known in walk(high, low, zigzag_length, depth):
        level, number = known, 0
        while len(level.items) > 3:
            c, b, a = level.items[:3]
            key = (a.bar, b.bar, c.bar)
            if 0.618 <= c.ratio <= 0.786 and key not in seen:
                seen.add(key)
                way = 1 if b.up > 0 else -1
                yield Found("abc_bullish" if way > 0 else "abc_bearish", i, c.price + (b.price - a.price) * target_ratio, c.price + (b.price - a.price) * stop_ratio, way, points([c, b, a]), number)
            level, number = level.higher(), number + 1


def impulses(high: np.ndarray, low: np.ndarray, zigzag_length: int = 5, depth: int = 200) -> Iterator[Found]:
    """Five waves within a leg of a higher level: the third isn't the shortest and the fourth stays off the first."""
    seen: set[tuple[int, ...]] = set()
    for i, known in walk(high, low, zigzag_length, depth):
        if len(known.items) < 6:
            continue
        p = list(reversed(known.items[:6]))
        way = p[5].up
        v = [way * x.price for x in p]
        w1, w3, w5 = v[1] - v[0], v[3] - v[2], v[5] - v[4]
        bars = tuple(x.bar for x in p)
        if min(w1, w3, w5) > 0 and v[2] > v[0] and v[4] > v[1] and v[3] > v[1] and v[5] > v[3] and w3 > min(w1, w5) and bars not in seen:
            seen.add(bars)
            # the end of the move: back through the fourth wave confirms it, a new extreme ends it
            yield Found("impulse_wave_bullish" if way > 0 else "impulse_wave_bearish", i, p[4].price, p[5].price, -way, points(list(reversed(p))))


@dataclass(frozen=True)
class Line:
    bar: float
    price: float
    slope: float

    def at(self, bar: float) -> float:
        return self.price + self.slope * (bar - self.bar)

    @classmethod
    def through(cls, a: Pivot, b: Pivot) -> Line:
        return cls(a.bar, a.price, (b.price - a.price) / (b.bar - a.bar))


def two_lines(pivots: list[Pivot], high: np.ndarray, low: np.ndarray, error: float = 0.2) -> tuple[Line, Line] | None:
    """The lines through the outer highs and lows, if the pivots between and nearly all bars keep to them."""
    p = list(reversed(pivots))
    tops, bottoms = [x for x in p if x.up > 0], [x for x in p if x.up < 0]
    if min(len(tops), len(bottoms)) < 2 or tops[0].bar == tops[-1].bar or bottoms[0].bar == bottoms[-1].bar:
        return None
    upper, lower = Line.through(tops[0], tops[-1]), Line.through(bottoms[0], bottoms[-1])
    first, last = p[0].bar, p[-1].bar
    height = max(upper.at(first) - lower.at(first), upper.at(last) - lower.at(last))
    if min(upper.at(first) - lower.at(first), upper.at(last) - lower.at(last)) <= 0:
        return None
    for x in tops[1:-1]:
        if abs(x.price - upper.at(x.bar)) > error * height:
            return None
    for x in bottoms[1:-1]:
        if abs(x.price - lower.at(x.bar)) > error * height:
            return None
    bars = np.arange(first, last + 1)
    out = (high[first : last + 1] > upper.price + upper.slope * (bars - upper.bar) + 1e-9) | (low[first : last + 1] < lower.price + lower.slope * (bars - lower.bar) - 1e-9)
    return None if out.mean() >= 0.2 else (upper, lower)


def shape_of(upper: Line, lower: Line, first: int, last: int, flat: float = 0.2) -> str | None:
    """One of 13 names by the lines' directions and how their distance changes."""
    before, after = upper.at(first) - lower.at(first), upper.at(last) - lower.at(last)
    span, tall = last - first, max(before, after)
    way = lambda x: 0 if abs(x.slope * span) <= flat * tall else (1 if x.slope > 0 else -1)
    u, d = way(upper), way(lower)
    if abs(after - before) <= flat * tall:
        return {1: "ascending_channel", -1: "descending_channel", 0: "ranging_channel"}[u if u == d else 0]
    if after > before:
        return {(1, 1): "rising_wedge_expanding", (-1, -1): "falling_wedge_expanding", (1, -1): "diverging_triangle", (1, 0): "ascending_triangle_expanding", (0, -1): "descending_triangle_expanding"}.get((u, d))
    return {(1, 1): "rising_wedge_contracting", (-1, -1): "falling_wedge_contracting", (-1, 1): "converging_triangle", (-1, 0): "descending_triangle_contracting", (0, 1): "ascending_triangle_contracting"}.get((u, d))


#: Lengths and depths of the four pivot series that channels and flags are looked for in.
SERIES = ((3, 144), (5, 89), (8, 55), (13, 34))


def channels(high: np.ndarray, low: np.ndarray, bar_ratio_limit: float = 0.382) -> Iterator[Found]:
    """13 kinds of channels, wedges and triangles on six pivots of the third series."""
    length, depth = SERIES[2]
    seen: set[tuple[str, int, int]] = set()
    for i, known in walk(high, low, length, depth):
        p = known.items[:6]
        if len(p) < 6:
            continue
        gaps = [a.bar - b.bar for a, b in zip(p, p[1:], strict=False)]
        if min(gaps) <= 0 or any(not bar_ratio_limit <= a / b <= 1 / bar_ratio_limit for a, b in zip(gaps, gaps[2:], strict=False)):
            continue
        lines = two_lines(p, high, low)
        kind = lines and shape_of(*lines, p[-1].bar, p[0].bar)
        if kind and (kind, p[-1].bar, p[1].bar) not in seen:
            seen.add((kind, p[-1].bar, p[1].bar))
            upper, lower = lines
            way = 1 if p[0].up < 0 else -1
            yield Found(kind, i, upper.at(i) if way > 0 else lower.at(i), lower.at(i) if way > 0 else upper.at(i), way, points(p))


def flags(high: np.ndarray, low: np.ndarray, flag_ratio: float = 0.618) -> Iterator[Found]:
    """A pole, and a base of five pivots that gives back no more than ``flag_ratio`` of it: parallel a flag, converging a pennant."""
    seen: set[tuple[str, int]] = set()
    for length, depth in SERIES:
        for i, known in walk(high, low, length, depth):
            p = known.items[:6]
            if len(p) < 6:
                continue
            base, start = p[:5], p[5]
            way = -start.up
            pole = abs(base[4].price - start.price)
            depth_back = max(way * (base[4].price - x.price) for x in base)
            if pole <= 0 or depth_back > flag_ratio * pole or any(way * (x.price - base[4].price) > 0.2 * pole for x in base[:4]):
                continue
            lines = two_lines(base, high, low)
            kind = lines and shape_of(*lines, base[4].bar, base[0].bar)
            if not kind or "expanding" in kind or kind == "diverging_triangle":
                continue
            name = ("bullish" if way > 0 else "bearish") + ("_flag" if "channel" in kind or "wedge" in kind else "_pennant")
            if (name, start.bar) in seen:
                continue
            seen.add((name, start.bar))
            upper, lower = lines
            yield Found(name, i, upper.at(i) if way > 0 else lower.at(i), lower.at(i) if way > 0 else upper.at(i), way, points(p))


def shapes(high: np.ndarray, low: np.ndarray, length: int = 8, tolerance: float = 0.15, symmetry: float = 3.0) -> Iterator[Found]:
    """Geometry of equal tops, heads, boxes, triangles, wedges, flags and pennants on the newest pivots."""
    for i, known in walk(high, low, length, 60):
        p = known.items
        near = lambda a, b, tall: abs(a.price - b.price) <= tolerance * tall
        for n, name in ((3, "double"), (5, "triple")):
            if len(p) <= n:
                continue
            used = p[:n]
            way = -used[0].up
            outer, inner = used[::2], used[1::2]
            tall = min(abs(x.price - y.price) for x in outer for y in inner)
            gaps = [a.bar - b.bar for a, b in zip(outer, outer[1:], strict=False)]
            fair = max(gaps) <= symmetry * max(1, min(gaps)) if len(gaps) > 1 else True
            neck = (min if way < 0 else max)(x.price for x in inner)
            limit = (max if way < 0 else min)(x.price for x in outer)
            lead = abs(p[n].price - used[-1].price) >= tall
            if fair and lead and tall > 0 and all(near(a, b, tall) for a in outer for b in outer):
                yield Found(f"{name}_{'top' if way < 0 else 'bottom'}_shape", i, neck, limit, way, points(used))
            if n == 5 and fair and lead and tall > 0:
                right, head, left = outer
                beyond = min(-way * (head.price - left.price), -way * (head.price - right.price))
                if beyond > tolerance * tall and near(left, right, tall + beyond):
                    slope = Line.through(inner[1], inner[0])
                    yield Found(("" if way < 0 else "inverse_") + "head_and_shoulders_shape", i, slope.at(i), head.price, way, points(used))
        if len(p) < 5:
            continue
        used, before = p[:4], p[4]
        lines = two_lines(used, high, low)
        kind = lines and shape_of(*lines, used[-1].bar, used[0].bar)
        if not kind:
            continue
        upper, lower = lines
        pole = used[-1].price - before.price
        tall = upper.at(i) - lower.at(i)
        strong = abs(pole) >= 2 * tall
        make = lambda name, way: Found(name, i, upper.at(i) if way > 0 else lower.at(i), lower.at(i) if way > 0 else upper.at(i), way, points(used))  # noqa: B023, E731
        side = 1 if pole > 0 else -1
        if kind == "ranging_channel":
            for name in ("box_shape", "box_shape_legacy"):
                yield make(("ascending_" if side > 0 else "descending_") + name, side)
        elif kind in ("ascending_triangle_contracting", "descending_triangle_contracting"):
            way = 1 if kind.startswith("asc") else -1
            for name in ("triangle_shape", "triangle_shape_legacy"):
                yield make(("ascending_" if way > 0 else "descending_") + name, way)
        elif kind == "rising_wedge_contracting":
            yield make("rising_wedge_shape", -1)
            yield make("rising_wedge_shape_x", -1)
        elif kind == "falling_wedge_contracting":
            yield make("falling_wedge_shape", 1)
        if strong and kind == "converging_triangle":
            yield make(f"{'bullish' if side > 0 else 'bearish'}_pennant_shape", side)
        if strong and kind == ("descending_channel" if side > 0 else "ascending_channel"):
            yield make(f"{'bullish' if side > 0 else 'bearish'}_flag_shape", side)


FAMILIES: tuple[Callable[..., Iterator[Found]], ...] = (double_zigzag, reversals, abcd, abc, impulses, channels, flags, shapes)
#: How many names of :data:`NAMES`, in their order, each family has.
_SIZES = (2, 6, 2, 2, 2, 13, 4, 21)
#: Names of all patterns, by family.
NAMES = (
    "double_top_zigzag double_bottom_zigzag triple_top triple_bottom cup_and_handle inverted_cup_and_handle head_and_shoulders inverse_head_and_shoulders abcd_bullish abcd_bearish abc_bullish abc_bearish impulse_wave_bullish impulse_wave_bearish "
    "ascending_channel descending_channel ranging_channel rising_wedge_expanding falling_wedge_expanding diverging_triangle ascending_triangle_expanding descending_triangle_expanding rising_wedge_contracting falling_wedge_contracting converging_triangle descending_triangle_contracting ascending_triangle_contracting bullish_flag bearish_flag bullish_pennant bearish_pennant "
    "double_top_shape double_bottom_shape triple_top_shape triple_bottom_shape head_and_shoulders_shape inverse_head_and_shoulders_shape ascending_box_shape descending_box_shape ascending_box_shape_legacy descending_box_shape_legacy ascending_triangle_shape descending_triangle_shape ascending_triangle_shape_legacy descending_triangle_shape_legacy rising_wedge_shape rising_wedge_shape_x falling_wedge_shape bullish_pennant_shape bearish_pennant_shape bullish_flag_shape bearish_flag_shape"
).split()


FAMILY = dict(zip(NAMES, (f for f, n in zip(FAMILIES, _SIZES, strict=True) for _ in range(n)), strict=True))


def parameters(name: str) -> dict[str, float]:
    """What a pattern's detector can be given, with defaults."""
    return {k: v.default for k, v in list(inspect.signature(FAMILY[name]).parameters.items())[2:]}


def first_cross(x: np.ndarray, level: float, up: bool, start: int) -> int:
    """The first bar from ``start`` on where ``x`` crosses the level, or the number of bars."""
    n = len(x)
    for a in range(start, n, 512):
        part, before = x[a : a + 512], x[max(a - 1, 0) : min(a + 511, n - 1)] if a else np.concatenate(([level], x[: min(511, n - 1)]))
        hit = np.flatnonzero((part > level) & (before <= level) if up else (part < level) & (before >= level))
        if len(hit):
            return a + int(hit[0])
    return n


def events(high: np.ndarray, low: np.ndarray, families: tuple[Callable[..., Iterator[Found]], ...] = FAMILIES, **params: float) -> list[tuple]:
    """``(kind, status, bar, neck, limit, level, point bars, point prices)`` of every pattern of ``families``, each found once."""
    out, seen = [], set()
    for family in families:
        for f in family(high, low, **params):
            key = (f.kind, tuple(b for b, _ in f.points))
            if key in seen:
                continue
            seen.add(key)
            tail = (float(f.neck), float(f.limit), f.level, [b for b, _ in f.points], [p for _, p in f.points])
            out.append((f.kind, "candidate", f.bar, *tail))
            good = first_cross(high if f.way > 0 else low, f.neck, f.way > 0, f.bar)
            bad = first_cross(low if f.way > 0 else high, f.limit, f.way < 0, f.bar)
            if good < len(high) and (good < bad or (good == bad and not f.kind.endswith(("_shape", "_legacy", "_x")))):
                out.append((f.kind, "confirmed", good, *tail))
            elif bad < len(high):
                out.append((f.kind, "invalidated", bad, *tail))
    return out


EVENTS = "symbol string, timeframe string, pattern_id string, pattern_type string, status string, event_bar long, neckline_price double, limit_price double, level int, point_bars array<long>, point_prices array<double>"


def detect(bars: DataFrame) -> DataFrame:
    """A row an event of every pattern on each series."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bar_index")
        rows = events(x["high"].to_numpy(float), x["low"].to_numpy(float))
        s, t = x["symbol"].iloc[0], x["timeframe"].iloc[0]
        return pd.DataFrame([(s, t, f"{k}_{'_'.join(map(str, pb))}", k, st, b, neck, limit, level, pb, pp) for k, st, b, neck, limit, level, pb, pp in rows], columns=[c.split()[0] for c in EVENTS.split(", ")])

    return bars.select("symbol", "timeframe", "bar_index", "high", "low").groupBy("symbol", "timeframe").applyInPandas(run, EVENTS)


def with_patterns(bars: DataFrame, names: list[str], state: str = "confirmed") -> DataFrame:
    """``bars`` with a 0 or 1 column a pattern: 1 on bars where one enters ``state``."""
    if state not in STATES:
        raise ValueError(f"unknown state: {state}")
    if unknown := [n for n in names if n not in NAMES]:
        raise ValueError(f"unknown pattern: {unknown[0]}")
    hits = detect(bars).where((F.col("status") == state) & F.col("pattern_type").isin(names))
    flags_ = hits.groupBy("symbol", "timeframe", F.col("event_bar").alias("bar_index")).agg(*[F.max((F.col("pattern_type") == n).cast("double")).alias(n) for n in names])
    return bars.join(flags_, ["symbol", "timeframe", "bar_index"], "left").fillna(0.0, names)
