"""Search over the structure of condition trees: what an indicator's values are, random trees, and a genetic search that recombines them.

Every registered indicator has a kind, told by its name: a flag, a price level, a percentage, a size in price or a signed
number. The kind says which operators make sense, what it can be compared with and which literals are drawn.
"""

from __future__ import annotations

import inspect
import json
import random
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from candleforge.functions.indicators import REGISTRY
from candleforge.operators.bars import MINUTES
from candleforge.plans.conditions import Condition, Group, Node, leaves

#: Names of each kind as patterns; the first that matches decides, what none matches is signed.
KINDS = {
    "level": r"open|high|low|close|ema|sma|vwap|donchian_mid|(bollinger|keltner)_(upper|middle|lower)|(highest|lowest)_\w+|prev_day_(high|low|mid)|((woodie|fib)_)?pivot(_[rs]\d)?|(woodie|camarilla|fib_pivot)_[rs]\d|ichimoku_(tenkan|kijun|senkou_[ab])|supertrend_line|parabolic_sar_line|linreg_(value|upper|lower)|rolling_mean_(high|low)|fib_level",
    "percent": r"rsi|stochastic_[kd]|mfi|adx|(plus|minus)_di|aroon_(up|down)|percentile_rank_\w+|connors_rsi|choppiness_index|rsi_rolling_mean|adx_rolling_mean|donchian_percent_position|today_range_position",
    "time": r"hour|month|weekday|minutes_since_\w+",
    "size": r"atr|adr|candle_body|dist_\w+|\w+_body_size|body_size_std|avg_(upper|lower)_wick|atr_rolling_mean|close_rolling_std|bb_width(_percent)?|historical_volatility",
    "signed": r"macd_\w+(?<!bearish)(?<!bullish)|cci|williams_r|cmo|\w+_roc|\w*slope\w*|zscore_\w+|\w+_deviation|obv|cmf|ad_line|chaikin_oscillator|coppock_curve|(bull|bear)_power|correlation_\w+|aroon_oscillator|linreg_\w+|bb_percent_b|today_range_pct_of_adr|ichimoku_price_vs_cloud|ichimoku_chikou_signal|\w+_direction",
    "flag": r"\w+",
}
CROSSING = (">", "<", "crosses_above", "crosses_below")
OPERATORS = {"flag": ("==",), "level": CROSSING, "percent": CROSSING, "time": (">=", "<="), "size": (">", "<"), "signed": CROSSING}
LITERALS = {"flag": (1.0,), "percent": tuple(float(x) for x in range(10, 100, 10)), "time": tuple(float(x) for x in range(0, 24, 2)), "signed": (-100.0, -1.0, 0.0, 1.0, 100.0), "size": (0.5, 1.0, 1.5, 2.0, 3.0)}
#: Chances of AND, OR and NOT, and of a comparison with an indicator where one is possible.
GROUPS, PAIRED = {"AND": 0.55, "OR": 0.30, "NOT": 0.15}, 0.5


def kind(name: str) -> str:
    if name not in REGISTRY:
        raise ValueError(f"unknown indicator: {name}")
    return next(k for k, p in KINDS.items() if re.fullmatch(p, name))


@dataclass(frozen=True)
class Space:
    """What is drawn: indicators, leaves and depth of a tree, factors of default parameters, and other timeframes."""

    names: tuple[str, ...] = field(default_factory=lambda: tuple(sorted(REGISTRY)))
    most_leaves: int = 4
    most_depth: int = 3
    factors: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)
    timeframes: tuple[str, ...] = ()
    other_timeframe: float = 0.0

    def __post_init__(self) -> None:
        if not self.names or self.most_leaves < 1 or self.most_depth < 1:
            raise ValueError("a space needs indicators, leaves and depth")
        if unknown := [n for n in self.names if n not in REGISTRY]:
            raise ValueError(f"unknown indicator: {unknown[0]}")

    def by_kind(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for n in self.names:
            out.setdefault(kind(n), []).append(n)
        return out


def coarser(timeframe: str) -> tuple[str, ...]:
    """Timeframes longer than the one given, the shortest first."""
    return tuple(sorted((t for t in MINUTES if MINUTES[t] > MINUTES[timeframe]), key=MINUTES.__getitem__))


def drawn_params(name: str, space: Space, rng: random.Random) -> dict:
    """A value for each length of an indicator, by a factor of its default (2 at least)."""
    out = {}
    for p in list(inspect.signature(REGISTRY[name]).parameters.values())[1:]:
        if re.search(r"length|period|lookback", p.name) and isinstance(p.default, int) and not isinstance(p.default, bool):
            out[p.name] = max(2, round(p.default * rng.choice(space.factors)))
    return out


def drawn_leaf(space: Space, rng: random.Random) -> Condition:
    kinds = space.by_kind()
    k = rng.choice(sorted(kinds))
    name = rng.choice(kinds[k])
    frame = lambda: rng.choice(space.timeframes) if space.timeframes and rng.random() < space.other_timeframe else None
    op = rng.choice(OPERATORS[k])
    paired = k == "level" or (k in ("percent", "signed") and rng.random() < PAIRED)
    if paired:  # a level has no literal: without a partner it is compared with the close, and the close with its own past
        partners = [n for n in kinds[k] if n != name] or ["close" if k == "level" else name]
        other = rng.choice(partners)
        return Condition(name, op, other, drawn_params(name, space, rng), drawn_params(other, space, rng), frame(), frame())
    mode = {"literal_mode": "atr_pct"} if k == "size" else {}
    value = rng.choice(LITERALS[k]) * (100 if k == "size" else 1)
    return Condition(name, op, value, drawn_params(name, space, rng), timeframe=frame(), **mode)


def drawn_tree(space: Space, rng: random.Random, most_leaves: int | None = None, depth: int = 1) -> Node:
    """A tree within the space's leaves and depth."""
    n = rng.randint(1, space.most_leaves if most_leaves is None else most_leaves)
    if n == 1 or depth >= space.most_depth:
        leaf = drawn_leaf(space, rng)
        return Group("NOT", (leaf,)) if depth < space.most_depth and rng.random() < GROUPS["NOT"] else leaf
    op = rng.choices(["AND", "OR"], [GROUPS["AND"], GROUPS["OR"]])[0]
    left = rng.randint(1, n - 1)
    return Group(op, (drawn_tree(space, rng, left, depth + 1), drawn_tree(space, rng, n - left, depth + 1)))


def key(tree: Node) -> str:
    return json.dumps(tree.to_dict(), sort_keys=True)


def candidates(space: Space, n: int, seed: int = 42) -> list[Node]:
    """Distinct random trees, fewer than ``n`` if the space has fewer."""
    rng, seen = random.Random(seed), {}
    for _ in range(max(50 * n, 1000)):
        tree = drawn_tree(space, rng)
        seen.setdefault(key(tree), tree)
        if len(seen) >= n:
            break
    return list(seen.values())


def paths(tree: Node, here: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
    """The places of all nodes, the root's first."""
    return [here] + ([] if isinstance(tree, Condition) else [p for i, c in enumerate(tree.children) for p in paths(c, (*here, i))])


def at(tree: Node, path: Iterable[int]) -> Node:
    for i in path:
        tree = tree.children[i]
    return tree


def put(tree: Node, path: tuple[int, ...], new: Node) -> Node:
    if not path:
        return new
    return Group(tree.op, tuple(put(c, path[1:], new) if i == path[0] else c for i, c in enumerate(tree.children)))


def depth(tree: Node) -> int:
    return 1 if isinstance(tree, Condition) else 1 + max(depth(c) for c in tree.children)


def fits(tree: Node, space: Space) -> bool:
    return len(leaves(tree)) <= space.most_leaves and depth(tree) <= space.most_depth + 1


def crossed(a: Node, b: Node, space: Space, rng: random.Random) -> Node:
    """``a`` with a part exchanged for one of ``b``; ``a`` itself if no try keeps within the space."""
    for _ in range(10):
        child = put(a, rng.choice(paths(a)), at(b, rng.choice(paths(b))))
        if fits(child, space):
            return child
    return a


def mutated(tree: Node, space: Space, rng: random.Random) -> Node:
    """A leaf drawn anew, or AND and OR exchanged, or a NOT put on or taken off."""
    path = rng.choice(paths(tree))
    node = at(tree, path)
    if isinstance(node, Group) and node.op != "NOT" and rng.random() < 0.5:
        return put(tree, path, Group("OR" if node.op == "AND" else "AND", node.children))
    if rng.random() < 0.3:
        new = put(tree, path, node.children[0] if isinstance(node, Group) and node.op == "NOT" else Group("NOT", (node,)))
        return new if fits(new, space) else tree
    own = [p for p in paths(tree) if isinstance(at(tree, p), Condition)]
    return put(tree, rng.choice(own), drawn_leaf(space, rng))


def penalised(score: float, trades: int, least: int) -> float:
    """A score that few trades can't win with: below ``least`` it shrinks in proportion, losses grow; none at all lose to everything."""
    if trades >= least:
        return score
    if trades <= 0:
        return -1e9
    share = trades / max(1, least)
    return score * share if score > 0 else score * (2 - share)


def evolve_trees(space: Space, fitness: Callable[[list[Node]], list[float]], population: int = 20, generations: int = 10, elite: int = 2, mutation: float = 0.3, seed: int = 42) -> list[tuple[float, Node]]:
    """A genetic search over trees; ``fitness`` gets all new trees of a generation, to run them as one Spark job. Best first."""
    rng = random.Random(seed)
    current, known = candidates(space, population, seed), {}
    for _ in range(generations):
        new = [t for k, t in {key(t): t for t in current}.items() if k not in known]
        known |= {key(t): (f, t) for t, f in zip(new, fitness(new) if new else [], strict=True)}
        ranked = sorted((known[key(t)] for t in current), key=lambda r: -r[0])
        pick = lambda: max(rng.sample(ranked, min(3, len(ranked))), key=lambda r: r[0])[1]  # noqa: B023, E731
        current = [t for _, t in ranked[:elite]]
        while len(current) < population:
            child = crossed(pick(), pick(), space, rng)
            current.append(mutated(child, space, rng) if rng.random() < mutation else child)
    return sorted(known.values(), key=lambda r: -r[0])
