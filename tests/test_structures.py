"""Trees drawn at random are valid and run; the genetic search keeps to its space and improves."""

import random

import pytest

from candleforge.functions.indicators import REGISTRY
from candleforge.operators import structures as S
from candleforge.plans.conditions import Condition, Group, evaluate, leaves, parse
from candleforge.plans.market_queries import hourly


def test_kinds_of_all_indicators():
    found = {n: S.kind(n) for n in REGISTRY}
    assert {found[n] for n in ("ema", "close", "pivot_r1", "camarilla_s3", "bollinger_upper")} == {"level"}
    assert {found[n] for n in ("rsi", "adx", "stochastic_k")} == {"percent"} and found["hour"] == "time"
    assert {found[n] for n in ("bullish_candle", "ema_rising", "macd_divergence_bearish", "double_top_zigzag", "ttm_squeeze")} == {"flag"}
    assert {found[n] for n in ("macd_line", "cci", "zscore_close")} == {"signed"} and {found[n] for n in ("atr", "dist_close_ema", "avg_body_size")} == {"size"}


def test_candidates_are_valid_and_distinct():
    space = S.Space(most_leaves=5, most_depth=3, timeframes=S.coarser("1h"), other_timeframe=0.3)
    trees = S.candidates(space, 300)
    assert len({S.key(t) for t in trees}) == 300 and all(S.fits(t, space) for t in trees)
    assert all(S.key(parse(t.to_dict())) == S.key(t) for t in trees)
    assert {g for t in trees for g in [t.op if isinstance(t, Group) else "leaf"]} == {"AND", "OR", "NOT", "leaf"}
    every = [x for t in trees for x in leaves(t)]
    assert any(x.timeframe or x.value_timeframe for x in every) and all(S.kind(x.indicator) == S.kind(x.value) for x in every if isinstance(x.value, str))
    assert S.coarser("4h") == ("1d", "1w", "1mo") and S.candidates(space, 20) == trees[:20]
    with pytest.raises(ValueError):
        S.Space(names=("unheard_of",))


def test_trees_run(spark):
    quick = tuple(n for n in REGISTRY if S.kind(n) in ("level", "percent") and "sar" not in n and "supertrend" not in n)[:40] + ("bullish_candle", "atr", "hour")
    trees = S.candidates(S.Space(names=quick), 6)
    out = evaluate(hourly(spark, "/root/testdata/sf0.001"), {f"t{i}": t.to_dict() for i, t in enumerate(trees)}, pip=1.0)
    assert out.where(" or ".join(f"t{i} is null" for i in range(6))).count() == 0


def test_parts_of_trees():
    a, b, c = (Condition("rsi", ">", float(v)) for v in (10, 20, 30))
    tree = Group("AND", (a, Group("NOT", (b,))))
    assert S.paths(tree) == [(), (0,), (1,), (1, 0)] and S.at(tree, (1, 0)) == b and S.depth(tree) == 3
    assert S.put(tree, (1, 0), c) == Group("AND", (a, Group("NOT", (c,)))) and S.put(tree, (), c) == c
    assert S.penalised(10, 5, 10) == 5 and S.penalised(-10, 5, 10) == -15 and S.penalised(3, 0, 10) < -1e8 and S.penalised(10, 10, 10) == 10


def test_evolution_improves_and_keeps_to_the_space():
    space, batches = S.Space(most_leaves=4, most_depth=3), []

    def fitness(trees):
        batches.append(len(trees))
        return [float(sum(S.kind(x.indicator) == "percent" and x.operator == ">" for x in leaves(t))) - 0.1 * S.depth(t) for t in trees]

    found = S.evolve_trees(space, fitness, population=30, generations=15, seed=1)
    start = max(fitness(S.candidates(space, 30, 1)))
    assert found[0][0] >= max(start, 2.0) and all(S.fits(t, space) for _, t in found)
    assert len({S.key(t) for _, t in found}) == len(found) and len(batches) <= 16
    rng = random.Random(0)
    for _, t in found[:50]:
        assert S.fits(S.mutated(t, space, rng), space) and S.fits(S.crossed(t, found[0][1], space, rng), space)
