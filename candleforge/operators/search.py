"""Parameter spaces, random and evolving search, and condition trees drawn at random."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from candleforge.plans.conditions import Condition, Group, Node

Space = dict[str, list[Any]]


def values(low: float, high: float, step: float) -> list[float]:
    """From ``low`` to ``high``, both included, to three decimals."""
    if step <= 0:
        raise ValueError("step must be positive")
    return [round(low + k * step, 3) for k in range(int((high - low) / step + 1e-9) + 1)]


def grid(space: Space) -> Iterator[dict[str, Any]]:
    names = list(space)
    return (dict(zip(names, v, strict=True)) for v in itertools.product(*space.values()))


def grid_table(spark: SparkSession, space: Space) -> DataFrame:
    """The grid as rows, one dimension joined after the other, with an id in the order of the dimensions."""
    out: DataFrame | None = None
    for name, items in space.items():
        one = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(items)], f"i_{name} int, {name} string")
        out = one if out is None else out.crossJoin(one)
    if out is None:
        raise ValueError("a space needs a dimension")
    index, size = "0", 1
    for name, items in reversed(space.items()):
        index, size = f"{index} + i_{name} * {size}", size * len(items)
    return out.selectExpr(f"cast({index} as long) as param_id", *space)


def sampled(space: Space, n: int, seed: int = 42) -> list[dict[str, Any]]:
    """Distinct combinations, fewer than ``n`` if the space has fewer."""
    rng, seen = random.Random(seed), {}
    for _ in range(max(50 * n, 1000)):
        one = {k: rng.choice(v) for k, v in space.items()}
        seen.setdefault(json.dumps(one, sort_keys=True, default=str), one)
        if len(seen) >= n:
            break
    return list(seen.values())


def evolve(space: Space, fitness: Callable[[list[dict]], list[float]], population: int = 20, generations: int = 10, elite: int = 2, mutation: float = 0.2, seed: int = 42) -> list[tuple[float, dict]]:
    """A genetic search; ``fitness`` gets a whole generation, to run it as one job. Best first."""
    rng = random.Random(seed)
    current = sampled(space, population, seed)
    known: dict[str, tuple[float, dict]] = {}
    key = lambda x: json.dumps(x, sort_keys=True, default=str)
    for _ in range(generations):
        new = [x for x in {key(x): x for x in current}.values() if key(x) not in known]
        known |= {key(x): (f, x) for x, f in zip(new, fitness(new) if new else [], strict=True)}
        ranked = sorted((known[key(x)] for x in current), key=lambda r: -r[0])
        pick = lambda: max(rng.sample(ranked, min(3, len(ranked))), key=lambda r: r[0])[1]  # noqa: B023, E731
        current = [x for _, x in ranked[:elite]]
        while len(current) < population:
            a, b = pick(), pick()
            child = {k: rng.choice((a[k], b[k])) for k in space}
            current.append({k: rng.choice(space[k]) if rng.random() < mutation else v for k, v in child.items()})
    return sorted(known.values(), key=lambda r: -r[0])


def estimate_density(space: Space, fitness: Callable[[dict], float], trials: int = 50, start: int = 10, best: float = 0.25, seed: int = 42) -> list[tuple[float, dict]]:
    """A sequential search that draws each value by how much oftener the best trials have it than the rest."""
    rng, done = random.Random(seed), []
    for t in range(trials):
        if t < start:
            one = {k: rng.choice(v) for k, v in space.items()}
        else:
            done.sort(key=lambda r: -r[0])
            cut = max(1, int(best * len(done)))
            weight = lambda k, v: (1 + sum(x[k] == v for _, x in done[:cut])) / (1 + sum(x[k] == v for _, x in done[cut:]))  # noqa: B023, E731
            one = {k: rng.choices(v, [weight(k, x) for x in v])[0] for k, v in space.items()}
        done.append((fitness(one), one))
    return sorted(done, key=lambda r: -r[0])


def random_tree(pool: list[dict[str, Any]], leaves: int, rng: random.Random) -> Node:
    """A tree of ``leaves`` comparisons from ``pool`` entries ``{indicator, operators, values, params}``."""
    if leaves <= 1:
        x = rng.choice(pool)
        leaf = Condition(x["indicator"], rng.choice(x["operators"]), rng.choice(x["values"]), x.get("params", {}))
        return Group("NOT", (leaf,)) if rng.random() < 0.15 else leaf
    left = rng.randint(1, leaves - 1)
    op = "AND" if rng.random() < 0.55 / 0.85 else "OR"
    return Group(op, (random_tree(pool, left, rng), random_tree(pool, leaves - left, rng)))


def random_trees(pool: list[dict[str, Any]], n: int, most_leaves: int = 4, seed: int = 42) -> list[Node]:
    """Distinct trees, of which no two have the same JSON."""
    rng, seen = random.Random(seed), {}
    for _ in range(max(50 * n, 1000)):
        tree = random_tree(pool, rng.randint(1, most_leaves), rng)
        seen.setdefault(json.dumps(tree.to_dict(), sort_keys=True), tree)
        if len(seen) >= n:
            break
    return list(seen.values())


def reversed_strategy(params: dict[str, Any]) -> dict[str, Any]:
    """The strategy with its direction and its trees exchanged."""
    out = dict(params)
    out["direction"] = {"long": "short", "short": "long"}.get(params.get("direction", "short"), params.get("direction"))
    if "long_tree" in params or "short_tree" in params:
        out["long_tree"], out["short_tree"] = params.get("short_tree"), params.get("long_tree")
    return out


def one_at_a_time(base: dict[str, Any], space: Space) -> list[tuple[str, dict[str, Any]]]:
    """Variants of ``base`` in one parameter of more than one value, with its name; the base's own value stays among them."""
    return [(k, {**base, k: v}) for k, items in space.items() if len(items) > 1 for v in items]
