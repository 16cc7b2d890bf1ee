"""Condition trees: JSON to a boolean SQL expression.

A leaf compares an indicator with a number or another indicator; AND and OR take any
number of children, NOT one. An unknown value makes a comparison false before it is
negated or combined. Operands of another timeframe are joined as of the last bar that
was finished there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from candleforge.functions import candles, derived, indicators  # noqa: F401  (they register)
from candleforge.functions.compiler import SPARK, Dialect, Plan
from candleforge.functions.indicators import REGISTRY, atr, build
from candleforge.operators import bars as B
from candleforge.operators.kernels import with_kernels

OPERATORS = (">", "<", ">=", "<=", "==", "crosses_above", "crosses_below")
OFFSETS = ("pips", "price_pct", "atr_pct")
LITERALS = ("value", *OFFSETS)


@dataclass(frozen=True)
class Condition:
    indicator: str
    operator: str
    value: float | str
    params: dict = field(default_factory=dict)
    value_params: dict = field(default_factory=dict)
    timeframe: str | None = None
    value_timeframe: str | None = None
    offset_pips: float = 0.0
    value_offset_pips: float = 0.0
    offset_mode: str = "pips"
    value_offset_mode: str = "pips"
    offset_atr_length: int = 14
    value_offset_atr_length: int = 14
    literal_mode: str = "value"
    literal_atr_length: int = 14

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator: {self.operator}")
        for mode in (self.offset_mode, self.value_offset_mode):
            if mode not in OFFSETS:
                raise ValueError(f"unknown offset mode: {mode}")
        if self.literal_mode not in LITERALS:
            raise ValueError(f"unknown literal mode: {self.literal_mode}")
        for name in (self.indicator, self.value):
            if isinstance(name, str) and name not in REGISTRY:
                raise ValueError(f"unknown indicator: {name}")

    def to_dict(self) -> dict:
        return dict(self.__dict__)


@dataclass(frozen=True)
class Group:
    op: str
    children: tuple

    def __post_init__(self) -> None:
        if self.op not in ("AND", "OR", "NOT"):
            raise ValueError(f"unknown group: {self.op}")
        if not self.children or (self.op == "NOT" and len(self.children) != 1):
            raise ValueError(f"{self.op} with {len(self.children)} children")

    def to_dict(self) -> dict:
        return {"op": self.op, "children": [c.to_dict() for c in self.children]}


Node = Condition | Group


def parse(tree: str | dict | Node) -> Node:
    if isinstance(tree, Condition | Group):
        return tree
    if isinstance(tree, str):
        tree = json.loads(tree)
    if "op" in tree:
        return Group(tree["op"], tuple(parse(c) for c in tree.get("children", [])))
    return Condition(**tree)


def leaves(node: Node) -> list[Condition]:
    return [node] if isinstance(node, Condition) else [x for c in node.children for x in leaves(c)]


def with_mandatory(tree: Node, mandatory: list[Node]) -> Node:
    """``tree`` and all of ``mandatory``."""
    return Group("AND", (tree, *mandatory)) if mandatory else tree


class Compiler:
    """Expressions of trees over one plan; ``joined`` holds what has to come from other timeframes."""

    def __init__(self, dialect: Dialect = SPARK, pip: float = 0.01, base: str = "1h"):
        self.plan, self.pip, self.base = Plan(dialect), pip, base
        self.joined: dict[tuple[str, str, str], str] = {}

    def _series(self, name: str, params: dict, timeframe: str | None) -> str:
        if timeframe in (None, self.base):
            return self.plan.let(build(self.plan, name, **params))
        if timeframe not in B.MINUTES:
            raise ValueError(f"unknown timeframe: {timeframe}")
        key = (timeframe, name, json.dumps(params, sort_keys=True))
        return self.joined.setdefault(key, f"m{len(self.joined)}_{timeframe}")

    def _scaled(self, amount: float, mode: str, length: int) -> str:
        if mode == "pips":
            return repr(float(amount) * self.pip)
        return f"(({'close' if mode == 'price_pct' else atr(self.plan, length)}) * {float(amount)!r} / 1e2)"

    def _side(self, name: str, params: dict, timeframe: str | None, amount: float, mode: str, length: int) -> str:
        x = self._series(name, params, timeframe)
        return f"({x} + {self._scaled(amount, mode, length)})" if amount else x

    def leaf(self, c: Condition) -> str:
        left = self._side(c.indicator, c.params, c.timeframe, c.offset_pips, c.offset_mode, c.offset_atr_length)
        if isinstance(c.value, str):
            right = self._side(c.value, c.value_params, c.value_timeframe, c.value_offset_pips, c.value_offset_mode, c.value_offset_atr_length)
        else:
            right = f"{float(c.value)!r}" if c.literal_mode == "value" else self._scaled(c.value, c.literal_mode, c.literal_atr_length)
            if c.value_offset_pips:
                right = f"({right} + {self._scaled(c.value_offset_pips, c.value_offset_mode, c.value_offset_atr_length)})"
        if c.operator.startswith("crosses"):
            return self.plan.fresh(f"{left} {'>' if c.operator == 'crosses_above' else '<'} {right}")
        return f"coalesce({left} {'=' if c.operator == '==' else c.operator} {right}, false)"

    def tree(self, node: Node) -> str:
        if isinstance(node, Condition):
            return self.leaf(node)
        parts = [f"({self.tree(c)})" for c in node.children]
        return f"not {parts[0]}" if node.op == "NOT" else reduce(lambda a, b: f"{a} {node.op.lower()} {b}", parts)


def evaluate(bars: DataFrame, trees: dict[str, str | dict | Node], pip: float = 0.01, base: str = "1h", extra: dict[str, tuple[str, dict]] | None = None) -> DataFrame:
    """``bars`` with a boolean column a tree and a double a named ``extra`` indicator.

    What several trees name is computed once.
    """
    compiler = Compiler(SPARK, pip, base)
    outputs = {name: compiler.tree(parse(t)) for name, t in trees.items()}
    outputs |= {name: build(compiler.plan, i, **p) for name, (i, p) in (extra or {}).items()}
    source = bars
    for timeframe in dict.fromkeys(k[0] for k in compiler.joined):
        other = B.resample(bars, timeframe)
        plan = Plan(SPARK)
        columns = {alias: build(plan, name, **json.loads(params)) for (t, name, params), alias in compiler.joined.items() if t == timeframe}
        values = bars.sparkSession.sql(plan.sql("{bars}", columns, keys="symbol, timeframe, datetime"), bars=with_kernels(other, " ".join([*columns.values(), *plan.made])))
        source = B.as_of(source, values, list(columns))
    source = with_kernels(source, " ".join([*outputs.values(), *compiler.plan.made]))
    return bars.sparkSession.sql(compiler.plan.sql("{bars}", outputs, keys=", ".join(bars.columns)), bars=source)
