"""Staged SQL: indicators are SQL expressions over named columns, and window results
are columns of the stage below.

All windows partition by the series and order by ``bar_index``, so Spark needs one
shuffle and one sort for any number of indicators. A stage is made once for an
expression, whatever asks for it. The same stages run on any engine with standard windows;
:class:`Dialect` holds the few functions that are spelled differently.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import ceil, log

SERIES = "symbol, timeframe"
_TEMP = re.compile(r"\bt\d+_\b")
_BACK = re.compile(r"rows between (\d+) preceding|lag\(.*?, (\d+)\) over")


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def weekday(self, x: str) -> str:
        return f"weekday({x})" if self.spark else f"(isodow({x}) - 1)"

    def zoned(self, x: str, to: str) -> str:
        return f"convert_timezone('Asia/Tokyo', '{to}', {x})" if self.spark else f"(({x} at time zone 'Asia/Tokyo') at time zone '{to}')"

    def day(self, x: str) -> str:
        return f"cast({x} as date)"

    def collected(self, x: str, over: str) -> str:
        return f"{'collect_list' if self.spark else 'list'}({x}) {over}"

    def position(self, items: str, x: str) -> str:
        return f"array_position({items}, {x})" if self.spark else f"list_position({items}, {x})"

    def count_where(self, items: str, test: str) -> str:
        """Items ``v`` for which ``test`` holds."""
        return f"size(filter({items}, v -> {test}))" if self.spark else f"len(list_filter({items}, lambda v: {test}))"

    def sum_of(self, items: str, value: str) -> str:
        return f"aggregate(transform({items}, v -> {value}), 0D, (a, b) -> a + b)" if self.spark else f"list_sum(list_transform({items}, lambda v: {value}))"

    def last_known(self, x: str, over: str) -> str:
        return f"last({x}, true) {over}" if self.spark else f"last_value({x} ignore nulls) {over}"

    def half_even(self, x: str) -> str:
        return f"bround({x})" if self.spark else f"round_even({x}, 0)"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


@dataclass
class Plan:
    """The stages that a set of indicators needs."""

    dialect: Dialect = SPARK
    stages: list[dict[str, str]] = field(default_factory=list)
    made: dict[str, str] = field(default_factory=dict)
    level: dict[str, int] = field(default_factory=dict)
    #: What windows partition by, and how far those of each stage look back: bars, and whole days (-1: none, 0: the day so far).
    series: str = SERIES
    bars_back: list[int] = field(default_factory=list)
    days_back: list[int] = field(default_factory=list)

    def place(self, sql: str) -> int:
        """The first stage where what ``sql`` names is there."""
        return max((self.level[t] + 1 for t in _TEMP.findall(sql)), default=0)

    def let(self, sql: str, days: int = -1) -> str:
        """A column with the value of ``sql``, in the first stage where what it names is there; ``days`` are those that it looks back."""
        if sql in self.made:
            return self.made[sql]
        at = self.place(sql)
        name = f"t{len(self.made)}_"
        while len(self.stages) <= at:
            self.stages.append({})
            self.bars_back.append(0)
            self.days_back.append(-1)
        self.stages[at][name] = sql
        self.made[sql], self.level[name] = name, at
        self.bars_back[at] = max([self.bars_back[at], *(int(a or b) for a, b in _BACK.findall(sql) if days < 1)])
        self.days_back[at] = max(self.days_back[at], days)
        return name

    def sql(self, source: str, outputs: dict[str, str], keys: str = "symbol, datetime", stages: int | None = None, where: str = "true") -> str:
        """A query over ``source``, which has symbol, timeframe, bar_index, datetime and the prices."""
        wanted = set(_TEMP.findall(" ".join(outputs.values())))
        for stage in reversed(self.stages[:stages]):
            wanted.update(t for n, x in stage.items() if n in wanted for t in _TEMP.findall(x))
        inner = f"select * from {source}"
        for stage in self.stages[:stages]:
            columns = [f"{x} as {n}" for n, x in stage.items() if n in wanted]
            if columns:
                inner = f"select *, {', '.join(columns)} from ({inner}) s"
        return f"select {keys}, {', '.join(f'{x} as {n}' for n, x in outputs.items())} from ({inner}) s where {where}"

    # windows

    def rows(self, first: str, last: str = "current row", within: str | None = None) -> str:
        """A window of a series, or of what has one value of ``within`` in it."""
        return f"over (partition by {self.series}{f', {within}' if within else ''} order by bar_index rows between {first} and {last})"

    def last_n(self, n: int) -> str:
        return self.rows(f"{int(n) - 1} preceding")

    def so_far(self) -> str:
        return self.rows("unbounded preceding")

    def before(self) -> str:
        return self.rows("unbounded preceding", "1 preceding")

    def roll(self, aggregate: str, x: str, n: int) -> str:
        """``aggregate`` of the last ``n`` values, null before there are as many."""
        w = self.last_n(n)
        return self.let(f"case when count({x}) {w} = {int(n)} then {aggregate}({x}) {w} end")

    def roll_previous(self, aggregate: str, x: str, n: int) -> str:
        w = self.rows(f"{int(n)} preceding", "1 preceding")
        return self.let(f"case when count({x}) {w} = {int(n)} then {aggregate}({x}) {w} end")

    def prev(self, x: str, k: int = 1) -> str:
        return self.let(f"lag({x}, {int(k)}) over (partition by {self.series} order by bar_index)")

    def _running(self, kind: str, x: str, before: bool = False) -> str:
        over = self.before() if before else self.so_far()
        return self.dialect.last_known(x, over) if kind == "last" else f"{kind}({x}) {over}"

    def running(self, kind: str, x: str, before: bool = False) -> str:
        """``sum``, ``count``, ``max`` or the ``last`` known of all values up to this bar, or to the one before."""
        return self.let(self._running(kind, x, before))

    def in_day(self, aggregate: str, x: str, day: str, last: str = "current row") -> str:
        """``aggregate`` of the day's values up to ``last``."""
        return self.let(f"{aggregate}({x}) {self.rows('unbounded preceding', last, day)}", days=0)

    def days_ago(self, x: str, k: int, first: str) -> str:
        """``x`` of the first bar of the day ``k`` days back, on bars where ``first`` holds."""
        return self.let(f"lag({x}, {int(k)}) over (partition by {self.series}, {first} order by bar_index)", days=int(k) + 1)

    def known(self, x: str) -> str:
        """The last value that isn't null."""
        return self.running("last", x)

    def last_index(self, test: str, before: bool = False) -> str:
        return self.running("max", f"case when {test} then bar_index end", before)

    def fresh(self, test: str) -> str:
        """``test`` where it didn't hold on the bar before."""
        now = self.let(f"coalesce({test}, false)")
        return f"({now} and not coalesce({self.prev(now)}, false))"

    def streak(self, test: str, n: int) -> str:
        flag = self.let(f"cast(coalesce({test}, false) as int)")
        return f"coalesce({self.roll('sum', flag, n)} = {int(n)}, false)"

    def ewm(self, x: str, alpha: float) -> str:
        """The recursive mean ``y = y + alpha * (x - y)`` from the first value on. Nulls are skipped."""
        return x if alpha >= 1 else self._decayed(x, alpha)

    def _decayed(self, x: str, alpha: float, start: str | None = None) -> str:
        """The recursive mean in closed form, from ``start`` on if that is given and known.

        Decayed sums are taken within blocks, whose weights stay in range, and the end of
        a block is carried over the next; what is two blocks old weighs less than 1e-12.
        """
        keep = 1 - alpha
        block = max(4, ceil(-14 / log(keep)))
        k = self.let(f"{self._running('count', x)} - 1")
        part = self.let(f"cast(floor(greatest({k}, 0) / {block}) as bigint)")
        place = f"(greatest({k}, 0) - {part} * {block})"
        first = f"{k} = 0 and {start} is null" if start else f"{k} = 0"
        weighted = self.let(f"case when {x} is not null then (case when {first} then {x} else {alpha!r} * ({x}) end) * power({keep!r}, -{place}) end")
        own = self.let(f"sum({weighted}) {self.rows('unbounded preceding', within=part)}")
        end = self.let(f"case when {place} = {block - 1} and {x} is not null then {own} * power({keep!r}, {block - 1}) end")
        older = self.let(self._running("last", end, before=True))
        both = self.let(f"case when {end} is not null then {end} + {keep**block!r} * coalesce({older}, 0) end")
        carried = self.let(self._running("last", both, before=True))
        # skipped rows after a block's end still belong to that block
        value = f"power({keep!r}, {place}) * {own} + power({keep!r}, {place} + 1) * coalesce({carried}, 0)"
        if start:
            return self.let(f"case when {k} >= 0 then {value} + power({keep!r}, {k} + 1) * coalesce({start}, 0) else {start} end")
        return self.let(f"case when {k} >= 0 then {value} end")


@dataclass(frozen=True)
class State:
    """What a slice has to know of ``x`` on all bars before its edge: a sum, count, maximum, last value, or the mean that ``keep`` decays."""

    name: str
    kind: str
    x: str
    keep: float = 0.0


@dataclass
class SlicedPlan(Plan):
    """The same stages over slices of a series with bars of earlier slices in front (:mod:`candleforge.operators.slices`).

    Windows stay within a slice. Those that look back to the beginning read the bars from the ``edge`` of their stage on, before which
    the columns below aren't whole, and a state of the slice for all bars before it.
    """

    series: str = f"{SERIES}, slice"
    states: dict[int, list[State]] = field(default_factory=dict)
    kept: dict[tuple, str] = field(default_factory=dict)

    def _state(self, kind: str, x: str, keep: float = 0.0) -> tuple[str, str]:
        """The name of a state and of ``x`` from the edge on."""
        at = self.place(x)
        if (kind, x, keep) not in self.kept:
            self.kept[kind, x, keep] = f"s{len(self.kept)}_"
            self.states.setdefault(at, []).append(State(self.kept[kind, x, keep], kind, x, keep))
        return self.kept[kind, x, keep], f"case when bar_index >= edge{at}_ then {x} end"

    def running(self, kind: str, x: str, before: bool = False) -> str:
        state, near = self._state(kind, x)
        local = self._running(kind, near, before)
        if kind == "sum":
            return self.let(f"case when {state} is null then {local} else {state} + coalesce({local}, 0) end")
        return self.let({"count": f"coalesce({state}, 0) + {local}", "max": f"greatest({state}, {local})", "last": f"coalesce({local}, {state})"}[kind])

    def ewm(self, x: str, alpha: float) -> str:
        if alpha >= 1:
            return x
        state, near = self._state("mean", x, 1 - alpha)
        return self._decayed(self.let(near), alpha, state)


def flag(test: str) -> str:
    """1 or 0 for a test; 0 where it is unknown."""
    return f"cast(coalesce({test}, false) as double)"
