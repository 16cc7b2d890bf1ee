"""Stateful passes over one series at a time, for what windows can't express.

A series (symbol and timeframe) is one group; its bars are a few columns of numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from candleforge.functions.indicators import KERNELS
from candleforge.operators.patterns import FAMILY, events


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    out, y = np.empty(len(x)), 0.0
    for i, v in enumerate(x.tolist()):
        y = v if i == 0 else y + (v - y) / n
        out[i] = y
    return out


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:  # noqa: E741
    before = np.concatenate(([np.nan], c[:-1]))
    return np.fmax(h - l, np.fmax(np.abs(h - before), np.abs(l - before)))


def supertrend(h: np.ndarray, l: np.ndarray, c: np.ndarray, length: int, multiplier: float) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Line and side (1 above a rising line, -1 below a falling one; -1 on the first bar)."""
    width, mid = multiplier * wilder(true_range(h, l, c), length), (h + l) / 2
    above, below, close = (mid + width).tolist(), (mid - width).tolist(), c.tolist()
    line, side = np.empty(len(c)), np.empty(len(c))
    top, bottom, way = above[0] if above else 0.0, below[0] if below else 0.0, -1
    for i, (a, b) in enumerate(zip(above, below, strict=True)):
        if i:
            last, was_top, was_bottom = close[i - 1], top, bottom
            top = a if a < top or last > top else top
            bottom = b if b > bottom or last < bottom else bottom
            # the side turns on a close beyond the band as it stood on the bar before
            way = 1 if way < 0 and close[i] > was_top else -1 if way > 0 and close[i] < was_bottom else way
        line[i], side[i] = (bottom if way > 0 else top), way
    return line, side


def sar(h: np.ndarray, l: np.ndarray, c: np.ndarray, af_start: float, af_step: float, af_max: float) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Parabolic stop and side; the first bar counts as rising."""
    n = len(c)
    line, side = np.full(n, np.nan), np.full(n, np.nan)
    if not n:
        return line, side
    up, stop, best, af = True, l[0], h[0], af_start
    line[0], side[0] = stop, 1.0
    for i in range(1, n):
        stop += af * (best - stop)
        if up:
            stop = min(stop, l[i - 1], l[i - 2] if i > 1 else l[i - 1])
            if l[i] < stop:
                up, stop, best, af = False, best, l[i], af_start
            elif h[i] > best:
                best, af = h[i], min(af + af_step, af_max)
        else:
            stop = max(stop, h[i - 1], h[i - 2] if i > 1 else h[i - 1])
            if h[i] > stop:
                up, stop, best, af = True, best, h[i], af_start
            elif l[i] < best:
                best, af = l[i], min(af + af_step, af_max)
        line[i], side[i] = stop, 1.0 if up else -1.0
    return line, side


_PASSES: dict[str, Callable[..., tuple[np.ndarray, np.ndarray]]] = {"supertrend": supertrend, "sar": sar}


def with_kernels(bars: DataFrame, wanted: str) -> DataFrame:
    """``bars`` with the columns of the kernels named in ``wanted``: lines and sides, and where patterns enter a state; one pass over a series for all."""
    need = {k: v for k, v in KERNELS.items() if re.search(rf"\b{k}(_line|_direction)?\b", wanted)}
    if not need:
        return bars
    shapes = {k: v[1] for k, v in need.items() if v[0] == "pattern"}
    lines = {k: v for k, v in need.items() if v[0] != "pattern"}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_index")
        h, l, c = (table.column(x).to_numpy() for x in ("high", "low", "close"))  # noqa: E741
        done: dict[tuple, list[tuple]] = {}
        for name, wanted in shapes.items():
            family, params = FAMILY[wanted["name"]], wanted["params"]
            key = (family, *params.items())
            if key not in done:
                done[key] = events(h, l, (family,), **params)
            hit = np.zeros(len(c))
            hit[[e[2] for e in done[key] if e[0] == wanted["name"] and e[1] == wanted["state"]]] = 1
            table = table.append_column(name, pa.array(hit))
        for name, (kind, params) in lines.items():
            line, side = _PASSES[kind](h, l, c, **params)
            table = table.append_column(f"{name}_line", pa.array(line, from_pandas=True)).append_column(f"{name}_direction", pa.array(side, from_pandas=True))
        return table

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema), *(f"{n} double" for n in shapes), *(f"{n}_{x} double" for n in lines for x in ("line", "direction"))])
    return bars.groupBy("symbol", "timeframe").applyInArrow(run, schema)
