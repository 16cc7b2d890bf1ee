"""Indicators on a stream of bars, from a state of a few numbers a series.

The state of a series is kept by ``transformWithState``: what its recursive means, its supertrend and the bar before have come to. It survives
restarts from the checkpoint, and that of a symbol without bars expires. The numbers equal those of the batch indicators, however the bars
are split into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Version of the state's columns. A checkpoint of another version is an error, and has to be built anew.
VERSION = 1
_MEANS = ("ema", "up", "down", "atr", "range", "plus", "minus", "dx", "band")
_NUMBERS = (*_MEANS, "high", "low", "close", "top", "bottom", "way")
STATE = "version int, datetime timestamp, n long, " + ", ".join(f"{c} double" for c in _NUMBERS)
OUTPUT = "symbol string, timeframe string, datetime timestamp, close double, ema double, rsi double, atr double, adx double, supertrend_line double, supertrend_direction double"


@dataclass(frozen=True)
class Lengths:
    """Bars of each mean, and the width of the supertrend's band in average ranges."""

    ema: int = 20
    rsi: int = 14
    atr: int = 14
    adx: int = 14
    supertrend: int = 10
    multiplier: float = 3.0


class Running:
    """The means and sides of a series after its latest bar."""

    def __init__(self, lengths: Lengths, state: dict[str, Any] | None = None):
        self.lengths = lengths
        self.s: dict[str, Any] = state or {"version": VERSION, "datetime": None, "n": 0, **dict.fromkeys(_NUMBERS)}

    def _mean(self, name: str, x: float | None, alpha: float) -> float | None:
        """The recursive mean after ``x``, which is skipped if it is unknown."""
        have = self.s[name]
        if x is not None:
            self.s[name] = x if have is None else have + alpha * (x - have)
        return self.s[name]

    def add(self, datetime: Any, high: float, low: float, close: float) -> tuple[float | None, ...]:
        s, n = self.s, self.lengths
        first = s["n"] == 0
        last, before_high, before_low = s["close"], s["high"], s["low"]
        change = 0.0 if first else close - last
        true_range = high - low if first else max(high - low, abs(high - last), abs(low - last))
        rise, fall = (0.0, 0.0) if first else (high - before_high, before_low - low)
        ema = self._mean("ema", close, 2 / (n.ema + 1))
        up, down = self._mean("up", max(change, 0.0), 1 / n.rsi), self._mean("down", max(-change, 0.0), 1 / n.rsi)
        rsi = None if up == 0 and down == 0 else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        atr = self._mean("atr", true_range, 1 / n.atr)
        width = self._mean("range", true_range, 1 / n.adx)
        plus = self._mean("plus", rise if rise > fall and rise > 0 else 0.0, 1 / n.adx)
        minus = self._mean("minus", fall if fall > rise and fall > 0 else 0.0, 1 / n.adx)
        a, b = (100 * x / width if width else None for x in (plus, minus))
        adx = self._mean("dx", 100 * abs(a - b) / (a + b) if a is not None and a + b != 0 else None, 1 / n.adx)
        line, way = self._supertrend(high, low, close, true_range, first, last)
        s.update(datetime=datetime, n=s["n"] + 1, high=high, low=low, close=close)
        return ema, rsi, atr, adx, line, way

    def _supertrend(self, high: float, low: float, close: float, true_range: float, first: bool, last: float | None) -> tuple[float, float]:
        s = self.s
        width, mid = self.lengths.multiplier * self._mean("band", true_range, 1 / self.lengths.supertrend), (high + low) / 2
        above, below = mid + width, mid - width
        if first:
            s.update(top=above, bottom=below, way=-1.0)
        else:
            was_top, was_bottom = s["top"], s["bottom"]
            # a band only tightens until a close breaks it; the side turns on a close beyond the band of the bar before
            s["top"] = above if above < was_top or last > was_top else was_top
            s["bottom"] = below if below > was_bottom or last < was_bottom else was_bottom
            s["way"] = 1.0 if s["way"] < 0 and close > was_top else -1.0 if s["way"] > 0 and close < was_bottom else s["way"]
        return (s["bottom"] if s["way"] > 0 else s["top"]), s["way"]


class _Processor(StatefulProcessor):
    def __init__(self, lengths: Lengths, idle_ms: int | None):
        self.lengths, self.idle_ms = lengths, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE, self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in STATE.split(", ")]
        have = self.state.get() if self.state.exists() else None
        given = None if have is None else dict(zip(columns, have, strict=True))
        if given and given["version"] != VERSION:
            raise ValueError(f"the checkpoint has version {given['version']} of the state, not {VERSION}")
        running = Running(self.lengths, given)
        bars = pd.concat(list(rows)).sort_values("datetime", kind="stable").drop_duplicates("datetime")
        out = []
        for at, high, low, close in zip(bars["datetime"], bars["high"], bars["low"], bars["close"], strict=True):
            time = pd.Timestamp(at)
            last = running.s["datetime"]
            if last is not None and time <= pd.Timestamp(last):
                continue  # sent again, or too late to count
            out.append((*key, time, float(close), *running.add(time.to_pydatetime(), float(high), float(low), float(close))))
        if out:
            self.state.update(tuple(running.s[c] for c in columns))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def stream_indicators(bars: DataFrame, lengths: Lengths | None = None, idle_ms: int | None = None) -> DataFrame:
    """A row for each new bar of a stream ``(symbol, timeframe, datetime, high, low, close)``: ema, rsi, atr, adx and supertrend.

    Bars of a series count in the order of their times: a bar that isn't later than the last one counted, because it was sent again or came too
    late, is left out, and in a micro-batch they are sorted. ``idle_ms`` lets the state of a series expire that long after its last bar (by the clock);
    such a query runs until it is stopped, also under an ``availableNow`` trigger.
    Rows without a price or time are left out. The session needs the RocksDB state store.
    """
    if bars.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass has to be {PROVIDER}")
    given = bars.selectExpr("symbol", "timeframe", "cast(datetime as timestamp) as datetime", "cast(high as double) as high", "cast(low as double) as low", "cast(close as double) as close").dropna(subset=["datetime", "high", "low", "close"])
    processor = _Processor(lengths or Lengths(), idle_ms)
    return given.groupBy("symbol", "timeframe").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
