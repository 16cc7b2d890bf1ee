"""User-defined patterns: what a detector has to keep to, and how it becomes an indicator."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Detector = Callable[..., np.ndarray]
APPENDED = (1, 5, 50, 200)
#: Milliseconds for 100,000 bars that are too many.
SLOWEST = 2000.0


def sample_bars(n: int, seed: int = 0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 0.5, n))
    open_ = np.concatenate(([100.0], close[:-1]))
    return pd.DataFrame({"datetime": pd.date_range("2020-01-01", periods=n, freq="15min"), "open": open_, "high": np.maximum(open_, close) + rng.random(n), "low": np.minimum(open_, close) - rng.random(n), "close": close, "volume": rng.integers(1, 1000, n).astype(float)})


def faults(detect: Detector, **params: object) -> list[str]:
    """What is wrong with a detector: shape, values, looking ahead, change between runs, odd input, speed."""
    out = []
    x = sample_bars(2200)
    try:
        whole = np.asarray(detect(x.copy(), **params), float)
        if whole.shape != (len(x),):
            return [f"{whole.shape} values for {len(x)} bars"]
        if not np.isin(whole, (0.0, 1.0)).all():
            out.append("values other than 0 and 1")
        if not (np.asarray(detect(x.copy(), **params), float) == whole).all():
            out.append("two runs differ")
        part = np.asarray(detect(x[:2000].copy(), **params), float)
        for k in APPENDED:
            if not (np.asarray(detect(x[: 2000 + k].copy(), **params), float)[:2000] == part).all():
                out.append(f"{k} later bars change earlier values")
                break
        flat = x[:50].assign(open=1.0, high=1.0, low=1.0, close=1.0)
        for name, odd in (("no bars", x[:0]), ("one bar", x[:1]), ("flat bars", flat)):
            if len(np.asarray(detect(odd.copy(), **params))) != len(odd):
                out.append(f"a wrong number of values for {name}")
        big = sample_bars(20_000)
        began = time.perf_counter()
        detect(big, **params)
        if (took := (time.perf_counter() - began) * 5000) > SLOWEST:
            out.append(f"{took:.0f} ms for 100,000 bars")
    except Exception as e:  # noqa: BLE001  (whatever a plugin raises is its fault)
        out.append(f"raised {type(e).__name__}: {e}")
    return out


def with_detectors(bars: DataFrame, detectors: dict[str, tuple[Detector, dict]]) -> DataFrame:
    """``bars`` with a 0 or 1 column ``custom_<name>`` for each detector, one pass over a series for all."""
    columns = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema), *(f"custom_{n} double" for n in detectors)])

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bar_index").reset_index(drop=True)
        return x.assign(**{f"custom_{n}": np.asarray(f(x.copy(), **p), float) for n, (f, p) in detectors.items()})

    return bars.groupBy("symbol", "timeframe").applyInPandas(run, columns)
