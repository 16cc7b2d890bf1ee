"""Bars from a stream of ticks, sessions of trading, and bars that are sent again.

A bar or session is emitted once, when the watermark has passed its end; later ticks are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, minutes: int = 60, late: str = "10 minutes", symbol: str = "event_type", price: str = "value", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Append-mode OHLC bars of ``ticks``, whose ``ts`` is a timestamp; repeated ticks count once."""
    order = F.struct(ts, tie)
    rows = ticks.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(price).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark([symbol, tie])
    out = rows.groupBy(F.col(symbol).alias("symbol"), F.window(ts, f"{minutes} minutes").alias("w")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume")


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", gaps: dict[str, str] | None = None, symbol: str = "event_type", price: str = "value", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Append-mode sessions ``symbol, begin, end, open, high, low, close, volume``: a session ends where no tick follows within ``gap``.

    ``gaps`` gives single symbols gaps of their own; ``end`` is the last tick and the gap. Repeated ticks count once, ticks without time or price don't.
    """
    wait = F.lit(gap)
    for name, own in (gaps or {}).items():
        wait = F.when(F.col(symbol) == name, F.lit(own)).otherwise(wait)
    order = F.struct(ts, tie)
    rows = ticks.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(price).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late).dropDuplicatesWithinWatermark([symbol, tie])
    out = rows.groupBy(F.col(symbol).alias("symbol"), F.session_window(ts, wait).alias("w")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume")


def first_of_bars(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of bars in which each time of a series counts once, the first row that comes; repeats are known for as long as ``late``."""
    return bars.withColumn("datetime", F.col("datetime").cast("timestamp")).withWatermark("datetime", late).dropDuplicatesWithinWatermark(["symbol", "timeframe", "datetime"])
