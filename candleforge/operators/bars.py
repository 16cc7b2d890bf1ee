"""Bars from ticks, resampling, cleaning and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes of the timeframe labels; month and week are calendar units.
MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "1d": 1440, "1w": 10080, "1mo": 43200}


def bucket(ts: Column, timeframe: str) -> Column:
    """The label of the bar that ``ts`` falls in: its start, and for weeks the Sunday that ends it."""
    if timeframe not in MINUTES:
        raise ValueError(f"unknown timeframe: {timeframe}")
    if timeframe == "1mo":
        return F.date_trunc("month", ts).cast("timestamp_ntz")
    if timeframe == "1w":
        return (F.date_trunc("week", ts).cast("timestamp_ntz") + F.expr("interval 6 days")).cast("timestamp_ntz")
    if timeframe == "1d":
        return F.date_trunc("day", ts).cast("timestamp_ntz")
    n = MINUTES[timeframe]
    start = F.date_trunc("day", ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (start.cast("timestamp_ntz") + F.make_dt_interval(mins=minute - F.pmod(minute, F.lit(n)))).cast("timestamp_ntz")


def indexed(bars: DataFrame) -> DataFrame:
    """``bars`` with ``bar_index`` counted from 0 in each series."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("datetime")
    return bars.withColumn("bar_index", (F.row_number().over(w) - 1).cast("long"))


def from_ticks(ticks: DataFrame, timeframe: str, symbol: str = "event_type", price: str = "value", ts: str = "ts", tie: str = "event_id", index: Callable[[DataFrame], DataFrame] = indexed) -> DataFrame:
    """OHLC bars of ticks; the volume is the number of ticks. Ticks without time or price are left out. ``index`` numbers the bars of each series."""
    order = F.struct(ts, tie)
    rows = ticks.where(F.col(ts).isNotNull() & F.col(price).isNotNull())
    rows = rows.groupBy(F.col(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), bucket(F.col(ts), timeframe).alias("datetime"))
    return index(rows.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume")))


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe; empty ones don't exist."""
    order = F.struct("datetime", "bar_index")
    rows = bars.groupBy("symbol", F.lit(timeframe).alias("timeframe"), bucket(F.col("datetime"), timeframe).alias("at"))
    out = rows.agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))
    return indexed(out.withColumnRenamed("at", "datetime"))


def cleaned(raw: DataFrame) -> DataFrame:
    """Imported bars with prices as doubles, without rows that lack one, repaired highs and lows, first of repeated times.

    ``source`` (a number, smaller first) orders files that overlap; without it the lower close wins ties.
    """
    prices = ["open", "high", "low", "close"]
    x = raw.select("symbol", "timeframe", "datetime", *[F.expr(f"try_cast({c} as double)").alias(c) for c in prices], F.coalesce(F.expr("try_cast(volume as double)"), F.lit(0.0)).alias("volume") if "volume" in raw.columns else F.lit(0.0).alias("volume"), F.col("source") if "source" in raw.columns else F.lit(0).alias("source"))
    x = x.dropna(subset=["datetime", *prices])
    first = F.row_number().over(Window.partitionBy("symbol", "timeframe", "datetime").orderBy("source", "close"))
    x = x.withColumn("n", first).where("n = 1").drop("n", "source")
    return x.withColumns({"high": F.greatest(*prices), "low": F.least(*prices)})


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored bars and those of ``new`` whose times aren't stored."""
    keys = ["symbol", "timeframe", "datetime"]
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def checked(bars: DataFrame, gap: float = 5.0) -> DataFrame:
    """One row a series: rows, range, repeated times, rows against the order of prices, gaps over ``gap`` bar lengths."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("datetime")
    minutes = F.coalesce(*[F.when(F.col("timeframe") == k, F.lit(v)) for k, v in MINUTES.items()])
    step = (F.unix_timestamp(F.col("datetime").cast("timestamp")) - F.unix_timestamp(F.lag("datetime").over(w).cast("timestamp"))) / 60
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close"))
    x = bars.select("symbol", "timeframe", "datetime", bad.alias("bad"), step.alias("step"), minutes.alias("minutes"))
    count = lambda c: F.sum(c.cast("int")).cast("long")
    return x.groupBy("symbol", "timeframe").agg(
        F.count("*").alias("n_rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.coalesce(count(F.col("step") == 0), F.lit(0)).alias("n_repeated"), count(F.col("bad")).alias("n_bad"), F.coalesce(count(F.col("step") > gap * F.col("minutes")), F.lit(0)).alias("n_gaps")
    )


def faults(bars: DataFrame, gap: float = 5.0) -> DataFrame:
    """A row for each fault of a series: ``symbol, timeframe, fault, datetime, before, minutes``.

    ``repeated`` is a bar at the time of the one before, ``gap`` one more than ``gap`` bar lengths after it,
    ``prices`` one whose high or low doesn't hold the others, ``missing`` one without a price or volume.
    """
    w = Window.partitionBy("symbol", "timeframe").orderBy("datetime")
    length = F.coalesce(*[F.when(F.col("timeframe") == k, F.lit(v)) for k, v in MINUTES.items()])
    before = F.lag("datetime").over(w)
    minutes = ((F.unix_timestamp(F.col("datetime").cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))) / 60).cast("long")
    x = bars.select("*", before.alias("before"), minutes.alias("minutes"), length.alias("length"))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close"))
    missing = F.greatest(*[F.col(c).isNull() for c in ("open", "high", "low", "close", "volume")])
    found = F.array(F.when(F.col("minutes") == 0, "repeated"), F.when(F.col("minutes") > gap * F.col("length"), "gap"), F.when(bad, "prices"), F.when(missing, "missing"))
    return x.select("symbol", "timeframe", F.explode(F.array_compact(found)).alias("fault"), "datetime", "before", "minutes")


def pip_size(symbol: Column) -> Column:
    """The price step that counts as a pip, by the symbol's name."""
    return F.when(symbol == "XAUUSD", 0.01).when(symbol == "XAGUSD", 0.001).when(symbol.contains("JPY"), 0.01).otherwise(0.0001)


def as_of(base: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` of the last bar of ``other`` that was finished when the base bar began.

    A bar of ``other`` counts from the time of the bar after it. Both are put on one
    time line and the last known row is carried on, so no pair is formed.
    """
    series = Window.partitionBy("symbol", "timeframe").orderBy("datetime")
    value = F.struct(*columns)
    late = other.select("symbol", "datetime", F.lag(value).over(series).alias("v"), F.lit(0).alias("kind"))
    mine = base.select("symbol", "datetime", F.lit(None).cast(late.schema["v"].dataType).alias("v"), F.lit(1).alias("kind"), F.struct(*base.columns).alias("row"))
    both = late.withColumn("row", F.lit(None).cast(mine.schema["row"].dataType)).unionByName(mine)
    line = Window.partitionBy("symbol").orderBy("datetime", "kind").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("v", F.last("v", ignorenulls=True).over(line)).where("kind = 1")
    return known.select("row.*", "v.*")
