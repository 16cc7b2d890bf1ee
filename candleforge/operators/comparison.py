"""Strategies and signals beside each other: equity over the share of trades, halves of the bars, and a signal against one from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["symbol", "timeframe"]


def equity_by_share(trades: DataFrame) -> DataFrame:
    """``series, trade, share, equity``: each trade's place from 1, the share of its series' trades from 0 to 100 and the equity after it, so that series of any length share an axis.

    A single trade stands at 0. Trades are ordered by exit and number.
    """
    order = Window.partitionBy("series").orderBy("exit_time", "trade_number")
    rows = trades.select("series", F.row_number().over(order).cast("long").alias("trade"), F.sum("profit").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("equity"))
    counts = trades.groupBy("series").agg(F.count("*").alias("n"))
    return rows.join(counts, "series").select("series", "trade", F.when(F.col("n") > 1, 100.0 * (F.col("trade") - 1) / (F.col("n") - 1)).otherwise(0.0).alias("share"), "equity")


def halves(bars: DataFrame, share: float = 0.7) -> DataFrame:
    """``bars`` as two series each: the first ``share`` of the bars with ``|in`` behind the symbol, and the rest with ``|out``, both counted from bar 0.

    What is evaluated or traded on them knows nothing of the other half. A share from 0.1 to 0.9 is taken.
    """
    if not 0.1 <= share <= 0.9:
        raise ValueError("the share of the first bars is 0.1 to 0.9")
    ends = bars.groupBy(*KEYS).agg(F.floor((F.max("bar_index") + 1) * share).alias("cut"))
    first = F.col("bar_index") < F.col("cut")
    rows = bars.join(ends, KEYS)
    return rows.withColumn("symbol", F.concat("symbol", F.when(first, "|in").otherwise("|out"))).withColumn("bar_index", F.when(first, F.col("bar_index")).otherwise(F.col("bar_index") - F.col("cut"))).drop("cut")


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``symbol, datetime, ours, theirs, verdict`` of two signals ``(symbol, datetime, signal)``.

    The verdict is ``both``, ``ours_only``, ``theirs_only``, ``neither``, or ``missing`` where only one of them has the time. An unknown signal is none;
    a time given twice counts once, with its signal if one of the rows has it.
    """
    one = lambda x, name: x.groupBy("symbol", F.col("datetime").cast("timestamp_ntz").alias("datetime")).agg(F.max(F.coalesce(F.col("signal").cast("boolean"), F.lit(False))).alias(name))
    both = one(ours, "ours").join(one(theirs, "theirs"), ["symbol", "datetime"], "full")
    a, b = F.col("ours"), F.col("theirs")
    verdict = F.when(a.isNull() | b.isNull(), "missing").when(a & b, "both").when(a, "ours_only").when(b, "theirs_only").otherwise("neither")
    return both.withColumn("verdict", verdict)


def from_chart(raw: DataFrame, symbol: str, marker: str, zone: str = "Asia/Tokyo") -> DataFrame:
    """A signal ``symbol, datetime, signal`` of a chart's export: it stands where the column ``marker`` has a value. Times are ISO with an offset, and become ``zone``'s."""
    at = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(F.try_to_timestamp(F.col("time")), F.current_timezone()).cast("timestamp_ntz"))
    filled = F.length(F.trim(F.col(f"`{marker}`").cast("string"))) > 0
    return raw.select(F.lit(symbol).alias("symbol"), at.alias("datetime"), F.coalesce(filled, F.lit(False)).alias("signal")).where("datetime is not null")
