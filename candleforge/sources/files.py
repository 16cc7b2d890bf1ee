"""Bar files: CSV with known headers, broker exports, and a partitioned table of bars."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candleforge.operators.bars import cleaned

#: Header names that mean the same.
HEADERS = {"datetime": ("datetime", "time", "date", "timestamp", "gmt time", "time (eet)"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "v", "vol")}
ZONES = {"EET": "Europe/Helsinki", "JST": "Asia/Tokyo", "UTC": "UTC"}


def renamed(raw: DataFrame) -> DataFrame:
    """``raw`` with the standard column names; a required one that is missing is an error."""
    have = {c.strip().lower(): c for c in raw.columns}
    out = {}
    for name, others in HEADERS.items():
        found = next((have[o] for o in others if o in have), None)
        if found is None and name != "volume":
            raise ValueError(f"no column for {name}")
        out[name] = F.col(f"`{found}`") if found else F.lit(None).cast("string")
    return raw.select(*[c.alias(n) for n, c in out.items()])


_PATTERNS = ("yyyy.MM.dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
UNSURE = "no single instant for "


def _times(x: Column, zone: str) -> tuple[Column, Column]:
    """The time in Tokyo's clock, and whether a plain time's clock shows it twice or never."""
    if zone not in ZONES:
        raise ValueError(f"unknown zone: {zone}")
    plain = F.coalesce(*[F.try_to_timestamp(x, F.lit(p)).cast("timestamp_ntz") for p in _PATTERNS])
    with_offset = F.when(x.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), F.to_utc_timestamp(F.try_to_timestamp(x), F.current_timezone()).cast("timestamp_ntz")))
    if zone == "JST":
        return F.coalesce(with_offset, plain).cast("timestamp_ntz"), F.lit(False)
    here, there = F.lit(ZONES[zone]), F.lit("UTC")
    instant = F.convert_timezone(here, there, plain)
    shown = lambda hours: F.convert_timezone(there, here, instant + F.make_dt_interval(hours=F.lit(hours)))
    unsure = (shown(0) != plain) | (shown(1) == plain) | (shown(-1) == plain)
    return F.coalesce(with_offset, F.convert_timezone(there, F.lit("Asia/Tokyo"), instant)).cast("timestamp_ntz"), with_offset.isNull() & F.coalesce(unsure, F.lit(False))


def parsed_time(x: Column, zone: str = "JST") -> Column:
    """A broker's or ISO time, in Tokyo wall-clock time. An offset in the text goes before ``zone``.

    A local time that the zone's clock shows twice or never, when summer time ends or begins, is an error.
    """
    time, unsure = _times(x, zone)
    return F.when(unsure, F.raise_error(F.concat(F.lit(UNSURE), x, F.lit(f" in {zone}")))).otherwise(time).cast("timestamp_ntz")


def read_csv(spark: SparkSession, path: str, symbol: str, timeframe: str, zone: str = "JST", source: int = 0) -> DataFrame:
    """Raw bars of CSV files, all text but the time; clean them with :func:`candleforge.operators.bars.cleaned`."""
    raw = renamed(spark.read.option("header", True).csv(path))
    return raw.select(F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), parsed_time(F.trim("datetime"), zone).alias("datetime"), "open", "high", "low", "close", "volume", F.lit(source).alias("source"))


def import_files(spark: SparkSession, files: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """Cleaned bars of many exports ``(path, symbol, timeframe, zone)`` of any series; where files overlap, the earlier one's bars stay."""
    raw = [read_csv(spark, path, symbol, timeframe, zone, source) for source, (path, symbol, timeframe, zone) in enumerate(files)]
    if not raw:
        raise ValueError("no files to import")
    return cleaned(reduce(DataFrame.unionByName, raw))


#: The name of an export: symbol, timeframe and anything.
EXPORT = r"([A-Za-z0-9]+)_([0-9]+m|1h|2h|4h|1d|1w|1mo)(?:_[^/]*)?\.csv$"
_RAW = "datetime string, open string, high string, low string, close string, volume string, bad string"
_PRICES = ("open", "high", "low", "close")


def read_exports(spark: SparkSession, path: str, zone: str = "JST") -> DataFrame:
    """All lines of the exports under ``path`` (a folder or a pattern) in one scan: ``file, modified, symbol, timeframe, datetime``, prices, ``volume, cause, line``.

    A file has a header, and time, open, high, low, close and volume (or none) in this order; its name tells symbol and timeframe
    (:data:`EXPORT`). ``cause`` is null for a bar and otherwise says why a line isn't one: ``name`` of the file, ``columns``, ``time``, ``clock`` (a time
    that the zone's clock shows twice or never) or ``price``. No line ends the job.
    """
    reader = spark.read.schema(_RAW).option("header", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "bad").option("columnPruning", False)
    raw = reader.csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    time, unsure = _times(F.trim("datetime"), zone)
    width = F.size(F.split("bad", ","))
    short = F.col("bad").isNotNull() & ((width < 5) | (width > 6))
    rows = raw.select(
        "file", "modified", F.regexp_extract("file", EXPORT, 1).alias("symbol"), F.regexp_extract("file", EXPORT, 2).alias("timeframe"), time.alias("datetime"), *[F.expr(f"try_cast(trim({c}) as double)").alias(c) for c in _PRICES],
        F.coalesce(F.expr("try_cast(trim(volume) as double)"), F.lit(0.0)).alias("volume"), F.coalesce(short, F.lit(False)).alias("short"), unsure.alias("unsure"), F.coalesce("bad", F.concat_ws(",", "datetime", *_PRICES, "volume")).alias("line"),
    )
    unknown = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    cause = F.when(F.col("symbol") == "", "name").when(F.col("short"), "columns").when(F.col("datetime").isNull(), "time").when(F.col("unsure"), "clock").when(unknown, "price")
    return rows.withColumn("cause", cause).drop("short", "unsure")


@dataclass(frozen=True)
class Imported:
    """What a batch of exports gave: cleaned bars, lines that are none, and a row a file, to be kept as what is stored."""

    bars: DataFrame
    failures: DataFrame
    files: DataFrame


def import_exports(spark: SparkSession, path: str, zone: str = "JST", stored: DataFrame | None = None) -> Imported:
    """The exports under ``path`` but those that ``stored (file, modified)`` names: a file that was written anew is read again.

    Where files of a series overlap, the bars of the first by name stay. Files whose lines all fail have no bars, but stay in ``files``, with their numbers of
    bars and failures; empty ones don't. Without files all three are empty.
    """
    lines = read_exports(spark, path, zone)
    if stored is not None:
        lines = lines.join(stored.select("file", "modified").distinct(), ["file", "modified"], "left_anti")
    bars = cleaned(lines.where("cause is null").withColumnRenamed("file", "source"))
    failures = lines.where("cause is not null").select("file", "modified", "cause", "line")
    counts = lines.groupBy("file", "modified").agg(F.count(F.when(F.col("cause").isNull(), 1)).alias("n_bars"), F.count("cause").alias("n_failures"))
    return Imported(bars, failures, counts)


def write_table(bars: DataFrame, path: str) -> None:
    """Bars by symbol and timeframe, so that a series is read without the others."""
    bars.repartition("symbol", "timeframe").sortWithinPartitions("datetime").write.mode("overwrite").partitionBy("symbol", "timeframe").parquet(path)


def read_table(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None, last: int | None = None) -> DataFrame:
    """Stored bars, pruned to what is asked; the dates are included. ``last`` keeps so many of the latest of each series."""
    x = spark.read.parquet(path)
    for column, value in (("symbol", symbol), ("timeframe", timeframe)):
        if value is not None:
            x = x.where(F.col(column) == value)
    if start is not None:
        x = x.where(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        x = x.where(F.col("datetime") <= F.lit(end).cast("timestamp_ntz"))
    if last is None:
        return x
    latest = Window.partitionBy("symbol", "timeframe").orderBy(F.col("datetime").desc())
    return x.withColumn("n", F.row_number().over(latest)).where(F.col("n") <= last).drop("n")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Symbols and timeframes stored."""
    return spark.read.parquet(path).select("symbol", "timeframe").distinct()


def write_report(df: DataFrame, path: str) -> None:
    """A result as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
