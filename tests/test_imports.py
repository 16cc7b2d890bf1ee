"""Broker files: clocks that change, many files at once, the latest bars, and faults of series."""

import datetime
import time

import pytest

from candleforge.operators import bars as B
from candleforge.sources import files


def write(path, times, price):
    path.write_text("Time (EET), Open, High, Low, Close, Volume\n" + "".join(f"{t},{price},{price + 1},{price - 1},{price},5\n" for t in times))
    return str(path)


def test_times_that_a_clock_shows_twice_or_never_are_errors(spark, tmp_path):
    fine = write(tmp_path / "a.csv", ["2024.01.10 12:00:00", "2024.07.10 12:00:00", "2024.03.31 02:59:59", "2024.03.31 04:00:00", "2024.10.27 02:59:59", "2024.10.27 04:00:00"], 10)
    got = [r.datetime for r in files.read_csv(spark, fine, "x", "1h", "EET").collect()]
    assert got[:2] == [datetime.datetime(2024, 1, 10, 19), datetime.datetime(2024, 7, 10, 18)] and len(set(got)) == 6
    for t in ("2024.03.31 03:30:00", "2024.10.27 03:30:00"):
        with pytest.raises(Exception, match="no single instant"):
            files.read_csv(spark, write(tmp_path / "b.csv", [t], 10), "x", "1h", "EET").collect()


def test_files_that_overlap(spark, tmp_path):
    a = write(tmp_path / "a.csv", ["2024.01.10 12:00:00", "2024.01.10 13:00:00"], 10)
    b = write(tmp_path / "b.csv", ["2024.01.10 13:00:00", "2024.01.10 14:00:00"], 20)
    c = write(tmp_path / "c.csv", ["2024.01.10 13:00:00"], 30)
    got = files.import_files(spark, [(a, "x", "1h", "UTC"), (b, "x", "1h", "UTC"), (c, "y", "1h", "UTC")]).orderBy("symbol", "datetime").collect()
    assert [(r.symbol, r.datetime.hour, r.close) for r in got] == [("x", 21, 10.0), ("x", 22, 10.0), ("x", 23, 20.0), ("y", 22, 30.0)]
    files.write_table(files.import_files(spark, [(a, "x", "1h", "UTC"), (b, "x", "1h", "UTC")]), str(tmp_path / "t"))
    assert sorted(r.datetime.hour for r in files.read_table(spark, str(tmp_path / "t"), symbol="x", last=2).collect()) == [22, 23]
    with pytest.raises(ValueError):
        files.import_files(spark, [])


def test_faults(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [("x", "1h", at(0), 1.0, 2.0, 0.0, 1.0, 1.0), ("x", "1h", at(0), 1.0, 2.0, 0.0, 1.0, 1.0), ("x", "1h", at(1), 1.0, 0.5, 0.0, 1.0, 1.0), ("x", "1h", at(9), 1.0, 2.0, 0.0, 1.0, None)]
    bars = spark.createDataFrame(rows, "symbol string, timeframe string, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
    got = sorted((r.fault, r.datetime.hour, r.minutes) for r in B.faults(bars).collect())
    assert got == [("gap", 9, 480), ("missing", 9, 480), ("prices", 1, 60), ("repeated", 0, 0)]


def test_a_folder_of_exports(spark, tmp_path):
    """One scan; lines that aren't bars are listed with their cause, files that are stored are left out, and one that changed comes again."""
    folder = tmp_path / "in" / "x_Data"
    folder.mkdir(parents=True)
    write(folder / "x_1h_Bid_a.csv", ["2024.01.10 12:00:00", "2024.10.27 03:30:00", "never", "2024.01.10 13:00:00"], 10)
    write(folder / "x_1h_Bid_b.csv", ["2024.01.10 13:00:00", "2024.01.10 14:00:00"], 20)
    (folder / "y_5m.csv").write_text("Time,Open,High,Low,Close\n2024.01.10 12:00:00,1,2,0.5,1.5\n2024.01.10 12:05:00,1,2\n2024.01.10 12:10:00,1,x,0.5,1.5\n2024.01.10 12:15:00,1,2,0.5,1.5,7,8\n")
    (folder / "notes.csv").write_text("a,b\n1,2\n")
    first = files.import_exports(spark, str(tmp_path / "in"), "EET")
    bars = sorted((r.symbol, r.timeframe, r.datetime.hour, r.close, r.volume) for r in first.bars.collect())
    assert bars == [("x", "1h", 19, 10.0, 5.0), ("x", "1h", 20, 10.0, 5.0), ("x", "1h", 21, 20.0, 5.0), ("y", "5m", 19, 1.5, 0.0)]
    failures = sorted((r.file.rsplit("/", 1)[1], r.cause) for r in first.failures.collect())
    assert failures == [("notes.csv", "name"), ("x_1h_Bid_a.csv", "clock"), ("x_1h_Bid_a.csv", "time"), ("y_5m.csv", "columns"), ("y_5m.csv", "columns"), ("y_5m.csv", "price")]
    assert sorted((r.file.rsplit("/", 1)[1], r.n_bars, r.n_failures) for r in first.files.collect()) == [("notes.csv", 0, 1), ("x_1h_Bid_a.csv", 2, 2), ("x_1h_Bid_b.csv", 2, 0), ("y_5m.csv", 1, 3)]
    first.files.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert files.import_exports(spark, str(tmp_path / "in"), "EET", log).bars.count() == 0
    time.sleep(1.1)
    write(folder / "x_1h_Bid_b.csv", ["2024.01.10 15:00:00"], 30)
    again = files.import_exports(spark, str(tmp_path / "in"), "EET", log)
    assert [(r.symbol, r.datetime.hour, r.close) for r in again.bars.collect()] == [("x", 22, 30.0)]
    assert B.merged(first.bars, again.bars.select(*first.bars.columns)).count() >= 1
