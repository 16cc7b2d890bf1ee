"""Streams against batch definitions: indicators by state, sessions, and bars that are sent again."""

import datetime
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candleforge.streaming import bars as SB
from candleforge.streaming import indicators as SI
from tests.test_market import series, values

SHAPE = "symbol string, timeframe string, datetime timestamp, open double, high double, low double, close double, volume double, bar_index long"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, SI.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def run(spark, df, where, name):
    q = df.writeStream.format("parquet").option("path", str(where / f"{name}-out")).option("checkpointLocation", str(where / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return spark.read.parquet(str(where / f"{name}-out"))


def write(spark, x, where):
    spark.createDataFrame(x).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in SHAPE.split(", ")]).coalesce(1).write.mode("append").parquet(str(where))


def test_a_state_gives_the_numbers_of_the_batch(spark):
    """Bar by bar, and in any split."""
    x = series(260)
    want = values(spark, x, ema=("ema", {"length": 20}), rsi=("rsi", {}), atr=("atr", {}), adx=("adx", {}), line=("supertrend_line", {}), way=("supertrend_direction", {}))
    one = SI.Running(SI.Lengths())
    got = pd.DataFrame([one.add(t, h, l, c) for t, h, l, c in zip(x.datetime, x.high, x.low, x.close, strict=True)], columns=["ema", "rsi", "atr", "adx", "line", "way"], dtype=float)
    for c in got:
        assert np.allclose(got[c], want[c], atol=1e-9, equal_nan=True), c
    again = SI.Running(SI.Lengths(), dict(SI.Running(SI.Lengths()).s))
    assert again.add(x.datetime[0], x.high[0], x.low[0], x.close[0])[0] == x.close[0]


@pytest.mark.parametrize("step", [100, 7, 1])
def test_streamed_indicators_equal_batch_after_restarts(rocks, tmp_path, step):
    """Micro-batches of any size, a restart from the checkpoint after each, rows sent again and late rows."""
    spark, n = rocks, {100: 150, 7: 14, 1: 3}[step]
    x, y = series(n, seed=3), series(n, seed=4).assign(symbol="Y")
    want = {}
    for z in (x, y):
        v = values(spark, z, ema=("ema", {"length": 20}), rsi=("rsi", {}), atr=("atr", {}), adx=("adx", {}), line=("supertrend_line", {}), way=("supertrend_direction", {}))
        want |= {(z.symbol[0], r.datetime): (r.ema, r.rsi, r.atr, r.adx, r.line, r.way) for r in v.itertuples()}
    for at in range(0, n, step):
        part = pd.concat([z.iloc[max(0, at - 2) : at + step] for z in (x, y)]).sample(frac=1, random_state=1)  # two bars come again
        write(spark, part, tmp_path / "in")
        stream = SI.stream_indicators(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")))
        got = run(spark, stream, tmp_path, "s")
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        mine = (r.ema, r.rsi, r.atr, r.adx, r.supertrend_line, r.supertrend_direction)
        assert all((a is None and math.isnan(b)) or a == pytest.approx(b, abs=1e-9) for a, b in zip(mine, want[r.symbol, r.datetime], strict=True)), (r, want[r.symbol, r.datetime])


def test_an_idle_series_is_forgotten(rocks, tmp_path):
    """With a time to live, batches go on until the query is stopped; a series that came back late begins anew."""
    spark, x = rocks, series(40, seed=5)
    write(spark, x.iloc[:20], tmp_path / "in")
    stream = SI.stream_indicators(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")), idle_ms=1)
    q = stream.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        for part, rows in ((None, 20), (x.iloc[20:], 40)):
            if part is not None:
                write(spark, part, tmp_path / "in")
            until = time.monotonic() + 60
            while spark.table("forgotten").count() < rows and time.monotonic() < until:
                time.sleep(0.5)
    finally:
        q.stop()
    got = {r.datetime: r.ema for r in spark.table("forgotten").collect()}
    assert len(got) == 40 and got[x.datetime[20].to_pydatetime()] == pytest.approx(x.close[20])


def test_the_state_store_and_the_version_are_asked_for(spark, tmp_path):
    with pytest.raises(ValueError, match="RocksDB"):
        SI.stream_indicators(spark.readStream.schema(SHAPE).parquet(str(tmp_path)))


def batch_sessions(rows, gap):
    out = []
    for s in sorted({r[0] for r in rows}):
        mine = sorted({r for r in rows if r[0] == s}, key=lambda r: (r[1], r[3]))
        wait = datetime.timedelta(minutes=gap[s])
        groups = []
        for r in mine:
            if groups and r[1] < groups[-1][-1][1] + wait:
                groups[-1].append(r)
            else:
                groups.append([r])
        out += [(s, g[0][1], g[-1][1] + wait, g[0][2], max(r[2] for r in g), min(r[2] for r in g), g[-1][2], float(len(g))) for g in groups]
    return sorted(out)


def test_sessions_equal_a_batch_definition(spark, tmp_path):
    rng = np.random.default_rng(2)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(s, begin + datetime.timedelta(minutes=int(m)), float(rng.integers(1, 100)), k * 1000 + i) for k, s in enumerate("ab") for i, m in enumerate(np.cumsum(rng.choice([1, 5, 20, 45, 90], 150)))]
    end = [(s, begin + datetime.timedelta(days=30), 1.0, 10**6 + k) for k, s in enumerate("ab")]  # moves the watermark on
    shape = "event_type string, ts timestamp, value double, event_id long"
    for k, part in enumerate([rows + rows[:40] + [("a", None, 1.0, -1), ("a", begin, None, -2)], end, [("a", begin, 5.0, -3), *end]]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run(spark, SB.stream_sessions(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), gap="30 minutes", gaps={"b": "60 minutes"}), tmp_path, "w")
    found = sorted(tuple(r) for r in got.where(F.col("begin") < "2024-01-29").collect())
    assert found == batch_sessions(rows, {"a": 30, "b": 60})


def test_bars_sent_again_count_once(spark, tmp_path):
    x = series(30)
    for part in (x.iloc[:20], x.iloc[10:], x.iloc[25:]):
        write(spark, part, tmp_path / "in")
        got = run(spark, SB.first_of_bars(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))), tmp_path, "d")
    assert sorted(r.bar_index for r in got.collect()) == list(range(30))
