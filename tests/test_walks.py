"""Walk-forward windows and scores, re-ranking, intervals and watched searches against plain definitions."""

import datetime
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candleforge.operators import analysis as A
from candleforge.operators import intervals, rankings, search
from candleforge.operators.jobs import Search
from candleforge.operators.walk_forward import Windows, calendar, proven, scores, summary

BEGIN = datetime.datetime(2020, 1, 31)


def trades_of(spark, n=400, days=900, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b", "c"):
        for k, d in enumerate(sorted(rng.integers(0, days, n).tolist())):
            at = BEGIN + datetime.timedelta(days=d, hours=int(rng.integers(24)))
            rows.append((s, k, at, at + datetime.timedelta(hours=1), float(rng.integers(-9, 11))))
    rows.append(("idle", 0, BEGIN, BEGIN, 1.0))
    x = pd.DataFrame(rows, columns=["series", "trade_number", "entry_time", "exit_time", "profit"])
    df = spark.createDataFrame(x).withColumn("entry_time", F.col("entry_time").cast("timestamp_ntz")).withColumn("exit_time", F.col("exit_time").cast("timestamp_ntz"))
    return x, df


def measures(x):
    if not len(x):
        return 0, 0.0, 0.0, 0.0, 0.0
    p = x.sort_values(["exit_time", "trade_number"]).profit
    gain, loss, equity = p[p > 0].sum(), -p[p < 0].sum(), p.cumsum()
    return len(p), p.sum(), 100 * (p > 0).mean(), gain / loss if loss else 999.0 if gain else 0.0, (equity.cummax() - equity).max()


def plain_windows(x, w):
    """Windows by adding calendar units to the first day, as long as the test ends by the last day."""
    step = {"day": lambda n: pd.DateOffset(days=n), "month": lambda n: pd.DateOffset(months=n), "year": lambda n: pd.DateOffset(years=n)}[w.unit]
    first, last, out, k = x.entry_time.min().normalize(), x.entry_time.max().normalize(), [], 0
    while first + step(k * w.step + w.train + w.test) <= last:
        out.append(tuple(first + step(k * w.step + n) for n in (0, w.train, w.train + w.test)))
        k += 1
    return out


@pytest.mark.parametrize("w", [Windows(30, 10, 7, "day"), Windows(6, 2, 3, "month"), Windows(1, 1, 1, "year"), Windows(5, 1, 1, "year")])
def test_windows_and_proofs(spark, w):
    x, df = trades_of(spark)
    want = plain_windows(x, w)
    got = [(r.train_start, r.train_end, r.test_end) for r in calendar(df, w).orderBy("window_id").collect()]
    assert got == [tuple(t.date() for t in z) for z in want]
    rows = proven(df, w, top=2, by="profit_factor").toPandas()
    assert len(rows) == sum(min(2, x[(x.entry_time >= a) & (x.entry_time < b)].series.nunique()) for a, b, _ in want)
    for r in rows.itertuples():
        a, b, c = want[r.window_id - 1]
        part = x[x.series == r.series]
        assert (r.train_trades, r.train_net_profit, r.train_win_rate, r.train_profit_factor, r.train_max_dd) == pytest.approx(measures(part[(part.entry_time >= a) & (part.entry_time < b)]))
        assert (r.test_trades, r.test_net_profit, r.test_win_rate, r.test_profit_factor, r.test_max_dd) == pytest.approx(measures(part[(part.entry_time >= b) & (part.entry_time < c)]))
        assert r.passed == (r.test_profit_factor >= 1 and r.test_trades >= 5 and r.test_net_profit > 0)


def test_scores_of_series(spark):
    x, df = trades_of(spark)
    w = Windows(30, 10, 7, "day")
    want = plain_windows(x, w)
    got = {r.series: r for r in scores(df, w).collect()}
    assert set(got) == {"a", "b", "c", "idle"} and got["idle"].wf_score == 0 and got["idle"].total_windows == len(want)
    for s in "abc":
        part = x[x.series == s]
        tests = [measures(part[(part.entry_time >= b) & (part.entry_time < c)]) for _, b, c in want]
        n, profit, dd = len(tests), sum(t[1] for t in tests), max(t[4] for t in tests)
        rate = sum(t[3] >= 1 and t[0] >= 5 and t[1] > 0 for t in tests) / n
        score = rate * 35 + min(sum(t[3] for t in tests) / n / 2, 2) * 20 + min(sum(t[2] for t in tests) / n / 60, 2) * 10 + (max(0, min(profit / dd, 5)) if dd else 1) * 20 + min(sum(t[0] for t in tests) / 100, 2) * 5 + min(max(profit, 0), 100) * 0.1
        assert got[s].wf_score == pytest.approx(score, abs=2e-6)
    one = summary(proven(df, w)).first()
    assert one.total_windows == len(want) and 0 <= one.pass_rate <= 1
    none = summary(proven(df, Windows(50, 1, 1, "year"))).first()
    assert (none.total_windows, none.wf_score, none.pass_rate) == (0, 0.0, 0.0)
    with pytest.raises(ValueError):
        Windows(0, 1)


def test_means_leave_out_what_has_no_trades_or_no_loss(spark):
    rows = [("s", 3, 5.0, 999.0, 60.0, 1.0), ("s", 0, 0.0, 0.0, 0.0, 0.0), ("s", 4, 2.0, 1.5, 50.0, 2.0), ("s", 4, -1.0, 0.7, 40.0, 3.0)]
    tests = rankings.judged(spark.createDataFrame(rows, "series string, test_trades long, test_net_profit double, test_profit_factor double, test_win_rate double, test_max_dd double"))
    one = rankings.overall(tests).first()
    assert (one.tests, one.valid_tests, one.pass_rate, one.avg_win_rate, one.max_dd, one.negative_tests, one.rating) == (4, 3, 50.0, 50.0, 3.0, 1, "C")
    assert one.avg_pf == pytest.approx(1.1)
    assert [tuple(r) for r in A.rated(tests).collect()] == [("s", "C")]


def test_reranking_by_eighteen_weights(spark):
    names = [f for f in rankings.Weights.__dataclass_fields__]
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.random((20, 18)), columns=names).assign(series=[f"s{i:02}" for i in range(20)])
    down = {"max_dd", "losing_years", "losing_months", "max_consecutive_losses"}
    want = sum(x[n] * getattr(rankings.Weights(), n) * (-1 if n in down else 1) for n in names)
    got = rankings.reranked(spark.createDataFrame(x)).toPandas().sort_values("series")
    assert np.allclose(got.new_score, want, atol=2e-6) and (got["rank"].to_numpy() == want.rank(ascending=False).to_numpy()).all()
    some = rankings.reranked(spark.createDataFrame(x), rankings.Weights(profit_factor=1.0, **{n: 0.0 for n in names if n != "profit_factor"}), rankings.Exclusions(minimum_win_rate=0.5)).toPandas()
    assert set(some.series) == set(x.series[x.win_rate >= 0.5]) and some.sort_values("rank").new_score.is_monotonic_decreasing


def test_the_base_value_stays_among_the_variants():
    got = search.one_at_a_time({"a": 1, "b": 2}, {"a": [1, 3], "b": [2], "c": [5, 6]})
    assert got == [("a", {"a": 1, "b": 2}), ("a", {"a": 3, "b": 2}), ("c", {"a": 1, "b": 2, "c": 5}), ("c", {"a": 1, "b": 2, "c": 6})]


def test_intervals_that_do_not_overlap(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for s in ("a", "b", "c"):
        begins = sorted(rng.choice(3000, 700, replace=False).tolist())
        mine = [(s, int(b), int(b + rng.integers(0, 6)) if s != "c" or b < 1500 else None, "x") for b in begins]
        rows += mine
        at, k = -1, 0
        for _, b, e, _ in mine:
            if b > at:
                k += 1
                want.append((s, b, e, k))
                if e is None:
                    break
                at = e
    df = spark.createDataFrame(rows, "series string, begin long, end long, note string").repartition(5)
    got = intervals.chosen(df)
    assert sorted((r.series, r.begin, r.end, r.number) for r in got.collect()) == sorted(want) and got.columns == [*df.columns, "number"]
    assert intervals.chosen(df.limit(0)).count() == 0


def test_one_search_is_stopped_while_another_goes_on(spark):
    slow = lambda batches: (time.sleep(0.4) or b for b in batches)
    work = lambda n: lambda: spark.range(0, n, 1, n).mapInPandas(slow, "id long").count()
    long, short = Search(spark, work(400), "long"), Search(spark, work(6), "short")
    until = time.monotonic() + 60
    while long.progress().running == 0 and time.monotonic() < until:
        time.sleep(0.2)
    seen = long.progress()
    assert seen.running == 1 and seen.tasks == 400 and 0 <= seen.done < 400
    long.stop()
    with pytest.raises(RuntimeError, match="stopped"):
        long.result(60)
    assert short.result(120) == 6 and not short.running() and short.progress().running == 0
    with pytest.raises(RuntimeError, match="failed"):
        Search(spark, lambda: spark.sql("select assert_true(false)").collect()).result(60)
