"""Queries of trees, signals, backtests and analysis, and the same over standard SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions.compiler import DUCKDB, SPARK, Plan
from candleforge.functions.indicators import build
from candleforge.operators import analysis as A
from candleforge.operators import rankings as R
from candleforge.operators import search
from candleforge.operators.backtest import CONCURRENT_SQL, Strategy, concurrent, simulate, walk_forward
from candleforge.operators.comparison import compared, equity_by_share, halves
from candleforge.operators.intervals import chosen
from candleforge.operators.kernels import with_kernels
from candleforge.operators.ordering import kept, ranked
from candleforge.operators.walk_forward import Windows, proven, scores, summary
from candleforge.plans import signals
from candleforge.plans.combined import Combined, combined
from candleforge.plans.conditions import Compiler, evaluate, parse
from candleforge.plans.market_queries import HOURLY_SQL, KERNEL_SQL, hourly

TREES = {
    "tree_long": {"op": "AND", "children": [
        {"indicator": "close", "operator": ">", "value": "ema", "value_params": {"length": 50}},
        {"op": "OR", "children": [{"indicator": "rsi", "operator": "crosses_above", "value": 50.0}, {"indicator": "macd_histogram", "operator": ">", "value": 0.0}]},
        {"op": "NOT", "children": [{"indicator": "doji", "operator": "==", "value": 1.0}]},
    ]},
    "tree_offsets": {"op": "OR", "children": [
        {"indicator": "high", "operator": ">", "value": "highest_high", "value_params": {"length": 20}, "value_offset_pips": 10.0},
        {"indicator": "low", "operator": "<", "value": "lowest_low", "value_offset_pips": -0.1, "value_offset_mode": "atr_pct"},
        {"indicator": "candle_body", "operator": ">=", "value": 50.0, "literal_mode": "price_pct"},
        {"indicator": "atr", "operator": "crosses_below", "value": 95.0, "literal_mode": "atr_pct", "literal_atr_length": 50},
    ]},
}
MULTI = {"op": "AND", "children": [{"indicator": "close", "operator": ">", "value": "sma", "value_params": {"length": 5}, "value_timeframe": "4h"}, {"indicator": "close", "operator": ">", "value": "open", "timeframe": "1d", "value_timeframe": "1d"}]}
MULTI_SQL = f"""with {HOURLY_SQL},
h4 as (select symbol, t as datetime, lead(t) over (partition by symbol order by t) as known, case when count(c) over w = 5 then avg(c) over w end as v from (select symbol, date_trunc('day', datetime) + interval 4 hour * cast(floor(extract(hour from datetime) / 4) as bigint) as t, last(close order by datetime) as c from bars group by 1, 2) x window w as (partition by symbol order by t rows between 4 preceding and current row)),
d1 as (select symbol, lead(t) over (partition by symbol order by t) as known, o, c from (select symbol, date_trunc('day', datetime) as t, first(open order by datetime) as o, last(close order by datetime) as c from bars group by 1, 2) x)
select b.symbol, b.datetime, coalesce(b.close > h4.v, false) and coalesce(d1.c > d1.o, false) as signal
from bars b asof left join (select * from h4 where known is not null) h4 on b.symbol = h4.symbol and b.datetime >= h4.known asof left join (select * from d1 where known is not null) d1 on b.symbol = d1.symbol and b.datetime >= d1.known"""

PATTERN_TREE = {"op": "OR", "children": [{"indicator": "double_top_zigzag", "operator": "==", "value": 1.0}, {"indicator": "supertrend_flip_bearish", "operator": "==", "value": 1.0}, {"indicator": "abc_bearish", "operator": "==", "value": 1.0, "params": {"state": "candidate"}}]}

#: Settings that suit the test bars, whose prices are in tens.
SETTINGS = {"pip_size": 1.0, "min_body_pips": 1, "ema_distance_pips": 1, "max_body_pips": 500, "max_wick_pips": 800, "ema_length": 20, "round_number_pips": 50}


def _tree(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), {"signal": TREES[name]}, pip=1.0).select("symbol", "datetime", "signal")


def _tree_sql(name: str) -> str:
    c = Compiler(DUCKDB, pip=1.0)
    x = c.tree(parse(TREES[name]))
    return f"with {HOURLY_SQL} {c.plan.sql('bars', {'signal': x})}"


def _signals(plan: Plan, kernels: bool) -> dict[str, str]:
    names = [t for t in signals.TRIGGERS if ("supertrend" in t) == kernels]
    out = {f"trigger_{t}": signals.candidate(plan, t, [], **SETTINGS) for t in names}
    filters = [f for f in signals.FILTERS if ("supertrend" in f) == kernels]
    s = {**signals.DEFAULTS, **SETTINGS}
    out |= {f: f"coalesce({signals.FILTERS[f](plan, s)}, false)" for f in filters}
    return out


def legacy_signals(spark: SparkSession, sf_dir: str, kernels: bool = False) -> DataFrame:
    plan = Plan(SPARK)
    out = _signals(plan, kernels)
    return spark.sql(plan.sql("{bars}", out), bars=with_kernels(hourly(spark, sf_dir), " ".join([*out.values(), *plan.made])))


def legacy_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan(SPARK)
    x = signals.candidate(plan, "breakout", ["use_session_filter", "use_min_body_filter", "use_ema_distance_filter", "use_rsi_filter"], **SETTINGS)
    return spark.sql(plan.sql("{bars}", {"signal": x}), bars=hourly(spark, sf_dir))


def _candidate_sql() -> str:
    plan = Plan(DUCKDB)
    x = signals.candidate(plan, "breakout", ["use_session_filter", "use_min_body_filter", "use_ema_distance_filter", "use_rsi_filter"], **SETTINGS)
    return f"with {HOURLY_SQL} {plan.sql('bars', {'signal': x})}"


ENTRY = {"op": "AND", "children": [{"indicator": "close", "operator": ">", "value": "sma", "value_params": {"length": 50}}, {"indicator": "rsi", "operator": "crosses_above", "value": 50.0}]}
EXIT = {"indicator": "rsi", "operator": ">", "value": 70.0}
SIGNALS = {"long_signal": ENTRY, "short_signal": {"op": "AND", "children": [{"op": "NOT", "children": [ENTRY["children"][0]]}, {"indicator": "rsi", "operator": "crosses_below", "value": 50.0}]}, "exit_signal": EXIT}
STRATEGIES = {
    "long_rr": Strategy(direction="long", rr=1.5),
    "short_atr": Strategy(direction="short", sl_basis="atr", use_atr_trailing_stop=True),
    "both_fixed": Strategy(direction="both", sl_basis="fixed_pips", sl_fixed_pips=60, tp_basis="fixed_pips", tp_fixed_pips=90, pip_size=1.0, position_sizing_method="compounding"),
    "limit": Strategy(direction="long", entry_method="limit", order_offset_pips=10, pip_size=1.0, sl_basis="fixed_pips", sl_fixed_pips=80),
    "stop": Strategy(direction="short", entry_method="stop", order_offset_pips=10, pip_size=1.0, sl_basis="fixed_pips", sl_fixed_pips=80, use_breakeven_stop=True),
    "confirmed": Strategy(direction="long", confirm=True, lookahead_bars=5, partial_tp_levels=((0.5, 0.5), (1.0, 0.5))),
    "custom": Strategy(direction="long", tp_basis="custom", use_daily_exit=True, use_weekend_exit=True),
    "guarded": Strategy(direction="long", allow_concurrent_positions=True, max_dd_stop_pips=300, consecutive_loss_stop_count=3, consecutive_loss_stop_bars=24, spread_pips=1, pip_size=1.0),
}


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(hourly(spark, sf_dir), SIGNALS, pip=1.0, extra={"atr": ("atr", {})})


def backtest_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(signalled(spark, sf_dir), STRATEGIES)


#: Settings of the concurrent trades.
RR, LENGTH, FIRST = 1.5, 20, 50


def _entry(length: int) -> dict:
    """An entry that stands in for a signal wherever standard SQL has to follow."""
    return {"op": "AND", "children": [{"indicator": "close", "operator": ">", "value": "sma", "value_params": {"length": length}}, {"indicator": "bullish_candle", "operator": "==", "value": 1.0}]}


_CONCURRENT = _entry(LENGTH)


def _concurrent(spark: SparkSession, sf_dir: str, rr: float = RR, length: int = LENGTH) -> DataFrame:
    x = evaluate(hourly(spark, sf_dir), {"long_signal": _entry(length)}, pip=1.0).select("symbol", "bar_index", "datetime", "open", "high", "low", "long_signal")
    return concurrent(x, rr=rr, first=FIRST)


def concurrent_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal opens a position; exits are the first touch, however many bars later."""
    return _concurrent(spark, sf_dir).drop("entry_time", "exit_time")


def _concurrent_sql(rr: float = RR, length: int = LENGTH) -> str:
    c = Compiler(DUCKDB, pip=1.0)
    x = c.tree(parse(_entry(length)))
    inner = c.plan.sql("bars", {"long_signal": x}, keys="symbol, bar_index, datetime, open, high, low")
    body = CONCURRENT_SQL.format(rr=rr, first=FIRST, bars="sig").strip().removeprefix("with ")
    return f"with {HOURLY_SQL}, sig as ({inner}), {body}"


def trade_list(spark: SparkSession, sf_dir: str, rr: float = RR, length: int = LENGTH) -> DataFrame:
    """The concurrent trades as ``series, trade_number, entry_time, exit_time, profit``."""
    return _concurrent(spark, sf_dir, rr, length).select(F.col("symbol").alias("series"), F.col("signal_bar_index").alias("trade_number"), "entry_time", "exit_time", "profit")


def _trades_sql() -> str:
    return f"with trades as (select x.symbol as series, x.signal_bar_index as trade_number, a.datetime as entry_time, z.datetime as exit_time, x.profit from ({_concurrent_sql()}) x join (with {HOURLY_SQL} select * from bars) a on a.symbol = x.symbol and a.bar_index = x.entry_bar_index join (with {HOURLY_SQL} select * from bars) z on z.symbol = x.symbol and z.bar_index = x.exit_bar_index)"


_DAYS = {"spark": "datediff(last, first)", "duckdb": "date_diff('day', first, last)"}


def _statements(dialect: str) -> dict[str, str]:
    spark = dialect == "spark"
    t = "{trades}"
    text = "string" if spark else "varchar"
    numbers = "explode(sequence(1, 1000))" if spark else "unnest(range(1, 1001))"
    quantile = lambda q: f"percentile(dd, {q})" if spark else f"quantile_cont(dd, {q})"
    monte_carlo = A.MONTE_CARLO.format(q50=quantile(0.5), q90=quantile(0.9), q95=quantile(0.95), q99=quantile(0.99), text=text, numbers=numbers, trades=t)
    return {
        "analysis_days": A.periods("day").replace("{ntz}", "_ntz" if spark else ""),
        "analysis_months": A.periods("month").replace("{ntz}", "_ntz" if spark else ""),
        "analysis_summary": A.SUMMARY,
        "analysis_streaks": A.STREAKS,
        "analysis_equity": f"select series, trade_number, exit_time, profit, round(equity + 1e-9, 6) as equity, round(equity_high + 1e-9, 6) as equity_high, round(drawdown + 1e-9, 6) as drawdown from ({A.EQUITY}) e",
        "analysis_ratios": A.RATIOS.format(per_year=52, unit="week", days=_DAYS[dialect], trades=t),
        "analysis_stability": A.STABILITY.format(unit="week", trades=t),
        "analysis_monte_carlo": monte_carlo,
        "analysis_stability_report": A.stability_report("week", "day"),
        "analysis_older_metrics": A.OLDER_METRICS,
        "analysis_calmar": A.CALMAR.format(per_year=52, unit="week", days=_DAYS[dialect], trades=t),
        "analysis_out_of_sample": A.OUT_OF_SAMPLE.format(share="0.7", trades=t),
    }


def _analysis(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: A.run(_statements("spark")[name], trade_list(spark, sf_dir))


def _analysis_sql(name: str) -> str:
    x = _statements("duckdb")[name].format(trades="trades")
    if x.startswith("with "):
        return f"{_trades_sql()}, {x.removeprefix('with ')}"
    return f"{_trades_sql()} {x}"


SPACE = {"rr": [1.0, 1.5, 2.0], "breakout_bars": [5, 10, 20], "ema_length": [100, 200]}


SENSITIVE = {"direction": "long", "rr": 1.5, "sl_basis": "fixed_pips", "sl_fixed_pips": 60.0, "pip_size": 1.0}
SENSITIVE_SPACE = {"rr": [1.0, 1.5, 2.0, 2.5], "sl_fixed_pips": [40.0, 60.0, 80.0], "pip_size": [1.0]}


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parameter changed at a time: how flat the profit factor stays, by parameter."""
    variants = search.one_at_a_time(SENSITIVE, SENSITIVE_SPACE)
    named = {f"{k}|{v[k]}": Strategy.of(v) for k, v in variants}
    trades = simulate(signalled(spark, sf_dir), named).select(F.col("param_id").alias("series"), "trade_number", "entry_time", "exit_time", "profit")
    x = A.run(A.SUMMARY, trades).withColumn("param", F.element_at(F.split("series", "\\|"), 1))
    return R.flatness(x)


#: Orders of the merged trades of all series.
_MERGED = "select 'all' as series, {concat} as trade_number, entry_time, exit_time, profit from {trades}"


#: Windows of the walk-forward tests, and the drawdown that a test may have here, where prices are in tens.
WALK, MOST_DD = Windows(10, 3, 1, "day"), 300.0
_ROUNDED = ("net_profit", "profit_factor", "win_rate", "max_dd")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row a series of the concurrent trades; the bars span weeks, which stand for years and months here."""
    return R.metrics(trade_list(spark, sf_dir), year="week", month="day", windows=WALK)


def _rounded(x: DataFrame, *columns: str) -> list:
    return [F.round(F.col(c) + 1e-9, 6).alias(c) for c in columns]


def walk_forward_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best series of each training part, proven on the test part."""
    x = R.judged(proven(trade_list(spark, sf_dir), WALK, top=3), MOST_DD)
    return x.select("window_id", "series", "rank", *[F.col(f"{d}_{k}").cast("timestamp_ntz").alias(f"{d}_{k}") for d in ("train", "test") for k in ("start", "end")], "train_trades", "test_trades", *_rounded(x, *[f"{p}_{c}" for p in ("train", "test") for c in _ROUNDED]), "passed", "judgement")


_SUMMED = ("pass_rate", "oos_total_profit", "oos_avg_profit", "oos_avg_pf", "oos_avg_win_rate", "oos_worst_dd", "wf_score")


def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = summary(proven(trade_list(spark, sf_dir), WALK))
    return x.select("total_windows", "passed_windows", "oos_total_trades", *_rounded(x, *_SUMMED))


def walk_forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scores(trade_list(spark, sf_dir), WALK)
    return x.select("series", "total_windows", "passed_windows", "oos_total_trades", *_rounded(x, *_SUMMED))


#: Trades in windows, and measures of each part, by range joins and windows of standard SQL.
_WALK_SQL = """cal as (select min(entry_time)::date as f, date_diff('day', min(entry_time)::date, max(entry_time)::date) as e from trades),
wb as (select unnest(range(0, greatest(e - 12, 0))) as b from cal),
wt as (select b, series, case when u < b + 10 then 'train' else 'test' end as part, trade_number, exit_time, profit from wb join (select t.*, date_diff('day', f, entry_time::date) as u from trades t, cal) x on u >= b and u < b + 13),
we as (select *, sum(profit) over (partition by b, series, part order by exit_time, trade_number) as eq from wt),
wm as (select b, series, part, count(*) as n, sum(profit) as net, 1e2 * count(*) filter (where profit > 0) / count(*) as wr, case when sum(greatest(-profit, 0)) > 0 then sum(greatest(profit, 0)) / sum(greatest(-profit, 0)) when sum(greatest(profit, 0)) > 0 then 999.0 else 0.0 end as pf, max(hi - eq) as dd
from (select *, max(eq) over (partition by b, series, part order by exit_time, trade_number) as hi from we) h group by b, series, part),
wr as (select b, series, row_number() over (partition by b order by round(net, 6) desc, series) as rank, n as train_trades, net as train_net_profit, pf as train_profit_factor, wr as train_win_rate, dd as train_max_dd from wm where part = 'train'),
wp as (select r.*, coalesce(t.n, 0) as test_trades, coalesce(t.net, 0) as test_net_profit, coalesce(t.pf, 0) as test_profit_factor, coalesce(t.wr, 0) as test_win_rate, coalesce(t.dd, 0) as test_max_dd, coalesce(t.pf >= 1 and t.n >= 5 and t.net > 0, false) as passed,
case when coalesce(t.n, 0) = 0 then 'NO_TRADE' when t.net > 0 and t.pf >= 1.2 and t.dd <= 300 then 'PASS' when t.net > 0 then 'CAUTION' else 'FAIL' end as judgement from wr r left join wm t on t.b = r.b and t.series = r.series and t.part = 'test')"""
_WF_SUMS = "count(*) filter (where passed) as passed_windows, coalesce(sum(test_net_profit), 0) as total, coalesce(sum(test_profit_factor), 0) as pfs, coalesce(sum(test_win_rate), 0) as wrs, coalesce(max(test_max_dd), 0) as oos_worst_dd, coalesce(sum(test_trades), 0)::bigint as oos_total_trades"


def _wf_score_sql(inner: str, keys: str = "") -> str:
    """The score over ``inner``, which has ``total_windows`` and the sums above."""
    score = "35 * passed_windows / m + 20 * greatest(0, least(pfs / m / 2, 2)) + 10 * greatest(0, least(wrs / m / 60, 2)) + 20 * (case when oos_worst_dd <= 0 then 1 else greatest(0, least(total / nullif(oos_worst_dd, 0), 5)) end) + 5 * least(oos_total_trades / 1e2, 2) + 0.1 * least(greatest(total, 0), 100)"
    return f"select {keys} total_windows, passed_windows, oos_total_trades, round(passed_windows / m + 1e-9, 6) as pass_rate, round(total + 1e-9, 6) as oos_total_profit, round(total / m + 1e-9, 6) as oos_avg_profit, round(pfs / m + 1e-9, 6) as oos_avg_pf, round(wrs / m + 1e-9, 6) as oos_avg_win_rate, round(oos_worst_dd + 1e-9, 6) as oos_worst_dd, round(round(case when oos_total_trades > 0 then {score} else 0e0 end + 1e-9, 6) + 1e-9, 6) as wf_score from (select *, greatest(total_windows, 1)::double as m from ({inner}) i) j"


_SERIES_SCORES = _wf_score_sql(f"select series, (select count(*) from wb) as total_windows, {_WF_SUMS} from (select s.series, coalesce(n, 0) as test_trades, coalesce(net, 0) as test_net_profit, coalesce(pf, 0) as test_profit_factor, coalesce(wr, 0) as test_win_rate, coalesce(dd, 0) as test_max_dd, coalesce(pf >= 1 and n >= 5 and net > 0, false) as passed from (select distinct series from trades) s left join wm t on t.series = s.series and t.part = 'test') q group by series", "series,")
_TESTS_SQL = "select b + 1 as window_id, series, rank, " + ", ".join(f"cast(f + cast(b + {x} as int) as timestamp) as {n}" for n, x in (("train_start", 0), ("train_end", 10), ("test_start", 10), ("test_end", 13))) + ", train_trades, test_trades, " + ", ".join(f"round({p}_{c} + 1e-9, 6) as {p}_{c}" for p in ("train", "test") for c in _ROUNDED) + ", passed, judgement from wp, cal where rank <= 3"
_RATED = "case when pass_rate >= 70 and avg_pf >= 1.5 and total_profit > 0 and negative_tests <= 4 then 'A' when pass_rate >= 55 and avg_pf >= 1.2 and total_profit > 0 then 'B' when pass_rate >= 40 and total_profit > 0 then 'C' else 'D' end"
_OVERALL = "count(*) as tests, count(*) filter (where test_trades > 0) as valid_tests, 1e2 * count(*) filter (where judgement = 'PASS') / count(*) as pass_rate, coalesce(avg(test_profit_factor) filter (where test_trades > 0 and test_profit_factor < 999), 0) as avg_pf, coalesce(avg(test_win_rate) filter (where test_trades > 0), 0) as avg_win_rate, sum(test_net_profit) as total_profit, max(test_max_dd) as max_dd, count(*) filter (where test_net_profit < 0) as negative_tests"
_OVERALL_SQL = f"select tests, valid_tests, round(pass_rate + 1e-9, 6) as pass_rate, round(avg_pf + 1e-9, 6) as avg_pf, round(avg_win_rate + 1e-9, 6) as avg_win_rate, round(total_profit + 1e-9, 6) as total_profit, round(max_dd + 1e-9, 6) as max_dd, negative_tests, {_RATED} as rating from (select {_OVERALL} from wp where rank <= 3) o"

#: Variants of the concurrent trades in one setting at a time.
VARIANTS = search.one_at_a_time({"rr": RR, "length": LENGTH}, {"rr": [1.0, 1.5, 2.0], "length": [10, 20, 40]})


def sensitivity_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How flat each series' profit factor stays when one setting of its concurrent trades changes."""
    trades = None
    for k, v in VARIANTS:
        one = trade_list(spark, sf_dir, v["rr"], v["length"]).withColumn("series", F.concat_ws("|", "series", F.lit(k), F.lit(str(v[k]))))
        trades = one if trades is None else trades.union(one)
    x = A.run(A.SUMMARY, trades).select(F.split("series", "\\|").alias("s"), "profit_factor")
    return R.flatness(x.select(F.col("s")[0].alias("series"), F.col("s")[1].alias("param"), "profit_factor"), "series")


def _series_sensitivity_sql() -> str:
    trades = " union all ".join(f"select symbol as series, '{k}' as param, '{v[k]}' as value, profit from ({_concurrent_sql(v['rr'], v['length'])}) x" for k, v in VARIANTS)
    gain, loss = "sum(case when profit > 0 then profit else 0e0 end)", "sum(case when profit < 0 then -profit else 0e0 end)"
    return f"select series, param, count(*) as variants_tested, min(pf) as pf_min, max(pf) as pf_max, round(case when max(pf) > 0 then min(pf) / max(pf) else 0 end * 100 + 1e-9, 6) as flatness from (select series, param, value, round({A.factor(gain, loss)} + 1e-9, 6) as pf from ({trades}) t group by series, param, value) f group by series, param"


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four grades of each series and their mean: stability, orders of trades, walk-forward tests, sensitivity."""
    trades = kept(trade_list(spark, sf_dir))
    tests = R.judged(proven(trades, WALK, top=None), MOST_DD)
    graded = lambda x, c: x.select("series", F.col(c).alias("grade"))
    return A.confidence(
        stability=graded(A.run(_statements("spark")["analysis_stability"], trades), "grade"), monte_carlo=graded(A.run(_statements("spark")["analysis_monte_carlo"], trades), "rating"),
        walk_forward=A.rated(tests), sensitivity=graded(R.sensitivity_rating(sensitivity_by_series(spark, sf_dir), "series"), "rating"),
    )


def _confidence_sql() -> str:
    x = _statements("duckdb")
    grades = f"select series, grade from ({x['analysis_stability'].format(trades='trades')}) a union all select series, rating from ({x['analysis_monte_carlo'].format(trades='trades')}) b union all select series, {_RATED} from (select series, {_OVERALL} from wp group by series) c union all select series, case when score >= 80 then 'A' when score >= 65 then 'B' when score >= 50 then 'C' else 'D' end from (select series, round(avg(flatness) + 1e-9, 2) as score from ({_series_sensitivity_sql()}) f group by series) d"
    return f"{_trades_sql()}, {_WALK_SQL}, g as (select series, case grade when 'A' then 1e2 when 'B' then 75 when 'C' then 50 else 25 end as points from ({grades}) e) select series, count(*) as components, round(avg(points) + 1e-9, 6) as score, case when avg(points) >= 87.5 then 'A' when avg(points) >= 62.5 then 'B' when avg(points) >= 37.5 then 'C' else 'D' end as grade from g group by series"


def composite_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = A.run(_MERGED.replace("{concat}", "concat(series, '/', trade_number)"), trade_list(spark, sf_dir))
    return A.run(_statements("spark")["analysis_monte_carlo"], merged)


#: Thresholds and exclusions that the test tables pass in part.
THRESHOLDS = R.Thresholds(trades=20, profit_factor=0.1, max_dd=1_000_000.0, win_rate=10.0)
EXCLUSIONS = R.Exclusions(minimum_trades=20, maximum_consecutive_losses=12, minimum_win_rate=30.0)


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that no exclusion hits, the best first by a linear score of four measures."""
    four = {"profit_factor": 10.0, "win_rate": 0.5, "max_dd": 0.01, "max_consecutive_wins": 5.0}
    weights = R.Weights(**{f.name: four.get(f.name, 0.0) for f in fields(R.Weights)})
    x = R.reranked(results(spark, sf_dir), weights, EXCLUSIONS)
    return x.select("series", F.col("new_score").alias("score"), F.col("rank").cast("long").alias("rank"))


#: Exclusions that set all that have a number, and let some of the test tables' series pass.
ALL_EXCLUSIONS = R.Exclusions(minimum_trades=20, minimum_profit=-100_000.0, minimum_pf=0.5, minimum_yearly_stability=1.0, minimum_monthly_stability=1.0, maximum_drawdown=100_000.0, minimum_win_rate=10.0, minimum_average_profit=-100.0, maximum_consecutive_losses=40, exclude_short=True)


def reranked_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The re-ranking by its eighteen default weights, with every numeric exclusion set."""
    x = R.reranked(results(spark, sf_dir), R.Weights(), ALL_EXCLUSIONS)
    return x.select("series", "new_score", F.col("rank").cast("long").alias("rank"))


_EIGHTEEN = "1000 * profit_factor + 2 * net_profit + 10000 * expected_value + 10 * win_rate - 50 * max_dd + 20 * year_stability + 30 * winning_years - 50 * losing_years + 5 * avg_yearly_profit + 5 * min_yearly_profit + 20 * month_stability + 2 * winning_months - 2 * losing_months + 10 * avg_monthly_profit + 10 * min_monthly_profit - 20 * max_consecutive_losses"


WINDOWS = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=a), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=a + 15), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=a + 20)) for a in (0, 4, 8)]


def walk_forward_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies fitted on 15 days and proven on the next 5, with a judgement of each test."""
    base = {"direction": "long", "sl_basis": "fixed_pips", "pip_size": 1.0, "first_bar": 1}
    grid = {f"{a}/{b}": Strategy.of({**base, "rr": a, "sl_fixed_pips": b}) for a in (1.0, 1.5, 2.0) for b in (40.0, 80.0)}
    return R.judged(walk_forward(signalled(spark, sf_dir), grid, WINDOWS))


SINGLE = {"backtest_long_rr": Strategy(direction="long", rr=1.5), "backtest_short_rr": Strategy(direction="short", rr=1.0, spread_pips=2, pip_size=0.5)}


def single(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: simulate(signalled(spark, sf_dir), {name: SINGLE[name]}).select("symbol", "trade_number", "direction", "signal_bar_index", "entry_bar_index", "entry_price", "exit_bar_index", "exit_price", "sl", "tp", "exit_reason", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("profit", "mae", "mfe")])


#: One position at a time: each signal's trade by a range join, and a walk from trade to trade by recursion.
_SINGLE_SQL = """c as (select s.symbol, s.bar_index as g, e.bar_index as k, e.open as entry, {side} * (e.open - {behind}) as risk, {behind} as sl, e.open + {side} * {rr} * ({side} * (e.open - {behind})) as tp
  from sig s join sig e on s.symbol = e.symbol and e.bar_index = s.bar_index + 1 where s.{signal} and s.bar_index >= 250 and {side} * (e.open - {behind}) > 0),
o as (select c.symbol, c.g, min(b.bar_index) as x from c join sig b on b.symbol = c.symbol and b.bar_index >= c.k and ({side} * b.{against} <= {side} * c.sl or {side} * b.{along} >= {side} * c.tp) group by 1, 2),
t as (select c.*, o.x from c left join o on o.symbol = c.symbol and o.g = c.g),
walk as (select symbol, min(g) as g, 1 as n from t group by symbol union all
  select w.symbol, (select min(n.g) from t n where n.symbol = w.symbol and n.g > t.x), w.n + 1 from walk w join t on t.symbol = w.symbol and t.g = w.g where exists (select 1 from t n where n.symbol = w.symbol and n.g > t.x)),
y as (select t.*, w.n, (select {worst}(b.{against}) from sig b where b.symbol = t.symbol and b.bar_index between t.k and t.x) as worst, (select {best}(b.{along}) from sig b where b.symbol = t.symbol and b.bar_index between t.k and t.x) as best from walk w join t on t.symbol = w.symbol and t.g = w.g where t.x is not null),
z as (select y.*, {side} * b.{against} <= {side} * sl as stopped, {side} * b.{along} >= {side} * tp as reached from y join sig b on b.symbol = y.symbol and b.bar_index = y.x)
select symbol, cast(n as bigint) as trade_number, '{direction}' as direction, g as signal_bar_index, k as entry_bar_index, round(entry, 5) as entry_price, x as exit_bar_index, round(case when stopped then sl else tp end, 5) as exit_price, round(sl, 5) as sl, round(tp, 5) as tp,
  case when stopped and reached then 'SL_and_TP_SL_first' when stopped then 'SL' else 'TP' end as exit_reason, round(round({side} * (case when stopped then sl else tp end - entry) - {cost}, 5) + 1e-9, 4) as profit,
  round(round(greatest(0, {side} * (entry - worst)), 5) + 1e-9, 4) as mae, round(round(greatest(0, {side} * (best - entry)), 5) + 1e-9, 4) as mfe, round({side} * (case when stopped then sl else tp end - entry) - {cost}, 5) as exact from z"""


#: A signal of all six kinds of the oldest conditions.
COMBINED, LEVELS = Combined(use_ema=True, ema_above=True, use_rsi=True, rsi_above=True, use_atr=True, atr_above=True, use_adx=True, adx_above=True, use_session=True, session_start=20, session_end=15, use_weekday=True, days=("monday", "tuesday", "wednesday", "thursday")), {"rsi": 45.0, "atr": 50.0, "adx": 5.0}


def legacy_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan(SPARK)
    return spark.sql(plan.sql("{bars}", {"signal": combined(plan, COMBINED, {"ema": 20}, **LEVELS)}), bars=hourly(spark, sf_dir))


def _combined_sql() -> str:
    plan = Plan(DUCKDB)
    x = {n: build(plan, n, length=20 if n == "ema" else 14) for n in ("ema", "rsi", "atr", "adx")}
    inner = plan.sql("bars", {f"{k}_": v for k, v in x.items()}, keys="symbol, datetime, close")
    return f"with {HOURLY_SQL} select symbol, datetime, coalesce(close > ema_ and rsi_ > 45 and atr_ > 50 and adx_ > 5, false) and (hour(datetime) >= 20 or hour(datetime) < 15) and isodow(datetime) <= 4 as signal from ({inner}) x"


def signals_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a tree and the oldest conditions agree, by series."""
    ours = _tree("tree_long")(spark, sf_dir)
    return compared(ours, legacy_combined(spark, sf_dir)).groupBy("symbol", "verdict").agg(F.count("*").alias("n"))


def _compared_sql() -> str:
    return f"select symbol, case when a.signal and b.signal then 'both' when a.signal then 'ours_only' when b.signal then 'theirs_only' else 'neither' end as verdict, count(*) as n from ({_tree_sql('tree_long')}) a join ({_combined_sql()}) b using (symbol, datetime) group by all"


def equity_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = equity_by_share(trade_list(spark, sf_dir))
    return x.select("series", "trade", *_rounded(x, "share", "equity"))


SHARE = 0.7


def split_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy on the first seven tenths of the bars and, knowing nothing of them, on the rest."""
    x = evaluate(halves(hourly(spark, sf_dir), SHARE), {"long_signal": _entry(LENGTH)}, pip=1.0).select("symbol", "bar_index", "datetime", "open", "high", "low", "long_signal")
    trades = concurrent(x, rr=RR, first=FIRST).select(F.col("symbol").alias("series"), F.col("signal_bar_index").alias("trade_number"), "entry_time", "exit_time", "profit")
    return A.run(A.SUMMARY, kept(trades)).drop("gross_profit", "gross_loss")


def _split_sql() -> str:
    c = Compiler(DUCKDB, pip=1.0)
    x = c.tree(parse(_entry(LENGTH)))
    half = "half as (select b.symbol || case when bar_index < cut then '|in' else '|out' end as symbol, timeframe, datetime, open, high, low, close, volume, case when bar_index < cut then bar_index else bar_index - cut end as bar_index from bars b join (select symbol, cast(floor((max(bar_index) + 1) * 0.7e0) as bigint) as cut from bars group by symbol) n on n.symbol = b.symbol)"
    inner = c.plan.sql("half", {"long_signal": x}, keys="symbol, bar_index, datetime, open, high, low")
    body = CONCURRENT_SQL.format(rr=RR, first=FIRST, bars="sig").strip().removeprefix("with ")
    trades = f"with {HOURLY_SQL}, {half}, sig as ({inner}), con as (with {body}), trades as (select c.symbol as series, signal_bar_index as trade_number, a.datetime as entry_time, z.datetime as exit_time, profit from con c join half a on a.symbol = c.symbol and a.bar_index = entry_bar_index join half z on z.symbol = c.symbol and z.bar_index = exit_bar_index)"
    return f"{trades} select * exclude (gross_profit, gross_loss) from ({A.SUMMARY.format(trades='trades')}) s"


def without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of ``backtest_long_rr`` chosen from all candidates by their intervals, without a pass from bar to bar."""
    every = concurrent(signalled(spark, sf_dir), rr=1.5, first=250, open_too=True)
    x = chosen(every.select(F.col("symbol").alias("series"), F.col("signal_bar_index").alias("begin"), F.col("exit_bar_index").alias("end"), "entry_bar_index", "entry_price", "exit_reason", "profit"))
    return x.where("end is not null").select(F.col("series").alias("symbol"), F.col("number").alias("trade_number"), F.col("begin").alias("signal_bar_index"), "entry_bar_index", "entry_price", F.col("end").alias("exit_bar_index"), "exit_reason", F.round(F.col("profit") + 1e-9, 4).alias("profit"))


def _single_sql(s: Strategy) -> str:
    c = Compiler(DUCKDB, pip=1.0)
    inner = c.plan.sql("bars", {k: c.tree(parse(v)) for k, v in SIGNALS.items()}, keys="symbol, bar_index, datetime, open, high, low")
    long = s.direction == "long"
    side = 1 if long else -1
    behind = f"(e.open - {side} * {s.sl_fixed_pips * s.pip_size!r})" if s.sl_basis == "fixed_pips" else "s.low" if long else "s.high"
    body = _SINGLE_SQL.format(side=side, behind=behind, against="low" if long else "high", along="high" if long else "low", worst="min" if long else "max", best="max" if long else "min", rr=s.rr, cost=s.cost, direction=s.direction, signal=f"{s.direction}_signal")
    return f"with recursive {HOURLY_SQL}, sig as ({inner}), {body}"


def _sensitivity_sql() -> str:
    trades = " union all ".join(f"select '{k}' as param, {v[k]!r} as value, exact as profit from ({_single_sql(Strategy.of(v))}) x" for k, v in search.one_at_a_time(SENSITIVE, SENSITIVE_SPACE))
    gain, loss = "sum(case when profit > 0 then profit else 0e0 end)", "sum(case when profit < 0 then -profit else 0e0 end)"
    factors = f"select param, value, round({A.factor(gain, loss)} + 1e-9, 6) as pf from ({trades}) t group by param, value"
    return f"select param, count(*) as variants_tested, min(pf) as pf_min, max(pf) as pf_max, round(coalesce(min(pf) / nullif(max(pf), 0), 0e0) * 100 + 1e-9, 6) as flatness from ({factors}) f group by param"


#: Rankings in standard SQL, from the statements of the result rows.
_RESULTS_SQL = f"""{_WALK_SQL}, fw as ({_SERIES_SCORES}), res as (select s.*, k.max_consecutive_wins, k.max_consecutive_losses, y.years_score as year_stability, y.months_score as month_stability, y.overall_score as overall_stability, fw.wf_score as walk_forward_score, profitable_years as winning_years, losing_years, years_average as avg_yearly_profit, years_worst as min_yearly_profit, profitable_months as winning_months, losing_months, months_average as avg_monthly_profit, months_worst as min_monthly_profit
from ({A.SUMMARY.format(trades="trades")}) s join ({A.STREAKS.format(trades="trades")}) k on k.series = s.series join ({A.stability_report("week", "day").format(trades="trades")}) y on y.series = s.series join fw on fw.series = s.series)"""


def _ranking_sql() -> str:
    norm = lambda c, down: f"case when max({c}) over () = min({c}) over () then 1e0 else {f'(max({c}) over () - {c})' if down else f'({c} - min({c}) over ())'} / (max({c}) over () - min({c}) over ()) end"
    score = " + ".join(f"{w!r} * {norm(k, k == 'max_dd')}" for k, w in R.WEIGHTS.items())
    return f"{_trades_sql()}, {_RESULTS_SQL}, p as (select * from res where trades >= 20 and profit_factor >= 0.1 and max_dd <= 1000000 and win_rate >= 10), q as (select *, round({score} + 1e-9, 6) as rank_score from p) select series, rank_score, row_number() over (order by rank_score desc, profit_factor desc, net_profit desc, year_stability desc, month_stability desc, win_rate desc, series) as rank from q"


def _ten_sql() -> str:
    parts = [f"select '{n}' as ranking, row_number() over (order by {', '.join(k[1:] + ' desc' if k[0] == '-' else k for k in o.split())}, series) as rank, series from res" for n, o in R.RANKINGS.items()]
    return f"{_trades_sql()}, {_RESULTS_SQL} {' union all '.join(parts)}"


_COMPOSITE_SQL = """select count(*) as trades, count(distinct series) as series_merged, round(sum(profit) + 1e-9, 6) as net_profit, round(case when sum(case when profit < 0 then -profit else 0 end) > 0 then sum(case when profit > 0 then profit else 0 end) / sum(case when profit < 0 then -profit else 0 end) when max(profit) > 0 then 999.0 else 0 end + 1e-9, 6) as profit_factor, round(max(greatest(high, 0) - equity) + 1e-9, 6) as max_dd from (
select *, max(equity) over (order by exit_time, series, trade_number rows between unbounded preceding and current row) as high from (select *, sum(profit) over (order by exit_time, series, trade_number rows between unbounded preceding and current row) as equity from trades) e) h"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _tree(n) for n in TREES}
    out["tree_multi_timeframe"] = lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), {"signal": MULTI}, pip=1.0).select("symbol", "datetime", "signal")
    out["tree_patterns"] = lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), {"signal": PATTERN_TREE}, pip=1.0).select("symbol", "datetime", "signal")
    out |= {"legacy_signals": legacy_signals, "legacy_signals_kernels": lambda spark, sf_dir: legacy_signals(spark, sf_dir, True), "legacy_candidate": legacy_candidate}
    out |= {"backtest_strategies": backtest_strategies, "backtest_concurrent": concurrent_trades}
    out |= {n: _analysis(n) for n in _statements("spark")}
    out["analysis_reranking"] = lambda spark, sf_dir: ranked(A.run(A.RERANKING.format(least=5, trades="{trades}"), trade_list(spark, sf_dir)), F.col("score").desc(), F.col("series")).select("series", "score", F.col("rank").cast("long").alias("rank"))
    out["analysis_sensitivity"] = sensitivity
    out["analysis_sensitivity_rating"] = lambda spark, sf_dir: R.sensitivity_rating(sensitivity(spark, sf_dir))
    out |= {n: single(n) for n in SINGLE}
    out["trades_without_overlap"] = without_overlap
    out |= {"legacy_combined": legacy_combined, "signals_compared": signals_compared, "equity_compared": equity_compared, "analysis_split_bars": split_bars}
    out["analysis_ranking"] = lambda spark, sf_dir: R.weighted(results(spark, sf_dir), THRESHOLDS).select("series", "rank_score", F.col("rank").cast("long").alias("rank"))
    out["analysis_ten_rankings"] = lambda spark, sf_dir: R.ten_rankings(results(spark, sf_dir))
    out["analysis_composite"] = lambda spark, sf_dir: R.composite(trade_list(spark, sf_dir))
    out["analysis_composite_monte_carlo"] = composite_monte_carlo
    out["analysis_exclusions"] = reranked
    out |= {"analysis_reranking_weights": reranked_by_all, "analysis_confidence": confidence, "analysis_sensitivity_series": sensitivity_by_series}
    out |= {"analysis_walk_forward": walk_forward_tests, "walk_forward_summary": walk_forward_summary, "walk_forward_scores": walk_forward_scores}
    out["analysis_walk_forward_rating"] = lambda spark, sf_dir: R.overall(R.judged(proven(trade_list(spark, sf_dir), WALK, top=3), MOST_DD))
    out["walk_forward_fit"] = walk_forward_fit
    out["walk_forward_rating"] = lambda spark, sf_dir: R.overall(walk_forward_fit(spark, sf_dir))
    out["search_grid"] = lambda spark, sf_dir: search.grid_table(spark, SPACE)
    return out


def oracle_sql() -> dict[str, str]:
    out = {n: _tree_sql(n) for n in TREES}
    out["tree_multi_timeframe"] = MULTI_SQL
    plan = Plan(DUCKDB)
    x = _signals(plan, False)
    out["legacy_signals"] = f"with {HOURLY_SQL} {plan.sql('bars', x)}"
    out["legacy_candidate"] = _candidate_sql()
    out["backtest_concurrent"] = _concurrent_sql()
    out |= {n: _analysis_sql(n) for n in _statements("duckdb")}
    out |= {n: f"select * exclude (exact) from ({_single_sql(s)}) x" for n, s in SINGLE.items()}
    out["analysis_reranking"] = f"{_trades_sql()} select series, score, row_number() over (order by score desc, series) as rank from ({A.RERANKING.format(least=5, trades='trades')}) r"
    out |= {"legacy_combined": _combined_sql(), "signals_compared": _compared_sql(), "analysis_split_bars": _split_sql()}
    out["equity_compared"] = f"{_trades_sql()} select series, k as trade, round(case when n > 1 then 1e2 * (k - 1) / (n - 1) else 0e0 end + 1e-9, 6) as share, round(equity + 1e-9, 6) as equity from (select series, row_number() over w as k, count(*) over (partition by series) as n, sum(profit) over w as equity from trades window w as (partition by series order by exit_time, trade_number)) x"
    out["trades_without_overlap"] = f"select symbol, trade_number, signal_bar_index, entry_bar_index, entry_price, exit_bar_index, exit_reason, profit from ({_single_sql(SINGLE['backtest_long_rr'])}) x"
    out["analysis_sensitivity"] = _sensitivity_sql()
    out["analysis_sensitivity_rating"] = f"select score, case when score >= 80 then 'A' when score >= 65 then 'B' when score >= 50 then 'C' else 'D' end as rating from (select round(avg(flatness) + 1e-9, 2) as score from ({_sensitivity_sql()}) s) r"
    kernels = Plan(DUCKDB)
    y = _signals(kernels, True)
    out["legacy_signals_kernels"] = f"with recursive {HOURLY_SQL}, {KERNEL_SQL} {kernels.sql('kbars', y)}"
    out |= {"analysis_ranking": _ranking_sql(), "analysis_ten_rankings": _ten_sql(), "analysis_composite": f"{_trades_sql()} {_COMPOSITE_SQL}"}
    merged = _MERGED.replace("{concat}", "concat(series, '/', trade_number)").format(trades="trades")
    out["analysis_composite_monte_carlo"] = f"{_trades_sql()}, merged as ({merged}) {_statements('duckdb')['analysis_monte_carlo'].format(trades='merged')}"
    out["analysis_exclusions"] = f"{_trades_sql()}, {_RESULTS_SQL}, q as (select series, round(profit_factor * 10 + win_rate * 0.5 + max_consecutive_wins * 5 - max_dd * 0.01 + 1e-9, 6) as score from res where not (trades < 20 or max_consecutive_losses > 12 or win_rate < 30)) select series, score, row_number() over (order by score desc, series) as rank from q"
    out["analysis_reranking_weights"] = f"{_trades_sql()}, {_RESULTS_SQL}, q as (select series, round({_EIGHTEEN} + 1e-9, 6) as new_score from res where trades >= 20 and net_profit >= -100000 and profit_factor >= 0.5 and year_stability >= 1 and month_stability >= 1 and max_dd <= 100000 and win_rate >= 10 and expected_value >= -100 and max_consecutive_losses <= 40) select series, new_score, row_number() over (order by new_score desc, series) as rank from q"
    out |= {"analysis_confidence": _confidence_sql(), "analysis_sensitivity_series": _series_sensitivity_sql()}
    out["analysis_walk_forward"] = f"{_trades_sql()}, {_WALK_SQL} {_TESTS_SQL}"
    out["walk_forward_summary"] = f"{_trades_sql()}, {_WALK_SQL} " + _wf_score_sql(f"select count(*) as total_windows, {_WF_SUMS} from wp where rank = 1")
    out["walk_forward_scores"] = f"{_trades_sql()}, {_WALK_SQL} {_SERIES_SCORES}"
    out["analysis_walk_forward_rating"] = f"{_trades_sql()}, {_WALK_SQL} {_OVERALL_SQL}"
    rows = {k: ", ".join(f"({i}, '{v}')" for i, v in enumerate(vs)) for k, vs in SPACE.items()}
    tables = " cross join ".join(f"(values {r}) as d_{k}(i_{k}, {k})" for k, r in rows.items())
    out["search_grid"] = f"select cast(i_rr * 6 + i_breakout_bars * 2 + i_ema_length as bigint) as param_id, rr, breakout_bars, ema_length from {tables}"
    return out
