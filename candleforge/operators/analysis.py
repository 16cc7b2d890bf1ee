"""Analysis of trades, as SQL over ``{trades}(series, trade_number, entry_time, exit_time, profit)``.

``series`` names what is analysed together: a strategy, or a strategy on a symbol. The
statements run on Spark and on any engine with standard windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No loss at all counts as this factor.
NO_LOSS = 999.0


def factor(gain: str, loss: str) -> str:
    return f"case when {loss} > 0 then {gain} / nullif({loss}, 0) when {gain} > 0 then {NO_LOSS} else 0.0 end"


_GAIN, _LOSS = "sum(case when profit > 0 then profit else 0.0 end)", "sum(case when profit < 0 then -profit else 0.0 end)"
_COUNTS = f"count(*) as trades, sum(case when profit > 0 then 1 else 0 end) as wins, sum(case when profit < 0 then 1 else 0 end) as losses, {_GAIN} as gross_profit, {_LOSS} as gross_loss, sum(profit) as net_profit"
EQUITY = """select series, trade_number, exit_time, profit, equity, high as equity_high, high - equity as drawdown from (
select *, max(equity) over (partition by series order by exit_time, trade_number rows between unbounded preceding and current row) as high from (
select series, trade_number, exit_time, profit, sum(profit) over (partition by series order by exit_time, trade_number rows between unbounded preceding and current row) as equity from {trades}) e) h"""


def periods(unit: str) -> str:
    """Trades by calendar unit of their entry."""
    if unit not in ("year", "month", "week", "day"):
        raise ValueError(f"unknown unit: {unit}")
    inner = f"select series, date_trunc('{unit}', entry_time) as p, {_COUNTS} from {{trades}} group by series, date_trunc('{unit}', entry_time)"
    return f"select series, cast(p as timestamp{{ntz}}) as period, trades, cast(wins as bigint) as wins, cast(losses as bigint) as losses, round(1e2 * wins / trades + 1e-9, 6) as win_rate, round(net_profit + 1e-9, 6) as net_profit, round(gross_profit + 1e-9, 6) as gross_profit, round(gross_loss + 1e-9, 6) as gross_loss, round({factor('gross_profit', 'gross_loss')} + 1e-9, 6) as profit_factor from ({inner}) a"


#: One row a series.
SUMMARY = f"""select a.series, trades, cast(wins as bigint) as wins, cast(losses as bigint) as losses, round(1e2 * wins / trades + 1e-9, 6) as win_rate, round(net_profit + 1e-9, 6) as net_profit, round(gross_profit + 1e-9, 6) as gross_profit, round(gross_loss + 1e-9, 6) as gross_loss,
round({factor('gross_profit', 'gross_loss')} + 1e-9, 6) as profit_factor, round(max_dd + 1e-9, 6) as max_dd, round(net_profit / trades + 1e-9, 6) as expected_value, round({factor('net_profit', 'max_dd')} + 1e-9, 6) as recovery_factor
from (select series, {_COUNTS} from {{trades}} group by series) a join (select series, max(drawdown) as max_dd from ({EQUITY}) e group by series) d on a.series = d.series"""

#: Longest runs of wins and of losses, by the difference of two row numbers.
STREAKS = """select series, coalesce(max(case when won = 1 then n end), 0) as max_consecutive_wins, coalesce(max(case when won = 0 then n end), 0) as max_consecutive_losses from (
select series, won, count(*) as n from (select series, won, row_number() over (partition by series order by exit_time, trade_number) - row_number() over (partition by series, won order by exit_time, trade_number) as island
from (select series, exit_time, trade_number, case when profit > 0 then 1 else 0 end as won from {trades}) t) i group by series, won, island) r group by series"""

#: Ratios of the returns of periods; ``{per_year}`` periods a year.
RATIOS = """select series, round(coalesce(case when sd > 0 then mean / nullif(sd, 0) * sqrt({per_year}) end, 0e0) + 1e-9, 6) as sharpe_ratio, round(coalesce(case when below >= 2 and down > 0 then mean / nullif(down, 0) * sqrt({per_year}) end, 0e0) + 1e-9, 6) as sortino_ratio,
round(case when years <= 0 then 0e0 when 1e2 + net <= 0 then -1e0 else power((1e2 + net) / 1e2, 1 / years) - 1 end + 1e-9, 6) as cagr from (
select series, avg(r) as mean, stddev_samp(r) as sd, stddev_samp(case when r < 0 then r end) as down, count(case when r < 0 then 1 end) as below, sum(r) as net, max(days) / 365.25e0 as years
from (select series, date_trunc('{unit}', exit_time) as p, sum(profit) as r, max(span) as days from (select *, {days} as span from (select *, min(entry_time) over (partition by series) as first, max(exit_time) over (partition by series) as last from {trades}) w) s group by series, date_trunc('{unit}', exit_time)) g group by series) x"""

#: Score of how steady the periods are: 0 to 100, and its grade.
STABILITY = """select series, n as periods, round(score + 1e-9, 6) as score, case when score >= 80 then 'A' when score >= 65 then 'B' when score >= 50 then 'C' else 'D' end as grade from (
select series, n, greatest(0e0, least(1e2, case when mean <= 0 then rate * 0.5e0 when coalesce(sd, 0) <= 0 then 1e2 else rate * 0.7e0 + least(30 * mean / nullif(sd, 0), 30e0) end)) as score from (
select series, count(*) as n, 1e2 * sum(case when r > 0 then 1 else 0 end) / count(*) as rate, avg(r) as mean, stddev_samp(r) as sd from (select series, date_trunc('{unit}', entry_time) as p, sum(profit) as r from {trades} group by series, date_trunc('{unit}', entry_time)) g group by series) x) y"""

#: Greatest drawdowns of many orders of the trades, drawn by a hash; their quantiles and a rating.
MONTE_CARLO = """select series, round(avg(dd) + 1e-9, 6) as dd_mean, round({q50} + 1e-9, 6) as dd_median, round({q90} + 1e-9, 6) as dd_90, round({q95} + 1e-9, 6) as dd_95, round({q99} + 1e-9, 6) as dd_99, round(max(dd) + 1e-9, 6) as dd_worst, round(min(dd) + 1e-9, 6) as dd_best, count(*) as runs,
case when {q95} <= 2 then 'A' when {q95} <= 3 then 'B' when {q95} <= 4 then 'C' else 'D' end as rating from (
select series, run, max(high - equity) as dd from (select series, run, equity, max(equity) over (partition by series, run order by draw, trade_number rows between unbounded preceding and current row) as high from (
select series, run, draw, trade_number, sum(profit) over (partition by series, run order by draw, trade_number rows between unbounded preceding and current row) as equity from (
select series, run, trade_number, profit, md5(concat(cast(run as {text}), '-', cast(trade_number as {text}))) as draw from {trades} cross join (select {numbers} as run) n) d) e) h group by series, run) m group by series"""

#: The first ``{share}`` of each series' trades against the rest.
OUT_OF_SAMPLE = f"""select series, part, {{n}} as trades, round(net_profit + 1e-9, 6) as net_profit, round({factor('gross_profit', 'gross_loss')} + 1e-9, 6) as profit_factor from (
select series, case when k <= floor(n * {{share}}) then 'in' else 'out' end as part, {_COUNTS} from (select *, row_number() over (partition by series order by exit_time, trade_number) as k, count(*) over (partition by series) as n from {{trades}}) o group by series, case when k <= floor(n * {{share}}) then 'in' else 'out' end) x""".replace("{n}", "trades")


#: A linear score of the series that pass the thresholds.
RERANKING = f"""select series, round(profit_factor * 10 + win_rate * 0.5e0 + recovery_factor * 5 - max_dd * 0.01e0 + 1e-9, 6) as score from ({SUMMARY}) s where trades >= {{least}} and win_rate between 1 and 99 and profit_factor < {NO_LOSS}"""

#: The mean of grades A to D (100, 75, 50, 25) of ``{{grades}}(series, component, grade)`` and its own grade.
CONFIDENCE = """select series, components, round(score + 1e-9, 6) as score, case when score >= 87.5 then 'A' when score >= 62.5 then 'B' when score >= 37.5 then 'C' else 'D' end as grade from (
select series, count(*) as components, avg(case grade when 'A' then 1e2 when 'B' then 75e0 when 'C' then 5e1 else 25e0 end) as score from ({grades}) g group by series) x"""


_SUMS = "select series, sum(case when r > 0 then 1 else 0 end) as good, sum(case when r < 0 then 1 else 0 end) as bad, sum(case when r = 0 then 1 else 0 end) as flat, 1e2 * sum(case when r > 0 then 1 else 0 end) / count(*) as rate, avg(r) as mean, max(r) as best, min(r) as worst from (select series, date_trunc('{unit}', entry_time) as p, sum(profit) as r from {trades} group by series, date_trunc('{unit}', entry_time)) g group by series"


def stability_report(year: str, month: str) -> str:
    """How the profits of ``year`` and ``month`` units are spread, their scores, the joint score (six and four tenths) and its rating."""
    part = lambda a, n: f"cast({a}.good as bigint) as profitable_{n}, cast({a}.bad as bigint) as losing_{n}, cast({a}.flat as bigint) as flat_{n}, round({a}.rate + 1e-9, 6) as {n}_positive_rate, round({a}.mean + 1e-9, 6) as {n}_average, round({a}.best + 1e-9, 6) as {n}_best, round({a}.worst + 1e-9, 6) as {n}_worst, s{a}.score as {n}_score"
    x = f"select y.series, {part('y', 'years')}, {part('m', 'months')}, round(sy.score * 0.6e0 + sm.score * 0.4e0 + 1e-9, 6) as overall_score from ({_SUMS.replace('{unit}', year)}) y join ({_SUMS.replace('{unit}', month)}) m on m.series = y.series join ({STABILITY.replace('{unit}', year)}) sy on sy.series = y.series join ({STABILITY.replace('{unit}', month)}) sm on sm.series = y.series"
    return f"select *, case when overall_score >= 80 then 'A' when overall_score >= 65 then 'B' when overall_score >= 50 then 'C' else 'D' end as rating from ({x}) r"


#: The older summary: the peak of the drawdown begins at 0, and one score of all.
OLDER_METRICS = f"""select series, trades as total_trades, breakeven, win_rate, total_profit, gross_profit, gross_loss, profit_factor, average_profit, max_drawdown, 0e0 as sharpe_ratio,
round(least(profit_factor, case when gross_loss > 0 then profit_factor else 10 end) * 100 + average_profit * 1000 + win_rate - max_drawdown * 50 + trades * 0.1e0 + 1e-9, 4) as score from (
select a.series, trades, cast(trades - wins - losses as bigint) as breakeven, round(1e2 * wins / trades + 1e-9, 6) as win_rate, round(net_profit + 1e-9, 6) as total_profit, round(gross_profit + 1e-9, 6) as gross_profit, round(gross_loss + 1e-9, 6) as gross_loss, round({factor('gross_profit', 'gross_loss')} + 1e-9, 6) as profit_factor, round(net_profit / trades + 1e-9, 6) as average_profit, round(d.dd + 1e-9, 6) as max_drawdown
from (select series, {_COUNTS} from {{trades}} group by series) a join (select series, max(greatest(equity_high, 0) - equity) as dd from ({EQUITY}) e group by series) d on d.series = a.series) x"""

#: Yearly growth against the greatest drawdown, both of a capital of 100.
CALMAR = f"select r.series, r.cagr, s.max_dd, round(case when s.max_dd > 0 then r.cagr / nullif(s.max_dd / 1e2, 0) else 0e0 end + 1e-9, 6) as calmar_ratio from ({RATIOS}) r join ({SUMMARY}) s on s.series = r.series"


def rated(tests: DataFrame) -> DataFrame:
    """``series, grade`` of judged walk-forward ``tests`` of each series: by the share of passes, the mean factor, the profit and the losing tests.

    The mean leaves out tests without trades and without a loss.
    """
    known = F.when((F.col("test_trades") > 0) & (F.col("test_profit_factor") < NO_LOSS), F.col("test_profit_factor"))
    passes, losing = F.count(F.when(F.col("judgement") == "PASS", 1)), F.count(F.when(F.col("test_net_profit") < 0, 1))
    x = tests.groupBy("series").agg((100 * passes / F.count("*")).alias("passed"), F.coalesce(F.avg(known), F.lit(0.0)).alias("pf"), F.sum("test_net_profit").alias("profit"), losing.alias("negative"))
    return x.select("series", walk_forward_grade("passed", "pf", "profit", "negative").alias("grade"))


def walk_forward_grade(passed: str, factor: str, profit: str, losing: str) -> Column:
    gain = F.col(profit) > 0
    return F.when((F.col(passed) >= 70) & (F.col(factor) >= 1.5) & gain & (F.col(losing) <= 4), "A").when((F.col(passed) >= 55) & (F.col(factor) >= 1.2) & gain, "B").when((F.col(passed) >= 40) & gain, "C").otherwise("D")


def flat_grade(score: Column) -> Column:
    """The grade of a flatness from 0 to 100."""
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")


def confidence(**components: DataFrame) -> DataFrame:
    """``series, components, score, grade`` of components with ``series, grade``; a series counts those that it has."""
    rows = None
    for name, x in components.items():
        x = x.select("series", F.lit(name).alias("component"), "grade")
        rows = x if rows is None else rows.union(x)
    return rows.sparkSession.sql(CONFIDENCE.format(grades="select * from {grades}"), grades=rows)


def run(statement: str, trades: DataFrame) -> DataFrame:
    """A statement of this module on Spark."""
    return trades.sparkSession.sql(statement, trades=trades)
