"""Result rows of strategies: their metrics, weighted and sorted rankings, exclusions, and what walk-forward rows amount to."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candleforge.operators import analysis as A
from candleforge.operators.ordering import kept, ranked, running_equity
from candleforge.operators.walk_forward import Windows, scores

#: Fixed weights of the metrics of a ranking; ``max_dd`` counts downwards.
WEIGHTS = {"profit_factor": 30.0, "net_profit": 20.0, "max_dd": 15.0, "win_rate": 10.0, "expected_value": 10.0, "year_stability": 10.0, "month_stability": 5.0, "walk_forward_score": 20.0}


@dataclass(frozen=True)
class Thresholds:
    """What a result needs to be ranked; ``max_dd`` is a most, all others are leasts."""

    trades: float = 0.0
    profit_factor: float = 0.0
    net_profit: float = -float("inf")
    max_dd: float = float("inf")
    win_rate: float = 0.0
    expected_value: float = -float("inf")
    year_stability: float = 0.0
    month_stability: float = 0.0
    walk_forward_score: float = 0.0

    def passed(self) -> Column:
        tests = [F.col(f.name) <= getattr(self, f.name) if f.name == "max_dd" else F.col(f.name) >= getattr(self, f.name) for f in fields(self)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


#: Sort orders of the ten rankings; a minus is for descending.
RANKINGS = {
    "total": "-profit_factor -overall_stability -net_profit max_dd -trades",
    "pf": "-profit_factor -overall_stability -net_profit max_dd",
    "dd": "max_dd -profit_factor -overall_stability -net_profit",
    "win_rate": "-win_rate -profit_factor -overall_stability -net_profit",
    "profit": "-net_profit -profit_factor -overall_stability max_dd",
    "expected_value": "-expected_value -profit_factor -overall_stability -net_profit",
    "yearly_stability": "-year_stability -profit_factor -net_profit max_dd",
    "monthly_stability": "-month_stability -profit_factor -net_profit max_dd",
    "overall_stability": "-overall_stability -profit_factor -net_profit max_dd",
    "recovery_factor": "-recovery_factor -profit_factor -overall_stability -net_profit",
}


def metrics(trades: DataFrame, year: str = "year", month: str = "month", windows: Windows | None = None) -> DataFrame:
    """A row a series: the summary, the longest streaks, how the profits of ``year`` and ``month`` (any calendar unit) are spread, and the walk-forward score.

    Both stabilities make the overall one, six tenths and four. The trades are evaluated once.
    """
    trades = kept(trades)
    spread = A.run(A.stability_report(year, month), trades)
    columns = [F.col(c).alias(n) for c, n in {"years_score": "year_stability", "months_score": "month_stability", "overall_score": "overall_stability", "profitable_years": "winning_years", "losing_years": "losing_years", "years_average": "avg_yearly_profit", "years_worst": "min_yearly_profit", "profitable_months": "winning_months", "losing_months": "losing_months", "months_average": "avg_monthly_profit", "months_worst": "min_monthly_profit"}.items()]
    walked = scores(trades, windows or Windows()).select("series", F.col("wf_score").alias("walk_forward_score"))
    return A.run(A.SUMMARY, trades).join(A.run(A.STREAKS, trades), "series").join(spread.select("series", *columns), "series").join(walked, "series")


@dataclass(frozen=True)
class Weights:
    """Fixed default weights of a re-ranking; drawdown, losing periods and losing streaks count downwards."""

    profit_factor: float = 1000.0
    net_profit: float = 2.0
    expected_value: float = 10000.0
    win_rate: float = 10.0
    max_dd: float = 50.0
    trades: float = 0.0
    year_stability: float = 20.0
    winning_years: float = 30.0
    losing_years: float = 50.0
    avg_yearly_profit: float = 5.0
    min_yearly_profit: float = 5.0
    month_stability: float = 20.0
    winning_months: float = 2.0
    losing_months: float = 2.0
    avg_monthly_profit: float = 10.0
    min_monthly_profit: float = 10.0
    max_consecutive_wins: float = 0.0
    max_consecutive_losses: float = 20.0

    def score(self, columns: list[str]) -> Column:
        """The weighted sum; a column that ``columns`` lacks, or null, counts as 0."""
        down = {"max_dd", "losing_years", "losing_months", "max_consecutive_losses"}
        terms = [F.coalesce(F.col(f.name).cast("double"), F.lit(0.0)) * (-getattr(self, f.name) if f.name in down else getattr(self, f.name)) for f in fields(self) if f.name in columns]
        return sum(terms, F.lit(0.0))


def reranked(results: DataFrame, weights: Weights | None = None, exclusions: Exclusions | None = None) -> DataFrame:
    """``results`` that no exclusion hits with ``new_score`` and ``rank``, the best first, ties by series."""
    rest = results if exclusions is None else results.where(~exclusions.excluded(results.columns))
    rest = rest.withColumn("new_score", F.round((weights or Weights()).score(results.columns) + 1e-9, 6))
    return ranked(rest, F.col("new_score").desc(), F.col("series"))


def weighted(results: DataFrame, thresholds: Thresholds | None = None, weights: Mapping[str, float] = WEIGHTS, top: int | None = None) -> DataFrame:
    """``results`` that pass, with ``rank_score`` and ``rank``: each metric scaled to 0..1 over them (1 if all are equal), weighted, the best first."""
    passed = results.where((thresholds or Thresholds()).passed())
    ends = passed.agg(*[f(k).alias(f"{k}_{n}") for k in weights for n, f in (("lo", F.min), ("hi", F.max))])
    score = F.lit(0.0)
    for k, w in weights.items():
        lo, hi = F.col(f"{k}_lo"), F.col(f"{k}_hi")
        place = F.when(hi == lo, F.lit(1.0)).otherwise(((hi - F.col(k)) if k == "max_dd" else (F.col(k) - lo)) / (hi - lo))
        score = score + place * w
    scored = passed.crossJoin(F.broadcast(ends)).withColumn("rank_score", F.round(score + 1e-9, 6)).drop(*ends.columns)  # a single row
    order = [F.col(c).desc() for c in ("rank_score", "profit_factor", "net_profit", "year_stability", "month_stability", "win_rate")]
    out = ranked(scored, *order, F.col("series"))
    return out if top is None else out.where(F.col("rank") <= top)


def ten_rankings(results: DataFrame) -> DataFrame:
    """``ranking, rank, series``: the results in each of the ten orders, ties by series."""
    results, out = kept(results), None
    for name, order in RANKINGS.items():
        keys = [F.col(k[1:]).desc() if k[0] == "-" else F.col(k) for k in order.split()]
        one = ranked(results, *keys, F.col("series")).select(F.lit(name).alias("ranking"), F.col("rank").cast("long").alias("rank"), "series")
        out = one if out is None else out.union(one)
    return out


@dataclass(frozen=True)
class Exclusions:
    """Twelve reasons to leave a result out of a re-ranking."""

    minimum_trades: float = 0.0
    minimum_profit: float = -float("inf")
    minimum_pf: float = 0.0
    minimum_yearly_stability: float = 0.0
    minimum_monthly_stability: float = 0.0
    maximum_drawdown: float = float("inf")
    minimum_win_rate: float = 0.0
    minimum_average_profit: float = -float("inf")
    maximum_consecutive_losses: float = float("inf")
    exclude_long: bool = False
    exclude_short: bool = False
    only_session: str = ""

    def excluded(self, columns: list[str]) -> Column:
        """True for excluded rows; a column that ``columns`` lacks counts as 0 or empty."""
        number = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in columns else F.lit(0.0)
        text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in columns else F.lit("")
        leasts = {"trades": self.minimum_trades, "net_profit": self.minimum_profit, "profit_factor": self.minimum_pf, "year_stability": self.minimum_yearly_stability, "month_stability": self.minimum_monthly_stability, "win_rate": self.minimum_win_rate, "expected_value": self.minimum_average_profit}
        mosts = {"max_dd": self.maximum_drawdown, "max_consecutive_losses": self.maximum_consecutive_losses}
        out = F.lit(False)
        for c, v in leasts.items():
            out = out | (number(c) < v)
        for c, v in mosts.items():
            out = out | (number(c) > v)
        for side, excluded in (("long", self.exclude_long), ("short", self.exclude_short)):
            out = out | (F.lit(excluded) & (text("direction") == side))
        return out | (F.lit(self.only_session != "") & (text("session_name") != self.only_session))


def judged(rows: DataFrame, most_dd: float = 5.0) -> DataFrame:
    """Walk-forward ``rows`` with ``judgement`` of each test: NO_TRADE, PASS, CAUTION or FAIL."""
    good = (F.col("test_net_profit") > 0) & (F.col("test_profit_factor") >= 1.2) & (F.col("test_max_dd") <= most_dd)
    return rows.withColumn("judgement", F.when(F.col("test_trades") <= 0, "NO_TRADE").when(good, "PASS").when(F.col("test_net_profit") > 0, "CAUTION").otherwise("FAIL"))


def overall(rows: DataFrame) -> DataFrame:
    """One row for judged walk-forward ``rows``: share of passes, means over the tests with trades, profit, losing tests and rating A to D.

    The mean factor also leaves out tests without a loss, whose factor stands for infinity.
    """
    valid = F.col("test_trades") > 0
    mean = lambda c, test: F.coalesce(F.avg(F.when(test, F.col(c))), F.lit(0.0))
    x = rows.agg(
        F.count("*").alias("tests"), F.count(F.when(valid, 1)).alias("valid_tests"), F.coalesce(100 * F.try_divide(F.count(F.when(F.col("judgement") == "PASS", 1)), F.count("*")), F.lit(0.0)).alias("pass_rate"),
        mean("test_profit_factor", valid & (F.col("test_profit_factor") < A.NO_LOSS)).alias("avg_pf"), (mean("test_win_rate", valid) if "test_win_rate" in rows.columns else F.lit(0.0)).alias("avg_win_rate"), F.coalesce(F.sum("test_net_profit"), F.lit(0.0)).alias("total_profit"), F.coalesce(F.max("test_max_dd"), F.lit(0.0)).alias("max_dd"), F.count(F.when(F.col("test_net_profit") < 0, 1)).alias("negative_tests"),
    )
    rating = A.walk_forward_grade("pass_rate", "avg_pf", "total_profit", "negative_tests").alias("rating")
    return x.select("tests", "valid_tests", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("pass_rate", "avg_pf", "avg_win_rate", "total_profit", "max_dd")], "negative_tests", rating)


def flatness(results: DataFrame, *by: str) -> DataFrame:
    """``pf_min, pf_max, flatness`` of the profit factors of the variants of each parameter (and of each of ``by``), base value included; 0 without profits."""
    out = results.groupBy(*by, "param").agg(F.count("*").alias("variants_tested"), F.min("profit_factor").alias("pf_min"), F.max("profit_factor").alias("pf_max"))
    return out.withColumn("flatness", F.round(F.when(F.col("pf_max") > 0, F.col("pf_min") / F.col("pf_max")).otherwise(0.0) * 100 + 1e-9, 6))


def sensitivity_rating(flat: DataFrame, *by: str) -> DataFrame:
    """``score, rating`` of how flat results stay over all parameters of ``flat`` (of each of ``by``)."""
    x = flat.groupBy(*by).agg(F.coalesce(F.round(F.avg("flatness") + 1e-9, 2), F.lit(0.0)).alias("score"))
    return x.select(*by, "score", A.flat_grade(F.col("score")).alias("rating"))


def composite(trades: DataFrame) -> DataFrame:
    """One row for all series merged by exit time; the peak begins at 0."""
    x = running_equity(trades, F.col("exit_time"), F.col("series"), F.col("trade_number"))
    gain, loss = F.sum(F.greatest("profit", F.lit(0.0))), F.sum(F.greatest(-F.col("profit"), F.lit(0.0)))
    x = x.agg(F.count("*").alias("trades"), F.count_distinct("series").alias("series_merged"), F.sum("profit").alias("net"), gain.alias("gain"), loss.alias("loss"), F.max(F.greatest("high", F.lit(0.0)) - F.col("equity")).alias("dd"))
    factor = F.when(F.col("loss") > 0, F.try_divide("gain", "loss")).when(F.col("gain") > 0, A.NO_LOSS).otherwise(0.0)
    return x.select("trades", "series_merged", F.round(F.col("net") + 1e-9, 6).alias("net_profit"), F.round(factor + 1e-9, 6).alias("profit_factor"), F.round(F.col("dd") + 1e-9, 6).alias("max_dd"))
