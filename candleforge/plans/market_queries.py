"""The market queries by name, and the same over standard SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions import candles, derived, indicators  # noqa: F401  (they register)
from candleforge.functions.compiler import DUCKDB, SPARK, Dialect, Plan
from candleforge.functions.indicators import REGISTRY, build
from candleforge.operators import bars as B
from candleforge.operators import patterns, slices, tails

#: Fixed families of the registry, a query each.
FAMILIES: dict[str, list[str]] = {
    "ind_price_time": "open high low close hour weekday month candle_body killzone_asian dist_to_round_number highest_high lowest_low highest_close lowest_close donchian_mid donchian_percent_position fib_level dist_to_fib".split(),
    "ind_zones": "killzone_london killzone_newyork killzone_london_close minutes_since_london_open minutes_since_ny_open".split(),
    "ind_bands": "sma bollinger_upper bollinger_middle bollinger_lower bb_percent_b bb_width bb_width_percent bb_squeeze bb_expansion close_rolling_std historical_volatility zscore_close rolling_mean_high rolling_mean_low".split(),
    "ind_averages": "ema macd_line macd_signal macd_histogram bull_power bear_power ema_slope ema_slope_degrees ema_roc dist_to_ema_atr_ratio dist_close_ema_pct keltner_upper keltner_middle keltner_lower".split(),
    "ind_rsi": "rsi stochastic_k stochastic_d cmo connors_rsi rsi_rolling_mean rsi_deviation percentile_rank_rsi zscore_rsi is_max_rsi_of_n rsi_divergence_bearish rsi_divergence_bullish".split(),
    "ind_atr_adx": "atr adx plus_di minus_di atr_roc atr_rolling_mean atr_deviation percentile_rank_atr zscore_atr is_min_atr_of_n adx_rolling_mean choppiness_index".split(),
    "ind_structure": "fvg_bullish fvg_bearish order_block_bullish order_block_bearish liquidity_sweep_bullish liquidity_sweep_bearish bos_bullish choch_bullish bos_bearish choch_bearish mss_bullish mss_bearish breaker_block_bullish breaker_block_bearish mitigation_block_bullish mitigation_block_bearish".split(),
    "ind_swings": "higher_high higher_low lower_high lower_low equal_high equal_low dist_bos_bullish dist_bos_bearish dist_order_block_bullish dist_order_block_bearish dist_fvg_bullish dist_fvg_bearish".split(),
    "ind_retests": "fvg_first_retest_bullish fvg_first_retest_bearish order_block_first_retest_bullish order_block_first_retest_bearish first_pullback_after_breakout_bullish first_pullback_after_breakout_bearish today_new_high today_new_low".split(),
    "ind_days": ["vwap", "prev_day_high", "prev_day_low", "prev_day_mid", "adr", "today_range_pct_of_adr", "today_range_position", *(n for n in indicators.LEVELS)],
    "ind_cloud": [n for n in REGISTRY if n.startswith("ichimoku")],
    "ind_candles_single": "bullish_candle bearish_candle large_bullish_candle large_bearish_candle small_bullish_candle small_bearish_candle doji long_upper_wick long_lower_wick no_upper_wick no_lower_wick marubozu_bullish marubozu_bearish pin_bar_bullish pin_bar_bearish hammer hanging_man inverted_hammer shooting_star long_legged_doji dragonfly_doji gravestone_doji spinning_top belt_hold_bullish belt_hold_bearish body_larger_than_average wick_ratio_at_least body_ratio_at_least".split(),
    "ind_candles_multi": "engulfing_bullish engulfing_bearish inside_bar outside_bar tweezer_top tweezer_bottom harami_bullish harami_bearish gap_up gap_down morning_star evening_star three_white_soldiers three_black_crows rising_three_methods falling_three_methods consecutive_bullish_candles consecutive_bearish_candles consecutive_higher_highs consecutive_lower_lows kicker_bullish kicker_bearish abandoned_baby_bullish abandoned_baby_bearish three_inside_up three_inside_down three_outside_up three_outside_down three_line_strike_bullish three_line_strike_bearish tasuki_gap_upside tasuki_gap_downside".split(),
    "ind_distances": [n for n in REGISTRY if n.startswith(("dist_close_", "dist_high_", "dist_low_")) and "supertrend" not in n and n != "dist_close_ema_pct"],
    "ind_slopes": [n for n in REGISTRY if n.endswith(("_rising", "_falling")) and not n.startswith("supertrend")],
    "ind_bodies": "avg_body_size max_body_size min_body_size body_size_std avg_upper_wick avg_lower_wick percentile_rank_body is_max_body_of_n nr4 nr7".split(),
    "ind_orders": [n for n in REGISTRY if n.startswith("ema_perfect_order")] + ["macd_divergence_bearish", "macd_divergence_bullish", "macd_rolling_mean"],
    "ind_volume": "obv mfi cmf ad_line chaikin_oscillator volume_climax_bullish volume_climax_bearish".split(),
    "ind_oscillators": "cci williams_r aroon_up aroon_down aroon_oscillator coppock_curve ttm_squeeze ttm_squeeze_release correlation_close_ema correlation_oscillator".split(),
    "ind_regression": "linreg_slope_atr_ratio linreg_angle_degrees linreg_value linreg_upper linreg_lower ha_bullish ha_bearish ha_strong_bullish ha_strong_bearish".split(),
}
#: Columns of the stateful kernels.
KERNEL_FAMILY = "supertrend_line supertrend_direction supertrend_flip_bullish supertrend_flip_bearish supertrend_rising supertrend_falling supertrend_consecutive_rising supertrend_consecutive_falling dist_close_supertrend dist_high_supertrend dist_low_supertrend parabolic_sar_line parabolic_sar_direction".split()

HOURLY_SQL = """bars as (
select symbol, '1h' as timeframe, datetime, open, high, low, close, volume, row_number() over (partition by symbol order by datetime) - 1 as bar_index
from (select event_type as symbol, date_trunc('hour', ts) as datetime, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, cast(count(*) as double) as volume
from events where ts is not null and value is not null group by 1, 2) b)"""

#: Supertrend and parabolic stop by recursion over the bars, one definition apart from the kernels: a state a series and bar.
KERNEL_SQL = """x as (select symbol, bar_index as i, high as h, low as l, close as c, lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl, coalesce(lag(high, 2) over w, lag(high) over w) as pph, coalesce(lag(low, 2) over w, lag(low) over w) as ppl from bars window w as (partition by symbol order by bar_index)),
state as (select symbol, i, h - l as atr, (h + l) / 2 + 3 * (h - l) as top, (h + l) / 2 - 3 * (h - l) as bottom, -1 as way, true as up, l as stop, h as best, 0.02e0 as af from x where i = 0
union all select symbol, i, atr, case when a < top or pc > top then a else top end, case when b > bottom or pc < bottom then b else bottom end,
  case when way < 0 and c > top then 1 when way > 0 and c < bottom then -1 else way end,
  case when turned then not up else up end, case when turned then best else held end, case when turned then (case when up then l else h end) when further then (case when up then h else l end) else best end,
  case when turned then 0.02e0 when further then least(af + 0.02e0, 0.2e0) else af end
from (select *, (h + l) / 2 + 3 * atr as a, (h + l) / 2 - 3 * atr as b, case when up then l < held else h > held end as turned, case when up then h > best else l < best end as further
from (select x.symbol, x.i, h, l, c, pc, way, up, best, af, top, bottom, atr + (greatest(h - l, abs(h - pc), abs(l - pc)) - atr) / 10 as atr, case when up then least(stop + af * (best - stop), pl, ppl) else greatest(stop + af * (best - stop), ph, pph) end as held
from state join x on x.symbol = state.symbol and x.i = state.i + 1) y) z),
kbars as (select b.*, case when way > 0 then bottom else top end as supertrend_10_3_0_line, cast(way as double) as supertrend_10_3_0_direction, stop as sar_0_02_0_02_0_2_line, case when up then 1e0 else -1e0 end as sar_0_02_0_02_0_2_direction from bars b join state s on s.symbol = b.symbol and s.i = b.bar_index)"""


def family_plan(names: list[str], dialect: Dialect) -> tuple[Plan, dict[str, str]]:
    plan = Plan(dialect)
    return plan, {f"v_{n}" if n in ("open", "high", "low", "close", "hour", "month", "weekday") else n: f"round({build(plan, n)} + 1e-9, 6)" for n in names}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "1h")


def evaluate(bars: DataFrame, names: list[str]) -> DataFrame:
    """The named indicators with default parameters, rounded (off ties, for comparison), on each bar."""
    from candleforge.operators.kernels import with_kernels

    plan, outputs = family_plan(names, SPARK)
    return bars.sparkSession.sql(plan.sql("{bars}", outputs), bars=with_kernels(bars, " ".join([*outputs.values(), *plan.made])))


def _family(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: evaluate(hourly(spark, sf_dir), names)


def _family_sql(names: list[str]) -> str:
    plan, outputs = family_plan(names, DUCKDB)
    return f"with {HOURLY_SQL} {plan.sql('bars', outputs)}"


#: Indicators of one long series in slices: with windows that end, and all kinds of those that don't.
SLICED = "ema rsi atr adx macd_signal obv ad_line vwap adr prev_day_high bollinger_upper percentile_rank_rsi connors_rsi bos_bullish choch_bearish breaker_block_bullish fvg_first_retest_bullish higher_high".split()
#: Indicators of a chart's last bars.
CHART = {"ema_20": ("ema", {"length": 20}), "rsi_14": ("rsi", {}), "upper": ("bollinger_upper", {}), "slow": ("stochastic_d", {}), "day_vwap": ("vwap", {}), "hammer": ("hammer", {}), "gap": ("fvg_bullish", {})}
ALL_SQL = HOURLY_SQL.replace("event_type as symbol", "'ALL' as symbol").replace("date_trunc('hour', ts)", "time_bucket(interval 15 minute, ts)").replace("'1h'", "'15m'")


def sliced_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of all ticks as one series, cut into eight slices."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_type", F.lit("ALL"))
    bars = B.from_ticks(ticks, "15m", index=slices.indexed_in_ranges)
    return slices.evaluate(bars, lambda plan: {n: f"round({build(plan, n)} + 1e-9, 5)" for n in SLICED}, 8)


def chart_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 48 bars of each series with a chart's indicators, of which only as many earlier bars are read as they need."""
    return tails.tail(hourly(spark, sf_dir), 48, lambda plan: {n: f"round({build(plan, i, **p)} + 1e-9, 6)" for n, (i, p) in CHART.items()})


def _tail_sql() -> str:
    plan = Plan(DUCKDB)
    outputs = {n: f"round({build(plan, i, **p)} + 1e-9, 6)" for n, (i, p) in CHART.items()}
    return f"with {HOURLY_SQL} select * exclude (bar_index) from ({plan.sql('bars', outputs, keys='symbol, datetime, bar_index')}) x where bar_index > (select max(bar_index) - 48 from bars b where b.symbol = x.symbol)"


def _sliced_sql() -> str:
    plan = Plan(DUCKDB)
    return f"with {ALL_SQL} {plan.sql('bars', {n: f'round({build(plan, n)} + 1e-9, 5)' for n in SLICED})}"


def _resampled(timeframe: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: B.resample(hourly(spark, sf_dir), timeframe).drop("timeframe", "bar_index")


_BUCKETS = {"4h": "date_trunc('day', datetime) + interval 4 hour * cast(floor(extract(hour from datetime) / 4) as bigint)", "1d": "date_trunc('day', datetime)", "1w": "cast(date_trunc('week', datetime) as timestamp) + interval 6 day", "1mo": "date_trunc('month', datetime)"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"bars_hourly": lambda spark, sf_dir: hourly(spark, sf_dir).drop("timeframe")}
    out |= {f"resample_{t}": _resampled(t) for t in _BUCKETS}
    out |= {"bars_check": lambda spark, sf_dir: B.checked(hourly(spark, sf_dir)).drop("timeframe")}
    out["bars_30m"] = lambda spark, sf_dir: B.from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "30m").drop("timeframe")
    out["bars_faults"] = lambda spark, sf_dir: B.faults(hourly(spark, sf_dir), gap=1.0).drop("timeframe")
    out |= {k: _family(v) for k, v in FAMILIES.items()}
    out["ind_kernels"] = _family(KERNEL_FAMILY)
    out |= {"ind_sliced_all": sliced_all, "chart_tail": chart_tail}
    out["chart_marks"] = lambda spark, sf_dir: tails.marks(hourly(spark, sf_dir), 100).drop("timeframe")
    out["chart_patterns"] = lambda spark, sf_dir: patterns.detect(hourly(spark, sf_dir))
    return out


def oracle_sql() -> dict[str, str]:
    out = {"bars_hourly": f"with {HOURLY_SQL} select symbol, datetime, open, high, low, close, volume, bar_index from bars"}
    for t, x in _BUCKETS.items():
        out[f"resample_{t}"] = f"with {HOURLY_SQL} select symbol, cast({x} as timestamp) as datetime, first(open order by datetime) as open, max(high) as high, min(low) as low, last(close order by datetime) as close, sum(volume) as volume from bars group by 1, 2"
    out["bars_check"] = f"""with {HOURLY_SQL}, s as (select *, date_diff('minute', lag(datetime) over (partition by symbol order by datetime), datetime) as step from bars)
select symbol, count(*) as n_rows, min(datetime) as first, max(datetime) as last, count(*) filter (where step = 0) as n_repeated, count(*) filter (where high < greatest(open, close, low) or low > least(open, close)) as n_bad, count(*) filter (where step > 300) as n_gaps from s group by symbol"""
    out["bars_30m"] = """select event_type as symbol, time_bucket(interval 30 minute, ts) as datetime, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, cast(count(*) as double) as volume,
row_number() over (partition by event_type order by time_bucket(interval 30 minute, ts)) - 1 as bar_index from events where ts is not null and value is not null group by 1, 2"""
    out["bars_faults"] = f"""with {HOURLY_SQL}, s as (select *, lag(datetime) over (partition by symbol order by datetime) as before from bars), t as (select *, date_diff('minute', before, datetime) as minutes from s)
select symbol, 'gap' as fault, datetime, before, minutes from t where minutes > 60 union all select symbol, 'repeated', datetime, before, minutes from t where minutes = 0 union all select symbol, 'prices', datetime, before, minutes from t where high < greatest(open, close, low) or low > least(open, close)"""
    out |= {k: _family_sql(v) for k, v in FAMILIES.items()}
    out |= {"ind_sliced_all": _sliced_sql(), "chart_tail": _tail_sql()}
    plan, outputs = family_plan(KERNEL_FAMILY, DUCKDB)
    out["ind_kernels"] = f"with recursive {HOURLY_SQL}, {KERNEL_SQL} {plan.sql('kbars', outputs)}"
    return out
