"""Backtests: a pass over one series and strategy, and the relational form for concurrent positions.

A signal on a bar enters at the next bar's open (market), or places an order that fills at
its price on a later bar (limit, stop), or is confirmed by a later close first. Exits are
looked for from the entry bar on: weekend, day, stop before target, custom, partial targets.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_BAR = 250


@dataclass(frozen=True)
class Strategy:
    """Settings of a strategy; the defaults are the simplest short trade."""

    direction: str = "short"
    entry_method: str = "market"
    confirm: bool = False
    lookahead_bars: int = 20
    order_offset_pips: float = 0.0
    sl_basis: str = "signal_candle"
    sl_atr_multiplier: float = 2.0
    sl_fixed_pips: float = 20.0
    tp_basis: str = "rr"
    rr: float = 2.0
    tp_fixed_pips: float = 20.0
    pip_size: float = 0.01
    spread_pips: float = 0.0
    slippage_pips: float = 0.0
    commission_per_trade: float = 0.0
    use_weekend_exit: bool = False
    weekend_exit_hour: int = 4
    use_daily_exit: bool = False
    daily_exit_hour: int = 23
    intraday: bool = True
    allow_concurrent_positions: bool = False
    use_atr_trailing_stop: bool = False
    atr_trailing_multiplier: float = 2.0
    use_breakeven_stop: bool = False
    breakeven_trigger_rr: float = 1.0
    partial_tp_levels: tuple[tuple[float, float], ...] = ()
    max_dd_stop_pips: float = 0.0
    consecutive_loss_stop_count: int = 0
    consecutive_loss_stop_bars: int = 0
    position_sizing_method: str = ""
    initial_capital: float = 1_000_000.0
    risk_percent: float = 1.0
    fixed_lot_size: float = 0.1
    pip_value_account: float = 1000.0
    first_bar: int = FIRST_BAR

    def __post_init__(self) -> None:
        for name, allowed in (("direction", ("short", "long", "both")), ("entry_method", ("market", "limit", "stop")), ("sl_basis", ("signal_candle", "atr", "fixed_pips")), ("tp_basis", ("rr", "fixed_pips", "custom")), ("position_sizing_method", ("", "fixed_lot", "risk_percent", "compounding"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        if self.direction == "both" and self.entry_method != "market":
            raise ValueError("both directions need market entries")

    @property
    def cost(self) -> float:
        return (self.spread_pips + self.slippage_pips) * self.pip_size + self.commission_per_trade

    @classmethod
    def of(cls, params: dict[str, Any]) -> Strategy:
        known = {f.name for f in fields(cls)}
        return cls(**{k: (tuple(map(tuple, v)) if k == "partial_tp_levels" else v) for k, v in params.items() if k in known})


@dataclass
class Signal:
    bar: int
    side: int  # 1 long, -1 short
    low: float
    high: float
    price: float | None = None  # of an order


@dataclass
class Position:
    signal: Signal
    bar: int
    entry: float
    risk: float
    stop: float
    target: float | None
    lots: float
    worst: float
    best: float
    safe: bool = False
    legs: list[tuple[float, float]] = field(default_factory=list)
    rest: float = 1.0


@dataclass
class Bars:
    """The columns of one series."""

    time: np.ndarray
    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    hour: np.ndarray
    weekday: np.ndarray
    atr: np.ndarray
    long: np.ndarray
    short: np.ndarray
    exit: np.ndarray

    @classmethod
    def of(cls, x: pd.DataFrame) -> Bars:
        n = len(x)
        no = np.zeros(n, bool)
        t = x["datetime"]
        col = lambda c, d: x[c].to_numpy(dtype=float) if c in x else d
        bit = lambda c: x[c].fillna(False).to_numpy(dtype=bool) if c in x else no
        return cls(t.to_numpy(), *(x[c].to_numpy(dtype=float) for c in ("open", "high", "low", "close")), t.dt.hour.to_numpy(), t.dt.weekday.to_numpy(), col("atr", np.full(n, np.nan)), bit("long_signal"), bit("short_signal"), bit("exit_signal"))


class Account:
    """Realised profit, and what pauses new entries or sizes them."""

    def __init__(self, s: Strategy):
        self.s, self.balance = s, s.initial_capital
        self.equity = self.peak = 0.0
        self.losses, self.paused_to, self.paused = 0, -1, False

    def blocked(self, bar: int) -> bool:
        return self.paused or bar < self.paused_to

    def lots(self, risk: float) -> float:
        s, pips = self.s, risk / self.s.pip_size
        if s.position_sizing_method == "fixed_lot":
            return s.fixed_lot_size
        if not s.position_sizing_method or pips <= 0.01:
            return 0.0
        capital = self.balance if s.position_sizing_method == "compounding" else s.initial_capital
        return max(0.0, capital * s.risk_percent / 100 / (pips * s.pip_value_account))

    def settle(self, profit: float, lots: float, bar: int) -> float:
        s = self.s
        self.equity += profit
        if s.max_dd_stop_pips > 0:
            self.peak = max(self.peak, self.equity)
            down = self.peak - self.equity
            self.paused = down >= s.max_dd_stop_pips or (self.paused and down > 0.5 * s.max_dd_stop_pips)
        if s.consecutive_loss_stop_count > 0:
            self.losses = self.losses + 1 if profit < 0 else 0
            if self.losses >= s.consecutive_loss_stop_count:
                self.paused_to, self.losses = bar + s.consecutive_loss_stop_bars, 0
        money = profit / s.pip_size * s.pip_value_account * lots
        self.balance += money
        return money


class Simulator:
    """One strategy over one series."""

    def __init__(self, bars: Bars, s: Strategy):
        self.b, self.s, self.account = bars, s, Account(s)
        self.open: list[Position] = []
        self.trades: list[dict[str, Any]] = []

    def run(self) -> list[dict[str, Any]]:
        s, waiting, watched = self.s, None, None
        for i in range(s.first_bar, len(self.b.close)):
            blocked = self.account.blocked(i)
            if waiting and (s.allow_concurrent_positions or not self.open):
                waiting = self._enter(waiting, i, blocked)
            held = bool(self.open)
            if held:
                self.open = [p for p in self.open if not self._exit(p, i)]
            if blocked or (held and not s.allow_concurrent_positions):
                continue
            if s.confirm:
                waiting, watched = self._confirm(waiting, watched, i)
            elif (found := self._signal(i)) and (s.entry_method == "market" or waiting is None):
                waiting = found
        return self.trades

    def _signal(self, i: int) -> Signal | None:
        b, s = self.b, self.s
        up = s.direction in ("long", "both") and b.long[i]
        down = s.direction in ("short", "both") and b.short[i]
        if up == down:
            return None
        side = 1 if up else -1
        away = s.order_offset_pips * s.pip_size * (-side if s.entry_method == "limit" else side)
        return Signal(i, side, b.low[i], b.high[i], None if s.entry_method == "market" else b.close[i] + away)

    def _confirm(self, waiting: Signal | None, watched: Signal | None, i: int) -> tuple[Signal | None, Signal | None]:
        """A signal is watched until a close beyond its bar arms the entry, or too many bars have passed."""
        if watched:
            age, close = i - watched.bar, self.b.close[i]
            if 0 < age <= self.s.lookahead_bars and (close > watched.high if watched.side > 0 else close < watched.low):
                return watched, None
            if age <= self.s.lookahead_bars:
                return waiting, watched
        return waiting, self._signal(i)

    def _enter(self, g: Signal, i: int, blocked: bool) -> Signal | None:
        """What is still waiting after the bar's open (or its range, for orders)."""
        b, s = self.b, self.s
        if blocked:
            return None
        if g.price is None:
            price = b.open[i]
        elif i - g.bar > s.lookahead_bars:
            return None
        else:
            below = (s.entry_method == "limit") == (g.side > 0)  # fills when the price falls to it
            if not (b.low[i] <= g.price if below else b.high[i] >= g.price):
                return g
            price = g.price
        stop, risk = self._stop(g, price, i)
        if risk > 0:
            target = {"rr": price + g.side * risk * s.rr, "fixed_pips": price + g.side * s.tp_fixed_pips * s.pip_size, "custom": None}[s.tp_basis]
            self.open.append(Position(g, i, price, risk, stop, target, self.account.lots(risk), price, price))
        return None

    def _stop(self, g: Signal, price: float, i: int) -> tuple[float, float]:
        s = self.s
        if s.sl_basis == "signal_candle":
            stop = g.low if g.side > 0 else g.high
            return stop, g.side * (price - stop)
        away = s.sl_fixed_pips * s.pip_size if s.sl_basis == "fixed_pips" else self.b.atr[i - 1] * s.sl_atr_multiplier if i else np.nan
        return (price, 0.0) if np.isnan(away) else (price - g.side * away, away)

    def _tighten(self, p: Position, i: int) -> None:
        b, s, side = self.b, self.s, p.signal.side
        if i and s.use_atr_trailing_stop and not np.isnan(b.atr[i - 1]):
            p.stop = side * max(side * p.stop, side * b.close[i - 1] - b.atr[i - 1] * s.atr_trailing_multiplier)
        if i and s.use_breakeven_stop:
            reached = b.high[i - 1] if side > 0 else b.low[i - 1]
            p.safe = p.safe or side * (reached - p.entry) >= p.risk * s.breakeven_trigger_rr
            if p.safe:
                p.stop = side * max(side * p.stop, side * p.entry)

    def _outcome(self, p: Position, i: int) -> tuple[str, float] | None:
        b, s, side = self.b, self.s, p.signal.side
        if s.intraday and s.use_weekend_exit and b.weekday[i] == 5 and b.hour[i] >= s.weekend_exit_hour:
            return "Weekend", b.close[i]
        if s.intraday and s.use_daily_exit and b.hour[i] == s.daily_exit_hour:
            return "DailyExit", b.close[i]
        against, along = (b.low[i], b.high[i]) if side > 0 else (b.high[i], b.low[i])
        stopped, custom = side * against <= side * p.stop, s.tp_basis == "custom" and bool(b.exit[i])
        reached = p.target is not None and side * along >= side * p.target
        if stopped:
            return ("SL_and_TP_SL_first" if reached or custom else "SL"), p.stop
        if reached:
            return "TP", p.target
        if custom:
            return "CustomExit", b.close[i]
        for ratio, share in s.partial_tp_levels[len(p.legs) :]:
            level = p.entry + side * p.risk * ratio
            if side * along < side * level:
                break
            p.legs.append((level, p.rest * share))
            p.rest -= p.rest * share
        return None

    def _exit(self, p: Position, i: int) -> bool:
        b, side = self.b, p.signal.side
        against, along = (b.low[i], b.high[i]) if side > 0 else (b.high[i], b.low[i])
        p.worst, p.best = side * min(side * p.worst, side * against), side * max(side * p.best, side * along)
        self._tighten(p, i)
        done = self._outcome(p, i)
        if not done:
            return False
        reason, price = done
        profit = side * (p.rest * (price - p.entry) + sum(w * (x - p.entry) for x, w in p.legs)) - self.s.cost
        money = self.account.settle(profit, p.lots, i)
        g = p.signal
        self.trades.append(
            {
                "direction": "long" if side > 0 else "short", "entry_time": b.time[p.bar], "entry_bar_index": p.bar, "entry_price": round(float(p.entry), 5), "exit_time": b.time[i], "exit_bar_index": i, "exit_price": round(float(price), 5),
                "sl": round(float(p.stop), 5), "tp": None if p.target is None else round(float(p.target), 5), "profit": round(float(profit), 5), "exit_reason": reason, "mae": round(float(side * (p.entry - p.worst)), 5), "mfe": round(float(side * (p.best - p.entry)), 5),
                "signal_time": b.time[g.bar], "signal_bar_index": g.bar, "signal_low": round(float(g.low), 5), "signal_high": round(float(g.high), 5), "lot_size": round(float(p.lots), 4), "profit_currency": round(float(money), 2), "account_balance": round(float(self.account.balance), 2), "partial_exit_prices": [round(float(x), 5) for x, _ in p.legs],
            }
        )
        return True


TRADES = "symbol string, param_id string, trade_number long, direction string, entry_time timestamp_ntz, entry_bar_index long, entry_price double, exit_time timestamp_ntz, exit_bar_index long, exit_price double, sl double, tp double, profit double, exit_reason string, mae double, mfe double, signal_time timestamp_ntz, signal_bar_index long, signal_low double, signal_high double, lot_size double, profit_currency double, account_balance double, partial_exit_prices array<double>"


#: Strategies that share one copy of a series' bars.
SHARED = 4


def simulate(bars: DataFrame, strategies: dict[str, Strategy], shared: int = SHARED) -> DataFrame:
    """Trades of every strategy on every series; ``bars`` has ``long_signal``, ``short_signal``, ``exit_signal`` and ``atr`` as needed.

    Strategies come in blocks of ``shared``, each of which gets one copy of a series as a task's group.
    """
    spark = bars.sparkSession
    names = list(strategies)
    blocks = [names[i : i + shared] for i in range(0, len(names), shared)]
    wanted = [c for c in ("symbol", "bar_index", "datetime", "open", "high", "low", "close", "atr", "long_signal", "short_signal", "exit_signal") if c in bars.columns]
    columns = [c.split()[0] for c in TRADES.split(", ")]

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bar_index")
        series, symbol, parts = Bars.of(x), x["symbol"].iloc[0], []
        for name in blocks[int(x["block"].iloc[0])]:
            trades = Simulator(series, strategies[name]).run()
            if trades:
                part = pd.DataFrame(trades, columns=columns)
                part["symbol"], part["param_id"], part["trade_number"] = symbol, name, np.arange(1, len(part) + 1)
                parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame(columns=columns)

    numbers = spark.createDataFrame([(i,) for i in range(len(blocks))], "block int")
    return bars.select(*wanted).crossJoin(F.broadcast(numbers)).groupBy("symbol", "block").applyInPandas(run, TRADES)


def walk_forward(bars: DataFrame, strategies: dict[str, Strategy], windows: list[tuple], top: int = 3) -> DataFrame:
    """Strategies fitted on one span of bars and proven on the next.

    ``windows`` are ``(train_start, train_end, test_end)``; a test begins where its training ends. In each window
    and series every strategy is run on the bars of the training; the ``top`` by profit factor, then
    profit, are run on the bars of the test. A row each: ``window, symbol, rank, param_id, train_*, test_*``;
    a strategy without a trade in the test has 0 there.
    """
    from candleforge.operators import analysis as A

    spark = bars.sparkSession
    spans = [(i, part, lo, hi) for i, (a, b, c) in enumerate(windows, 1) for part, lo, hi in (("train", a, b), ("test", b, c))]
    table = spark.createDataFrame(spans, "window int, part string, lo timestamp_ntz, hi timestamp_ntz")
    cut = bars.join(F.broadcast(table), (F.col("datetime") >= F.col("lo")) & (F.col("datetime") < F.col("hi"))).drop("lo", "hi")
    first = cut.groupBy("symbol", "window", "part").agg(F.min("bar_index").alias("first"))
    cut = cut.join(first, ["symbol", "window", "part"]).withColumn("bar_index", F.col("bar_index") - F.col("first"))
    cut = cut.withColumn("symbol", F.to_json(F.struct("symbol", "window", "part"))).drop("window", "part", "first")
    trades = simulate(cut, strategies).select(F.to_json(F.struct("symbol", "param_id")).alias("series"), "trade_number", "entry_time", "exit_time", "profit")
    of = F.from_json("series", "symbol string, param_id string")
    where = F.from_json(of["symbol"], "symbol string, window int, part string")
    rows = A.run(A.SUMMARY, trades).select(where["symbol"].alias("symbol"), where["window"].alias("window"), where["part"].alias("part"), of["param_id"].alias("param_id"), "trades", "win_rate", "net_profit", "profit_factor", "max_dd")
    values = ["trades", "win_rate", "net_profit", "profit_factor", "max_dd"]
    best = Window.partitionBy("window", "symbol").orderBy(F.col("profit_factor").desc(), F.col("net_profit").desc(), "param_id")
    train = rows.where("part = 'train'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    train = train.select("window", "symbol", F.col("rank").cast("long").alias("rank"), "param_id", *[F.col(v).alias(f"train_{v}") for v in values])
    test = rows.where("part = 'test'").select("window", "symbol", "param_id", *[F.col(v).alias(f"test_{v}") for v in values])
    return train.join(test, ["window", "symbol", "param_id"], "left").fillna(0, [f"test_{v}" for v in values])


def first_touch(low: np.ndarray, high: np.ndarray, begin: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each position the first bar from ``begin`` on whose low is at most ``stop`` or whose high is at least ``target``; -1 without one.

    Lowest lows and highest highs of blocks of 1, 2, 4, ... bars are climbed until a block touches and then descended.
    """
    lows, highs = [low], [high]
    while len(lows[-1]) > 1:
        odd = len(lows[-1]) % 2
        lows.append(np.fmin.reduceat(lows[-1], np.arange(0, len(lows[-1]) + odd, 2)))
        highs.append(np.fmax.reduceat(highs[-1], np.arange(0, len(highs[-1]) + odd, 2)))
    at, height, left = begin.copy(), np.full(len(begin), -1), np.arange(len(begin))
    for k in range(len(lows)):
        left = left[at[left] < len(lows[k])]
        own = left[(at[left] % 2 == 1) | (k == len(lows) - 1)]  # even blocks are looked at with their neighbour
        met = (lows[k][at[own]] <= stop[own]) | (highs[k][at[own]] >= target[own])
        height[own[met]] = k
        left = left[height[left] < 0]
        at[left] = (at[left] + 1) // 2
    for k in range(len(lows) - 1, 0, -1):
        down = np.flatnonzero(height == k)
        at[down] *= 2
        met = (lows[k - 1][at[down]] <= stop[down]) | (highs[k - 1][at[down]] >= target[down])
        at[down] += ~met
        height[down] = k - 1
    return np.where(height == 0, at, -1)


def concurrent(bars: DataFrame, rr: float, first: int, open_too: bool = False) -> DataFrame:
    """Trades of a position for each ``long_signal`` from bar ``first`` on, with their times, held until its stop or target, however long; open ones have no row, or with ``open_too`` one without exit."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bar_index", ignore_index=True)
        bar, price, low, high = x["bar_index"].to_numpy(), *(x[c].to_numpy(dtype=float) for c in ("open", "low", "high"))
        i = np.flatnonzero(x["long_signal"].fillna(False).to_numpy(dtype=bool)[:-1] & (bar[:-1] >= first) & (bar[1:] == bar[:-1] + 1) & (price[1:] > low[:-1]))
        entry, stop = price[i + 1], low[i]
        target = entry + rr * (entry - stop)
        out = first_touch(low, high, i + 1, stop, target)
        done = (out >= 0) | open_too
        i, out, entry, stop, target = i[done], out[done], entry[done], stop[done], target[done]
        time, shut = x["datetime"].to_numpy(), out >= 0
        return pd.DataFrame({"symbol": x["symbol"].iloc[0], "entry_time": time[i + 1], "exit_time": pd.Series(time[out]).where(shut), "signal_bar_index": bar[i], "entry_bar_index": bar[i + 1], "exit_bar_index": pd.Series(bar[out]).astype("Int64").where(shut), "entry_price": entry, "sl": stop, "tp": target, "low": low[out], "high": high[out]})

    given = bars.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), F.col("datetime").cast("timestamp_ntz").alias("datetime"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low")], "long_signal")
    x = given.groupBy("symbol").applyInPandas(run, "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, signal_bar_index long, entry_bar_index long, exit_bar_index long, entry_price double, sl double, tp double, low double, high double")
    return x.selectExpr(
        "symbol", "entry_time", "exit_time", "signal_bar_index", "entry_bar_index", "exit_bar_index", "round(entry_price, 5) as entry_price",
        "case when exit_bar_index is null then 'OPEN' when low <= sl and high >= tp then 'SL_and_TP_SL_first' when low <= sl then 'SL' else 'TP' end as exit_reason",
        "round(case when low <= sl then sl else tp end - entry_price + 1e-9, 5) as profit",
    )


#: The same by a range join.
CONCURRENT_SQL = """
with c as (select s.symbol, s.bar_index as signal_bar_index, e.bar_index as entry_bar_index, e.open as entry_price, s.low as sl, e.open + {rr} * (e.open - s.low) as tp
  from {bars} s join {bars} e on s.symbol = e.symbol and e.bar_index = s.bar_index + 1 where s.long_signal and s.bar_index >= {first} and e.open > s.low),
x as (select c.symbol, c.signal_bar_index, c.entry_bar_index, c.entry_price, c.sl, c.tp, min(b.bar_index) as exit_bar_index
  from c join {bars} b on b.symbol = c.symbol and b.bar_index >= c.entry_bar_index and (b.low <= c.sl or b.high >= c.tp) group by 1, 2, 3, 4, 5, 6)
select x.symbol, x.signal_bar_index, x.entry_bar_index, x.exit_bar_index, round(x.entry_price, 5) as entry_price,
  case when b.low <= x.sl and b.high >= x.tp then 'SL_and_TP_SL_first' when b.low <= x.sl then 'SL' else 'TP' end as exit_reason,
  round(case when b.low <= x.sl then x.sl else x.tp end - x.entry_price + 1e-9, 5) as profit
from x join {bars} b on b.symbol = x.symbol and b.bar_index = x.exit_bar_index
"""
