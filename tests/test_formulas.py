"""Indicators against a second definition of each in pandas or plain Python."""

import numpy as np
import pandas as pd

from candleforge.functions import indicators as I
from tests.test_market import series, values


def second(x):
    """Second definitions by name, with default parameters."""
    o, h, l, c, v = (x[k] for k in ("open", "high", "low", "close", "volume"))  # noqa: E741
    body, span, before = (c - o).abs(), h - l, c.shift()
    top, bottom = np.maximum(o, c), np.minimum(o, c)
    upper, lower = h - top, bottom - l
    tr = pd.concat([span, (h - before).abs(), (l - before).abs()], axis=1).max(axis=1)
    wilder = lambda s, n: s.ewm(alpha=1 / n, adjust=False).mean()
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    atr = wilder(tr, 14)
    move = c.diff()
    up, down = move.where(move > 0, 0.0), -move.where(move < 0, 0.0)  # the first bar counts as no move
    rsi = 100 - 100 / (1 + wilder(up, 14) / wilder(down, 14))
    mid, sd = c.rolling(20).mean(), c.rolling(20).std()
    out = {
        "open": o, "high": h, "low": l, "close": c, "candle_body": c - o,
        "sma": c.rolling(200).mean(), "ema": ema(c, 200), "atr": atr, "rsi": rsi,
        "highest_high": h.rolling(20).max().shift(), "lowest_low": l.rolling(20).min().shift(), "highest_close": c.rolling(20).max().shift(), "lowest_close": c.rolling(20).min().shift(),
        "donchian_mid": (h.rolling(20).max() + l.rolling(20).min()).shift() / 2,
        "donchian_percent_position": (c - l.rolling(20).min().shift()) / (h.rolling(20).max() - l.rolling(20).min()).shift(),
        "rolling_mean_high": h.rolling(20).mean(), "rolling_mean_low": l.rolling(20).mean(),
        "bollinger_upper": mid + 2 * sd, "bollinger_middle": mid, "bollinger_lower": mid - 2 * sd, "bb_width": 4 * sd / mid, "bb_width_percent": 100 * 4 * sd / mid, "bb_percent_b": (c - mid + 2 * sd) / (4 * sd),
        "macd_line": ema(c, 12) - ema(c, 26), "macd_signal": ema(ema(c, 12) - ema(c, 26), 9), "macd_histogram": ema(c, 12) - ema(c, 26) - ema(ema(c, 12) - ema(c, 26), 9),
        "williams_r": -100 * (h.rolling(14).max() - c) / (h.rolling(14).max() - l.rolling(14).min()),
        "rsi_rolling_mean": rsi.rolling(20).mean(), "rsi_deviation": rsi - rsi.rolling(20).mean(),
        "atr_rolling_mean": atr.rolling(20).mean(), "atr_deviation": atr - atr.rolling(20).mean(),
        "avg_body_size": body.rolling(20).mean(), "max_body_size": body.rolling(20).max(), "min_body_size": body.rolling(20).min(),
        "avg_upper_wick": upper.rolling(20).mean(), "avg_lower_wick": lower.rolling(20).mean(),
        "bull_power": h - ema(c, 13), "bear_power": l - ema(c, 13),
        "obv": (np.sign(move.fillna(0)) * v).cumsum(),
        "bullish_candle": c > o, "bearish_candle": c < o, "inside_bar": (h < h.shift()) & (l > l.shift()), "outside_bar": (h > h.shift()) & (l < l.shift()),
        "engulfing_bullish": (c > o) & (c.shift() < o.shift()) & (o <= c.shift()) & (c >= o.shift()), "engulfing_bearish": (c < o) & (c.shift() > o.shift()) & (o >= c.shift()) & (c <= o.shift()),
        "nr4": span == span.rolling(4).min(), "nr7": span == span.rolling(7).min(),
        "ichimoku_tenkan": (h.rolling(9).max() + l.rolling(9).min()) / 2, "ichimoku_kijun": (h.rolling(26).max() + l.rolling(26).min()) / 2,
        "ichimoku_senkou_b": ((h.rolling(52).max() + l.rolling(52).min()) / 2).shift(26),
        "fvg_bullish": l > h.shift(2), "fvg_bearish": h < l.shift(2),
        "dist_close_sma": (c - c.rolling(200).mean()).abs(), "dist_high_ema": (h - ema(c, 200)).abs(), "dist_low_donchian_lower": (l - l.rolling(20).min().shift()).abs(), "dist_close_bb_upper": (c - mid - 2 * sd).abs(),
        "ema_slope": ema(c, 200) - ema(c, 200).shift(5), "ema_rising": ema(c, 200).diff() > 1e-9, "ema_falling": ema(c, 200).diff() < -1e-9, "rsi_rising": rsi.diff() > 1e-9,
        "keltner_middle": ema(c, 20), "keltner_upper": ema(c, 20) + 2 * wilder(tr, 10), "keltner_lower": ema(c, 20) - 2 * wilder(tr, 10),
        "correlation_oscillator": c.rolling(20).corr(pd.Series(np.arange(len(c), dtype=float))), "correlation_close_ema": c.rolling(20).corr(ema(c, 20)),
        "hour": x.datetime.dt.hour, "month": x.datetime.dt.month,
    }
    out["ichimoku_senkou_a"] = ((out["ichimoku_tenkan"] + out["ichimoku_kijun"]) / 2).shift(26)
    k = (100 * (c - l.rolling(14).min()) / (h.rolling(14).max() - l.rolling(14).min())).rolling(3).mean()
    out |= {"stochastic_k": k, "stochastic_d": k.rolling(3).mean()}
    typical = (h + l + c) / 3
    spread = typical.rolling(20).apply(lambda w: np.abs(w - w.mean()).mean(), raw=True)
    out["cci"] = (typical - typical.rolling(20).mean()) / (0.015 * spread)
    ups, downs = h.diff(), -l.diff()
    plus, minus = ups.where((ups > downs) & (ups > 0), 0.0), downs.where((downs > ups) & (downs > 0), 0.0)
    out["plus_di"], out["minus_di"] = 100 * wilder(plus, 14) / atr, 100 * wilder(minus, 14) / atr
    dx = 100 * (out["plus_di"] - out["minus_di"]).abs() / (out["plus_di"] + out["minus_di"])
    out["adx"] = wilder(dx, 14)
    age = lambda s, f: s.rolling(15).apply(lambda w: 14 - (14 - f(w[::-1])), raw=True)
    out["aroon_up"], out["aroon_down"] = 100 * (14 - age(h, np.argmax)) / 14, 100 * (14 - age(l, np.argmin)) / 14
    out["aroon_oscillator"] = out["aroon_up"] - out["aroon_down"]
    flow = (typical * v)
    rise = typical.diff()
    out["mfi"] = 100 - 100 / (1 + flow.where(rise > 0, 0.0).rolling(14).sum() / flow.where(rise < 0, 0.0).rolling(14).sum())
    place = ((2 * c - h - l) / span).fillna(0) * v
    out["cmf"], out["ad_line"] = place.rolling(20).sum() / v.rolling(20).sum(), place.cumsum()
    out["chaikin_oscillator"] = ema(place.cumsum(), 3) - ema(place.cumsum(), 10)
    line = lambda w: np.polyfit(np.arange(20.0), w, 1)
    out["linreg_value"] = c.rolling(20).apply(lambda w: np.polyval(line(w), 19.0), raw=True)
    out["linreg_slope_atr_ratio"] = c.rolling(20).apply(lambda w: line(w)[0], raw=True) / atr
    gain, loss = up.rolling(14).sum(), down.rolling(14).sum()
    out["cmo"] = 100 * (gain - loss) / (gain + loss)
    out["choppiness_index"] = 100 * np.log10(tr.rolling(14).sum() / (h.rolling(14).max() - l.rolling(14).min())) / np.log10(14)
    roc = 100 * (c / c.shift(14) - 1) + 100 * (c / c.shift(11) - 1)
    out["coppock_curve"] = roc.rolling(10).apply(lambda w: (w * np.arange(1, 11)).sum() / 55, raw=True)
    day = x.datetime.dt.date
    daily = x.groupby(day).agg(high=("high", "max"), low=("low", "min"), close=("close", "last"))
    past = daily.shift()
    high, low, last = (day.map(past[k]) for k in ("high", "low", "close"))
    pivot = (high + low + last) / 3
    out |= {"prev_day_high": high, "prev_day_low": low, "prev_day_mid": (high + low) / 2, "pivot": pivot, "pivot_r1": 2 * pivot - low, "pivot_s1": 2 * pivot - high}
    out |= {f"camarilla_r{n}": last + (high - low) * 1.1 / d for n, d in ((1, 12), (2, 6), (3, 4), (4, 2))} | {f"camarilla_s{n}": last - (high - low) * 1.1 / d for n, d in ((1, 12), (2, 6), (3, 4), (4, 2))}
    out["adr"] = day.map((daily.high - daily.low).rolling(14).mean().shift())
    sofar_high, sofar_low = x.groupby(day).high.cummax(), x.groupby(day).low.cummin()
    out["today_range_position"] = (c - sofar_low) / (sofar_high - sofar_low)
    out["vwap"] = (typical * v).groupby(day).cumsum() / v.groupby(day).cumsum()
    ha = (o + h + l + c) / 4
    ho = [(o[0] + c[0]) / 2]
    for i in range(1, len(x)):
        ho.append((ho[-1] + ha[i - 1]) / 2)
    out["ha_bullish"], out["ha_bearish"] = ha > np.array(ho), ha < np.array(ho)
    # levels of days
    woodie, width = (high + low + 2 * last) / 4, high - low
    out |= {"woodie_pivot": woodie, "woodie_r1": 2 * woodie - low, "woodie_s1": 2 * woodie - high, "woodie_r2": woodie + width, "woodie_s2": woodie - width}
    out |= {"woodie_r3": high + 2 * (woodie - low), "woodie_s3": low - 2 * (high - woodie), "woodie_r4": high + 2 * (woodie - low) + width, "woodie_s4": low - 2 * (high - woodie) - width, "fib_pivot": pivot}
    out |= {f"fib_pivot_{k}{i}": pivot + way * d * width for k, way in (("r", 1), ("s", -1)) for i, d in enumerate((0.382, 0.618, 1.0), 1)}
    out["today_range_pct_of_adr"] = 100 * (sofar_high - sofar_low) / out["adr"]
    out["today_new_high"], out["today_new_low"] = h > sofar_high.groupby(day).shift(), l < sofar_low.groupby(day).shift()
    # distances
    top20, low20 = h.rolling(20).max().shift(), l.rolling(20).min().shift()
    levels = {"ema": ema(c, 200), "sma": c.rolling(200).mean(), "vwap": out["vwap"], "pivot": pivot, "prev_day_high": high, "prev_day_low": low, "donchian_upper": top20, "donchian_lower": low20, "bb_upper": mid + 2 * sd, "bb_lower": mid - 2 * sd}
    out |= {f"dist_{p}_{k}": (y - z).abs() for p, y in (("close", c), ("high", h), ("low", l)) for k, z in levels.items()}
    out["fib_level"] = top20 - 0.618 * (top20 - low20)
    out["dist_to_fib"], out["dist_to_round_number"] = (c - out["fib_level"]).abs(), (c - c.round()).abs() / 0.01
    out["dist_to_ema_atr_ratio"], out["dist_close_ema_pct"] = (c - ema(c, 200)).abs() / atr, 100 * (c - ema(c, 200)).abs() / c
    # slopes
    for k, y in {"ema": ema(c, 200), "vwap": out["vwap"], "rsi": rsi, "adx": out["adx"], "macd": out["macd_line"], "atr": atr, "obv": out["obv"], "mfi": out["mfi"]}.items():
        for name, way in (("rising", 1), ("falling", -1)):
            step = way * y.diff() > 1e-9
            out[f"{k}_{name}"], out[f"{k}_consecutive_{name}"] = step, step.rolling(3).sum() == 3
    slope = out["ema_slope"]
    out["ema_slope_degrees"], out["ema_roc"], out["atr_roc"] = np.degrees(np.arctan(slope / (5 * atr))), 100 * slope / ema(c, 200).shift(5), 100 * atr.pct_change()
    # statistics
    out |= {"body_size_std": body.rolling(20).std(), "close_rolling_std": sd, "historical_volatility": np.log(c / before).rolling(20).std() * 252**0.5 * 100, "adx_rolling_mean": out["adx"].rolling(20).mean(), "macd_rolling_mean": out["macd_line"].rolling(20).mean()}
    score = lambda y: (y - y.rolling(20).mean()) / y.rolling(20).std()
    out |= {"zscore_close": score(c), "zscore_rsi": score(rsi), "zscore_atr": score(atr)}
    rank = lambda y, n: y.rolling(n).apply(lambda w: 100 * ((w < w[-1]).sum() + ((w == w[-1]).sum() + 1) / 2) / n, raw=True)
    out |= {"percentile_rank_rsi": rank(rsi, 100), "percentile_rank_atr": rank(atr, 200), "percentile_rank_body": rank(body, 50)}
    out |= {"is_max_body_of_n": body == body.rolling(100).max(), "is_min_atr_of_n": atr == atr.rolling(50).min(), "is_max_rsi_of_n": rsi == rsi.rolling(200).max()}
    squeezed = rank(4 * sd / mid, 100) <= 10
    out["bb_squeeze"], out["bb_expansion"] = squeezed, squeezed.shift(fill_value=False) & (out["bb_width"].diff() > 0)
    for k, y in (("rsi", rsi), ("macd", out["macd_line"])):
        out[f"{k}_divergence_bearish"] = (c > top20) & (y < y.rolling(20).max().shift())
        out[f"{k}_divergence_bullish"] = (c < low20) & (y > y.rolling(20).min().shift())
    # cloud
    lead_a, lead_b = out["ichimoku_senkou_a"], out["ichimoku_senkou_b"]
    known = lead_a.notna() & lead_b.notna()
    out["ichimoku_price_vs_cloud"] = ((c > np.maximum(lead_a, lead_b)) & known).astype(float) - ((c < np.minimum(lead_a, lead_b)) & known)
    now_a, now_b = (out["ichimoku_tenkan"] + out["ichimoku_kijun"]) / 2, (h.rolling(52).max() + l.rolling(52).min()) / 2
    for k, over in (("bullish", now_a > now_b), ("bearish", now_a < now_b)):
        out[f"ichimoku_kumo_twist_{k}"] = over & ~over.shift(fill_value=False)
    # single candles, by the shares of body and wicks in the range
    b, u, w = body / span, upper / span, lower / span
    usual = body.rolling(20).mean().shift()
    for k, colour in (("bullish", c > o), ("bearish", c < o)):
        out |= {f"large_{k}_candle": colour & (body > 1.5 * usual), f"small_{k}_candle": colour & (body < 0.5 * usual), f"marubozu_{k}": colour & (b >= 0.95), f"consecutive_{k}_candles": colour.rolling(3).sum() == 3}
    out |= {"doji": b < 0.1, "long_upper_wick": u >= 0.6, "long_lower_wick": w >= 0.6, "no_upper_wick": u <= 0.05, "no_lower_wick": w <= 0.05, "pin_bar_bullish": (b <= 0.3) & (w >= 0.6), "pin_bar_bearish": (b <= 0.3) & (u >= 0.6)}
    down, raised = (b <= 0.3) & (w >= 0.6) & (u <= 0.1), (b <= 0.3) & (u >= 0.6) & (w <= 0.1)
    out |= {"hammer": down, "hanging_man": down, "inverted_hammer": raised, "shooting_star": raised, "spinning_top": (b <= 0.3) & (u >= 0.3) & (w >= 0.3)}
    out |= {"long_legged_doji": (b < 0.1) & (u >= 0.35) & (w >= 0.35), "dragonfly_doji": (b < 0.1) & (w >= 0.6) & (u <= 0.1), "gravestone_doji": (b < 0.1) & (u >= 0.6) & (w <= 0.1)}
    out |= {"body_larger_than_average": body > 1.5 * usual, "wick_ratio_at_least": u + w >= 0.5, "body_ratio_at_least": b >= 0.5, "belt_hold_bullish": (c > o) & (w <= 0.05) & (b >= 0.7), "belt_hold_bearish": (c < o) & (u <= 0.05) & (b >= 0.7)}
    out |= {"consecutive_higher_highs": (h.diff() > 0).rolling(3).sum() == 3, "consecutive_lower_lows": (l.diff() < 0).rolling(3).sum() == 3}
    out["ichimoku_chikou_signal"] = np.sign(c - c.shift(26)).fillna(0)
    return out


def test_second_definitions(spark):
    x = series(900, seed=11)
    want = second(x)
    got = values(spark, x, **{f"v_{n}": (n, {}) for n in want})
    wrong = {}
    for n, w in want.items():
        a, b = got[f"v_{n}"].to_numpy(float), np.asarray(w, float)
        at = np.flatnonzero(np.isnan(a) != np.isnan(b))
        far = np.nanmax(np.abs(a - b)) if not np.isnan(a - b).all() else np.inf
        if len(at) or far > 1e-6:
            wrong[n] = (len(at), at[:3].tolist(), far)
    assert not wrong, "\n".join(f"WRONG {k} {v}" for k, v in wrong.items())
    assert len(want) >= 230 and set(want) <= set(I.REGISTRY)
