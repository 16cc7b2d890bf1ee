"""The oldest signal: up to six kinds of conditions, all of which have to hold."""

from __future__ import annotations

from dataclasses import dataclass

from candleforge.functions.compiler import Plan
from candleforge.functions.indicators import build

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")


@dataclass(frozen=True)
class Combined:
    """Which conditions count. ``above`` and ``below`` may both be asked for; a kind that is on without either holds always."""

    use_ema: bool = False
    ema_above: bool = False
    ema_below: bool = False
    use_rsi: bool = False
    rsi_above: bool = False
    rsi_below: bool = False
    use_atr: bool = False
    atr_above: bool = False
    atr_below: bool = False
    use_adx: bool = False
    adx_above: bool = False
    use_session: bool = False
    session_start: int = 0
    session_end: int = 24
    use_weekday: bool = False
    days: tuple[str, ...] = DAYS


def combined(plan: Plan, c: Combined, lengths: dict[str, int] | None = None, **thresholds: float) -> str:
    """A boolean expression: close against the ema, rsi, atr and adx against ``rsi=``, ``atr=``, ``adx=``, the hour and the weekday.

    An unknown value holds for nothing. A session from a later hour to an earlier one goes over midnight.
    """
    lengths = {"ema": 200, "rsi": 14, "atr": 14, "adx": 14, **(lengths or {})}
    parts = []
    for name in ("ema", "rsi", "atr", "adx"):
        if not getattr(c, f"use_{name}"):
            continue
        value = plan.let(build(plan, name, length=lengths[name]))
        if name != "ema" and name not in thresholds:
            raise ValueError(f"no threshold for {name}")
        left, right = ("close", value) if name == "ema" else (value, repr(float(thresholds[name])))
        for side, op in (("above", ">"), ("below", "<")):
            if getattr(c, f"{name}_{side}", False):
                parts.append(f"coalesce({left} {op} {right}, false)")
    if c.use_session:
        joint = "and" if c.session_start < c.session_end else "or"
        parts.append(f"(extract(hour from datetime) >= {int(c.session_start)} {joint} extract(hour from datetime) < {int(c.session_end)})")
    if c.use_weekday:
        if unknown := set(c.days) - set(DAYS):
            raise ValueError(f"unknown day: {sorted(unknown)[0]}")
        numbers = ", ".join(str(DAYS.index(d)) for d in c.days)
        parts.append(f"{plan.dialect.weekday('datetime')} in ({numbers})" if numbers else "false")
    return " and ".join(parts) if parts else "true"
