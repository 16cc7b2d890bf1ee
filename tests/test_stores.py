"""The strategy store and user-defined patterns."""

import numpy as np

from candleforge.functions.plugins import faults, with_detectors
from candleforge.plans.market_queries import hourly
from candleforge.sources.store import Store


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.strategies().count() == 0
    s.save("a", "one", {"rr": 2}, tags=("x",))
    s.save("b", "two", {"rr": 3}, favorite=True)
    s.save("a", "again", {"rr": 4}, tags=("x", "y"))
    assert {r.id: r.name for r in s.strategies().collect()} == {"a": "again", "b": "two"}
    assert s.strategies(tag="y").count() == 1 and s.strategies(favorite=True).first().id == "b"
    s.put("best", "a")
    s.put("best", "b")
    s.rename("best", "top")
    s.take("top", "a")
    assert [r.strategy_id for r in s.collections("top").collect()] == ["b"]
    s.delete("b")
    assert s.collections().count() == 0 and s.strategies().count() == 1


def rising(x, n=3):
    up = (x["close"] > x["open"]).astype(int)
    return (up.rolling(n).sum() == n).to_numpy(float)


def test_plugins(spark):
    assert faults(rising) == []
    assert faults(lambda x: (x["close"].shift(-1) > x["close"]).to_numpy(float))
    assert faults(lambda x: np.ones(3)) and faults(lambda x: np.full(len(x), 2.0)) and faults(lambda x: 1 / 0)
    out = with_detectors(hourly(spark, "/root/testdata/sf0.001"), {"up": (lambda x, n: ((x["close"] > x["open"]).astype(int).rolling(n).sum() == n).to_numpy(float), {"n": 2})})
    assert out.selectExpr("sum(custom_up) s").first().s > 0
