"""Position sizing: stop and target prices, whole lots, and what a trade costs and pays.

Expects the columns direction (long or short), anchor (stop or profit), deposit,
risk_pct, entry, stop, tp, rr, borrow_pct, hold_days, lot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C = F.col


def _short() -> Column:
    return _C("direction") == "short"


def flipped(entry: Column | str, price: Column | str, wants_above: Column) -> Column:
    """``price`` at its distance from ``entry``, above it or below it."""
    entry, price = (F.col(x) if isinstance(x, str) else x for x in (entry, price))
    far = F.abs(entry - price)
    return F.when(wants_above, entry + far).otherwise(entry - far)


def resolved(trades: DataFrame) -> DataFrame:
    """``trades`` with stop_distance, reward_distance, and the stop or target that the anchor leaves open.

    Borrowing costs a short position a share f = rate / 365 * days of its value;
    the reward makes up for it, so that the net ratio is the wanted one:
    reward = rr * stop + (rr + 1) * entry * f, or solved for stop.
    """
    sign = F.when(_C("direction") == "long", 1.0).otherwise(-1.0)
    cost = _C("entry") * F.when(_short(), _C("borrow_pct") / 100 / 365 * _C("hold_days")).otherwise(0.0)
    by_stop = _C("anchor") == "stop"
    stop_distance = F.when(by_stop, F.abs(_C("entry") - _C("stop"))).otherwise((F.abs(_C("entry") - _C("tp")) - cost) / F.nullif(_C("rr"), F.lit(0.0)) - cost)
    reward_distance = F.when(by_stop, _C("rr") * F.abs(_C("entry") - _C("stop")) + (_C("rr") + 1) * cost).otherwise(F.abs(_C("entry") - _C("tp")))
    out = trades.withColumns({"stop_distance": stop_distance, "reward_distance": reward_distance})
    return out.withColumns({
        "stop": F.when(by_stop, _C("stop")).otherwise(_C("entry") - sign * _C("stop_distance")),
        "tp": F.when(by_stop, _C("entry") + sign * _C("reward_distance")).otherwise(_C("tp")),
    })


def economics(trades: DataFrame) -> DataFrame:
    """``resolved`` with size (whole lots, one at least), lots, notional, borrow_cost, risk, reward, net_rr, risk_share."""
    rate = F.when(_short(), _C("borrow_pct") / 100 / 365).otherwise(0.0)
    out = resolved(trades).withColumn("_reach", _C("stop_distance") + _C("entry") * rate * _C("hold_days"))
    lots = F.floor(_C("deposit") * _C("risk_pct") / 100 / _C("_reach") / F.nullif(_C("lot"), F.lit(0)))
    size = F.when(_C("_reach") <= 0, 0.0).otherwise((F.greatest(lots, F.lit(1)) * _C("lot")).cast("double"))
    out = out.withColumn("size", size).withColumns({"lots": _C("size") / F.nullif(_C("lot"), F.lit(0)), "notional": _C("size") * _C("entry")})
    out = out.withColumn("borrow_cost", _C("notional") * rate * _C("hold_days"))
    out = out.withColumns({"risk": _C("size") * _C("stop_distance") + _C("borrow_cost"), "reward": _C("size") * _C("reward_distance") - _C("borrow_cost")})
    net = F.when(_C("risk") > 0, _C("reward") / _C("risk")).otherwise(0.0)
    share = F.when(_C("deposit") > 0, _C("risk") / _C("deposit")).otherwise(0.0)
    return out.withColumns({"net_rr": net, "risk_share": share}).drop("_reach")


def problems(trades: DataFrame) -> DataFrame:
    """``trades`` with problem: what is wrong with the input first, or null."""
    long_, by_stop = _C("direction") == "long", _C("anchor") == "stop"
    low = lambda c: F.coalesce(_C(c) <= 0, F.lit(True))
    wrong_stop = F.when(long_, _C("stop") >= _C("entry")).otherwise(_C("stop") <= _C("entry"))
    wrong_tp = F.when(long_, _C("tp") <= _C("entry")).otherwise(_C("tp") >= _C("entry"))
    cases = [
        (low("deposit"), "deposit"), (low("risk_pct"), "risk_pct"), (low("entry"), "entry"), (low("rr"), "rr"),
        (by_stop & low("stop"), "stop"), (by_stop & wrong_stop, "stop side"), (~by_stop & low("tp"), "tp"), (~by_stop & wrong_tp, "tp side"),
        (_short() & ((_C("borrow_pct") < 0) | (_C("hold_days") < 0)), "borrow"),
    ]
    out = F.lit(None).cast("string")
    for test, name in reversed(cases):
        out = F.when(test, F.lit(name)).otherwise(out)
    return trades.withColumn("problem", out)
