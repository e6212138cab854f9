"""Range zones: how low and how high the next bars reach, read from windows of the past like the last one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import distance, quotient
from ..operators import ranks, trend
from ..operators.bars import logged
from ..operators.quantile import weighted_quantiles
from ..operators.window import whole


def prepared(bars: DataFrame, ahead: int, p: int, with_ranks: bool = False) -> DataFrame:
    """Bars with i, dratio, window (the last ``p`` ratio steps), fwd_low and fwd_high, and ranks if wanted."""
    out = ranks.delay_windows(trend.ratio_steps(trend.causal_trend(bars)), p, "dratio")
    out = ranks.forward_extremes(out, ahead)
    return ranks.bar_ranks(logged(out)) if with_ranks else out


def neighbors(bars: DataFrame, ahead: int = 5, p: int = 8, theiler: int = 5, theta: float = 0.0, lambdas: Mapping[str, float] | None = None) -> DataFrame:
    """Windows that end more than ``theiler`` bars before each ticker's last bar, with distance and weight.

    Bars must end at the origin. Weights fall with the distance over its mean
    (of all windows, also those whose outcome is unknown) and with squared
    differences of ranks; they sum to 1. Tickers with fewer than 5 windows, or
    with fewer than p + 5 bars before the gap, have none.
    """
    used = {f: w for f, w in (lambdas or {}).items() if w}
    rows = prepared(bars, ahead, p, bool(used)).withColumn("origin", F.max("i").over(whole()))
    names = [f"rank_{f}" for f in used]
    query = rows.where("i = origin").select("ticker", F.col("window").alias("query"), F.col("close").alias("anchor"), *[F.col(n).alias(f"o_{n}") for n in names])
    near = rows.where((F.col("i") < F.col("origin") - theiler) & F.col("window").isNotNull() & (F.col("origin") - theiler >= p + 5))
    over = W.partitionBy("ticker")
    near = near.join(query, "ticker").withColumn("d", distance("window", "query"))
    exponent = F.lit(-theta) * F.col("d") / F.greatest(F.avg("d").over(over), F.lit(1e-10))
    for f, w in used.items():
        exponent = exponent - F.lit(float(w)) * F.pow(F.col(f"rank_{f}") - F.col(f"o_rank_{f}"), 2)
    valid = near.withColumn("weight", F.exp(exponent)).where(F.col("fwd_low").isNotNull() & F.col("weight").isNotNull())
    valid = valid.withColumns({"_sum": F.sum("weight").over(over), "neighbors": F.count("*").over(over)}).where("neighbors >= 5")
    return valid.withColumn("weight", F.col("weight") / F.col("_sum")).select("ticker", "i", "begin", "close", "anchor", "d", "weight", "neighbors", "fwd_low", "fwd_high")


def zones(near: DataFrame, ahead: int = 5, levels: Sequence[float] = (50, 75, 90), read: Mapping[float, tuple[float, float]] | None = None) -> DataFrame:
    """(ticker, h, level, low, high, neighbors) from one search: outcomes relative to each neighbour's close, at the anchor.

    ``read`` replaces a level's nominal quantiles by calibrated ones.
    """
    steps = near.select("ticker", "i", "anchor", "weight", "neighbors", F.col("close").alias("c"), F.posexplode(F.arrays_zip("fwd_low", "fwd_high")).alias("k", "f"))
    steps = steps.select("ticker", "i", "anchor", "weight", "neighbors", (F.col("k") + 1).alias("h"), quotient(F.col("f.fwd_low") - F.col("c"), "c").alias("low"), quotient(F.col("f.fwd_high") - F.col("c"), "c").alias("high"))
    at = {float(lv): (read or {}).get(lv, ((100 - lv) / 200, (100 + lv) / 200)) for lv in levels}
    by = ("ticker", "h", "anchor", "neighbors")
    # both sides in one pass, a row for each; a quantile belongs to the levels that read it on its side
    sides = steps.select(*by, "i", "weight", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in ("low", "high")])).alias("v"))
    read_ = weighted_quantiles(sides.select(*by, "i", "weight", "v.*"), "value", "weight", sorted({float(q) for pair in at.values() for q in pair}), (*by, "side"), ("i",))
    table = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(s).alias("s"), F.lit(float(q)).alias("x")) for lv, pair in at.items() for s, q in zip(("low", "high"), pair, strict=True)])
    mine = read_.select(*by, "side", "quantile", F.explode(F.filter(table, lambda z: (z["s"] == F.col("side")) & (z["x"] == F.col("q")))).alias("z"))
    price = lambda s: (F.col("anchor") * (1 + F.max(F.when(F.col("side") == s, F.col("quantile"))))).alias(s)
    return mine.groupBy(*by, F.col("z.level").alias("level")).agg(price("low"), price("high")).select("ticker", "h", "level", "low", "high", "neighbors")


def unconditional(bars: DataFrame, ahead: int = 5, theiler: int = 5, levels: Sequence[float] = (50, 75, 90)) -> DataFrame:
    """The zones that all past windows give alike: what a forecast has to beat."""
    rows = ranks.forward_extremes(trend.with_position(bars), ahead).withColumn("origin", F.max("i").over(whole()))
    anchor = F.max(F.when(F.col("i") == F.col("origin"), F.col("close"))).over(whole())
    known = rows.withColumn("anchor", anchor).where((F.col("i") < F.col("origin") - theiler) & F.col("fwd_low").isNotNull())
    known = known.withColumns({"weight": F.lit(1.0), "neighbors": F.count("*").over(W.partitionBy("ticker"))}).where("neighbors >= 20")
    return zones(known, ahead, levels)
