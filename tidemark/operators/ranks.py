"""Causal ranks and raw features of bars, volatility regimes, outcomes ahead, delay windows.

Expects bars with log_high, log_low, mid and volume (``bars.logged``). All frames
end at the row or before it, but those of ``forward_extremes``, which are outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .window import BY, Names, following, full, preceding, series, trailing, whole

WINDOW, BINS = 252, 40
#: The features that are ranked, volume by its profile and the others among their past values.
FEATURES = ("volume", "trend", "velocity", "acceleration", "volatility")


def percentile_rank(value: str, window: int = WINDOW, least: int = 10, by: Names = BY, order: str = "begin", whole_frame: bool = True) -> Column:
    """The share of the known values of the ``window`` rows before that lie below the row's.

    Null without ``least`` known values, and (``whole_frame``) without ``window`` rows before.
    """
    frame = preceding(window, by, order)
    known = F.collect_list(value).over(frame)
    x = F.col(value)
    share = F.size(F.filter(known, lambda h: h < x)) / F.size(known)
    enough = x.isNotNull() & (F.size(known) >= least)
    if whole_frame:
        enough = enough & (F.count(F.lit(1)).over(frame) == window)
    return F.when(enough, share)


def density_rank(bars: DataFrame, window: int = WINDOW, bins: int = BINS, by: Names = BY, order: str = "begin") -> DataFrame:
    """``bars`` with rank_volume: the share of volume below the bar's mid price in the profile of the ``window`` bars before.

    The profile has equal bins between the lowest low and the highest high; the
    bar's own bin counts half. Null for a flat profile or one without volume.
    """
    frame = preceding(window, by, order)
    bars = bars.withColumns({
        "_low": F.min("log_low").over(frame), "_high": F.max("log_high").over(frame),
        "_held": F.collect_list(F.struct("mid", "volume")).over(frame), "_total": F.sum("volume").over(frame),
    })
    span = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    place = lambda m: F.floor((m - F.col("_low")) / span * bins)
    bars = bars.withColumn("_own", F.greatest(F.least(place(F.col("mid")), F.lit(bins - 1)), F.lit(0)))
    part = lambda b: F.least(place(b["mid"]), F.lit(bins - 1))
    share = lambda b: F.when(part(b) < F.col("_own"), b["volume"]).when(part(b) == F.col("_own"), b["volume"] / 2.0).otherwise(0.0)
    mass = F.aggregate("_held", F.lit(0.0), lambda a, b: a + share(b))
    known = (F.size("_held") == window) & (F.col("_high") > F.col("_low")) & (F.col("_total") > 0)
    return bars.withColumn("rank_volume", F.when(known, mass / F.col("_total"))).drop("_low", "_high", "_held", "_total", "_own")


def raw_features(bars: DataFrame, average: int = 100, lag: int = 10, volatility: int = 20, by: Names = BY, order: str = "begin") -> DataFrame:
    """``bars`` with trend_raw, velocity_raw, acceleration_raw and volatility_raw of the mid price."""
    over = series(by, order)
    back = {k: F.lag("mid", k).over(over) for k in (1, lag, 2 * lag)}
    bars = bars.withColumns({"_ret": F.col("mid") - back[1], "_v": F.col("mid") - back[lag], "_w": back[lag] - back[2 * lag]})
    return bars.withColumns({
        "trend_raw": F.col("mid") - full(F.avg("mid"), "mid", preceding(average, by, order), average),
        "velocity_raw": F.col("_v"),
        "acceleration_raw": F.col("_v") - F.col("_w"),
        "volatility_raw": full(F.stddev_samp("_ret"), "_ret", trailing(volatility, by, order), volatility),
    }).drop("_ret", "_v", "_w")


def bar_ranks(bars: DataFrame, window: int = WINDOW, bins: int = BINS, by: Names = BY, order: str = "begin") -> DataFrame:
    """``bars`` with rank_<feature> for the five features; raw features are kept."""
    raw = raw_features(bars, by=by, order=order)
    ranks = {f"rank_{f}": percentile_rank(f"{f}_raw", window, by=by, order=order) for f in FEATURES[1:]}
    return density_rank(raw.withColumns(ranks), window, bins, by, order)


def rolling_volatility(steps: DataFrame, window: int = 60, value: str = "dratio", by: Names = BY, order: str = "begin") -> DataFrame:
    """``steps`` with vol, the population deviation of the last ``window`` values."""
    return steps.withColumn("vol", full(F.stddev_pop(value), value, trailing(window, by, order), window))


def regimes(steps: DataFrame, value: str = "vol", least: int = 10, by: Names = BY) -> DataFrame:
    """``steps`` with regime: how many terciles of the series' values lie below the row's; -1 if it is null.

    With ``least`` known values or fewer there are no terciles, and the regime is 0.
    The terciles use all rows that are given, so cut them at the origin first.
    """
    over = whole(by)
    cuts = F.when(F.count(value).over(over) > least, F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).over(over))
    steps = steps.withColumn("_cuts", cuts)
    above = sum(F.coalesce(F.get("_cuts", F.lit(k)) < F.col(value), F.lit(False)).cast("int") for k in (0, 1))
    return steps.withColumn("regime", F.when(F.col(value).isNull(), -1).otherwise(above)).drop("_cuts")


def forward_extremes(bars: DataFrame, ahead: int, by: Names = BY, order: str = "begin") -> DataFrame:
    """``bars`` with arrays fwd_low and fwd_high: the lowest low and highest high of the next h = 1 ... ``ahead`` bars.

    Null unless all ``ahead`` bars are there.
    """
    enough = F.count("low").over(following(ahead, by, order)) == ahead
    lows = F.array(*[F.min("low").over(following(h, by, order)) for h in range(1, ahead + 1)])
    highs = F.array(*[F.max("high").over(following(h, by, order)) for h in range(1, ahead + 1)])
    return bars.withColumns({"fwd_low": F.when(enough, lows), "fwd_high": F.when(enough, highs)})


def delay_windows(rows: DataFrame, p: int, value: str, name: str = "window", by: Names = BY, order: str = "begin") -> DataFrame:
    """``rows`` with the array of the last ``p`` values, oldest first; null unless all are known."""
    frame = trailing(p, by, order)
    held = F.collect_list(value).over(frame)
    return rows.withColumn(name, F.when(F.size(held) == p, held))
