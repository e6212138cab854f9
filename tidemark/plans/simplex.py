"""The trajectory ensemble: recursive nearest-neighbour forecasts from several origins and dimensions.

Smoothing is a group for each series and dimension; every path is a group of its
own (series, origin, dimension), which holds the series up to its origin. Means
over dimensions, trend lines and returns are columns.

Prices below ``FLOOR`` count as that in trend lines, so that a price of 0 leaves
a line. Windows that hold a value that is no finite number are nobody's
neighbours; numbers whose squares are too large are scaled before.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import quotient
from ..operators.quantile import weighted_quantiles
from ..operators.trend import causal_trend

#: Prices and trends below this count as it.
FLOOR = 1e-10
#: Squares of larger numbers are not taken: what holds any is scaled before.
LARGE = 1e100


@dataclass(frozen=True)
class Settings:
    """Fit length is ``slope`` * d + ``offset``; K = 3 * (p + 1) + ``extra`` neighbours make local planes."""

    horizon: int = 20
    slope: int = 3
    offset: int = 0
    extra: int = 1
    alpha: float = 0.5
    levels: int = 6
    longest: int = 5000
    bars: int = 0
    p_range: tuple[int, int] = (3, 150)
    thresholds: tuple[float, float] = (0.80, 0.85)
    correct: bool = True


def windows(x: np.ndarray, p: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, p)


def finite(x: np.ndarray, p: int) -> np.ndarray:
    """Whether the windows of length ``p`` hold finite numbers only."""
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    return bad[p:] == bad[:-p]


def power_of(top: np.ndarray | float) -> np.ndarray | float:
    """The power of two by which numbers up to ``top`` are divided; 1 unless they are large."""
    return np.where(top > LARGE, np.exp2(np.frexp(top)[1] - 1.0), 1.0)


def amp_cos(rows: np.ndarray, q: np.ndarray, alpha: float) -> np.ndarray:
    """The blend of size and direction of ``neighbors.with_amp_cos``, over one set of rows of finite numbers."""
    with np.errstate(over="ignore"):
        parts, part = np.sqrt((rows * rows).sum(axis=1)), float(np.sqrt(q @ q))
    sizes, size = parts, part
    if max(sizes.max(initial=0.0), size) > LARGE:
        power, q_power = power_of(np.abs(rows).max(axis=1)), power_of(np.abs(q).max())
        rows, q = rows / power[:, None], q / q_power
        parts, part = np.sqrt((rows * rows).sum(axis=1)), float(np.sqrt(q @ q))
        sizes, size = parts * power, part * float(q_power)
    shape = np.ones(len(rows))
    amp = np.abs(sizes - size)
    if size >= 1e-10:
        some = sizes > 1e-10
        shape[some] = 1 - np.clip(rows[some] @ q / (parts[some] * part), -1, 1)
        amp[some] = np.abs(np.log(sizes[some] / size))
    return alpha * amp / max(amp.max(), 1e-10) + (1 - alpha) * shape / max(shape.max(), 1e-10)


def nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest; ties go to the smaller place."""
    return np.argsort(d, kind="stable")[:k]


def on_plane(rows: np.ndarray, x: np.ndarray, d: int) -> float:
    """The last coordinate of ``x`` projected on the plane of the first ``d`` principal directions of ``rows``."""
    top = max(np.abs(rows).max(), np.abs(x).max())
    if top > LARGE:
        return float(power_of(top) * on_plane(rows / power_of(top), x / power_of(top), d))
    center = rows.mean(axis=0)
    moved = rows - center
    axes = np.linalg.eigh(moved.T @ moved)[1][:, ::-1][:, :d].T
    return float((center + axes.T @ (axes @ (x - center)))[-1])


def dimension(x: np.ndarray, p: int, k: int, share: float, alpha: float) -> int | None:
    """How many principal directions hold ``share`` of the variance of the ``k`` windows nearest to the last one."""
    if len(x) - p < max(k, 1):
        return None
    known, last = finite(x, p), x[-p:]
    library = windows(x[:-1], p) if known.all() else windows(x[:-1], p)[known[:-1]]
    if not known[-1] or len(library) < max(k, 1):
        return None
    near = library[nearest(amp_cos(library, last, alpha), k)]
    if len(near) < 2:
        return None
    near = near / power_of(np.abs(near).max())
    moved = near - near.mean(axis=0)
    variance = np.maximum(np.linalg.eigvalsh(moved.T @ moved)[::-1], 0.0)
    reached = np.cumsum(variance) / max(variance.sum(), 1e-14)
    return min(int(np.searchsorted(reached, share)) + 1, p)


def dimensions(x: np.ndarray, s: Settings) -> list[int]:
    """The dimensions to try: from the mean dimension at the lower threshold to that at the upper one."""
    means = []
    for share in s.thresholds:
        found = [dimension(x, p, 3 * (p + 1) + s.extra, share, s.alpha) for p in range(s.p_range[0], s.p_range[1] + 1)]
        found = [f for f in found if f is not None]
        if not found:
            return []
        means.append(float(np.mean(found)))
    low = max(2, int(np.floor(means[0])))
    return list(range(low, max(low, int(np.ceil(means[1]))) + 1))


def smoothed(x: np.ndarray, p: int, d: int, k: int, alpha: float) -> np.ndarray:
    """``x`` with each value moved to the local plane of earlier windows like its own; looks back only."""
    d = min(d, p - 1)
    out = x.copy()
    if d < 1 or len(x) <= p:
        return out
    rows, known = windows(x, p), finite(x, p)
    for at in range(d + 1, len(rows)):
        past = rows[:at] if known[:at].all() else rows[:at][known[:at]]
        if known[at] and min(k, len(past)) >= d + 1:
            out[at + p - 1] = on_plane(past[nearest(amp_cos(past, rows[at], alpha), k)], rows[at], d)
    return out


def candidates(x: np.ndarray, context: np.ndarray, p: int, k: int, s: Settings, at: int) -> np.ndarray:
    """Starts of windows of length ``p`` that are left after a search from long windows to short ones.

    Lengths halve from p * 2^(levels - 1), leaving out those above ``longest``;
    each level keeps the ``k`` nearest starts, and the next one looks within
    them. The last level is the last of the lengths that are left. Lengths at
    which the context is not finite are left out, and so are such windows and outcomes.
    """
    lengths = [n for n in (p << j for j in reversed(range(s.levels))) if n <= s.longest] or [p]
    lengths = [n for n in lengths if np.isfinite(context[-n:]).all()]
    if not lengths:
        return np.arange(0)
    latest = lambda n: min(len(x) - n, at - n - 1)
    pool = np.arange(latest(lengths[0]) + 1)
    pool = pool[finite(x, lengths[0])[pool]]
    if len(pool) < k:
        return pool[:0]
    for n, shorter in zip(lengths, [*lengths[1:], None], strict=True):
        pool = pool[pool + n <= len(x)]
        pool = pool[finite(x, n)[pool]]
        if len(context) < n or not len(pool):
            return pool[:0]
        if shorter is None:
            pool = pool[pool + p < len(x)]
            return pool[np.isfinite(x[pool + p])]
        near = pool[nearest(amp_cos(windows(x, n)[pool], context[-n:], s.alpha), k)]
        wider = np.unique(near[:, None] + np.arange(n - shorter + 1))
        pool = wider[wider <= latest(shorter)]
    return pool


def trajectory(x: np.ndarray, p: int, d: int, s: Settings) -> np.ndarray | None:
    """``horizon`` values after ``x``: each the weighted outcome of d + 1 neighbours of the values before; None without enough of them."""
    held = x.tolist()
    library = windows(x, p)[:-1] if len(x) > p else None
    if library is not None and not np.isfinite(x).all():
        library = library[finite(x, p)[:-1]]
    for _ in range(s.horizon):
        context = np.array(held)
        pool = candidates(x, context, p, d + 1, s, len(held))
        if len(pool) < d + 2:
            return None
        rows = windows(x, p)[pool]
        far = amp_cos(rows, context[-p:], s.alpha)
        near = nearest(far, d + 1)
        w = np.exp(-far[near] / max(far[near].min(), 1e-10))
        value = float(w @ x[pool[near] + p] / w.sum())
        if s.correct and library is not None:
            k = min(3 * (p + 1) + s.extra, len(library))
            guess = np.array([*held[len(held) - p + 1 :], value])
            if k >= d + 1 and np.isfinite(value):
                value = on_plane(library[nearest(amp_cos(library, guess, s.alpha), k)], guess, d)
        held.append(value)
    return np.array(held[len(x) :])


def _fits(n: int, p: int, s: Settings) -> bool:
    """Whether a series of ``n`` values is long enough for windows of ``p``."""
    first = max((x for x in (p << j for j in range(s.levels)) if x <= s.longest), default=p)
    return p >= 2 and n >= first + p + 1


def ensemble(bars: DataFrame, n: int = 20, settings: Settings = Settings()) -> DataFrame:
    """(ticker, back, origin, origin_price, dims, h, rel): paths of the last ``n`` origins as returns, means over the dimensions.

    Dimensions are chosen once for a series, at its last origin. Smoothing looks
    back only, so a series is smoothed once for each dimension and every origin
    reads it up to its own bar; only where ``bars`` cuts an origin's past does
    each origin smooth its own. Origins with too little history, or too few
    neighbours in every dimension, have no rows. From a price of 0 returns are
    infinite or no numbers.
    """
    s = settings
    rows = causal_trend(bars.select("ticker", "begin", "close"), floor=FLOOR).select("ticker", "begin", "close", "i", "ratio", "log_a", "log_b")
    found = rows.groupBy("ticker").applyInPandas(lambda f: _dims(f, s), "ticker string, dims array<int>").select("ticker", F.explode("dims").alias("d"))
    each = rows.select("ticker", "i", F.col("ratio").alias("value")).join(found, "ticker")

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i", kind="stable")
        d = int(frame["d"].iloc[0])
        p = s.slope * d + s.offset
        if _fits(len(frame), p, s):
            frame["value"] = smoothed(frame["value"].to_numpy(dtype=float), p, d, 3 * (p + 1) + s.extra, s.alpha)
        return frame[["ticker", "d", "i", "value"]]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i", kind="stable")
        x, d = frame["value"].to_numpy(dtype=float), int(frame["d"].iloc[0])
        p = s.slope * d + s.offset
        if s.bars > 0:
            x = x[-s.bars :]
        path = None
        if _fits(len(x), p, s):
            x = smoothed(x, p, d, 3 * (p + 1) + s.extra, s.alpha) if s.bars > 0 else x
            path = trajectory(x, p, d, s)
        if path is None:
            return pd.DataFrame(columns=["ticker", "back", "d", "h", "ahead"])
        return pd.DataFrame({"ticker": frame["ticker"].iloc[0], "back": frame["back"].iloc[0], "d": d, "h": np.arange(1, s.horizon + 1), "ahead": path})

    # groups are few and slow, and their rows small: a fixed number of tasks, which adaptive execution would merge
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = each.select("ticker", "d", "i", "value") if s.bars > 0 else each.repartition(tasks, "ticker", "d").groupBy("ticker", "d").applyInPandas(smooth, "ticker string, d int, i long, value double")
    last = rows.groupBy("ticker").agg(F.max("i").alias("_last"))
    origins = rows.join(last, "ticker").where((F.col("i") > F.col("_last") - n) & (F.col("i") >= 10))
    origins = origins.select("ticker", (F.col("_last") - F.col("i")).cast("int").alias("back"), F.col("begin").alias("origin"), F.col("close").alias("origin_price"), F.col("i").alias("_at"), "log_a", "log_b")
    held = values.join(origins.select("ticker", "back", "_at"), "ticker").where(F.col("i") <= F.col("_at")).drop("_at")
    paths = held.repartition(tasks, "ticker", "back", "d").groupBy("ticker", "back", "d").applyInPandas(work, "ticker string, back int, d int, h int, ahead double")
    means = paths.groupBy("ticker", "back", "h").agg(F.avg("ahead").alias("_ahead"), F.count("*").cast("int").alias("dims"))
    line = F.exp(F.col("log_a") + F.col("log_b") * (F.col("_at") + F.col("h")))
    return means.join(origins, ["ticker", "back"]).select("ticker", "back", "origin", "origin_price", "dims", "h", (quotient(F.col("_ahead") * line, "origin_price") - 1).alias("rel"))


def _dims(frame: pd.DataFrame, s: Settings) -> pd.DataFrame:
    ratio = frame.sort_values("i", kind="stable")["ratio"].to_numpy(dtype=float)
    return pd.DataFrame({"ticker": frame["ticker"].iloc[:1].to_list(), "dims": [dimensions(ratio[-s.bars :] if s.bars > 0 else ratio, s)]})


def band(paths: DataFrame, percent: float = 50.0) -> DataFrame:
    """(ticker, h, origins, mean, std, p25, p75, lo, hi): the ensemble at each step, origins weighing the same."""
    tail = (100.0 - percent) / 200.0
    by = ("ticker", "h")
    stats = paths.groupBy(*by).agg(F.count("*").alias("origins"), F.avg("rel").alias("mean"), F.stddev_pop("rel").alias("std"), F.percentile("rel", 0.25).alias("p25"), F.percentile("rel", 0.75).alias("p75"))
    read = weighted_quantiles(paths.withColumn("w", F.lit(1.0)), "rel", "w", (tail, 1 - tail), by, ("back",))
    ends = read.groupBy(*by).agg(F.min_by("quantile", "q").alias("lo"), F.max_by("quantile", "q").alias("hi"))  # what is not a number stays on its side
    return stats.join(ends, list(by))


def direction(paths: DataFrame) -> DataFrame:
    """(ticker, direction): 1 if the mean return at the last step is not below zero, else -1."""
    means = paths.groupBy("ticker", "h").agg(F.avg("rel").alias("_m")).groupBy("ticker").agg(F.max_by("_m", "h").alias("_m"))
    return means.select("ticker", F.when(F.col("_m") >= 0, 1).otherwise(-1).alias("direction"))
