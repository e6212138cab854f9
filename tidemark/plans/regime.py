"""Scenarios: analogs of the same volatility regime, several lagged searches pooled, and mixtures fitted to their paths.

An origin has its own trend line, so (ticker, back) is a series of ratios of its
own; ``back`` counts origins from the last one. Filters, regimes, searches,
weights and paths are columns over windows of one partitioning; only the filters'
recurrence and the fit of a mixture run in Python, on groups of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import total
from ..operators.spectral import CUTOFFS, filter_bank, pair_lags
from ..operators.trend import anchored
from ..operators.window import whole, with_position
from ..sources.shared import written


@dataclass(frozen=True)
class Settings:
    horizon: int = 30
    theta: float = 5.0
    warmup: int = 250
    theiler: int = 20
    bars: int = 3000
    lookback: int = 8
    lookback_step: int = 1
    volatility: int = 60
    least: int = 15
    least_regime: int = 30
    sample: int = 1500


def origins(bars: DataFrame, n: int, step: int = 1) -> DataFrame:
    """``bars`` once for each of the last ``n`` origins of a series, ``step`` apart: those up to it, with ``back`` = 0, 1, ..."""
    placed = with_position(bars).withColumn("_last", F.max("i").over(whole()))
    out = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("back"))
    return out.where((F.col("i") <= F.col("_last") - F.col("back") * step) & (F.col("_last") - F.col("back") * step >= 10)).drop("_last")


GROUP = ("ticker", "back")
#: The features of a place: each component now and at its lags.
FEATURES = [(k, lag) for k, three in enumerate(pair_lags()) for lag in three]


def featured(bars: DataFrame, n: int, step: int, s: Settings) -> DataFrame:
    """The steps of the ratio of each origin's series: ``place`` from 0, ``features``, ``regime``, the ratio, and the ratios of the bars after it.

    The ratio is that over one line fitted up to the origin. Volatility is the
    deviation of the last steps; its terciles over all of the origin's history
    part the regimes 0, 1 and 2, and -1 is where it is not known.
    """
    over = W.partitionBy(*GROUP)
    run = over.orderBy("i")
    held = anchored(origins(bars.select("ticker", "begin", "close"), n, step), by=GROUP)
    held = held.withColumn("last", F.max("i").over(over))
    held = held.where(F.col("i") >= F.col("last") - s.bars) if s.bars > 0 else held
    # the place of a step is that of the bar before it among the bars in use
    held = held.withColumns({"place": F.row_number().over(run) - 2, "_step": F.col("ratio_close") - F.lag("ratio_close").over(run)})
    kept = ["i", "last", "place", "close", "ratio_close", "log_a", "log_b", "_step"]
    parts = filter_bank(held, "_step", GROUP, "begin", keep=kept[:-1])
    parts = parts.withColumn("_step", sum((F.col(f"comp_{k}") for k in range(1, len(CUTOFFS) + 1)), F.col("comp_0")))
    width = run.rowsBetween(1 - s.volatility, 0)
    parts = parts.withColumn("vol", F.when(F.count("*").over(width) == s.volatility, F.stddev_pop("_step").over(width)))
    parts = parts.withColumns({
        "features": F.array(*[F.lag(f"comp_{k}", lag).over(run) for k, lag in FEATURES]),
        "ahead": F.collect_list("ratio_close").over(run.rowsBetween(1, s.horizon + s.lookback * s.lookback_step)),
        "cuts": F.when(F.count("vol").over(over) > 10, F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(over)),
    })
    label = F.when(F.col("vol").isNull(), -1).when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("vol"))))
    return parts.withColumn("regime", label.cast("int")).select(*GROUP, "begin", *kept[:-1], "features", "ahead", "regime")


def pools(steps: DataFrame, s: Settings) -> DataFrame:
    """(ticker, back, search, place, weight, ...): places after which a series went on as it may after an origin.

    A search starts at the origin's last bar or some bars before it; its paths
    run on to the same horizon. Candidates lie within the warmed-up past whose
    paths are complete; of these, those further than ``theiler`` if enough
    remain, and of these, those of the search's regime if enough remain.
    Features are scaled by their deviation over the pool; the kernel is Gaussian
    with the mean distance over theta. Each search weighs the same, and searches
    with fewer than ``least`` candidates have none.
    """
    first = max(s.warmup, max(lag for _, lag in FEATURES))
    searches = F.array(*[F.lit(k) for k in range(0, s.lookback * s.lookback_step + 1, s.lookback_step)])
    starts = steps.select(*GROUP, F.col("i").alias("_i"), F.col("last").alias("_last"), F.explode(searches).alias("search"), F.col("place").alias("from_place"), F.col("features").alias("query"), F.col("regime").alias("from_regime"), F.col("ratio_close").alias("from_ratio"))
    starts = starts.where(F.col("_i") == F.col("_last") - F.col("search")).drop("_i", "_last")
    pairs = steps.join(starts, list(GROUP)).where((F.col("place") >= first) & (F.col("place") <= F.col("from_place") - s.horizon - F.col("search")))
    group = W.partitionBy(*GROUP, "search")
    far = F.col("from_place") - F.col("place") > s.theiler
    pairs = pairs.withColumns({"_n": F.count("*").over(group), "_far": F.count(F.when(far, 1)).over(group)}).where(F.col("_n") >= s.least)
    if s.theiler > 0:
        pairs = pairs.where(far | (F.col("_far") < s.least))
    same = F.col("regime") == F.col("from_regime")
    pairs = pairs.withColumn("_same", F.count(F.when(same, 1)).over(group))
    pairs = pairs.where(same | (F.col("_same") < s.least_regime) | (F.col("from_regime") < 0))
    scaled = F.array(*[F.pow((F.get("features", F.lit(c)) - F.get("query", F.lit(c))) / F.greatest(F.stddev_pop(F.get("features", F.lit(c))).over(group), F.lit(1e-12)), 2) for c in range(len(FEATURES))])
    pairs = pairs.withColumn("d", F.sqrt(total(scaled)))
    mean = F.avg("d").over(group)
    width = F.when(mean > 0, mean).otherwise(1.0) / s.theta
    pairs = pairs.withColumn("w", F.exp(-0.5 * F.pow(F.col("d") / width, 2))).withColumn("_sum", F.sum("w").over(group)).where("_sum > 0")
    found = F.size(F.collect_set("search").over(W.partitionBy(*GROUP)))
    return pairs.withColumn("weight", F.col("w") / F.col("_sum") / found).select(*GROUP, "search", "place", "weight", "from_ratio", "ratio_close", "ahead", "d")


#: Steps of a fit at most, and the gain in mean log-likelihood below which it ends.
STEPS, GAIN = 100, 1e-5


def mixture(x: np.ndarray, w: np.ndarray, n: int) -> list[tuple[float, float, float]]:
    """(mean, std, weight) of the normal mixture of one, two or three parts with the least BIC, heaviest part first.

    Expectation-maximisation on weighted points, started at their quantiles;
    ``n`` is the sample size that the points stand for.
    """
    w = w / w.sum()
    mean = float(w @ x)
    spread = float(np.sqrt(w @ (x - mean) ** 2))
    if spread < 1e-12:
        return [(mean, spread, 1.0)]
    order = np.argsort(x, kind="stable")
    middle = np.cumsum(w[order]) - 0.5 * w[order]
    best = None
    for k in (1, 2, 3):
        mu = np.interp((np.arange(k) + 0.5) / k, middle, x[order])
        sd, share = np.full(k, spread / k), np.full(k, 1.0 / k)
        before = -np.inf
        for _ in range(STEPS):
            log = (np.log(share) - np.log(sd) - 0.5 * np.log(2 * np.pi))[:, None] - 0.5 * ((x - mu[:, None]) / sd[:, None]) ** 2
            top = log.max(axis=0)
            part = np.exp(log - top)
            total = part.sum(axis=0)
            now = float(w @ (top + np.log(total)))
            part *= w / total
            mass = np.maximum(part.sum(axis=1), 1e-300)
            mu, share = part @ x / mass, np.maximum(mass / mass.sum(), 1e-12)
            sd = np.sqrt(np.maximum((part * (x - mu[:, None]) ** 2).sum(axis=1) / mass, (1e-3 * spread) ** 2))
            if now - before < GAIN:
                break
            before = now
        bic = -2 * n * now + (3 * k - 1) * np.log(n)
        if best is None or bic < best[0]:
            best = bic, [(float(mu[j]), float(sd[j]), float(share[j])) for j in np.argsort(-share, kind="stable")]
    return best[1]


MIXTURES = "ticker string, back int, origin timestamp, origin_price double, regime int, h int, part int, mean double, std double, weight double"


def price_paths(bars: DataFrame, n: int = 1, step: int = 1, settings: Settings = Settings()) -> DataFrame:
    """(ticker, back, origin, origin_price, regime, path, weight, h, price): weighted price paths of each origin. Origins with too little history have none."""
    s = settings
    steps = written(featured(bars, n, step, s), "steps")  # read for the searches and their candidates
    heads = steps.where("i = last").select(*GROUP, F.col("begin").alias("origin"), F.col("close").alias("origin_price"), "regime", "last", "log_a", "log_b")
    found = pools(steps, s).withColumn("path", F.row_number().over(W.partitionBy(*GROUP).orderBy("search", "place")) - 1)
    moved = F.slice("ahead", F.col("search") + 1, F.lit(s.horizon))
    found = found.select(*GROUP, "path", "weight", F.posexplode(F.transform(moved, lambda x: F.col("from_ratio") + x - F.col("ratio_close"))).alias("at", "ratio"))
    line = F.exp(F.col("log_a") + F.col("log_b") * (F.col("last") + F.col("at") + 1))
    return found.join(heads, list(GROUP)).select("ticker", "back", "origin", "origin_price", "regime", "path", "weight", (F.col("at") + 1).alias("h"), (F.col("ratio") * line).alias("price"))


def scenarios(bars: DataFrame, n: int = 10, step: int = 1, settings: Settings = Settings()) -> DataFrame:
    """Mixtures of each origin and step ahead, one row for each part; (ticker, back, h) is a group of bounded size, the origin's paths."""
    heads = ["ticker", "back", "origin", "origin_price", "regime", "h"]

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0][heads].to_dict()
        parts = mixture(frame["price"].to_numpy(), frame["weight"].to_numpy(), settings.sample)
        return pd.DataFrame([{**head, "part": k, "mean": m, "std": sd, "weight": w} for k, (m, sd, w) in enumerate(parts)])

    paths = price_paths(bars, n, step, settings)
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fits are slow for their rows: adaptive execution is not to merge them
    return paths.repartition(4 * tasks, "ticker", "back", "h").groupBy("ticker", "back", "h").applyInPandas(work, MIXTURES)


def dominant(mixtures: DataFrame) -> DataFrame:
    """(ticker, back, direction): whether the heaviest part at the last step ahead lies above (1) or below (-1) the origin's price."""
    last = mixtures.groupBy("ticker", "back", "origin_price").agg(F.max_by("mean", F.struct("h", "weight")).alias("_mean"))
    return last.select("ticker", "back", F.when(F.col("_mean") >= F.col("origin_price"), 1).otherwise(-1).alias("direction"))
