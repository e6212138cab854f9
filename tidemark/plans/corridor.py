"""The risk corridor: where price may go, by paths that add up steps of past analogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import student_kernel, uniform
from ..operators import ranks, trend
from ..operators.neighbors import apart, normalised, with_amp_cos
from ..operators.window import series, whole
from ..sources.shared import written

PRICES = ("close", "high", "low")
#: Equal parts of [0, 1) in which draws look for their analog.
GUIDE = 1024


def steps(bars: DataFrame, p: int = 20) -> DataFrame:
    """Bars over the trend line of the last bar: ratio and its step d_<price> for each price, and the window of the last ``p`` close steps."""
    out = trend.anchored(bars, PRICES)
    out = out.withColumns({f"d_{x}": F.col(f"ratio_{x}") - F.lag(f"ratio_{x}").over(series()) for x in PRICES})
    return ranks.delay_windows(out, p, "d_close").withColumn("origin", F.max("i").over(whole()))


def pool(rows: DataFrame, p: int = 20, h: int = 20, theta: float = 20.0, alpha: float = 0.75, margin: int = 5, least: int = 15) -> DataFrame:
    """(ticker, i, d, weight): bars whose window is like the last one, more than p + ``margin`` bars before it and ``h`` from its end.

    Weights follow a Student kernel with one degree of freedom, of a width of
    the mean distance over ``theta``; tickers with fewer than ``least`` give none.
    """
    query = rows.where("i = origin").select("ticker", F.col("window").alias("query"))
    near = rows.where(F.col("window").isNotNull() & (F.col("i") <= F.col("origin") - h) & apart("i", "origin", p + margin)).select("ticker", "i", "window").join(query, "ticker")
    over = W.partitionBy("ticker")
    near = with_amp_cos(near.withColumn("_n", F.count("*").over(over)).where(F.col("_n") >= least), alpha, ("ticker",))
    mean = F.avg("d").over(over)
    width = F.when(mean > 0, mean).otherwise(1.0) / theta
    near = near.withColumn("_width", width)
    return normalised(near.withColumn("weight", student_kernel("d", "_width")), ("ticker",)).select("ticker", "i", "d", "weight")


def expected(rows: DataFrame, analogs: DataFrame, h: int) -> DataFrame:
    """(ticker, h, price): the weighted mean of the paths that go on as each analog did, over the trend line."""
    origin = rows.where("i = origin").select("ticker", "origin", "log_a", "log_b", "ratio_close")
    starts = analogs.select("ticker", "i", "weight", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(h).cast("long"))).alias("h"))
    moved = starts.withColumn("_at", F.col("i") + F.col("h")).join(rows.select("ticker", F.col("i").alias("_at"), "d_close"), ["ticker", "_at"])
    mean = moved.groupBy("ticker", "h").agg(F.sum(F.col("weight") * F.col("d_close")).alias("_d"))
    path = F.sum("_d").over(W.partitionBy("ticker").orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    line = F.exp(F.col("log_a") + F.col("log_b") * (F.col("origin") + F.col("h")))
    return mean.withColumn("_path", path).join(origin, "ticker").select("ticker", "h", ((F.col("ratio_close") + F.col("_path")) * line).alias("price"))


def drawn(analogs: DataFrame, n: int, h: int) -> DataFrame:
    """(ticker, sim, h, i): an analog for each path and step, as often as its weight says.

    Draws are hashes of (path, step), the same in every run. A guide table lists,
    for each of ``GUIDE`` equal parts of [0, 1), the analogs whose share of the
    running total of weights reaches into it: a draw meets the few of its part
    by an equi-join, and no draw is sorted.
    """
    over = W.partitionBy("ticker").orderBy("i")
    totals = analogs.select("ticker", "i", F.sum("weight").over(over.rowsBetween(W.unboundedPreceding, 0)).alias("hi"))
    ranges = totals.select("ticker", "i", F.coalesce(F.lag("hi").over(over), F.lit(-1.0)).alias("lo"), F.when(F.lead("i").over(over).isNull(), 2.0).otherwise(F.col("hi")).alias("hi"))
    part = lambda c: F.floor(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) * GUIDE)
    guide = ranges.where("lo < 1").select("ticker", "i", "lo", "hi", F.explode(F.sequence(part(F.col("lo")), F.least(part(F.col("hi")), F.lit(GUIDE - 1).cast("long")))).alias("_part"))
    # the draws are the same for every ticker, and a range is made by many tasks
    each = analogs.sparkSession.range(n).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(h).cast("long"))).alias("h"))
    each = each.withColumn("at", uniform(F.col("sim"), F.col("h"))).withColumn("_part", part(F.col("at")))
    return each.join(guide, "_part").where("lo < at and at <= hi").select("ticker", "sim", "h", "i")


def paths(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """(ticker, sim, h, close, high, low, run_high, run_low): prices of the paths, and their extremes so far without the origin.

    A step adds what the drawn analog really did ``h`` bars after its window,
    for close, high and low together.
    """
    origin = rows.where("i = origin").select("ticker", "origin", "log_a", "log_b", *[F.col(f"ratio_{x}").alias(f"o_{x}") for x in PRICES])
    moved = draws.withColumn("_at", F.col("i") + F.col("h")).join(rows.select("ticker", F.col("i").alias("_at"), *[f"d_{x}" for x in PRICES]), ["ticker", "_at"])
    over = W.partitionBy("ticker", "sim").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    line = F.exp(F.col("log_a") + F.col("log_b") * (F.col("origin") + F.col("h")))
    out = moved.join(origin, "ticker").withColumns({x: (F.col(f"o_{x}") + F.sum(f"d_{x}").over(over)) * line for x in PRICES})
    return out.withColumns({"run_high": F.max("high").over(over), "run_low": F.min("low").over(over)}).select("ticker", "sim", "h", *PRICES, "run_high", "run_low")


def bounds(found: DataFrame, percent: float = 95.0) -> DataFrame:
    """(ticker, h, close_low, close_high, risk_low, risk_high): where ``percent`` of closes lie, and of extremes on the way.

    Paths weigh the same, so a quantile is read from the sorted values of a step,
    one for each path, with lines between the middles of their weights.
    """
    tail = (100.0 - percent) / 200.0
    steps = found.groupBy("ticker", "h").agg(F.count("*").alias("n"), *[F.sort_array(F.collect_list(v)).alias(v) for v in ("close", "run_low", "run_high")])

    def read(value: str, q: float) -> Column:
        at = F.greatest(F.least(F.lit(q) * F.col("n") - 0.5, F.col("n") - 1.0), F.lit(0.0))
        low = F.floor(at)
        below, above = F.get(value, low.cast("int")), F.get(value, F.least(low + 1, F.col("n") - 1).cast("int"))
        return below + (at - low) * (above - below)

    return steps.select(
        "ticker", "h", read("close", tail).alias("close_low"), read("close", 1 - tail).alias("close_high"),
        read("run_low", tail).alias("risk_low"), read("run_high", 1 - tail).alias("risk_high"),
    )


def corridor(bars: DataFrame, p: int = 20, h: int = 20, theta: float = 20.0, alpha: float = 0.75, n: int = 15_000, percent: float = 95.0) -> DataFrame:
    """The corridor of each ticker from its last bar; steps, analogs and paths are written, as each is read more than once."""
    rows = written(steps(bars, p), "steps")
    analogs = written(pool(rows, p, h, theta, alpha), "analogs")
    return bounds(written(paths(rows, drawn(analogs, n, h)), "paths"), percent)
