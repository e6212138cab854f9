"""Moving averages; null until the window is full."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recurrence import System, run
from .window import BY, Names, full, numbered, trailing, whole, with_position


def sma(bars: DataFrame, period: int, value: str = "close", name: str = "sma", by: Names = BY, order: str = "begin") -> DataFrame:
    """Mean of the last ``period`` values."""
    return bars.withColumn(name, full(F.avg(value), value, trailing(period, by, order), period))


def wma(bars: DataFrame, period: int, value: str = "close", name: str = "wma", by: Names = BY, order: str = "begin") -> DataFrame:
    """Mean of the last ``period`` values with weights 1 ... ``period``, the newest weighing most."""
    frame = trailing(period, by, order)
    held = F.collect_list(value).over(frame)
    weighed = F.aggregate(F.transform(held, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return bars.withColumn(name, F.when(F.count(value).over(frame) == period, weighed / (period * (period + 1) / 2)))


def ema(bars: DataFrame, period: int, value: str = "close", name: str = "ema", by: Names = BY, order: str = "begin", chunk: int | None = None) -> DataFrame:
    """Exponential mean: starts as the mean of the first ``period`` values, then moves by 2 / (``period`` + 1).

    A recurrence, so a series is one group of a grouped map, or with ``chunk``
    groups of so many rows; only its keys, order and value go through Python.
    Null values are an error of the input and give null from there on.
    """
    alpha = 2 / (period + 1)
    rows = bars.select(*by, order, value)
    opening = F.when(F.col("i") < period, F.col(value))
    if chunk:
        placed = numbered(rows, by, order)
        firsts = placed.where(F.col("i") < period).groupBy(*by).agg(F.avg(value).alias("_first"), F.count(value).alias("_known"))
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
        placed = placed.alias("x").join(firsts.alias("y"), on).select("x.*", "y._first", "y._known")
    else:
        placed = with_position(rows, by, order).withColumns({"_first": F.avg(opening).over(whole(by)), "_known": F.count(opening).over(whole(by))})
    # the mean comes in where the average starts, and nothing before
    start = F.when(F.col("_known") == period, F.col("_first") / alpha)
    pushed = placed.select(*by, order, "i", F.when(F.col("i") < period - 1, 0.0).when(F.col("i") == period - 1, start).otherwise(F.col(value)).alias("_in"))
    found = run(pushed, System([[1 - alpha]], [alpha], [[1 - alpha]], [alpha]), "_in", [name], by, order, chunk, ["i"])
    return found.select(*by, order, F.when(F.col("i") >= period - 1, F.col(name)).alias(name))


KINDS = {"sma": sma, "wma": wma, "ema": ema}


def moving_averages(bars: DataFrame, wanted: Iterable[tuple[str, int]], value: str = "close", by: Names = BY, order: str = "begin") -> DataFrame:
    """Long form (series, begin, kind, period, value) of several averages.

    An unknown kind counts as ``sma``. Periods below 2, and periods longer than
    a series, give no rows.
    """
    out = None
    for kind, period in wanted:
        if period < 2:
            continue
        kind = kind if kind in KINDS else "sma"
        found = KINDS[kind](bars, period, value, "average", by, order).select(*by, order, F.lit(kind).alias("kind"), F.lit(period).cast("long").alias("period"), "average")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = bars.select(*by, order, F.lit("").alias("kind"), F.lit(0).cast("long").alias("period"), F.lit(0.0).alias("average")).limit(0)
    return out.where("average is not null")
