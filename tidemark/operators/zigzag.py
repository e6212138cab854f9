"""Zigzag pivots of bars, the legs between them, and pools of pivots as analogs.

The automaton that finds pivots needs one bar after the other, so a series is one
group of a grouped map (keys, high, low and begin only). Its state is a handful of
numbers; the streaming twin carries the same state from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .ranks import FEATURES, percentile_rank
from .window import BY, Names, series, whole

TOP, BOTTOM = 1, -1


@dataclass
class Walker:
    """The automaton: direction (0 before the first leg), extreme so far, and the bar of the last confirmation."""

    threshold: float
    min_bars: int
    direction: int = 0
    extreme: float | None = None
    extreme_i: int = 0
    confirmed_i: int | None = None
    i: int = 0

    def feed(self, high: float, low: float) -> tuple[float, int, int, int] | None:
        """Takes the next bar's logarithms; a pivot (log price, extreme bar, confirming bar, direction) if the bar confirms one.

        The open leg is never a pivot, and neither is the start.
        """
        i, self.i = self.i, self.i + 1
        if self.extreme is None:
            self.extreme = (high + low) / 2.0
        rise, fall = high - self.extreme, self.extreme - low
        if self.direction == 0:
            if not rise < self.threshold:  # also between two prices of 0
                self._turn(TOP, high, i)
            elif not fall < self.threshold:
                self._turn(BOTTOM, low, i)
            return None
        further, back, opposite = (rise, fall, low) if self.direction == TOP else (fall, rise, high)
        if further > 0:
            self.extreme, self.extreme_i = (high if self.direction == TOP else low), i
        elif not back < self.threshold and (self.confirmed_i is None or i - self.confirmed_i >= self.min_bars):
            pivot = self.extreme, self.extreme_i, i, self.direction
            self.confirmed_i = i
            self._turn(-self.direction, opposite, i)
            return pivot
        return None

    def _turn(self, direction: int, extreme: float, i: int) -> None:
        self.direction, self.extreme, self.extreme_i = direction, extreme, i


def pivots(bars: DataFrame, threshold: float, min_bars: int = 5, by: Names = BY, order: str = "begin") -> DataFrame:
    """Pivots of each series: seq, log_price, extreme_begin, confirm_begin, extreme_i, confirm_i, direction (1 top, -1 bottom).

    ``threshold`` is a difference of logarithms. Expects log_high and log_low
    (``bars.logged``); bars without them are passed by.
    """
    keys = list(by)
    fields = [bars.schema[c] for c in keys]
    time = bars.schema[order].dataType
    schema = T.StructType([
        *fields, T.StructField("seq", T.LongType()), T.StructField("log_price", T.DoubleType()),
        T.StructField("extreme_begin", time), T.StructField("confirm_begin", time),
        T.StructField("extreme_i", T.LongType()), T.StructField("confirm_i", T.LongType()), T.StructField("direction", T.IntegerType()),
    ])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        walker = Walker(threshold, min_bars)
        found = [p for p in (walker.feed(h, lo) for h, lo in zip(frame["log_high"].tolist(), frame["log_low"].tolist(), strict=True)) if p]
        begin = frame[order].to_numpy()
        price, extreme, confirm, direction = zip(*found, strict=True) if found else ((), (), (), ())
        out = pd.DataFrame({"seq": range(len(found)), "log_price": price, "extreme_begin": begin[list(extreme)], "confirm_begin": begin[list(confirm)], "extreme_i": extreme, "confirm_i": confirm, "direction": direction})
        for k in reversed(keys):
            out.insert(0, k, frame[k].iloc[0])
        return out

    rows = bars.where(F.col("log_high").isNotNull() & F.col("log_low").isNotNull()).select(*keys, order, "log_high", "log_low")
    return rows.groupBy(*keys).applyInPandas(run, schema)


def legs(found: DataFrame, by: Names = BY) -> DataFrame:
    """``found`` with duration (bars since the pivot before was confirmed) and log_move since its price; null for the first."""
    over = series(by, "seq")
    return found.withColumns({"duration": F.col("confirm_i") - F.lag("confirm_i").over(over), "log_move": F.col("log_price") - F.lag("log_price").over(over)})


def leg_statistics(found: DataFrame, by: Names = BY) -> DataFrame:
    """For each direction of leg: number, and median, mean and sample deviation (0 for one leg) of duration and of the move in percent."""
    known = legs(found, by).where("duration is not null").withColumn("percent", F.expm1(F.abs("log_move")) * 100.0)
    stats = []
    for value, name in (("duration", "duration"), ("percent", "amplitude")):
        stats += [F.percentile(value, 0.5).alias(f"{name}_median"), F.avg(value).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{name}_std")]
    return known.groupBy(*by, "direction").agg(F.count("*").alias("n"), *stats)


def step_widths(found: DataFrame, least: int = 5, fallback: float = 5.0, by: Names = BY) -> DataFrame:
    """For each series' last pivot: its direction, and the median durations of legs of the other direction (step1) and of its own (step2).

    Directions with fewer than ``least`` legs count as ``fallback`` bars long.
    """
    known = legs(found, by)
    median = lambda d: F.percentile(F.when(F.col("direction") == d, F.col("duration")), 0.5)
    many = lambda d: F.count(F.when(F.col("direction") == d, F.col("duration"))) >= least
    width = {d: F.coalesce(F.when(many(d), median(d)), F.lit(fallback)) for d in (TOP, BOTTOM)}
    out = known.groupBy(*by).agg(F.max_by("direction", "seq").alias("direction"), width[TOP].alias("_top"), width[BOTTOM].alias("_bottom"))
    own, other = F.when(F.col("direction") == TOP, F.col("_top")).otherwise(F.col("_bottom")), F.when(F.col("direction") == TOP, F.col("_bottom")).otherwise(F.col("_top"))
    return out.select(*by, "direction", other.alias("step1"), own.alias("step2"))


def leg_ranks(found: DataFrame, k: int = 10, least: int = 3, by: Names = BY) -> DataFrame:
    """``found`` with leg_age (``duration`` as a double) and rank_leg_age among the up to ``k`` legs before."""
    aged = legs(found, by).withColumn("leg_age", F.col("duration").cast("double"))
    return aged.withColumn("rank_leg_age", percentile_rank("leg_age", k, least, by, "seq", whole_frame=False))


def with_bar_ranks(found: DataFrame, ranked: DataFrame, by: Names = BY, order: str = "begin") -> DataFrame:
    """``found`` with the bar ranks at the confirming bar."""
    names = [f"rank_{f}" for f in FEATURES]
    return found.join(ranked.select(*by, F.col(order).alias("confirm_begin"), *names), [*by, "confirm_begin"], "left")


def pool(found: DataFrame, m: int, h: int, ranks: Iterable[str] = (), by: Names = BY) -> DataFrame:
    """Pivots as analogs: features (the last ``m`` leg moves, newest first) and target (the move to the pivot ``h`` later).

    Only pivots with ``m`` legs behind and ``h`` ahead, and with all ``ranks`` known.
    """
    moved = legs(found, by).withColumn("target", F.lead("log_price", h).over(series(by, "seq")) - F.col("log_price"))
    held = F.reverse(F.collect_list("log_move").over(series(by, "seq").rowsBetween(1 - m, 0)))
    known: Column = (F.size("features") == m) & F.col("target").isNotNull()
    for r in ranks:
        known = known & F.col(r).isNotNull()
    return moved.withColumn("features", held).where(known)


def last_vector(found: DataFrame, m: int, by: Names = BY) -> DataFrame:
    """For each series its last ``m`` leg moves, newest first; no row with fewer legs."""
    held = F.reverse(F.collect_list("log_move").over(series(by, "seq").rowsBetween(1 - m, 0)))
    rows = legs(found, by).withColumns({"query": held, "_last": F.max("seq").over(whole(by))})
    return rows.where((F.col("seq") == F.col("_last")) & (F.size("query") == m)).select(*by, "query")


def pivot_at(found: DataFrame, days: DataFrame, by: Names = BY) -> DataFrame:
    """For each (series, day) of ``days`` the last pivot whose extreme lies on that day or before, by its confirming bar.

    One sort of pivots and days together; days before the first pivot get nulls.
    """
    marks = found.select(*by, F.to_date("extreme_begin").alias("day"), F.struct("seq", "confirm_begin", "log_price", "direction").alias("pivot"))
    asked = days.select(*by, F.to_date("day").alias("day")).withColumn("pivot", F.lit(None).cast(marks.schema["pivot"].dataType))
    both = marks.withColumn("asked", F.lit(0)).unionByName(asked.withColumn("asked", F.lit(1)))
    over = W.partitionBy(*by).orderBy("day", "asked", F.col("pivot.seq")).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("pivot", F.last("pivot", True).over(over)).where("asked = 1").select(*by, "day", "pivot.*")
