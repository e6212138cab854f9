"""Scans of bars: ranges, newest rows, coverage, origins, future dates, resampling.

Bars have the columns ticker, begin, open, high, low, close, volume, value.
All functions take null and empty input; bars whose ticker is null form one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import buy_share, log, seconds_of, steps_after
from .window import BY, Names, series, whole


def between(bars: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Bars from ``since`` to ``until``, both included; an empty bound is none.

    Bounds are time stamps: a date alone means its first instant.
    """
    if since:
        bars = bars.where(F.col("begin") >= F.to_timestamp(F.lit(since)))
    if until:
        bars = bars.where(F.col("begin") <= F.to_timestamp(F.lit(until)))
    return bars


def newest(bars: DataFrame, n: int, by: Names = BY) -> DataFrame:
    """The last ``n`` bars of each series; all for ``n`` <= 0."""
    if n <= 0:
        return bars
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("begin")))
    return bars.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def after(bars: DataFrame, origin: str, n: int, by: Names = BY) -> DataFrame:
    """The first ``n`` bars strictly after ``origin``."""
    rank = F.row_number().over(series(by))
    return bars.where(F.col("begin") > F.to_timestamp(F.lit(origin))).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def page_before(bars: DataFrame, oldest: str, n: int, by: Names = BY) -> DataFrame:
    """Keyset paging: ``n`` bars before ``oldest``, read as ``n`` + 1 up to it without the one already shown."""
    return newest(between(bars, until=oldest), n + 1, by).where(F.col("begin") < F.to_timestamp(F.lit(oldest)))


def with_history(bars: DataFrame, least: int = 20, by: Names = BY) -> DataFrame:
    """Only series of at least ``least`` bars."""
    return bars.withColumn("_n", F.count("*").over(whole(by))).where(F.col("_n") >= least).drop("_n")


def causal(bars: DataFrame, cutoff: str | None, least: int = 20, by: Names = BY) -> DataFrame:
    """What was known at ``cutoff``: bars up to it, of series that then have ``least`` bars."""
    return with_history(between(bars, until=cutoff), least, by)


def logged(bars: DataFrame) -> DataFrame:
    """``bars`` with log_high, log_low, mid (their mean); a null volume becomes 0."""
    bars = bars.withColumns({"log_high": log("high"), "log_low": log("low"), "volume": F.coalesce("volume", F.lit(0.0))})
    return bars.withColumn("mid", (F.col("log_high") + F.col("log_low")) / 2.0)


def positive(bars: DataFrame) -> DataFrame:
    """Only series whose prices are all above zero."""
    bad = F.max(F.when((F.least("close", "high", "low") <= 0) | F.col("close").isNull(), 1).otherwise(0)).over(whole())
    return bars.withColumn("_bad", bad).where("_bad = 0").drop("_bad")


def coverage(bars: DataFrame, by: Names = BY) -> DataFrame:
    """First bar, last bar and number of bars of each series."""
    return bars.groupBy(*by).agg(F.min("begin").alias("first"), F.max("begin").alias("last"), F.count("*").alias("bars"))


def visible(bars: DataFrame, low: str, high: str) -> DataFrame:
    """Bars of a view from ``low`` to ``high`` and one more width of it at either side."""
    low_s, high_s = (seconds_of(F.to_timestamp(F.lit(x))) for x in (low, high))
    span, at = high_s - low_s, seconds_of("begin")
    return bars.where(at.between(low_s - span, high_s + span))


def view_range(bars: DataFrame, low: str, high: str, pad: float = 0.06, by: Names = BY) -> DataFrame:
    """Lowest and highest price of a view, widened by a share of their distance."""
    seen = between(bars, low, high).groupBy(*by).agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    margin = (F.col("hi") - F.col("lo")) * pad
    return seen.select(*by, (F.col("lo") - margin).alias("y_low"), (F.col("hi") + margin).alias("y_high"))


def origins_at_days(bars: DataFrame, days: DataFrame, by: Names = BY) -> DataFrame:
    """For each (series, day) of ``days`` its origin: the first bar of the day, else the last bar before it.

    Days and bars are sorted together once, a backward as-of join without a
    range join; a day that no bar precedes has a null origin. Repeated days stay.
    """
    day = F.to_date("begin")
    first = bars.groupBy(*by, day.alias("day")).agg(F.min("begin").alias("origin"))
    asked = days.select(*by, F.to_date("day").alias("day"), F.lit(None).cast("timestamp").alias("origin"), F.lit(1).alias("asked"))
    both = first.select(*by, "day", "origin", F.lit(0).alias("asked")).unionByName(asked)
    last = bars.groupBy(*by, day.alias("day")).agg(F.max("begin").alias("latest"))
    both = both.join(last, [*by, "day"], "left").withColumn("latest", F.when(F.col("asked") == 0, F.col("latest")))
    over = W.partitionBy(*by).orderBy("day", "asked")
    before = F.last("latest", True).over(over.rowsBetween(W.unboundedPreceding, 0))
    same = F.max("origin").over(W.partitionBy(*by, "day"))
    return both.withColumns({"_before": before, "_same": same}).where("asked = 1").select(*by, "day", F.coalesce("_same", "_before").alias("origin"))


def last_of_days(bars: DataFrame, by: Names = BY) -> DataFrame:
    """The last bar of each day."""
    columns = [c for c in bars.columns if c not in by]
    row = F.max_by(F.struct(*columns), "begin").alias("row")
    return bars.groupBy(*by, F.to_date("begin").alias("day")).agg(row).select(*by, "day", *[f"row.{c}" for c in columns])


def future_dates(bars: DataFrame, ahead: int, seconds: int = 86400, by: Names = BY) -> DataFrame:
    """For each bar and h = 1 ... ``ahead`` the begin of the bar h later, or the day of the bar plus h steps."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("h")
    later = F.collect_list("begin").over(series(by).rowsBetween(1, ahead))
    out = bars.select(*by, "begin", later.alias("later")).select("*", steps)
    known = F.when(F.col("h") <= F.size("later"), F.get("later", F.col("h") - 1))
    return out.select(*by, "begin", "h", F.coalesce(known, steps_after("begin", F.col("h"), seconds)).alias("future"))


def resampled(bars: DataFrame, width: str, by: Names = BY) -> DataFrame:
    """Bars of ``width`` (as "3 hours") made of the bars that begin in them; works on streams too."""
    span = F.window("begin", width)
    out = bars.groupBy(*by, span.alias("_span")).agg(
        F.min_by("open", "begin").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "begin").alias("close"), F.sum("volume").alias("volume"), F.sum("value").alias("value"),
    )
    return out.select(*by, F.col("_span.start").alias("begin"), "open", "high", "low", "close", "volume", "value")


def signed_volume(bars: DataFrame) -> DataFrame:
    """``bars`` with buy, sell (their sum is the volume) and whether the close is not below the open."""
    buy = F.col("volume") * buy_share()
    return bars.withColumns({"buy": buy, "sell": F.col("volume") - buy, "rising": F.col("close") >= F.col("open")})


def stale(bars: DataFrame, now: Column, ttl_seconds: int, fetched: str = "fetched_at", by: Names = BY) -> DataFrame:
    """When each series was last fetched and whether that is longer ago than ``ttl_seconds`` (true if never)."""
    last = bars.groupBy(*by).agg(F.max(fetched).alias("last_fetched"))
    age = seconds_of(now) - seconds_of("last_fetched")
    return last.withColumn("stale", F.coalesce(age >= ttl_seconds, F.lit(True)))


def default_view(bars: DataFrame, n: int = 200, pad: int = 5, seconds: int = 86400, by: Names = BY) -> DataFrame:
    """First and last time of a view of the newest ``n`` bars and ``pad`` steps more."""
    seen = newest(bars, n, by).groupBy(*by).agg(F.min("begin").alias("view_from"), F.max("begin").alias("_last"))
    return seen.select(*by, "view_from", F.timestamp_seconds(seconds_of("_last") + pad * seconds).alias("view_to"))




def day_names(bars: DataFrame, order: str = "begin") -> DataFrame:
    """``bars`` with weekday (its English name) and label, such as "5 Mar 2024, Tue"."""
    return bars.withColumns({"weekday": F.date_format(order, "EEEE"), "label": F.date_format(order, "d MMM yyyy, EEE")})


def axis_range(rows: DataFrame, values: Sequence[str], by: Names = BY, symmetric: bool = False, pad: float = 1.05) -> DataFrame:
    """(by, axis_from, axis_to): a range for a plot of ``values`` with room above; from 0, or as far below 0 as above it.

    Where nothing rises above 0 the range ends at 1.
    """
    size = F.greatest(*[F.coalesce(F.max(F.abs(v) if symmetric else F.col(v)), F.lit(0.0)) for v in values], F.lit(0.0))
    found = rows.groupBy(*by).agg(size.alias("_m"))
    top = F.when(F.col("_m") > 0, F.col("_m") * pad).otherwise(1.0)
    return found.select(*by, (-top if symmetric else F.lit(0.0)).alias("axis_from"), top.alias("axis_to"))


def step_geometry(origins: DataFrame, first: str, second: str, seconds: int = 86400, order: str = "begin") -> DataFrame:
    """``origins`` with the days between which the two steps are drawn: from the bar after the origin for ``first`` bars, then for ``second`` more."""
    at = lambda n: F.to_date(F.timestamp_seconds(seconds_of(F.to_timestamp(F.to_date(order))) + n * seconds))
    one, both = F.col(first), F.col(first) + F.col(second)
    return origins.withColumns({"step1_from": at(F.lit(1)), "step1_to": at(one), "step2_from": at(one), "step2_to": at(both)})
