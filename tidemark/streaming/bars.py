"""Bars from streams: resampling with watermarks, upserts of late and partial bars, and averages, trends, filters and pivots whose state goes on across batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import log
from ..operators.recurrence import System
from ..operators.spectral import CUTOFFS, bank
from ..operators.store import upserted
from ..operators.zigzag import Walker
from ..sources.shared import exists, remove


def bars_of_trades(trades: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Bars of ``width`` from a stream of trades (ticker, ts, event_id, price, q).

    A bar leaves (append mode) once the watermark, ``late`` behind the newest
    trade, has passed its end; trades that come later than that are dropped.
    """
    span = F.window("ts", width)
    at = F.struct("ts", "event_id")
    out = trades.withWatermark("ts", late).groupBy(span.alias("_span"), "ticker").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("q").alias("volume"), F.sum(F.col("price") * F.col("q")).alias("value"),
    )
    return out.select("ticker", F.col("_span.start").alias("begin"), "open", "high", "low", "close", "volume", "value")


class Upserts:
    """A ``foreachBatch`` sink that keeps the last version of every bar in a Parquet table by day.

    A batch rewrites only the days that it has bars of. The merged days are
    staged in full before they replace the old ones, and a batch that is run
    again after a failure merges to the same rows, so that every bar is kept once.
    """

    def __init__(self, path: str, key: tuple[str, ...] = ("ticker", "begin")):
        self.path, self.key = path.rstrip("/"), key

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day", F.to_date("begin")).persist()
        try:
            days = [r["day"] for r in batch.select("day").distinct().collect()]  # the days of one batch
            stored = self.table(spark)
            merged = batch if stored is None else upserted(stored.where(F.col("day").isin(days)), batch, self.key)
            stage = f"{self.path}-stage/{number}"
            merged.write.mode("overwrite").parquet(stage)
            staged = spark.read.schema(merged.schema).parquet(stage)
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
            remove(spark, stage)
        finally:
            batch.unpersist()

    def table(self, spark) -> DataFrame | None:
        """The bars so far; None before the first batch."""
        if not exists(spark, self.path):
            return None
        return spark.read.parquet(self.path)


_STATE = "direction int, extreme double, extreme_i long, confirmed_i long, i long, seq long, extreme_begin timestamp"
_PIVOTS = "ticker string, seq long, log_price double, extreme_begin timestamp, confirm_begin timestamp, direction int"


def pivots(bars: DataFrame, threshold: float, min_bars: int = 5) -> DataFrame:
    """Zigzag pivots of a stream of bars (ticker, begin, high, low) that come in order of time for each ticker.

    The automaton's few numbers are the state of a ticker, so that pivots are
    those of the batch operator, whatever the batches.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        walker, seq, extreme_begin = Walker(threshold, min_bars), 0, None
        if state.exists:
            direction, extreme, extreme_i, confirmed, i, seq, extreme_begin = state.get
            walker = Walker(threshold, min_bars, direction, extreme, extreme_i, confirmed, i)
        rows = pd.concat(list(frames)).sort_values("begin", kind="stable")
        out = []
        for begin, high, low in zip(rows["begin"], rows["log_high"], rows["log_low"], strict=True):
            at, started = walker.i, walker.extreme is not None
            before = walker.extreme_i
            pivot = walker.feed(high, low)
            if pivot:
                out.append((key[0], seq, pivot[0], extreme_begin, begin, pivot[3]))
                seq += 1
            if not started or walker.extreme_i != before or walker.extreme_i == at:
                extreme_begin = begin
        state.update((walker.direction, walker.extreme, walker.extreme_i, walker.confirmed_i, walker.i, seq, extreme_begin))
        yield pd.DataFrame(out, columns=["ticker", "seq", "log_price", "extreme_begin", "confirm_begin", "direction"])

    logs = bars.select("ticker", "begin", log("high").alias("log_high"), log("low").alias("log_low"))
    return logs.groupBy("ticker").applyInPandasWithState(work, _PIVOTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def _carried(rows: DataFrame, order: str, feed, columns: str, state_schema: str) -> DataFrame:
    """``feed(sorted rows, state or None) -> (columns of results, state)`` for each ticker of a stream whose rows come in order of time."""
    names = [c.split()[0] for c in columns.split(", ")]
    schema = ", ".join(["ticker string", f"{order} timestamp", columns])

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        found, after = feed(frame, state.get if state.exists else None)
        state.update(after)
        out = pd.DataFrame({"ticker": key[0], order: frame[order].to_numpy()})
        for name, values in zip(names, found, strict=True):
            out[name] = np.asarray(values, dtype=float)  # what is not a number becomes null on the way
        yield out

    return rows.groupBy("ticker").applyInPandasWithState(work, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def ema(bars: DataFrame, period: int, value: str = "close", name: str = "ema") -> DataFrame:
    """``averages.ema`` of a stream of bars in order of time for each ticker: the average so far is the state, and while it is short the sum."""
    alpha = 2 / (period + 1)
    system = System([[1 - alpha]], [alpha], [[1 - alpha]], [alpha])

    def feed(frame: pd.DataFrame, state: tuple | None) -> tuple[list[np.ndarray], tuple]:
        average, i, opening = state or (0.0, 0, 0.0)
        x = frame[value].to_numpy(dtype=float)
        at = i + np.arange(len(x))
        opening += float(x[at < period].sum())
        pushed = np.where(at < period - 1, np.nan_to_num(0.0 * x), np.where(at == period - 1, opening / period / alpha, x))
        found, after = system.run(pushed, np.array([average]))
        return [np.where(at < period - 1, np.nan, found[0])], (float(after[0]), int(i + len(x)), opening)

    return _carried(bars.select("ticker", F.col("begin").cast("timestamp").alias("begin"), value), "begin", feed, f"{name} double", "average double, i long, opening double")


def filtered_ratios(bars: DataFrame, value: str = "close") -> DataFrame:
    """(ticker, begin, trend, ratio, comp_0, ...) of a stream of bars in order of time for each ticker: the causal trend, and the filters' components of the ratio's steps.

    The state are the trend's sums, the last ratio and the filters' states: as
    many numbers however long the series, and results are those of the batch
    operators whatever the batches. The first bar has no step and no components.
    """
    system = bank()
    size = len(system.a)
    columns = ", ".join(["trend double", "ratio double", *[f"comp_{k} double" for k in range(len(CUTOFFS) + 1)]])

    def feed(frame: pd.DataFrame, state: tuple | None) -> tuple[list[np.ndarray], tuple]:
        sums, filters = state or ([0.0, 0.0, 0.0, 0.0, 0.0], [0.0] * size)
        n, first, sy, siy, before = sums
        price = frame[value].to_numpy(dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.log(price)
        first = y[0] if n == 0 else first
        i = n + np.arange(len(y))
        y = y - first
        sy, siy = sy + np.cumsum(y), siy + np.cumsum(i * y)
        count, middle = i + 1, i / 2
        slope = np.divide(siy - middle * sy, count * (count**2 - 1) / 12, out=np.zeros(len(y)), where=i > 0)
        line = np.where(i < 2, price, np.exp(first + sy / count - slope * middle + slope * i))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = price / line
        steps = np.diff(np.r_[before, ratio])
        known = i > 0
        left, after = system.run(steps[known], np.array(filters))
        parts = np.full((len(CUTOFFS) + 1, len(y)), np.nan)
        parts[:, known] = np.vstack([np.vstack([steps[known], left[:-1]]) - left, left[-1:]])
        return [line, ratio, *parts], ([float(i[-1] + 1), float(first), float(sy[-1]), float(siy[-1]), float(ratio[-1])], [float(v) for v in after])

    rows = bars.select("ticker", F.col("begin").cast("timestamp").alias("begin"), value)
    return _carried(rows, "begin", feed, columns, "sums array<double>, filters array<double>")
