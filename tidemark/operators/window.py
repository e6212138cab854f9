"""Windows over series of bars, and how long series are cut for many tasks.

A series is what ``by`` names (a ticker, or ticker and interval) in the order of
``order``. All frames count rows, as closed sessions are simply absent. All
windows of one series share the partitioning and order, so that Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

Names = Sequence[str]
BY: Names = ("ticker",)


def series(by: Names = BY, order: str = "begin") -> WindowSpec:
    return W.partitionBy(*by).orderBy(order)


def trailing(n: int, by: Names = BY, order: str = "begin") -> WindowSpec:
    """The row and the ``n`` - 1 before it."""
    return series(by, order).rowsBetween(1 - n, 0)


def preceding(n: int, by: Names = BY, order: str = "begin") -> WindowSpec:
    """The ``n`` rows before the row."""
    return series(by, order).rowsBetween(-n, -1)


def following(n: int, by: Names = BY, order: str = "begin") -> WindowSpec:
    """The ``n`` rows after the row."""
    return series(by, order).rowsBetween(1, n)


def so_far(by: Names = BY, order: str = "begin") -> WindowSpec:
    return series(by, order).rowsBetween(W.unboundedPreceding, 0)


def whole(by: Names = BY) -> WindowSpec:
    return W.partitionBy(*by)


def full(aggregate: Column, value: Column | str, frame: WindowSpec, n: int) -> Column:
    """``aggregate`` over ``frame``, null unless ``n`` values are known there."""
    return F.when(F.count(value).over(frame) == n, aggregate.over(frame))


def with_position(bars: DataFrame, by: Names = BY, order: str = "begin") -> DataFrame:
    """``bars`` with ``i``, the place of a bar in its series from 0; kept if there is one already."""
    if "i" in bars.columns:
        return bars
    return bars.withColumn("i", F.row_number().over(series(by, order)).cast("long") - 1)


def numbered(bars: DataFrame, by: Names = BY, order: str = "begin", slot: str = "month") -> DataFrame:
    """``with_position`` for series that no single task should sort.

    Rows are counted for each calendar ``slot``; running totals over the slots
    (some hundreds for a series) give each slot's first place, and rows are
    numbered within their slot.
    """
    slots = bars.withColumn("_slot", F.date_trunc(slot, order))
    counts = slots.groupBy(*by, "_slot").agg(F.count("*").alias("_rows"))
    starts = counts.withColumn("_start", F.sum("_rows").over(so_far(by, "_slot")) - F.col("_rows")).drop("_rows")
    inside = F.row_number().over(series((*by, "_slot"), order)) - 1
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "_slot")]
    joined = slots.alias("x").join(starts.alias("y"), on).select("x.*", "y._start")
    return joined.withColumn("i", (F.col("_start") + inside).cast("long")).drop("_slot", "_start")


def in_chunks(bars: DataFrame, operator: Callable[..., DataFrame], back: int, ahead: int = 0, rows: int = 100_000, by: Names = BY, order: str = "begin") -> DataFrame:
    """``operator(bars, by=..., order=...)`` on overlapping chunks of long series, in parallel.

    For operators that look back at most ``back`` rows and ahead at most
    ``ahead``: every chunk of ``rows`` bars also gets the rows around it that
    its frames reach, and those rows' results are dropped. The result is the
    same as without chunks, with ``i`` as a further column; a series of any
    length is spread over tasks of ``rows`` + ``back`` + ``ahead`` rows.
    """
    own = F.floor(F.col("i") / rows)
    chunks = F.sequence(F.floor(F.greatest(F.col("i") - ahead, F.lit(0)) / rows), F.floor((F.col("i") + back) / rows))
    # no chunk beyond the series: its length is counted before, so no task holds a series
    sizes = bars.groupBy(*by).agg(F.count("*").alias("_rows"))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in by]
    placed = numbered(bars, by, order).alias("x").join(sizes.alias("y"), on).select("x.*", "y._rows")
    dealt = placed.select("*", F.explode(chunks).alias("_chunk")).where(F.col("_chunk") <= F.floor((F.col("_rows") - 1) / rows))
    dealt = dealt.withColumn("_own", F.col("_chunk") == own).drop("_rows")
    return operator(dealt, by=(*by, "_chunk"), order=order).where("_own").drop("_own", "_chunk")
