"""What the query modules share: rounding on both sides, and SQL on top of the bar tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]


def shown(rows: DataFrame, *keys: str, **digits: int) -> DataFrame:
    """``keys`` as they are and the columns of ``digits`` rounded."""
    return rows.select(*keys, *[rounded(c, n).alias(c) for c, n in digits.items()])


def long_(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def on_bars(kind: str, select: str, *ctes: str, recursive: bool = False) -> str:
    """SQL over a bar table: further common table expressions, then the final query."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([fixtures.SQL[kind], *ctes])}\n{select}"


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


#: Common table expressions that several queries build on.
PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY begin) - 1 AS i FROM bars)"
LOGGED = "logged AS (SELECT *, (log_high + log_low) / 2.0 AS mid FROM (SELECT *, ln(high) AS log_high, ln(low) AS log_low FROM placed))"
RATIOS = """fits AS (SELECT *, coalesce(regr_slope(ln(close), i) OVER s, 0.0) AS log_b, coalesce(regr_intercept(ln(close), i) OVER s, ln(close)) AS log_a
  FROM placed WINDOW s AS (PARTITION BY ticker ORDER BY begin ROWS UNBOUNDED PRECEDING)),
ratios AS (SELECT *, close / trend AS ratio FROM (SELECT *, CASE WHEN i < 2 THEN close ELSE exp(log_a + log_b * i) END AS trend FROM fits)),
steps AS (SELECT *, ratio - lag(ratio) OVER (PARTITION BY ticker ORDER BY begin) AS dratio FROM ratios)"""


def windows(p: int, source: str = "steps", value: str = "dratio", name: str = "delays", keep: str = "") -> str:
    """Delay windows as a common table expression; rows without a full window go."""
    return f"""{name} AS (SELECT * FROM (SELECT *, list({value}) OVER (PARTITION BY ticker ORDER BY begin ROWS {p - 1} PRECEDING) AS win FROM {source}{keep})
  WHERE len(list_filter(win, lambda x : x IS NOT NULL)) = {p})"""


def weighted(source: str, by: str, value: str, weight: str, qs: list[float], ties: str = "") -> str:
    """A weighted quantile for each group as a SELECT: (by, q, quantile)."""
    order = ", ".join(x for x in (value, ties, weight) if x)
    part = f"PARTITION BY {by}" if by else ""
    by_ = f"{by}, " if by else ""
    return f"""SELECT {by_}q, CASE WHEN lo IS NULL THEN hi_v WHEN hi IS NULL THEN lo_v WHEN lo = hi OR lo_v = hi_v THEN lo_v ELSE lo_v + (q - lo) / (hi - lo) * (hi_v - lo_v) END AS quantile FROM (
  SELECT {by_}q, max(c) FILTER (c <= q) AS lo, max_by(v, c) FILTER (c <= q) AS lo_v, min(c) FILTER (c >= q) AS hi, min_by(v, c) FILTER (c >= q) AS hi_v
  FROM (SELECT {by_}{value} AS v, (sum({weight}) OVER ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - 0.5 * {weight}) / sum({weight}) OVER ({part}) AS c FROM {source}),
    (SELECT unnest({qs}::DOUBLE[]) AS q) GROUP BY {by_}q)"""
