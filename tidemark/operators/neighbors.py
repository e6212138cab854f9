"""Analogs: windows of a series that are near to a query window, and their weights.

Queries are few (an origin or a set of origins for each series) and are joined
with all windows of their own series by its keys, so that work grows with
queries times windows and is dealt out by (series, query).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import clamp, distance, dot, norm
from .window import Names

TINY = 1e-10


def apart(i: Column | str, origin: Column | str, width: int) -> Column:
    """Whether a bar is more than ``width`` bars away from the origin."""
    return F.abs((F.col(i) if isinstance(i, str) else i) - (F.col(origin) if isinstance(origin, str) else origin)) > width


def with_distance(pairs: DataFrame, window: str = "window", query: str = "query", name: str = "d") -> DataFrame:
    """``pairs`` with the Euclidean distance of two arrays."""
    return pairs.withColumn(name, distance(window, query))


def with_amp_cos(pairs: DataFrame, alpha: float, by: Names, window: str = "window", query: str = "query", name: str = "d") -> DataFrame:
    """``pairs`` with a blend of difference in size and in direction, each scaled by its largest in the group ``by``.

    Size: the absolute logarithm of the ratio of norms, or the difference of
    norms where one is (almost) zero. Direction: 1 - cosine; 1 for a zero window
    or query.
    """
    pairs = pairs.withColumns({"_nx": norm(window), "_nq": norm(query), "_xq": dot(window, query)})
    some = (F.col("_nx") > TINY) & (F.col("_nq") > TINY)
    cosine = F.when(some, F.col("_xq") / (F.col("_nx") * F.col("_nq"))).otherwise(0.0)
    pairs = pairs.withColumns({"_shape": 1.0 - clamp(cosine, -1.0, 1.0), "_amp": F.when(some, F.abs(F.ln(F.col("_nx") / F.col("_nq")))).otherwise(F.abs(F.col("_nx") - F.col("_nq")))})
    over = W.partitionBy(*by)
    scaled = lambda c: F.col(c) / F.greatest(F.max(c).over(over), F.lit(TINY))
    return pairs.withColumn(name, alpha * scaled("_amp") + (1.0 - alpha) * scaled("_shape")).drop("_nx", "_nq", "_xq", "_shape", "_amp")


def nearest(pairs: DataFrame, k: int, by: Names, d: str = "d", tie: str = "i") -> DataFrame:
    """The ``k`` nearest rows of each group with their rank from 1; ties go to the smaller ``tie``."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(d, tie))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def normalised(rows: DataFrame, by: Names, weight: str = "weight") -> DataFrame:
    """``rows`` with weights that sum to 1 in each group; groups without weight go."""
    total = F.sum(weight).over(W.partitionBy(*by))
    return rows.withColumn("_total", total).where(F.col("_total") > 0).withColumn(weight, F.col(weight) / F.col("_total")).drop("_total")


def simplex_step(near: DataFrame, outcome: str, by: Names, d: str = "d") -> DataFrame:
    """(by, prediction): the mean outcome of the neighbours, weighed by exp(-d / least d)."""
    least = F.greatest(F.min(d).over(W.partitionBy(*by)), F.lit(TINY))
    weighed = near.withColumn("_w", F.exp(-F.col(d) / least))
    return weighed.groupBy(*by).agg((F.sum(F.col("_w") * F.col(outcome)) / F.sum("_w")).alias("prediction"))
