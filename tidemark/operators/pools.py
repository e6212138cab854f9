"""Pools of instruments: candidates of several groups, ranked by liquidity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Groups of instruments and their engine, market and asset type.
GROUPS = {
    "stock_shares": ("stock", "shares", "stock"),
    "stock_dr": ("stock", "shares", "stock"),
    "stock_etf": ("stock", "shares", "fund"),
    "stock_ppif": ("stock", "shares", "fund"),
    "stock_bonds": ("stock", "bonds", "bond"),
    "stock_index": ("stock", "index", "index"),
    "currency_selt": ("currency", "selt", "currency"),
    "currency_metal": ("currency", "selt", "metal"),
    "futures_forts": ("futures", "forts", "futures"),
    "futures_options": ("futures", "options", "option"),
}


def pool_key(categories: Column | str, n: Column | int) -> Column:
    """One text for a set of categories in any order and a size: "bond+stock:25"."""
    names = F.array_sort(F.col(categories) if isinstance(categories, str) else categories)
    return F.concat(F.array_join(names, "+"), F.lit(":"), (F.lit(n) if isinstance(n, int) else n).cast("string"))


def union_distinct(parts: Iterable[DataFrame], key: str, order: str) -> DataFrame:
    """All rows of ``parts`` with distinct ``key``: of equal keys the first part's, then the least ``order``, stays."""
    out = None
    for n, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(n))
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(W.partitionBy(key).orderBy("_part", order))
    return out.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_part")


def liquidity(bars: DataFrame, kinds: DataFrame, since: Column, least: int = 15) -> DataFrame:
    """(ticker, bars, score) since a time: number of bars for currencies, volume for futures, else value.

    ``kinds`` gives the engine of each ticker. Tickers with fewer than ``least``
    bars or without a positive score are left out.
    """
    recent = bars.where(F.col("begin") >= since).groupBy("ticker").agg(F.count("*").alias("bars"), F.sum("volume").alias("_volume"), F.sum("value").alias("_value"))
    scored = recent.join(kinds.select("ticker", "engine"), "ticker")
    score = F.when(F.col("engine") == "currency", F.col("bars").cast("double")).when(F.col("engine") == "futures", F.col("_volume")).otherwise(F.col("_value"))
    return scored.where(F.col("bars") >= least).select("ticker", "bars", score.alias("score")).where("score > 0")


def most_liquid(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` best scores at most, with their rank; ties go to the smaller ticker. A report of bounded size."""
    top = scores.orderBy(F.desc("score"), "ticker").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "ticker")).cast("long"))
