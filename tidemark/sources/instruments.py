"""Listings of instruments: classification by group, boards, trading parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pools import GROUPS


def groups(spark: SparkSession) -> DataFrame:
    """The ten known groups as a table."""
    return spark.createDataFrame([(g, *kinds) for g, kinds in GROUPS.items()], "group string, engine string, market string, asset_type string")


def classified(listing: DataFrame) -> DataFrame:
    """``listing`` with engine, market and asset type of its group; rows of unknown groups go. The groups are ten rows."""
    return listing.join(F.broadcast(groups(listing.sparkSession)), "group")


def searched(listing: DataFrame, text: str = "", group: str | None = None) -> DataFrame:
    """Classified rows whose secid, short name or name contains ``text``, of one group if given."""
    from ..operators.store import matching

    found = listing.where(F.col("group") == group) if group else listing
    return classified(matching(found, text, ("secid", "shortname", "name")))


def board(listing: DataFrame, engine: str, market: str, asset_type: str, name: str) -> DataFrame:
    """All rows of one board, in the columns of ``classified``."""
    rows = listing.where(F.col("board") == name)
    return rows.withColumns({"engine": F.lit(engine), "market": F.lit(market), "asset_type": F.lit(asset_type)})


def trading_parameters(values: DataFrame) -> DataFrame:
    """(secid, lot_size, price_step) of rows (secid, name, value); 1 and 0.01 where a value lacks or is no number."""
    wide = values.groupBy("secid").pivot("name", ["LOTSIZE", "MINSTEP"]).agg(F.first("value", True))
    return wide.select("secid", F.coalesce(F.expr("try_cast(LOTSIZE AS int)"), F.lit(1)).alias("lot_size"), F.coalesce(F.expr("try_cast(MINSTEP AS double)"), F.lit(0.01)).alias("price_step"))


def history_ranges(boards: DataFrame) -> DataFrame:
    """(secid, board, engine, market, history_from, history_till): the coverage of each board of a security, in days."""
    return boards.select("secid", F.col("boardid").alias("board"), "engine", "market", F.to_date("history_from").alias("history_from"), F.to_date("history_till").alias("history_till"))
