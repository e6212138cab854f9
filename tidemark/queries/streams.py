"""Queries that run streams to their end over the driver's files and return what they left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import event_trades, raw, table, walk
from ..sources.shared import fresh_path
from ..streaming import bars as stream
from .common import PLACED, RATIOS, on_bars, r, shown
from .models import _T
from .series import SQL as _SERIES_SQL
from .series import bank

QUERIES, SQL = {}, {}


def _files(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def _run(rows: DataFrame, sink: stream.Upserts, spark: SparkSession, mode: str) -> DataFrame:
    query = rows.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.table(spark)


def stream_resample(spark: SparkSession, sf: str) -> DataFrame:
    """Three-hour bars of the events: every version of a bar is upserted, so partial bars become whole."""
    made = stream.bars_of_trades(event_trades(_files(spark, sf, "events")), "3 hours")
    out = _run(made, stream.Upserts(fresh_path(spark, "bars")), spark, "update")
    return shown(out, "ticker", "begin", "open", "high", "low", "close", "volume", value=2)


def stream_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """Pivots of the order totals' bars (largest total of a day as high, least as low), by the stateful operator."""
    from ..sources.fixtures import orders

    path = fresh_path(spark, "bars")
    orders(spark, sf).coalesce(1).sortWithinPartitions("begin").write.parquet(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = fresh_path(spark, "pivots")
    query = stream.pivots(rows, _T).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return shown(spark.read.parquet(out), "ticker", "seq", "extreme_begin", "confirm_begin", "direction", log_price=9)


def _replayed(spark: SparkSession, rows: DataFrame, operator) -> DataFrame:
    """``operator`` on bars that come in three batches in order of time, and what it has put out."""
    path, out = fresh_path(spark, "bars"), fresh_path(spark, "carried")
    for low, high in (("1900-01-01", "1997-07-01"), ("1997-07-01", "1999-07-01"), ("1999-07-01", "2100-01-01")):
        part = rows.where((F.col("begin") >= F.lit(low).cast("timestamp")) & (F.col("begin") < F.lit(high).cast("timestamp")))
        part.repartitionByRange(1, "begin").write.mode("append").parquet(path)
    stream_ = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = operator(stream_).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def stream_ema(spark: SparkSession, sf: str) -> DataFrame:
    """The exponential average, its state carried over three batches."""
    return shown(_replayed(spark, raw(spark, sf), lambda rows: stream.ema(rows, 20)), "ticker", "begin", ema=6)


def stream_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Trend, ratio and the filters' components, their state carried over three batches."""
    found = _replayed(spark, walk(spark, sf), stream.filtered_ratios)
    return shown(found, "ticker", "begin", trend=6, ratio=9, comp_0=9, comp_5=9)


QUERIES["stream_ema"], SQL["stream_ema"] = stream_ema, _SERIES_SQL["ema_20"]
QUERIES["stream_filters"] = stream_filters
SQL["stream_filters"] = on_bars("walk", f"SELECT s.ticker, s.begin, {r('s.trend')} AS trend, {r('s.ratio', 9)} AS ratio, {r('comp_0', 9)} AS comp_0, {r('comp_5', 9)} AS comp_5 FROM steps s LEFT JOIN known k ON k.ticker = s.ticker AND k.begin = s.begin LEFT JOIN bank b ON b.ticker = k.ticker AND b.n = k.n", PLACED, RATIOS, bank(), recursive=True)
QUERIES["stream_resample"] = stream_resample
SQL["stream_resample"] = on_bars("hourly", """SELECT ticker, time_bucket(INTERVAL '3 hours', begin) AS begin, min_by(open, begin) AS open, max(high) AS high, min(low) AS low,
  max_by(close, begin) AS close, sum(volume) AS volume, round(sum(value), 2) + 0.0 AS value FROM bars GROUP BY 1, 2""")
QUERIES["stream_pivots"] = stream_pivots


def _pivots_sql() -> str:
    from .models import LOGGED, PLACED, _ZIGZAG

    return on_bars("orders", "SELECT ticker, seq, extreme_begin, confirm_begin, direction, round(log_price, 9) + 0.0 AS log_price FROM pivots", PLACED, LOGGED, _ZIGZAG, recursive=True)


SQL["stream_pivots"] = _pivots_sql()
