"""Queries on lookups, saved documents, labels and geometry, and on the reading of written models."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import bars, spectral, store, trend
from ..plans import band, calibrate, regime, simplex
from ..sources import candles, instruments
from ..sources.fixtures import SQL as SQL_OF
from ..sources.fixtures import orders, raw, table, walk
from ..sources.shared import fresh_path, written
from .common import PLACED, RATIOS, on_bars, r, shown, weighted
from .models import _BAND_BASE, _ORIGIN, _T, _band, _pool

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ── lookups ─────────────────────────────────────────────────────────────────


@query(on_bars("orders", "SELECT ticker, begin, close FROM bars WHERE ticker = '2-HIGH' AND begin = TIMESTAMP '1995-03-09'"))
def bar_by_key(spark, sf):
    day = F.to_timestamp(F.lit("1995-03-09"))
    return store.found_by(orders(spark, sf), ticker="2-HIGH").where(F.col("begin") == day).select("ticker", "begin", "close")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def instrument_by_key(spark, sf):
    return store.found_by(table(spark, sf, "customer"), c_custkey=77).select("c_custkey", "c_name")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 ")
def visible_instruments(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "pool").otherwise("manual").alias("added_via"))
    return store.visible(rows).select("id")


@query("SELECT event_id, k FROM (SELECT event_id, ts, json_extract_string(props, '$.k') AS k FROM events) ORDER BY k DESC NULLS LAST, ts DESC, event_id LIMIT 50")
def newest_by_json(spark, sf):
    found = store.newest_by_json(table(spark, sf, "events"), "props", "$.k", (F.desc("ts"), F.col("event_id")), 50)
    return found.select("event_id", F.get_json_object("props", "$.k").alias("k"))


# ── saved documents ─────────────────────────────────────────────────────────


@query("SELECT c_custkey AS id, c_custkey % 4 = 0 AS is_favorite, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey END AS lot_size FROM customer")
def trading_params_set(spark, sf):
    """Favourites and trading parameters, set by id."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(False).alias("is_favorite"), F.lit(None).cast("int").alias("lot_size"))
    rows = store.updated(rows, table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.lit(True).alias("is_favorite")), ("id",))
    return store.updated(rows, table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("lot_size")), ("id",))


@query("""SELECT o_orderkey AS id, 'old' AS model_type, o_orderstatus AS result, NULL AS geometry FROM orders
UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY r_name), 'new', r_name, NULL FROM region""")
def forecast_saved(spark, sf):
    stored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("model_type"), F.col("o_orderstatus").alias("result"), F.lit(None).cast("string").alias("geometry"))
    new = table(spark, sf, "region").select(F.lit("new").alias("model_type"), F.col("r_name").alias("result"))
    return store.appended(stored, new, ("result",))


@query("SELECT o_orderkey AS id, o_orderstatus AS result, CASE WHEN o_orderstatus = 'P' THEN '{\"width\":' || o_custkey || '}' END AS geometry FROM orders")
def forecast_geometry_updated(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("result"), F.lit(None).cast("string").alias("geometry"))
    given = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_custkey").alias("width"))).alias("geometry"))
    return store.updated(rows, given, ("id",))


@query("""WITH keys AS (SELECT p_size AS h_steps, p_partkey % 12 AS p, p_partkey % 5 AS theiler, p_retailprice FROM part)
SELECT h_steps, p, theiler, max((p_retailprice > 1500)::INT) = 1 AS fresh FROM keys GROUP BY 1, 2, 3""")
def calibration_fresh(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_size").alias("h_steps"), (F.col("p_partkey") % 12).alias("p"), (F.col("p_partkey") % 5).alias("theiler"), "p_retailprice")
    return calibrate.fresh(part.select("h_steps", "p", "theiler").distinct(), part.where("p_retailprice > 1500"))


@query("SELECT s_suppkey AS secid, 'B' || s_nationkey AS board, 'e' AS engine, 'm' AS market, DATE '2000-01-01' + s_nationkey AS history_from, NULL::DATE AS history_till FROM supplier")
def history_ranges(spark, sf):
    s = table(spark, sf, "supplier")
    boards = s.select(F.col("s_suppkey").alias("secid"), F.concat(F.lit("B"), "s_nationkey").alias("boardid"), F.lit("e").alias("engine"), F.lit("m").alias("market"), F.date_add(F.lit("2000-01-01"), F.col("s_nationkey")).cast("string").alias("history_from"), F.lit(None).cast("string").alias("history_till"))
    return instruments.history_ranges(boards)


# ── labels and geometry ─────────────────────────────────────────────────────


@query(on_bars("orders", "SELECT ticker, begin, strftime(begin, '%A') AS weekday, strftime(begin, '%-d %b %Y, %a') AS label FROM bars"))
def day_names(spark, sf):
    return bars.day_names(orders(spark, sf)).select("ticker", "begin", "weekday", "label")


@query(on_bars("orders", f"SELECT ticker, {r('-1.05 * max(greatest(volume, value / 1e5))', 4)} AS axis_from, {r('1.05 * max(greatest(volume, value / 1e5))', 4)} AS axis_to FROM bars GROUP BY ticker"))
def axis_ranges(spark, sf):
    rows = orders(spark, sf).withColumn("money", F.col("value") / -1e5)
    return shown(bars.axis_range(rows, ("volume", "money"), symmetric=True), "ticker", axis_from=4, axis_to=4)


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + 1 AS step1_from, CAST(o_orderdate AS DATE) + w AS step1_to, CAST(o_orderdate AS DATE) + w AS step2_from, CAST(o_orderdate AS DATE) + w + 7 AS step2_to FROM (SELECT *, (3 + o_orderkey % 9)::INT AS w FROM orders)")
def step_geometry(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("begin"), (3 + F.col("o_orderkey") % 9).alias("first"), F.lit(7).alias("second"))
    return bars.step_geometry(rows, "first", "second").select("id", "step1_from", "step1_to", "step2_from", "step2_to")


# ── reading of models ───────────────────────────────────────────────────────


@query(f"SELECT h, pool_size, min(price) AS low, (list(price ORDER BY q))[3] AS middle, max(price) AS high, CASE WHEN h = 1 THEN direction > 0 ELSE direction < 0 END AS down FROM ({_band(0)}) GROUP BY h, pool_size, direction")
def band_result_rows(spark, sf):
    found = written(band.ranked_pivots(walk(spark, sf), _T), "pivots")
    return shown(band.result_rows(band.forecast(found, "A")), "h", "pool_size", "down", low=4, middle=4, high=4)


_ENDS = sorted({(100 + s * p) / 200 for p in (50, 75, 90, 70) for s in (-1, 1)})


def _zones() -> str:
    pools = ", ".join(f"side{h} AS (SELECT *, count(*) OVER () AS pool_size, 1.0::DOUBLE AS w, {h} AS h FROM pool{h} WHERE direction = o_side QUALIFY count(*) OVER () >= 8)" for h in (1, 2))
    read = " UNION ALL ".join(f"({weighted(f'side{h}', 'h, o_price, o_side', 'target', 'w', _ENDS, 'confirm_begin, ticker')})" for h in (1, 2))
    prices = f"prices AS (SELECT h, o_side, round(q, 6) AS q, exp(o_price + quantile) AS price FROM ({read}))"
    bound = "bound AS (SELECT max(price) AS boundary FROM prices WHERE h = 2 AND q = CASE WHEN o_side > 0 THEN 0.15 ELSE 0.85 END)"
    select = f"""SELECT h, level, {r('lo', 4)} AS lo, {r('hi', 4)} AS hi, {r('boundary', 4)} AS boundary FROM (
  SELECT a.h, level, boundary, CASE WHEN a.h = 1 AND a.o_side < 0 THEN greatest(a.price, boundary) ELSE a.price END AS lo, CASE WHEN a.h = 1 AND a.o_side > 0 THEN least(b.price, boundary) ELSE b.price END AS hi
  FROM (VALUES (50.0::DOUBLE, 0.25, 0.75), (75.0::DOUBLE, 0.125, 0.875), (90.0::DOUBLE, 0.05, 0.95)) z(level, ql, qh) JOIN prices a ON a.q = z.ql JOIN prices b ON b.q = z.qh AND b.h = a.h, bound) WHERE lo < hi"""
    return on_bars("walk", select, *_BAND_BASE, _ORIGIN, _pool("before", 1, "pool1"), _pool("before", 2, "pool2"), pools, prices, bound, recursive=True)


SQL["band_zones"] = _zones()


_PATHS = "paths AS (SELECT l_returnflag AS ticker, l_linenumber AS h, (l_orderkey % 1000)::BIGINT AS back, l_discount - 0.05 AS rel, 1.0::DOUBLE AS w FROM lineitem)"


def _ends(q: float) -> str:
    return f"({weighted('paths', 'ticker, h', 'rel', 'w', [q], 'back')})"


@query(f"""WITH {_PATHS} SELECT s.ticker, s.h, s.origins, {r('s.mean')} AS mean, {r('s.std')} AS std, {r('s.p25')} AS p25, {r('s.p75')} AS p75, {r('a.quantile')} AS lo, {r('b.quantile')} AS hi
FROM (SELECT ticker, h, count(*) AS origins, avg(rel) AS mean, stddev_pop(rel) AS std, quantile_cont(rel, 0.25) AS p25, quantile_cont(rel, 0.75) AS p75 FROM paths GROUP BY 1, 2) s
JOIN {_ends(0.25)} a USING (ticker, h) JOIN {_ends(0.75)} b USING (ticker, h)""")
def ensemble_band_of_paths(spark, sf):
    """The ensemble's band, read from paths that are at hand."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("ticker"), F.col("l_linenumber").alias("h"), (F.col("l_orderkey") % 1000).alias("back"), (F.col("l_discount") - 0.05).alias("rel"))
    return shown(simplex.band(rows), "ticker", "h", "origins", mean=6, std=6, p25=6, p75=6, lo=6, hi=6)


@query("""SELECT p_brand AS ticker, p_partkey % 3 AS back, CASE WHEN arg_max(p_retailprice, p_size * 1000000 + p_partkey) >= 1500 THEN 1 ELSE -1 END AS direction FROM part GROUP BY 1, 2""")
def direction_of_mixtures(spark, sf):
    """The direction of the heaviest part at the last step, read from mixtures that are at hand."""
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("ticker"), (F.col("p_partkey") % 3).alias("back"), F.lit(1500.0).alias("origin_price"), F.col("p_size").alias("h"), F.col("p_partkey").alias("weight"), F.col("p_retailprice").alias("mean"))
    return regime.dominant(rows)


# ── guards, listings, pages, files ──────────────────────────────────────────


@query(on_bars("raw", """SELECT ticker, begin, low FROM moved WHERE ticker NOT IN (SELECT ticker FROM moved WHERE least(close, high, low) <= 0)""",
    "moved AS (SELECT ticker, begin, high, close, CASE WHEN ticker = 'A' AND begin < TIMESTAMP '1997-01-01' THEN -low ELSE low END AS low FROM bars)"))
def positive_series(spark, sf):
    """Only series whose prices are all above zero."""
    rows = raw(spark, sf).withColumn("low", F.when((F.col("ticker") == "A") & (F.col("begin") < F.lit("1997-01-01").cast("timestamp")), -F.col("low")).otherwise(F.col("low")))
    return bars.positive(rows).select("ticker", "begin", "low")


@query("SELECT c_name AS ticker, c_mktsegment AS full_name FROM customer WHERE c_name ILIKE '%machin%' OR c_mktsegment ILIKE '%machin%'")
def quick_filter(spark, sf):
    """The quick list for a text: tickers or names that contain it, whatever the case."""
    rows = table(spark, sf, "customer").select(F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("full_name"), F.lit(False).alias("is_favorite"))
    return store.quick_list(rows, " MACHIN ").select("ticker", "full_name")


@query("SELECT s_name AS secid, 'B' || s_nationkey % 2 AS board, 'stock' AS engine, 'shares' AS market, 'fund' AS asset_type FROM supplier WHERE s_nationkey % 2 = 1")
def board_listing(spark, sf):
    """All securities of one board, with its engine, market and kind."""
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("secid"), F.concat(F.lit("B"), F.col("s_nationkey") % 2).alias("board"))
    return instruments.board(rows, "stock", "shares", "fund", "B1")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS updated_at FROM orders ORDER BY o_orderstatus, o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_by_keys(spark, sf):
    """The third page of records in an order of several keys."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return store.page(rows, ["status", F.desc("updated_at"), "id"], 2, 25)


@query("""SELECT p_size AS h_steps, p_partkey % 50 AS p, CASE WHEN max(p_partkey) FILTER (p_partkey % 3 = 0) IS NULL THEN max(p_partkey) ELSE max(p_partkey) FILTER (p_partkey % 3 = 0) END AS theta FROM part GROUP BY 1, 2""")
def settings_upserted(spark, sf):
    """Settings by a key of two columns: later saves replace earlier ones, others stay."""
    rows = table(spark, sf, "part").select(F.col("p_size").alias("h_steps"), (F.col("p_partkey") % 50).alias("p"), F.col("p_partkey").alias("theta"))
    newest = lambda part: part.groupBy("h_steps", "p").agg(F.max("theta").alias("theta"))
    return store.upserted(newest(rows.where("theta % 3 <> 0")), newest(rows.where("theta % 3 = 0")), ("h_steps", "p"))


def _covered(kind: str, interval: str) -> str:
    return f"SELECT ticker, '{interval}' AS interval, min(begin) AS first, max(begin) AS last, count(*) AS bars FROM {kind} GROUP BY ticker"


@query(f"""WITH {SQL_OF['raw'].replace('bars AS', 'days AS', 1)}, {SQL_OF['orders'].replace('bars AS', 'totals AS', 1)},
held AS ({_covered('days', '1d')} UNION ALL SELECT ticker, '1w', min(begin), max(begin), count(*) FROM totals WHERE begin >= TIMESTAMP '1995-01-01' GROUP BY ticker)
SELECT t.ticker, i.interval, first, last, coalesce(bars, 0) AS bars FROM (SELECT DISTINCT ticker FROM held) t, (VALUES ('1d'), ('1w')) i(interval) LEFT JOIN held h ON h.ticker = t.ticker AND h.interval = i.interval""")
def coverage_by_interval(spark, sf):
    """What is stored of each instrument in each interval; nothing is 0 bars."""
    days = raw(spark, sf).select("ticker", F.lit("1d").alias("interval"), "begin")
    weeks = orders(spark, sf).where("begin >= timestamp'1995-01-01'").select("ticker", F.lit("1w").alias("interval"), "begin")
    held = bars.coverage(days.unionByName(weeks), ("ticker", "interval"))
    wanted = held.select("ticker").distinct().withColumn("interval", F.explode(F.array(F.lit("1d"), F.lit("1w"))))
    return wanted.join(held, ["ticker", "interval"], "left").withColumn("bars", F.coalesce("bars", F.lit(0)).cast("long"))


@query(on_bars("raw", "SELECT ticker, begin, '1d' AS interval, open, high, low, close, volume FROM bars"))
def bars_as_json(spark, sf):
    """Bars that were saved as JSON by interval and are read again by schema."""
    path = fresh_path(spark, "json")
    candles.write_bars(raw(spark, sf).withColumn("interval", F.lit("1d")), path, "json")
    return candles.read_bars(spark, path, "json").select("ticker", "begin", "interval", "open", "high", "low", "close", "volume")


@query(on_bars("walk", """SELECT ticker, (n - 64) // 16 + 1 AS segments, ((n - 64) // 16 + 1) * 33 AS cells FROM (SELECT ticker, count(*) AS n FROM steps WHERE dratio IS NOT NULL AND (ticker <> 'A' OR i < 60) AND (ticker <> 'N' OR i < 200) GROUP BY ticker) WHERE n >= 64""", PLACED, RATIOS))
def stft_guards(spark, sf):
    """Series that are too short for a segment have no spectrum; of others every whole segment has all frequencies."""
    rows = trend.ratio_steps(trend.causal_trend(walk(spark, sf))).where("(ticker <> 'A' or i < 60) and (ticker <> 'N' or i < 200)")
    return spectral.spectrogram(rows).groupBy("ticker").agg(F.countDistinct("segment").alias("segments"), F.count("*").alias("cells"))


def _paged(rows, folder: str, page: int = 500) -> None:
    """Bars as pages of an archive, a file for each ``page`` of a ticker; a ticker's pages are written by the task that holds it."""
    columns = ["open", "close", "high", "low", "value", "volume", "begin"]

    def write(frame):
        frame = frame.sort_values("begin")
        at = Path(folder.removeprefix("file:"), frame["ticker"].iloc[0], "1d")
        at.mkdir(parents=True, exist_ok=True)
        frame["begin"] = frame["begin"].dt.strftime("%Y-%m-%d %H:%M:%S")
        for start in range(0, len(frame), page):
            (at / f"{start}.json").write_text(json.dumps({"columns": columns, "data": frame[columns].iloc[start : start + page].values.tolist()}))
        return frame[["ticker"]].head(1)

    rows.groupBy("ticker").applyInPandas(write, "ticker string").count()


@query(on_bars("raw", "SELECT ticker, '1d' AS interval, begin, open, high, low, close, volume FROM bars WHERE begin >= TIMESTAMP '2000-01-01'"))
def bars_ingested(spark, sf):
    """Stored bars after two runs of an ingest: the first ends with bars that are not yet whole, the second loads from their day on."""
    rows, path = raw(spark, sf).withColumn("begin", F.col("begin").cast("timestamp")), fresh_path(spark, "stored")
    early = F.col("begin") <= F.lit("2000-06-30").cast("timestamp")
    last = F.max("begin").over(W.partitionBy("ticker"))
    partial = rows.where(early).withColumn("volume", F.when(F.col("begin") == last, F.col("volume") / 2).otherwise(F.col("volume")))
    tickers = sorted(x["ticker"] for x in rows.select("ticker").distinct().collect())
    for bars_, until in ((partial, "2000-06-30"), (rows, "2100-01-01")):
        folder = fresh_path(spark, "pages")
        _paged(bars_, folder)
        candles.ingest(spark, folder.removeprefix("file:"), path, tickers, ["1d"], until, slice_days="36500")
    return candles.stored_bars(spark, path).select("ticker", "interval", "begin", "open", "high", "low", "close", "volume")
