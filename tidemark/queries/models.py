"""Queries on quantiles, pivots, analogs and the forecasting models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import bars, neighbors, quantile, ranks, trend, zigzag
from ..plans import band, calibrate, corridor, range_zones, regime, simplex
from ..sources.fixtures import table, walk, written_once
from ..sources.shared import parts_of, written
from .common import LOGGED, PLACED, RATIOS, on_bars, r, shown, weighted, windows
from .series import AHEAD, RANKED, RAWS, bank

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ── quantiles and densities ─────────────────────────────────────────────────

_QS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _quantiles_of(found):
    return shown(found, "q", quantile=4)


_WQ = f"SELECT q, {r('quantile', 4)} AS quantile FROM ({weighted('lineitem', '', 'l_extendedprice', 'l_quantity', _QS)})"


@query(_WQ)
def weighted_quantiles_wide(spark, sf):
    return _quantiles_of(quantile.wide_weighted_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", _QS))


@query(f"SELECT l_returnflag, l_linestatus, l_shipmonth, q, {r('quantile', 6)} AS quantile FROM ({weighted('(SELECT *, month(l_shipdate)::INT AS l_shipmonth FROM lineitem)', 'l_returnflag, l_linestatus, l_shipmonth', 'l_extendedprice', 'l_quantity', _QS)})")
def weighted_quantiles(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate"))
    by = ("l_returnflag", "l_linestatus", "l_shipmonth")
    return shown(quantile.wide_weighted_quantiles(rows, "l_extendedprice", "l_quantity", _QS, by, parts_of(table(spark, sf, "lineitem"))), *by, "q", quantile=6)


@query(f"SELECT unnest({_QS}::DOUBLE[]) AS q, round(unnest(quantile_cont(l_extendedprice, {_QS})), 4) + 0.0 AS quantile FROM lineitem")
def plain_quantiles_wide(spark, sf):
    return _quantiles_of(quantile.wide_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", _QS))


@query(f"SELECT l_returnflag, unnest({_QS}::DOUBLE[]) AS q, round(unnest(quantile_cont(l_extendedprice, {_QS})), 4) + 0.0 AS quantile FROM lineitem GROUP BY l_returnflag")
def plain_quantiles(spark, sf):
    return shown(quantile.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", _QS, ("l_returnflag",)), "l_returnflag", "q", quantile=4)


_DENSITY = """ends AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
counts AS (SELECT l_quantity::INT AS h, least(floor((l_extendedprice - lo) / 500.0), ceil((hi - lo) / 500.0) - 1)::BIGINT AS bin, count(*) AS n, lo FROM lineitem, ends GROUP BY 1, 2, lo),
hist AS (SELECT h, bin, lo + 500.0 * (bin + 0.5) AS center, n / sum(n) OVER (PARTITION BY h) AS share FROM counts)"""


def _histogram(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("h"), F.col("l_extendedprice").alias("price"))
    return quantile.density(rows, 500.0)


@query(f"WITH {_DENSITY} SELECT h, bin, {r('center', 4)} AS center, {r('share', 9)} AS share FROM hist")
def density_heatmap(spark, sf):
    return shown(_histogram(spark, sf), "h", "bin", center=4, share=9)


@query(f"""WITH {_DENSITY}, run AS (SELECT *, sum(share) OVER (PARTITION BY h ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c FROM hist)
SELECT h, {r('min(center) FILTER (c >= 0.04999999)', 4)} AS lo, {r('min(center) FILTER (c >= 0.95000001)', 4)} AS hi FROM run GROUP BY h""")
def histogram_coverage(spark, sf):
    return shown(quantile.histogram_bounds(_histogram(spark, sf), 90.000002), "h", lo=4, hi=4)


_PARTS = """parts AS (SELECT l_linenumber AS h, l_returnflag AS part, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, count(*) / sum(count(*)) OVER (PARTITION BY l_linenumber) AS weight
  FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {_PARTS}, ends AS (SELECT greatest(min(mean - 4 * std), max(mean + 4 * std) * 1e-6) AS lo, max(mean + 4 * std) AS hi FROM parts),
cells AS (SELECT *, lo + 2000.0 * (bin + 0.5) AS center FROM parts, (SELECT lo, unnest(range(least(greatest(ceil((hi - lo) / 2000.0), 1), 2000)::BIGINT)) AS bin FROM ends))
SELECT h, bin, {r('any_value(center)', 4)} AS center, {r('sum(weight * exp(-0.5 * power((center - mean) / greatest(std, 1e-6), 2)))', 9)} AS z FROM cells GROUP BY h, bin""")
def mixture_grid(spark, sf):
    from pyspark.sql.window import Window as W

    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("h"), F.col("l_returnflag").alias("part")).agg(F.avg("l_extendedprice").alias("mean"), F.stddev_pop("l_extendedprice").alias("std"), F.count("*").alias("n"))
    rows = rows.withColumn("weight", F.col("n") / F.sum("n").over(W.partitionBy("h")))
    return shown(quantile.mixture_grid(rows, 2000.0), "h", "bin", center=4, z=9)


@query(f"SELECT l_shipmode, {r('quantile_cont(l_extendedprice, 0.05)', 4)} AS z_low, {r('quantile_cont(l_extendedprice, 0.95)', 4)} AS z_high FROM (SELECT *, l_linenumber AS l_shipmode FROM lineitem) GROUP BY 1")
def contrast_range(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_shipmode", F.col("l_linenumber"))
    return shown(quantile.contrast(rows, "l_extendedprice", 5.0, ("l_shipmode",)), "l_shipmode", z_low=4, z_high=4)


# ── zigzag and the band ─────────────────────────────────────────────────────

_T = 0.05
_ZIGZAG = f"""zz AS (SELECT ticker, -1::BIGINT AS i, 0 AS dir, (log_high + log_low) / 2.0 AS ext, 0::BIGINT AS ext_i, -6::BIGINT AS last_i, NULL::DOUBLE AS price, NULL::BIGINT AS price_i, NULL::INT AS side FROM logged WHERE i = 0
  UNION ALL SELECT ticker, bi,
    CASE ev WHEN 'up' THEN 1 WHEN 'down' THEN -1 WHEN 'turn' THEN -dir ELSE dir END,
    CASE WHEN ev = 'up' OR (ev = 'more' AND dir = 1) OR (ev = 'turn' AND dir = -1) THEN lh WHEN ev = '' THEN ext ELSE ll END,
    CASE WHEN ev = '' THEN ext_i ELSE bi END, CASE WHEN ev = 'turn' THEN bi ELSE last_i END,
    CASE WHEN ev = 'turn' THEN ext END, CASE WHEN ev = 'turn' THEN ext_i END, CASE WHEN ev = 'turn' THEN dir END
  FROM (SELECT z.*, b.i AS bi, b.log_high AS lh, b.log_low AS ll, CASE
      WHEN dir = 0 AND b.log_high - ext >= {_T} THEN 'up' WHEN dir = 0 AND ext - b.log_low >= {_T} THEN 'down'
      WHEN dir = 1 AND b.log_high > ext THEN 'more' WHEN dir = -1 AND b.log_low < ext THEN 'more'
      WHEN dir = 1 AND ext - b.log_low >= {_T} AND b.i - last_i >= 5 THEN 'turn' WHEN dir = -1 AND b.log_high - ext >= {_T} AND b.i - last_i >= 5 THEN 'turn' ELSE '' END AS ev
    FROM zz z JOIN logged b ON b.ticker = z.ticker AND b.i = z.i + 1)),
pivots AS (SELECT z.ticker, row_number() OVER (PARTITION BY z.ticker ORDER BY z.i) - 1 AS seq, z.price AS log_price, z.price_i AS extreme_i, z.i AS confirm_i, z.side AS direction,
  e.begin AS extreme_begin, c.begin AS confirm_begin FROM zz z JOIN placed e ON e.ticker = z.ticker AND e.i = z.price_i JOIN placed c ON c.ticker = z.ticker AND c.i = z.i WHERE z.side IS NOT NULL)"""
_LEGS = """legs AS (SELECT *, confirm_i - lag(confirm_i) OVER s AS duration, log_price - lag(log_price) OVER s AS log_move FROM pivots WINDOW s AS (PARTITION BY ticker ORDER BY seq)),
aged AS (SELECT *, CASE WHEN duration IS NOT NULL AND count(duration) OVER f >= 3 THEN len(list_filter(list(duration) OVER f, lambda x : x < duration))::DOUBLE / count(duration) OVER f END AS rank_leg_age
  FROM legs WINDOW f AS (PARTITION BY ticker ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"""
_ALL_RANKS = [f"rank_{f}" for f in ranks.FEATURES]
_PIVOT_RANKS = f"""known AS (SELECT a.*, {', '.join(f'b.{x}' for x in _ALL_RANKS)} FROM aged a JOIN bar_ranks b ON b.ticker = a.ticker AND b.begin = a.confirm_begin)"""


def _pivots(spark, sf):
    return zigzag.pivots(bars.logged(walk(spark, sf)), _T)


@query(on_bars("walk", f"SELECT ticker, seq, extreme_begin, confirm_begin, extreme_i, confirm_i, direction, {r('log_price', 9)} AS log_price FROM pivots", PLACED, LOGGED, _ZIGZAG, recursive=True))
def zigzag_pivots(spark, sf):
    return shown(_pivots(spark, sf), "ticker", "seq", "extreme_begin", "confirm_begin", "extreme_i", "confirm_i", "direction", log_price=9)


_STATS = ", ".join(f"{r(f'{f}', 6)} AS {n}" for n, f in {
    "duration_median": "median(duration)", "duration_mean": "avg(duration)", "duration_std": "coalesce(stddev_samp(duration), 0)",
    "amplitude_median": "median(p)", "amplitude_mean": "avg(p)", "amplitude_std": "coalesce(stddev_samp(p), 0)"}.items())


@query(on_bars("walk", f"SELECT ticker, direction, count(*) AS n, {_STATS} FROM (SELECT *, (exp(abs(log_move)) - 1) * 100 AS p FROM legs WHERE duration IS NOT NULL) GROUP BY 1, 2", PLACED, LOGGED, _ZIGZAG, _LEGS, recursive=True))
def zigzag_leg_stats(spark, sf):
    found = zigzag.leg_statistics(_pivots(spark, sf))
    return shown(found, "ticker", "direction", "n", **{f"{v}_{s}": 6 for v in ("duration", "amplitude") for s in ("median", "mean", "std")})


_WIDTH = "coalesce(CASE WHEN count(duration) FILTER (direction = {d}) >= 5 THEN median(duration) FILTER (direction = {d}) END, 5)"


@query(on_bars("walk", f"""SELECT ticker, direction, CASE WHEN direction = 1 THEN bottom ELSE top END AS step1, CASE WHEN direction = 1 THEN top ELSE bottom END AS step2 FROM (
  SELECT ticker, max_by(direction, seq) AS direction, {_WIDTH.format(d=1)}::DOUBLE AS top, {_WIDTH.format(d=-1)}::DOUBLE AS bottom FROM legs GROUP BY ticker)""", PLACED, LOGGED, _ZIGZAG, _LEGS, recursive=True))
def step_widths(spark, sf):
    return zigzag.step_widths(_pivots(spark, sf))


@query(on_bars("walk", f"SELECT ticker, seq, duration, {r('rank_leg_age', 9)} AS rank_leg_age FROM aged", PLACED, LOGGED, _ZIGZAG, _LEGS, recursive=True))
def pivot_leg_ranks(spark, sf):
    return shown(zigzag.leg_ranks(_pivots(spark, sf)), "ticker", "seq", "duration", rank_leg_age=9)


@query(on_bars("walk", """SELECT d.ticker, d.day, max_by(p.seq, p.seq) AS seq, max_by(p.confirm_begin, p.seq) AS confirm_begin FROM (
  SELECT ticker, CAST(unnest(generate_series(DATE '1994-12-30', DATE '2001-12-30', INTERVAL 11 DAY)) AS DATE) AS day FROM (SELECT DISTINCT ticker FROM bars)) d
LEFT JOIN pivots p ON p.ticker = d.ticker AND CAST(p.extreme_begin AS DATE) <= d.day GROUP BY 1, 2""", PLACED, LOGGED, _ZIGZAG, recursive=True))
def pivot_at_day(spark, sf):
    found = _pivots(spark, sf)
    days = walk(spark, sf).select("ticker").distinct().select("ticker", F.explode(F.expr("sequence(date'1994-12-30', date'2001-12-30', interval 11 day)")).alias("day"))
    return zigzag.pivot_at(found, days).select("ticker", "day", "seq", "confirm_begin")


def _lags(c: str, m: int = 6) -> str:
    return ", ".join(f"lag({c}, {k}) OVER s AS f{k}" if k else f"{c} AS f0" for k in range(m))


def _pool(source: str, h: int, name: str = "pool") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, {_lags('log_move')}, lead(log_price, {h}) OVER s - log_price AS target FROM {source} WINDOW s AS (PARTITION BY ticker ORDER BY seq))
  WHERE f5 IS NOT NULL AND target IS NOT NULL AND rank_leg_age IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in _ALL_RANKS)})"""


_BAND_BASE = (PLACED, LOGGED, RAWS, RANKED, _ZIGZAG, _LEGS, _PIVOT_RANKS)


@query(on_bars("walk", f"SELECT ticker, seq, {r('f0', 9)} AS newest, {r('f5', 9)} AS oldest, {r('target', 9)} AS target FROM pool", *_BAND_BASE, _pool("known", 2), recursive=True))
def pool_vectors(spark, sf):
    found = zigzag.pool(band.ranked_pivots(walk(spark, sf), _T), 6, 2, band.RANKS)
    return shown(found.select("ticker", "seq", F.get("features", F.lit(0)).alias("newest"), F.get("features", F.lit(5)).alias("oldest"), "target"), "ticker", "seq", newest=9, oldest=9, target=9)


_ORIGIN = f"""origin AS (SELECT confirm_begin AS o_at, direction AS o_side, log_price AS o_price, {', '.join(f'o{k}' for k in range(6))} FROM (
  SELECT *, {_lags('log_move').replace(' AS f', ' AS o')}, count(*) OVER (PARTITION BY ticker) AS n FROM known WHERE ticker = 'A' WINDOW s AS (PARTITION BY ticker ORDER BY seq))
  WHERE n >= 9 AND rank_leg_age IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in _ALL_RANKS)}
    AND seq = (SELECT max(seq) FROM known WHERE ticker = 'A')),
before AS (SELECT * FROM known, origin WHERE confirm_begin <= o_at)"""


def _band(theta: float) -> str:
    d = "sqrt(" + " + ".join(f"power(f{k} - o{k}, 2)" for k in range(6)) + ")"
    weigh = lambda h: f"weighed{h} AS (SELECT *, count(*) OVER () AS pool_size, {f'exp(-{theta} * d / avg(d) OVER ())' if theta else '1.0::DOUBLE'} AS w, {h} AS h FROM (SELECT *, {d} AS d FROM pool{h} WHERE direction = o_side) QUALIFY count(*) OVER () >= 8)"
    read = lambda h: weighted(f"weighed{h}", "h, pool_size, o_price, o_at, o_side", "target", "w", _QS, "confirm_begin, ticker")
    select = f"SELECT h, pool_size, o_at AS origin, o_side AS direction, q, {r('quantile')} AS log_return, {r('exp(o_price + quantile)', 4)} AS price FROM ({read(1)} UNION ALL {read(2)})"
    return on_bars("walk", select, *_BAND_BASE, _ORIGIN, _pool("before", 1, "pool1"), _pool("before", 2, "pool2"), weigh(1), weigh(2), recursive=True)


def _forecast(spark, sf, theta):
    found = written(band.ranked_pivots(walk(spark, sf), _T), "pivots")
    return shown(band.forecast(found, "A", theta=theta), "h", "pool_size", "origin", "direction", "q", log_return=6, price=4)


@query(_band(0))
def band_forecast(spark, sf):
    return _forecast(spark, sf, 0.0)


@query(_band(1.0))
def band_forecast_smap(spark, sf):
    return _forecast(spark, sf, 1.0)


@query()
def band_zones(spark, sf):
    found = written(band.ranked_pivots(walk(spark, sf), _T), "pivots")
    return shown(band.zones(found, "A"), "h", "level", lo=4, hi=4, boundary=4)


# ── neighbours ──────────────────────────────────────────────────────────────

_LAST = "last AS (SELECT ticker, max(i) AS origin FROM placed GROUP BY ticker)"


def _l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z : (z[1] - z[2]) * (z[1] - z[2]))))"


@query(on_bars("walk", f"""SELECT ticker, i, begin, rank, {r('d', 9)} AS d FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d, i) AS rank FROM (
  SELECT x.ticker, x.i, x.begin, {_l2('x.win', 'q.win')} AS d FROM delays x JOIN last USING (ticker) JOIN delays q ON q.ticker = x.ticker AND q.i = origin WHERE x.i < origin - 5)) WHERE rank <= 20""",
    PLACED, RATIOS, windows(8), _LAST))
def knn_l2(spark, sf):
    rows = range_zones.prepared(walk(spark, sf), 5, 8).withColumn("origin", F.max("i").over(range_zones.whole()))
    queries = rows.where("i = origin").select("ticker", F.col("window").alias("query"))
    pairs = rows.where("window is not null and i < origin - 5").join(queries, "ticker")
    return shown(neighbors.nearest(neighbors.with_distance(pairs), 20, ("ticker",)), "ticker", "i", "begin", "rank", d=9)


def _amp_cos(alpha: float, source: str) -> str:
    """Distances of rows with the lists win and qwin."""
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z : z[1] * z[2]))"
    return f"""amp AS (SELECT *, abs(ln(nx / nq)) AS amplitude, 1 - greatest(least(xq / (nx * nq), 1), -1) AS shape FROM (
  SELECT *, sqrt({dot('win', 'win')}) AS nx, sqrt({dot('qwin', 'qwin')}) AS nq, {dot('win', 'qwin')} AS xq FROM {source})),
blend AS (SELECT *, {alpha} * amplitude / greatest(max(amplitude) OVER (PARTITION BY ticker), 1e-10) + {1 - alpha} * shape / greatest(max(shape) OVER (PARTITION BY ticker), 1e-10) AS d FROM amp)"""


_RATIO_PAIRS = "pairs AS (SELECT x.*, q.win AS qwin, lead(x.ratio) OVER (PARTITION BY x.ticker ORDER BY x.i) AS next FROM delays x JOIN last USING (ticker) JOIN delays q ON q.ticker = x.ticker AND q.i = origin QUALIFY x.i < origin)"


def _ratio_pairs(spark, sf):
    rows = trend.causal_trend(walk(spark, sf))
    rows = ranks.delay_windows(rows, 6, "ratio").withColumns({"next": F.lead("ratio").over(range_zones.W.partitionBy("ticker").orderBy("begin")), "origin": F.max("i").over(range_zones.whole())})
    queries = rows.where("i = origin").select("ticker", F.col("window").alias("query"))
    pairs = rows.where("window is not null and i < origin").join(queries, "ticker")
    return neighbors.with_amp_cos(pairs, 0.5, ("ticker",))


@query(on_bars("walk", f"SELECT ticker, i, rank, {r('d', 8)} AS d FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d, i) AS rank FROM blend) WHERE rank <= 12", PLACED, RATIOS, windows(6, value="ratio"), _LAST, _RATIO_PAIRS, _amp_cos(0.5, "pairs")))
def amp_cos_topk(spark, sf):
    return shown(neighbors.nearest(_ratio_pairs(spark, sf), 12, ("ticker",)), "ticker", "i", "rank", d=8)


@query(on_bars("walk", f"""SELECT ticker, {r('sum(w * next) / sum(w)', 8)} AS prediction FROM (SELECT *, exp(-d / greatest(min(d) OVER (PARTITION BY ticker), 1e-10)) AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d, i) AS rank FROM blend) WHERE rank <= 4) GROUP BY ticker""", PLACED, RATIOS, windows(6, value="ratio"), _LAST, _RATIO_PAIRS, _amp_cos(0.5, "pairs")))
def simplex_step(spark, sf):
    near = neighbors.nearest(_ratio_pairs(spark, sf), 4, ("ticker",))
    return shown(neighbors.simplex_step(near, "next", ("ticker",)), "ticker", prediction=8)


# ── range zones ─────────────────────────────────────────────────────────────

_NEAR = f"""near AS (SELECT *, exp(-4.0 * d / greatest(avg(d) OVER (PARTITION BY ticker), 1e-10)) AS w FROM (
  SELECT x.*, q.close AS anchor, {_l2('x.win', 'q.win')} AS d FROM delays x JOIN last USING (ticker) JOIN delays q ON q.ticker = x.ticker AND q.i = origin WHERE x.i < origin - 5)),
outcome AS (SELECT ticker, i, anchor, w, count(*) OVER (PARTITION BY ticker) AS neighbors, h, (CASE h WHEN 1 THEN low_1 WHEN 2 THEN low_2 WHEN 3 THEN low_3 WHEN 4 THEN low_4 ELSE low_5 END - close) / close AS low,
  (CASE h WHEN 1 THEN high_1 WHEN 2 THEN high_2 WHEN 3 THEN high_3 WHEN 4 THEN high_4 ELSE high_5 END - close) / close AS high
  FROM near, (SELECT unnest([1, 2, 3, 4, 5]) AS h) WHERE low_5 IS NOT NULL),
sized AS (SELECT * REPLACE (neighbors // 5 AS neighbors) FROM outcome)"""
_ENDS = [(50.0, 0.25, 0.75), (75.0, 0.125, 0.875), (90.0, 0.05, 0.95)]


def _zones(source: str, w: str) -> str:
    by = "ticker, h, anchor, neighbors"
    low = weighted(source, by, "low", w, [e[1] for e in _ENDS], "i")
    high = weighted(source, by, "high", w, [e[2] for e in _ENDS], "i")
    return f"""SELECT l.ticker, l.h, e.level, {r('l.anchor * (1 + l.quantile)', 4)} AS low, {r('u.anchor * (1 + u.quantile)', 4)} AS high, l.neighbors
FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in _ENDS)}) e(level, ql, qh) JOIN ({low}) l ON l.q = e.ql JOIN ({high}) u ON u.q = e.qh AND u.ticker = l.ticker AND u.h = l.h"""


@query(on_bars("walk", _zones("sized", "w"), PLACED, RATIOS, AHEAD.format(source="steps"), windows(8, source="ahead"), _LAST, _NEAR))
def range_forecast_zones(spark, sf):
    return shown(range_zones.zones(range_zones.neighbors(walk(spark, sf), theta=4.0)), "ticker", "h", "level", "neighbors", low=4, high=4)


@query(on_bars("walk", _zones("sized", "w"), PLACED, AHEAD.format(source="placed"), _LAST,
    _NEAR.replace(_NEAR[: _NEAR.index("outcome AS")], "near AS (SELECT x.*, q.close AS anchor, 1.0::DOUBLE AS w FROM ahead x JOIN last USING (ticker) JOIN placed q ON q.ticker = x.ticker AND q.i = origin WHERE x.i < origin - 5),\n")))
def unconditional_zones(spark, sf):
    return shown(range_zones.unconditional(walk(spark, sf)), "ticker", "h", "level", "neighbors", low=4, high=4)


# ── calibration ─────────────────────────────────────────────────────────────

_CAL = calibrate.Settings()
_GRID = [0.0, 2.0, 4.0, 6.0, 8.0]
_CONTEXT = f"""origins AS (SELECT ticker, i AS o, CASE WHEN i >= e - 300 AND i < e THEN -1 WHEN i >= e - 905 AND i < e - 305 THEN (i - (e - 905)) // 200 END::INT AS fold
  FROM (SELECT *, (SELECT origin FROM last l WHERE l.ticker = p.ticker) - 5 AS e FROM placed p) WHERE e - 905 >= 33),
ctx AS (SELECT f.ticker, f.fold, f.o, q.close AS anchor, q.low_5 AS alow, q.high_5 AS ahigh, x.i, (x.low_5 - x.close) / x.close AS low, (x.high_5 - x.close) / x.close AS high, x.win, q.win AS qwin
  FROM origins f JOIN {{delays}} q ON q.ticker = f.ticker AND q.i = f.o JOIN {{delays}} x ON x.ticker = f.ticker AND x.i <= f.o - 6 WHERE f.fold IS NOT NULL AND x.low_5 IS NOT NULL)"""


def _loss(table_: str, ql: float = 0.05, qh: float = 0.95) -> str:
    """Mean pinball loss relative to the anchor, from rows with lo and hi quantiles."""
    pin = lambda a, b, t: f"greatest({t} * ({a} - {b}), ({t} - 1) * ({a} - {b}))"
    return f"({pin('alow', 'anchor * (1 + lo)', ql)} + {pin('ahigh', 'anchor * (1 + hi)', qh)}) / 2 / anchor"


def _both(source: str, by: str, w: str) -> str:
    a, b = weighted(source, by, "low", w, [0.05], "i"), weighted(source, by, "high", w, [0.95], "i")
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    return f"(SELECT a.*, a.quantile AS lo, b.quantile AS hi FROM ({a}) a JOIN ({b}) b ON {on})"


_BY = "ticker, fold, o, anchor, alow, ahigh"
_SCORES = f"""grid AS (SELECT c.*, v AS value, exp(-v * d / greatest(avg(d) OVER (PARTITION BY ticker, fold, o, v), 1e-10)) AS w FROM (SELECT *, {_l2('win', 'qwin')} AS d FROM ctx) c, (SELECT unnest({_GRID}::DOUBLE[]) AS v)),
pb AS (SELECT ticker, fold, value, avg({_loss('')}) AS loss, avg((anchor * (1 + lo) <= alow AND ahigh <= anchor * (1 + hi))::INT) AS coverage, count(*) AS n FROM {_both('grid', _BY + ', value', 'w')} GROUP BY 1, 2, 3),
plain AS (SELECT f.ticker, f.fold, f.o, q.close AS anchor, q.low_5 AS alow, q.high_5 AS ahigh, x.i, (x.low_5 - x.close) / x.close AS low, (x.high_5 - x.close) / x.close AS high, 1.0::DOUBLE AS w
  FROM origins f JOIN ahead q ON q.ticker = f.ticker AND q.i = f.o JOIN ahead x ON x.ticker = f.ticker AND x.i <= f.o - 6 WHERE f.fold IS NOT NULL AND x.low_5 IS NOT NULL),
pbu AS (SELECT ticker, fold, avg({_loss('')}) AS loss FROM {_both('plain', _BY, 'w')} GROUP BY 1, 2),
scores AS (SELECT p.ticker, p.fold, p.value, p.loss / u.loss AS ratio, p.coverage, p.n FROM pb p JOIN pbu u USING (ticker, fold) WHERE p.n >= 25)"""
_CAL_CTES = (PLACED, RATIOS, AHEAD.format(source="steps"), windows(8, source="ahead"), _LAST, _CONTEXT.format(delays="delays"), _SCORES)


def _scores(spark, sf):
    rows = walk(spark, sf)
    trials = [calibrate.Trial(v, (("theta", v),), _CAL.tails) for v in _GRID]
    context = calibrate.contexts(rows, _CAL, ())
    names = {t: trials for t in ("A", "N", "R")}
    return calibrate.scores(calibrate.losses(context, names, _CAL.tails), calibrate.baseline(rows, _CAL), _CAL.least)


@query(on_bars("walk", f"SELECT ticker, fold, value, {r('ratio')} AS ratio, {r('coverage')} AS coverage, n FROM scores", *_CAL_CTES))
def calibration_pass_theta(spark, sf):
    return shown(_scores(spark, sf), "ticker", "fold", "value", "n", ratio=6, coverage=6)


@query(on_bars("walk", """SELECT DISTINCT ticker, round(value, 3) AS value FROM (
  SELECT ticker, min_by(value, s) AS value FROM smooth GROUP BY ticker, fold UNION ALL SELECT ticker, min_by(value, s) FROM pooled GROUP BY ticker UNION ALL SELECT DISTINCT ticker, 0.0 FROM scores)""", *_CAL_CTES,
    """smooth AS (SELECT ticker, fold, value, avg(ratio) OVER w AS s FROM scores WHERE fold >= 0 WINDOW w AS (PARTITION BY ticker, fold ORDER BY value ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) QUALIFY count(*) OVER w = 3),
pooled AS (SELECT ticker, value, avg(ratio) OVER w AS s FROM (SELECT ticker, value, avg(ratio) AS ratio FROM scores WHERE fold >= 0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY ticker ORDER BY value ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) QUALIFY count(*) OVER w = 3)"""))  # fmt: skip
def candidate_values(spark, sf):
    return calibrate.candidates(written(_scores(spark, sf), "scores"))


_STEP_GRID = (0.0, 2.0, 4.0, 6.0, 8.0)


def _step(name: str, exponent: str, source: str) -> str:
    """One step of the descent in SQL: scores of a grid ``v``, candidates of the folds and their mean, and the winner on the holdout."""
    return f"""g_{name} AS (SELECT c.*, v AS value, exp(-({exponent})) AS w FROM {source} c, (SELECT unnest({list(_STEP_GRID)}::DOUBLE[]) AS v)),
p_{name} AS (SELECT ticker, fold, value, avg({_loss('')}) AS loss, avg((anchor * (1 + lo) <= alow AND ahigh <= anchor * (1 + hi))::INT) AS coverage, count(*) AS n FROM {_both(f'g_{name}', _BY + ', value', 'w')} GROUP BY 1, 2, 3),
s_{name} AS (SELECT p.ticker, p.fold, p.value, p.loss / u.loss AS ratio, p.coverage, p.n FROM p_{name} p JOIN pbu u USING (ticker, fold) WHERE p.n >= 25),
m_{name} AS (SELECT ticker, fold, value, avg(ratio) OVER w AS s FROM s_{name} WHERE fold >= 0 WINDOW w AS (PARTITION BY ticker, fold ORDER BY value ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) QUALIFY count(*) OVER w = 3),
a_{name} AS (SELECT ticker, value, avg(ratio) OVER w AS s FROM (SELECT ticker, value, avg(ratio) AS ratio FROM s_{name} WHERE fold >= 0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY ticker ORDER BY value ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) QUALIFY count(*) OVER w = 3),
c_{name} AS (SELECT DISTINCT ticker, value FROM (SELECT ticker, min_by(value, s) AS value FROM m_{name} GROUP BY ticker, fold UNION ALL SELECT ticker, min_by(value, s) FROM a_{name} GROUP BY ticker UNION ALL SELECT DISTINCT ticker, 0.0 FROM s_{name})),
won_{name} AS (SELECT ticker, min_by(value, ratio) AS {name}, min(ratio) AS ratio, min_by(coverage, ratio) AS coverage FROM s_{name} JOIN c_{name} USING (ticker, value) WHERE fold = -1 GROUP BY ticker)"""


_RANKED_CONTEXT = _CONTEXT.format(delays="shapes").replace("x.win, q.win AS qwin", "x.win, q.win AS qwin, power(x.rank_velocity - q.rank_velocity, 2) AS sq")
_PASS = (
    f"""shapes AS (SELECT d.*, b.rank_velocity FROM delays d JOIN bar_ranks b ON b.ticker = d.ticker AND b.begin = d.begin WHERE b.rank_velocity IS NOT NULL),
{_RANKED_CONTEXT},
far AS (SELECT *, d / greatest(avg(d) OVER (PARTITION BY ticker, fold, o), 1e-10) AS dd FROM (SELECT *, {_l2('win', 'qwin')} AS d FROM ctx)),
{_SCORES[_SCORES.index('plain AS'):_SCORES.index(',' + chr(10) + 'scores AS')]}""",
    _step("theta", "v * dd", "far"),
    _step("velocity", "theta * dd + v * sq", "(SELECT * FROM far JOIN won_theta USING (ticker))"),
)


@query(on_bars("walk", f"SELECT t.ticker, theta, velocity, {r('v.ratio')} AS ratio, {r('v.coverage')} AS coverage FROM won_theta t JOIN won_velocity v ON v.ticker = t.ticker",
    PLACED, LOGGED, RAWS, RANKED, RATIOS, AHEAD.format(source="steps"), windows(8, source="ahead"), _LAST, *_PASS))
def calibration_one_pass(spark, sf):
    """One pass of the descent over theta and then, with the theta found, the weight of velocity."""
    rows, used = walk(spark, sf), ("velocity",)
    context = written(calibrate.with_baseline(calibrate.contexts(rows, _CAL, used), calibrate.baseline(rows, _CAL)), "blocks")
    tickers = [x["ticker"] for x in context.select("ticker").distinct().collect()]
    best = calibrate.calibrate(context, None, tickers, replace(_CAL, passes=1, refine=0.0), used, dict.fromkeys(("theta", *used), _STEP_GRID))
    found = spark.createDataFrame([(t, p["theta"], p["velocity"]) for t, p in best.items()], "ticker string, theta double, velocity double")
    trials = {t: [calibrate.Trial(1.0, tuple(p.items()), _CAL.tails)] for t, p in best.items()}
    base = calibrate.baseline(rows, _CAL)
    held = calibrate.scores(calibrate.losses(context, trials, _CAL.tails), base, _CAL.least).where(F.col("fold") == calibrate.HOLDOUT)
    return shown(found.join(held, "ticker"), "ticker", "theta", "velocity", ratio=6, coverage=6)


@query()
def calibration(spark, sf):
    """The whole calibration at the default folds and grids; a test scores the parameters found in SQL."""
    found = calibrate.calibration(walk(spark, sf), levels=(75.0, 50.0))
    return shown(found, "ticker", "level", "n", theta=3, **dict.fromkeys(ranks.FEATURES, 3), read_low=3, read_high=3, ratio=6, plain_ratio=6, coverage=6)


# ── corridor ────────────────────────────────────────────────────────────────

_H, _P, _N = 20, 20, 15_000
_CORRIDOR = f"""line AS (SELECT ticker, regr_slope(ln(close), i) AS b, regr_intercept(ln(close), i) AS a, max(i) AS origin FROM placed GROUP BY ticker),
lined AS (SELECT p.*, a, b, origin, close / exp(a + b * i) AS rc, high / exp(a + b * i) AS rh, low / exp(a + b * i) AS rl FROM placed p JOIN line USING (ticker)),
moves AS (SELECT *, rc - lag(rc) OVER s AS dc, rh - lag(rh) OVER s AS dh, rl - lag(rl) OVER s AS dl FROM lined WINDOW s AS (PARTITION BY ticker ORDER BY begin)),
{windows(_P, source="moves", value="dc")},
pairs AS (SELECT x.*, q.win AS qwin FROM delays x JOIN delays q ON q.ticker = x.ticker AND q.i = x.origin WHERE x.i <= x.origin - {_H} AND abs(x.i - x.origin) > {_P + 5}),
{_amp_cos(0.75, "pairs")},
kernel AS (SELECT *, 1 / (1 + power(d / (avg(d) OVER (PARTITION BY ticker) / 20.0), 2)) AS k FROM blend),
analogs AS (SELECT ticker, i, d, k / sum(k) OVER (PARTITION BY ticker) AS w FROM kernel)"""


def _corridor(spark, sf):
    rows = corridor.steps(walk(spark, sf), _P)
    return rows, corridor.pool(rows, _P, _H)


@query(on_bars("walk", f"SELECT ticker, i, {r('d', 8)} AS d, {r('w', 9)} AS weight FROM analogs", PLACED, _CORRIDOR))
def corridor_pool(spark, sf):
    return shown(_corridor(spark, sf)[1], "ticker", "i", d=8, weight=9)


@query(on_bars("walk", f"""SELECT ticker, h, {r('(rc + path) * exp(a + b * (origin + h))', 4)} AS price FROM (
  SELECT ticker, h, sum(move) OVER (PARTITION BY ticker ORDER BY h ROWS UNBOUNDED PRECEDING) AS path FROM (
    SELECT g.ticker, h, sum(g.w * m.dc) AS move FROM analogs g, (SELECT unnest(range(1, {_H + 1})) AS h) JOIN moves m ON m.ticker = g.ticker AND m.i = g.i + h GROUP BY 1, 2))
JOIN (SELECT * FROM lined WHERE i = origin) USING (ticker)""", PLACED, _CORRIDOR))
def analog_paths(spark, sf):
    rows, pool = _corridor(spark, sf)
    return shown(corridor.expected(rows, pool, _H), "ticker", "h", price=4)


_SIMULATED = f"""totals AS (SELECT ticker, i, sum(w) OVER (PARTITION BY ticker ORDER BY i ROWS UNBOUNDED PRECEDING) AS hi FROM analogs),
ranges AS (SELECT ticker, i, CASE WHEN lead(i) OVER s IS NULL THEN 2 ELSE hi END AS hi FROM totals WINDOW s AS (PARTITION BY ticker ORDER BY i)),
draws AS (SELECT ticker, sim, h, CAST('0x' || substr(md5(sim::VARCHAR || ':' || h::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT unnest(range({_N})) AS sim), (SELECT unnest(range(1, {_H + 1})) AS h), (SELECT DISTINCT ticker FROM analogs)),
drawn AS (SELECT d.ticker, sim, h, r.i FROM draws d ASOF JOIN ranges r ON r.ticker = d.ticker AND d.u <= r.hi),
went AS (SELECT r.ticker, sim, h, m.dc, m.dh, m.dl FROM drawn r JOIN moves m ON m.ticker = r.ticker AND m.i = r.i + h),
priced AS (SELECT w.ticker, sim, h, (o.rc + sum(dc) OVER p) * exp(a + b * (origin + h)) AS close, (o.rh + sum(dh) OVER p) * exp(a + b * (origin + h)) AS high, (o.rl + sum(dl) OVER p) * exp(a + b * (origin + h)) AS low
  FROM went w JOIN (SELECT * FROM lined WHERE i = origin) o ON o.ticker = w.ticker WINDOW p AS (PARTITION BY w.ticker, sim ORDER BY h ROWS UNBOUNDED PRECEDING)),
ran AS (SELECT *, 1.0::DOUBLE AS w, max(high) OVER p AS run_high, min(low) OVER p AS run_low FROM priced WINDOW p AS (PARTITION BY ticker, sim ORDER BY h ROWS UNBOUNDED PRECEDING))"""


def _bound(value: str, q: float) -> str:
    return f"({weighted('ran', 'ticker, h', value, 'w', [q], 'sim')})"


@query(on_bars("walk", f"""SELECT a.ticker, a.h, {r('a.quantile', 4)} AS close_low, {r('b.quantile', 4)} AS close_high, {r('c.quantile', 4)} AS risk_low, {r('d.quantile', 4)} AS risk_high
FROM {_bound('close', 0.025)} a JOIN {_bound('close', 0.975)} b USING (ticker, h) JOIN {_bound('run_low', 0.025)} c USING (ticker, h) JOIN {_bound('run_high', 0.975)} d USING (ticker, h)""", PLACED, _CORRIDOR, _SIMULATED))
def corridor_bounds(spark, sf):
    return shown(corridor.corridor(walk(spark, sf), _P, _H, n=_N), "ticker", "h", close_low=4, close_high=4, risk_low=4, risk_high=4)


# ── scenarios and ensembles ─────────────────────────────────────────────────

_BACKS = 2
_RS = regime.Settings()
_FIRST = max(_RS.warmup, max(lag for _, lag in regime.FEATURES))
_REGIME_STEPS = f"""origins AS (SELECT ticker, max(i) AS last FROM placed GROUP BY ticker),
held AS (SELECT p.*, o.last - back AS last, back FROM placed p JOIN origins o USING (ticker), (SELECT unnest(range({_BACKS}))::INT AS back) WHERE p.i <= o.last - back),
lined AS (SELECT * FROM held JOIN (SELECT ticker, back, regr_slope(ln(close), i) AS b, regr_intercept(ln(close), i) AS a FROM held GROUP BY 1, 2) USING (ticker, back)),
moves AS MATERIALIZED (SELECT *, ratio - lag(ratio) OVER s AS move FROM (SELECT *, close / exp(a + b * i) AS ratio FROM lined) WHERE i >= last - {_RS.bars} WINDOW s AS (PARTITION BY ticker, back ORDER BY i)),
{bank('moves', 'move', 'ticker, back')},
parts AS (SELECT k.*, {', '.join(f'comp_{k}' for k in range(6))}, CASE WHEN count(*) OVER w = {_RS.volatility} THEN stddev_pop(move) OVER w END AS vol FROM known k JOIN bank USING (ticker, back, n) WINDOW w AS (PARTITION BY ticker, back ORDER BY n ROWS {_RS.volatility - 1} PRECEDING)),
cuts AS (SELECT ticker, back, quantile_cont(vol, 1 / 3.0) AS c1, quantile_cont(vol, 2 / 3.0) AS c2, count(vol) AS known_vols FROM parts GROUP BY 1, 2),
seen AS (SELECT p.*, CASE WHEN vol IS NULL THEN -1 WHEN known_vols <= 10 THEN 0 ELSE (vol > c1)::INT + (vol > c2)::INT END AS regime,
  {', '.join(f'lag(comp_{k}, {lag}) OVER s AS f{c}' for c, (k, lag) in enumerate(regime.FEATURES))} FROM parts p JOIN cuts USING (ticker, back) WINDOW s AS (PARTITION BY ticker, back ORDER BY n))"""
_DIMS = range(len(regime.FEATURES))
_REGIME_POOL = f"""searches AS (SELECT ticker, back, last - i AS search, n AS q_n, regime AS q_regime, ratio AS q_ratio, {', '.join(f'f{c} AS q{c}' for c in _DIMS)} FROM seen WHERE last - i <= {_RS.lookback}),
pool_0 AS (SELECT x.*, q.* EXCLUDE (ticker, back) FROM seen x JOIN searches q ON q.ticker = x.ticker AND q.back = x.back AND x.n >= {_FIRST} AND x.n <= q.q_n - {_RS.horizon} - q.search QUALIFY count(*) OVER (PARTITION BY x.ticker, x.back, search) >= {_RS.least}),
pool_1 AS (SELECT * FROM pool_0 WINDOW g AS (PARTITION BY ticker, back, search) QUALIFY q_n - n > {_RS.theiler} OR count(*) FILTER (q_n - n > {_RS.theiler}) OVER g < {_RS.least}),
pool_2 AS (SELECT * FROM pool_1 WINDOW g AS (PARTITION BY ticker, back, search) QUALIFY regime = q_regime OR q_regime < 0 OR count(*) FILTER (regime = q_regime) OVER g < {_RS.least_regime}),
away AS (SELECT *, sqrt({' + '.join(f'power((f{c} - q{c}) / greatest(stddev_pop(f{c}) OVER g, 1e-12), 2)' for c in _DIMS)}) AS d FROM pool_2 WINDOW g AS (PARTITION BY ticker, back, search)),
weighed AS (SELECT *, exp(-0.5 * power(d / (avg(d) OVER g / {_RS.theta}), 2)) AS w FROM away WINDOW g AS (PARTITION BY ticker, back, search)),
analogs AS MATERIALIZED (SELECT *, w / sum(w) OVER (PARTITION BY ticker, back, search) / count(DISTINCT search) OVER (PARTITION BY ticker, back) AS weight FROM weighed)"""


@query(on_bars("walk", f"SELECT ticker, back, search::INT AS search, n::INT AS place, {r('weight', 9)} AS weight, {r('d', 7)} AS d FROM analogs", PLACED, _REGIME_STEPS, _REGIME_POOL, recursive=True))
def regime_pool(spark, sf):
    """The candidates of all searches of the last origins, with their weights: 18 features, regimes and fallbacks."""
    found = regime.pools(written(regime.featured(walk(spark, sf), _BACKS, 1, _RS), "steps"), _RS)
    return shown(found, "ticker", "back", "search", "place", weight=9, d=7)


@query(on_bars("walk", f"""SELECT g.ticker, g.back, h::INT AS h, count(*) AS paths, {r('sum(g.weight * (g.q_ratio + m.ratio - g.ratio) * exp(o.a + o.b * (o.i + h)))', 4)} AS mean, {r('min((g.q_ratio + m.ratio - g.ratio) * exp(o.a + o.b * (o.i + h)))', 4)} AS low
FROM analogs g, (SELECT unnest(range(1, {_RS.horizon + 1})) AS h) JOIN moves m ON m.ticker = g.ticker AND m.back = g.back AND m.i = g.i + search + h JOIN moves o ON o.ticker = g.ticker AND o.back = g.back AND o.i = o.last GROUP BY 1, 2, 3""",
    PLACED, _REGIME_STEPS, _REGIME_POOL, recursive=True))
def regime_paths(spark, sf):
    """The union of the lagged searches' paths, step by step: how many there are, their weighted mean and the lowest."""
    found = regime.price_paths(walk(spark, sf), _BACKS).groupBy("ticker", "back", "h").agg(F.count("*").alias("paths"), F.sum(F.col("weight") * F.col("price")).alias("mean"), F.min("price").alias("low"))
    return shown(found, "ticker", "back", "h", "paths", mean=4, low=4)


@written_once
def _mixtures(spark, sf):
    return regime.scenarios(walk(spark, sf))


@written_once
def _ensemble(spark, sf):
    return simplex.ensemble(walk(spark, sf))


@query()
def regime_mixture(spark, sf):
    return shown(_mixtures(spark, sf), "ticker", "back", "origin", "regime", "h", "part", mean=4, std=4, weight=6)


@query()
def regime_direction(spark, sf):
    return regime.dominant(_mixtures(spark, sf))


@query()
def simplex_ensemble(spark, sf):
    return shown(_ensemble(spark, sf), "ticker", "back", "origin", "dims", "h", rel=6)


@query()
def ensemble_band(spark, sf):
    return shown(simplex.band(_ensemble(spark, sf)), "ticker", "h", "origins", mean=6, std=6, p25=6, p75=6, lo=6, hi=6)
