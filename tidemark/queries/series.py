"""Queries on scans, averages, trends, ranks, regimes and spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import averages, bars, ranks, spectral, trend, window
from ..sources.fixtures import hourly, orders, raw, table, walk
from .common import LOGGED, PLACED, RATIOS, long_, on_bars, r, shown, windows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_OHLC = "ticker, begin, open, high, low, close, volume, round(value, 2) + 0.0 AS value"


def _ohlc(rows):
    return shown(rows, "ticker", "begin", "open", "high", "low", "close", "volume", value=2)


@query(on_bars("walk", f"SELECT {_OHLC} FROM bars"))
def bars_daily(spark, sf):
    return _ohlc(walk(spark, sf))


@query(on_bars("hourly", """SELECT ticker, time_bucket(INTERVAL '3 hours', begin) AS begin, min_by(open, begin) AS open, max(high) AS high, min(low) AS low,
  max_by(close, begin) AS close, sum(volume) AS volume, round(sum(value), 2) + 0.0 AS value FROM bars GROUP BY 1, 2"""))
def bars_resample_3(spark, sf):
    return _ohlc(bars.resampled(hourly(spark, sf), "3 hours"))


@query(on_bars("walk", f"SELECT {_OHLC} FROM bars WHERE begin > TIMESTAMP '1999-06-15' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY begin) <= 25"))
def bars_after_origin(spark, sf):
    return _ohlc(bars.after(walk(spark, sf), "1999-06-15", 25))


@query(on_bars("walk", f"SELECT {_OHLC} FROM bars WHERE begin BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31'"))
def bars_between(spark, sf):
    return _ohlc(bars.between(walk(spark, sf), "1998-01-01", "1999-12-31"))


@query(on_bars("walk", f"SELECT {_OHLC} FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY begin DESC) <= 100"))
def bars_last_n(spark, sf):
    return _ohlc(bars.newest(walk(spark, sf), 100))


@query(on_bars("walk", f"SELECT {_OHLC} FROM bars WHERE begin < TIMESTAMP '1999-06-15' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY begin DESC) <= 50"))
def keyset_page(spark, sf):
    # one more than a page is left where no bar begins at the origin
    return _ohlc(bars.newest(bars.page_before(walk(spark, sf), "1999-06-15", 50), 50))


@query(on_bars("hourly", "SELECT ticker, min(begin) AS first, max(begin) AS last, count(*) AS bars FROM bars GROUP BY ticker"))
def coverage_by_ticker(spark, sf):
    return bars.coverage(hourly(spark, sf))


@query(on_bars("orders", """SELECT d.ticker, d.day, coalesce((SELECT min(begin) FROM bars b WHERE b.ticker = d.ticker AND CAST(b.begin AS DATE) = d.day),
  (SELECT max(begin) FROM bars b WHERE b.ticker = d.ticker AND CAST(b.begin AS DATE) <= d.day)) AS origin
FROM (SELECT ticker, CAST(unnest(generate_series(DATE '1994-12-30', DATE '2001-08-10', INTERVAL 9 DAY)) AS DATE) AS day FROM (SELECT DISTINCT ticker FROM bars)) d"""))
def asof_origin(spark, sf):
    rows = orders(spark, sf)
    days = rows.select("ticker").distinct().select("ticker", F.explode(F.expr("sequence(date'1994-12-30', date'2001-08-10', interval 9 day)")).alias("day"))
    return bars.origins_at_days(rows, days)


@query(on_bars("hourly", "SELECT ticker, CAST(begin AS DATE) AS day, max(begin) AS begin, max_by(close, begin) AS close FROM bars GROUP BY 1, 2"))
def last_bar_of_day(spark, sf):
    return bars.last_of_days(hourly(spark, sf)).select("ticker", "day", "begin", "close")


@query(on_bars("orders", """SELECT a.ticker, a.begin, h.h, coalesce(b.begin, date_trunc('day', a.begin) + h.h * INTERVAL 1 DAY) AS future
FROM placed a, (SELECT unnest([1, 2, 3])::BIGINT AS h) h LEFT JOIN placed b ON b.ticker = a.ticker AND b.i = a.i + h.h""", PLACED))
def future_dates(spark, sf):
    return bars.future_dates(orders(spark, sf), 3).select("ticker", "begin", long_("h"), "future")


@query(on_bars("orders", "SELECT ticker, count(*) AS bars FROM bars GROUP BY ticker HAVING count(*) >= 1725"))
def history_guard(spark, sf):
    return bars.with_history(orders(spark, sf), 1725).groupBy("ticker").agg(F.count("*").alias("bars"))


@query(on_bars("walk", """SELECT ticker, begin, round(log_high, 9) + 0.0 AS log_high, round(log_low, 9) + 0.0 AS log_low, volume FROM logged l
WHERE begin <= TIMESTAMP '1999-06-15' AND (SELECT count(*) FROM bars b WHERE b.ticker = l.ticker AND b.begin <= TIMESTAMP '1999-06-15') >= 20""", PLACED, LOGGED))
def causal_logs(spark, sf):
    return shown(bars.logged(bars.causal(walk(spark, sf), "1999-06-15")), "ticker", "begin", "volume", log_high=9, log_low=9)


@query(on_bars("walk", f"""SELECT ticker, {r('lo - 0.06 * (hi - lo)')} AS y_low, {r('hi + 0.06 * (hi - lo)')} AS y_high FROM (
  SELECT ticker, min(low) AS lo, max(high) AS hi FROM bars WHERE begin BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31' GROUP BY ticker)"""))
def view_range(spark, sf):
    return shown(bars.view_range(walk(spark, sf), "1998-01-01", "1999-12-31"), "ticker", y_low=6, y_high=6)


@query(on_bars("walk", "SELECT ticker, begin, close FROM bars WHERE begin BETWEEN TIMESTAMP '1997-07-01' AND TIMESTAMP '1999-12-30'"))
def visible_bars(spark, sf):
    # a view of 1998-05-01 ... 1999-03-01 (304 days) and as much at either side
    return bars.visible(walk(spark, sf), "1998-05-01", "1999-03-01").select("ticker", "begin", "close")


@query(on_bars("walk", """SELECT ticker, min(begin) AS view_from, max(begin) + INTERVAL 5 DAY AS view_to FROM (
  SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY begin DESC) <= 200) GROUP BY ticker"""))
def default_view(spark, sf):
    return bars.default_view(walk(spark, sf))


@query(on_bars("raw", f"""SELECT ticker, begin, {r('volume * share')} AS buy, {r('volume - volume * share')} AS sell, close >= open AS rising FROM (
  SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS share FROM bars)"""))
def clv_buy_sell(spark, sf):
    return shown(bars.signed_volume(raw(spark, sf)), "ticker", "begin", "rising", buy=6, sell=6)


@query("""SELECT event_type AS ticker, max(ts) AS last_fetched, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-01-31 00:00:00') >= 300 AS stale FROM events GROUP BY event_type""")
def stale_series(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("ticker"), F.col("ts").alias("fetched_at"))
    return bars.stale(rows, F.to_timestamp(F.lit("2024-01-31 00:00:00")), 300)


_SMA = f"SELECT ticker, begin, {r('CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END')} AS sma FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY begin ROWS 19 PRECEDING)"


@query(on_bars("raw", _SMA))
def sma_20(spark, sf):
    return shown(averages.sma(raw(spark, sf), 20), "ticker", "begin", sma=6)


@query(on_bars("raw", _SMA))
def sma_20_in_chunks(spark, sf):
    rows = window.in_chunks(raw(spark, sf), lambda b, by, order: averages.sma(b, 20, by=by, order=order), 19, rows=500)
    return shown(rows, "ticker", "begin", sma=6)


_WMA = " + ".join(f"{20 - k} * lag(close, {k}) OVER w" if k else "20 * close" for k in range(20))


@query(on_bars("raw", f"SELECT ticker, begin, {r(f'({_WMA}) / 210.0')} AS wma FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY begin)"))
def wma_20(spark, sf):
    return shown(averages.wma(raw(spark, sf), 20), "ticker", "begin", wma=6)


_EMA = """ema AS (SELECT ticker, 19::BIGINT AS i, avg(close) AS ema FROM placed WHERE i < 20 GROUP BY ticker HAVING count(*) = 20
  UNION ALL SELECT e.ticker, p.i, e.ema + 2.0 / 21.0 * (p.close - e.ema) FROM ema e JOIN placed p ON p.ticker = e.ticker AND p.i = e.i + 1)"""


@query(on_bars("raw", f"SELECT p.ticker, p.begin, {r('e.ema')} AS ema FROM placed p LEFT JOIN ema e ON e.ticker = p.ticker AND e.i = p.i", PLACED, _EMA, recursive=True))
def ema_20(spark, sf):
    return shown(averages.ema(raw(spark, sf), 20), "ticker", "begin", ema=6)


def _sma(n: int) -> str:
    return f"SELECT ticker, begin, 'sma' AS kind, {n}::BIGINT AS period, {r('avg(close) OVER w')} AS average FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY begin ROWS {n - 1} PRECEDING) QUALIFY count(close) OVER w = {n}"


@query(on_bars("raw", f"""{_sma(5)} UNION ALL {_sma(50)} UNION ALL
SELECT ticker, begin, 'wma', 5, {r('(5 * close + 4 * lag(close) OVER w + 3 * lag(close, 2) OVER w + 2 * lag(close, 3) OVER w + lag(close, 4) OVER w) / 15.0')}
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY begin) QUALIFY lag(close, 4) OVER w IS NOT NULL"""))
def ma_multi_series(spark, sf):
    return shown(averages.moving_averages(raw(spark, sf), [("sma", 5), ("other", 50), ("wma", 5), ("sma", 1)]), "ticker", "begin", "kind", "period", average=6)


_OLS = """ols AS (SELECT ticker, begin, i, CASE WHEN i >= 49 THEN regr_slope(ln(close), i) OVER w END AS slope,
  CASE WHEN i >= 49 THEN greatest((regr_syy(ln(close), i) OVER w - regr_slope(ln(close), i) OVER w * regr_sxy(ln(close), i) OVER w) / 48, 0) END AS resid_var
  FROM placed WINDOW w AS (PARTITION BY ticker ORDER BY begin ROWS 49 PRECEDING))"""


@query(on_bars("walk", f"SELECT ticker, begin, {r('slope', 9)} AS slope, {r('resid_var', 9)} AS resid_var FROM ols", PLACED, _OLS))
def rolling_ols(spark, sf):
    return shown(trend.rolling_trend(walk(spark, sf), 50), "ticker", "begin", slope=9, resid_var=9)


@query(on_bars("walk", f"""SELECT ticker, begin, {r('CASE WHEN count(slope) OVER w = 20 THEN var_samp(slope) OVER w END', 12)} AS slope_var
FROM ols WINDOW w AS (PARTITION BY ticker ORDER BY begin ROWS 19 PRECEDING)""", PLACED, _OLS))
def slope_variance(spark, sf):
    return shown(trend.slope_variance(trend.rolling_trend(walk(spark, sf), 50), 20), "ticker", "begin", slope_var=12)


_FIT = """ends AS (SELECT *, max(i) OVER (PARTITION BY ticker) AS last FROM {source}),
fit AS (SELECT ticker, max(begin) AS origin, min(i) AS start, max(i) AS last, regr_slope(ln(close), i) AS slope, regr_intercept(ln(close), i) AS intercept,
  sqrt(greatest((regr_syy(ln(close), i) - regr_slope(ln(close), i) * regr_sxy(ln(close), i)) / 48, 0)) AS std
  FROM ends WHERE i > last - 50 GROUP BY ticker HAVING count(*) = 50),
ks AS (SELECT unnest([2.0, 1.0]::DOUBLE[]) AS k)"""


def _bands(log: str) -> str:
    return f"{r(f'exp({log})', 4)} AS price, {r(f'exp({log} + k * std)', 4)} AS hi, {r(f'exp({log} - k * std)', 4)} AS lo"


@query(on_bars("walk", f"SELECT p.ticker, p.begin, k, {_bands('intercept + slope * i')} FROM placed p JOIN fit f ON f.ticker = p.ticker AND p.i >= f.start, ks", PLACED, _FIT.format(source="placed")))
def trend_window_bands(spark, sf):
    return shown(trend.window_bands(walk(spark, sf), 50, [1, 2, 2, -1]), "ticker", "begin", "k", price=4, hi=4, lo=4)


@query(on_bars("walk", f"SELECT ticker, origin, h, k, {_bands('intercept + slope * (last + h)')} FROM fit, ks, (SELECT unnest(range(11)) AS h)", PLACED, _FIT.format(source="placed")))
def trend_extension(spark, sf):
    found = trend.extension(trend.fit(walk(spark, sf), 50), 10, [1, 2])
    return shown(found.withColumn("h", long_("h")), "ticker", "origin", "h", "k", price=4, hi=4, lo=4)


@query(on_bars("walk", f"""SELECT f.ticker, f.origin, h, k, coalesce(p.begin, date_trunc('day', f.origin) + h * INTERVAL 1 DAY) AS begin_h, {_bands('intercept + slope * (f.last + h)')}
FROM fit f CROSS JOIN ks CROSS JOIN (SELECT unnest(range(11)) AS h) LEFT JOIN placed p ON p.ticker = f.ticker AND p.i = f.last + h""",
    PLACED, "cut AS (SELECT * FROM placed p WHERE i <= (SELECT max(i) - 4 FROM placed q WHERE q.ticker = p.ticker))", _FIT.format(source="cut")))
def trend_ruler_at_origin(spark, sf):
    rows = walk(spark, sf)
    # four bars before the last one: some steps have a bar, the rest the calendar
    fifth = F.row_number().over(window.W.partitionBy("ticker").orderBy(F.desc("begin")))
    origins = rows.select("ticker", F.col("begin").alias("origin"), fifth.alias("n")).where("n = 5").drop("n")
    found = trend.ruler(rows, origins, 50, [1, 2], 10)
    return shown(found.withColumn("h", long_("h")), "ticker", "origin", "h", "k", "begin_h", price=4, hi=4, lo=4)


@query(on_bars("walk", f"SELECT ticker, begin, {r('trend')} AS trend, {r('ratio', 9)} AS ratio FROM ratios", PLACED, RATIOS))
def logtrend_ratio(spark, sf):
    return shown(trend.causal_trend(walk(spark, sf)), "ticker", "begin", trend=6, ratio=9)


@query(on_bars("walk", f"SELECT ticker, begin, {r('dratio', 9)} AS dratio FROM steps", PLACED, RATIOS))
def dratio(spark, sf):
    return shown(trend.ratio_steps(trend.causal_trend(walk(spark, sf))), "ticker", "begin", dratio=9)


@query(on_bars("walk", f"""SELECT p.ticker, p.begin, {r('close / exp(a + b * i)', 9)} AS ratio_close FROM placed p
JOIN (SELECT ticker, regr_slope(ln(close), i) AS b, regr_intercept(ln(close), i) AS a FROM placed GROUP BY ticker) f USING (ticker)""", PLACED))
def origin_anchored_ratio(spark, sf):
    return shown(trend.anchored(walk(spark, sf)), "ticker", "begin", ratio_close=9)


RAWS = """raws AS (SELECT *, CASE WHEN i >= 100 THEN mid - avg(mid) OVER (s ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) END AS trend_raw,
  mid - lag(mid, 10) OVER s AS velocity_raw, (mid - lag(mid, 10) OVER s) - (lag(mid, 10) OVER s - lag(mid, 20) OVER s) AS acceleration_raw,
  CASE WHEN i >= 20 THEN stddev_samp(ret) OVER (s ROWS 19 PRECEDING) END AS volatility_raw
  FROM (SELECT *, mid - lag(mid) OVER s AS ret FROM logged WINDOW s AS (PARTITION BY ticker ORDER BY begin)) WINDOW s AS (PARTITION BY ticker ORDER BY begin))"""


def _rank(c: str) -> str:
    return f"""CASE WHEN i >= 252 AND {c} IS NOT NULL AND count({c}) OVER f >= 10
    THEN len(list_filter(list({c}) OVER f, lambda x : x < {c}))::DOUBLE / count({c}) OVER f END"""


_DENSITY = """held AS (SELECT *, min(log_low) OVER f AS lo, max(log_high) OVER f AS hi, list({'m': mid, 'v': volume}) OVER f AS prof, sum(volume) OVER f AS total
  FROM raws WINDOW f AS (PARTITION BY ticker ORDER BY begin ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
dense AS (SELECT ticker, begin, CASE WHEN i >= 252 AND hi > lo AND total > 0 THEN (
  list_sum(list_transform(list_filter(prof, lambda b : least(floor((b.m - lo) / (hi - lo) * 40), 39) < own), lambda b : b.v))
  + list_sum(list_transform(list_filter(prof, lambda b : least(floor((b.m - lo) / (hi - lo) * 40), 39) = own), lambda b : b.v)) / 2.0) / total END AS rank_volume
  FROM (SELECT *, greatest(least(floor((mid - lo) / (hi - lo) * 40), 39), 0) AS own FROM held))""".replace("list_sum(", "coalesce(list_sum(").replace("lambda b : b.v))", "lambda b : b.v)), 0)")

RANKED = f"""ranked AS (SELECT ticker, begin, i, {', '.join(f'{_rank(f"{c}_raw")} AS rank_{c}' for c in ('trend', 'velocity', 'acceleration', 'volatility'))}
  FROM raws WINDOW f AS (PARTITION BY ticker ORDER BY begin ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)), {_DENSITY},
bar_ranks AS (SELECT r.*, d.rank_volume FROM ranked r JOIN dense d USING (ticker, begin))"""


@query(on_bars("walk", f"SELECT ticker, begin, {r('rank_trend', 9)} AS rank_trend FROM ranked", PLACED, LOGGED, RAWS, RANKED))
def pct_rank_252(spark, sf):
    found = ranks.raw_features(bars.logged(walk(spark, sf)))
    return shown(found.withColumn("rank_trend", ranks.percentile_rank("trend_raw")), "ticker", "begin", rank_trend=9)


@query(on_bars("walk", f"SELECT ticker, begin, {r('rank_volume', 9)} AS rank_volume FROM dense", PLACED, LOGGED, RAWS, RANKED))
def density_rank(spark, sf):
    return shown(ranks.density_rank(bars.logged(walk(spark, sf))), "ticker", "begin", rank_volume=9)


@query(on_bars("walk", f"SELECT ticker, begin, {', '.join(f'{r(f"{c}_raw", 9)} AS {c}_raw' for c in ('trend', 'velocity', 'acceleration', 'volatility'))} FROM raws", PLACED, LOGGED, RAWS))
def raw_features(spark, sf):
    return shown(ranks.raw_features(bars.logged(walk(spark, sf))), "ticker", "begin", trend_raw=9, velocity_raw=9, acceleration_raw=9, volatility_raw=9)


@query(on_bars("walk", f"SELECT ticker, begin, {', '.join(f'{r(f"rank_{c}", 9)} AS rank_{c}' for c in ranks.FEATURES)} FROM bar_ranks", PLACED, LOGGED, RAWS, RANKED))
def bar_rank_features(spark, sf):
    return shown(ranks.bar_ranks(bars.logged(walk(spark, sf))), "ticker", "begin", **{f"rank_{c}": 9 for c in ranks.FEATURES})


VOL = "vols AS (SELECT *, CASE WHEN count(dratio) OVER w = 60 THEN stddev_pop(dratio) OVER w END AS vol FROM steps WINDOW w AS (PARTITION BY ticker ORDER BY begin ROWS 59 PRECEDING))"


def _vol(spark, sf):
    return ranks.rolling_volatility(trend.ratio_steps(trend.causal_trend(walk(spark, sf))))


@query(on_bars("walk", f"SELECT ticker, begin, {r('vol', 9)} AS vol FROM vols", PLACED, RATIOS, VOL))
def rolling_vol_60(spark, sf):
    return shown(_vol(spark, sf), "ticker", "begin", vol=9)


_REGIME = "cuts AS (SELECT ticker, quantile_cont(vol, [1.0 / 3, 2.0 / 3]) AS c FROM vols GROUP BY ticker)"


@query(on_bars("walk", "SELECT ticker, begin, CASE WHEN vol IS NULL THEN -1 ELSE (vol > c[1])::INT + (vol > c[2])::INT END AS regime FROM vols JOIN cuts USING (ticker)", PLACED, RATIOS, VOL, _REGIME))
def regime_labels(spark, sf):
    return ranks.regimes(_vol(spark, sf)).select("ticker", "begin", F.col("regime").cast("int").alias("regime"))


@query(on_bars("walk", f"""SELECT v.ticker, v.begin, {r('v.ratio', 9)} AS ratio, {r('v.vol', 9)} AS vol,
  CASE WHEN v.vol IS NULL THEN -1 ELSE (v.vol > c[1])::INT + (v.vol > c[2])::INT END AS regime, {r('o.slope', 9)} AS slope, {r('o.resid_var', 9)} AS resid_var
FROM vols v JOIN cuts USING (ticker) JOIN ols o ON o.ticker = v.ticker AND o.begin = v.begin""", PLACED, RATIOS, VOL, _REGIME, _OLS))
def regime_trend_oscillator(spark, sf):
    """The flagship: regimes of volatility and the trend's slope and noise, for every bar of every ticker."""
    found = trend.rolling_trend(ranks.regimes(_vol(spark, sf)), 50)
    found = found.withColumn("regime", F.col("regime").cast("int"))
    return shown(found, "ticker", "begin", "regime", ratio=9, vol=9, slope=9, resid_var=9)


def _ahead(f: str, c: str) -> str:
    return ", ".join(f"CASE WHEN n = 5 THEN {f}({c}) OVER (PARTITION BY ticker ORDER BY begin ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END AS {c}_{h}" for h in range(1, 6))


AHEAD = f"""ahead AS (SELECT *, {_ahead('min', 'low')}, {_ahead('max', 'high')} FROM (
  SELECT *, count(low) OVER (PARTITION BY ticker ORDER BY begin ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS n FROM {{source}}))"""


@query(on_bars("walk", "SELECT ticker, begin, low_1, low_3, low_5, high_1, high_3, high_5 FROM ahead", PLACED, AHEAD.format(source="placed")))
def forward_extremes(spark, sf):
    found = ranks.forward_extremes(walk(spark, sf), 5)
    return found.select("ticker", "begin", *[F.get(f"fwd_{s}", F.lit(h - 1)).alias(f"{s}_{h}") for s in ("low", "high") for h in (1, 3, 5)])


@query(on_bars("walk", f"SELECT ticker, begin, {r('win[1]', 9)} AS oldest, {r('win[8]', 9)} AS newest, {r('list_sum(win)', 9)} AS total FROM delays", PLACED, RATIOS, windows(8)))
def delay_windows(spark, sf):
    found = ranks.delay_windows(trend.ratio_steps(trend.causal_trend(walk(spark, sf))), 8, "dratio").where("window is not null")
    found = found.select("ticker", "begin", F.get("window", F.lit(0)).alias("oldest"), F.get("window", F.lit(7)).alias("newest"), F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return shown(found, "ticker", "begin", oldest=9, newest=9, total=9)


_HANN = [0.5 - 0.5 * math.cos(2 * math.pi * k / 64) for k in range(64)]
_STFT = f"""known AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY begin) - 1 AS j FROM steps WHERE dratio IS NOT NULL),
segs AS (SELECT ticker, k.j AS start, (k.j / 16)::BIGINT AS segment FROM known k WHERE k.j % 16 = 0 AND k.j + 64 <= (SELECT count(*) FROM known n WHERE n.ticker = k.ticker)),
cut AS (SELECT s.ticker, s.segment, k.j - s.start AS n, k.begin, k.dratio - avg(k.dratio) OVER (PARTITION BY s.ticker, s.segment) AS x FROM segs s JOIN known k ON k.ticker = s.ticker AND k.j BETWEEN s.start AND s.start + 63),
waves AS (SELECT ticker, segment, f, sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * cos(2 * pi() * f * n / 64)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * sin(2 * pi() * f * n / 64)) AS im,
  max(begin) FILTER (n = 32) AS time FROM cut, (SELECT unnest(range(33)) AS f) GROUP BY 1, 2, 3)"""


@query(on_bars("walk", f"""SELECT ticker, segment, time, f / 64.0::DOUBLE AS freq, {r(f"10 * log10((re * re + im * im) / {sum(w * w for w in _HANN)!r} * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END + 1e-20)", 5)} AS db FROM waves""", PLACED, RATIOS, _STFT))
def stft_power(spark, sf):
    return shown(spectral.spectrogram(trend.ratio_steps(trend.causal_trend(walk(spark, sf)))), "ticker", "segment", "time", "freq", db=5)


def bank(source: str = "steps", value: str = "dratio", by: str = "ticker") -> str:
    """The cascade value by value: a recursion whose rows hold the states of all sections, as the common table expressions known and bank."""
    on = " AND ".join(f"b.{c.strip()} = z.{c.strip()}" for c in by.split(","))
    sections = [(k, j, c) for k, cutoff in enumerate(spectral.CUTOFFS) for j, c in enumerate(spectral.butterworth(cutoff))]
    last = max(j for _, j, _ in sections)
    level = f"SELECT z.*, b.{value} AS r_0 FROM bank z JOIN known b ON {on} AND b.n = z.n + 1"
    for k, j, (b0, *_) in sections:
        put_in = f"r_{k}" if j == 0 else f"y_{k}_{j - 1}"
        level = f"SELECT *, {b0!r}::DOUBLE * {put_in} + s1_{k}_{j} AS y_{k}_{j} FROM ({level})"
        if j == last:
            level = f"SELECT *, y_{k}_{j} AS r_{k + 1} FROM ({level})"
    states = ", ".join(
        f"{b1!r}::DOUBLE * {'r_' + str(k) if j == 0 else f'y_{k}_{j - 1}'} - {a1!r}::DOUBLE * y_{k}_{j} + s2_{k}_{j}, {b2!r}::DOUBLE * {'r_' + str(k) if j == 0 else f'y_{k}_{j - 1}'} - {a2!r}::DOUBLE * y_{k}_{j}"
        for k, j, (_, b1, b2, a1, a2) in sections
    )
    zeros = ", ".join(f"0.0::DOUBLE AS s1_{k}_{j}, 0.0::DOUBLE AS s2_{k}_{j}" for k, j, _ in sections)
    m = len(spectral.CUTOFFS)
    parts = ", ".join([*[f"r_{k} - r_{k + 1}" for k in range(m)], f"r_{m}"])
    nulls = ", ".join(f"NULL::DOUBLE AS comp_{k}" for k in range(m + 1))
    return f"""known AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY begin) - 1 AS n FROM {source} WHERE {value} IS NOT NULL),
bank AS (SELECT DISTINCT {by}, -1::BIGINT AS n, {nulls}, {zeros} FROM known
  UNION ALL SELECT {by}, n + 1, {parts}, {states} FROM ({level}))"""


_FILTERED = on_bars("walk", f"SELECT ticker, k.begin, {', '.join(f'{r(f'comp_{k}', 9)} AS comp_{k}' for k in range(6))} FROM bank JOIN known k USING (ticker, n)", PLACED, RATIOS, bank(), recursive=True)


@query(_FILTERED)
def filter_bank(spark, sf):
    found = spectral.filter_bank(trend.ratio_steps(trend.causal_trend(walk(spark, sf))))
    return shown(found, "ticker", "begin", **{f"comp_{k}": 9 for k in range(6)})


@query(_FILTERED)
def filter_bank_in_chunks(spark, sf):
    found = spectral.filter_bank(trend.ratio_steps(trend.causal_trend(walk(spark, sf))), chunk=500)
    return shown(found, "ticker", "begin", **{f"comp_{k}": 9 for k in range(6)})


@query(SQL["ema_20"])
def ema_20_in_chunks(spark, sf):
    return shown(averages.ema(raw(spark, sf), 20, chunk=500), "ticker", "begin", ema=6)


@query(SQL["logtrend_ratio"])
def logtrend_in_chunks(spark, sf):
    return shown(trend.causal_trend_in_chunks(walk(spark, sf), rows=500), "ticker", "begin", trend=6, ratio=9)
