"""Causality, invariants and edge cases of the operators, on small made-up series."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import averages, bars, neighbors, quantile, ranks, risk, spectral, store, trend, window, zigzag

SCHEMA = "ticker string, begin timestamp, open double, high double, low double, close double, volume double, value double"
DAY = dt.datetime(2020, 1, 1)


def series(spark, n, ticker="T", seed=1, flat=False, volume=True):
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        before, price = price, price if flat else price * math.exp(rng.gauss(0, 0.03))
        low, high = (price, price) if flat else (min(before, price) * 0.99, max(before, price) * 1.01)
        rows.append((ticker, DAY + dt.timedelta(days=i), before, high, low, price, float(rng.randint(1, 9)) if volume else 0.0, 1.0))
    return spark.createDataFrame(rows, SCHEMA)


def values(rows, *columns):
    return {(r["ticker"], r["begin"]): tuple(r[c] for c in columns) for r in rows.collect()}


CAUSAL = {
    "sma": (lambda b: averages.sma(b, 5), ["sma"]),
    "wma": (lambda b: averages.wma(b, 5), ["wma"]),
    "ema": (lambda b: averages.ema(b, 5), ["ema"]),
    "trend": (lambda b: trend.rolling_trend(b, 10), ["slope", "resid_var"]),
    "ratio": (lambda b: trend.ratio_steps(trend.causal_trend(b)), ["ratio", "dratio"]),
    "ranks": (lambda b: ranks.bar_ranks(bars.logged(b), 30, 10), [f"rank_{f}" for f in ranks.FEATURES]),
    "filters": (lambda b: spectral.filter_bank(trend.ratio_steps(trend.causal_trend(b))), ["comp_0", "comp_5"]),
}


@pytest.mark.parametrize("name", CAUSAL)
def test_later_bars_change_nothing_earlier(spark, name):
    f, columns = CAUSAL[name]
    rows, cut = series(spark, 160), DAY + dt.timedelta(days=133)
    whole = values(f(rows).where(F.col("begin") <= F.lit(cut)), *columns)
    assert whole == values(f(rows.where(F.col("begin") <= F.lit(cut))), *columns)
    assert any(v[0] is not None for v in whole.values())


def test_pivots_known_at_a_time_stay(spark):
    rows, cut = bars.logged(series(spark, 300)), DAY + dt.timedelta(days=200)
    whole = zigzag.pivots(rows, 0.05).where(F.col("confirm_begin") <= F.lit(cut)).orderBy("seq").collect()
    assert whole == zigzag.pivots(rows.where(F.col("begin") <= F.lit(cut)), 0.05).orderBy("seq").collect()
    assert len(whole) > 5
    assert all(a["direction"] == -b["direction"] and b["confirm_i"] - a["confirm_i"] >= 5 for a, b in zip(whole, whole[1:], strict=False))
    assert all(p["extreme_i"] < p["confirm_i"] for p in whole)


@pytest.mark.parametrize("make", [lambda s: series(s, 0), lambda s: series(s, 1), lambda s: series(s, 8), lambda s: series(s, 60, flat=True)], ids=["empty", "one", "short", "flat"])
def test_edges_give_nulls_or_nothing(spark, make):
    rows = make(spark)
    n = rows.count()
    for f, _ in CAUSAL.values():
        assert f(rows).count() in (n, max(n - 1, 0))
    assert averages.sma(rows, 100).where("sma is not null").count() == 0
    assert zigzag.pivots(bars.logged(rows), 0.5).count() == 0
    assert spectral.spectrogram(trend.ratio_steps(trend.causal_trend(rows))).count() == 0
    assert bars.coverage(rows).count() == (1 if n else 0)


def test_flat_series(spark):
    rows = bars.logged(series(spark, 80, flat=True))
    found = ranks.bar_ranks(rows, 30, 10).where("i is null or true") if "i" in rows.columns else ranks.bar_ranks(rows, 30, 10)
    last = found.orderBy(F.desc("begin")).first()
    assert last["rank_volume"] is None and last["rank_velocity"] == 0.0
    line = trend.rolling_trend(series(spark, 30, flat=True), 10).orderBy(F.desc("begin")).first()
    assert line["slope"] == pytest.approx(0, abs=1e-15) and line["resid_var"] == pytest.approx(0, abs=1e-15)
    assert bars.signed_volume(rows).where("buy <> sell").count() == 0


def test_no_volume_no_density_rank(spark):
    rows = bars.logged(series(spark, 60, volume=False).withColumn("volume", F.lit(None).cast("double")))
    assert ranks.density_rank(rows, 30, 10).where("rank_volume is not null").count() == 0


def test_chunks_change_nothing(spark):
    rows = series(spark, 120).unionByName(series(spark, 7, "U")).unionByName(series(spark, 50, None, 3))
    for f, back, columns in ((averages.sma, 4, ["sma"]), (averages.wma, 4, ["wma"])):
        whole = values(f(rows, 5), *columns)
        assert values(window.in_chunks(rows, lambda b, by, order, f=f: f(b, 5, by=by, order=order), back, rows=16), *columns) == whole
    whole = values(trend.rolling_trend(rows, 10), "slope", "resid_var", "i")
    parts = values(window.in_chunks(rows, lambda b, by, order: trend.rolling_trend(b, 10, by=by, order=order), 9, rows=16), "slope", "resid_var", "i")
    assert parts.keys() == whole.keys()
    assert all(a == pytest.approx(b, abs=1e-12) if a is not None else b is None for k in whole for a, b in zip(whole[k], parts[k], strict=True))


def test_wide_quantiles_are_the_quantiles(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(k, float(rng.randint(0, 40)), float(rng.randint(0, 3))) for k in "ab" for _ in range(300)] + [("a", None, 1.0), ("b", 1.0, None)], "k string, v double, w double")
    qs = (0.0, 0.05, 0.3, 0.5, 0.77, 1.0)
    order = ["k", "q"]
    exact = quantile.weighted_quantiles(rows.where("w > 0"), "v", "w", qs, ("k",)).orderBy(*order).collect()
    wide = quantile.wide_weighted_quantiles(rows.where("w > 0"), "v", "w", qs, ("k",), parts=7).orderBy(*order).collect()
    assert [r["quantile"] for r in wide] == pytest.approx([r["quantile"] for r in exact])
    exact = quantile.quantiles(rows, "v", qs, ("k",)).orderBy(*order).collect()
    wide = quantile.wide_quantiles(rows, "v", qs, ("k",), parts=7).orderBy(*order).collect()
    assert [r["quantile"] for r in wide] == pytest.approx([r["quantile"] for r in exact])


def test_wide_quantiles_keep_the_order_of_ties(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 5.0, 2), (2.0, 1.0, 3), (2.0, 3.0, 4), (3.0, 2.0, 5)], "v double, w double, t int")
    qs = (0.15, 0.25, 0.7, 0.8, 0.85)
    exact, wide = ([r["quantile"] for r in f(rows, "v", "w", qs, ties=("t",)).orderBy("q").collect()] for f in (quantile.weighted_quantiles, quantile.wide_weighted_quantiles))
    assert wide == pytest.approx(exact)


def test_no_weight_reads_the_median(spark):
    rows = spark.createDataFrame([(float(v), 0.0) for v in (1, 2, 4, 9)], "v double, w double")
    assert {r["quantile"] for r in quantile.weighted_quantiles(rows, "v", "w", (0.1, 0.9)).collect()} == {3.0}


def test_butterworth_filters():
    for cutoff in spectral.CUTOFFS:
        z = np.exp(-1j * np.pi * np.array([0.0, cutoff, 1.0]))
        gain = np.prod([np.abs((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)) for b0, b1, b2, a1, a2 in spectral.butterworth(cutoff)], axis=0)
        assert gain == pytest.approx([1, math.sqrt(0.5), 0], abs=1e-9)
    assert spectral.pair_lags()[-1] == (0, 32, 64)


def test_amp_cos_of_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 0.0]), (2, [2.0, 0.0], [1.0, 0.0]), (3, [0.0, 1.0], [1.0, 0.0])], "i long, window array<double>, query array<double>")
    d = {r["i"]: r["d"] for r in neighbors.with_amp_cos(rows.withColumn("g", F.lit(1)), 0.5, ("g",)).collect()}
    assert d[1] == pytest.approx(1.0) and d[2] == pytest.approx(0.5 * math.log(2)) and d[3] == pytest.approx(0.5)


def test_trade_reaches_its_ratio(spark):
    rows = spark.createDataFrame([("short", "stop", 300000.0, 2.0, 100.0, 105.0, 0.0, 3.0, 13.0, 30, 1), ("long", "profit", 300000.0, 2.0, 100.0, 0.0, 115.0, 3.0, 13.0, 30, 1), ("long", "stop", 10.0, 2.0, 100.0, 95.0, 0.0, 3.0, 0.0, 0, 10)],
                                 "direction string, anchor string, deposit double, risk_pct double, entry double, stop double, tp double, rr double, borrow_pct double, hold_days int, lot int")
    a, b, c = risk.economics(rows).collect()
    assert a["net_rr"] == pytest.approx(3.0) and b["net_rr"] == pytest.approx(3.0) and b["stop"] == pytest.approx(95.0)
    assert c["size"] == 10 and c["risk_share"] > 0.02  # never less than one lot
    assert [r["problem"] for r in risk.problems(rows).collect()] == [None, None, None]


def test_upserts_take_the_last_version(spark):
    old = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0)], "k string, ver int, v double")
    new = spark.createDataFrame([("a", 2, 3.0), ("a", 3, 4.0), ("b", 1, None)], "k string, ver int, v double")
    assert sorted((r["k"] or "", r["v"] or 0) for r in store.upserted(old, new, ("k",), "ver").collect()) == [("", 2.0), ("a", 4.0), ("b", 0)]


def test_settings_of_broken_json(spark):
    rows = spark.createDataFrame([('{"a": "x", "c": "z"}',), ("{",), (None,)], "j string")
    found = [r["m"] for r in rows.select(store.settings_over({"a": "1", "b": "2"}, "j").alias("m")).collect()]
    assert found == [{"a": "x", "b": "2", "c": "z"}, {"a": "1", "b": "2"}, {"a": "1", "b": "2"}]


def test_halves_go_up(spark):
    rows = spark.createDataFrame([(2.5,), (-2.5,), (None,)], "x double")
    assert [r[0] for r in rows.select(scalars.half_up("x")).collect()] == [3, -2, None]
    assert [r[0] for r in rows.select(scalars.to_step("x", F.lit(0.0))).collect()] == [2.5, -2.5, None]
