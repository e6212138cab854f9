"""Models: simulated corridors, calibration, ensembles and scenarios on small series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantile, zigzag
from tidemark.plans import band, calibrate, corridor, range_zones, regime, simplex
from test_operators import series


def test_corridor_widens(spark):
    found = corridor.corridor(series(spark, 260), p=8, h=6, n=200).orderBy("h").collect()
    assert len(found) == 6
    for a, b in zip(found, found[1:], strict=False):
        assert b["risk_low"] <= a["risk_low"] and b["risk_high"] >= a["risk_high"]
    assert all(0 < r["close_low"] <= r["close_high"] and r["risk_low"] <= r["risk_high"] for r in found)


def test_first_step_is_the_bar_after_the_window(spark):
    rows = corridor.steps(series(spark, 120), 8)
    draws = spark.createDataFrame([("T", 0, 1, 50), ("T", 0, 2, 60)], "ticker string, sim long, h long, i long")
    d = {r["i"]: r for r in rows.collect()}
    got = {r["h"]: r["close"] for r in corridor.paths(rows, draws).collect()}
    line = lambda h: np.exp(d[119]["log_a"] + d[119]["log_b"] * (119 + h))
    assert got[1] == pytest.approx((d[119]["ratio_close"] + d[51]["d_close"]) * line(1))
    assert got[2] == pytest.approx((d[119]["ratio_close"] + d[51]["d_close"] + d[62]["d_close"]) * line(2))


def test_band_takes_equal_moves_by_time(spark):
    rng = np.random.default_rng(3)
    days = pd.date_range("2020-01-01", periods=60)
    frame = pd.DataFrame([(t, i, float(rng.integers(1, 4)) if i % 2 else 0.0, i, days[i], days[i], 1 - 2 * (i % 2)) for t in "AB" for i in range(60)], columns=["ticker", "seq", "log_price", "confirm_i", "confirm_begin", "extreme_begin", "direction"])
    found = zigzag.legs(spark.createDataFrame(frame)).withColumns({r: F.lit(0.5) for r in band.RANKS})
    got = [(r["h"], r["log_return"]) for r in band.forecast(found, "A", theta=1.0).orderBy("h", "q").collect()]
    want = [(h, r["quantile"]) for h in (1, 2) for r in quantile.weighted_quantiles(band.analogs(found, "A", h, theta=1.0), "target", "weight", band.LEVELS, ties=("confirm_begin", "ticker")).orderBy("q").collect()]
    assert [h for h, _ in got] == [h for h, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-12)


def test_draws_follow_weights(spark):
    pool = spark.createDataFrame([("T", 1, 0.1), ("T", 2, 0.6), ("T", 3, 0.3)], "ticker string, i long, weight double")
    found = dict(corridor.drawn(pool, 500, 4).groupBy("i").count().collect())
    assert sum(found.values()) == 2000
    assert [found[i] / 2000 for i in (1, 2, 3)] == pytest.approx([0.1, 0.6, 0.3], abs=0.04)


def test_too_short_for_zones(spark):
    assert range_zones.neighbors(series(spark, 15)).count() == 0
    found = range_zones.zones(range_zones.neighbors(series(spark, 200), theta=2.0)).collect()
    assert len(found) == 15 and all(r["low"] <= r["high"] for r in found)


def test_calibration_finds_a_value_of_the_grid(spark):
    s = calibrate.Settings(folds=2, fold=30, holdout=30, least=10, passes=1)
    rows = series(spark, 260)
    folds = {r["fold"]: r["n"] for r in calibrate.labelled(range_zones.prepared(rows, 5, 8).select("ticker", "i"), s).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert folds == {-1: 30, 0: 30, 1: 30}
    context, base = calibrate.contexts(rows, s, ()).cache(), calibrate.baseline(rows, s).cache()
    best = calibrate.calibrate(context, base, ["T"], s, (), {"theta": (0.0, 2.0, 4.0, 6.0)})
    assert 0 <= best["T"]["theta"] <= 6
    low, high = calibrate.calibrate_reads(context, base, best, s)["T"]
    assert abs(low - 0.05) <= 0.041 and abs(high - 0.95) <= 0.041


def test_refined_grid():
    assert calibrate.refined((0.0, 2.0, 4.0), 0.0, 0.5) == [0.0, 1.0, 2.0]
    assert calibrate.refined((0.0, 2.0, 4.0), 2.0, 0.5) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_mixture_of_two_heaps():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, 300), rng.normal(10, 1, 100)))
    found = regime.mixture(x, np.ones(400), 1500)
    assert len(found) == 2 and [round(p[0]) for p in found] == [0, 10] and found[0][2] == pytest.approx(0.75, abs=0.02)
    assert regime.mixture(np.full(4, 3.0), np.ones(4), 100) == [(3.0, 0.0, 1.0)]


def test_simplex_follows_a_cycle():
    x = 1 + 0.1 * np.sin(np.arange(200) * 2 * np.pi / 20)
    s = simplex.Settings(horizon=10, levels=2, correct=False)
    assert simplex.trajectory(x, 6, 2, s) == pytest.approx(1 + 0.1 * np.sin(np.arange(200, 210) * 2 * np.pi / 20), abs=0.01)
    assert simplex.trajectory(x[:8], 6, 2, s) is None
    assert simplex.smoothed(x, 6, 2, 10, 0.5)[150:] == pytest.approx(x[150:], abs=1e-6)


def test_smoothing_looks_back_only():
    x = 1 + 0.01 * np.random.default_rng(2).normal(size=120)
    assert (simplex.smoothed(x, 5, 2, 12, 0.5)[:90] == simplex.smoothed(x[:90], 5, 2, 12, 0.5)).all()


def test_scenarios_of_a_series(spark):
    s = regime.Settings(horizon=4, warmup=80, theiler=5, lookback=2, bars=0)
    found = regime.scenarios(series(spark, 330), 2, settings=s)
    rows = found.collect()
    assert {(r["back"], r["h"]) for r in rows} == {(b, h) for b in (0, 1) for h in range(1, 5)}
    assert regime.dominant(found).count() == 2
    paths = regime.price_paths(series(spark, 330), settings=s)
    assert paths.where("h = 1").agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    assert regime.scenarios(series(spark, 30), 1, settings=s).count() == 0


def plain_descent(frame, s, features, grids):
    """The whole calibration of one ticker, origin by origin and value by value."""
    by_i = {r["i"]: r for r in frame}
    end = max(by_i) - s.ahead
    dev = end - s.holdout - max(s.ahead, 5)
    start = dev - s.folds * s.fold
    folds = {-1: range(end - s.holdout, end)} | {k: range(start + k * s.fold, start + (k + 1) * s.fold) for k in range(s.folds)}
    gap = max(s.theiler + 1, s.ahead)
    off = lambda r: tuple((r[c][s.ahead - 1] - r["close"]) / r["close"] for c in ("fwd_low", "fwd_high"))
    full = lambda r: r["window"] is not None and all(r[f"rank_{f}"] is not None for f in features)
    done = lambda r: r["fwd_low"] is not None and len(r["fwd_low"]) >= s.ahead and r["fwd_low"][s.ahead - 1] is not None
    contexts = {}
    for fold, origins in folds.items():
        for o in origins:
            past = [by_i[i] for i in range(o - gap + 1) if done(by_i[i])]
            known = [r for r in past if full(r)]
            if not full(by_i[o]) or len(known) < 5:
                continue
            d = np.array([np.linalg.norm(np.subtract(r["window"], by_i[o]["window"])) for r in known])
            parts = {"theta": d / max(d.mean(), 1e-10)} | {f: np.array([(r[f"rank_{f}"] - by_i[o][f"rank_{f}"]) ** 2 for r in known]) for f in features}
            contexts.setdefault(fold, []).append((by_i[o], np.array([off(r) for r in known]), parts, np.array([off(r) for r in past]) if len(past) >= 20 else None))

    def pinball(r, ends):
        return sum(max(t * (r[c][s.ahead - 1] - e), (t - 1) * (r[c][s.ahead - 1] - e)) for c, e, t in zip(("fwd_low", "fwd_high"), ends, s.tails, strict=True)) / 2 / r["close"]

    def quantile(values, w, q):
        order = np.argsort(values, kind="stable")
        return np.interp(q, (np.cumsum(w[order]) - 0.5 * w[order]) / w.sum(), values[order])

    def score(params, read, fold):
        loss, base = [], []
        for r, offs, parts, past in contexts.get(fold, []):
            w = np.exp(-sum(v * parts[n] for n, v in params.items()) + np.zeros(len(offs)))
            if w.sum() < 1e-14:
                continue
            loss.append(pinball(r, [r["close"] * (1 + quantile(offs[:, k], w, read[k])) for k in (0, 1)]))
            if past is not None:
                base.append(pinball(r, [r["close"] * (1 + quantile(past[:, k], np.ones(len(past)), s.tails[k])) for k in (0, 1)]))
        return np.mean(loss) / np.mean(base) if len(loss) >= s.least and base else None

    def best(rows):
        middle = [(np.mean([x[1] for x in rows[k - 1 : k + 2]]), rows[k][0]) for k in range(1, len(rows) - 1)]
        return {min(middle)[1]} if middle else set()

    def step(grid, nominal, at):
        dev = [[(v, at(v, fold)) for v in grid if at(v, fold) is not None] for fold in range(s.folds)]
        found, pooled = {nominal}, {}
        for rows in dev:
            found |= best(rows)
            for v, x in rows:
                pooled.setdefault(v, []).append(x)
        found |= best(sorted((v, np.mean(x)) for v, x in pooled.items()))
        held = [(at(v, -1), v) for v in found if at(v, -1) is not None]
        return min(held)[1] if held else None

    params, names = dict.fromkeys(("theta", *features), 0.0), ("theta", *features)
    for fine in [False] * s.passes + [True]:
        if not fine and params.get("done"):
            continue
        before = {n: params[n] for n in names}
        for n in names:
            grid = calibrate.refined(grids[n], params[n], s.refine) if fine else grids[n]
            cache = {}
            at = lambda v, fold, n=n, cache=cache: cache[v, fold] if (v, fold) in cache else cache.setdefault((v, fold), score({m: params[m] for m in names} | {n: v}, s.tails, fold))
            won = step(grid, 0.0, at)
            params[n] = params[n] if won is None else won
        params["done"] = max(abs(params[n] - before[n]) for n in names) <= s.tolerance
    params = {n: params[n] for n in names}
    reads = list(s.tails)
    for side in (0, 1):
        grid = [round(v, 3) for v in np.arange(max((1e-3, 0.501)[side], s.tails[side] - 0.04), min((0.499, 0.999)[side], s.tails[side] + 0.04) + 0.005, 0.01).tolist()]
        won = step(grid, s.tails[side], lambda v, fold, side=side: score(params, [v if k == side else reads[k] for k in (0, 1)], fold))
        reads[side] = reads[side] if won is None else won
    return params, tuple(reads), score(params, reads, -1)


def test_calibration_is_the_plain_descent(spark):
    s = calibrate.Settings(folds=2, fold=40, holdout=40, least=10, passes=3)
    rows, used = series(spark, 420), ("velocity",)
    grids = {"theta": (0.0, 2.0, 4.0, 6.0), "velocity": (0.0, 2.0, 4.0, 6.0)}
    found = calibrate.calibration(rows, s, used, grids).collect()
    params, reads, ratio = plain_descent([r.asDict() for r in range_zones.prepared(rows, s.ahead, s.p, True).collect()], s, used, grids)
    assert len(found) == 1 and {n: found[0][n] for n in params} == params
    assert (found[0]["read_low"], found[0]["read_high"]) == pytest.approx(reads) and found[0]["ratio"] == pytest.approx(ratio)


def test_calibration_without_history_has_no_row(spark):
    assert calibrate.calibration(series(spark, 120)).count() == 0


def test_mixtures_are_fixed_points_in_sql(spark):
    """One more step of expectation-maximisation, in SQL over the paths, gains less than the fit's last step may; no single normal has a smaller BIC."""
    import duckdb

    s = regime.Settings(horizon=3, warmup=80, theiler=5, lookback=2, bars=0)
    rows = series(spark, 330)
    duck = duckdb.connect()
    duck.register("paths", regime.price_paths(rows, 2, settings=s).toPandas())
    duck.register("parts", regime.scenarios(rows, 2, settings=s).toPandas())
    found = duck.sql(f"""
WITH points AS (SELECT back, h, path, price AS x, weight / sum(weight) OVER (PARTITION BY back, h) AS w FROM paths),
spread AS (SELECT back, h, sum(w * x) AS m, sqrt(sum(w * x * x) - sum(w * x) ** 2) AS sd FROM points GROUP BY 1, 2),
dense AS (SELECT p.*, part, mean, std, q.weight * exp(-0.5 * ((x - mean) / std) ** 2) / std / sqrt(2 * pi()) AS f FROM points p JOIN parts q USING (back, h)),
shared AS (SELECT *, f / sum(f) OVER (PARTITION BY back, h, path) AS part_of FROM dense),
step AS (SELECT back, h, part, sum(w * part_of) AS mass, sum(w * part_of * x) / sum(w * part_of) AS mean FROM shared GROUP BY 1, 2, 3),
moved AS (SELECT a.back, a.h, a.part, any_value(b.mass) AS mass, any_value(b.mean) AS mean, sqrt(greatest(sum(w * part_of * (x - b.mean) ** 2) / any_value(b.mass), (1e-3 * any_value(sd)) ** 2)) AS std
  FROM shared a JOIN step b ON a.back = b.back AND a.h = b.h AND a.part = b.part JOIN spread c ON c.back = a.back AND c.h = a.h GROUP BY 1, 2, 3),
before AS (SELECT back, h, sum(w * ln(f)) AS fit FROM (SELECT back, h, path, any_value(w) AS w, sum(f) AS f FROM dense GROUP BY 1, 2, 3) GROUP BY 1, 2),
after AS (SELECT back, h, sum(w * ln(f)) AS fit FROM (SELECT p.back, p.h, path, any_value(w) AS w, sum(mass * exp(-0.5 * ((x - mean) / std) ** 2) / std / sqrt(2 * pi())) AS f FROM points p JOIN moved m ON m.back = p.back AND m.h = p.h GROUP BY 1, 2, 3) GROUP BY 1, 2),
size AS (SELECT back, h, count(*) AS k FROM parts GROUP BY 1, 2)
SELECT a.back, a.h, k, a.fit - b.fit AS gain, -2 * {s.sample} * b.fit + (3 * k - 1) * ln({s.sample}) AS bic, -2 * {s.sample} * (-ln(sd) - 0.5 * ln(2 * pi()) - 0.5) + 2 * ln({s.sample}) AS bic_of_one
FROM after a JOIN before b ON a.back = b.back AND a.h = b.h JOIN size z ON z.back = a.back AND z.h = a.h JOIN spread c ON c.back = a.back AND c.h = a.h""").df()
    assert len(found) == 6 and found["gain"].between(-1e-12, regime.GAIN).all() and (found["bic"] <= found["bic_of_one"] + 1e-6).all() and found["k"].max() > 1


def test_few_candidates_make_no_search(spark):
    """With too little of the past a search has no candidates, and one with enough takes all the weight."""
    s = regime.Settings(horizon=4, warmup=80, theiler=5, lookback=2, bars=0, volatility=30)
    rows = series(spark, 90 + 80 + 4)
    found = regime.pools(regime.featured(rows, 1, 1, s), s).groupBy("search").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    by = {r["search"]: r for r in found}
    assert sum(r["w"] for r in found) == pytest.approx(1.0) and len({round(r["w"], 9) for r in found}) == 1
    assert all(r["n"] >= s.least for r in found) and by


def test_calibration_counts_origins_that_a_price_of_zero_leaves_no_number(spark):
    """All origins count, and those before the price of 0 have the losses that they have without it."""
    s = calibrate.Settings(folds=1, fold=64, holdout=64)
    price = 100 * np.exp(np.cumsum(np.random.default_rng(2).normal(size=260)) / 50)
    begin = pd.date_range("2020-01-01", periods=260)
    trials = {"X": [calibrate.Trial(v, (("theta", v),), s.tails) for v in (0.0, 4.0)]}
    found = []
    for last in (price[200], 0.0):
        price[200] = last
        bars = spark.createDataFrame(pd.DataFrame({"ticker": "X", "begin": begin, "open": price, "high": price * 1.01, "low": price * 0.99, "close": price, "volume": 1.0}))
        context, base = calibrate.contexts(bars, s, ()), calibrate.baseline(bars, s)
        rows = calibrate.losses(context, trials, s.tails)
        found.append({(r["origin"], r["value"]): r["loss"] for r in rows.collect()})
        assert calibrate.scores(rows, base, s.least).agg({"n": "sum"}).first()[0] == 2 * 128
    full, fallen = found
    assert len(full) == len(fallen) == 2 * 128 and all(v is not None for v in fallen.values())
    before = [k for k in full if k[0] < 195]
    assert len(before) > 100 and [fallen[k] for k in before] == pytest.approx([full[k] for k in before])
    assert not all(np.isfinite(v) for v in fallen.values())


def test_ensemble_stands_prices_of_zero_and_large_ones(spark):
    s = simplex.Settings(horizon=4, levels=2, p_range=(3, 6))
    price = 100 * np.exp(np.cumsum(np.random.default_rng(4).normal(size=160)) / 20)
    price[[40, 155]], price[60:90] = 0.0, price[60:90] * 1e200
    bars = pd.DataFrame({"ticker": "T", "begin": pd.date_range("2020-01-01", periods=160), "close": price})
    paths = simplex.ensemble(spark.createDataFrame(bars), 8, s)
    found = {(r["back"], r["h"]): r["rel"] for r in paths.collect()}
    assert set(found) == {(b, h) for b in range(8) for h in range(1, 5)}
    assert all(np.isfinite(v) != (b == 4) for (b, _), v in found.items())  # from a price of 0 there is no return
    broken = bars.assign(close=bars["close"].where(bars.index != 70))
    assert simplex.ensemble(spark.createDataFrame(broken).withColumn("close", F.nanvl("close", F.lit(None).cast("double"))), 8, s).count() == 32


def test_large_numbers_change_the_scale_alone():
    x = 1 + 0.1 * np.random.default_rng(6).normal(size=150)
    s = simplex.Settings(horizon=4, levels=2, p_range=(3, 6))
    large = x * 2.0**700
    assert simplex.dimensions(large, s) == simplex.dimensions(x, s)
    assert (simplex.smoothed(large, 6, 2, 10, 0.5) == simplex.smoothed(x, 6, 2, 10, 0.5) * 2.0**700).all()
    assert (simplex.trajectory(large, 6, 2, s) == simplex.trajectory(x, 6, 2, s) * 2.0**700).all()


def test_ensemble_band_stands_returns_without_a_number(spark):
    price = 100 * np.exp(np.cumsum(np.random.default_rng(4).normal(size=160)) / 20)
    price[155] = 0.0
    bars = spark.createDataFrame(pd.DataFrame({"ticker": "T", "begin": pd.date_range("2020-01-01", periods=160), "close": price}))
    paths = simplex.ensemble(bars, 8, simplex.Settings(horizon=2, levels=2, p_range=(3, 6))).cache()
    found = {r["h"]: r for r in simplex.band(paths).collect()}
    assert [found[h]["origins"] for h in (1, 2)] == [8, 8]
    for h, r in found.items():
        rel = sorted(x["rel"] for x in paths.where(F.col("h") == h).collect())
        assert abs(rel[-1]) == np.inf or abs(rel[0]) == np.inf
        assert np.isnan(r["std"]) and (r["p25"], r["lo"]) == pytest.approx((rel[1] + 0.75 * (rel[2] - rel[1]), rel[1] + 0.5 * (rel[2] - rel[1])))
    split = spark.createDataFrame([("T", 1, b, v) for b, v in enumerate((float("-inf"), 1.0, 2.0))], "ticker string, h int, back int, rel double")
    lo, hi = simplex.band(split).select("lo", "hi").first()
    assert np.isnan(lo) and hi == pytest.approx(1.75)


def test_calibration_rounds_count_what_is_no_number(spark):
    """A round's sums are the scores of all origins, also of those whose loss is no number; a trial of zeros alone scores as among others."""
    s = calibrate.Settings(folds=1, fold=64, holdout=64)
    price = 100 * np.exp(np.cumsum(np.random.default_rng(2).normal(size=260)) / 50)
    price[200] = 0.0
    bars = spark.createDataFrame(pd.DataFrame({"ticker": "X", "begin": pd.date_range("2020-01-01", periods=260), "open": price, "high": price * 1.01, "low": price * 0.99, "close": price, "volume": 1.0}))
    base = calibrate.baseline(bars, s).cache()
    context = calibrate.with_baseline(calibrate.contexts(bars, s, ()), base).cache()
    trials = [calibrate.Trial(v, (("theta", v),), s.tails) for v in (0.0, 4.0)]
    read = lambda rows: {(r["fold"], r["value"]): (r["ratio"], r["coverage"], r["n"]) for r in rows.collect()}
    want = read(calibrate.scores(calibrate.losses(context, {"X": trials}, s.tails), base, s.least))
    assert {k: v[2] for k, v in want.items()} == {(f, v): 64 for f in (-1, 0) for v in (0.0, 4.0)} and np.isnan(want[-1, 0.0][0])
    for found in (read(calibrate._ratios(context, {"X": trials}, s.tails, s.least)), read(calibrate._ratios(context, {"X": trials[:1]}, s.tails, s.least))):
        assert found and all(v == pytest.approx(want[k], nan_ok=True) for k, v in found.items())
