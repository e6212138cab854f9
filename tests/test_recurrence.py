"""Linear recurrences: blocks, chunks and chains against value by value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import averages, recurrence, spectral, trend
from test_operators import series, values


def plainly(system, x):
    state, out = np.zeros(len(system.a)), []
    for v in x:
        out.append(system.c @ state + system.d * v)
        state = system.a @ state + system.b * v
    return np.array(out).reshape(len(x), len(system.d)).T, state


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 300])
def test_blocks_are_the_values_one_by_one(n):
    rng = np.random.default_rng(n)
    system = recurrence.System(rng.normal(size=(3, 3)) / 3, rng.normal(size=3), rng.normal(size=(2, 3)), rng.normal(size=2))
    x = rng.normal(size=n)
    for got, want in zip(system.run(x), plainly(system, x), strict=True):
        assert got == pytest.approx(want, abs=1e-12)


def test_stretches_compose():
    rng = np.random.default_rng(7)
    system, x = spectral.bank(), rng.normal(size=500)
    whole, end = system.run(x)
    half, state = system.run(x[:170])
    assert system.carried(state, 330) + system.after(x[170:]) == pytest.approx(end, abs=1e-12)
    assert np.hstack([half, system.run(x[170:], state)[0]]) == pytest.approx(whole, abs=1e-12)


def test_the_bank_is_its_filters_one_after_the_other():
    x = np.random.default_rng(3).normal(size=400)
    rest, want = x, []
    for cutoff in spectral.CUTOFFS:
        low = rest
        for b0, b1, b2, a1, a2 in spectral.butterworth(cutoff):
            s1 = s2 = 0.0
            out = []
            for v in low:
                y = b0 * v + s1
                s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
                out.append(y)
            low = np.array(out)
        want.append(rest - low)
        rest = low
    assert spectral.components(x) == pytest.approx(np.array([*want, rest]), abs=1e-12)


def test_chunks_give_what_whole_series_give(spark):
    rows = series(spark, 230).union(series(spark, 90, "U", 2)).union(series(spark, 7, "V", 3)).withColumn("close", F.when((F.col("ticker") != "U") | (F.dayofyear("begin") != 60), F.col("close")))
    whole, cut = (values(averages.ema(rows, 12, chunk=c), "ema") for c in (None, 50))
    assert whole.keys() == cut.keys() and sum(v[0] is not None for v in whole.values()) > 250
    assert all(a == b or a[0] == pytest.approx(b[0]) for a, b in ((whole[k], cut[k]) for k in whole))
    assert all(v[0] is None for (t, _), v in whole.items() if t == "V") and sum(v[0] is not None for (t, _), v in whole.items() if t == "U") == 59 - 11
    known = rows.where("close is not null")
    whole, cut = (values(f(known), "trend", "ratio") for f in (trend.causal_trend, lambda r: trend.causal_trend_in_chunks(r, rows=50)))
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k]) for k in whole)
    steps = trend.ratio_steps(trend.causal_trend(known))
    names = [f"comp_{k}" for k in range(6)]
    whole, cut = (values(spectral.filter_bank(steps, chunk=c), *names) for c in (None, 50))
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k], abs=1e-12) for k in whole)
