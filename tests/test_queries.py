"""Every query against DuckDB on the smallest tables; those without SQL against what must hold."""

import duckdb
import numpy as np
import pytest

from compare import database, differences
from conftest import SF
from tidemark import queries as engine
from tidemark.operators import ranks
from tidemark.queries import common, models, series

QUERIES, SQL = engine.queries(), engine.oracle_sql()
#: A liquidity window of 30 days holds too few bars at the smallest scale.
EMPTY = {"liquidity_rank", "history_guard", "band_zones", "band_forecast", "band_forecast_smap", "page_favourites"}


@pytest.fixture(scope="module")
def duck():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert differences(got, duck.sql(SQL[name]).df()) == ""
    assert len(got) or name in EMPTY


def test_no_task_sorts_a_group_of_quantiles(spark):
    over = [line for line in QUERIES["weighted_quantiles"](spark, SF)._jdf.queryExecution().sparkPlan().toString().splitlines() if "Window" in line and "value" in line]
    assert over and all("_part#" in line for line in over)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_filter_bank_components_sum_to_the_series(spark):
    parts = QUERIES["filter_bank"](spark, SF).toPandas().set_index(["ticker", "begin"]).sum(axis=1)
    steps = QUERIES["dratio"](spark, SF).toPandas().dropna().set_index(["ticker", "begin"])["dratio"]
    assert (parts - steps).abs().max() < 1e-7


def test_scenarios_are_mixtures(spark):
    found = QUERIES["regime_mixture"](spark, SF).toPandas()
    sums = found.groupby(["ticker", "back", "h"])["weight"].sum()
    assert len(sums) and (sums - 1).abs().max() < 1e-5
    assert found["part"].max() <= 2 and (found["std"] >= 0).all() and set(found["regime"]) <= {-1, 0, 1, 2}


def test_ensemble_band_holds_its_quartiles(spark):
    found = QUERIES["ensemble_band"](spark, SF).toPandas()
    assert len(found) and (found["p25"] <= found["p75"]).all() and (found["lo"] <= found["hi"]).all() and (found["std"] >= 0).all()


def test_calibrated_parameters_score_as_in_sql(spark, duck):
    """The holdout's ratio and coverage of the parameters and quantiles that the whole calibration returns, from the bars again in SQL."""
    found = QUERIES["calibration"](spark, SF).toPandas()
    assert len(found) == 9 and found.groupby("ticker")["level"].nunique().eq(3).all()
    got = found[found["level"] == 90.0].reset_index(drop=True)
    duck.register("params", got)
    features = ranks.FEATURES
    shapes = f"shapes AS (SELECT d.*, {', '.join(f'b.rank_{f}' for f in features)} FROM delays d JOIN bar_ranks b ON b.ticker = d.ticker AND b.begin = d.begin WHERE {' AND '.join(f'b.rank_{f} IS NOT NULL' for f in features)})"
    squares = ", ".join(f"power(x.rank_{f} - q.rank_{f}, 2) AS sq_{f}" for f in features)
    context = models._CONTEXT.format(delays="shapes").replace("q.win AS qwin", f"q.win AS qwin, {squares}")
    weigh = "theta * d / greatest(avg(d) OVER (PARTITION BY ticker, fold, o), 1e-10)" + "".join(f" + {f} * sq_{f}" for f in features)
    kept = f"kept_ctx AS (SELECT * FROM (SELECT *, exp(-({weigh})) AS w FROM (SELECT c.*, p.* EXCLUDE (ticker), {models._l2('win', 'qwin')} AS d FROM ctx c JOIN params p USING (ticker) WHERE fold = -1)))"
    by = models._BY + ", read_low, read_high"
    cut = lambda c, q: f"(SELECT {by}, min_by(v, k) FILTER (k >= {q}) AS above, min(k) FILTER (k >= {q}) AS k1, max_by(v, k) FILTER (k <= {q}) AS below, max(k) FILTER (k <= {q}) AS k0 FROM (SELECT {by}, {c} AS v, (sum(w) OVER z - 0.5 * w) / sum(w) OVER (PARTITION BY {by}) AS k FROM kept_ctx WINDOW z AS (PARTITION BY {by} ORDER BY {c}, i ROWS UNBOUNDED PRECEDING)) GROUP BY {by})"
    read = lambda t, q: f"CASE WHEN {t}.below IS NULL THEN {t}.above WHEN {t}.above IS NULL OR {t}.k1 = {t}.k0 THEN {t}.below ELSE {t}.below + ({q} - {t}.k0) / ({t}.k1 - {t}.k0) * ({t}.above - {t}.below) END"
    both = f"ends AS (SELECT a.*, {read('a', 'a.read_low')} AS lo, {read('b', 'b.read_high')} AS hi FROM {cut('low', 'read_low')} a JOIN {cut('high', 'read_high')} b USING (ticker, o))"
    plain = models._SCORES[models._SCORES.index("plain AS") : models._SCORES.index(",\nscores AS")]
    sql = common.on_bars("walk", f"""SELECT e.ticker, round(avg({models._loss('')}) / any_value(u.loss), 6) AS ratio, round(avg((anchor * (1 + lo) <= alow AND ahigh <= anchor * (1 + hi))::INT), 6) AS coverage
FROM ends e JOIN pbu u ON u.ticker = e.ticker AND u.fold = -1 GROUP BY e.ticker""", common.PLACED, common.LOGGED, series.RAWS, series.RANKED, common.RATIOS, series.AHEAD.format(source="steps"), common.windows(8, source="ahead"), models._LAST, shapes, context, kept, both, plain)  # fmt: skip
    want = duck.sql(sql).df().set_index("ticker")
    got = got.set_index("ticker")
    assert len(want) == 3 and (got["ratio"] - want["ratio"]).abs().max() < 2e-6 and (got["coverage"] - want["coverage"]).abs().max() < 2e-6


@pytest.fixture(scope="module")
def fallen(tmp_path_factory):
    """Lines whose many copies take the walk's prices to 0 and beyond 1e9."""
    folder = tmp_path_factory.mktemp("fallen")
    duckdb.sql(f"COPY (SELECT * REPLACE (l_orderkey + 1000000 * k AS l_orderkey) FROM '{SF}/lineitem.parquet', range(100) r(k) WHERE l_shipdate < TIMESTAMP '1997-01-01') TO '{folder}/lineitem.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["causal_logs", "delay_windows", "amp_cos_topk", "bar_rank_features", "corridor_pool", "analog_paths", "corridor_bounds", "logtrend_in_chunks", "band_forecast", "band_forecast_smap", "band_result_rows", "band_zones"])
def test_prices_of_zero_are_those_of_sql(spark, fallen, name):
    keys = {"ticker": str, "begin": str}
    frames = [f.astype({c: t for c, t in keys.items() if c in f}) for f in (QUERIES[name](spark, fallen).toPandas(), database(fallen).sql(SQL[name]).df())]
    got, want = [f.sort_values(list(f.columns)).reset_index(drop=True) for f in (frames[0], frames[1][list(frames[0].columns)])]
    assert len(got) == len(want)
    for c in got:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c].astype(float), rtol=1e-7, atol=1e-8, equal_nan=True), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
