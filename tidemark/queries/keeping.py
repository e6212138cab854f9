"""Queries on kept tables, pools, listings, markers and position sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import pinball, ramp, steps_after, to_step, uniform
from ..operators import pools, risk, store
from ..sources import instruments
from ..sources.fixtures import orders, raw, table
from .common import on_bars, r, shown

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ── upserts, merges, retention ──────────────────────────────────────────────


@query(on_bars("raw", """SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.begin, o.begin) AS begin, CASE WHEN n.ticker IS NULL THEN o.close ELSE n.close + 1 END AS close,
  CASE WHEN n.ticker IS NULL THEN o.volume WHEN n.volume > 100 THEN n.volume ELSE 0 END AS volume
FROM (SELECT * FROM bars WHERE begin < TIMESTAMP '1999-06-01') o FULL JOIN (SELECT * FROM bars WHERE begin >= TIMESTAMP '1999-01-01') n ON n.ticker = o.ticker AND n.begin = o.begin"""))
def upsert_latest(spark, sf):
    bars = raw(spark, sf).select("ticker", "begin", "close", "volume")
    stored = bars.where("begin < timestamp'1999-06-01'")
    incoming = bars.where("begin >= timestamp'1999-01-01'").withColumns({"close": F.col("close") + 1, "volume": F.when(F.col("volume") > 100, F.col("volume"))})
    return store.upserted_bars(stored, incoming, ("ticker", "begin"))




@query("""SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.data_source, n.data_source) AS data_source,
  CASE WHEN o.ticker IS NULL THEN coalesce(n.asset_type, 'stock') WHEN n.ticker IS NULL THEN o.asset_type ELSE coalesce(n.asset_type, o.asset_type) END AS asset_type,
  CASE WHEN n.ticker IS NULL THEN o.full_name ELSE coalesce(n.full_name, o.full_name) END AS full_name,
  CASE WHEN o.ticker IS NULL THEN 'manual' WHEN n.added_via = 'manual' THEN 'manual' ELSE o.added_via END AS added_via
FROM (SELECT c_custkey AS ticker, 'x' AS data_source, c_mktsegment AS asset_type, c_name AS full_name, CASE WHEN c_custkey % 2 = 0 THEN 'pool' ELSE 'manual' END AS added_via FROM customer WHERE c_custkey % 3 <> 0) o
FULL JOIN (SELECT c_custkey AS ticker, 'x' AS data_source, CASE WHEN c_custkey % 4 = 0 THEN 'fund' END AS asset_type, CASE WHEN c_custkey % 5 = 0 THEN 'renamed' END AS full_name, CASE c_custkey % 7 WHEN 0 THEN 'manual' WHEN 1 THEN 'pool' END AS added_via FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 7 <> 1) n
ON o.ticker = n.ticker""")
def instrument_merge(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("ticker"), F.lit("x").alias("data_source"), "c_mktsegment", "c_name")
    odd = F.col("ticker") % 2
    stored = c.where("ticker % 3 <> 0").select("ticker", "data_source", F.col("c_mktsegment").alias("asset_type"), F.col("c_name").alias("full_name"), F.when(odd == 0, "pool").otherwise("manual").alias("added_via"))
    incoming = c.where("ticker % 2 = 0 and ticker % 7 <> 1").select("ticker", "data_source", F.expr("case when ticker % 4 = 0 then 'fund' end").alias("asset_type"), F.expr("case when ticker % 5 = 0 then 'renamed' end").alias("full_name"), F.expr("case ticker % 7 when 0 then 'manual' when 1 then 'pool' end").alias("added_via"))
    return store.merged_instruments(stored, incoming)


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey IN (
  SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)""")
def retention_keep_n(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return store.retained(tasks, 10, "F").select("id", "status")


@query("""SELECT p_brand AS model_type, p_partkey AS name, p_size > 40 AND p_partkey = max(CASE WHEN p_size > 40 THEN p_partkey END) OVER (PARTITION BY p_brand) AS is_default FROM part""")
def default_preset(spark, sf):
    presets = table(spark, sf, "part").select(F.col("p_brand").alias("model_type"), F.col("p_partkey").alias("name"), F.col("p_partkey").alias("saved_at"), (F.col("p_size") > 40).alias("is_default"))
    return store.presets_with_default(presets).select("model_type", "name", "is_default")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return store.without(table(spark, sf, "customer"), gone, ("c_custkey",)).select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def reference_nulled(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0")
    return store.unreferenced(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@query("""SELECT event_type, rank, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 20""")
def history_per_model(spark, sf):
    found = store.newest_of_each(table(spark, sf, "events"), 20, ("event_type",), (F.desc("ts"), F.desc("event_id")))
    return found.select("event_type", "rank", "event_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_projection(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "props")
    return store.json_fields(rows, "props", {"k": "$.k", "none": "$.none"})


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1') AS k, 'light' AS theme FROM events")
def settings_merge(spark, sf):
    merged = store.settings_over({"k": "-1", "theme": "light"}, "props")
    rows = table(spark, sf, "events").select("event_id", merged.alias("m"))
    return rows.select("event_id", F.element_at("m", "k").alias("k"), F.element_at("m", "theme").alias("theme"))


# ── listings ────────────────────────────────────────────────────────────────


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS added FROM customer")
def existence_flag(spark, sf):
    known = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return store.with_flag(table(spark, sf, "customer").select("c_custkey"), known, ("c_custkey",), "added")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')")
def search_filter(spark, sf):
    return store.matching(table(spark, sf, "part"), " RED ", ("p_name", "p_brand")).select("p_partkey", "p_name", "p_brand")


@query("SELECT c_custkey, c_name, c_acctbal > 9000 AS favourite FROM customer ORDER BY favourite DESC, c_name, c_custkey LIMIT 20 OFFSET 20")
def page_favourites(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 9000).alias("favourite"))
    return store.page(rows, (F.desc("favourite"), "c_name", "c_custkey"), 1)


_GROUP = "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{g}'" for k, g in enumerate(pools.GROUPS)) + " ELSE 'other' END"


@query(f"""SELECT p_partkey AS secid, g.grp AS "group", m.engine, m.market, m.asset_type FROM (SELECT p_partkey, {_GROUP} AS grp FROM part) g
JOIN (VALUES {', '.join(f"('{g}', '{e}', '{m}', '{a}')" for g, (e, m, a) in pools.GROUPS.items())}) m(grp, engine, market, asset_type) ON m.grp = g.grp""")
def group_map_join(spark, sf):
    listing = table(spark, sf, "part").select(F.col("p_partkey").alias("secid"), F.expr(_GROUP).alias("group"))
    return instruments.classified(listing).select("secid", "group", "engine", "market", "asset_type")


@query("SELECT p_partkey AS secid, CASE WHEN p_size % 7 = 0 THEN 1 ELSE p_size END AS lot_size, CASE WHEN p_size % 5 = 0 THEN 0.01::DOUBLE ELSE p_size / 4.0::DOUBLE END AS price_step FROM part")
def trading_params_pivot(spark, sf):
    part = table(spark, sf, "part")
    lots = part.select(F.col("p_partkey").alias("secid"), F.lit("LOTSIZE").alias("name"), F.when(F.col("p_size") % 7 == 0, "bad").otherwise(F.col("p_size").cast("string")).alias("value"))
    steps = part.where("p_size % 5 <> 0").select(F.col("p_partkey").alias("secid"), F.lit("MINSTEP").alias("name"), (F.col("p_size") / 4.0).cast("string").alias("value"))
    return instruments.trading_parameters(lots.unionByName(steps))


_ENGINES = {"1-URGENT": "currency", "2-HIGH": "futures", "3-MEDIUM": "stock", "4-NOT SPECIFIED": "stock", "5-LOW": "stock"}


@query(on_bars("orders", """SELECT rank, ticker, bars, round(score, 2) + 0.0 AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, ticker) AS rank FROM (
  SELECT ticker, count(*) AS bars, CASE WHEN ticker = '1-URGENT' THEN count(*)::DOUBLE WHEN ticker = '2-HIGH' THEN sum(volume) ELSE sum(value) END AS score
  FROM bars WHERE begin >= TIMESTAMP '2001-07-02' GROUP BY ticker HAVING count(*) >= 15) WHERE score > 0) WHERE rank <= 3"""))
def liquidity_rank(spark, sf):
    kinds = spark.createDataFrame(list(_ENGINES.items()), "ticker string, engine string")
    scores = pools.liquidity(orders(spark, sf), kinds, F.to_timestamp(F.lit("2001-07-02")))
    return shown(pools.most_liquid(scores, 3), "rank", "ticker", "bars", score=2)


@query("""SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, name) AS rank FROM (
  SELECT 0 AS part, p_size AS id, p_name AS name FROM part WHERE p_brand = 'Brand#1' UNION ALL SELECT 1, p_size, p_name FROM part WHERE p_brand = 'Brand#2')) WHERE rank = 1""")
def pool_union_distinct(spark, sf):
    part = table(spark, sf, "part").select("p_brand", F.col("p_size").alias("id"), F.col("p_name").alias("name"))
    return pools.union_distinct([part.where("p_brand = 'Brand#1'").drop("p_brand"), part.where("p_brand = 'Brand#2'").drop("p_brand")], "id", "name")


@query("SELECT c_mktsegment, array_to_string(list_sort(list(DISTINCT c_nationkey::VARCHAR)), '+') || ':25' AS pool_key FROM customer GROUP BY c_mktsegment")
def pool_keys(spark, sf):
    sets = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.collect_set(F.col("c_nationkey").cast("string")).alias("names"))  # at most 25 nations
    return sets.select("c_mktsegment", pools.pool_key("names", 25).alias("pool_key"))


# ── markers ─────────────────────────────────────────────────────────────────

_MARKERS = "markers AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS model_type, o_orderkey AS id, o_totalprice AS y FROM orders)"


def _markers(spark, sf):
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("model_type"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"))


@query(f"WITH {_MARKERS} SELECT id, day, row_number() OVER (PARTITION BY day ORDER BY model_type, id) - 1 AS stack FROM markers")
def marker_stacking(spark, sf):
    return store.stacked(_markers(spark, sf)).select("id", "day", "stack")


@query(f"WITH {_MARKERS} SELECT day, 150000.0::DOUBLE AS price, min_by(id, (abs(y - 150000.0), id)) AS id FROM markers GROUP BY day".replace("min_by(id, (abs(y - 150000.0), id))", "(list(id ORDER BY abs(y - 150000.0), id))[1]"))
def nearest_marker(spark, sf):
    markers = _markers(spark, sf)
    clicks = markers.select("day").distinct().withColumn("price", F.lit(150000.0))
    return store.nearest_marker(markers, clicks)


# ── position sizing and scalars ─────────────────────────────────────────────

_TRADES = """trades AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, CASE WHEN o_orderkey % 3 = 0 THEN 'profit' ELSE 'stop' END AS anchor,
  300000.0::DOUBLE AS deposit, 2.0::DOUBLE AS risk_pct, e AS entry, CASE WHEN o_orderkey % 2 = 0 THEN e * 0.95 ELSE e * 1.05 END AS stop, CASE WHEN o_orderkey % 2 = 0 THEN e * 1.25 ELSE e * 0.75 END AS tp,
  3.0::DOUBLE AS rr, 13.0::DOUBLE AS borrow_pct, 30 AS hold_days, 1 + o_orderkey % 10 AS lot FROM (SELECT *, o_totalprice / 100.0::DOUBLE AS e FROM orders)),
far AS (SELECT *, CASE direction WHEN 'long' THEN 1.0 ELSE -1.0 END AS sign, CASE direction WHEN 'short' THEN borrow_pct / 100 / 365 ELSE 0.0::DOUBLE END AS rate FROM trades),
solved AS (SELECT *, CASE anchor WHEN 'stop' THEN abs(entry - stop) ELSE (abs(entry - tp) - entry * rate * hold_days) / rr - entry * rate * hold_days END AS sd,
  CASE anchor WHEN 'stop' THEN rr * abs(entry - stop) + (rr + 1) * entry * rate * hold_days ELSE abs(entry - tp) END AS rd FROM far),
sized AS (SELECT *, CASE WHEN sd + entry * rate * hold_days <= 0 THEN 0 ELSE greatest(floor(deposit * risk_pct / 100 / (sd + entry * rate * hold_days) / lot), 1) * lot END AS size FROM solved)"""


def _trades(spark, sf):
    o = table(spark, sf, "orders").withColumn("e", F.col("o_totalprice") / 100.0)
    even = F.col("o_orderkey") % 2 == 0
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(even, "long").otherwise("short").alias("direction"), F.when(F.col("o_orderkey") % 3 == 0, "profit").otherwise("stop").alias("anchor"),
        F.lit(300000.0).alias("deposit"), F.lit(2.0).alias("risk_pct"), F.col("e").alias("entry"), F.when(even, F.col("e") * 0.95).otherwise(F.col("e") * 1.05).alias("stop"), F.when(even, F.col("e") * 1.25).otherwise(F.col("e") * 0.75).alias("tp"),
        F.lit(3.0).alias("rr"), F.lit(13.0).alias("borrow_pct"), F.lit(30).alias("hold_days"), (1 + F.col("o_orderkey") % 10).alias("lot"),
    )


@query(f"""WITH {_TRADES} SELECT id, {r("CASE anchor WHEN 'stop' THEN stop ELSE entry - sign * sd END")} AS stop, {r("CASE anchor WHEN 'stop' THEN entry + sign * rd ELSE tp END")} AS tp, size::DOUBLE AS size,
  {r('size * entry', 4)} AS notional, {r('size * entry * rate * hold_days')} AS borrow_cost, {r('size * sd + size * entry * rate * hold_days')} AS risk, {r('size * rd - size * entry * rate * hold_days')} AS reward,
  {r('(size * sd + size * entry * rate * hold_days) / deposit', 12)} AS risk_share FROM sized""")
def position_sizing(spark, sf):
    return shown(risk.economics(_trades(spark, sf)), "id", "size", stop=6, tp=6, notional=4, borrow_cost=6, risk=6, reward=6, risk_share=12)


@query(f"""WITH {_TRADES} SELECT id, CASE WHEN entry <= 0 THEN 'entry' WHEN anchor = 'stop' AND entry > 4000 THEN 'stop side' WHEN anchor = 'profit' AND entry > 4000 THEN 'tp side' END AS problem FROM trades""")
def trade_problems(spark, sf):
    trades = _trades(spark, sf)
    wrong = F.when(F.col("direction") == "long", "short").otherwise("long")
    return risk.problems(trades.withColumn("direction", F.when(F.col("entry") > 4000, wrong).otherwise(F.col("direction")))).select("id", "problem")


@query(f"""SELECT o_orderkey AS id, {r('floor(o_totalprice / 25 + 0.5) * 25')} AS stepped, {r('greatest(0.9 * (o_totalprice - 150000), -0.1 * (o_totalprice - 150000))')} AS loss,
  {r("CAST('0x' || substr(md5(o_orderkey::VARCHAR || ':' || o_custkey::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0", 9)} AS draw, date_trunc('day', o_orderdate) + INTERVAL 21 DAY AS later,
  {r('greatest(least((tanh(6 * (o_custkey / 2000.0 - 0.4)) - tanh(-2.4)) / (tanh(3.6) - tanh(-2.4)), 1), 0)')} AS mix FROM orders""")
def scalar_functions(spark, sf):
    o = table(spark, sf, "orders")
    found = o.select(
        F.col("o_orderkey").alias("id"), to_step("o_totalprice", F.lit(25.0)).alias("stepped"), pinball("o_totalprice", F.lit(150000.0), 0.9).alias("loss"), uniform(F.col("o_orderkey"), F.col("o_custkey")).alias("draw"),
        steps_after("o_orderdate", 3, 604800).alias("later"), ramp(F.col("o_custkey") / 2000.0, 0.4, 6.0).alias("mix"),
    )
    return shown(found, "id", "later", stepped=6, loss=6, draw=9, mix=6)


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction, o_orderkey AS id, round(2 * o_totalprice - (o_totalprice - 500), 4) + 0.0 AS flipped FROM orders")
def flipped_prices(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("direction"), "o_totalprice")
    return shown(o.withColumn("flipped", risk.flipped("o_totalprice", F.col("o_totalprice") - 500, F.lit(True))), "direction", "id", flipped=4)


