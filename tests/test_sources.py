"""Paged source, files, instruments and streams."""

import json
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import zigzag
from tidemark.operators.bars import logged
from tidemark.sources import candles, fixtures, instruments
from tidemark.streaming import bars as stream
from conftest import SF
from test_operators import DAY, series


def test_pages_are_read_to_the_end(spark, tmp_path):
    columns = ["open", "close", "high", "low", "value", "volume", "begin", "end"]
    for ticker, n in (("AA", 7), ("BB", 3)):
        rows = [[1.0, 2.0, 3.0, 0.5, 9.0, None, f"2024-01-0{k + 1} 00:00:00", ""] for k in range(n)]
        folder = tmp_path / ticker / "1d"
        folder.mkdir(parents=True)
        for start in range(0, n, 3):
            (folder / f"{start}.json").write_text(json.dumps({"columns": columns, "data": rows[start : start + 3]}))
    found = candles.download(spark, str(tmp_path), ["AA", "BB", "CC"], ["1d"], page="3", until="2024-01-05", since="2024-01-01")
    assert {r["ticker"]: r["n"] for r in found.groupBy("ticker").agg(F.count("*").alias("n")).collect()} == {"AA": 5, "BB": 3}
    assert found.where("volume is not null").count() == 0
    plan = candles.fetch_plan(found, spark.createDataFrame([("AA", "1d"), ("CC", "1d")], "ticker string, interval string")).collect()
    assert {r["ticker"]: (r["mode"], str(r["date_from"])) for r in plan} == {"AA": ("incremental", "2024-01-05"), "CC": ("full", "2000-01-01")}


def test_files_round_trip(spark, tmp_path):
    rows = series(spark, 20).withColumn("interval", F.lit("1d"))
    for form in ("parquet", "json"):
        candles.write_bars(rows, f"{tmp_path}/{form}", form)
        back = candles.read_bars(spark, f"{tmp_path}/{form}", form)
        assert back.select("begin", "close").exceptAll(rows.select("begin", "close")).count() == 0 and back.count() == 20


def test_listing(spark):
    listing = spark.createDataFrame([("A", "Alpha", "Alpha Inc", "stock_shares", "X"), ("B", "Beta", None, "none", "X")], "secid string, shortname string, name string, group string, board string")
    assert [r["engine"] for r in instruments.searched(listing, " alp ").collect()] == ["stock"]
    assert instruments.searched(listing, "beta").count() == 0
    assert instruments.board(listing, "e", "m", "t", "X").count() == 2
    values = spark.createDataFrame([("A", "LOTSIZE", "10"), ("A", "MINSTEP", "x"), ("B", "OTHER", "1")], "secid string, name string, value string")
    assert sorted(map(tuple, instruments.trading_parameters(values).collect())) == [("A", 10, 0.01), ("B", 1, 0.01)]


def test_upserts_keep_late_and_partial_bars(spark, tmp_path):
    sink = stream.Upserts(f"{tmp_path}/bars")
    assert sink.table(spark) is None
    bars = series(spark, 10).select("ticker", "begin", "close")
    sink(bars, 0)
    late = bars.where(F.col("begin") == F.lit(DAY)).withColumn("close", F.lit(5.0))
    sink(late, 1)
    sink(late, 1)  # the same batch again
    found = sink.table(spark)
    assert found.count() == 10 and found.where("close = 5").count() == 1


def test_stream_finds_the_pivots_of_the_batch(spark, tmp_path):
    rows = series(spark, 240)
    for k in range(4):  # four files, four batches
        part = rows.where((F.datediff("begin", F.lit(DAY)) >= 60 * k) & (F.datediff("begin", F.lit(DAY)) < 60 * k + 60))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.pivots(source, 0.05).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["seq", "log_price", "extreme_begin", "confirm_begin", "direction"]
    batch = zigzag.pivots(logged(rows), 0.05).select(*columns).orderBy("seq").collect()
    assert spark.read.parquet(f"{tmp_path}/out").select(*columns).orderBy("seq").collect() == batch and len(batch) > 5


def test_ingest_touches_only_the_months_of_new_bars(spark, tmp_path):
    columns = ["open", "close", "high", "low", "value", "volume", "begin"]

    def archive(days, price):
        folder = tmp_path / "pages" / "AA" / "1d"
        folder.mkdir(parents=True, exist_ok=True)
        rows = [[price, price, price, price, 1.0, 1.0, f"{day} 00:00:00"] for day in days]
        for start in range(0, len(rows), 2):
            (folder / f"{start}.json").write_text(json.dumps({"columns": columns, "data": rows[start : start + 2]}))

    files = lambda: {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in (tmp_path / "bars").rglob("*.parquet")}
    run = lambda: {(r["mode"], str(r["date_from"])) for r in candles.ingest(spark, str(tmp_path / "pages"), str(tmp_path / "bars"), ["AA"], ["1d"], "2024-12-31", page="2").collect()}
    archive(["2024-01-05", "2024-01-20", "2024-02-03"], 1.0)
    assert run() == {("full", "2000-01-01")}
    first = files()
    archive(["2024-01-05", "2024-01-20", "2024-02-03", "2024-02-04", "2024-03-01"], 2.0)
    assert run() == {("incremental", "2024-02-03")}
    second = files()
    kept = {f for f in first if "month=2024-01" in str(f)}
    assert kept and all(second[f] == first[f] for f in kept) and not any(f in second for f in first if f not in kept)
    stored = {str(r["begin"])[:10]: r["close"] for r in candles.stored_bars(spark, str(tmp_path / "bars")).collect()}
    assert stored == {"2024-01-05": 1.0, "2024-01-20": 1.0, "2024-02-03": 2.0, "2024-02-04": 2.0, "2024-03-01": 2.0}
    assert run() == {("incremental", "2024-03-01")} and len({str(r["begin"]) for r in candles.stored_bars(spark, str(tmp_path / "bars")).collect()}) == 5


def test_no_task_sorts_a_ticker_of_the_walk(spark):
    plan = fixtures.walk.__wrapped__(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    over = [line for line in re.findall(r"Window .*", plan) if "l_orderkey" in line]
    assert over and all(re.search(r"\], \[ticker#\d+, begin#\d+\],", line) for line in over)


def test_walk_far_from_its_start_is_that_of_sql(spark, tmp_path):
    # many copies of the lines of a day take prices to 0 and beyond 1e9
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (l_orderkey + 1000000 * k AS l_orderkey) FROM '{SF}/lineitem.parquet', range(400) r(k) WHERE l_shipdate < TIMESTAMP '1996-01-01') TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    key = ["ticker", "begin"]
    got = fixtures.walk(spark, str(tmp_path)).toPandas().sort_values(key).set_index(key)
    want = con.sql(f"WITH {fixtures.SQL['walk']} SELECT * FROM bars").df().sort_values(key).set_index(key)
    assert got["low"].min() == 0 and got["high"].max() > 1e9 and (got.index == want.index).all()
    assert np.allclose(got, want[got.columns], rtol=1e-13, atol=0)
