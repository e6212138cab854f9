"""Bars from paged archives and files.

``PagedBars`` is a Spark data source ("paged_bars"): one partition for each
ticker, interval and slice of dates, which reads its pages one after the other.
Where pages come from is the option ``pages``: a folder that all executors see,
with files <ticker>/<interval>/<first row>.json of the form
{"columns": [...], "data": [[...], ...]}.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.store import upserted_bars
from .shared import exists, fresh_path, remove, written

SCHEMA = "ticker string, interval string, begin timestamp, open double, high double, low double, close double, volume double, value double"
#: Rows of a page, and the first day of history.
PAGE, FIRST_DAY = 500, "2000-01-01"
INTERVALS = ("1m", "10m", "1h", "1d", "1w", "1mo")


class Slice(InputPartition):
    def __init__(self, ticker: str, interval: str, since: str, until: str):
        self.ticker, self.interval, self.since, self.until = ticker, interval, since, until


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = options["pages"]
        self.tickers = [t for t in options.get("tickers", "").split(",") if t]
        self.intervals = [t for t in options.get("intervals", "1d").split(",") if t]
        unknown = set(self.intervals) - set(INTERVALS)
        if unknown:
            raise ValueError(f"unknown intervals: {sorted(unknown)}")
        self.since = date.fromisoformat(options.get("since", FIRST_DAY))
        self.begins = {key: date.fromisoformat(day) for key, day in json.loads(options.get("begins", "{}")).items()}
        self.until = date.fromisoformat(options["until"]) if "until" in options else date.today()
        self.days = int(options.get("slice_days", "3650"))
        self.page, self.retries, self.delay = (int(options.get(k, d)) for k, d in (("page", str(PAGE)), ("retries", "3"), ("delay_ms", "0")))

    def partitions(self) -> list[Slice]:
        """Tickers x intervals x slices of dates: a plan of some bytes for each task."""
        found = []
        for ticker in self.tickers:
            for interval in self.intervals:
                at = self.begins.get(f"{ticker}|{interval}", self.since)
                while at <= self.until:
                    last = min(at + timedelta(days=self.days - 1), self.until)
                    found.append(Slice(ticker, interval, at.isoformat(), last.isoformat()))
                    at = last + timedelta(days=1)
        return found

    def _page(self, part: Slice, start: int) -> list[dict]:
        """One page as dicts; waits 1, 2, 4 ... seconds between tries. A missing page is an empty one."""
        path = Path(self.pages.removeprefix("file://"), part.ticker, part.interval, f"{start}.json")
        for attempt in range(self.retries + 1):
            try:
                if not path.exists():
                    return []
                page = json.loads(path.read_text())
                return [dict(zip(page["columns"], row, strict=True)) for row in page["data"]]
            except (OSError, ValueError):
                if attempt == self.retries:
                    raise
                time.sleep(2**attempt)
        return []

    def _first(self, part: Slice) -> int:
        """The row at which reading may start: pages double until one reaches the slice, then the gap is halved."""
        before = lambda page: bool(rows := self._page(part, page * self.page)) and len(rows) == self.page and rows[-1]["begin"][:10] < part.since
        if part.since <= FIRST_DAY or not before(0):
            return 0
        low, high = 0, 1
        while before(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if before(middle) else (low, middle)
        return high * self.page

    def read(self, partition: Slice) -> Iterator[tuple]:
        """Pages in order, from the first that can hold the slice's first day to the one that passes its last."""
        start = self._first(partition)
        while True:
            rows = self._page(partition, start)
            for r in rows:
                if partition.since <= r["begin"][:10] <= partition.until:
                    number = [None if r.get(k) is None else float(r[k]) for k in ("open", "high", "low", "close", "volume", "value")]
                    yield (partition.ticker, partition.interval, datetime.fromisoformat(r["begin"]), *number)
            if len(rows) < self.page or rows[-1]["begin"][:10] > partition.until:
                return
            start += len(rows)
            time.sleep(self.delay / 1000)


class PagedBars(DataSource):
    """Options: pages, tickers, intervals, since, begins (JSON: a first day for each "ticker|interval" of its own), until, slice_days, page, retries, delay_ms."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def download(spark: SparkSession, pages: str, tickers: list[str], intervals: list[str], **options: str) -> DataFrame:
    """Bars of all tickers in all intervals."""
    spark.dataSource.register(PagedBars)
    return spark.read.format("paged_bars").options(pages=pages, tickers=",".join(tickers), intervals=",".join(intervals), **options).load()


def write_bars(bars: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes bars by interval, sorted by ticker and time within files, so that scans skip row groups."""
    keys = [c for c in ("ticker", "begin") if c in bars.columns]
    out = bars.repartitionByRange("interval", *keys).sortWithinPartitions("interval", *keys) if "interval" in bars.columns else bars
    writer = out.write.mode("overwrite")
    (writer.partitionBy("interval") if "interval" in bars.columns else writer).format(form).save(path)


def read_bars(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Bars as ``write_bars`` left them; JSON is read by schema, without inference."""
    if form == "json":
        return spark.read.schema(SCHEMA).json(path)
    return spark.read.format(form).load(path)


def fetch_plan(stored: DataFrame, wanted: DataFrame, full_refresh: bool = False) -> DataFrame:
    """For each (ticker, interval) of ``wanted`` the mode, and the day to load from.

    A series that is stored is loaded again from the day of its last bar, which
    may be a partial one; others from the first day on.
    """
    last = stored.groupBy("ticker", "interval").agg(F.max("begin").alias("_last"))
    known = F.col("_last").isNotNull() & F.lit(not full_refresh)
    out = wanted.join(last, ["ticker", "interval"], "left")
    return out.select("ticker", "interval", F.when(known, "incremental").otherwise("full").alias("mode"), F.when(known, F.to_date("_last")).otherwise(F.to_date(F.lit(FIRST_DAY))).alias("date_from"))


def ingest(spark: SparkSession, pages: str, path: str, tickers: list[str], intervals: list[str], until: str, full_refresh: bool = False, **options: str) -> DataFrame:
    """Brings the stored bars under ``path`` up to date and returns the plan: each ticker in each interval, from where it was loaded.

    Series that are stored are loaded from the day of their last bar on, all in
    one scan. Bars lie in a folder for each interval and month; only the months
    that the new bars touch are merged and written again. They are staged in
    full before they replace the old ones, so a lost task or a run that ends
    half-way leaves the stored months as they were, and the same run again gives
    the same bars.
    """
    wanted = spark.createDataFrame([(t, i) for t in tickers for i in intervals], "ticker string, interval string")  # what a user names
    stored = stored_bars(spark, path)
    plan = fetch_plan(stored, wanted, full_refresh).collect()  # a row for each series asked for
    begins = json.dumps({f"{r['ticker']}|{r['interval']}": r["date_from"].isoformat() for r in plan})
    new = written(download(spark, pages, tickers, intervals, begins=begins, until=until, **options).withColumn("month", F.date_format("begin", "yyyy-MM")), "new")
    touched = new.select("interval", "month").distinct()
    merged = upserted_bars(stored.join(touched, ["interval", "month"], "left_semi"), new)
    stage = fresh_path(spark, "stage")
    merged.repartition("interval", "month").sortWithinPartitions("ticker", "begin").write.parquet(stage)
    spark.read.schema(merged.schema).parquet(stage).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval", "month").parquet(path)
    remove(spark, stage)
    return spark.createDataFrame(plan, "ticker string, interval string, mode string, date_from date")


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars under ``path`` with their month, by which scans skip folders; no rows before the first ingest."""
    schema = f"{SCHEMA}, month string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*[c.split()[0] for c in schema.split(", ")])
