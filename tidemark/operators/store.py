"""Tables that are kept: upserts, merges, retention, defaults, settings, listings.

Parquet has no MERGE, so an update is a new version of the table: the union or
join of the stored rows with the incoming ones, of which a window or an
aggregate keeps the right one. Incoming rows win over stored ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BAR_KEY = ("ticker", "interval", "begin")


def upserted(stored: DataFrame, incoming: DataFrame, key: Sequence[str] = BAR_KEY, version: str | None = None) -> DataFrame:
    """Last write wins: for each key the incoming row, else the stored one.

    Of several incoming rows the one with the largest ``version`` counts (needed
    if keys repeat within ``incoming``). Keys may be null.
    """
    order = [F.desc("_side")] + ([F.desc_nulls_last(version)] if version else [])
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_side")


def upserted_bars(stored: DataFrame, incoming: DataFrame, key: Sequence[str] = BAR_KEY, version: str | None = None) -> DataFrame:
    """``upserted`` for bars: a null volume is stored as 0."""
    return upserted(stored, incoming.withColumn("volume", F.coalesce("volume", F.lit(0.0))), key, version)


#: What a new instrument gets where nothing is given.
INSTRUMENT_DEFAULTS = {"asset_type": "stock", "engine": "stock", "market": "shares", "added_via": "manual"}


def merged_instruments(stored: DataFrame, incoming: DataFrame, key: Sequence[str] = ("ticker", "data_source")) -> DataFrame:
    """Instruments after an update: a null input keeps what is stored; new rows get the defaults.

    ``added_via`` becomes manual where the input says so and otherwise stays.
    """
    rest = [c for c in stored.columns if c not in key]
    new = incoming.withColumn("_given", F.lit(True))
    old = stored.withColumn("_known", F.lit(True))
    both = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")

    def value(c: str) -> Column:
        given = F.col(f"n.{c}") if c in incoming.columns else F.lit(None)
        if c == "added_via":
            kept = F.when(given == "manual", "manual").otherwise(F.col("o.added_via"))
        else:
            kept = F.coalesce(given, F.col(f"o.{c}"))
        fresh = F.coalesce(given, F.lit(INSTRUMENT_DEFAULTS.get(c)))
        return F.when(F.col("o._known"), F.when(F.col("n._given"), kept).otherwise(F.col(f"o.{c}"))).otherwise(fresh).alias(c)

    return both.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key], *[value(c) for c in rest])


def without(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` whose key is not in ``gone``: a delete, and the cascade of one to a depending table."""
    return rows.join(gone.select(*key).distinct(), list(key), "left_anti")


def unreferenced(rows: DataFrame, reference: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """``rows`` with null in ``reference`` where it points to a deleted row."""
    marks = gone.select(F.col(gone_key).alias(reference)).distinct().withColumn("_gone", F.lit(True))
    out = rows.join(marks, reference, "left")
    return out.withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).drop("_gone").select(*rows.columns)


def retained(tasks: DataFrame, keep: int, status: str = "done", by: Sequence[str] = ()) -> DataFrame:
    """``tasks`` without those of ``status`` beyond the ``keep`` newest (by updated_at, then id)."""
    done = F.coalesce(F.col("status") == status, F.lit(False))
    newest = tasks.where(done).select("id", "updated_at", *by)
    if by:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("updated_at"), F.desc("id")))
        newest = newest.withColumn("_rank", rank).where(F.col("_rank") <= keep)
    else:
        newest = newest.orderBy(F.desc("updated_at"), F.desc("id")).limit(keep)
    kept = newest.select("id").withColumn("_kept", F.lit(True))
    return tasks.join(kept, "id", "left").where(~done | F.col("_kept").isNotNull()).select(*tasks.columns)


def presets_with_default(presets: DataFrame, by: str = "model_type", flag: str = "is_default", order: str = "saved_at", tie: str = "name") -> DataFrame:
    """``presets`` of which each model type has one default at most: the last saved of those that claim to be."""
    claim = F.when(F.col(flag), F.struct(order, tie))
    last = F.max(claim).over(W.partitionBy(by))
    return presets.withColumn(flag, F.coalesce(F.col(flag) & (F.struct(order, tie) == last), F.lit(False)))


def settings_over(defaults: Mapping[str, str], stored: Column | str) -> Column:
    """A map of defaults with the entries of a stored JSON object over them; invalid JSON counts as empty."""
    stored = F.col(stored) if isinstance(stored, str) else stored
    given = F.coalesce(F.from_json(stored, "map<string,string>"), F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)


def newest_of_each(rows: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their rank."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def json_fields(rows: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """``rows`` with fields of a JSON column as texts: {name: path}; the document is not kept."""
    return rows.select(*[c for c in rows.columns if c != column], *[F.get_json_object(column, path).alias(name) for name, path in fields.items()])


def matching(rows: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which one of ``columns`` contains ``text``, whatever the case; all rows for an empty text."""
    text = text.strip().lower()
    test = F.lit(not text)
    for c in columns:
        test = test | F.coalesce(F.lower(c).contains(text), F.lit(False))
    return rows.where(test)


def visible(instruments: DataFrame) -> DataFrame:
    """Instruments that were added by hand; those that a pool brought along are hidden."""
    return instruments.where(F.col("added_via") == "manual")


def found_by(rows: DataFrame, **key) -> DataFrame:
    """The rows with exactly these values, null for null: a lookup by key, pushed down to the scan."""
    for name, value in key.items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return rows


def newest_by_json(rows: DataFrame, column: str, path: str, tie: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` rows with the largest text at ``path`` of a JSON column (nulls last), then by ``tie``."""
    return rows.orderBy(F.desc_nulls_last(F.get_json_object(column, path)), *tie).limit(n)


def updated(rows: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``changes`` set, nulls included, where a key is in ``changes``; keys are unique there, and new ones add no row."""
    fields = [c for c in changes.columns if c not in key]
    new = changes.select(*key, F.struct(*fields).alias("_new"), F.lit(True).alias("_set"))
    out = rows.join(new, list(key), "left")
    return out.select(*[F.when(F.col("_set"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else c for c in rows.columns])


def appended(stored: DataFrame, new: DataFrame, order: Sequence[Column | str], id_col: str = "id") -> DataFrame:
    """``stored`` and the rows of ``new`` under the next ids, in ``order``; columns that ``new`` lacks are null.

    ``new`` is what one save brings, a few rows.
    """
    last = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_last"))
    named = new.crossJoin(F.broadcast(last))  # a single row
    named = named.withColumn(id_col, F.col("_last") + F.row_number().over(W.orderBy(*order))).drop("_last")
    return stored.unionByName(named, allowMissingColumns=True)


def quick_list(instruments: DataFrame, text: str) -> DataFrame:
    """Favourites for an empty text, else matches of ticker or full name; by ticker."""
    found = matching(instruments, text, ("ticker", "full_name")) if text.strip() else instruments.where("is_favorite")
    return found.orderBy("ticker")


def page(rows: DataFrame, order: Sequence[Column | str], number: int, size: int = 20) -> DataFrame:
    """The ``number``-th page (from 0) of rows in ``order``, which must be total."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def with_flag(rows: DataFrame, known: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """``rows`` with whether their key occurs in ``known``."""
    marks = known.select(*key).distinct().withColumn(name, F.lit(True))
    return rows.join(marks, list(key), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def stacked(markers: DataFrame, day: str = "day", order: Sequence[str] = ("model_type", "id")) -> DataFrame:
    """``markers`` with stack, the number of markers before it on the same day, of all models."""
    rank = F.row_number().over(W.partitionBy(day).orderBy(*order)).cast("long") - 1
    return markers.withColumn("stack", rank)


def nearest_marker(markers: DataFrame, clicks: DataFrame, day: str = "day") -> DataFrame:
    """For each click (day, price) the id of the marker of that day nearest to its price; ties to the smaller id."""
    both = clicks.join(markers.select(day, "id", "y"), day, "left")
    return both.groupBy(day, "price").agg(F.min_by("id", F.struct(F.abs(F.col("y") - F.col("price")), F.col("id"))).alias("id"))
