"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the mix by its weight, held to ``max_epochs`` times
its own size. A source is read in a fixed pseudo-random order of its documents,
as often as its target asks; the last, partial pass ends at the target. How
fast a source is read over the training time from 0 to 1 follows its weight
schedule: the schedule's integral is the source's cumulative demand, and the
inverse of that integral turns the place of a document on the source's line of
words into the training position at which it is due. A range sort by position
gives the training order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, join_by_size, remove, row_key, written
from .sharding import prefix_sums

#: (time, relative weight) knots; between them the weight is linear in time.
Schedule = Sequence[tuple[float, float]]


def default_schedule(kind: int) -> Schedule:
    """Light sources early, heavy ones late, each with a mean weight of 1."""
    return [((0.0, 1.4), (1.0, 0.6)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.6), (1.0, 1.4))][kind % 3]


def due(share: Column, schedule: Schedule) -> Column:
    """The time at which ``share`` (0 to 1) of a source's demand has accumulated."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(area), 0.0, None
    for (t0, w0), (t1, w1), own in zip(schedule, schedule[1:], area, strict=False):
        if not own:
            continue
        slope = (w1 - w0) / (t1 - t0)
        left = F.greatest(share * whole - before, F.lit(0.0))
        time = F.lit(t0) + F.least(2 * left / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * left, F.lit(0.0)))), F.lit(t1 - t0))
        time = F.when(left == 0, F.lit(t0)).otherwise(time)
        out = time if out is None else F.when(share * whole <= before, out).otherwise(time)
        before += own
    return out


def demand(time: Column, schedule: Schedule) -> Column:
    """The share (0 to 1) of a source's demand that has accumulated at ``time``: the integral of its schedule."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    out = F.lit(0.0)
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        inside = F.greatest(F.least(time, F.lit(t1)) - t0, F.lit(0.0))
        out = out + inside * (w0 + inside * ((w1 - w0) / (t1 - t0) / 2))
    return F.when(time >= schedule[-1][0], F.lit(1.0)).otherwise(out / sum(area))


def targets(sized: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(source, rows, kind, source_size, target): one row for each source, written.

    Sources by code point, null last, take the weights in turn. Shares by weight
    above ``max_epochs`` sizes are held there and the excess is shared again.
    With sources in order of size / weight, the held ones come first, so running
    sums find the level that the others share. Sources may be many: both orders
    are range-partitioned.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).withColumn("none", F.col("source").isNull())
    kind = F.col("place") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (kind + 1).cast("int"))
    sources = prefix_sums(sources, ["none", "source"]).select("source", "source_size", "rows", F.col("place").alias("number"), kind.alias("kind"), weight.alias("weight"))
    sources = sources.withColumn("ratio", F.col("source_size") / F.col("weight"))
    sources = prefix_sums(sources, ["ratio", "number"], "source_size", "weight")
    level = (F.col("total_source_size") - max_epochs * F.col("before_source_size")).cast("double") / (F.col("total_weight") - F.col("before_weight"))
    fits = level * F.col("weight") <= max_epochs * F.col("source_size")
    shared = sources.agg(F.min(F.when(fits, F.struct("place", level.alias("level"))))["level"].alias("level"))
    target = F.least(F.col("level") * F.col("weight"), (max_epochs * F.col("source_size")).cast("double"))
    return sources.crossJoin(F.broadcast(shared)).select("source", "rows", "kind", "source_size", target.alias("target"))  # a single row


def plan(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    max_epochs: int = 3,
    schedule: Callable[[int], Schedule] = default_schedule,
    seed: str = "mix",
    bucket_rows: int = 5_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: id, source, row, size, source_size, target, taken, copies, before, kind, first_position.

    ``row`` names the row by id, source and text. A pass over a source takes its
    rows by a keyed hash of id and text; ``before`` is a row's first word's place
    in the pass. The row's words in pass number p lie on the source's line of
    words from p * source_size + before on; inverting the demand gives the times
    at which the first and the next word after them are due. ``taken`` is the
    demand between these times, within the training time, over all passes.
    ``copies`` is how often the row is read, the last time perhaps in part, and
    ``first_position`` when for the first time. A null text has size 0 and takes
    no words. Null sources are one source. Rows with equal ids keep apart as
    rows, rows that repeat follow each other. No rows give no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rank = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), text_of(id_col), F.lit(":"), text_of(text_col))), 1, 15), 16, 10).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), row_key(id_col, source_col, text_col).alias("row"), size.alias("size"), rank.alias("rank"))
    sized, sized_at = written(sized, "sizes")
    total = sized.count()
    aims = targets(sized, weights, max_epochs)
    # a source's line is cut into buckets of its order, as many as its rows need, so no task holds a whole source
    aims = aims.withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")), "cut": 60 - F.ceil(F.log2(F.greatest(F.col("rows") / bucket_rows, F.lit(1.0)))).cast("int")}).drop("source")
    # rows that repeat are one until the end
    rows = sized.groupBy(*sized.columns).agg(F.count("*").alias("times")).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    rows = join_by_size(rows, aims, "key", "rows", total).withColumn("bucket", F.expr("shiftright(rank, cut)"))
    totals = rows.groupBy("key", "bucket").agg(F.sum(F.col("size") * F.col("times")).alias("sum"))
    totals = totals.withColumn("start", F.sum("sum").over(W.partitionBy("key").orderBy("bucket")) - F.col("sum")).drop("sum")
    inside = W.partitionBy("key", "bucket").orderBy("rank", "id", "row", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(F.col("size") * F.col("times")).over(inside)).join(totals, ["key", "bucket"])
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    rows = rows.withColumn("before", F.col("start") + F.col("upto") - F.col("nth") * F.col("size"))
    # step by step, as columns: places on the line, times when they are due, demand at these times
    edges = {f"{side}_{p}": p * F.col("source_size") + F.col("before") + (F.col("size") if side == "end" else 0) for p in range(max_epochs) for side in ("begin", "end")}
    rows = rows.withColumns({c: _share(at) for c, at in edges.items()})
    rows = rows.withColumns({c: _by_kind(lambda k, c=c: due(F.col(c), schedule(k)), len(weights)) for c in edges}).withColumn("first_position", F.col("begin_0"))
    rows = rows.withColumns({c: F.round(_by_kind(lambda k, c=c: demand(F.col(c), schedule(k)), len(weights)) * F.col("target")).cast("long") for c in edges})
    own = [F.when((F.col("size") > 0) & (F.col("target") > 0), F.col(f"end_{p}") - F.col(f"begin_{p}")).otherwise(0) for p in range(max_epochs)]
    taken, copies = sum(own[1:], own[0]), sum((F.when(2 * x > F.col("size"), 1).otherwise(0) for x in own), F.lit(0))
    out = rows.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "row", "size", "source_size", "target",
        taken.cast("long").alias("taken"), copies.cast("long").alias("copies"), "before", "kind", "first_position",
    )
    out, _ = written(out, "plan")
    remove(spark, sized_at)
    return out


def _share(place: Column) -> Column:
    """The share of its source's demand that lies before a word's place on the line of ``target`` words."""
    return F.when(F.col("target") > 0, F.least(place / F.col("target"), F.lit(1.0))).otherwise(F.lit(1.0))


def _by_kind(value: Callable[[int], Column], kinds: int) -> Column:
    out = F.lit(None).cast("double")
    for kind in range(kinds):
        out = F.when(F.col("kind") == kind, value(kind)).otherwise(out)
    return out


def ordered_plan(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``plan`` with ``training_place``: the row's place, from 0, among all first readings in training order.

    Rows are range-sorted by position; those due at one time follow by size of
    ``before``, id (nulls first) and row, those without a reading come last.
    """
    found = plan(docs, id_col=id_col, **options)
    return prefix_sums(found, ["first_position", "before", id_col, "row"]).withColumnRenamed("place", "training_place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedule: Callable[[int], Schedule] = default_schedule, weights: Sequence[float] = (1, 2, 3), **options) -> DataFrame:
    """``docs`` in training order: every row as often as the plan reads it, whole.

    A row that the target cuts is read once more if more than half of it is due.
    Columns are those of ``docs``. Of rows that repeat in id, source and text,
    each is read as often as its own plan says, with the other columns of one of them.
    """
    plans = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, schedule=schedule, weights=weights, **options)
    read = plans.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = _share(F.col("copy") * F.col("source_size") + F.col("before"))
    read = read.withColumn("position", _by_kind(lambda k: due(at, schedule(k)), len(weights)))
    read = read.select("row", F.struct("position", "before", "copy").alias("mix_due"))
    # a row goes as one value, so its columns may have any names; repeated rows are cut down before they are shuffled
    named = docs.select(F.struct(*docs.columns).alias("doc"), row_key(id_col, source_col, text_col).alias("row"))
    once = named.withColumn("nth", F.row_number().over(W.partitionBy("row").orderBy("row"))).where("nth = 1").drop("nth")
    out = once.join(read.hint("merge"), "row")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("mix_due.position"), F.col("mix_due.before"), F.col("row"), F.col("mix_due.copy")]
    return out.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc.*")
