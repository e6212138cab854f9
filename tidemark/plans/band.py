"""The band forecast: where price stands after the next leg or two, read from a pool of past pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import distance
from ..operators import ranks, zigzag
from ..operators.bars import between, logged, with_history
from ..operators.quantile import wide_weighted_quantiles
from ..sources.shared import written

RANKS = (*[f"rank_{f}" for f in ranks.FEATURES], "rank_leg_age")
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)


def ranked_pivots(bars: DataFrame, threshold: float, min_bars: int = 5) -> DataFrame:
    """Pivots of all tickers with the ranks of their confirming bar and of their leg's age.

    All of it looks back only, so pivots confirmed by some time are the same
    whether bars are cut there or not; and ranks may use history before a cut.
    """
    known = logged(with_history(bars))
    found = zigzag.leg_ranks(zigzag.pivots(known, threshold, min_bars))
    return zigzag.with_bar_ranks(found, ranks.bar_ranks(known))


def origin_of(found: DataFrame, target: str, m: int = 6) -> DataFrame:
    """The last pivot of ``target`` as one row, its fields with the prefix o_; none with fewer than m + 3 pivots or an unknown rank."""
    own = found.where(F.col("ticker") == target).withColumns({"_n": F.count("*").over(W.partitionBy("ticker")), "_query": F.reverse(F.collect_list("log_move").over(W.partitionBy("ticker").orderBy("seq").rowsBetween(1 - m, 0)))})
    last = own.orderBy(F.desc("seq")).limit(1).where(F.col("_n") >= m + 3)
    for r in RANKS:
        last = last.where(F.col(r).isNotNull())
    fields = ["confirm_begin", "extreme_begin", "log_price", "direction", *RANKS]
    return last.select(*[F.col(c).alias(f"o_{c}") for c in fields], F.col("_query").alias("o_query"))


def analogs(found: DataFrame, target: str, h: int, m: int = 6, theta: float = 0.0, lambdas: Mapping[str, float] | None = None) -> DataFrame:
    """The pool of ``target``'s last pivot, with weights: pivots of all tickers that were known then, of its direction.

    Weights fall with the squared differences of ranks (times ``lambdas``), and
    with the distance of the last ``m`` leg moves if ``theta`` is not 0. Fewer
    than m + 2 analogs make no pool: weights are null then.
    """
    origin = origin_of(found, target, m)
    known = found.crossJoin(F.broadcast(origin)).where(F.col("confirm_begin") <= F.col("o_confirm_begin"))  # a single row
    out = zigzag.pool(known, m, h, RANKS).where(F.col("direction") == F.col("o_direction"))
    exponent = F.lit(0.0)
    for name, weight in (lambdas or {}).items():
        exponent = exponent + F.lit(float(weight)) * F.pow(F.col(f"rank_{name}") - F.col(f"o_rank_{name}"), 2)
    out = out.withColumn("weight", F.exp(-exponent))
    out = out.withColumn("_d", distance("features", "o_query"))
    sums = out.agg(F.count("*").alias("pool_size"), F.avg("_d").alias("_mean"))
    out = out.crossJoin(F.broadcast(sums))  # a single row
    if theta:
        out = out.withColumn("weight", F.col("weight") * F.when(F.col("_mean") < 1e-14, 1.0).otherwise(F.exp(F.lit(-theta) * F.col("_d") / F.col("_mean"))))
    return out.withColumns({"weight": F.when(F.col("pool_size") >= m + 2, F.col("weight")), "h": F.lit(h)}).drop("_d", "_mean")


def forecast(found: DataFrame, target: str, m: int = 6, theta: float = 0.0, lambdas: Mapping[str, float] | None = None, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(h, pool_size, q, log_return, price) for h = 1 (the next leg) and 2 (there and back)."""
    pools = written(analogs(found, target, 1, m, theta, lambdas).unionByName(analogs(found, target, 2, m, theta, lambdas)), "pools")
    # a pool grows with the tickers, so no task sorts a whole one
    head = pools.groupBy("h").agg(*[F.first(c).alias(c) for c in ("pool_size", "o_log_price", "o_confirm_begin", "o_extreme_begin", "o_direction")])
    read = wide_weighted_quantiles(pools, "target", "weight", levels, ("h",), ties=("confirm_begin", "ticker")).join(head, "h")
    return read.select("h", "pool_size", F.col("o_confirm_begin").alias("origin"), F.col("o_extreme_begin").alias("origin_extreme"), F.col("o_direction").alias("direction"), "q", F.col("quantile").alias("log_return"), F.exp(F.col("o_log_price") + F.col("quantile")).alias("price"))


def zones(found: DataFrame, target: str, percents: Sequence[float] = (50, 75, 90), boundary: float = 70, trim: bool = True, m: int = 6) -> DataFrame:
    """(h, level, lo, hi, boundary): central price zones, and the one-sided boundary read from the second step's pool.

    ``trim`` keeps of the first step's zones what lies beyond the boundary.
    """
    ends = sorted({(100 + s * p) / 200 for p in (*percents, boundary) for s in (-1, 1)})
    read = forecast(found, target, m, levels=ends).select("h", "direction", F.round("q", 6).alias("q"), "price")
    at = lambda q, h=None: F.max(F.when((F.col("q") == round(q, 6)) & (F.lit(True) if h is None else F.col("h") == h), F.col("price")))
    limit = read.groupBy("direction").agg(at((100 - boundary) / 200, 2).alias("_down"), at((100 + boundary) / 200, 2).alias("_up"))
    limit = limit.select("direction", F.when(F.col("direction") > 0, F.col("_down")).otherwise(F.col("_up")).alias("boundary"))
    levels = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("level"), F.lit(round((100 - p) / 200, 6)).alias("ql"), F.lit(round((100 + p) / 200, 6)).alias("qh")) for p in percents])).alias("z")
    wide = read.groupBy("h", "direction").agg(F.map_from_entries(F.collect_list(F.struct("q", "price"))).alias("m")).select("*", levels)
    out = wide.select("h", "direction", F.col("z.level").alias("level"), F.element_at("m", F.col("z.ql")).alias("lo"), F.element_at("m", F.col("z.qh")).alias("hi")).join(limit, "direction")
    if trim:
        falls, first = F.col("direction") > 0, F.col("h") == 1
        out = out.withColumns({"lo": F.when(first & ~falls, F.greatest("lo", "boundary")).otherwise(F.col("lo")), "hi": F.when(first & falls, F.least("hi", "boundary")).otherwise(F.col("hi"))})
        out = out.where("lo < hi")
    return out.select("h", "level", "lo", "hi", "boundary")


def at_cutoff(bars: DataFrame, cutoff: str | None, threshold: float, min_bars: int = 5) -> DataFrame:
    """``ranked_pivots`` as they were known at ``cutoff``; ranks are taken before bars are cut."""
    found = ranked_pivots(bars, threshold, min_bars)
    enough = between(bars, until=cutoff).groupBy("ticker").agg(F.count("*").alias("_n")).where("_n >= 20").select("ticker")
    if cutoff:
        found = found.where(F.col("confirm_begin") <= F.to_timestamp(F.lit(cutoff)))
    return found.join(enough, "ticker", "left_semi")


def result_rows(read: DataFrame) -> DataFrame:
    """(h, pool_size, low, middle, high, down): the lowest, the middle and the highest price of each step, and whether it leads down."""
    prices = F.transform(F.sort_array(F.collect_list(F.struct("q", "price"))), lambda x: x["price"])
    out = read.groupBy("h", "pool_size", "direction").agg(prices.alias("_p"))
    down = F.when(F.col("h") == 1, F.col("direction") > 0).otherwise(F.col("direction") < 0)
    return out.select("h", "pool_size", F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.floor(F.size("_p") / 2).cast("int")).alias("middle"), F.get("_p", F.size("_p") - 1).alias("high"), down.alias("down"))
