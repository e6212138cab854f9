"""Scalar functions as columns: kernels, losses, rounding, vectors, uniform draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int = 6) -> Column:
    """``x`` to so many decimals, never minus zero."""
    return F.round(_col(x), digits) + F.lit(0.0)


def log(x: Column | str) -> Column:
    """The natural logarithm as SQL has it: minus infinity of 0, NaN below."""
    x = _col(x)
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def quotient(a: Column | str, b: Column | str) -> Column:
    """``a`` / ``b`` of doubles; a division by 0 gives an infinity, or NaN of 0 / 0."""
    a, b = _col(a), _col(b)
    return F.when(b != 0, a / b).when(b.isNotNull() & a.isNotNull(), F.when((a == 0) | F.isnan(a), float("nan")).otherwise(F.signum(a) * float("inf")))


def half_up(x: Column | str) -> Column:
    """The nearest whole number; halves go up, also below zero."""
    return F.floor(_col(x) + 0.5)


def to_step(price: Column | str, step: Column | str) -> Column:
    """``price`` at the nearest multiple of ``step``; as it is if the step is null or not positive."""
    price, step = _col(price), _col(step)
    return F.when(step > 0, half_up(price / step) * step).otherwise(price)


def pinball(actual: Column | str, predicted: Column | str, tau: Column | float) -> Column:
    """Quantile loss of a prediction of the ``tau`` quantile."""
    miss = _col(actual) - _col(predicted)
    tau = F.lit(tau)
    return F.greatest(tau * miss, (tau - 1) * miss)


def buy_share(high: Column | str = "high", low: Column | str = "low", close: Column | str = "close") -> Column:
    """Where the close lies between low and high, from 0 to 1; a half for a flat bar."""
    high, low, close = _col(high), _col(low), _col(close)
    return F.when(high > low, (close - low) / (high - low)).otherwise(0.5)


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(_col(x), F.lit(high)), F.lit(low))


def lerp(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The straight line through two points at ``x``; ``y0`` where the points coincide."""
    return F.when(x1 == x0, y0).otherwise(y0 + (x - x0) / (x1 - x0) * (y1 - y0))


def ramp(t: Column | str, shift: float, steepness: float) -> Column:
    """A hyperbolic tangent through ``shift``, scaled so that 0 gives 0 and 1 gives 1."""
    t = _col(t)
    at = lambda x: F.tanh(F.lit(steepness) * (x - F.lit(shift)))
    low, high = at(F.lit(0.0)), at(F.lit(1.0))
    width = F.when(F.abs(high - low) > 1e-12, high - low).otherwise(1.0)
    return clamp((at(t) - low) / width, 0.0, 1.0)


def total(values: Column) -> Column:
    """The sum of an array of doubles, in order."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(_col(a), lambda x: x * x)))


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))))


def exponential_kernel(d: Column | str, mean: Column | str, theta: float) -> Column:
    return F.exp(-F.lit(theta) * _col(d) / _col(mean))


def gaussian_kernel(d: Column | str, width: Column | str) -> Column:
    scaled = _col(d) / _col(width)
    return F.exp(F.lit(-0.5) * scaled * scaled)


def student_kernel(d: Column | str, width: Column | str, freedom: float = 1.0) -> Column:
    scaled = _col(d) / _col(width)
    return F.pow(1.0 + scaled * scaled / freedom, F.lit(-(freedom + 1.0) / 2.0))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that ``parts`` alone decide: 32 bits of the MD5 of their texts joined by colons."""
    text = reduce(lambda a, b: F.concat(a, F.lit(":"), b), [p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: Seconds of a bar of each interval; a month counts as thirty days.
INTERVAL_SECONDS = {"1m": 60, "10m": 600, "1h": 3600, "1d": 86400, "1w": 604800, "1mo": 2592000}


def seconds_of(time: Column | str) -> Column:
    """Whole seconds since 1970 of a time stamp, with or without a time zone (then UTC)."""
    return F.unix_seconds(_col(time).cast("timestamp"))


def steps_after(begin: Column | str, steps: Column | int, seconds: int) -> Column:
    """The time stamp ``steps`` bars of ``seconds`` after the day of ``begin``."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    return F.timestamp_seconds(seconds_of(F.date_trunc("day", _col(begin))) + steps.cast("long") * seconds)
