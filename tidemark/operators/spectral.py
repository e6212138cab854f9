"""Short-time spectra of ratio steps, and a cascade of low-pass filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .recurrence import System, chain, run
from .window import BY, Names, series

#: Fewer values than this give no spectrum.
LEAST = 32


def spectrogram(steps: DataFrame, length: int = 64, overlap: float = 75.0, fmin: float = 0.0, fmax: float = 0.5, value: str = "dratio", by: Names = BY, order: str = "begin") -> DataFrame:
    """(series, segment, time, freq, db) of overlapping segments of ``length`` values.

    A segment's mean is removed and a periodic Hann window applied; the one-sided
    power density is given in decibels, its time is the bar at the segment's
    middle. Null values are left out first. Series with fewer than 32 values or
    than ``length`` have no rows. An empty band from fmin to fmax means all.
    """
    step = length - min(int(length * overlap / 100), length - 1)
    low, high = (fmin, fmax) if fmin < fmax else (0.0, 0.5)
    known = steps.where(F.col(value).isNotNull()).select(*by, order, value)
    placed = known.withColumn("_i", F.row_number().over(series(by, order)) - 1)
    # a value goes to the segments that hold it; a segment has its first value's place over the step
    first = F.greatest(F.ceil((F.col("_i") - (length - 1)) / step), F.lit(0))
    dealt = placed.select(*by, F.col(value).alias("_v"), F.col(order).alias("_o"), F.col("_i"), F.explode(F.sequence(first, F.floor(F.col("_i") / step))).alias("segment"))
    held = dealt.groupBy(*by, "segment").agg(F.sort_array(F.collect_list(F.struct("_i", "_v", "_o"))).alias("_s")).where(F.size("_s") == length)
    segments = held.select(*by, "segment", F.transform("_s", lambda s: s["_v"]).alias("_x"), F.transform("_s", lambda s: s["_o"]).alias("_t"))
    if length < LEAST:
        segments = segments.join(placed.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST).drop("_n"), list(by))
    freqs = [k / length for k in range(length // 2 + 1)]
    kept = [k for k, f in enumerate(freqs) if low <= f <= high]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    sides = np.array([1.0 if k == 0 or 2 * k == length else 2.0 for k in range(length // 2 + 1)])

    def spectra(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fast transforms of many segments at once."""
        for frame in frames:
            out = frame.drop(columns="_x")
            if len(frame):
                x = np.stack(frame["_x"].to_list())
                power = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * hann, axis=1)) ** 2 / (hann @ hann) * sides
                out["_db"] = list(10.0 * np.log10(power[:, kept] + 1e-20))
            else:
                out["_db"] = []
            yield out

    placed = segments.select(*by, F.col("segment").cast("long").alias("segment"), F.get("_t", F.lit(length // 2)).alias("time"), "_x")
    schema = T.StructType([*[f for f in placed.schema if f.name != "_x"], T.StructField("_db", T.ArrayType(T.DoubleType()))])
    table = F.array(*[F.lit(freqs[k]) for k in kept]).cast("array<double>")
    out = placed.mapInPandas(spectra, schema).select(*by, "segment", "time", F.explode(F.arrays_zip(table.alias("freq"), F.col("_db").alias("db"))).alias("w"))
    return out.select(*by, "segment", "time", "w.freq", "w.db")


#: Cut-offs of the cascade as shares of the Nyquist frequency, and the order of its filters.
CUTOFFS = (0.25, 0.125, 0.0625, 0.03125, 0.015625)
ORDER = 4


def butterworth(cutoff: float, order: int = ORDER) -> list[tuple[float, ...]]:
    """Second-order sections (b0, b1, b2, a1, a2) of a digital Butterworth low-pass filter of even ``order``.

    Poles of the analog filter lie evenly on a half circle; the bilinear
    transform, with the cut-off pre-warped, takes each pair to one section.
    """
    warped = math.tan(math.pi * cutoff / 2)
    sections = []
    for k in range(order // 2):
        damping = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + damping * warped + warped * warped
        b0 = warped * warped / a0
        sections.append((b0, 2 * b0, b0, 2 * (warped * warped - 1) / a0, (1 - damping * warped + warped * warped) / a0))
    return sections


def section(b0: float, b1: float, b2: float, a1: float, a2: float) -> System:
    """A second-order section as a recurrence of two states."""
    return System([[-a1, 1.0], [-a2, 0.0]], [b1 - a1 * b0, b2 - a2 * b0], [[1.0, 0.0]], [b0])


@cache
def bank(cutoffs: tuple[float, ...] = CUTOFFS) -> System:
    """The cascade as one recurrence: its outputs are what each low-pass leaves, slower and slower."""
    whole = chain([section(*s) for cutoff in cutoffs for s in butterworth(cutoff)])
    each = ORDER // 2
    return System(whole.a, whole.b, whole.c[each - 1 :: each], whole.d[each - 1 :: each])


def components(x: np.ndarray) -> np.ndarray:
    """Components of a series, quickest first: what each low-pass takes away of what the one before left, and the rest."""
    left, _ = bank().run(np.asarray(x, dtype=float))
    return np.vstack([np.vstack([x, left[:-1]]) - left, left[-1:]])


def filter_bank(steps: DataFrame, value: str = "dratio", by: Names = BY, order: str = "begin", chunk: int | None = None, keep: Names = ()) -> DataFrame:
    """(series, begin, comp_0 ... comp_5): the components of each series' known values; with ``chunk``, long series are cut for many tasks.

    ``keep`` names columns that go along.
    """
    known = steps.where(F.col(value).isNotNull()).select(*by, order, *keep, value)
    names = [f"_left_{k}" for k in range(len(CUTOFFS))]
    # the input goes along as an output of its own
    system = bank()
    through = System(system.a, system.b, np.vstack([np.zeros(len(system.a)), system.c]), np.r_[1.0, system.d])
    found = run(known, through, value, ["_left", *names], by, order, chunk, keep)
    left = ["_left", *names]
    parts = [(F.col(a) - F.col(b)).alias(f"comp_{k}") for k, (a, b) in enumerate(zip(left, left[1:], strict=False))]
    return found.select(*by, order, *keep, *parts, F.col(left[-1]).alias(f"comp_{len(CUTOFFS)}"))


def pair_lags(cutoffs: tuple[float, ...] = CUTOFFS) -> list[tuple[int, int, int]]:
    """For each component the lags 0, a quarter and a half of its shortest period."""
    periods = [2.0, *[2.0 / c for c in cutoffs]]
    return [(0, *[max(1, round(t / d)) for d in (4.0, 2.0)]) for t in periods]
