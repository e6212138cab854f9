"""Linear recurrences over series of any length: s' = A s + B x, with outputs C s + D x.

A stretch of a series moves the state by an affine map: s -> A^m s + f, where f
is what the stretch leaves of a state of zero. So long series are cut into
chunks: every chunk finds its f, the maps of a series are composed in order (a
row for each chunk), and every chunk runs again from the state it starts with.
Within a chunk, blocks of ``BLOCK`` values are products with constant matrices.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .window import BY, Names, numbered

BLOCK = 64


class System:
    """A linear system with one input; ``B`` is a vector, ``C`` has a row and ``D`` an entry for each output."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray):
        self.a, self.b, self.c, self.d = (np.asarray(x, dtype=float) for x in (a, b, c, d))
        powers = [np.eye(len(self.a))]
        for _ in range(BLOCK):
            powers.append(self.a @ powers[-1])
        self.whole = powers[-1]
        # a block's end state from its values, and its outputs from its first state and from its values
        self.ends = np.array([powers[BLOCK - 1 - j] @ self.b for j in range(BLOCK)])
        self.free = np.array([self.c @ powers[j] for j in range(BLOCK)])
        pulse = [self.d, *[self.c @ powers[j] @ self.b for j in range(BLOCK - 1)]]
        self.forced = np.zeros((BLOCK, BLOCK, len(self.d)))
        for j in range(BLOCK):
            for i in range(j, BLOCK):
                self.forced[j, i] = pulse[i - j]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, one row for each; the state after the last value); not a number from the first such value on."""
        state = np.zeros(len(self.a)) if state is None else np.asarray(state, dtype=float)
        unknown = np.flatnonzero(np.isnan(x))
        if len(unknown):  # not within the products below, where it would reach back to its block's start
            known, _ = self.run(x[: unknown[0]], state)
            return np.hstack([known, np.full((len(self.d), len(x) - unknown[0]), np.nan)]), np.full(len(self.a), np.nan)
        n, k = len(x), len(x) // BLOCK
        blocks = np.asarray(x[: k * BLOCK], dtype=float).reshape(k, BLOCK)
        pushed = blocks @ self.ends
        states = np.empty((k, len(self.a)))
        for j in range(k):
            states[j] = state
            state = self.whole @ state + pushed[j]
        out = np.einsum("kj,jio->kio", blocks, self.forced, optimize=True) + np.einsum("ks,ios->kio", states, self.free, optimize=True)
        rest = np.empty((n - k * BLOCK, len(self.d)))
        for j, v in enumerate(x[k * BLOCK :]):
            rest[j] = self.c @ state + self.d * v
            state = self.a @ state + self.b * v
        return np.concatenate((out.reshape(k * BLOCK, len(self.d)), rest)).T, state

    def after(self, x: np.ndarray) -> np.ndarray:
        """What values leave of a state of zero."""
        return self.run(x)[1]

    def carried(self, state: np.ndarray, m: int) -> np.ndarray:
        """A state after ``m`` values of zero."""
        return np.linalg.matrix_power(self.a, m) @ state


def chain(parts: Sequence[System]) -> System:
    """Systems in a row: the first output of each is the input of the next; all outputs of all of them are put out."""
    size = sum(len(p.a) for p in parts)
    a, b = np.zeros((size, size)), np.zeros(size)
    rows, passed = [], []
    from_state, from_input, at = np.zeros(size), 1.0, 0  # the input of the next system
    for p in parts:
        k = len(p.a)
        own = slice(at, at + k)
        a[own, own] += p.a
        a[own] += np.outer(p.b, from_state)
        b[own] = p.b * from_input
        for c, d in zip(p.c, p.d, strict=True):
            row = d * from_state
            row[own] += c
            rows.append(row)
            passed.append(d * from_input)
        first = len(rows) - len(p.d)
        from_state, from_input, at = rows[first], passed[first], at + k
    return System(a, b, np.array(rows), np.array(passed))


def run(rows: DataFrame, system: System, value: str, names: Sequence[str], by: Names = BY, order: str = "begin", chunk: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(by, order, keep, names): the outputs at each row, from a state of zero; null from the first null value of a series on.

    A series is one group of a grouped map, or, with ``chunk``, groups of so many
    rows; the results are the same. Then values are read twice, and no task
    holds more than a chunk and the list of a series' chunks. ``keep`` names columns
    that go along; a place ``i`` among them is not counted again.
    """
    keys = [*by, order, *keep]
    schema = T.StructType([*[rows.schema[c] for c in keys], *[T.StructField(n, T.DoubleType()) for n in names]])

    def outputs(frame: pd.DataFrame, state: np.ndarray | None) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        found, _ = system.run(frame[value].to_numpy(dtype=float), state)
        out = frame[keys].reset_index(drop=True)
        for name, values in zip(names, found, strict=True):
            out[name] = pd.array(values, dtype="Float64") if not np.isnan(values).any() else [None if np.isnan(v) else v for v in values]
        return out

    if chunk is None:
        return rows.select(*keys, value).groupBy(*by).applyInPandas(lambda frame: outputs(frame, None), schema)

    part = (*by, "_chunk")
    placed = rows.select(*keys, value) if "i" in keep else numbered(rows.select(*keys, value), by, order)
    placed = placed.withColumn("_chunk", F.floor(F.col("i") / chunk)).select(*keys, value, "_chunk")
    heads = [rows.schema[c] for c in by]
    number, state_of = T.StructField("_chunk", T.LongType()), T.StructField("_state", T.ArrayType(T.DoubleType()))

    def left(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        return frame[[*part]].head(1).assign(_rows=len(frame), _state=[system.after(frame[value].to_numpy(dtype=float))])

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, out = frame.sort_values("_chunk"), np.zeros(len(system.a)), []
        for m, pushed in zip(frame["_rows"], frame["_state"], strict=True):
            out.append(state)
            state = system.carried(state, int(m)) + np.array([np.nan if v is None else v for v in pushed], dtype=float)
        return frame[[*part]].assign(_state=out)

    ends = placed.groupBy(*part).applyInPandas(left, T.StructType([*heads, number, T.StructField("_rows", T.LongType()), state_of]))
    starts = ends.groupBy(*by).applyInPandas(composed, T.StructType([*heads, number, state_of]))
    starts = starts.select(*[F.col(c).alias(f"_s{c}") for c in starts.columns])  # Spark takes the same columns on both sides for one
    both = placed.groupBy(*part).cogroup(starts.groupBy(*[f"_s{c}" for c in part]))
    return both.applyInPandas(lambda frame, start: outputs(frame, np.array([np.nan if v is None else v for v in start["_s_state"].iloc[0]], dtype=float)), schema)
