"""Quality of documents: a Bradley-Terry ranking learned from preference pairs.

A text becomes a vector of its form: shares of kinds of characters, hashed
grams of their order, hashed words, and how much it repeats itself. The
preferred document of a pair has label 1, the other label 0; weights minimise
the logistic loss of the difference of their vectors. A score is cut at the
quantile above which there is as large a share of the labelled documents as
have label 1. Labelled rows are dealt into blocks, in which the pairs are
drawn; each step of the fit is one job over the blocks, whose tasks send sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantile import wide_quantiles
from . import common
from .common import gram_hashes, lowered, mix64, word_hashes

#: Rows of a block, about; pairs are drawn within blocks.
BLOCK = 512
#: Opponents that each document meets in its block.
ROUNDS = 16
#: Bins of the hashed grams of kinds of characters, and of the hashed words.
SHAPES, WORDS = 128, 128
#: Characters that are handled at once; bounds a task's memory.
PIECE = 1 << 20
#: Weight of the squared weights in the loss, for each pair.
RIDGE = 1e-3
STEPS = 12
#: Sums that come to the driver from a step of the fit.
MERGED = 8
#: Bits of the map of labelled ids for each of them, and in all (32 MB).
SPARSE, MOST_BITS = 16, 1 << 28

_KINDS = 6 + 33
_STATS = 10
SIZE = _KINDS + SHAPES + WORDS + _STATS
_kinds: np.ndarray | None = None


def _kind_of() -> np.ndarray:
    """A number for the kind of each code point: lower-case letter, other letter, digit, space, line feed, anything else, and each ASCII sign."""
    global _kinds
    if _kinds is None:
        kinds = np.full(0x110000, 5, dtype=np.uint8)
        for c in range(0x110000):
            x = chr(c)
            if x == "\n":
                kinds[c] = 4
            elif x.isspace():
                kinds[c] = 3
            elif x.isalpha():
                kinds[c] = 0 if x.islower() else 1
            elif x.isdigit():
                kinds[c] = 2
        signs = [c for c in range(33, 127) if not chr(c).isalnum()]
        kinds[signs] = 6 + np.arange(len(signs))
        _kinds = kinds
    return _kinds


def _form(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the kinds of characters, and of hashed grams of three kinds in a row, where a run of letters counts once."""
    kinds, shapes = np.zeros(_KINDS), np.zeros(SHAPES)
    before = np.empty(0, dtype=np.uint64)
    for at in range(0, len(text), PIECE):
        own = _kind_of()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        kinds += np.bincount(own, minlength=_KINDS)
        met = len(before)
        own = np.concatenate((before, own.astype(np.uint64)))
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (own[1:] > 2)
        new[:met] = True
        own = own[new]
        if len(own) > 2:
            with np.errstate(over="ignore"):
                grams = (own[:-2] * np.uint64(64) + own[1:-1]) * np.uint64(64) + own[2:]
            shapes += np.bincount((mix64(grams + np.uint64(1)) & np.uint64(SHAPES - 1)).astype(np.int64), minlength=SHAPES)
        before = own[-2:]
    return kinds, shapes


def features(text: str | None) -> np.ndarray:
    """The vector of a whole text; all zeros for none."""
    out = np.zeros(SIZE, dtype=np.float32)
    if not text:
        return out
    kinds, shapes = _form(text)
    data = lowered(text)
    words = word_hashes(data)
    n = len(words)
    bins = np.bincount((words & np.uint64(WORDS - 1)).astype(np.int64), minlength=WORDS)
    lines = text.split("\n")
    stats = np.zeros(_STATS)
    stats[:2] = np.log1p(len(text)), np.log1p(n)
    if n:
        _, often = np.unique(words, return_counts=True)
        stats[2:6] = len(data) / n, len(often) / n, len(often) / np.sqrt(n), often.max() / n
        stats[6] = len(np.unique(gram_hashes(words, 3))) / max(n - 2, 1)
        stats[7] = (words[1:] == words[:-1]).mean() if n > 1 else 0.0
    stats[8:] = len(set(lines)) / len(lines), np.log1p(len(text) / len(lines))
    parts = [np.log1p(1000 * c / max(c.sum(), 1)) for c in (kinds, shapes, bins)]
    return np.concatenate([*parts, stats]).astype(np.float32)


class Model:
    """Weights of standardised features, the cut, and the score where nothing was learned."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float = 0.0):
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def raw(self, vectors: np.ndarray) -> np.ndarray:
        # row by row and exactly rounded, so that a text has the same score in whatever batch it is
        return np.array([math.fsum(row) for row in (_standard(vectors, self.mean, self.scale) * self.weights).tolist()])

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """How likely a text is to win against one at the cut."""
        return np.array([1 / (1 + math.exp(-x)) for x in np.clip(self.raw(vectors) - self.cut, -30, 30).tolist()])


def _standard(vectors: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((vectors - mean) / scale, -8, 8)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "vector": [features(t).tobytes() for t in frame["text"]]})


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: its labels and vectors, label 1 first, in the order of a hash of the ids."""
    frame = frame.sort_values(["label", "place", "id"], ascending=[False, True, True])
    return pd.DataFrame({"block": frame["block"].iloc[:1], "ones": [int(frame["label"].sum())], "n": [len(frame)], "vectors": [b"".join(frame["vector"])]})


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, np.ndarray]]:
    for frame in frames:
        for block, ones, n, vectors in zip(frame["block"], frame["ones"], frame["n"], frame["vectors"], strict=True):
            yield block, ones, np.frombuffer(vectors, dtype=np.float32).reshape(n, SIZE).astype(float)


def _meetings(ones: int, zeros: int) -> np.ndarray:
    """How often each document of label 1 meets each of label 0: everyone of the larger side ``ROUNDS`` opponents, dealt in turn."""
    out = np.zeros((ones, zeros))
    if ones and zeros:
        large = np.arange(max(ones, zeros))
        for r in range(min(ROUNDS, min(ones, zeros))):
            small = (large + r * max(1, min(ones, zeros) // ROUNDS)) % min(ones, zeros)
            np.add.at(out, (large, small) if ones >= zeros else (small, large), 1.0)
    return out


def _step_of(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
    """Sums over a task's blocks: pairs, gradient and second derivative of the logistic loss of feature differences."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, pairs, gradients, seconds = None, 0.0, np.zeros(SIZE), np.zeros((SIZE, SIZE))
        for block, ones, vectors in _blocks(frames):
            z = _standard(vectors, mean, scale)
            s = z @ weights
            met = _meetings(ones, len(z) - ones)
            gap = s[:ones, None] - s[None, ones:]
            lost = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
            pull = met * lost
            gradients += z[ones:].T @ pull.sum(axis=0) - z[:ones].T @ pull.sum(axis=1)
            bend = pull * (1 - lost)
            cross = z[:ones].T @ bend @ z[ones:]
            seconds += (z[:ones].T * bend.sum(axis=1)) @ z[:ones] + (z[ones:].T * bend.sum(axis=0)) @ z[ones:] - cross - cross.T
            first, pairs = block if first is None else first, pairs + met.sum()
        if first is not None:
            yield pd.DataFrame({"block": [first], "pairs": [pairs], "gradient": [gradients.tobytes()], "second": [seconds.tobytes()]})

    return run


def _summed(parts: list, name: str, shape: tuple) -> np.ndarray:
    return np.sum([np.frombuffer(p[name]).reshape(shape) for p in parts], axis=0)


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over a task's blocks: documents, those of label 1, and vectors and their squares."""
    head, count, some, first, second = None, 0, 0, np.zeros(SIZE), np.zeros(SIZE)
    for block, ones, vectors in _blocks(frames):
        head, count, some = block if head is None else head, count + len(vectors), some + ones
        first, second = first + vectors.sum(axis=0), second + (vectors**2).sum(axis=0)
    if head is not None:
        yield pd.DataFrame({"block": [head], "ones": [some], "n": [count], "first": [first.tobytes()], "second": [second.tobytes()]})


def _merged(parts: DataFrame) -> list:
    """Rows of tasks, added up in ``MERGED`` groups before they come to the driver; binaries are vectors of doubles."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block", kind="stable")
        add = lambda c: np.sum([np.frombuffer(v) for v in frame[c]], axis=0).tobytes() if isinstance(frame[c].iloc[0], bytes) else frame[c].sum()
        return pd.DataFrame({c: [frame[c].iloc[0] if c == "block" else add(c)] for c in parts_columns})

    parts_columns = parts.columns
    return parts.groupBy(F.pmod("block", F.lit(MERGED))).applyInPandas(run, parts.schema).orderBy("block").collect()


def _raw_of(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, ones, vectors in _blocks(frames):
            yield pd.DataFrame({"label": (np.arange(len(vectors)) < ones).astype(int), "raw": model.raw(vectors)})

    return run


def fit(blocks: DataFrame) -> Model:
    """Newton's method on the pairs of all blocks; what comes to the driver are ``MERGED`` sums at most."""
    sums = _merged(blocks.mapInPandas(_moments, "block long, ones long, n long, first binary, second binary"))
    n = sum(r["n"] for r in sums)
    mean = _summed(sums, "first", (SIZE,)) / max(n, 1)
    spread = np.sqrt(np.maximum(_summed(sums, "second", (SIZE,)) / max(n, 1) - mean**2, 0)) if sums else np.zeros(SIZE)
    scale = np.maximum(spread, 0.05)
    weights, ones = np.zeros(SIZE), sum(r["ones"] for r in sums)
    if not sums or ones in (0, n):  # no pair: every text has the share of label 1
        return Model(np.zeros(SIZE), np.ones(SIZE), weights, float(np.log((n - ones + 1) / (ones + 1))))
    for _ in range(STEPS):
        parts = _merged(blocks.mapInPandas(_step_of(mean, scale, weights), "block long, pairs double, gradient binary, second binary"))
        pairs = max(sum(p["pairs"] for p in parts), 1.0)
        gradient = _summed(parts, "gradient", (SIZE,)) / pairs + RIDGE * weights
        second = _summed(parts, "second", (SIZE, SIZE)) / pairs + RIDGE * np.eye(SIZE)
        move = np.linalg.solve(second, gradient)
        weights = weights - move * min(1.0, 20 / max(np.linalg.norm(move), 1e-12))
        if np.abs(move).max() < 1e-3:
            break
    return Model(mean, scale, weights)


def _among(rows: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    """``rows`` whose id may be one of the ``count`` in ``keys``: all that are, and about one in ``SPARSE`` of the others.

    The bits of hashed ids are broadcast in pieces, so that rows without a label
    are not shuffled. More ids than the map has room for let more others through.
    """
    place = F.pmod(F.xxhash64(F.lit("among"), "id"), F.lit(min(max(SPARSE * count, 1), MOST_BITS))) + 1
    piece, at = F.bitmap_bucket_number(place).alias("_piece"), F.bitmap_bit_position(place)
    maps = keys.select(piece, at.alias("_at")).groupBy("_piece").agg(F.bitmap_construct_agg("_at").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.select("*", piece, at.alias("_at")).join(F.broadcast(maps), "_piece")
    return met.where(byte.bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0).select(*rows.columns)


def train(docs: DataFrame, labels: DataFrame, max_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from the documents whose ids have a label, 0 or 1.

    All of them count, for the weights and for the cut. ``max_rows`` may bound
    them: half for each label, the first in the order of a hash of the id, or
    all if there are fewer. An id
    whose labels disagree counts for the more frequent one, and not at all if
    they are even; documents that share an id count once, by the smallest text.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label in (0, 1)")
    marks = marks.groupBy("id").agg(F.avg("label").alias("share")).where("share <> 0.5").select("id", (F.col("share") > 0.5).cast("int").alias("label"), F.xxhash64(F.lit("quality"), "id").alias("place"))
    known = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    marks, marks_at = common.written(marks.join(known, "id", "left_semi"), "marks")
    shares = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    chosen, chosen_at, count = marks, [], sum(shares.values())
    if max_rows is not None:
        half = max_rows // 2
        chosen = marks.where("label = 1").orderBy("place", "id").limit(half).unionByName(marks.where("label = 0").orderBy("place", "id").limit(half))  # max_rows at most
        chosen, at = common.written(chosen, "chosen")
        chosen_at, count = [at], sum(min(half, n) for n in shares.values())
    texts = _among(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), chosen, count).join(chosen.select("id", "label"), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = texts.mapInPandas(_packed, "id long, label int, vector binary")
    many = -(-count // BLOCK) or 1
    dealt = rows.withColumn("place", F.xxhash64(F.lit("block"), "id")).withColumn("block", F.pmod("place", F.lit(many)))
    blocks, blocks_at = common.written(dealt.groupBy("block").applyInPandas(_block, "block long, ones int, n int, vectors binary"), "blocks")
    model = fit(blocks)
    if model.weights.any():
        raw = blocks.mapInPandas(_raw_of(model), "label int, raw double")
        if max_rows is None:
            model.cut = whole_cut(raw, shares)
        else:
            raw = raw.toPandas()  # two numbers for each of max_rows
            model.cut = cut_of(raw["raw"].to_numpy(), raw["label"].to_numpy(), shares)
    common.remove(spark, marks_at, *chosen_at, blocks_at)
    return model


def whole_cut(raw: DataFrame, shares: dict[int, int]) -> float:
    """``cut_of`` the scores of all labelled documents, which no task holds: the middle of the last score of the share of label 0 and the next."""
    n, zeros = sum(shares.values()), shares.get(0, 0)
    at = min(max(zeros - 0.5, 0.5), n - 1.5) if n > 1 else 0.0
    return float(wide_quantiles(raw, "raw", [at / max(n - 1, 1)]).first()["quantile"])


def cut_of(raw: np.ndarray, label: np.ndarray, shares: dict[int, int]) -> float:
    """The quantile of the scores below which the share of all is nearest to that of label 0; the middle between the two scores next to it.

    Each label's scores stand for all documents of that label.
    """
    order = np.argsort(raw, kind="stable")
    each = np.array([shares.get(k, 0) / max((label == k).sum(), 1) for k in (0, 1)])
    below = np.cumsum(each[label[order]])
    at = min(int(np.argmin(np.abs(below - shares.get(0, 0)))) + 1, len(order) - 1)
    return float(raw[order[at - 1 : at + 1]].mean())


def is_held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rank(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5 on); learned from labels that are not held out.

    Null and empty texts have the score of a vector of zeros. Labels that are
    null or neither 0 nor 1, or have no document, are not learned from; where
    only one label is left, or none, every text has the same score. Repeated
    rows have equal scores. Columns of ``docs`` with the three names are
    replaced, all others stay. No rows, no rows.
    """
    model = train(docs, labels.where(~is_held_out(id_col)), id_col=id_col, text_col=text_col, label_col=label_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = np.array([features(t) for t in texts]).reshape(-1, SIZE)
            yield pd.Series(shared.value.scores(vectors))

    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = docs.select(F.struct(*kept).alias("doc"), is_held_out(id_col).alias("held_out"), score(text_col).alias("score"))
    return out.select("doc.*", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
