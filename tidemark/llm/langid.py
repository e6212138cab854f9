"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, runs of anything else become one space, and 1- to
3-grams are hashed into ``BUCKETS`` bins. Training sums bin counts per language
on Spark; the matrix of log-probabilities (languages x bins) is broadcast, and
tasks score their rows in numpy, whole texts, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Characters that are handled at once; bounds a task's memory, whatever a text's length.
PIECE = 400_000
#: The broadcast matrix may have so many bytes at most.
MODEL_BYTES = 256 << 20
#: Cells of grams x languages that are added up at once.
_CELLS = 1 << 23
#: Sharpnesses of the confidence that training tries.
SHARPNESS = [float(x) for x in 2 ** np.arange(-3, 7.25, 0.25)]
#: The least confidence in a language that is certain: it must be nine times as likely as all others together.
CERTAIN = 0.9

_kinds: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else a space; 0, which parts texts, stays."""
    global _kinds
    if _kinds is None:
        _kinds = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                _kinds[c] = c
        _kinds[0] = 0
    return _kinds


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _bins(codes: np.ndarray, part: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bin, part) of every gram of ``codes``, one space for runs of them; grams within the first ``known`` codes were met before."""
    bins, owners = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        whole = np.ones(m, dtype=bool)
        whole[: max(0, known - n + 1)] = False
        for i in range(n):
            c = codes[i : i + m]
            with np.errstate(over="ignore"):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c
            whole &= c != 0
        if n == 1:
            whole &= codes != 32
        bins.append((mix64(h[whole]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(part[:m][whole])
    if not bins:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(bins), np.concatenate(owners)


def _collapsed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces, with the number of text ends (code 0) up to each."""
    part = np.cumsum(codes == 0)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep].astype(np.uint64), part[keep]


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram bins, row of each gram) for pieces of the texts; grams never span two texts.

    Texts longer than a piece are taken piece by piece; the last codes of one
    lead the next, so that all grams across a cut are met too.
    """

    def grams(parts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        bins, part = _bins(*_collapsed(_letters()[_codes("\0".join(parts))]))
        return bins, np.array(rows)[part]

    parts, rows, held = [], [], 0
    for row, text in enumerate(texts):
        text = (text or "").lower().replace("\0", " ")
        if len(text) > PIECE:
            before = np.empty(0, dtype=np.uint32)
            for at in range(0, len(text), PIECE):
                codes, part = _collapsed(np.concatenate((before, _letters()[_codes(text[at : at + PIECE])])))
                bins, _ = _bins(codes, part, len(before))
                yield bins, np.full(len(bins), row)
                before = codes[1 - max(ORDERS) :].astype(np.uint32)
            continue
        parts.append(text)
        rows.append(row)
        held += len(text)
        if held >= PIECE:
            yield grams(parts, rows)
            parts, rows, held = [], [], 0
    if parts:
        yield grams(parts, rows)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, texts in frame.groupby("lang")["text"]:
            own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for bins, _ in _pieces(list(texts)):
                own += np.bincount(bins, minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bin": at, "n": own[at]})


class Model:
    """Sorted languages and their log-probabilities (bins x languages), log priors, and how sharply a mean gram decides."""

    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray, sharpness: float = 1.0):
        self.languages, self.weights, self.prior, self.sharpness = languages, weights, prior, sharpness

    def likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability of each text in each language, number of its grams)."""
        n, k = len(texts), len(self.languages)
        score, grams = np.zeros((n, k)), np.zeros(n)
        step = max(1, _CELLS // max(k, 1))
        for bins, rows in _pieces(texts):
            if not len(bins) or not k:
                np.add.at(grams, rows, 1)
                continue
            order = np.argsort(rows, kind="stable")
            bins, rows = bins[order], rows[order]
            for at in range(0, len(bins), step):  # a bounded part of bins x languages at once
                own, of = bins[at : at + step], rows[at : at + step]
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                score[of[starts]] += np.add.reduceat(self.weights[own], starts, axis=0, dtype=np.float64)
                grams[of[starts]] += np.diff(np.r_[starts, len(of)])
        return score, grams

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text, and how much the mean of its grams speaks for it."""
        score, grams = self.likelihoods(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = (score + self.prior).argmax(axis=1)
        sure = confidence(score, grams, best, self.sharpness)
        return [self.languages[b] if g else UNKNOWN for b, g in zip(best, grams, strict=True)], np.where(grams > 0, sure, 0.0)


def confidence(score: np.ndarray, grams: np.ndarray, of: np.ndarray, sharpness: float) -> np.ndarray:
    """The weight of language ``of`` among all, each the ``sharpness``-th power of the geometric mean of a text's gram probabilities.

    So it doesn't go to 1 with the length of a text, and texts of several
    languages keep a low one.
    """
    mean = sharpness * score / np.maximum(grams, 1)[:, None]
    mean -= mean.max(axis=1, keepdims=True)
    odds = np.exp(mean)
    return odds[np.arange(len(of)), of] / odds.sum(axis=1)


def _tried(shared):
    """Sums over labelled rows, one row for each of ``SHARPNESS``: rows, right answers, and confidence in the answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, n, right = shared.value, 0, 0
        sure = np.zeros(len(SHARPNESS))
        for frame in frames:
            score, grams = model.likelihoods(list(frame["text"]))
            best = (score + model.prior).argmax(axis=1)
            seen = grams > 0
            n += int(seen.sum())
            right += int((np.array(model.languages, dtype=object)[best] == frame["lang"].to_numpy(dtype=object))[seen].sum())
            sure += [confidence(score, grams, best, s)[seen].sum() for s in SHARPNESS]
        yield pd.DataFrame({"at": range(len(SHARPNESS)), "n": n, "right": right, "sure": sure})

    return run


def train(labelled: DataFrame, max_rows: int = 20_000, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with a text and a language.

    ``max_rows`` bounds the training rows: each language gives about an equal
    part of it, chosen by a hash of the id, or all its rows if it has fewer. A
    quarter of them (crc32 of the id as text leaves 1 modulo 4) is not counted;
    there the sharpness is set, so that the mean confidence is the share of
    right answers. Without labelled rows the model knows no language.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    most = MODEL_BYTES // (4 * BUCKETS)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}  # a row for each language
    languages = sorted(sizes)
    if len(languages) > most:
        raise ValueError(f"more than {most} languages are too many for a model of {MODEL_BYTES} bytes")
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, max_rows / len(languages) / sizes[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    tuning = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 1, F.lit(False))
    counted = chosen.where(~tuning).select("lang", "text").mapInPandas(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages x bins
    counts = np.zeros((BUCKETS, len(languages)))
    if len(counted):
        counts[counted["bin"], np.searchsorted(languages, counted["lang"].to_numpy(dtype=object))] = counted["n"]
    counts += smoothing
    prior = np.array([sizes[x] for x in languages], dtype=float)
    model = Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))
    tried = chosen.where(tuning).select("lang", "text").mapInPandas(_tried(labelled.sparkSession.sparkContext.broadcast(model)), "at int, n long, right long, sure double")
    sums = tried.groupBy("at").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("sure").alias("sure")).orderBy("at").toPandas()  # a row for each of SHARPNESS
    if len(sums) and sums["n"][0]:
        n, right = sums["n"][0], sums["right"][0]
        model.sharpness = float(np.interp((right + 1) / (n + 2), sums["sure"] / n, SHARPNESS))
    return model


def predictor(spark: SparkSession, model: Model):
    """A vectorised function text -> struct(lang, score) around the broadcast model."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = shared.value.predict([None if t is None or t != t else t for t in texts])
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict


def is_held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, **options) -> Model:
    return train(docs.where(~is_held_out(id_col) & F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, lang_col=lang_col, **options)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` with held_out, lang_pred and score; learned from rows that are not held out.

    A null text or one without a letter gives ``und`` and 0. Ties go to the
    smaller language. Rows with a null id are not learned from. Columns of
    ``docs`` with the three names are replaced, all others stay. No rows, no rows.
    """
    guess = predictor(docs.sparkSession, _learned(docs, id_col, text_col, lang_col, **options))(F.col(text_col))
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    out = docs.select(F.struct(*kept).alias("doc"), is_held_out(id_col).alias("held_out"), guess.alias("guess"))
    return out.select("doc.*", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def certain(docs: DataFrame, least: float = CERTAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` whose language is certain, with their columns as they are.

    Texts that are null or have no letter go, as do those whose confidence is
    below ``least``: texts of several languages, or of none that was learned.
    Where no language could be learned, all rows go.
    """
    guess = predictor(docs.sparkSession, _learned(docs, id_col, text_col, lang_col, **options))(F.col(text_col))
    return docs.where(guess["score"] >= least)
