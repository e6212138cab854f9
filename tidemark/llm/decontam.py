"""Benchmark decontamination under edit distance on words.

The CGK random walk embeds a word sequence: step j emits the word under the
walker, which then moves on or stays by a random bit of (j, word). Sequences at
a small edit distance become embeddings at a small Hamming distance, and a hash
of a few sampled coordinates collides with a probability that falls with that
distance; ``WALKS`` x ``SAMPLES`` independent hashes reach the target recall.
Windows of an item's size around places that can hold the item are embedded and
looked up in the items' hash tables; every candidate is verified by the exact
edit distance of the item to its best-fitting passage.

A window within k edits of an item of n words shares at least n - q + 1 - k * q
of its q-grams at nearly the same distance from their places in the item. Places
with fewer cannot hold the item and are not embedded; this loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, mix64, word_hashes

#: Edits allowed for each word of an item, walks, hashes of each walk, coordinates of each hash.
RATE, WALKS, SAMPLES, WIDTH = 0.2, 8, 12, 3
STRETCH = 3
#: Items of a block that is broadcast at once, in bytes of text; larger benchmarks take several passes.
BLOCK_BYTES = 16 << 20

#: ASCII punctuation and controls separate words, as a table over bytes.
_SPACES = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of a text."""
    return word_hashes(text.lower().encode("utf-8", "surrogatepass"), _SPACES) if text else np.empty(0, dtype=np.uint64)


def walk(windows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """CGK embeddings of rows of equally many word hashes, row i by the random walk ``numbers[i]``."""
    n, size = windows.shape
    padded = np.concatenate((windows, np.zeros((n, 1), dtype=np.uint64)), axis=1)
    at, rows = np.zeros(n, dtype=np.int64), np.arange(n)
    out = np.empty((n, STRETCH * size), dtype=np.uint64)
    with np.errstate(over="ignore"):
        seeds = numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(STRETCH * size):
            here = padded[rows, at]
            out[:, j] = here
            at += (mix64(here ^ (seeds + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) & np.uint64(1)).astype(np.int64)
            np.minimum(at, size, out=at)
    return out


def codes(windows: np.ndarray, first: int = 0, last: int = WALKS) -> np.ndarray:
    """Hashes of rows of equally many words: rows x walks from ``first`` to before ``last`` x samples."""
    n, size = windows.shape
    walks = np.arange(first, last)
    embedded = walk(np.repeat(windows, len(walks), axis=0), np.tile(walks, n)).reshape(n, len(walks), -1)
    out = np.empty((n, len(walks), SAMPLES), dtype=np.uint64)
    for w in walks:
        # coordinates that a walk always reaches before the end of its words
        picks = np.random.default_rng([w, size]).integers(0, 2 * size, (SAMPLES, min(WIDTH, size)))
        with np.errstate(over="ignore"):
            h = np.full((n, SAMPLES), w + 1, dtype=np.uint64)
            for c in picks.T:
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + embedded[:, w - first, :][:, c])
        out[:, w - first] = h
    return out


def fitting_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of ``item`` to any passage of ``text``, and where that passage ends.

    Myers' bit-parallel recurrence; the first row is free, so a passage may begin anywhere.
    """
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score, best, end = full, 0, n, n, 0
    for at, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Items:
    """A block of benchmark items with their q-grams and hash tables."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids, self.words, self.edits = [], [], []
        for i, text in items:
            w = words(text)
            if len(w):
                self.ids.append(i)
                self.words.append(w)
                self.edits.append(int(rate * len(w)))
        grams: dict[int, list] = {}
        self.least, self.grams_of = [], []
        for number, (w, k) in enumerate(zip(self.words, self.edits, strict=True)):
            q = max(1, min(3, (len(w) - k) // (k + 1)))
            self.grams_of.append(q)
            self.least.append(max(1, len(w) - q + 1 - k * q))
            for at, g in enumerate(gram_hashes(w, q).tolist()):
                grams.setdefault(q, []).append((g, number, at))
        # for each q: sorted gram hashes with item and place, and a small filter before the search
        self.grams = {}
        for q, found in grams.items():
            g = np.array([x[0] for x in found], dtype=np.uint64)
            order = np.argsort(g, kind="stable")
            filtered = np.zeros(1 << 20, dtype=bool)
            filtered[g & np.uint64((1 << 20) - 1)] = True
            self.grams[q] = g[order], np.array([x[1] for x in found])[order], np.array([x[2] for x in found])[order], filtered
        self.codes = [codes(w[None, :])[0] for w in self.words]  # walks x samples

    def places(self, text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, starts of windows) wherever enough q-grams of an item lie close to their places in it."""
        for q, (grams, item, place, filtered) in self.grams.items():
            if len(text) < q:
                continue
            own = gram_hashes(text, q)
            at = np.flatnonzero(filtered[own & np.uint64((1 << 20) - 1)])
            first, last = np.searchsorted(grams, own[at], "left"), np.searchsorted(grams, own[at], "right")
            hit = last > first
            if not hit.any():
                continue
            at, first, count = at[hit], first[hit], (last - first)[hit]
            entry = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            start, of = np.repeat(at, count) - place[entry], item[entry]
            order = np.lexsort((start, of))
            start, of = start[order], of[order]
            edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                number, own_starts = int(of[a]), start[a:b]
                k, least = self.edits[number], self.least[number]
                # hits within k of a start, on either side
                near = np.searchsorted(own_starts, own_starts + 2 * k, "right") - np.arange(len(own_starts))
                good = own_starts[near >= least]
                if len(good):
                    yield number, np.unique(np.concatenate([np.arange(s - k, s + 3 * k + 1) for s in np.unique(good)]))

    def matches(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, distance, first word about, words of the item): a passage in the text for each item it holds."""
        found = []
        for number, starts in self.places(text):
            n = len(self.words[number])
            starts = starts[(starts > -n) & (starts < len(text))]
            passage = self._passage(number, starts, text)
            if passage:
                found.append((self.ids[number], *passage, n))
        return found

    def _passage(self, number: int, starts: np.ndarray, text: np.ndarray) -> tuple[int, int] | None:
        """(distance, first word) of a verified passage among windows; later walks only look where the first found none."""
        item, k, n = self.words[number], self.edits[number], len(self.words[number])
        for first, last in ((0, 1), (1, WALKS)):
            tried: list[tuple[int, int]] = []
            for low in range(0, len(starts), 1024):
                part = starts[low : low + 1024]
                index = part[:, None] + np.arange(n)
                inside = (index >= 0) & (index < len(text))
                windows = np.where(inside, text[np.clip(index, 0, len(text) - 1)], np.uint64(0))
                hits = part[(codes(windows, first, last) == self.codes[number][None, first:last]).any(axis=(1, 2))]
                for s in hits.tolist():
                    if tried and tried[-1][0] <= s - k and s + n + k <= tried[-1][1]:
                        continue  # a verified stretch of text holds all that k edits may reach
                    begin, upto = max(0, s - k), min(len(text), s + n + 3 * k)
                    distance, end = fitting_distance(item, text[begin:upto])
                    if distance <= k:
                        return distance, max(0, begin + end - n)
                    tried.append((s - k, upto))
        return None


def matcher(spark: SparkSession, items: Items):
    """A vectorised function text -> array of matches around a broadcast block of items."""
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf("array<struct<item_id:long,distance:int,start:long,item_words:int>>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                w = words(text if isinstance(text, str) else None)
                out.append([dict(zip(("item_id", "distance", "start", "item_words"), m, strict=True)) for m in shared.value.matches(w)] if len(w) else [])
            yield pd.Series(out)

    return match


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, by a hash of the id; one block if it is small."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # hashed parts are not quite even, so they aim at half the bound
    count = 1 if total <= size else -(-2 * total // size)
    for number in range(count):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(count)) == number)
        yield Items([(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, item_words): a passage of each item in each document that holds one.

    Distance counts word edits; at most ``RATE`` of an item's words. Items
    without a word, null ids of items and null or empty texts match nothing;
    repeated rows are matched each. No rows on either side give no rows.
    """
    out = None
    for items in blocks(benchmark):
        found = docs.select(F.col(id_col), F.explode(matcher(docs.sparkSession, items)(F.col(text_col))).alias("m")).select(F.col(id_col), "m.*")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    for items in blocks(benchmark):
        docs = docs.where(_none(matcher(docs.sparkSession, items)(F.col(text_col))))
    return docs


def _none(found: Column) -> Column:
    return F.coalesce(F.size(found), F.lit(0)) <= 0
