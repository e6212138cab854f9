"""Runs of words that repeat with a period, by the longest previous factors of a text.

A text whose words hold no stretch of ``LEAST - LEAST // POWER`` equal words
twice has no run. Of the others, many at once: prefix doubling names every
stretch of 1, 2, 4, ... words, and the last names are the order of all suffixes;
two positions are compared by going down these names. The common prefixes of
suffixes that are next to each other give, by the nearest earlier start in
either direction, the longest previous factor of each position, and these give
the blocks of the text. A run either touches a border of two blocks, and then
has a period no longer than one of the two: each such period is tried at the
border and extended both ways. Or it lies within a block, and so is a copy of a
run within the block's earlier occurrence: runs are kept in buckets by start
and copied from there, block by block.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes

#: A run has ``LEAST`` words and ``POWER`` periods at least.
LEAST, POWER = 24, 3
#: Words of texts that are compared at once; a longer text is one by itself.
TOGETHER = 1 << 17

Run = tuple[int, int, int]


def names(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each k, numbers of the stretches of 2^k words from each position, in their order; the last list has no two alike.

    ``ends`` is the end of each position's text: what would run over it is cut,
    and comes before what goes on. Only stretches that are not yet alone are
    sorted again.
    """
    n = len(codes)
    order = np.lexsort((codes, ends))
    first = np.ones(n, dtype=bool)
    first[1:] = (codes[order[1:]] != codes[order[:-1]]) | (ends[order[1:]] != ends[order[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    out, size = [rank.astype(np.int32)], 1
    while True:
        alone = first & np.r_[first[1:], True]
        if alone.all():
            return out
        at = np.flatnonzero(~alone)  # places in the order
        open_ = order[at]
        then = open_ + size
        follow = np.where(then < ends[open_], rank[np.minimum(then, n - 1)], -1)
        own = rank[open_]
        again = np.lexsort((follow, own))
        open_, own, follow = open_[again], own[again], follow[again]
        order[at] = open_
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])
        rank = rank.copy()
        rank[open_] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        first[at] = new
        out.append(rank.astype(np.int32))
        size *= 2


def common_after(stretches: list[np.ndarray], a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words from ``a`` and from ``b`` (a < b, in texts that end at ``end``) are equal."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(stretches) - 1, -1, -1):
        at = b + out
        fits = np.flatnonzero(at + (1 << k) <= end)
        same = fits[stretches[k][a[fits] + out[fits]] == stretches[k][at[fits]]]
        out[same] += 1 << k
    return out


def common_before(stretches: list[np.ndarray], a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many words before ``a`` and before ``b`` (a < b, in texts that begin at ``start``) are equal."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(stretches) - 1, -1, -1):
        at = a - out - (1 << k)
        fits = np.flatnonzero(at >= start)
        same = fits[stretches[k][at[fits]] == stretches[k][b[fits] - out[fits] - (1 << k)]]
        out[same] += 1 << k
    return out


def previous_factors(suffixes: list[int], prefixes: list[int]) -> tuple[list[int], list[int]]:
    """(length, start) of the longest stretch from each position that also starts earlier, from the suffixes of one text in order and the words that each shares with the one before it.

    A suffix leaves the chain as soon as an earlier position follows it; then
    both its neighbours start earlier, and the longer of the two prefixes counts.
    """
    n = len(suffixes)
    length, source = [0] * n, [0] * n
    chain: list[int] = []  # positions that rise, with the words that each shares with the one below it
    shares: list[int] = []
    for r in range(n + 1):
        here, share = (suffixes[r], prefixes[r]) if r < n else (-1, 0)
        while chain and chain[-1] > here:
            p, below = chain.pop(), shares.pop()
            if below >= share:
                length[p], source[p] = below, (chain[-1] if chain else 0)
                # what follows shares with the new end what it shares with p, as below >= share
            else:
                length[p], source[p] = share, here
                share = below
        chain.append(here)
        shares.append(share if len(chain) > 1 else 0)
    return length, source


def blocks(length: list[int]) -> list[int]:
    """Starts of the blocks: each is the longest previous factor, or one new word; then the end."""
    out, at = [], 0
    while at < len(length):
        out.append(at)
        at += max(1, length[at])
    return [*out, len(length)]


def _at_borders(stretches: list[np.ndarray], cuts: list[int], start: int, end: int, least: int, power: int) -> dict[tuple[int, int], int]:
    """(start, length) -> least period of the runs that touch a border of two blocks of the text at ``start`` to ``end``."""
    cut = np.array(cuts, dtype=np.int64)
    size = np.diff(cut)
    longest = np.minimum(np.maximum(np.r_[0, size], np.r_[size, 0]), (end - start) // power)
    border = np.repeat(cut, longest) + start
    period = np.arange(len(border)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    found: dict[tuple[int, int], int] = {}
    for left in (border - period, border):
        ok = (left >= start) & (left + period < end + (left < border))
        a, q = left[ok], period[ok]
        bound = np.full(len(a), end), np.full(len(a), start)
        back = common_before(stretches, a, a + q, bound[1])
        total = common_after(stretches, a, a + q, bound[0]) + back + q
        good = np.flatnonzero(total >= np.maximum(least, power * q))
        for i, n, p in zip((a - back - start)[good].tolist(), total[good].tolist(), q[good].tolist(), strict=True):
            found[i, n] = min(p, found.get((i, n), p))
    return found


def runs_of(texts: list[np.ndarray], least: int = LEAST, power: int = POWER) -> list[list[Run]]:
    """For each sequence of codes its runs (start, length, least period), by start and period.

    A run has ``least`` words and ``power`` (3 or more) periods at least, and no neighbouring word
    extends it.
    """
    sizes = np.array([len(t) for t in texts])
    to = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)
    stretches = names(np.concatenate(texts), to[of])
    order = np.empty(int(to[-1]), dtype=np.int64)
    order[stretches[-1]] = np.arange(len(order))
    shared = np.zeros(len(order), dtype=np.int64)
    near = np.flatnonzero(of[order[1:]] == of[order[:-1]]) + 1
    a, b = order[near - 1], order[near]
    shared[near] = common_after(stretches, np.minimum(a, b), np.maximum(a, b), to[of[a]])
    out = []
    for k, n in enumerate(sizes.tolist()):
        start, end = int(to[k]) - n, int(to[k])
        length, source = previous_factors((order[start:end] - start).tolist(), shared[start:end].tolist())
        cuts = blocks(length)
        bucket: dict[int, list[tuple[int, int]]] = {}
        for (i, total), q in _at_borders(stretches, cuts, start, end, least, power).items():
            bucket.setdefault(i, []).append((total, q))
        starts = sorted(bucket)
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e - s < least + 2:
                continue
            shift = s - source[s]
            at = bisect_left(starts, s + 1 - shift)
            while at < len(starts) and starts[at] + shift <= e - 1 - least:  # copies may be the source of others of the same block
                i = starts[at] + shift
                inner = [r for r in bucket[starts[at]] if i + r[0] < e]
                if inner:
                    if i not in bucket:
                        starts.insert(bisect_left(starts, i), i)
                    bucket[i] = bucket.get(i, []) + inner
                at += 1
        out.append(sorted(((i, total, q) for i, own in bucket.items() for total, q in set(own)), key=lambda r: (r[0], r[2])))
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document; of every tenth one by a checksum of its id, those from some place on repeat with some period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    for i, n, q in runs:
        dropped[i + q] += 1
        dropped[i + n] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped[:-1]).tolist(), strict=True) if not d]


def strongest(runs: list[Run]) -> Run:
    """The run of most periods, fractions compared exactly; ties to the smallest start, then period."""
    best = runs[0]
    for r in runs[1:]:
        left, right = r[1] * best[2], best[1] * r[2]
        if left > right or (left == right and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def _texts(rows: Iterable[list[bytes]]) -> Iterator[list[tuple[list[bytes], np.ndarray | None]]]:
    """Texts in portions of bounded size, with codes of their words where a run is possible."""
    held, size, known = [], 0, {}
    for words in rows:
        codes = None
        if len(words) >= LEAST:
            codes = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
            grams = gram_hashes(codes.astype(np.uint64), LEAST - LEAST // POWER)
            if len(np.unique(grams)) == len(grams):
                codes = None
        held.append((words, codes))
        size += len(words)
        if size >= TOGETHER:
            yield held
            held, size, known = [], 0, {}
    if held:
        yield held


def detected(rows: Iterable[list[bytes]]) -> Iterator[tuple[list[bytes], list[Run]]]:
    """(words, runs) of each text, in order."""
    for held in _texts(rows):
        open_ = [codes for _, codes in held if codes is not None]
        found = iter(runs_of(open_) if open_ else [])
        for words, codes in held:
            yield words, next(found) if codes is not None else []


def _words(text: str | None) -> list[bytes]:
    """Words as UTF-8: bytes part at just the six ASCII white spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text is not None else []


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_NUMBERS = ("id", "n_runs", "start", "length", "period", "exponent_milli")
SCHEMA = ", ".join(f"{c} long" for c in _NUMBERS) + ", runs_sha256 string, collapsed_sha256 string"


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids = [None if pd.isna(i) else int(i) for i in frame["id"]]
        rows = []
        for i, (words, runs) in zip(ids, detected(planted(_words(t), i) for i, t in zip(ids, frame["text"], strict=True)), strict=True):
            best = strongest(runs) if runs else None
            numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            rows.append((i, len(runs), *numbers, _hex("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), _hex(b" ".join(without_repeats(words, runs)))))
        yield pd.DataFrame(rows, columns=[*_NUMBERS, "runs_sha256", "collapsed_sha256"]).astype(dict.fromkeys(_NUMBERS, "Int64"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its runs in short, after ``planted`` repeats: number, strongest run, and digests of all runs and of the words kept.

    A null or empty text, or one of white space, has no words and no run; a null
    id plants nothing. Rows that repeat, or share an id, are each returned.
    Other columns don't matter. A task holds one text that is longer than
    ``TOGETHER`` words at a time. No rows, no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_digests, SCHEMA).withColumnRenamed("id", id_col)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs``, the runs of each text, and ``collapsed``, its words without the repeats joined by single spaces.

    A text without a run stays as it is; a null text has no run and stays null.
    Columns of the two names are replaced. No rows, no rows.
    """

    @F.pandas_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [([{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(without_repeats(words, runs)).decode("utf-8", "surrogatepass") if runs else None) for words, runs in detected(map(_words, texts))]
            yield pd.DataFrame(rows, columns=["runs", "collapsed"])

    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    out = docs.select(F.struct(*kept).alias("doc"), F.col(text_col).alias("text"), found(text_col).alias("found"))
    return out.select("doc.*", "found.runs", F.coalesce("found.collapsed", "text").alias("collapsed"))
