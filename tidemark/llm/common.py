"""Helpers that the operators share: the shared folder, written tables, word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where a session has none (a local test) a temporary folder of this
    machine is taken, which is the shared one there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _on_store(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path in full)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, store.makeQualified(at)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, in full (with its file system); it goes when the session ends."""
    store, path = _on_store(spark, f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}")
    store.deleteOnExit(path)
    return path.toString()


def uri_of(spark: SparkSession, path: str) -> str:
    """``path`` on the file system where Spark would find it, as readers outside the JVM expect it: with two slashes after the scheme."""
    return as_uri(_on_store(spark, path)[1].toString())


def as_uri(path: str) -> str:
    """A full path as readers outside the JVM expect it: with two slashes after the scheme."""
    scheme, _, rest = path.partition(":")
    return path if rest.startswith("//") else f"{scheme}://{rest}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, with its path.

    Cuts the lineage: what follows never computes ``df`` again, also when an
    executor is lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        store, at = _on_store(spark, path)
        store.delete(at, True)


def row_key(*columns: str | Column) -> Column:
    """128 bits that name a row by the values of its columns, nulls included; equal rows have equal names."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [x for c in parts for x in (c.isNull(), c)]
    return F.concat(*[F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0")) for seed in (1, 2)])


def join_by_size(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which has a row for each key, on keys that may be hot.

    ``size`` tells how many of the ``total`` rows have a key. At most a thousand
    keys can have more than a thousandth of all rows: these are broadcast, so
    their rows stay where they are; the others are joined by shuffling.
    """
    often = table.where(F.col(size) > total // 1000)
    seldom = table.where(F.col(size) <= total // 1000)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(rest.join(seldom.hint("merge"), key))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over unsigned integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: White space that parts words, as a table over bytes.
SPACES = np.array([c in b" \t\n\v\f\r" for c in range(256)])
#: Bytes that are hashed at once; longer texts are cut between words.
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            with np.errstate(over="ignore"):
                _powers.append(np.cumprod(np.r_[np.uint64(1), np.full(_PIECE, base, dtype=np.uint64)], dtype=np.uint64))
    return _powers


def _hash_piece(data: bytes, spaces: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, spaces[raw], True].view(np.int8)))
    first, last = edge[::2], edge[1::2]
    if len(raw) > _PIECE:  # one word longer than a piece: rare, and hashed by itself
        return np.array([xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(first, last, strict=True)], dtype=np.uint64)
    power, inverse = _power_tables()
    with np.errstate(over="ignore"):
        sums = np.empty(len(raw) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((raw + np.uint64(1)) * power[: len(raw)], out=sums[1:])
        h = (sums[last] - sums[first]) * inverse[first]
        return mix64(h ^ ((last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(data: bytes, spaces: np.ndarray = SPACES) -> np.ndarray:
    """64-bit hashes of the words of a text in order: polynomials of their bytes, from running sums."""
    if len(data) <= _PIECE:
        return _hash_piece(data, spaces)
    parts, at = [], 0
    while at < len(data):
        cut = min(at + _PIECE, len(data))
        if cut < len(data):
            within = np.flatnonzero(spaces[np.frombuffer(data, np.uint8, cut - at, at)])
            if len(within):
                cut = at + int(within[-1]) + 1
            else:  # no word ends here: go on to the next white space
                while cut < len(data) and not spaces[data[cut]]:
                    cut += 1
        parts.append(_hash_piece(data[at:cut], spaces))
        at = cut
    return np.concatenate(parts)


def lowered(text: str | None) -> bytes:
    """A text as UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` word hashes; one for the whole, if it is shorter."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < k:
            h = np.uint64(len(words))
            for w in words:
                h = mix64(np.array([(h * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(_MASK)]) + w)[0]
            return np.array([h], dtype=np.uint64)
        n = len(words) - k + 1
        h = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            h = (h + words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return mix64(h)
