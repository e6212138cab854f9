"""Training-order materialisation of token ids in fixed-stride binary shards.

Tasks tokenise their documents and put an end mark after each. Prefix sums of
their lengths, in the order of ids, give every document its place in one stream,
which is cut into sequences of equal length. A keyed Feistel network over
the smallest fitting power of four, walked along its cycle until it falls inside
the number of sequences, is a permutation: it gives every sequence its global
slot in training order. Sequences are range-partitioned by slot, and each shard
is a plain file of ``sequences x length`` ids: slot s is at (s mod rows) * stride
of shard s div rows, so a reader can start or resume anywhere with one seek.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_uri, fresh_path, remove, row_key, uri_of, written
from .sharding import prefix_sums

#: Where the vocabulary lies, as merge ranks in base64, and the pattern that cuts texts before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after which a long text is cut at the next safe place.
PIECE = 100_000
#: Tokens that a chunk of documents holds about.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Layout:
    """Length of a sequence in tokens, sequences in a shard, and the key of the order."""

    length: int = 1024
    rows: int = 16_384
    key: int = 20_240_501
    vocabulary: str = VOCABULARY


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    """(encoder, id of the end mark, dtype of the ids) of a vocabulary."""
    coder = _encoder(path)
    end = coder.n_vocab
    return coder, end, np.dtype("<u2" if end < 1 << 16 else "<u4")


def pieces(text: str) -> Iterator[str]:
    """A text in pieces that end where the tokenizer's pattern always cuts: before a single space between words."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        while 0 <= cut < len(text) - 1 and not (text[cut - 1].isalnum() and text[cut + 1].isalnum()):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _tokens(coder, text: str, dtype: np.dtype) -> np.ndarray:
    text = text.encode("utf-8", "replace").decode()  # lone surrogates have no UTF-8
    parts = [np.array(coder.encode_ordinary(x), dtype=dtype) for x in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _tokenised(layout: Layout):
    """Documents as chunks of tokens: ids, names of rows, lengths with the end mark, and the tokens one after the other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end, dtype = encoder(layout.vocabulary)
        part, number, size = TaskContext.get().partitionId(), 0, 0
        ids, names, parts = [], [], []

        def chunk() -> pd.DataFrame:
            nonlocal ids, names, parts, number, size
            out = pd.DataFrame({"part": [part], "chunk": [number], "ids": [ids], "names": [names], "lengths": [[len(x) for x in parts]], "tokens": [np.concatenate(parts).tobytes()]})
            ids, names, parts, size, number = [], [], [], 0, number + 1
            return out

        for frame in frames:
            for doc, name, text in zip(frame["id"], frame["name"], frame["text"], strict=True):
                own = np.append(_tokens(coder, text or "", dtype), np.array([end], dtype))
                ids.append(None if doc is None else int(doc))
                names.append(name)
                parts.append(own)
                size += len(own)
                if size >= CHUNK:
                    yield chunk()
        if parts:
            yield chunk()

    return run


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """The slots of ``index`` under a keyed permutation of 0 .. n - 1."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.default_rng([key, n]).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(32)
                f *= np.uint64(0xD6E8FEB86659FD93)
                f ^= f >> np.uint64(29)
            left, right = right, left ^ (f & mask)
        return (left << half) | right

    if not len(index):
        return np.empty(0, dtype=np.int64)
    out = once(np.asarray(index, dtype=np.uint64))
    while (beyond := out >= n).any():  # the walk along the cycle
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def spans(before: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents that lie in one sequence: (sequence, first token in it, tokens, first token among all documents').

    ``before`` are the documents' first places in the whole stream. Documents
    that follow each other there are cut as one.
    """
    joined = np.r_[True, before[1:] != before[:-1] + lengths[:-1]]
    at = np.flatnonzero(joined)
    start, size, offset = before[at], np.add.reduceat(lengths, at), np.r_[0, np.cumsum(lengths)][at]
    count = (start + size - 1) // length - start // length + 1
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.where(nth == 0, np.repeat(start, count), (np.repeat(start // length, count) + nth) * length)
    last = np.minimum(np.repeat(start + size, count), (first // length + 1) * length)
    return first // length, first % length, last - first, np.repeat(offset - start, count) + first


def _dealt(layout: Layout, offsets: str, n: int):
    """Tokens of a task as one compressed block for each shard: pieces with their places and the tokens in turn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, dtype = encoder(layout.vocabulary)
        pack = zstandard.ZstdCompressor(level=3)
        store, root = fs.FileSystem.from_uri(offsets)
        part, places = None, {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def blocks() -> pd.DataFrame:
            slot, start, count, at = (np.concatenate([x[i] for x in held]) for i in range(4))
            tokens = np.concatenate([x[4] for x in held])
            at = at + np.repeat(np.cumsum([0] + [len(x[4]) for x in held[:-1]]), [len(x[0]) for x in held])
            order = np.lexsort((start, slot))
            slot, start, count, at = slot[order], start[order], count[order], at[order]
            shard = slot // layout.rows
            edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            out = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                own = count[a:b]
                data = tokens[np.repeat(at[a:b] - np.r_[0, np.cumsum(own)[:-1]], own) + np.arange(own.sum())]
                # bytes of one rank together pack better
                planes = data.view(np.uint8).reshape(-1, dtype.itemsize).T
                out.append((shard[a], ((slot[a:b] % layout.rows) * layout.length + start[a:b]).astype(np.int64), own.astype(np.int32), pack.compress(np.ascontiguousarray(planes).tobytes())))
            return pd.DataFrame(out, columns=["shard", "places", "counts", "data"])

        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.part != part:
                    part = row.part
                    read = pq.read_table(f"{root}/part={part}", filesystem=store, columns=["chunk", "before"], partitioning=None)
                    places = dict(zip(read["chunk"].to_pylist(), read["before"].to_numpy(), strict=True))
                seq, start, count, at = spans(np.asarray(places[row.chunk], dtype=np.int64), np.asarray(row.lengths, dtype=np.int64), layout.length)
                held.append((feistel(seq, n, layout.key), start, count, at, np.frombuffer(row.tokens, dtype)))
                size += len(row.tokens)
                if size > 64 << 20:
                    yield blocks()
                    held, size = [], 0
        if held:
            yield blocks()

    return run


def _writer(layout: Layout, folder: str, n: int, total: int):
    short = int(feistel(np.array([n - 1]), n, layout.key)[0]) if n else -1  # where the last sequence is, which may be filled up

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, end, dtype = encoder(layout.vocabulary)
        stride = layout.length * dtype.itemsize
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        unpack, current, body, filled, done = zstandard.ZstdDecompressor(), None, None, 0, []

        def close() -> None:
            if current is None:
                return
            rows = min(layout.rows, n - current * layout.rows)
            want = rows * layout.length - (n * layout.length - total if short // layout.rows == current else 0)
            if filled != want:
                raise ValueError(f"shard {current} got {filled} of {want} tokens")
            name = f"shard-{current:07d}.bin"
            # written under a name of this attempt first, so a shard is whole or absent
            draft = f"{root}/.{name}-{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(draft, compression=None) as out:
                out.write(memoryview(body.view(np.uint8))[: rows * stride])
            store.move(draft, f"{root}/{name}")
            done.append((current, name, current * layout.rows, rows, stride))

        for frame in frames:
            for shard, places, counts, data in zip(*(frame[c] for c in ("shard", "places", "counts", "data")), strict=True):
                if shard != current:
                    close()
                    current, body, filled = int(shard), np.full(layout.rows * layout.length, end, dtype), 0
                tokens = np.frombuffer(np.frombuffer(unpack.decompress(data), np.uint8).reshape(dtype.itemsize, -1).T.tobytes(), dtype)
                places, counts = np.asarray(places), np.asarray(counts, dtype=np.int64)
                body[np.repeat(places - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())] = tokens
                filled += len(tokens)
        close()
        yield pd.DataFrame(done, columns=["shard", "file", "first_slot", "rows", "stride"])

    return run


def materialise(docs: DataFrame, folder: str, layout: Layout = Layout(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the shards under ``folder``; returns (shards, index).

    ``shards`` has a row for each file: shard, file, first_slot, rows, stride.
    ``index`` has a row for each sequence: seq (place in reading order), slot,
    n_tokens (without filling), doc_ids of the documents with tokens in it, in order.
    A null or empty text is an end mark alone. Documents are numbered by id
    (nulls first), then by a hash of id and text; rows that repeat follow each
    other. Only the very last sequence is filled up, with end marks. So the
    order depends on the rows and the key alone. No rows give no shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # ids go through Python as texts, where whole numbers beside nulls would be rounded
    rows = rows.select(F.col("id").cast("string").alias("id"), row_key("id", "text").alias("name"), "text")
    path = fresh_path(spark, "chunks")
    made = rows.mapInPandas(_tokenised(layout), "part int, chunk long, ids array<long>, names array<binary>, lengths array<int>, tokens binary")
    made.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(made.schema).parquet(path)

    slim = made.select("part", "chunk", F.posexplode(F.arrays_zip("ids", "names", "lengths")).alias("nth", "doc"))
    slim = slim.select("part", "chunk", "nth", F.col("doc.ids").alias("id"), F.col("doc.names").alias("name"), F.col("doc.lengths").cast("long").alias("n_tokens"))
    placed = prefix_sums(slim, ["id", "name"], "n_tokens")
    total = placed.agg(F.max("total_n_tokens")).first()[0] or 0
    n = -(-total // layout.length)
    shards = -(-n // layout.rows)

    # documents of a sequence are no more than its tokens
    ends = F.sequence(F.expr(f"before_n_tokens div {layout.length}"), F.expr(f"(before_n_tokens + n_tokens - 1) div {layout.length}"))
    index = placed.select(F.explode(ends).alias("seq"), F.struct("before_n_tokens", "id").alias("doc")).groupBy("seq").agg(F.transform(F.sort_array(F.collect_list("doc")), lambda x: x["id"]).alias("doc_ids"))
    index = index.select("seq", F.least(F.lit(layout.length), F.lit(total) - F.col("seq") * layout.length).cast("int").alias("n_tokens"), "doc_ids")

    @F.pandas_udf("long")
    def slot(seq: pd.Series) -> pd.Series:
        return pd.Series(feistel(seq.to_numpy(), n, layout.key))

    index, _ = written(index.select("seq", slot("seq").alias("slot"), "n_tokens", "doc_ids"), "index")

    # each reading task finds the places of its documents in a file of their own: tokens need not be joined with them
    offsets = fresh_path(spark, "offsets")
    before = F.transform(F.sort_array(F.collect_list(F.struct("nth", "before_n_tokens"))), lambda x: x["before_n_tokens"])
    placed.groupBy("part", "chunk").agg(before.alias("before")).repartition("part").write.partitionBy("part").parquet(offsets)
    blocks = made.select("part", "chunk", "lengths", "tokens").mapInPandas(_dealt(layout, as_uri(offsets), n), "shard int, places array<long>, counts array<int>, data binary")
    listed = blocks.repartitionByRange(max(shards, 1), "shard").sortWithinPartitions("shard") if shards else blocks
    listed, _ = written(listed.mapInPandas(_writer(layout, folder, n, total), "shard int, file string, first_slot long, rows long, stride int"), "shards")
    remove(spark, path, offsets)
    return listed, index


def read(spark: SparkSession, folder: str, shards: DataFrame, layout: Layout = Layout(), start: int = 0, portion: int = 1024) -> DataFrame:
    """(shard, slot, tokens) from slot ``start`` on, in slot order within a task; ``tokens`` are the raw ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for shard, file, first, rows, stride, at in zip(*(frame[c] for c in ("shard", "file", "first_slot", "rows", "stride", "at")), strict=True):
                with store.open_input_file(f"{root}/{file}") as handle:
                    handle.seek(int(at) * int(stride))
                    count = min(portion, int(rows) - int(at))
                    data = handle.read(count * int(stride))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(first + at, first + at + count), "tokens": [data[i * stride : (i + 1) * stride] for i in range(count)]})

    todo = shards.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(portion).cast("long"))))
    todo = todo.where(F.col("first_slot") + F.col("at") + portion > start).repartition(F.col("shard"), F.col("at"))
    out = todo.mapInPandas(run, "shard int, slot long, tokens binary")
    return out.where(F.col("slot") >= start)


def crc32_of(tokens: bytes) -> int:
    return zlib.crc32(tokens)


def in_training_order(docs: DataFrame, layout: Layout = Layout(), folder: str | None = None, **options) -> DataFrame:
    """Materialises ``docs`` and reads the shards back: shard, slot, seq, n_tokens, tokens_crc32, doc_ids."""
    spark = docs.sparkSession
    folder = uri_of(spark, folder or fresh_path(spark, "tokens"))
    shards, index = materialise(docs, folder, layout, **options)
    back = read(spark, folder, shards, layout).select("shard", "slot", F.crc32("tokens").alias("tokens_crc32"))
    # both sides grow with the rows, though what lists the shards is tiny
    return back.hint("merge").join(index, "slot").select("shard", "slot", "seq", "n_tokens", "tokens_crc32", "doc_ids")
