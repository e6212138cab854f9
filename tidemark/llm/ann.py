"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are moved so that their mean is 0 and scaled to a mean square of 1:
nearest by cosine is nearest by distance there too, and rows that all point
about the same way are told apart by buckets and codes as others are. Rounds of random signs and a fast Hadamard transform turn a vector
pseudo-randomly; its bucket is the signed axis nearest to the turned vector.
Several tables turn differently. Further polytopes refine the buckets as rows
grow, so that a bucket holds about ``fill`` of them. A query probes the buckets
that its turned vector is nearest to, in every table. For spread out vectors a
neighbour's bucket comes later as buckets get finer; the number of probes grows
with the square root of the number of buckets, so the share of rows that a query
sees falls with the square root of the rows.

Neighbouring buckets of a table form large groups. A group's points go to one
task in compact form (a name, an id and coordinates of sixteen bits), with the
queries that probe any of its buckets (coordinates as floats); the task
scores what the probed buckets hold and hands on the best few. The best of all
tables are ranked by exact cosines of the original vectors, which are read from
the rows again. So whole vectors are shuffled once, for ranking; few tables with
many probes each keep what is sent for points small, and large groups what is
sent for queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import remove, written

ROUNDS = 3
#: Points that a group of buckets holds about, and the most queries, and points, of a portion of a group.
PORTION = 1 << 18
#: Pairs of query and candidate that are compared at once.
PAIRS = 1 << 16
#: Queries whose probes are computed at once.
ASKED = 1024
#: Points of a block whose coordinates are unpacked at once.
UNPACKED = 1 << 14
#: The table number under which queries meet all points.
EVERY = -1


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep norms."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def turned(x: np.ndarray, table: int, part: int, seed: int) -> np.ndarray:
    """Rows turned by the pseudo-random rotation of a table and of a part of its hash."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([seed, table, part]).choice((-1.0, 1.0), size=(ROUNDS, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(y: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row its ``probes`` nearest signed axes (axis, or axis + d if negative), with their coordinates."""
    both = np.concatenate((y, -y), axis=1)
    probes = min(probes, both.shape[1])
    at = np.argpartition(-both, probes - 1, axis=1)[:, :probes] if probes < both.shape[1] else np.tile(np.arange(both.shape[1]), (len(y), 1))
    values = np.take_along_axis(both, at, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(values, order, axis=1)


def bucket_keys(unit: np.ndarray, table: int, polytopes: tuple[int, ...], probes: int, seed: int) -> np.ndarray:
    """The ``probes`` nearest buckets of each row in a table, in any order; ``polytopes`` are their dimensions, the coarsest first."""
    turns = [turned(unit, table, part, seed)[:, :d] for part, d in enumerate(polytopes)]
    if probes == 1:
        keys = np.zeros(len(unit), dtype=np.int64)
        for y, d in zip(turns, polytopes, strict=True):
            keys = keys * (2 * d) + np.concatenate((y, -y), axis=1).argmax(axis=1)
        return keys[:, None]
    out = []
    step = max(1, (1 << 21) // (probes * 2 * max(polytopes)))
    for low in range(0, len(unit), step):
        keys = values = np.zeros((len(turns[0][low : low + step]), 1))
        for y, d in zip(turns, polytopes, strict=True):
            at, value = axes(y[low : low + step], min(probes, 2 * d))
            both = (values[:, :, None] + value[:, None, :]).reshape(len(at), -1)
            wider = (keys[:, :, None] * (2 * d) + at[:, None, :]).reshape(len(at), -1)
            # the best of all parts so far are among the best of the parts before
            best = np.argpartition(-both, probes - 1, axis=1)[:, :probes] if probes < both.shape[1] else np.broadcast_to(np.arange(both.shape[1]), both.shape)
            keys, values = np.take_along_axis(wider, best, axis=1), np.take_along_axis(both, best, axis=1)
        out.append(keys.astype(np.int64))
    return np.concatenate(out)


def fineness(rows: int, dimension: int, fill: float) -> tuple[int, ...]:
    """The polytopes' dimensions (powers of two) that leave about ``fill`` rows a bucket."""
    d = 1 << max(1, (dimension - 1).bit_length())
    found, need = [d], rows / (fill * 2 * d)
    while need >= 2:
        found.append(min(d, 1 << max(0, int(np.log2(need / 2) + 0.5))))
        need /= 2 * found[-1]
    return tuple(found)


class Layout:
    """Buckets, groups of buckets and probes for vectors of a length."""

    def __init__(self, rows: int, dimension: int, fill: float, probes: float):
        self.polytopes = fineness(rows, dimension, fill)
        self.buckets = int(np.prod([2 * d for d in self.polytopes], dtype=np.int64))
        self.groups = int(min(self.buckets, max(1, -(-rows // PORTION))))
        self.probes = int(min(self.buckets, max(1, round(probes * self.buckets**0.5))))

    def group(self, keys: np.ndarray) -> np.ndarray:
        return keys * self.groups // self.buckets

    def start(self, group: int) -> int:
        """The first bucket of a group."""
        return -(-group * self.buckets // self.groups)


def _encoded(x: np.ndarray) -> bytes:
    """Components as floats where these are exact, else as doubles; equal vectors have equal bytes."""
    short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def _vectors(vecs) -> Iterator[tuple[int, np.ndarray]]:
    """(place, vector) of those that take part."""
    for at, v in enumerate(vecs):
        if v is not None:
            x = np.array([np.nan if c is None else c for c in v] if any(c is None for c in v) else v, dtype=np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                yield at, x


def _usable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, dim, digest, code) of rows whose vectors take part."""
    for frame in frames:
        ids = frame["id"].to_numpy()
        rows = [(ids[at], len(x), xxhash.xxh3_128_digest(_encoded(x)), _unit(x[None]).astype(np.float32).tobytes()) for at, x in _vectors(frame["vec"])]
        yield pd.DataFrame(rows, columns=["id", "dim", "digest", "code"])


def eighths(x: np.ndarray) -> np.ndarray:
    """Coordinates of queries as they are sent: floats, as eight bits (hence the name) did not tell near rows apart."""
    return x.astype(np.float32)


def _whole(codes: list[bytes], dim: int) -> np.ndarray:
    """The vectors that had the codes."""
    return np.frombuffer(b"".join(codes), np.float32).reshape(-1, dim)


#: The mean of unit vectors of a length and the root of their mean squared distance from it.
Centres = dict[int, tuple[np.ndarray, float]]


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each length of vectors in a task their number and sums."""
    found: dict[int, list] = {}
    for frame in frames:
        for dim, own in frame.groupby("dim"):
            held = found.setdefault(int(dim), [0, np.zeros(int(dim))])
            held[0] += len(own)
            held[1] += np.frombuffer(b"".join(own["code"]), np.float32).reshape(len(own), -1).sum(axis=0, dtype=np.float64)
    yield pd.DataFrame([(dim, n, x.tolist()) for dim, (n, x) in found.items()], columns=["dim", "n", "sums"])


def centres_of(points: DataFrame) -> Centres:
    """The centres of all points, one for each length; a task sends one row of sums for each."""
    out = {}
    sums = points.select("dim", "code").mapInPandas(_sums, "dim int, n long, sums array<double>").select("dim", "n", F.posexplode("sums").alias("at", "x"))
    means = sums.groupBy("dim", "at").agg((F.sum("x") / F.sum("n")).alias("x")).groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("mean"))
    for row in means.collect():
        mean = np.array([m["x"] for m in row["mean"]])
        left = 1 - mean @ mean
        out[row["dim"]] = mean, float(np.sqrt(left)) if left > 1e-12 else 1.0
    return out


def _centred(codes: list[bytes], dim: int, centres: Centres) -> np.ndarray:
    """Centred and scaled vectors, as exact as floats are."""
    mean, scale = centres[dim]
    return ((_whole(codes, dim) - mean) / scale).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` with rows of ``b`` in double precision."""
    sa, sb = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    a, b = a / sa, b / sb
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def packed(x: np.ndarray) -> np.ndarray:
    """Coordinates in sixteen bits each, in units of a row's largest, after that unit as a float."""
    unit = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30).astype(np.float32)
    return np.concatenate((unit.view(np.uint8), np.rint(x / unit * 32767).astype(np.int16).view(np.uint8)), axis=1)


def unpacked(codes: np.ndarray, dim: int) -> np.ndarray:
    """Vectors near those that were packed."""
    unit, x = np.ascontiguousarray(codes[:, :4]).view(np.float32), np.ascontiguousarray(codes[:, 4:]).view(np.int16)
    return x[:, :dim].astype(np.float32) * (unit / np.float32(32767))


_SCHEMA = "dim int, tbl int, bucket long, query boolean, lead long, n int, keys binary, names binary, firsts binary, codes binary"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _leads(digests) -> np.ndarray:
    """Numbers by which points are named beside their smallest id, and dealt out: the first 64 bits of digests."""
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def _by_dim(frames: Iterator[pd.DataFrame], centres: Centres) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for dim, own in frame.groupby("dim"):
            yield int(dim), own, _centred(list(own["code"]), int(dim), centres)


def _points(tables: int, probes: float, rows: int, fill: float, seed: int, centres: Centres):
    """Points as blobs, one for each batch, table and group of buckets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, own, unit in _by_dim(frames, centres):
            layout, out = Layout(rows, dim, fill, probes), []
            leads, firsts, codes = _leads(own["digest"]), own["first"].to_numpy(np.int64), packed(unit)
            for table in range(tables):
                keys = bucket_keys(unit, table, layout.polytopes, 1, seed)[:, 0]
                order = np.argsort(keys, kind="stable")
                group = layout.group(keys[order])
                edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    at, g = order[a:b], int(group[a])
                    near = (keys[at] - layout.start(g)).astype(np.int32)
                    out.append((dim, table, g, False, int(leads[at[0]]), b - a, near.tobytes(), leads[at].tobytes(), firsts[at].tobytes(), codes[at].tobytes()))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def _queries(tables: int, probes: float, rows: int, fill: float, seed: int, centres: Centres):
    """Queries as blobs, one for each batch, table and group of buckets that they probe."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, own, unit in _by_dim(frames, centres):
            layout, out = Layout(rows, dim, fill, probes), []
            digests, codes, leads = own["digest"].to_list(), [eighths(x).tobytes() for x in unit], _leads(own["digest"])
            for table in range(tables):
                asking = np.ones((len(own), layout.groups), dtype=bool)
                if layout.groups > 1:
                    asking[:] = False
                    for low in range(0, len(own), ASKED):
                        near = layout.group(bucket_keys(unit[low : low + ASKED], table, layout.polytopes, layout.probes, seed))
                        asking[low + np.arange(len(near))[:, None], near] = True
                for g in np.flatnonzero(asking.any(axis=0)):
                    at = np.flatnonzero(asking[:, g])
                    out.append((dim, table, int(g), True, int(leads[at[0]]), len(at), None, b"".join(digests[i] for i in at), None, b"".join(codes[i] for i in at)))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


class _Asked:
    """The queries of a block with the best candidates so far."""

    def __init__(self, dim: int, table: int, group: int, layout: Layout, names: list[bytes], codes: list[bytes], keep: int, seed: int):
        self.digests, self.keep = np.frombuffer(b"".join(names), "V16"), keep
        self.vecs = unit = _whole(codes, dim)
        self.probed = None
        if table != EVERY:
            probed, of = [], []
            for low in range(0, len(unit), ASKED):
                keys = bucket_keys(unit[low : low + ASKED], table, layout.polytopes, layout.probes, seed)
                at, nth = np.nonzero(layout.group(keys) == group)
                probed.append((keys[at, nth] - layout.start(group)).astype(np.int32))
                of.append((at + low).astype(np.int32))
            probed, of = np.concatenate(probed), np.concatenate(of)
            order = np.argsort(probed, kind="stable")
            self.probed, self.of = probed[order], of[order]
        self.least = np.full(len(self.vecs), -np.inf, dtype=np.float32)  # the score of a query's last candidate, once it has enough
        self.best = [np.empty(0, t) for t in (np.int64, np.float32, np.int64, np.int64)]  # query, score, smallest id, lead
        self.waiting, self.n = [], 0

    def meet(self, keys: np.ndarray, codes: np.ndarray, firsts: np.ndarray, leads: np.ndarray) -> None:
        """Scores points, bucket by bucket, against the queries that probe their buckets."""
        if self.probed is None:
            keys = np.zeros(len(keys), dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        for low in range(0, len(order), UNPACKED):
            at = order[low : low + UNPACKED]
            own, points = keys[at], unpacked(codes[at], self.vecs.shape[1])
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            if self.probed is None:
                spans = np.array([[0, len(self.vecs)]])
            else:
                spans = np.stack([np.searchsorted(self.probed, own[edge[:-1]], side) for side in ("left", "right")], axis=1)
            for a, b, (first, last) in zip(edge[:-1], edge[1:], spans, strict=True):
                if first < last:
                    self._score(at[a:b], points[a:b], np.arange(first, last) if self.probed is None else self.of[first:last], firsts, leads)
        self._keep()

    def _score(self, at: np.ndarray, points: np.ndarray, queries: np.ndarray, firsts: np.ndarray, leads: np.ndarray) -> None:
        step = max(1, PAIRS // len(queries))
        vecs = self.vecs[queries].T
        for low in range(0, len(at), step):  # as many points as give a bounded number of pairs
            own = points[low : low + step]
            score = np.round(own @ vecs + (1 - (own * own).sum(axis=1, keepdims=True)) / 2, 6)  # falls as the distance rises
            point, query = np.nonzero(score >= self.least[queries])  # the others are beaten already
            some = at[low + point]
            self.waiting.append((queries[query].astype(np.int64), score[point, query], firsts[some], leads[some]))
            self.n += len(some)
            if self.n > max(PAIRS, 2 * self.keep * len(self.vecs)):
                self._keep()

    def _keep(self) -> None:
        """The best ``keep`` of each query among those so far and those that wait."""
        parts = [np.concatenate(x) for x in zip(self.best, *self.waiting, strict=True)]
        order = np.lexsort((parts[2], -parts[1], parts[0]))
        start = np.flatnonzero(np.r_[True, np.diff(parts[0][order]) != 0]) if len(order) else np.zeros(0, dtype=int)
        nth = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        self.best = [x[order[nth < self.keep]] for x in parts]
        full = order[nth == self.keep - 1]
        self.least[parts[0][full]] = parts[1][full]
        self.waiting, self.n = [], 0

    def result(self) -> pd.DataFrame:
        query, score, first, lead = self.best
        edge = np.flatnonzero(np.r_[True, np.diff(query) != 0, True]) if len(query) else np.zeros(1, dtype=int)
        spans = list(zip(edge[:-1], edge[1:], strict=True))
        return pd.DataFrame({"q": [self.digests[query[a]].tobytes() for a, _ in spans], **{c: [x[a:b].tobytes() for a, b in spans] for c, x in (("scores", score), ("firsts", first), ("leads", lead))}})


def _search(keep: int, probes: float, rows: int, fill: float, seed: int, centres: Centres):
    """The best ``keep`` candidates of each query in each block, whose codes a task holds: at most a portion of queries and one of points."""

    def found(block: tuple, asking: list, points: list) -> Iterator[pd.DataFrame]:
        if asking and points:
            dim, table, group, _ = block
            asked = _Asked(dim, table, group, Layout(rows, dim, fill, probes), *map(list, zip(*asking, strict=True)), keep, seed)
            keys, codes, firsts, leads = (b"".join(x) for x in zip(*points, strict=True))
            asked.meet(np.frombuffer(keys, np.int32), np.frombuffer(codes, np.uint8).reshape(-1, 2 * dim + 4), np.frombuffer(firsts, np.int64), np.frombuffer(leads, np.int64))
            yield asked.result()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, asking, points = None, [], []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if (key := (row.dim, row.tbl, row.bucket, row.portion)) != block:
                    yield from found(block, asking, points)
                    block, asking, points = key, [], []
                if row.query:
                    asking.append((row.names, row.codes))
                else:
                    points.append((row.keys, row.codes, row.firsts, row.names))
        yield from found(block, asking, points)

    return run


def _merged(keep: int):
    """(q, lead, first) of the best ``keep`` candidates of a query over all its blocks."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        score, first, lead = (np.frombuffer(b"".join(frame[c]), t) for c, t in (("scores", np.float32), ("firsts", np.int64), ("leads", np.int64)))
        _, once = np.unique(np.stack((lead, first)), axis=1, return_index=True)
        order = once[np.lexsort((first[once], -score[once]))[:keep]]
        return pd.DataFrame({"q": frame["q"].iloc[0], "lead": lead[order], "first": first[order]})

    return run


def _exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cosines of pairs of vectors whose point is named by its vector's digest; other vectors of an id go."""
    for frame in frames:
        q, digest, score = frame["q"].to_numpy(), [], []
        lead, asked = frame["lead"].to_numpy(), frame["asked"].to_list()
        at = []
        for i, x in _vectors(frame["vec"]):
            own = xxhash.xxh3_128_digest(_encoded(x))
            y = np.asarray(asked[i], dtype=np.float64)
            if len(y) == len(x) and np.frombuffer(own[:8], np.int64)[0] == lead[i]:
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                at.append(i)
                digest.append(own)
                score.append(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))))
        yield pd.DataFrame({"q": q[at], "digest": digest, "score": np.array(score, dtype=np.float64)})


def _named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(q, asked): vectors with their digests."""
    for frame in frames:
        found = [(xxhash.xxh3_128_digest(_encoded(x)), x) for _, x in _vectors(frame["vec"])]
        yield pd.DataFrame(found, columns=["q", "asked"])


def _dealt(hashed: DataFrame) -> DataFrame:
    """Rows with the block (``portion``) of their group: each portion of queries meets each portion of points in one.

    Groups without a query or without a point go. Whether the list of groups is
    broadcast, Spark decides by its size: it grows with the rows.
    """
    key = ["dim", "tbl", "bucket"]
    size = F.col("n") if "n" in hashed.columns else F.lit(1)
    portions = lambda of: F.ceil(F.sum(F.when(of, size)) / PORTION).cast("int")
    sizes = hashed.groupBy(*key).agg(portions(F.col("query")).alias("asking"), portions(~F.col("query")).alias("found"))
    out = hashed.join(sizes.where("asking > 0 and found > 0"), key)
    own = F.pmod("lead", F.when(F.col("query"), F.col("asking")).otherwise(F.col("found"))).cast("int")
    blocks = F.when(F.col("query"), F.transform(F.sequence(F.lit(0), F.col("found") - 1), lambda i: i * F.col("asking") + own)).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda i: own * F.col("asking") + i)
    )
    return out.withColumn("portion", F.explode(blocks)).drop("asking", "found")


def nearest(
    rows: DataFrame, k: int = 5, every: int = 50, tables: int = 4, probes: float = 6, fill: float = 16, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows by cosine of each row whose id is divisible by ``every``.

    Ties go to the smaller id; a row is no neighbour of its own id. Null, zero
    or non-finite vectors and null ids take no part; vectors are compared with
    those of their length. Rows with equal vectors are one point, named by a
    digest of 128 bits, with its ``k`` + 1 smallest ids, which is all that any
    answer can need; repeated rows of an id count once, and an id with several
    vectors is as near as the nearest of them. A query that finds fewer
    than ``k`` neighbours is compared with all rows. No rows give no rows; other
    columns are ignored. A query probes ``probes`` times the square root of the
    number of buckets in each table.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null")
    usable = rows.mapInPandas(_usable, "id long, dim int, digest binary, code binary")
    # the k + 1 smallest ids of every point, and whether a query is among all its ids
    order = W.partitionBy("digest").orderBy("id")
    ids = usable.select("digest", "id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    ids = ids.groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = usable.groupBy("digest").agg(F.first("dim").alias("dim"), F.first("code").alias("code"), F.max(F.col("id") % every == 0).alias("query"))
    points, points_at = written(points.join(ids, "digest").withColumn("first", F.col("ids")[0]), "points")
    count = points.count()
    asking = rows.where(F.col("id") % every == 0)
    queries, queries_at = written(asking.mapInPandas(_usable, "id long, dim int, digest binary, code binary").select(F.col("id").alias("query_id"), F.col("digest").alias("q")).distinct(), "queries")

    setting = (probes, count, fill, seed, centres_of(points))
    blobs = lambda n: points.select("dim", "digest", "first", "code").mapInPandas(_points(n, *setting), _SCHEMA)
    asked = points.where("query").select("dim", "digest", "code").mapInPandas(_queries(tables, *setting), _SCHEMA)
    answers = _answers(_found(blobs(tables).union(asked), k, *setting), rows, asking, points, queries, k)
    answers, answers_at = written(answers, "answers")

    # queries that found too few, though there may be more, see every row; expected for tiny or odd tables only
    short = queries.join(answers.groupBy("query_id").agg(F.count("*").alias("got")), "query_id", "left").where(F.coalesce("got", F.lit(0)) < k)
    short, short_at = written(short.select("query_id", "q"), "short")
    if not short.isEmpty():
        again = points.join(short.select(F.col("q").alias("digest")).distinct(), "digest", "left_semi").select("dim", "digest", "code")
        flat = lambda df: df.withColumn("tbl", F.lit(EVERY)).select(*_COLUMNS)
        every_point = flat(blobs(1))
        groups = every_point.select("dim", "bucket").distinct()
        alone = again.mapInPandas(_alone(setting[-1]), _SCHEMA)
        wide = flat(alone.drop("bucket").join(groups, "dim"))
        more = _answers(_found(every_point.union(wide), k, *setting), rows, asking, points, short, k)
        answers, _ = written(answers.join(short, "query_id", "left_anti").unionByName(more), "answers")
        remove(spark, answers_at)
    remove(spark, points_at, queries_at, short_at)
    return answers


def _alone(centres: Centres):
    """Queries as rows, each once, without a group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for dim, own, unit in _by_dim(frames, centres):
            n = len(own)
            yield pd.DataFrame({"dim": dim, "tbl": EVERY, "bucket": 0, "query": True, "lead": _leads(own["digest"]), "n": 1, "keys": [None] * n, "names": own["digest"].to_list(), "firsts": [None] * n, "codes": [eighths(x).tobytes() for x in unit]})

    return run


def _found(hashed: DataFrame, k: int, *setting) -> DataFrame:
    """(q, lead, first): candidates of each query, three for each that its answer may need."""
    block = ["dim", "tbl", "bucket", "portion"]
    # blocks are few and slow, and their rows large: a fixed number of tasks, which adaptive execution would merge
    tasks = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(hashed).repartition(tasks, *block).sortWithinPartitions(*block)
    found = dealt.mapInPandas(_search(3 * (k + 1), *setting), "q binary, scores binary, firsts binary, leads binary")
    return found.groupBy("q").applyInPandas(_merged(3 * (k + 1)), "q binary, lead long, first long")


def _answers(found: DataFrame, rows: DataFrame, asking: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """From candidate points of query points to the ranked ids of every query.

    A candidate's vector is read from the row of its smallest id.
    """
    asked = asking.mapInPandas(_named, "q binary, asked array<double>").dropDuplicates(["q"])
    pairs = found.join(rows.select(F.col("id").alias("first"), "vec"), "first").join(asked, "q")
    best = pairs.select("q", "lead", "asked", "vec").mapInPandas(_exact, "q binary, digest binary, score double")
    best = best.groupBy("q", "digest").agg(F.max("score").alias("score")).join(points.select("digest", "ids"), "digest")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    flat = best.select("q", "score", F.explode("ids").alias("id")).groupBy("q", "id").agg(F.max("score").alias("score"))
    flat = flat.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = flat.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("id"), F.col("score")))).alias("near"))
    out = queries.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("id"), F.col("col.score").alias("score"))
