"""Near-duplicate documents by fast similarity sketching, banding and exact checks.

A document's set holds its distinct 5-word shingles. The sketch has ``SIZE``
coordinates that are filled in rounds: a round throws every shingle into a
hashed bin with a hashed value, rounds are kept apart by their number in the
high bits, and the smallest value of a bin stays. Rounds end as soon as all
bins are filled; round SIZE + i throws everything into bin i, so that every
coordinate is filled after 2 * SIZE rounds for sure, whatever the set.

``BANDS`` bands of ``ROWS`` coordinates become bucket keys. A pair at the
threshold of 0.85 shares no bucket with probability (1 - 0.85^5)^24, below 1e-6.

Documents with equal sets are one class from the start, so copies never meet in
a bucket. A class is named by its smallest id and a digest of its set, in this
order, so a component's smallest class tells its smallest id. Every member of a bucket is checked against the bucket's hubs (the
members that meet most others): against all others in small buckets, against one
in large ones; components are formed. Large buckets that still hold several
components go on, in blocks of at most two ``PORTION`` members: pairs of
different components are compared by their sketches in numpy, in the first
bucket that they share, and only those that may be links leave the block. So no
link between components is lost, and what is emitted does not grow with the
square of a bucket. Pairs whose sketches agree in too few coordinates for the
threshold (by more than five standard deviations) are no candidates; all others
are checked on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, gram_hashes, join_by_size, lowered, mix64, remove, row_key, word_hashes, written
from .components import components

SHINGLE, SIZE, BANDS, ROWS = 5, 480, 24, 5
#: Members of a small bucket, which has as many hubs as are needed to check all its pairs at once.
SMALL = 12
#: Members of a large bucket that meet as many others in one block.
PORTION = 4096
#: Equal coordinates that a pair needs: 408 are expected at a similarity of 0.85, with a deviation of 7.8.
AGREE = 368
#: Words that are sketched at once; bounds the memory of a task.
BATCH = 400_000


def sketch(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """Fast similarity sketches of non-empty sets of 64-bit hashes, one row each."""
    n = len(sets)
    out = np.full(n * size, np.iinfo(np.uint64).max, dtype=np.uint64)
    flat, lengths = np.concatenate(sets), np.array([len(s) for s in sets])
    owner, live = np.repeat(np.arange(n), lengths), np.arange(n)
    for i in range(2 * size):
        with np.errstate(over="ignore"):
            h = mix64(flat ^ (np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)))
        bins = ((h >> np.uint64(40)) * np.uint64(size)) >> np.uint64(24) if i < size else np.uint64(i - size)
        value = (np.uint64(i) << np.uint64(40)) | (h & np.uint64(0xFFFFFFFFFF))
        np.minimum.at(out, owner * size + bins.astype(np.int64), value)
        full = (out.reshape(n, size)[live] != np.iinfo(np.uint64).max).all(axis=1)
        if full.all():
            break
        if full.any():
            open_ = np.zeros(n, dtype=bool)
            open_[live[~full]] = True
            keep, live = open_[owner], live[~full]
            flat, owner = flat[keep], owner[keep]
    return out.reshape(n, size)


def bands(sketches: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each of the first ``count`` bands of ``rows`` coordinates."""
    parts = sketches[:, : count * rows].reshape(len(sketches), count, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), parts.shape[:2])
        for i in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return h


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return np.unique(gram_hashes(word_hashes(lowered(text)), SHINGLE))


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _agreeing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            a, b = (np.frombuffer(b"".join(frame[c]), dtype=np.uint8).reshape(len(frame), -1) for c in ("digest", "hub_digest"))
            frame = frame[(a == b).sum(axis=1) >= AGREE]
        yield frame[["cls", "hub"]]


def agreeing(pairs: DataFrame, digests: DataFrame) -> DataFrame:
    """Those of ``pairs`` (cls, hub) whose sketches leave it open that they are similar."""
    both = pairs.join(digests, "cls").join(digests.select(F.col("cls").alias("hub"), F.col("digest").alias("hub_digest")), "hub")
    return both.select("cls", "hub", "digest", "hub_digest").mapInPandas(_agreeing, "cls binary, hub binary")


def _meet(threshold: float):
    """Pairs of one block's rows (side 0 with side 1, or within a portion) that may be links of different components."""
    percent = round(threshold * 100)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.array(frame["keys"].tolist(), dtype=np.int64)
        digest = np.frombuffer(b"".join(frame["digest"]), dtype=np.uint8).reshape(len(frame), -1)
        comp, n, portion = pd.factorize(frame["comp"])[0], frame["n"].to_numpy(), frame["portion"].to_numpy()
        band = int(np.flatnonzero((keys == frame["key"].iloc[0]).all(axis=0))[0])
        within = frame["low"].iloc[0] == frame["high"].iloc[0]
        left = np.flatnonzero(portion == frame["low"].iloc[0])
        right = np.flatnonzero(portion == frame["high"].iloc[0])
        a, b = [], []
        for at in left:
            others = right[right > at] if within else right
            others = others[comp[others] != comp[at]]
            others = others[100 * np.minimum(n[others], n[at]) >= percent * np.maximum(n[others], n[at])]
            # an earlier band that both share has the pair already
            others = others[~(keys[others, :band] == keys[at, :band]).any(axis=1)]
            others = others[(digest[others] == digest[at]).sum(axis=1) >= AGREE]
            a += [at] * len(others)
            b += others.tolist()
        return pd.DataFrame({"cls": frame["cls"].iloc[b].to_numpy(), "hub": frame["cls"].iloc[a].to_numpy(), "portion": frame["block"].iloc[0]})

    return run


def meetings(rows: DataFrame, threshold: float) -> DataFrame:
    """(cls, hub, portion): pairs of different components that share a bucket and whose sketches leave it open that they are similar.

    ``rows`` are (key, cls, n, comp, keys, digest), and met, how many a bucket has,
    where it is known. A bucket is cut into portions, and every two portions
    meet in a block, which one task holds and whose hash is the portion.
    """
    if "met" not in rows.columns:
        rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("met")), "key")
    dealt = rows.withColumn("portions", F.ceil(F.col("met") / PORTION)).withColumn("portion", F.pmod(F.xxhash64("cls"), F.col("portions")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)))
    dealt = dealt.withColumns({"low": F.least("portion", "other"), "high": F.greatest("portion", "other")})
    dealt = dealt.withColumn("block", F.xxhash64("key", "low", "high"))
    return dealt.groupBy("key", "low", "high").applyInPandas(_meet(threshold), "cls binary, hub binary, portion long")


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sets, counts, classes, first, words = [], [], [], 0, 0

        def done(upto: int):
            filled = [i for i, s in enumerate(sets) if len(s)]
            keys, digests = [None] * len(sets), [None] * len(sets)
            if filled:
                sketches = sketch([sets[i] for i in filled])
                short = mix64(sketches).astype(np.uint8)
                for j, (i, row) in enumerate(zip(filled, bands(sketches).view(np.int64), strict=True)):
                    keys[i], digests[i] = row, short[j].tobytes()
            return pd.DataFrame({"id": frame["id"].iloc[first:upto], "row": frame["row"].iloc[first:upto], "n_shingles": counts, "cls": classes, "keys": keys, "digest": digests})

        for i, text in enumerate(frame["text"]):
            s = shingles(text)
            sets.append(s)
            counts.append(len(s))
            classes.append(_digest(s) if len(s) else None)
            words += len(s)
            if words > BATCH:
                yield done(i + 1)
                sets, counts, classes, first, words = [], [], [], i + 1, 0
        if sets:
            yield done(len(frame))


def _confirm(threshold: float):
    """Checks members (role 1) against the hub (role 0) that precedes them, on full sets."""
    percent = round(threshold * 100)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, hub_set = None, None
        for frame in frames:
            a, b = [], []
            for group, cls, role, text in zip(frame["hub"], frame["cls"], frame["role"], frame["text"], strict=True):
                s = shingles(text)
                if role == 0:
                    hub, hub_set = bytes(group), s
                elif hub == bytes(group):
                    common = len(np.intersect1d(s, hub_set, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(hub_set) - common):
                        a.append(bytes(cls))
                        b.append(hub)
            yield pd.DataFrame({"a": a, "b": b})

    return run


def confirm(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (cls, hub) whose sets are similar, as (a, b).

    Members come to their hub in portions of at most some hundreds, each led by
    the hub's text, so a hub with very many members is spread over tasks. Pairs
    of a block have their portion already.
    """
    dealt = pairs
    if "portion" not in pairs.columns:
        portions = pairs.groupBy("hub").agg(F.ceil(F.count("*") / 256).alias("portions"))
        dealt = pairs.join(portions, "hub").withColumn("portion", F.pmod(F.xxhash64("cls"), F.col("portions")))
    members = dealt.join(texts, "cls").select("hub", "portion", F.lit(1).alias("role"), "cls", "text")
    leads = dealt.select("hub", "portion").distinct().join(texts.withColumnRenamed("cls", "hub"), "hub")
    leads = leads.select("hub", "portion", F.lit(0).alias("role"), F.col("hub").alias("cls"), "text")
    rows = members.union(leads).repartition("hub", "portion").sortWithinPartitions("hub", "portion", "role")
    return rows.mapInPandas(_confirm(threshold), "a binary, b binary")


def _name(lead, cls):
    """The name of a class: whether it has no id, its smallest id in the order of bytes, and the digest of its set."""
    number = F.unhex(F.lpad(F.hex(F.coalesce(lead, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(lead.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), number, cls)


def _lead_of(name):
    """The smallest id in a class's name."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number)


def _once(rows: DataFrame) -> DataFrame:
    """One of the rows with the same ``row``; those that repeat in a partition are cut down before they are shuffled."""
    return rows.withColumn("copy", F.row_number().over(W.partitionBy("row").orderBy("row"))).where("copy = 1").drop("copy")


def grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, list[str]]:
    """A row for each of ``docs``, written, and the tables to remove after it.

    (id, row, n_shingles, component, first): ``row`` names the row by id and
    text, ``component`` is the name of its group's first class (null without
    words), and ``first`` tells the rows of the group's first id and class.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("row", row_key("id", "text"))
    # ids go through Python as texts, where whole numbers beside nulls would be rounded
    described = base.withColumn("id", F.col("id").cast("string")).mapInPandas(_describe, "id string, row binary, n_shingles long, cls binary, keys array<long>, digest binary")
    described, described_at = written(described.withColumn("id", F.col("id").cast("long")), "sketches")
    total = described.count()

    # a row for each class: whichever member it is read from, keys and digest are the same
    known = described.where("cls is not null")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    leads = known.groupBy("cls").agg(least, F.count("*").alias("members"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("digest").alias("digest"))
    leads = leads.select(_name(F.col("least.id"), F.col("cls")).alias("cls"), F.col("cls").alias("set"), F.col("least.row").alias("row"), "members", "n", "keys", "digest")
    leads, leads_at = written(leads, "leads")
    entries = leads.select("cls", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    met, met_at = written(join_by_size(entries, shared, "key", "met", BANDS * total), "buckets")

    degree, degree_at = written(met.groupBy("cls").agg(F.sum("met").alias("degree")), "degrees")
    chosen = leads.join(degree, "cls").select("row", "cls", "digest")
    # texts grow with the rows and so do the candidates: neither side is broadcast
    texts = _once(base.select("row", "text")).join(chosen.select("row", "cls").hint("merge"), "row")
    texts, texts_at = written(texts.select("cls", "text"), "texts")
    digests = chosen.select("cls", "digest")

    met = met.join(degree, "cls").select("key", "cls", "n", "met", "degree")
    percent = F.lit(round(threshold * 100))
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    below = F.struct("degree", "cls") < F.struct(F.col("hub_degree").alias("degree"), F.col("hub").alias("cls"))

    # the hubs of a small bucket are all but its least member, that of a large one is its greatest
    member = F.struct("degree", "cls", "n", "met")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("degree"), F.desc("cls")))
    small = met.where(F.col("met") <= SMALL + 1).withColumn("rank", rank).where(F.col("rank") <= SMALL).select("key", member.alias("hub"))
    hubs = small.unionByName(met.where(F.col("met") > SMALL + 1).groupBy("key").agg(F.max(member).alias("hub")))
    hubs = hubs.select("key", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.degree").alias("hub_degree"), F.col("hub.met").alias("hub_met"))
    pairs = join_by_size(met.drop("met"), hubs, "key", "hub_met", max(BANDS * total, 1000 * (SMALL + 1))).where(below & alike)
    pairs, pairs_at = written(pairs.select("cls", "hub").distinct(), "pairs")
    links, links_at = written(confirm(agreeing(pairs, digests), texts, threshold), "links")
    labels, labels_at = written(components(links), "labels")

    # large buckets of several components: what is left between the components
    large = met.where(F.col("met") > SMALL + 1)
    parts = large.join(labels, large.cls == labels.node, "left").select("key", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    several = parts.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("met")).where(F.col("low") != F.col("high"))
    parts = join_by_size(parts, several.select("key", "met"), "key", "met", BANDS * total).join(leads.select("cls", "keys", "digest"), "cls")
    rest, parts_at = written(meetings(parts, threshold), "meetings")
    more, more_at = written(confirm(rest, texts, threshold), "links")
    if more.limit(1).count():
        labels, again_at = written(components(links.union(more)), "labels")
        remove(spark, labels_at)
        labels_at = again_at

    # from classes to rows: the rows of classes with very many members stay where they are
    table = leads.select("cls", "set", F.col("row").alias("first_row"), "members").join(labels, F.col("cls") == F.col("node"), "left")
    table = table.select(F.col("set").alias("cls"), F.coalesce("component", "cls").alias("component"), F.when(F.coalesce("component", "cls") == F.col("cls"), F.col("first_row")).alias("first_row"), "members")
    rows = join_by_size(known.select("id", "row", "n_shingles", "cls"), table, "cls", "members", total)
    rows = rows.select("id", "row", "n_shingles", "component", F.coalesce(F.col("row") == F.col("first_row"), F.lit(False)).alias("first"))
    blank = described.where("cls is null").select("id", "row", "n_shingles", F.lit(None).cast("binary").alias("component"), F.lit(True).alias("first"))
    rows, rows_at = written(rows.unionByName(blank), "near")
    remove(spark, described_at, leads_at, met_at, degree_at, texts_at, pairs_at, links_at, labels_at, parts_at, more_at)
    return rows, [rows_at]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.85) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links), kept.

    Null or blank texts have an empty set and are linked with nothing. Rows are
    the nodes: rows with equal texts are linked, equal ids alone link nothing.
    A null id is never a component_id, and such a row is not kept. No rows give
    no rows. Other columns of ``docs`` are ignored.
    """
    rows, _ = grouped(docs, id_col, text_col, threshold)
    out = rows.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("component").isNull(), F.col("id")).otherwise(_lead_of(F.col("component"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.85) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``: a row of the group's smallest id.

    A group whose rows all have a null id keeps one of them. Of rows that repeat
    in id and text one stays; rows that share only an id are told apart by their
    texts. Rows without words are near nothing, so all of them stay.
    """
    rows, _ = grouped(docs, id_col, text_col, threshold)
    gone = rows.where(~F.col("first")).select("row").distinct()
    named = docs.select(F.struct(*docs.columns).alias("doc"), row_key(F.col(id_col).cast("long"), F.col(text_col)).alias("row"))
    filled = F.coalesce(F.col(f"doc.{text_col}").rlike(WORD), F.lit(False))
    kept = _once(named.where(filled)).join(gone.hint("merge"), "row", "left_anti").select("doc.*")
    return kept.unionByName(named.where(~filled).select("doc.*"))
