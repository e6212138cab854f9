"""Periodic runs, whitening and the quality ranking: against brute force, held-out accuracy, and odd input."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from test_llm_operators import LONG, empty_documents, odd_documents
from tidemark.llm import entry, periodic, quality, whitening

# ── 11 periodic runs ────────────────────────────────────────────────────────


def all_runs(words, least=periodic.LEAST, power=periodic.POWER):
    """Every period at every place."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng, kind):
    n = rng.randint(1, 150)
    if kind == "few":
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == "one":
        return [0] * n
    if kind == "powers":
        out = []
        while len(out) < n:
            out += [rng.randint(0, 3) for _ in range(rng.randint(1, 12))] * rng.randint(1, 7)
        return out
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
    return ([9] + unit * rng.randint(3, 6) + [8] + unit * 9 + [7]) * rng.randint(1, 4)  # runs within copied blocks


@pytest.mark.parametrize("least, power", [(24, 3), (6, 3), (3, 3), (8, 4)])
@pytest.mark.parametrize("kind", ["few", "one", "powers", "fibonacci", "nested"])
def test_runs_are_those_of_every_period(kind, least, power):
    rng = random.Random(f"{kind}{least}{power}")
    for _ in range(40):
        texts = [made(rng, kind) for _ in range(rng.randint(1, 6))]
        got = periodic.runs_of([np.array(t) for t in texts], least, power)
        assert got == [all_runs(t, least, power) for t in texts]


def test_longest_previous_factors():
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.randint(0, 2) for _ in range(rng.randint(1, 60))]
        n = len(w)
        order = sorted(range(n), key=lambda i: w[i:])
        same = lambda a, b: next((k for k in range(n - max(a, b)) if w[a + k] != w[b + k]), n - max(a, b))
        length, source = periodic.previous_factors(order, [0] + [same(a, b) for a, b in zip(order, order[1:], strict=False)])
        assert length == [max([same(i, j) for j in range(i)], default=0) for i in range(n)]
        assert all(source[i] < i and same(i, source[i]) == length[i] for i in range(n) if length[i])


def digest_of(doc_id, text):
    """A document's row, word by word."""
    words = text.encode().split() if text else []
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *strongest, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_digests_of_odd_rows(spark):
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    more = spark.createDataFrame([(i, " ".join(f"w{k * i % 97}" for k in range(60 + i))) for i in planted] + [(7, "a b " * 30), (8, "x y z " * 9 + "ä " * 24)], "doc_id long, text string")
    docs = odd_documents(spark)
    for rows in (docs, more):
        got = sorted(map(tuple, periodic.digests(rows).collect()), key=str)
        assert got == sorted((digest_of(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()), key=str)
    assert periodic.digests(empty_documents(spark)).count() == 0


def test_collapsed_texts(spark):
    docs = odd_documents(spark).withColumn("runs", F.lit("clash"))
    rows = {(r["doc_id"], r["text"]): r for r in periodic.collapse(docs).collect()}
    assert len(rows) == docs.distinct().count() and set(docs.columns) < set(next(iter(rows.values())).asDict())
    long = rows[5, LONG]
    assert long["collapsed"] == "word" and [tuple(x) for x in long["runs"]] == [(0, 40_000, 1)]
    assert all(r["collapsed"] == text and not r["runs"] for (i, text), r in rows.items() if i != 5)


def test_portions_of_texts_give_the_same(monkeypatch):
    rng = random.Random(5)
    texts = [[f"{x}".encode() for x in made(rng, "powers")] for _ in range(30)]
    whole = [runs for _, runs in periodic.detected(texts)]
    monkeypatch.setattr(periodic, "TOGETHER", 100)
    assert [runs for _, runs in periodic.detected(texts)] == whole


# ── 12 whitening ────────────────────────────────────────────────────────────


def exact_covariance(x):
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    c = [[Fraction(v) - Fraction(s, n) for v, s in zip(row, sums, strict=True)] for row in x]
    return [[sum(r[i] * r[j] for r in c) / n for j in range(len(sums))] for i in range(len(sums))]


def test_sums_of_outer_products_are_nearly_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**9), 10**9, (50, 4))
    mean = tuple(np.array(p) for p in zip(*[whitening.as_pair(Fraction(int(s), 50)) for s in x.sum(axis=0)], strict=True))
    high, low = whitening.outer_sum(*whitening.centred(x, mean))
    want = exact_covariance(x.tolist())
    for i in range(4):
        for j in range(4):
            got = (Fraction(high[i, j]) + Fraction(low[i, j])) / 50
            assert abs(got - want[i][j]) <= abs(want[i][j]) * Fraction(1, 2**95) + Fraction(1, 2**40)


def test_a_large_offset_does_not_swallow_the_variance():
    x = np.array([[2**52 + v, -(2**52) + 3 * v] for v in (-1, 0, 1, 5)])
    mean = tuple(np.array(p) for p in zip(*[whitening.as_pair(Fraction(int(s), 4)) for s in x.sum(axis=0)], strict=True))
    high, low = whitening.outer_sum(*whitening.centred(x, mean))
    want = exact_covariance(x.tolist())
    assert (high + low)[0, 0] / 4 == float(want[0][0]) and (high + low)[0, 1] / 4 == float(want[0][1])


def test_whitened_embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, x.values())))
    sums, n = [sum(c) for c in zip(*fit, strict=True)], len(fit)
    found = entry.op12_whitening(spark, SF).toPandas()
    assert sorted(zip(found["vec_id"], found["component"], strict=True)) == sorted((i, k) for i in x for k in (1, 2, 3, 4))
    assert set(found["n"]) == {n} and found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-9
    deviation = found.set_index("vec_id")["deviation"].groupby(level=0).first()
    assert all(deviation[i] == sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for i, row in x.items())
    cov = np.cov(np.array(fit, dtype=float).T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    got = found.pivot_table(index="vec_id", columns="component", values="whitened")
    for k in (1, 2, 3, 4):
        assert found.loc[found["component"] == k, "explained"].to_numpy() == pytest.approx(values[-k] / np.trace(cov), rel=1e-9)
        own = np.array([np.array(x[i]) - np.array(sums) / n for i in got.index]) @ vectors[:, -k] / math.sqrt(values[-k])
        sign = np.sign(own @ got[k].to_numpy())
        assert np.abs(own * sign - got[k].to_numpy()).max() < 1e-8


VECTORS = "vec_id long, embedding array<double>"


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [0.5]), (8, [1.0, 1.0]), (9, [1.0, 1.0, 1.0, 1.0, 1.0])]
    given = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "x", "n", "d", "component")})
    found = whitening.whiten(given).toPandas()
    assert found.fillna({"vec_id": -1}).groupby("vec_id").size().to_dict() == {-1: 2, 1: 4, 7: 1, 8: 2, 9: 4}
    two = found[found["vec_id"].isin([1, 8]) | found["vec_id"].isna()]
    assert set(two["n"]) == {3} and two["whitened"].notna().all()
    alone = found[found["vec_id"].isin([7, 9])]
    assert alone["whitened"].isna().all() and (alone["explained"] == 0).all() and alone["identity_error"].isna().all() and (alone["deviation"] == 0).all()
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_deviations_beyond_a_long_are_null(spark):
    found = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], VECTORS)).toPandas()
    assert found[found["vec_id"] < 3]["deviation"].isna().all() and set(found[found["vec_id"] == 3]["deviation"]) == {(3 * 512 - 768) ** 2}
    assert (found["whitened"].notna() == (found["component"] == 1)).all()  # the other variance lies below the rounding of the first


def test_partial_sums_merge_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(400)], VECTORS).repartition(16)
    order = ["vec_id", "component"]
    whole = whitening.whiten(rows).toPandas().sort_values(order)
    monkeypatch.setattr(whitening, "FAN", 2)
    parts = whitening.whiten(rows).toPandas().sort_values(order)
    assert np.abs(whole["whitened"].abs().to_numpy() - parts["whitened"].abs().to_numpy()).max() < 1e-12


def test_close_eigenvalues_are_told_apart():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    values = np.array([3.0, 3.0 - 1e-9, 2.0, 1.0, 0.5, 0.0])
    got, vectors = whitening.eigen(((q * values) @ q.T, np.zeros((6, 6))), 4)
    assert got == pytest.approx(values[:4], rel=1e-12)
    matrix = (q * values) @ q.T
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-14 * 6


# ── 13 quality ──────────────────────────────────────────────────────────────


def test_held_out_labels_are_predicted(spark):
    found = entry.op13_quality(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(found) == len(docs) and found["score"].between(0, 1).all() and (found["predicted"] == (found["score"] >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(found["doc_id"], found["held_out"], strict=True))
    both = found.merge(labels, on="doc_id")
    both = both[both["held_out"] & both["quality"].notna()]
    assert len(both) > 20 and (both["predicted"] == both["quality"]).mean() > 0.95


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(quality.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    a, b = ({r["doc_id"]: r["score"] for r in quality.rank(d, x).collect()} for d, x in ((docs, labels), (moved, wrong)))
    assert a == pytest.approx(b)


def test_newton_finds_the_least_loss(spark):
    """No other weights near have a smaller loss over the pairs, counted one by one."""
    rng = np.random.default_rng(0)
    ones, n = 30, 50
    vectors = np.zeros((n, quality.SIZE), dtype=np.float32)
    vectors[:, :3] = rng.normal(size=(n, 3)) + (np.arange(n) < ones)[:, None] * [0.8, 0.2, 0.0]
    blocks = spark.createDataFrame([(0, ones, n, vectors.tobytes())], "block long, ones int, n int, vectors binary")
    model = quality.fit(blocks)
    z = np.clip((vectors - model.mean) / model.scale, -8, 8)
    met = quality._meetings(ones, n - ones)
    pairs = [(i, ones + j, met[i, j]) for i in range(ones) for j in range(n - ones) if met[i, j]]
    assert sum(m for *_, m in pairs) == ones * min(quality.ROUNDS, n - ones) and max(m for *_, m in pairs) == 1

    def loss(w):
        return sum(m * math.log1p(math.exp(-(z[i] - z[j]) @ w)) for i, j, m in pairs) / met.sum() + quality.RIDGE / 2 * (w @ w)

    least = loss(model.weights)
    for k in range(3):
        for move in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += move
            assert loss(w) > least


def test_cut_is_the_quantile_of_label_one():
    raw, label = np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([0, 1, 0, 1, 1])
    assert quality.cut_of(raw, label, {0: 2, 1: 3}) == pytest.approx(0.25)
    assert quality.cut_of(raw, label, {0: 20, 1: 3}) == pytest.approx(0.35)  # label 0 stands for more documents than are here


def test_quality_of_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.rank(docs, none).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.5} and set(docs.columns) <= set(rows[0].asDict())
    odd = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, None), (4, 7), (None, 1), (7, 0), (7, 0), (6, 1), (99, 1)], "doc_id long, quality int")
    assert [i for i in (1, 7) if zlib.crc32(str(i).encode()) % 3 != 1] == [1, 7]
    more = docs.withColumn("score", F.lit("clash")).unionByName(spark.createDataFrame([(7, "### $$$ *** &&&"), (7, "%%%")], "doc_id long, text string"), allowMissingColumns=True)
    rows = quality.rank(more, odd).collect()
    assert len(rows) == more.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert {r["predicted"] for r in rows if r["doc_id"] == 1 and "fox" in r["text"]} == {1} and {r["predicted"] for r in rows if r["text"] == "%%%"} == {0}
    assert quality.rank(empty_documents(spark), odd).count() == 0


def test_features_of_long_texts_are_those_of_their_pieces(monkeypatch):
    text = "Some Words, and digits 12; again.\n" * 40
    whole = quality.features(text)
    monkeypatch.setattr(quality, "PIECE", 57)
    assert quality.features(text) == pytest.approx(whole)
    assert not quality.features(None).any() and not quality.features("").any()


def test_quality_learns_from_every_labelled_document(spark):
    """More documents than a fit once saw: each counts, and so do the scores of all for the cut."""
    texts = ["plain words of a calm story go here", "$$$ !!! ### ???"]
    docs = spark.range(10_600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, texts[0]).otherwise(texts[1]).alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    fitted = quality.fit
    quality.fit = lambda blocks: (seen.append(blocks.agg(F.sum("n")).first()[0]), fitted(blocks))[1]
    try:
        model = quality.train(docs, labels)
    finally:
        quality.fit = fitted
    assert seen == [10_600]
    raw = model.raw(np.array([quality.features(t) for t in texts]))
    assert abs(model.cut - raw.mean()) < 1e-9 and raw[0] > raw[1]


def test_few_texts_without_a_label_are_shuffled(spark):
    docs = spark.range(-20_000, 20_000).selectExpr("if(id % 7 = 0, null, id) AS id", "concat('text ', id) AS text")
    keys = docs.where("id % 40 = 3").select("id").distinct()
    count = keys.count()
    met = {r["id"] for r in quality._among(docs, keys, count).collect()}
    assert count > 400 and {r["id"] for r in keys.collect()} <= met and len(met) < 40_000 / 8
    assert quality._among(docs, keys.limit(0), 0).count() == 0
    assert len({r["id"] for r in quality._among(docs, keys, 0).collect()}) > 30_000  # no room: all may be among them


def test_score_is_that_of_the_row_alone():
    """Sums and exponentials are rounded for each text by itself."""
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(size=quality.SIZE), rng.uniform(0.1, 2, quality.SIZE), rng.normal(size=quality.SIZE), 0.3)
    vectors = rng.normal(size=(40, quality.SIZE)).astype(np.float32)
    alone = [math.fsum(quality._standard(v, model.mean, model.scale) * model.weights) for v in vectors]
    assert model.raw(vectors).tolist() == alone
    assert model.scores(vectors).tolist() == [1 / (1 + math.exp(-min(max(x - 0.3, -30), 30))) for x in alone]
    assert len(model.raw(vectors[:0])) == len(model.scores(vectors[:0])) == 0


def test_cut_of_scores_that_no_task_holds(spark):
    rng = np.random.default_rng(3)
    for n, ones in ((7, 3), (50, 1), (40, 39)):
        raw, label = rng.normal(size=n), np.arange(n) < ones
        shares = {1: ones, 0: n - ones}
        held = spark.createDataFrame(list(zip(label.astype(int).tolist(), raw.tolist())), "label int, raw double")
        assert abs(quality.whole_cut(held, shares) - quality.cut_of(raw, label.astype(int), shares)) < 1e-12
