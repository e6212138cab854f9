"""Expected values for odd rows, ties and repeated rows, and brute force where SQL can't express an operator."""

import html.parser
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF
from test_llm_operators import DOCS, odd_documents
from tidemark.llm import ann, entry, html_text, langid, minhash, mixing, pii, sharding, token_shards

TEXT = "the quick brown fox jumps over the lazy dog again and again"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# ── 1 mixing ────────────────────────────────────────────────────────────────


def levelled(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again what lies above the limit, one source after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    held, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(most * sizes[s] for s in held)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: most * sizes[s] for s in held}
        held |= over


def test_mixing_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.plan(docs).collect()
    given = [(r["doc_id"], r["source"], words(r["text"])) for r in docs.collect()]
    key = lambda x: [(v is not None, v) for v in x]
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in rows), key=key) == sorted(given, key=key)
    sizes = {}
    for _, source, size in given:
        sizes[source] = sizes.get(source, 0) + size
    want = levelled(sizes)
    for source, target in want.items():
        own = [r for r in rows if r["source"] == source]
        assert all(r["target"] == pytest.approx(target) and r["source_size"] == sizes[source] and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert sum(r["taken"] for r in own) == pytest.approx(target, abs=1)
        assert sorted(r["before"] for r in own if r["size"]) == np.cumsum([0] + [r["size"] for r in sorted(own, key=lambda r: r["before"]) if r["size"]])[:-1].tolist()


def test_mix_reads_rows_as_often_as_planned(spark):
    """Rows that share an id, rows without one, and rows that repeat, each by their own plan."""
    rows = [(1, "a " * 10, "en", "x", 1), (1, "b " * 30, "en", "x", 2), (None, "c " * 20, "de", "x", 3), (None, "d " * 5, "de", "y", 4), (2, "e " * 7, "en", "y", 5), (2, "e " * 7, "en", "y", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    copies = {}
    for r in mixing.plan(docs).collect():
        copies[r["doc_id"], r["source"], r["size"]] = copies.get((r["doc_id"], r["source"], r["size"]), 0) + r["copies"]
    got = {}
    for r in mixing.mix(docs).collect():
        at = (r["doc_id"], r["source"], words(r["text"]))
        got[at] = got.get(at, 0) + 1
    assert got == {k: v for k, v in copies.items() if v} and sum(got.values()) > 4


def test_places_follow_positions(spark):
    rows = mixing.ordered_plan(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("training_place").collect()
    assert [r["training_place"] for r in rows] == list(range(len(rows)))
    assert all(a["first_position"] <= b["first_position"] for a, b in zip(rows, rows[1:], strict=False))


# ── 2 near duplicates ───────────────────────────────────────────────────────


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd_documents(spark)).collect()), key=str)
    want = [
        (1, 8, 1, True), (1, 8, 1, True), (1, 7, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 6, True),
        (None, 5, None, False), (None, 0, None, False),
    ]
    assert got == sorted(want, key=str)


def test_names_of_classes_keep_the_order_of_ids(spark):
    ids = [-(2**63), -5, 0, 7, 2**53 + 1, 2**63 - 1, None]
    rows = spark.createDataFrame([(i,) for i in reversed(ids)], "id long").select("id", minhash._name(F.col("id"), F.unhex(F.lit("ff"))).alias("name")).orderBy("name")
    assert [r["id"] for r in rows.collect()] == ids
    assert [r[0] for r in rows.select(minhash._lead_of(F.col("name"))).collect()] == ids


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame([(big, TEXT), (None, TEXT), (big + 2, TEXT)], "doc_id long, text string")).collect()}
    assert got == {(big, big), (None, big), (big + 2, big)}


def test_one_row_of_a_group_stays(spark):
    """Rows that share an id are told apart by their texts; rows that repeat count once; null ids, blanks and other columns."""
    other, third = " ".join(f"u{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20))
    rows = [(0, TEXT, "a"), (1, TEXT, "b"), (1, other, "c"), (1, other, "d"), (None, TEXT, "e"), (None, third, "f"), (None, third, "g"), (2, None, "h"), (2, None, "i"), (3, " ", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("doc", F.lit(1))
    got = minhash.representatives(docs)
    assert got.columns == docs.columns
    kept = sorted(r["row"] for r in got.collect())
    assert kept in ([*"a", x, y, *"hij"] for x in "cd" for y in "fg")
    assert minhash.representatives(docs.where("false")).count() == 0


# ── 3 sharding ──────────────────────────────────────────────────────────────


def test_shards_against_one_loop(spark):
    """The law of bytes on the default 40 shards, with ties in id and text."""
    docs = odd_documents(spark).unionByName(odd_documents(spark))
    rows = []
    for r in docs.collect():
        data = None if r["text"] is None else r["text"].encode()
        rows.append((r["doc_id"], len(data or b"") + 16, None if data is None else zlib.crc32(data)))
    rows.sort(key=lambda r: [(v is not None, v or 0) for v in (r[0], r[2], r[1])])
    total, before, slots, want = sum(r[1] for r in rows), 0, {}, []
    for doc, size, crc in rows:
        shard = min(39, (2 * before + size) * 40 // (2 * total))
        want.append((doc, size, crc, "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    got = [tuple(r) for r in sharding.shard(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# ── 4 language ──────────────────────────────────────────────────────────────


def test_grams_across_cuts_are_counted(monkeypatch):
    text = "Über 30 kleine   Wörter, dann mehr! " * 7
    count = lambda: np.sort(np.concatenate([b for b, _ in langid._pieces([text, "ab", None, "", text])]))
    whole = count()
    for piece in (1, 2, 3, 10, 37, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (count() == whole).all()


def test_language_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"guess": F.lit("mine"), "score": F.lit("own"), "held_out": F.lit(3)})
    found = corpus_pipeline.language(spark, docs, SF)
    assert found.columns == docs.columns and {(r["guess"], r["score"], r["held_out"]) for r in found.collect()} == {("mine", "own", 3)}
    named = langid.identify(docs)
    assert named.columns == [c for c in docs.columns if c not in ("score", "held_out")] + ["held_out", "lang_pred", "score"]


def test_doubtful_languages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    en, de = (docs.where(F.col("lang") == x).orderBy("doc_id").first()["text"][:600] for x in ("en", "de"))
    odd = spark.createDataFrame([(10**9 + i, t, None, None, None) for i, t in enumerate([None, "", "12 34", en + de, en, de])], docs.schema)
    kept = {r["doc_id"] for r in langid.certain(docs.union(odd)).where(F.col("doc_id") >= 10**9).collect()}
    assert kept == {10**9 + 4, 10**9 + 5}
    scores = [r["score"] for r in langid.identify(docs).collect()]
    assert 0 < min(scores) < 0.95 < np.median(scores) < 0.9999
    assert langid.certain(docs.where("false")).count() == 0


# ── 5 nearest neighbours ────────────────────────────────────────────────────


def test_shares_fall_and_recall_stays(spark):
    """Spread out vectors, the hardest case: recall on tables of two sizes, and what part of a table a query sees."""
    shares = []
    for n in (2_000, 20_000):
        x = np.random.default_rng(n).normal(size=(n, 32)).astype(np.float32)
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("digest", F.lit("clash"))
        every = n // 40
        got = ann.nearest(frame, every=every).toPandas()
        queries = np.arange(0, n, every)
        c = ann.cosines(x[queries].astype(float), x.astype(float))
        c[np.arange(len(queries)), queries] = -2
        best = np.argsort(-c, axis=1, kind="stable")[:, :5]
        hits = sum(len(set(got[got["query_id"] == q]["id"]) & set(b.tolist())) for q, b in zip(queries, best, strict=True))
        assert hits >= 0.9 * best.size
        exact = got.merge(got, on=["query_id", "rank"])  # scores are those of the vectors themselves
        assert np.allclose(got["score"], [c[list(queries).index(q), i] for q, i in zip(got["query_id"], got["id"], strict=True)], rtol=0, atol=1e-12) and len(exact) == len(got)
        layout = ann.Layout(n, 32, 3, 1.3)
        unit = ann._unit(x.astype(float))
        seen = np.zeros((len(queries), n), dtype=bool)
        for table in range(12):
            keys = ann.bucket_keys(unit, table, layout.polytopes, 1, 11)[:, 0]
            for i, probed in enumerate(ann.bucket_keys(unit[queries], table, layout.polytopes, layout.probes, 11)):
                seen[i] |= np.isin(keys, probed)
        shares.append(seen.mean())
    assert shares[1] < 0.6 * shares[0]


def test_blocks_score_all_that_is_probed(monkeypatch):
    """A block's best candidates are those of all pairs of a query and a point in a bucket it probes, whatever is done at once."""
    x = ann._unit(np.random.default_rng(5).normal(size=(600, 16)))
    layout = ann.Layout(600, 16, 4, 2)
    keys = ann.bucket_keys(x, 0, layout.polytopes, 1, 11)[:, 0]
    keys[:200] = keys[0]  # a hot bucket
    codes, asked = ann.packed(x), [ann.eighths(v).tobytes() for v in x[:40]]
    vecs = ann._whole(asked, 16)
    score = np.round(vecs.astype(np.float32) @ ann.unpacked(codes, 16).T, 5)
    probed = ann.bucket_keys(vecs, 0, layout.polytopes, layout.probes, 11)
    for table in (0, ann.EVERY):
        for pairs, unpacked in ((1 << 16, 1 << 14), (64, 50)):
            monkeypatch.setattr(ann, "PAIRS", pairs)
            monkeypatch.setattr(ann, "UNPACKED", unpacked)
            block = ann._Asked(16, table, 0, layout, [i.to_bytes(16, "little") for i in range(1, 41)], asked, 6, 11)
            block.meet(keys.astype(np.int32), codes, np.arange(600), np.arange(600))
            got = {int.from_bytes(r.q, "little") - 1: np.frombuffer(r.scores, np.float32) for r in block.result().itertuples()}
            for i in range(40):
                seen = np.ones(600, dtype=bool) if table == ann.EVERY else np.isin(keys, probed[i])
                best = np.sort(score[i][seen])[::-1][:6]
                assert np.allclose(got.get(i, np.empty(0)), best, rtol=0, atol=2e-5)


@pytest.mark.parametrize("kind", ["mean", "tight", "outlier"])
def test_rows_that_point_the_same_way_are_told_apart(spark, kind):
    """A common mean, tight clusters, or coordinates far larger than the others."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    if kind == "mean":
        x = 0.02 * x + rng.normal(size=32)
    elif kind == "tight":
        x = rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] + 0.02 * x
    else:
        x[:, :2] *= 30
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(rows).collect()
    c = ann.cosines(x[::50], x)
    c[np.arange(60), np.arange(0, 3000, 50)] = -2
    best = {(50 * q, int(i)) for q, near in enumerate(np.argsort(-c, axis=1)[:, :5]) for i in near}
    assert len(got) == 300 and len(best & {(r["query_id"], r["id"]) for r in got}) >= 270


def test_an_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.1]), (8, [1.0, 1.0]), (9, None)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["id"]) for r in got] == [(0, 1, 7), (0, 2, 8)]
    assert abs(got[0]["score"] - 1 / 1.01**0.5) < 1e-12


def test_four_bits_keep_the_direction():
    x = ann._unit(np.random.default_rng(0).normal(size=(50, 33)))
    assert (np.einsum("ij,ij->i", x, ann.unpacked(ann.packed(x), 33)) > 0.985).all()


# ── 6 main text ─────────────────────────────────────────────────────────────


class Article(html.parser.HTMLParser):
    """The blocks of the article element, read by the standard parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in html_text.INLINE | {"br"}:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.blocks.append("")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += " " + data if self.get_starttag_text() == "<br>" else data


def test_pages_against_their_article(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in entry.op6_main_text(spark, SF).collect()}
    right = 0
    for r in rows:
        parser = Article()
        parser.feed(r["html"] or "")
        parser.close()
        right += got[r["page_id"]] == " ".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)
    assert len(got) == len(rows) and right == len(rows)


# ── 7 token ids ─────────────────────────────────────────────────────────────


def test_order_is_one_of_rows_and_key(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 80").union(spark.createDataFrame([(None, "x"), (None, None), (3, "again")], "doc_id long, text string"))
    layout = token_shards.Layout(length=128, rows=20)
    answers = [sorted(map(str, token_shards.in_training_order(d, layout).collect())) for d in (docs.coalesce(1), docs.repartition(5, "text"), docs.orderBy(F.desc("doc_id")))]
    assert answers[0] == answers[1] == answers[2]
    rows = token_shards.in_training_order(docs, layout).collect()
    n = len(rows)
    seq = np.array([r["seq"] for r in rows])
    assert [r["slot"] for r in rows] == token_shards.feistel(seq, n, layout.key).tolist() and sorted(seq) == list(range(n))
    assert all(r["shard"] == r["slot"] // layout.rows for r in rows)
    assert [r["n_tokens"] < 128 for r in sorted(rows, key=lambda r: r["seq"])][:-1] == [False] * (n - 1)


def test_pieces_of_sequences():
    before, lengths = np.array([10, 13, 5, 100]), np.array([3, 9, 2, 4])
    tokens = np.r_[10:13, 13:22, 5:7, 100:104]
    seq, start, count, at = token_shards.spans(before, lengths, 8)
    assert [(s * 8 + a + np.arange(c)).tolist() for s, a, c in zip(seq, start, count, strict=True)] == [tokens[x : x + c].tolist() for x, c in zip(at, count, strict=True)]
    assert count.sum() == len(tokens) and (start + count <= 8).all()


# ── 8 surrogates ────────────────────────────────────────────────────────────


def test_a_family_name_has_one_surrogate(spark):
    """More bearers than there are known first names: all differ, and all bear one family name."""
    firsts = [a + b for a in ("Al", "Be", "Co", "Du") for b in ("ran", "lin", "mos", "nek", "pit", "rus", "sav", "tol", "vir", "wen", "zed", "kor", "lum", "nor", "pax")]
    texts = [f"Mr {f} Quist and Mrs {f} Quist met." for f in firsts] + ["Mr Quist left. Dr Anna Quist stayed.", "Mr QUIST"]
    out = [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    found = [re.fullmatch(r"Mr (\w+) (\w+) and Mrs (\w+) (\w+) met\.", t).groups() for t in out[:60]]
    family = {x for f in found for x in (f[1], f[3])}
    assert len(family) == 1 and "Quist" not in family
    assert len({f[0] for f in found}) == 60 and not {f[0] for f in found} & set(firsts)
    assert out[60].startswith(f"Mr {found[0][1]} left. Dr ") and out[60].endswith(f" {found[0][1]} stayed.") and out[61] == f"Mr {found[0][1].upper()}"


def test_marks_in_texts_stay(spark):
    texts = ["a\x01b\x01\x04c\x01\x03d", "\x01x@y.org\x01\x04", "\x04\x03\x01"]
    out = [r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out[0] == texts[0] and out[2] == texts[2] and re.fullmatch(r"\x01[a-z]@[a-z]\.org\x01\x04", out[1])


def test_surrogates_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n_entities"]) for r in pii.replace(docs).collect())
    assert got == sorted((str(r["doc_id"]), str(r["text"]), 0) for r in docs.collect())
    twice = spark.createDataFrame([(1, "to a.b@c.org"), (1, "to a.b@c.org"), (None, "to A.B@c.org")], "doc_id long, text string")
    texts = [r["text"] for r in pii.replace(twice).collect()]
    assert len(texts) == 3 and len({t.lower() for t in texts}) == 1 and "a.b@c.org" not in texts


# ── pipeline ────────────────────────────────────────────────────────────────


def test_stages_on_empty_and_odd_tables(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {c: F.lit("clash") for c in ("row", "doc", "guess", "copy", "position", "component", "key")}
    odd = real.where("doc_id < 60").union(odd_documents(spark).select(real.columns)).withColumns(clash)
    for docs in (real.where("false"), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns, name
            rows = after.collect()
            if docs is odd:
                ids = {(r["doc_id"], r["text"]) for r in rows}
                assert {(r["doc_id"], r["text"]) for r in docs.collect()} >= ids and len(ids) > 20
            else:
                assert not rows
