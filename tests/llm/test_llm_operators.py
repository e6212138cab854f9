"""The operators of training-data pipelines: against SQL, brute force, round trips, held-out accuracy, and odd input."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import database, differences
from conftest import SF
from tidemark.llm import ann, components, decontam, entry, html_text, langid, minhash, mixing, pii, sharding, token_shards, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, repeated ids, and columns whose names the operators use."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1), (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, None, None, None, None), (3, "", "de", "b", 0), (None, "der schnelle braune fuchs springt ueber den faulen hund", "de", "b", 2), (4, " \t\n", None, "", 3),
        (5, LONG, "en", "a", 4), (6, "1234 5678", "en", None, 5), (1, "another text of the first id with words enough to shingle", None, "c", 6), (None, None, None, None, None),
    ]
    out = spark.createDataFrame(rows, DOCS)
    return out.withColumns({c: F.lit("clash") for c in ("id", "size", "rank", "before", "part", "key", "cls", "bucket", "guess", "m", "place", "slot", "copies", "plan_id")})


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def duck():
    return database(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) and differences(got, duck.sql(entry.oracle_sql()[name]).df()) == ""


OPERATORS = {
    "mixing": lambda d: mixing.plan(d), "mix": lambda d: mixing.mix(d), "near": lambda d: minhash.near_duplicates(d), "shards": lambda d: sharding.shard(d), "language": lambda d: langid.identify(d),
    "tokens": lambda d: token_shards.in_training_order(d), "surrogates": lambda d: pii.replace(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_documents(spark, name):
    docs = odd_documents(spark)
    rows = OPERATORS[name](docs).collect()
    assert OPERATORS[name](empty_documents(spark)).count() == 0
    if name not in ("tokens", "mix"):
        assert len(rows) == docs.count()


# ── 1 mixing ────────────────────────────────────────────────────────────────


def test_sources_come_near_their_targets(spark):
    plan = mixing.plan(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.sum("size").alias("own"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 and r["size"] == r["own"] and r["over"] <= 0 for r in rows)
    assert sum(r["target"] for r in rows) == pytest.approx(sum(r["size"] for r in rows))


def test_mix_follows_the_curriculum(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "ab"[i % 2], 20) for i in range(400)], DOCS)
    order = [r["source"] for r in mixing.mix(docs, weights=(1, 1), schedule=lambda k: [((0.0, 2.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 2.0))][k % 2]).collect()]
    assert len(order) == 400 and order[:100].count("a") > 80 and order[-100:].count("b") > 80


def test_due_inverts_the_schedule(spark):
    schedule = ((0.0, 0.5), (0.4, 2.0), (1.0, 1.0))
    shares = [0.0, 0.1, 0.37, 0.8, 1.0]
    times = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.due(F.col("s"), schedule)).collect()]
    grid = np.linspace(0, 1, 100_001)
    run = np.concatenate(([0], np.cumsum((np.interp(grid[1:], *zip(*schedule, strict=True)) + np.interp(grid[:-1], *zip(*schedule, strict=True))) / 2)))
    assert times == pytest.approx([float(np.interp(s, run / run[-1], grid)) for s in shares], abs=1e-4)


# ── 2 near duplicates ───────────────────────────────────────────────────────


def test_near_duplicates_against_all_pairs(spark):
    rng, texts = random.Random(3), []
    for base in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(90)]
        texts.append(" ".join(words))
        for _ in range(base * 4):  # groups from one to dozens, beside large buckets
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(90)] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    texts += ["", None, "a b", "A  b", "a b c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    head = list(range(len(texts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    """Portions of a few rows: pairs of all portions are met, each once."""
    monkeypatch.setattr(minhash, "PORTION", 4)
    rng = np.random.default_rng(1)
    digest = rng.integers(0, 255, 480, dtype=np.uint8).tobytes()
    rows = [(7, bytes([i]), 100, bytes([i]), [7] + [1000 + i] * 23, digest) for i in range(14)]
    frame = spark.createDataFrame(rows, "key long, cls binary, n long, comp binary, keys array<long>, digest binary")
    found = [tuple(sorted((bytes(r["cls"]), bytes(r["hub"])))) for r in minhash.meetings(frame, 0.85).collect()]
    assert len(found) == len(set(found)) == 14 * 13 // 2


def test_sketch_fills_every_coordinate():
    sketches = minhash.sketch([np.array([5], dtype=np.uint64), np.arange(1000, dtype=np.uint64)])
    assert (sketches != np.iinfo(np.uint64).max).all()
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    same = (minhash.sketch([a]) == minhash.sketch([b])).mean()
    assert same == pytest.approx(900 / 1100, abs=0.08)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert {found[i] for i in range(61)} == {0} and found[101] == 100
    assert components.components(links.where("false")).count() == 0


# ── 3 sharding ──────────────────────────────────────────────────────────────


def test_shards_are_contiguous_and_even(spark):
    rows = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"), shards=8).toPandas().sort_values(["doc_id"])
    total = rows.groupby("shard")["size"].sum()
    assert set(total.index) == set(range(8)) and total.max() - total.min() <= 2 * rows["size"].max()
    assert (rows["shard"].diff().dropna() >= 0).all()
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


# ── 4 language ──────────────────────────────────────────────────────────────


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs).where("held_out and lang is not null and lang_pred <> 'und' and length(text) > 40")
    right, n = found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95
    odd = {r["n_chars"]: r for r in langid.identify(odd_documents(spark)).collect()}
    assert odd[0]["lang_pred"] == odd[3]["lang_pred"] == odd[5]["lang_pred"] == "und" and odd[5]["score"] == 0


# ── 5 nearest neighbours ────────────────────────────────────────────────────


def test_nearest_against_all_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array([np.array(v, dtype=np.float64) for v in rows["embedding"]])
    c = ann.cosines(x, x)
    got = entry.op5_nearest(spark, SF).toPandas()
    hits = n = 0
    for at in np.flatnonzero(rows["vec_id"] % 50 == 0):
        order = [i for i in np.lexsort((rows["vec_id"], -c[at])) if i != at][:5]
        own = got[got["query_id"] == rows["vec_id"][at]].sort_values("rank")
        assert len(own) == 5 and (own["score"].diff().dropna() <= 1e-15).all()
        hits, n = hits + len(set(own["vec_id"]) & set(rows["vec_id"].iloc[order])), n + 5
    assert n and hits / n >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (50, [0.0, 1.0]), (None, [1.0, 1.0]), (6, [3.0, 0.0]), (6, [3.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    found = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in got}
    assert found[0, 1] == (1, 1.0) and found[0, 2] == (6, 1.0) and found[50, 1][0] == 0 and len(found) == 4
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_equal_cosines_go_to_the_smaller_id(spark, monkeypatch):
    halves = [v for v in itertools.product((0.0, 1.0), repeat=8) if sum(v) == 4]
    rows = [(0, [1.0] * 8)] + [(i, list(v)) for i, v in enumerate(halves, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for portion in (4096, 8):
        monkeypatch.setattr(ann, "PORTION", portion)
        got = ann.nearest(frame, k=2, every=1000).collect()
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]
    # all rows at hand are fewer than asked for: the way that sees every row
    got = ann.nearest(frame, k=80, every=10).groupBy("query_id").count().collect()
    assert len(got) == 8 and {r["count"] for r in got} == {70}


def test_large_buckets_are_dealt_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(ann, "PORTION", 25)
    rows = [(1, 1, 0, i < 300, i if i < 300 else i - 300, i, b"") for i in range(400)] + [(1, 1, 1, True, 5, 5, b"")]
    hashed = spark.createDataFrame(rows, "dim int, tbl int, bucket long, query boolean, lead long, first long, vec binary")
    blocks = {}
    for r in ann._dealt(hashed).collect():
        blocks.setdefault(r["portion"], ([], []))[r["query"]].append(r["lead"])
    assert all(len(found) <= 25 and len(asking) <= 25 for found, asking in blocks.values())
    pairs = [(q, c) for found, asking in blocks.values() for q in asking for c in found]
    assert len(pairs) == len(set(pairs)) == 300 * 100


# ── 6 main text ─────────────────────────────────────────────────────────────

PAGE = """<html><head><title>no</title><script>var x = "<p>no</p>";</script></head><body><nav><a href=x>Home</a> <a>News</a></nav><div class="cookie-notice">We use cookies to improve everything you do here, honestly.</div>
<article><h1>Heading</h1><p>First &amp; foremost this paragraph
has quite some <b>bold</b> text in it to stand out.</p><p>Second paragraph, also with a good number of words&hellip;</p><div class="advert">Buy now, this is an advert of many words indeed!</div><p>Short.</p></article>
<div id="comments"><p>I disagree with all of this and I say so at great length, dear reader.</p></div><footer>Copyright and so on</footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(PAGE) == "Heading First & foremost this paragraph has quite some bold text in it to stand out. Second paragraph, also with a good number of words… Short."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>Menu</nav>") == ""


_LONG = "This paragraph of the article has more than enough words in it to be a surge of text by itself."
_SIDE = "<div class='sidebar'><p>Some words beside the article, which nobody came here to read.</p></div>"


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div class='layout with-sidebar'", "div class='page no-sidebar'", "div class=ad-free", "form id=aspnetForm"])
def test_wrappers_are_not_skipped(wrapper):
    name = wrapper.split()[0]
    for body in (f"<p>{_LONG}</p><p>{_LONG}</p>", f"<article><p>{_LONG}</p><p>{_LONG}</p></article>"):
        assert html_text.main_text(f"<body><{wrapper}>{body}{_SIDE}</{name}></body>") == f"{_LONG} {_LONG}"


def test_long_comments_are_no_article():
    comments = f"<div id=comments><article class=comment><div class=comment-content>{f'<p>I disagree. {_LONG}</p>' * 3}</div></article></div>"
    assert html_text.main_text(f"<main><p>{_LONG}</p><p>{_LONG}</p>{comments}</main>") == f"{_LONG} {_LONG}"


def test_all_runs_are_kept():
    links = "<p><a>One</a></p><p><a>Two</a></p><p><a>Three</a></p><p><a>Four</a></p>"
    assert html_text.main_text(f"<body><p>{_LONG} First.</p>{links}<p>{_LONG} Last.</p></body>") == f"{_LONG} First. {_LONG} Last."


def test_long_attributes_stay_in_their_tag():
    value = "<p>not text</p>" * 1000
    assert html_text.main_text(f'<p><img alt="{value}">{_LONG}</p><p data-x=\'{value}\'>{_LONG}</p>') == f"{_LONG} {_LONG}"
    assert html_text.main_text(f'<p a="x>{_LONG}</p>') == _LONG


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", PAGE), (2, "u", "<p>" + "x" * 500_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r["page_id"]: r["n_chars"] for r in html_text.extract(pages).collect()}
    assert found[1] == 0 and found[2] == 500_000 and found[None] > 100
    assert html_text.extract(pages.where("false")).count() == 0


# ── 7 token ids ─────────────────────────────────────────────────────────────


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(token_shards.feistel(np.arange(n), n, 7)) == list(range(n))


def test_shards_hold_every_token(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    layout = token_shards.Layout(length=64, rows=50)
    folder = f"file://{tmp_path}"
    shards, index = token_shards.materialise(docs, folder, layout)
    back = token_shards.read(spark, folder, shards, layout).orderBy("slot").collect()
    coder, end, dtype = token_shards.encoder(layout.vocabulary)
    assert [r["slot"] for r in back] == list(range(len(back)))
    seq_of = {r["slot"]: (r["seq"], r["n_tokens"]) for r in index.collect()}
    stream = np.concatenate([np.frombuffer(r["tokens"], dtype)[: seq_of[r["slot"]][1]] for r in sorted(back, key=lambda r: seq_of[r["slot"]][0])])
    want = [t.encode("utf-8", "replace").decode() if t else "" for t in (r["text"] for r in docs.collect())]
    cuts = np.flatnonzero(stream == end)
    texts = [coder.decode(part[part != end].tolist()) for part in np.split(stream, cuts + 1)[:-1]]
    assert sorted(texts) == sorted(want)
    later = token_shards.read(spark, folder, shards, layout, start=70, portion=16).orderBy("slot").collect()
    assert [(r["slot"], r["tokens"]) for r in later] == [(r["slot"], r["tokens"]) for r in back[70:]]


def test_long_texts_are_cut_where_the_pattern_cuts(monkeypatch):
    coder = token_shards.encoder(token_shards.VOCABULARY)[0]
    monkeypatch.setattr(token_shards, "PIECE", 40)
    text = "Many words, it's 3 or 4  lines\n of text with spaces   and more. " * 9
    assert sum([coder.encode_ordinary(p) for p in token_shards.pieces(text)], []) == coder.encode_ordinary(text)


# ── 8 surrogates ────────────────────────────────────────────────────────────


def test_surrogates_keep_type_format_and_identity(spark):
    texts = [
        "Mail jane.doe@example.org or call +1 415 555 0134. Mr John Smith paid with 4111 1111 1111 1111.", "JANE.DOE@EXAMPLE.ORG wrote; Mrs Anna Smith and Mr Smith replied from 10.20.30.40.",
        "SSN 123-45-6789, card 4111-1111-1111-1111, Господин Иванов.", "nothing private here, version 1.2.3", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.replace(docs).collect()}
    out = {i: r["text"] for i, r in found.items()}
    assert out[3] == texts[3] and out[4] is None and out[5] == "" and found[3]["n_entities"] == 0
    joined = " ".join(v for v in out.values() if v)
    for secret in ("jane.doe", "JANE.DOE", "555 0134", "Smith", "4111", "10.20.30.40", "123-45-6789", "Иванов"):
        assert secret not in joined.replace("4111", "", 0) or secret == "4111"
    mail = re.search(r"Mail (\S+@\S+\.org)", out[0])[1]
    assert mail.upper() in out[1] and re.fullmatch(r"[a-z]{4}\.[a-z]{3}@[a-z]{7}\.org", mail)
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", out[0])[0]
    assert card.replace(" ", "-") in out[2] and card != "4111 1111 1111 1111"
    assert sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(int(c) for c in card if c.isdigit())) % 10 == 0
    family = re.search(r"Mr \w+ (\w+)", out[0])[1]
    assert f"Mr {family}" in out[1] and re.search(rf"Mrs \w+ {family}", out[1])
    assert re.search(r"Господин [а-яА-Я]+", out[2]) and re.search(r"\+1 \d{3} \d{3} \d{4}", out[0])
    again = {r["doc_id"]: r["text"] for r in pii.replace(docs).collect()}
    assert again == out


def test_long_keys_and_other_formats_are_found(spark):
    """Each text holds one entity; what must go, and what the rest must look like."""
    long = "0123456789abcdef" * 40
    cases = [
        (f"key {long} end", long[:40], r"key [0-9a-f]{640} end"), (f"token sk-{'Ab1-' * 60}x end", "Ab1-Ab1-", r"token sk-\S{241} end"),
        ("please contact Anna Schmidt today", "Schmidt", r"please contact \w+ \w+ today"), ("Best regards,\nAnna Schmidt", "Anna Schmidt", r"Best regards,\n\w+ \w+"),
        ("call 415 555 0134 now", "555 0134", r"call \d{3} \d{3} \d{4} now"), ("Tel. 030 1234567 oder", "1234567", r"Tel\. 0\d\d \d{7} oder"), ("tel 06 12 34 56 78.", "12 34 56", r"tel 0\d( \d\d){4}\."),
        ("host 2001:db8::8a2e:370:7334 up", "2001:db8", r"host [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} up"),
    ]
    clean = ["on 01.02.2003 10:20:30 it was", "std::vector<int> a::b", "Contact us in New York"]
    docs = spark.createDataFrame(list(enumerate([c[0] for c in cases] + clean)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.replace(docs).collect()}
    for i, (_, gone, pattern) in enumerate(cases):
        assert out[i]["n_entities"] == 1 and gone not in out[i]["text"] and re.fullmatch(pattern, out[i]["text"]), out[i]
    assert [out[len(cases) + i]["text"] for i in range(len(clean))] == clean


def test_surrogates_are_distinct(spark):
    entities = spark.createDataFrame([("ip", f"10.{i // 10}.0.{i % 10}") for i in range(90)] + [("ssn", f"{i:09d}") for i in range(50)], "kind string, norm string")
    found = pii.surrogates(entities, "k").collect()
    assert len({(r["kind"], r["surrogate"]) for r in found}) == len(found) == 140
    assert not {r["surrogate"] for r in found} & {r["norm"] for r in entities.collect()}


def test_surrogates_of_full_formats_are_exact(spark):
    """More entities than half the values of their format: draws alone can't end."""
    digits = "123456789"
    rows = [("ip", ".".join(x)) for x in list(itertools.product(digits, repeat=4))[:4000]] + [("phone", f"+1{i:03d}") for i in range(700)]
    rows += [("email", f"{c}@example.org") for c in "abcdefghijklmnopqrstuvwxyz"] + [("card", "4111111111111111"), ("name_m", "smith"), ("name_f", "anna smith")]
    found = pii.surrogates(spark.createDataFrame(rows, "kind string, norm string"), "k", rounds=2).collect()
    assert {(r["kind"], r["norm"]) for r in found} == set(rows) and len(found) == len(rows)
    shown = {r["surrogate"] for r in found}
    assert len(shown) == len(rows) and not shown & {n for _, n in rows}
    kinds = {k: [r["surrogate"] for r in found if r["kind"] == k] for k, _ in rows}
    assert all(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", x) for x in kinds["ip"]) and all(re.fullmatch(r"\+1\d{3,4}", x) for x in kinds["phone"])
    # a format is left only when it is full
    assert sum(len(x) == 7 for x in kinds["ip"]) == 6561 - 4000 and sum(len(x) == 5 for x in kinds["phone"]) == 300
    assert len({x.split("@")[1] for x in kinds["email"]}) == 1


def test_all_kinds_have_numbered_values(spark):
    """Values by number keep the format, as draws do, and differ."""
    rows = [("email", "a.b1@x.org"), ("iban", "de44500105175407324931"), ("secret", "0f" * 16), ("secret", "sk-abcdefgh12345678"), ("card", "4111111111111111"), ("card", "4111111111111112"), ("ssn", "123456789"), ("ip", "10.2.3.200"),
            ("phone", "+14155550134"), ("name_m", "john smith"), ("name_f", "иванова"), ("name_n", "άννα δάφνη")]
    entities = spark.createDataFrame(rows, "kind string, norm string")
    found = {r["norm"]: r["surrogate"] for r in pii._assigned(entities, entities.limit(0).withColumn("surrogate", F.lit("")), entities, "k").collect()}
    assert set(found) == {n for _, n in rows} and not set(found) & set(found.values()) and len(set(found.values())) == len(rows)
    like = [r"[a-z]\.[a-z]\d@[a-z]\.org", r"de\d{20}", r"[0-9a-f]{32}", r"sk-[a-z]{8}\d{8}", r"4\d{15}", r"4\d{15}", r"\d{9}", r"\d\d\.\d\.\d\.\d{3}", r"\+1\d{10}", r"[a-z]+ [a-z]{12}", r"[а-я]{8,12}", r"[α-ωά-ώ]+ [α-ω]{12}"]
    for (_, norm), pattern in zip(rows, like, strict=True):
        assert re.fullmatch(pattern, found[norm]), (norm, found[norm])
    luhn = lambda x: sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, x))) % 10
    assert luhn(found["4111111111111111"]) == 0 != luhn(found["4111111111111112"])


# ── 9 decontamination ───────────────────────────────────────────────────────


def edits(a, b):
    """The least edit distance of ``a`` to a passage of ``b``, by the whole table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return min(row)


def test_contamination_against_whole_tables(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 40))] for _ in range(12)]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        if d % 2:
            passage = list(rng.choice(items))
            for _ in range(rng.randint(0, int(0.3 * len(passage)))):
                at, kind = rng.randrange(len(passage)), rng.random()
                passage[at : at + (kind > 0.3)] = [rng.choice(vocabulary)] if kind < 0.7 else []
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append(words)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)] + [(None, None), (99, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in enumerate(items)] + [(50, None), (51, "..."), (None, "w1 w2")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(frame, bench).collect()}
    want = {(d, i) for d, w in enumerate(docs) for i, item in enumerate(items) if edits(item, w) <= int(decontam.RATE * len(item))}
    assert got <= want and len(got) >= 0.97 * len(want) > 15
    kept = {r["doc_id"] for r in decontam.clean(frame, bench).collect()}
    assert kept == {r["doc_id"] for r in frame.collect()} - {d for d, _ in got}
    assert decontam.matches(frame, bench.where("false")).count() == 0 and decontam.clean(frame.where("false"), bench).count() == 0


def test_fitting_distance_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 70)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 90)).astype(np.uint64)
        assert decontam.fitting_distance(a, b)[0] == edits(a.tolist(), b.tolist())


# ── 10 WARC ─────────────────────────────────────────────────────────────────


def test_archives_round_trip(spark, tmp_path):
    noise = random.Random(5).randbytes(3000).decode("latin-1")
    pages = [(1, "u", "x" * 2000), (2, None, "x" * 2000), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", noise + "\x1f\x8b\x08" * 50), (None, "u", "y" * 2000), (7, "ü\r\nx", "é" * 800)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    listed = warc.write(frame, f"file://{tmp_path}")
    for size in (64, 1 << 20):  # ranges shorter than a record, and longer than an archive
        rows = {r["page_id"]: r for r in warc.read(spark, f"file://{tmp_path}", listed, size=size).collect()}
        assert len(rows) == 8 and rows[1]["record_type"] == "revisit" and rows[1]["refers_to"] == 2 and rows[1]["payload_bytes"] == 2000
        assert all((rows[i]["payload"] or b"").decode() == (h or "") for i, _, h in pages if i != 1)
        assert rows[3]["record_type"] == rows[4]["record_type"] == "response"
    assert warc.round_trip(frame.where("false")).count() == 0
