"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, html_text, langid, minhash, mixing, periodic, pii, quality, sharding, token_shards, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.ordered_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_position", "training_place")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.in_training_order(_table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = quality.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return ranked.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mixing, op2_near_duplicates, op3_sharding, op4_language, op5_nearest, op6_main_text, op7_token_shards, op8_surrogates, op9_decontamination, op10_warc, op11_periodic_runs, op12_whitening, op13_quality,
    )
    return {f.__name__: f for f in found}


def _due(share: str, knots: mixing.Schedule) -> str:
    """SQL for the time at which ``share`` of the demand of a schedule of two knots has accumulated."""
    (t0, w0), (t1, w1) = knots
    area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
    left = f"({share} * {area!r}::DOUBLE)"
    return f"CASE WHEN {left} = 0 THEN {t0!r} ELSE {t0!r}::DOUBLE + least(2 * {left} / ({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {left}, 0))), {t1 - t0!r}::DOUBLE) END"


_OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint AS rank
  FROM documents),
sources AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS number
  FROM sized GROUP BY source),
weighed AS (SELECT *, (number % 3 + 1)::double AS weight FROM sources),
ordered AS (
  SELECT *, row_number() OVER w AS place,
         (sum(source_size) OVER ()
          - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, number)),
shared AS (SELECT min_by(level, place) AS level FROM ordered WHERE level * weight <= 3 * source_size),
aims AS (
  SELECT source, number, source_size, least(shared.level * weight, (3 * source_size)::double) AS target
  FROM ordered, shared),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, floor(a.target + 0.5)::bigint AS words, a.number % 3 AS kind,
         CASE WHEN a.source_size > 0 THEN floor(floor(a.target + 0.5) / a.source_size)::bigint ELSE 0 END AS passes,
         (sum(s.size) OVER (PARTITION BY a.number ORDER BY s.rank, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::bigint AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
timed AS (
  SELECT *, CASE kind """ + " ".join(f"WHEN {k} THEN {_due('share', mixing.default_schedule(k))}" for k in range(3)) + r""" END AS first_position
  FROM (SELECT *, CASE WHEN target > 0 THEN least(before / target, 1) ELSE 1 END::DOUBLE AS share FROM placed))
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, words - passes * source_size - before)))::bigint AS taken,
       first_position, (row_number() OVER (ORDER BY first_position, before, doc_id NULLS FIRST) - 1)::bigint AS training_place
FROM timed
"""

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i : array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

_OP3 = """
WITH bits AS (
  SELECT doc_id, text, flatten(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x : list_transform([('0x' || x)::BIGINT],
    lambda v : [v & 1, (v >> 1) & 1, (v >> 2) & 1, (v >> 3) & 1, (v >> 4) & 1, (v >> 5) & 1, (v >> 6) & 1, (v >> 7) & 1])[1])) AS bits
  FROM documents),
sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b : xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS text_crc32
  FROM bits),
placed AS (
  SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total, row_number() OVER w AS place
  FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, least(39, (2 * before + size) * 40 // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::bigint AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""


_OP11 = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x : list_transform([ord(x)::BIGINT],
      lambda v : [v & 1, (v >> 1) & 1, (v >> 2) & 1, (v >> 3) & 1, (v >> 4) & 1, (v >> 5) & 1, (v >> 6) & 1, (v >> 7) & 1])[1])) AS bits
  FROM documents),
hashed AS (
  SELECT row, doc_id, words, len(words) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b : xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
  FROM split),
place AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
step AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM place),
docs AS (
  SELECT row, doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i : words[(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END) + 1]) END AS words
  FROM step),
w AS (SELECT row, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM docs),
same AS (SELECT x.row, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT row, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS g FROM same)
  GROUP BY row, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT row, start, length, min(q) AS period FROM stretch GROUP BY row, start, length),
best AS (
  SELECT row, count(*) AS n_runs, arg_min({'s': start, 'n': length, 'q': period}, {'e': -length::DOUBLE / period, 's': start, 'q': period}) AS run,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY row),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text
  FROM w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row = w.row AND w.i >= r.start + r.period AND w.i < r.start + r.length)
  GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, run.s::BIGINT AS start, run.n::BIGINT AS length, run.q::BIGINT AS period, (1000 * run.n // run.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (row) LEFT JOIN kept USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _OP1, "op2_near_duplicates": _OP2, "op3_sharding": _OP3, "op10_warc": _OP10, "op11_periodic_runs": _OP11}
