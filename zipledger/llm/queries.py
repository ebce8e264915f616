"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.llm import (byte_pairs, decontaminate, fingerprint, lm, minhash, packing, periodic, quality, suffix_array, suffix_tree,
                           token_files, toxicity, variants)
from zipledger.llm.common import table
from zipledger.session import shared_dir


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.report(table(spark, sf_dir, "documents"), window=35)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.report(table(spark, sf_dir, "documents"), length=50)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "llm-tokens") + f"/{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.digest(token_files.read(spark, path))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm.scores(table(spark, sf_dir, "documents"))
    # sums of doubles depend on their order in the last digits
    return rows.withColumn("log_score", F.round("log_score", 6)).withColumn(
        "mean_log_score", F.round("mean_log_score", 6))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=1, size=2048)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.plant(table(spark, sf_dir, "documents")), least=12)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), slips=31)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.report(table(spark, sf_dir, "documents"))


#: Words, windows and coverage again in SQL: a document's word is hit if a benchmark window covers it.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len, array_to_string(w[i:i + len - 1], ' ') AS win FROM (
        SELECT item_id, w, least(10, len(w)) AS len, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM bw),
dw AS (SELECT r, i, len, array_to_string(w[i:i + len - 1], ' ') AS win FROM (
        SELECT r, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM d, lens WHERE len(w) >= len)),
h AS (SELECT r, i, dw.len, item_id FROM dw JOIN bw USING (len, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (
        SELECT DISTINCT r, unnest(range(i, i + len)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (
        SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

#: Windows of 35 words whose sequence starts more than once; the words they cover go.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(
        regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (
        SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (s)),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Bytes as hex digits; strings of 50 bytes that also start in a document with a smaller doc_id.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
pos AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (
        SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
old AS (SELECT s, min(doc_id) AS first FROM pos GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS b FROM pos JOIN old USING (s) WHERE doc_id > first),
run AS (SELECT r, i, sum(CASE WHEN b IS NULL OR i > b + 50 THEN 1 ELSE 0 END)
               OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, min(i) AS lo, max(i) + 50 AS hi FROM run GROUP BY r, k),
gap AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM span),
cut AS (SELECT d.r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS tail,
               string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS t
        FROM gap JOIN d ON d.r = gap.r GROUP BY d.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE t || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

#: Word pairs and words counted in all documents, the document's own taken off.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(
        regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
one AS (SELECT r, x, lag(x) OVER o AS y, lag(x, 2) OVER o AS z FROM (
        SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) WINDOW o AS (PARTITION BY r ORDER BY p)),
c1 AS (SELECT x, count(*) AS n FROM one GROUP BY x), c2 AS (SELECT y, x, count(*) AS n FROM one GROUP BY y, x),
c3 AS (SELECT z, y, x, count(*) AS n FROM one GROUP BY z, y, x),
m1 AS (SELECT r, x, count(*) AS n FROM one GROUP BY r, x), m2 AS (SELECT r, y, x, count(*) AS n FROM one GROUP BY r, y, x),
m3 AS (SELECT r, z, y, x, count(*) AS n FROM one GROUP BY r, z, y, x),
size AS (SELECT r, count(*) AS n, (SELECT count(*) FROM one) AS corpus FROM one GROUP BY r),
rest AS (SELECT one.r, one.y, one.z, c1.n - m1.n AS w1, c2.n - m2.n AS w2, c3.n - m3.n AS w3, cy.n - my.n AS before,
                cz.n - mz.n AS before2, corpus - size.n AS others
         FROM one JOIN c1 ON one.x = c1.x JOIN m1 ON one.r = m1.r AND one.x = m1.x JOIN size ON one.r = size.r
         LEFT JOIN c2 ON one.y = c2.y AND one.x = c2.x LEFT JOIN m2 ON one.r = m2.r AND one.y = m2.y AND one.x = m2.x
         LEFT JOIN c3 ON one.z = c3.z AND one.y = c3.y AND one.x = c3.x
         LEFT JOIN m3 ON one.r = m3.r AND one.z = m3.z AND one.y = m3.y AND one.x = m3.x
         LEFT JOIN c1 cy ON one.y = cy.x LEFT JOIN m1 my ON one.r = my.r AND one.y = my.x
         LEFT JOIN c2 cz ON one.z = cz.y AND one.y = cz.x LEFT JOIN m2 mz ON one.r = mz.r AND one.z = mz.y AND one.y = mz.x),
sums AS (SELECT r, count(*) AS n, sum(CASE WHEN w3 > 0 THEN ln(w3) - ln(before2)
                WHEN w2 > 0 THEN ln(w2) - ln(before) + CASE WHEN z IS NULL THEN 0 ELSE ln(0.4) END
                WHEN w1 > 0 THEN ln(w1) - ln(others) + CASE WHEN y IS NULL THEN 0 WHEN z IS NULL THEN 1 ELSE 2 END * ln(0.4)
                ELSE 3 * ln(0.4) - ln(others + 1) END) AS score FROM rest GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(score, 0), 6) AS log_score,
       round(score / n, 6) AS mean_log_score
FROM d LEFT JOIN sums USING (r)
"""

#: All pairs with a common shingle, and what is reachable over the similar ones.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
         GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT link.b, reach.other FROM reach JOIN link ON link.a = reach.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id,
       d.doc_id = min(other) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

#: The checksum of some byte values: eight shifts for each.
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], CAST({codes} AS UBIGINT[])),
        lambda a, c: list_reduce(list_concat([xor(a, c)], CAST(range(8) AS UBIGINT[])),
            lambda v, k: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)"""

#: Pairs of equal word 6-grams (every run has one) joined into stretches; those long enough are runs.
OP11_SQL = r"""
WITH d0 AS (SELECT doc_id, row_number() OVER () AS r, """ + _CRC.format(codes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c))") + r""" AS h, list_filter(
        regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d1 AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST(h // 10 AS BIGINT) AS g FROM d0),
d2 AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM d1),
d AS (SELECT doc_id, r, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
        lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM d2),
gram AS (SELECT r, i, hash(array_to_string(w[i + 1:i + 6], ' ')) AS s FROM (
        SELECT r, w, unnest(range(0, n - 5)) AS i FROM d WHERE n >= 12)),
pair AS (SELECT x.r, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.r = y.r AND x.s = y.s AND x.i < y.i),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair),
run0 AS (SELECT r, q, min(i) AS lo, max(i) + 6 + q AS hi FROM isle GROUP BY r, q, k
         HAVING max(i) + 6 + q - min(i) >= greatest(12, 2 * q)),
run AS (SELECT r, q, lo, hi FROM run0 a WHERE NOT EXISTS (SELECT 1 FROM run0 b WHERE b.r = a.r AND b.q < a.q
         AND a.q % b.q = 0 AND b.lo <= a.lo AND b.hi >= a.hi)),
t AS (SELECT r, count(*) AS n_runs, string_agg(lo || ',' || (hi - lo) || ',' || q || chr(10), '' ORDER BY lo, q) AS s,
      min((lo - hi, lo, q)) AS best FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(lo + q, hi)) AS i FROM run),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, n AS n_words, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best[2] AS BIGINT) AS "start",
       CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period,
       CAST(-1000 * best[1] // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(t.s, '')) AS runs_sha256,
       sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN kept USING (r)
"""

#: Misspellings planted, words counted, near words by what is left when a letter is taken out.
OP12_SQL = r"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
kind AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM run WHERE length(w) >= 7 GROUP BY doc_id, w),
slip AS (SELECT w, n, """ + _CRC.format(
    codes="list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS UBIGINT))") + r""" AS h FROM kind),
word AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2)
         ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n FROM slip GROUP BY 1),
v AS (SELECT word, n FROM word WHERE length(word) >= 7 AND n >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (
        SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pair AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
         UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.s = v.word
         UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.s = v.word),
near AS (SELECT word, count(*) AS n_near, min((-n, encode(other))) AS best FROM pair GROUP BY word),
known AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * v.n THEN decode(best[2]) END AS form,
          CASE WHEN -best[1] >= 10 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN near USING (word)),
follow AS (SELECT word, word AS root FROM known UNION ALL
           SELECT follow.word, known.form FROM follow JOIN known ON known.word = follow.root WHERE known.form IS NOT NULL),
ends AS (SELECT follow.word, follow.root FROM follow JOIN known ON known.word = follow.root WHERE known.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM known JOIN ends USING (word)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_fingerprints": op3_fingerprints,
    "op4_suffix_array": op4_suffix_array,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_minhash": op10_minhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_suffix_tree": OP2_SQL,
    "op4_suffix_array": OP4_SQL,
    "op7_lm_scoring": OP7_SQL,
    "op10_minhash": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
