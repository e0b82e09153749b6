"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import avi_media, decontam, langid, license_scan, pii, quotes, sentencepiece_nbest, setsketch, simhash, spelling, token_counts, toxicity, whitening
from tidewell.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark, table(spark, sf_dir, "documents"))


def op4_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_media.media_digest(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.quotation_links(table(spark, sf_dir, "conversations"))


def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.segment_digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_digest(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_license_scan, op4_avi_media, op5_language_id, op6_toxicity, op7_quotation_links, op8_sentencepiece_nbest, op9_simhash, op10_token_counts, op11_whitening, op12_setsketch, op13_spelling)}

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
g AS (SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT g.rid, g.size, g.i, win.item_id FROM g JOIN win USING (size, gram)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, size, i FROM hit)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hit) GROUP BY rid),
s AS (SELECT rid, sum(CASE WHEN prev IS NULL OR p > prev + 1 THEN 1 ELSE 0 END) AS n_spans FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS prev FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS p FROM hit)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN s USING (rid)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Sets are told apart by their sorted shingles; reach is the closure of links between different sets.
SETS_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) AS grams FROM d WHERE len(w) > 0),
m AS (SELECT rid, doc_id, len(grams) AS n, dense_rank() OVER (ORDER BY sha256(array_to_string(grams, chr(10)))) AS k, grams FROM g),
s AS (SELECT k, any_value(n) AS n, any_value(grams) AS grams, min(doc_id) AS doc_id FROM m GROUP BY k),
x AS (SELECT k, n, hash(gram) AS gram FROM (SELECT k, n, unnest(grams) AS gram FROM s)),
links AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.gram = b.gram AND a.k <> b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT k AS a, k AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT reach.a AS k, min(s.doc_id) AS component_id FROM reach JOIN s ON s.k = reach.b GROUP BY 1)
SELECT d.doc_id, coalesce(m.n, 0)::BIGINT AS n_shingles, CASE WHEN m.rid IS NULL THEN d.doc_id ELSE c.component_id END AS component_id, m.rid IS NULL OR d.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM d LEFT JOIN m USING (rid) LEFT JOIN c USING (k)"""

#: crc32 by a table of 256 remainders, which the rule of the reflected polynomial gives.
SPELLING_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS r FROM (SELECT unnest(range(256)) AS b))),
u AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS bytes FROM u WHERE length(run) > 5 GROUP BY ALL),
h AS (SELECT run, n, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(bytes) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', bytes[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', bytes[2 * i + 2]) - 1)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) END AS h FROM r, crc),
f AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) > 5 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM f)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN f b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN f b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS form_n FROM near GROUP BY word),
v AS (SELECT f.word, CASE WHEN form_n >= 5 * f.n THEN other END AS form, f.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * f.n THEN form_n END AS form_n FROM f LEFT JOIN best USING (word)),
path AS (SELECT word, word AS reached, 0 AS step FROM v UNION ALL SELECT path.word, v.form, step + 1 FROM path JOIN v ON v.word = path.reached WHERE v.form IS NOT NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM v JOIN (SELECT word, arg_max(reached, step) AS root FROM path GROUP BY word) USING (word)"""

ORACLE_SQL = {"op12_setsketch": SETS_SQL, "op13_spelling": SPELLING_SQL, "op2_decontamination": DECONTAMINATION_SQL, "op3_license_scan": license_scan.license_sql(), "op7_quotation_links": quotes.QUOTES_SQL}
