"""The queries that apply each operator to its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontam, exact_dedup, jaccard, langid, line_dedup, sentencepiece_bridge, toxicity, url_filter, warc
from .common import id_mod, table

TOKENIZER = os.environ.get("NDCOLLECT_SENTENCEPIECE", "/opt/tokenizers/piece_bpe_32k.model")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids, links and digests of both derivatives of every page; the records' bytes as lengths and SHA-256."""
    out = warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return out.select("record_id", "type", "refers_to", "target_uri", "date", "content_type", F.sha2(F.col("headers").cast("binary"), 256).alias("headers_sha256"), F.octet_length("block").cast("long").alias("block_bytes"), "block_digest", "payload_digest")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_matches", "n_removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bridge.encode(table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False).drop("ids")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out(5))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out(5).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctw.score(table(spark, sf_dir, "documents"), id_mod("doc_id", 7) != 2, plain=True)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, scorer).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("restored_hits").alias("n_hits"))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the labels row with its id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    return url_filter.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), RULES)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_derivatives, op2_line_dedup, op3_exact_dedup, op4_sentencepiece, op5_language_id, op6_jaccard_join, op7_lm_scoring, op8_toxicity, op9_url_filter, op10_decontamination)}


_OP3 = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""

_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS win
            FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT m FROM items),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes),
hits AS (SELECT p.doc_id, p.i, p.m, v.item
         FROM (SELECT doc_id, i, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS win FROM places) p
         JOIN windows v ON v.win = p.win AND v.m = p.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
whose AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated,
       CASE WHEN len(d.w) > 0 THEN coalesce(words.n_hit, 0)::DOUBLE / len(d.w) ELSE 0.0 END AS coverage
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN whose USING (doc_id)
"""


_OP2 = """
WITH h AS (SELECT doc_id, l, list_transform(l, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS h
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
c AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l)
             OR (((CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END) * 1000003 + h[i]) % 2147483647) % 16 <> 0) AS e FROM h),
p AS (SELECT doc_id, l, e, unnest(range(1, len(e) + 1)) AS place FROM c),
t AS (SELECT doc_id, place, (CASE WHEN place > 1 THEN e[place - 1] ELSE 0 END) AS start,
             l[(CASE WHEN place > 1 THEN e[place - 1] ELSE 0 END) + 1 : e[place]] AS chunk FROM p),
n AS (SELECT *, coalesce(lag(chunk) OVER w, []) AS before, coalesce(lead(chunk) OVER w, []) AS after FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
f AS (SELECT *, row_number() OVER w AS k, first_value(before) OVER w AS fb, first_value(after) OVER w AS fa FROM n WINDOW w AS (PARTITION BY array_to_string(chunk, chr(10)) ORDER BY doc_id, place)),
m AS (SELECT *, len(list_filter(range(1, least(len(before), len(fb)) + 1), lambda i: before[len(before) - i + 1 : len(before)] = fb[len(fb) - i + 1 : len(fb)])) AS up,
             len(list_filter(range(1, least(len(after), len(fa)) + 1), lambda i: after[1 : i] = fa[1 : i])) AS down FROM f WHERE k > 1),
r AS (SELECT doc_id, start - up AS a, start + len(chunk) + down AS b, list_concat(list_concat(before[len(before) - up + 1 : len(before)], chunk), after[1 : down]) AS run FROM m),
ok AS (SELECT DISTINCT doc_id, a, b FROM r WHERE len(run) >= 2 AND regexp_matches(array_to_string(run, chr(10)), '[^ \\t\\n\\r]')),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM ok),
matches AS (SELECT doc_id, count(*) AS n FROM ok GROUP BY 1),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM c)
SELECT doc_id, count(*) AS n_lines, any_value(CAST(len(c.e) AS BIGINT)) AS n_chunks, any_value(coalesce(matches.n, 0)) AS n_matches, count(gone.i) AS n_removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (gone.i IS NULL), '')) AS text_sha256
FROM lines JOIN c USING (doc_id) LEFT JOIN matches USING (doc_id) LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
"""

_OP9 = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
names AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM (SELECT DISTINCT host FROM p)),
sized AS (SELECT *, len(l) < 2 OR regexp_matches(name, '^[0-9.]+$') OR contains(name, '[') AS whole,
                 CASE WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.za', 'com.mx', 'co.in') THEN 2 ELSE 1 END AS k FROM names),
parts AS (SELECT host, CASE WHEN whole THEN name ELSE array_to_string(l[greatest(len(l) - k, 1) : len(l)], '.') END AS domain,
                 CASE WHEN whole THEN '' ELSE array_to_string(l[len(l) - k + 1 : len(l)], '.') END AS suffix FROM sized),
hh AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(bad) AS bad FROM p JOIN o USING (page_id) JOIN parts USING (host) GROUP BY host),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hh GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m FROM s),
sk AS (SELECT 1 / least(greatest((sum(pow(bad - n * m, 2) / n) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)), 1e-4), 0.5) - 1 AS k FROM s, g),
dj AS (SELECT d.*, (sk.k * g.m + s.bad - d.bad) / (sk.k + s.n - d.n) AS m FROM d JOIN s USING (suffix), g, sk),
dk AS (SELECT 1 / least(greatest((sum(pow(bad - n * m, 2) / n) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)), 1e-4), 0.5) - 1 AS k FROM dj),
hj AS (SELECT hh.*, (dk.k * dj.m + dj.bad - hh.bad) / (dk.k + dj.n - hh.n) AS m FROM hh JOIN dj USING (suffix, domain), dk),
hk AS (SELECT 1 / least(greatest((sum(pow(bad - n * m, 2) / n) - sum(m * (1 - m))) / sum((n - 1) * m * (1 - m)), 1e-4), 0.5) - 1 AS k FROM hj),
hm AS (SELECT host, (k * m + bad) / (k + n) AS m, k + n AS w FROM hj, hk),
dm AS (SELECT suffix, domain, (dk.k * dj.m + bad) / (dk.k + n) AS dmean FROM dj, dk),
sm AS (SELECT suffix, (sk.k * g.m + bad) / (sk.k + n) AS smean FROM s, g, sk),
q AS (SELECT host, dmean, smean, coalesce(dmean, smean, g.m) AS m,
             hk.k / (hk.k + 1) * CASE WHEN dmean IS NULL THEN dk.k / (dk.k + 1) ELSE 1 END * CASE WHEN coalesce(dmean, smean) IS NULL THEN sk.k / (sk.k + 1) ELSE 1 END AS within
      FROM parts LEFT JOIN dm USING (suffix, domain) LEFT JOIN sm USING (suffix), g, hk, dk, sk WHERE host NOT IN (SELECT host FROM hh)),
b AS (SELECT host FROM hm WHERE m - 1.645 * sqrt(m * (1 - m) / (w + 1)) > 0.25
      UNION ALL SELECT host FROM q WHERE m - 1.645 * sqrt(m * (1 - m) * (1 - within)) > 0.25),
r AS (SELECT page_id, max_by(rule, len(rule)) AS rule, max_by(what, len(rule)) AS what
      FROM p JOIN (VALUES ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'), ('allow', 'www.example.com', '/en/', 'www.example.com/en/'),
                          ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')) v(what, name, start, rule)
      ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.what, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END AS reputation
FROM p LEFT JOIN r USING (page_id) LEFT JOIN b ON p.host = b.host
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": _OP2, "op3_exact_dedup": _OP3, "op9_url_filter": _OP9, "op10_decontamination": _OP10}
