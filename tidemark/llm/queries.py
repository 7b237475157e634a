"""One query per operator over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversation_trie, exact_dedup, hard_negatives, licenses, mixing, ngram_join, pii, quality, substring_dedup, token_io, toxicity, warc
from tidemark.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("_row")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, digest=True)


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a second replica that was written with damage: bodies of pages 13, 110, ... (mod 97) have a first letter more, and pages
    7, 218, ... (mod 211) are lost."""
    pages = table(spark, sf_dir, "pages")
    damaged = pages.where("page_id is null or page_id % 211 <> 7").withColumn("html", F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("x"), "html")).otherwise(F.col("html")))
    return warc.audited(warc.replica(pages), warc.replica(damaged))


OP3_SQL = """
WITH r AS (SELECT page_id, page_id // 4096 AS shard, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
  'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS record FROM pages)
SELECT page_id, shard, (sum(strlen(record)) OVER w - strlen(record))::BIGINT AS first_byte, (sum(strlen(record)) OVER w)::BIGINT AS end_byte, sha256(record) AS sha256,
  CASE WHEN page_id % 211 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'changed' ELSE 'ok' END AS status
FROM r WINDOW w AS (PARTITION BY shard ORDER BY page_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _count_of(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [_count_of(kind) for kind in ("email", "ip", "card", "phone")]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).drop("_row")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_w FROM o),
l AS (SELECT *, (1.5::DOUBLE * total - capped) / open_w AS level FROM r),
f AS (SELECT level FROM l WHERE level * w <= cap ORDER BY capped, level LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f) * w, cap::DOUBLE)) AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5(d.doc_id::VARCHAR || ':mix-1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM j
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("doc_row")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; every seventh label is moved on by one."""
    moved = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = hard_negatives.mine(hard_negatives.vectors(moved, F.col("vec_id") % 100 == 0))
    return found.drop("anchor_row", "positive_row", "negative_row")


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = conversation_trie.turns(table(spark, sf_dir, "conversations"))
    nodes, ends = conversation_trie.prefix_tree(*conversation_trie.grafted(placed))
    digests = conversation_trie.end_digests(ends)
    return nodes.join(digests, ["depth", "p", "q"], "left").drop("p", "q").fillna({"ends_sha256": hashlib.sha256(b"").hexdigest()})


OP13_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base,
  xor(list_reduce([4294967295::UBIGINT] || list_transform(range(8 * length(conv_id::VARCHAR)), lambda i: ((ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)::UBIGINT),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), 4294967295::UBIGINT)::BIGINT % 4 AS h FROM o GROUP BY conv_id),
c AS (SELECT k.conv_id, k.base, k.h, least(k.h, coalesce(b.own, 0)) AS taken, least(k.h, coalesce(b.own, 0)) + greatest(k.own - k.h, 0) AS n FROM k LEFT JOIN k b ON b.conv_id = k.base),
r AS (SELECT o.conv_id, taken + place - h + 1 AS depth, role, text FROM o JOIN c USING (conv_id) WHERE place >= h
  UNION ALL SELECT c.conv_id, place + 1, role, text FROM o JOIN c ON o.conv_id = c.base WHERE place < taken),
m AS (SELECT conv_id, depth, array_to_string(list(sha256(length(role)::VARCHAR || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS prefix,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nd AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM m JOIN c USING (conv_id) GROUP BY depth, prefix),
up AS (SELECT nd.conv_id, nd.depth, p.conv_id AS parent FROM nd JOIN m ON m.conv_id = nd.conv_id AND m.depth = nd.depth - 1 JOIN nd p ON p.depth = m.depth AND p.prefix = m.prefix),
ch AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
f AS (SELECT nd.*, coalesce(n_children, 0) AS n_children FROM nd LEFT JOIN ch USING (conv_id, depth)),
s AS (SELECT v.conv_id, v.depth, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
  FROM f v JOIN m ON m.depth = v.depth AND m.prefix = v.prefix JOIN f u ON u.conv_id = m.conv_id AND u.depth >= v.depth GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM f JOIN s USING (conv_id, depth) LEFT JOIN up USING (conv_id, depth)
"""


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_token_files, op3_warc_audit, op4_toxicity, op5_pii, op6_ngram_join, op7_mix, op8_byte_bpe, op9_quality_rules, op10_substring_dedup, op11_license_scan, op12_hard_negatives, op13_conversation_trie)}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op3_warc_audit": OP3_SQL, "op7_mix": OP7_SQL, "op12_hard_negatives": OP12_SQL, "op13_conversation_trie": OP13_SQL}
