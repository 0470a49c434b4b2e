"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, jaccard, middle, negatives, packing, quality, secret_scan, sharding, suffixes, topk, toxicity, urls

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_bpe")
def _op1(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


@query("op2_packing")
def _op2(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), WORD_BPE)


def fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


@query("op3_repeats")
def _op3(spark, sf_dir):
    return suffixes.removed(table(spark, sf_dir, "documents"))


@query("op4_quality")
def _op4(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), fold(3) == 1
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out), held_out)


@query("op5_toxicity")
def _op5(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), fold(5) == 0
    return quality.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out), held_out)


@query("op6_exact_dedup", r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents) d
WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id)""")
def _op6(spark, sf_dir):
    return exact.dedup(table(spark, sf_dir, "documents")).drop("locator")


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query("op9_url_filter")
def _op9(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages"), RULES)


@query("op7_jaccard_join")
def _op7(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).drop("sid", "class_sid", "tid")


@query("op8_topk", """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) s) r
WHERE rank <= 5""")
def _op8(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_secrets")
def _op10(spark, sf_dir):
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN))


@query("op11_sharding", """
WITH RECURSIVE nodes(tree, parent, child, weight) AS (
  SELECT tree, '', 'g' || g, CASE WHEN g = 2 THEN 1 ELSE 8 END FROM (VALUES ('old'), ('grown')) t(tree), range(3) r(g) WHERE tree = 'grown' OR g < 2
  UNION ALL SELECT 'old', 'g' || (k // 2), 'g' || (k // 2) || 'r' || (k % 2), 4 FROM range(4) r(k)
  UNION ALL SELECT 'grown', 'g' || (k // 2), 'g' || (k // 2) || 'r' || (k % 2), CASE WHEN k = 4 THEN 1 ELSE 4 END FROM range(5) r(k)
  UNION ALL SELECT 'old', 'g' || (s // 8) || 'r' || (s // 4 % 2), CAST(s AS VARCHAR), 1 FROM range(16) r(s)
  UNION ALL SELECT 'grown', 'g' || (s // 8) || 'r' || (s // 4 % 2), CAST(s AS VARCHAR), 1 FROM range(17) r(s)),
keys AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
regions AS (SELECT key, tree, arg_min(child, -ln((CAST('0x' || substr(md5(key || '/' || child), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) / weight) AS node
  FROM keys, nodes WHERE parent = '' GROUP BY key, tree),
racks AS (SELECT key, r.tree, arg_min(child, -ln((CAST('0x' || substr(md5(key || '/' || child), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) / weight) AS node
  FROM regions r JOIN nodes n ON n.tree = r.tree AND parent = node GROUP BY key, r.tree),
shards AS (SELECT key, r.tree, CAST(arg_min(child, -ln((CAST('0x' || substr(md5(key || '/' || child), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) / weight) AS INTEGER) AS shard
  FROM racks r JOIN nodes n ON n.tree = r.tree AND parent = node GROUP BY key, r.tree),
crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
rows_ AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM documents, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, o.shard, CAST(row_number() OVER (PARTITION BY o.shard
    ORDER BY substr(md5(r.key || '/' || size || '/' || text_crc32), 1, 13), doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, g.shard AS grown_shard
FROM rows_ r JOIN shards o ON o.key = r.key AND o.tree = 'old' JOIN shards g ON g.key = r.key AND g.tree = 'grown'""")
def _op11(spark, sf_dir):
    return sharding.placed(table(spark, sf_dir, "documents"), sharding.balanced(16))


@query("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""")
def _op12(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


@query("op13_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS units FROM documents),
c AS (SELECT *, len(units) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS r FROM d),
p AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
      WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c),
s AS (SELECT doc_id, n, form, text, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s""")
def _op13(spark, sf_dir):
    return middle.digests(middle.transform(table(spark, sf_dir, "documents")))
