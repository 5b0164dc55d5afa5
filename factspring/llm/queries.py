"""The registered queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, language_id, near_dedup, packing, quality_rules, ranked_search, sharding, suffix_dedup, token_counts, vector_codes, vector_dedup


LENIENT = 0.2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_quality_rules_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), pooled=True)


def op1_quality_rules_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a fifth of false rejections, so that few labels certify cutoffs too."""
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), alpha=LENIENT)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digest_conversations(turns.union(own)).drop("error")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tier")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality_rules": op1_quality_rules,
    "op1_quality_rules_pooled": op1_quality_rules_pooled,
    "op1_quality_rules_lenient": op1_quality_rules_lenient,
    "op2_language_id": op2_language_id,
    "op3_sharding": op3_sharding,
    "op4_near_dedup": op4_near_dedup,
    "op5_chat": op5_chat,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_vector_codes": op11_vector_codes,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES = {
    "op11_vector_codes": vector_codes.codes_sql(),
    "op12_vector_dedup": vector_dedup.LINKS_SQL,
    "op13_ranked_search": ranked_search.SEARCH_SQL,
    "op3_sharding": """
WITH s(v) AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n))),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, len(bytes)::BIGINT + 1 AS size, CASE WHEN len(bytes) = 0 THEN 0 ELSE xor(list_reduce(bytes, lambda c, x: xor(v[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) END AS text_crc32 FROM b, s),
t AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32) - size AS start, sum(size) OVER () AS total FROM c),
p AS (SELECT *, least(7, (2 * start + size) * 8 // (2 * total))::INTEGER AS shard FROM t)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p""",
    "op4_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(0, len(words) - 4), lambda i: array_to_string(words[i + 1:i + 5], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, seen) AS (SELECT DISTINCT a, a FROM l UNION SELECT node, l.b FROM r JOIN l ON r.seen = l.a),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON node = w.doc_id""",
    "op6_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(n - 49, 0))) AS p, unnest(list_transform(range(0, greatest(n - 49, 0)), lambda p: h[2 * p + 1:2 * p + 100])) AS s FROM b),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN m USING (s) WHERE first < doc_id),
k AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
r AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM k GROUP BY ALL),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM r GROUP BY doc_id),
cut AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM r UNION ALL SELECT doc_id, 0, min(a) FROM r GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(h[2 * cut.a + 1:2 * coalesce(cut.z, n)], '' ORDER BY cut.a) AS h FROM cut JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, b.h))) AS kept_sha256 FROM b LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op1_quality_rules": quality_rules.rules_sql(),
    "op1_quality_rules_pooled": quality_rules.pooled_rules_sql(),
    "op1_quality_rules_lenient": quality_rules.rules_sql(LENIENT),
    "op5_chat": chat.digest_sql().replace("FROM turns", """FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))"""),
    "op10_fingerprints": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
t AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  list_transform(string_split(text, chr(10)), lambda l: list_transform(regexp_extract_all(l, '(?s)(.{0,63}?[.!?]|.{1,64})'), lambda u: left(sha256(u), 32))) AS a,
  list_transform(string_split(edited, chr(10)), lambda l: list_transform(regexp_extract_all(l, '(?s)(.{0,63}?[.!?]|.{1,64})'), lambda u: left(sha256(u), 32))) AS b,
  list_transform(string_split(next_text, chr(10)), lambda l: list_transform(regexp_extract_all(l, '(?s)(.{0,63}?[.!?]|.{1,64})'), lambda u: left(sha256(u), 32))) AS c FROM e),
s AS (SELECT *, list_distinct(list_transform(flatten(a), lambda u: left(u, 8))) AS x, list_distinct(list_transform(flatten(b), lambda u: left(u, 8))) AS y, list_distinct(list_transform(flatten(c), lambda u: left(u, 8))) AS z FROM t)
SELECT doc_id, n_chars, edited_sha256,
  sha256(array_to_string(list_transform(a, lambda s: sha256(array_to_string(s, ''))), '')) || '/' || array_to_string(list_transform(a, lambda s: array_to_string(list_transform(s, lambda u: left(u, 8)), '')), '/') AS fingerprint,
  sha256(array_to_string(list_transform(b, lambda s: sha256(array_to_string(s, ''))), '')) || '/' || array_to_string(list_transform(b, lambda s: array_to_string(list_transform(s, lambda u: left(u, 8)), '')), '/') AS edited_fingerprint,
  CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END AS near_edited,
  CASE WHEN len(x) + len(z) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x, z)) / (len(x) + len(z)) END AS near_next,
  len(a)::BIGINT AS n_sections
FROM s""",
}
