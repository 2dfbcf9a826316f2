"""The subpackage's registered queries: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, embedding, licenses, mixing, packing, quality, simhash, substring, warc

BYTE_BPE, MULTI_BPE, PIECE_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_chat_tree(spark, sf_dir):
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.tree(told.unionByName(more), BYTE_BPE, public_tokenizers.PATTERN))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op5_embedding_dedup(spark, sf_dir):
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op7_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_substring_dedup(spark, sf_dir):
    return substring.dedup(_table(spark, sf_dir, "documents"), digests=True)


def op9_quality(spark, sf_dir):
    return quality.rules(_table(spark, sf_dir, "documents"), PIECE_BPE, MULTI_BPE, public_tokenizers.PATTERN)


def op10_warc(spark, sf_dir):
    return warc.digests(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_chat_tree, op3_license_scan, op4_packing, op5_embedding_dedup, op6_byte_bpe, op7_mixing, op8_substring_dedup, op9_quality, op10_warc)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op2_chat_tree": r"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ':' || chr(10)) + length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g')) + length('</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id""",
    "op3_license_scan": licenses.scan_sql(),
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op8_substring_dedup": rf"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE m < doc_id
), word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_warc": warc.digests_sql(),
}
