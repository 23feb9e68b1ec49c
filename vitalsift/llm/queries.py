"""One registered query per operator, over the whole of its table, with SQL twins where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalsift.llm import (
    alignment,
    archive,
    bytepairs,
    fingerprints,
    grammar,
    language,
    neardup,
    packing,
    pieces,
    private,
    repair,
    secret_scan,
    vectors,
)
from vitalsift.llm.common import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.find_near_duplicates(Workspace(spark, "vectors"), table(spark, sf_dir, "embeddings"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find_near_duplicates(Workspace(spark, "neardup"), table(spark, sf_dir, "documents"))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.token_files(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_columns(pieces.encode_decode(table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest_columns(private.find_private(table(spark, sf_dir, "documents")))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "secrets")
    return secret_scan.digest_columns(secret_scan.find_secrets(work, table(spark, sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_pages(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(Workspace(spark, "alignment"), table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    segments = repair.repair(Workspace(spark, "repair"), repair.damage(conversations))
    return repair.with_all(conversations, repair.summarise(segments))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.digest_columns(bytepairs.encode_decode(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_token_id_output": op5_token_id_output,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii": op7_pii,
    "op8_secret_scans": op8_secret_scans,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_bpe": op13_bpe,
}

_BASE32_SHA1 = """(
  SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(d.hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1), ''
    ORDER BY i) FROM range(32) t(i))"""

# Components: whatever links reach, named by the smallest member.
_REACHED = """
reached(a, b) AS (
  SELECT id, id FROM nodes
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
named AS (SELECT a AS id, min(b) AS component_id FROM reached GROUP BY a)"""

ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": f"""
WITH RECURSIVE nodes AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT p.id AS a, q.id AS b FROM nodes p JOIN nodes q ON p.id <> q.id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
{_REACHED}
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
       coalesce(n.component_id, v.vec_id) AS component_id, coalesce(n.component_id, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN named n ON n.id = v.vec_id""",
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
nodes AS (SELECT DISTINCT id FROM words),
shingles AS MATERIALIZED (
  SELECT DISTINCT id, shingle FROM (
    SELECT id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words)),
sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS MATERIALIZED (
  SELECT p.id AS a, q.id AS b, count(*) AS n FROM shingles p JOIN shingles q USING (shingle)
  WHERE p.id <> q.id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b
  WHERE 100 * common.n >= 75 * (p.n + q.n - common.n)),
{_REACHED}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, n.component_id, n.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.id = d.doc_id JOIN named n ON n.id = d.doc_id""",
    "op9_warc": f"""
WITH d AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex,
         octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
r AS (SELECT hex, max(page_id) AS response FROM d GROUP BY hex)
SELECT d.page_id, d.payload_bytes::BIGINT AS payload_bytes, {_BASE32_SHA1} AS payload_digest,
       CASE WHEN d.page_id = r.response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> r.response THEN r.response END AS refers_to
FROM d JOIN r USING (hex)""",
}
