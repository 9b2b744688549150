"""The queries of this subpackage, one for each operator, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, language_id, pii, toxicity
from .common import crc_of, table
from .exact_dedup import exact_groups
from .mixing import mix
from .packing import pack
from .simhash_dedup import near_groups
from .substring_dedup import remove_repeats
from .warc import archive


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_of("doc_id") % 5 != 0, "doc_id", "text", "toxic")
    return toxicity.score(docs, network).select("doc_id", (crc_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs, crc_of("doc_id") % 4 != 2, "doc_id", "text", "lang")
    return language_id.identify(docs, profiles).select("doc_id", (crc_of("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_mixing, op4_imatch, op5_warc, op6_pii, op7_language, op8_exact_dedup, op9_simhash, op10_suffix_dedup)}

#: A digest's 160 bits as 32 letters of five bits, each out of two neighboring hexadecimal digits.
BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((instr('0123456789abcdef', substr(h, 1 + (5 * j) // 4, 1)) - 1) * 16
    + instr('0123456789abcdef', substr(h, 2 + (5 * j) // 4, 1)) - 1) >> (3 - (5 * j) % 4)) & 31), 1) for j in range(32)], '')"""

ORACLE_SQL = {
    "op5_warc": f"""
        SELECT page_id, strlen(body) AS payload_bytes, {BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))""",
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    # Bytes as pairs of hexadecimal digits; every 50-byte string of every document with the smallest document that has it.
    "op10_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, length(hex(coalesce(text, ''))) // 2 AS n FROM documents),
        parts AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 1098) AS part FROM (SELECT doc_id, h, n, unnest(range(0, greatest(n - 49, 0), 500)) AS base FROM d)),
        w AS (SELECT doc_id, base + j AS i, substr(part, 2 * j + 1, 100) AS g FROM (SELECT doc_id, base, part, unnest(range(least(500, n - 49 - base))) AS j FROM parts)),
        hit AS (SELECT w.doc_id, i FROM w JOIN (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING max(doc_id) > min(doc_id)) USING (g) WHERE least < w.doc_id),
        marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
        cut AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s FROM runs),
        kept AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * s + 1, 2 * (a - s)), '' ORDER BY s) AS head FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
