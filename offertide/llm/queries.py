"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offertide.llm import (
    codes, exact_dedup, jaccard, language, mixing, packing, preferences, resampling, secrets, sentencepieces, sharding, topk, warc,
)
from offertide.llm.common import table
from offertide.llm.sql import codes_sql, resampling_sql

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op3_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return preferences.preference_pairs(table(spark, folder, "conversations"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(table(spark, folder, "documents"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_report(table(spark, folder, "documents"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_report(table(spark, folder, "documents"))


def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.capture_report(table(spark, folder, "pages"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents")).drop("_text_hash")


def op11_sentencepieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = sentencepieces.decode(sentencepieces.encode(docs, keep=["doc_id"]))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.code_report(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_packing, op2_mixing, op3_preference_pairs, op4_language, op5_exact_dedup, op6_sharding, op7_top_k,
    op8_warc, op9_secrets, op10_jaccard, op11_sentencepieces, op12_resampling, op13_vector_codes)}

_TURN = r"'<|' || role || E'|>\n' || text || E'<|end|>\n'"


def _side(name: str, side: int, count: str) -> str:
    there = f"side = {side} AND pos >= common"
    return f"""CASE WHEN max({count}) > 0 THEN coalesce(string_agg(s, '' ORDER BY pos) FILTER ({there}), '') END AS {name}_completion,
        CASE WHEN max({count}) > 0 THEN coalesce(string_agg(
            (ahead + length(role) + 5)::BIGINT || ':' || (ahead + length(role) + 5 + length(text))::BIGINT, ',' ORDER BY pos)
            FILTER ({there} AND role = 'assistant'), '') END AS {name}_mask"""


ORACLES: dict[str, str] = {
    "op2_mixing": r"""
        WITH l AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        d AS (SELECT *, 2 * length(bin(size)) + ((size >> greatest(length(bin(size)) - 2, 0)) & 1) AS class,
                ((('0x' || substr(md5(concat_ws('|', '11|mix', doc_id::VARCHAR)), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
            FROM l),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
        r AS (SELECT *, sum(source_size) OVER o AS sizes, sum(weight) OVER o AS weights,
                sum(source_size) OVER () AS all_sizes, sum(weight) OVER () AS all_weights
            FROM w WHERE source_size > 0 WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
        share AS (SELECT max((all_sizes - 3 * (sizes - source_size))::DOUBLE / (all_weights - (weights - weight))::DOUBLE) AS share FROM r),
        t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(share, 0) * weight) AS target FROM w, share),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
        c AS (SELECT source, class, count(*) AS m FROM d GROUP BY source, class),
        q AS (SELECT c.class, c.m, p.*, sum(m) OVER (PARTITION BY c.source ORDER BY class)::BIGINT AS so_far,
                ((('0x' || substr(md5('11|start|' || coalesce('0' || c.source, '1')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS start
            FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
        e AS (SELECT *, (floor(so_far * (rate - floor(rate)) + start) - floor((so_far - m) * (rate - floor(rate)) + start))::BIGINT AS quota FROM q),
        k AS (SELECT d.*, row_number() OVER (PARTITION BY source, class ORDER BY u) AS pos FROM d)
        SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN pos <= quota THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM k JOIN e ON k.class = e.class AND k.source IS NOT DISTINCT FROM e.source""",
    "op3_preference_pairs": rf"""
        WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
                replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
            FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT pair_id, count(*) FILTER (side = 0) AS c, count(*) FILTER (side = 1) AS r FROM t GROUP BY pair_id),
        d AS (SELECT a.pair_id, min(a.pos) AS first FROM t a JOIN t b
            ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 0 AND b.side = 1
            WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
        k AS (SELECT n.*, CASE WHEN least(c, r) = 0 THEN 0 ELSE coalesce(d.first, least(c, r)) END AS common
            FROM n LEFT JOIN d USING (pair_id)),
        y AS (SELECT t.*, c, r, common, {_TURN} AS s FROM t JOIN k USING (pair_id)),
        x AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, side, pos >= common ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM y)
        SELECT pair_id, max(common)::BIGINT AS common_turns,
            coalesce(string_agg(s, '' ORDER BY pos) FILTER (side = 0 AND pos < common), '') AS prompt,
            {_side("chosen", 0, "c")}, {_side("rejected", 1, "r")}
        FROM x GROUP BY pair_id""",
    "op5_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        WINDOW g AS (PARTITION BY t)""",
    "op7_top_k": """
        WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, r.v) DESC, r.vec_id)::INTEGER AS rank
            FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
    "op8_warc": """
        SELECT page_id, bytes AS payload_bytes, sha AS payload_digest,
            CASE WHEN bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN bytes >= 100 AND page_id <> first THEN first END AS refers_to, true AS has_request, true AS has_metadata
        FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS bytes, sha256(coalesce(html, '')) AS sha,
                min(page_id) OVER (PARTITION BY html) AS first FROM pages)""",
    "op12_resampling": resampling_sql(),
    "op13_vector_codes": codes_sql(),
}
