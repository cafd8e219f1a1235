"""The subpackage's queries and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base_sql, chat, exact_dedup, jaccard, langid, licenses, mixing, pieces, pii, secrets, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links", "n_set_links")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op2_personal_data``."""
    return op2_personal_data(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op6_secrets``."""
    return op6_secrets(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in secrets.KINDS], "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_personal_data": op2_personal_data,
    "op3_language_id": op3_language_id,
    "op4_licenses": op4_licenses,
    "op5_top_k": op5_top_k,
    "op6_secrets": op6_secrets,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_chat_format": op9_chat_format,
    "op10_source_mix": op10_source_mix,
    "personal_data_base": personal_data_base,
    "secrets_base": secrets_base,
}

ORACLES: dict[str, str] = {
    "personal_data_base": base_sql.scan_sql(base_sql.PERSONAL, "place, s"),
    "secrets_base": base_sql.scan_sql(base_sql.SECRET, "s, place"),
    # for conversations without quotations, as the shipped ones are; tests plant quotations
    "op9_chat_format": """
        WITH m AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown')) - 1 AS position
                   FROM conversations)
        SELECT conv_id, position // 256 AS chunk, count(*) AS n_messages, 0::BIGINT AS n_replies,
               string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>', chr(10) ORDER BY position) AS conversation
        FROM m GROUP BY 1, 2""",
    "op5_top_k": """
        WITH v AS (SELECT row_number() OVER () AS row, vec_id,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.row, a.vec_id AS query_id, b.vec_id,
                     list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row AND len(a.q) = len(b.q)),
        r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
              FROM documents)
        WINDOW same AS (PARTITION BY text_sha256)""",
    "op8_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' ')) END) AS gram
            FROM w WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        s AS (SELECT doc_id, md5(string_agg(gram, chr(0) ORDER BY gram)) AS set_key FROM g GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (
            SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)
            UNION ALL SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON len(x.ws) = 0 AND len(y.ws) = 0 AND x.doc_id <> y.doc_id),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
        k AS (SELECT doc_id, min(other) AS class_id, count(*) AS class_size FROM r GROUP BY 1),
        d AS (SELECT a, count(*) AS n_links, count(DISTINCT y.set_key) FILTER (x.set_key <> y.set_key) AS n_set_links
              FROM l LEFT JOIN s x ON x.doc_id = a LEFT JOIN s y ON y.doc_id = b GROUP BY 1)
        SELECT k.doc_id, class_id, class_size, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_set_links, 0)::BIGINT AS n_set_links
        FROM k LEFT JOIN d ON d.a = k.doc_id""",
    "op10_source_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
                   FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size,
                     [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
              FROM d GROUP BY source),
        c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
                     coalesce(sum(source_size) OVER below, 0) AS full_size, coalesce(sum(w) OVER below, 0) AS full_w
              FROM s WINDOW below AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min((1.5::DOUBLE * total - 2.0::DOUBLE * full_size) / (all_w - full_w), source_size / w) AS level FROM c
              WHERE w * ((1.5::DOUBLE * total - 2.0::DOUBLE * full_size) / (all_w - full_w)) < cap),
        t AS (SELECT source, source_size, least(cap, w * level) AS target FROM c, l),
        r AS (SELECT d.doc_id, size, source_size, target,
                     CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS each,
                     row_number() OVER (PARTITION BY d.source ORDER BY size, md5(concat(coalesce(doc_id::VARCHAR, ''), ':17')), doc_id) - 1 AS rank,
                     ('0x' || substr(md5(concat(coalesce(d.source, ''), ':17')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS off
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               ((floor((rank + 1) * each + off) - floor(rank * each + off)) * size)::BIGINT AS taken
        FROM r""",
}
