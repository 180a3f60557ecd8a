"""The registered queries of the training-data operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, language, line_dedup, packing, simhash, token_counts, topk, toxicity, warc
from .runtime import small_batches, vocabulary

BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, budget=3)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, language.TRAIN_ROWS))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), k=10, every=100, pivots=topk.PIVOTS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.attribute(_table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), ratio=line_dedup.RATIO, min_pages=line_dedup.MIN_PAGES)
    return found.select("doc_id", "source", "text", "n_lines", "n_dropped")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=embedding_dedup.THRESHOLD)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"), toxicity.TRAIN_ROWS))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_topk": op5_topk,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        n AS (SELECT *, sqrt(list_dot_product(z, z)) AS norm FROM v WHERE list_dot_product(z, z) > 0),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.z, b.z) / (a.norm * b.norm) >= 0.93),
        r(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
        SELECT id AS vec_id, CAST((SELECT count(*) FROM l WHERE l.a = r.id) AS BIGINT) AS n_links, min(reached) AS component_id, id = min(reached) AS kept
        FROM r GROUP BY id""",
    "op7_line_dedup": """
        WITH docs AS (SELECT row_number() OVER () AS rid, * FROM documents),
        pages AS (SELECT DISTINCT source, coalesce(text, '') AS text FROM docs),
        totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
        lines AS (
            SELECT DISTINCT source, text, trim(line, ' ') AS line
            FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages)
            WHERE trim(line, ' ') <> ''),
        boilerplate AS (
            SELECT l.source, l.line
            FROM (SELECT source, line, count(*) AS pages FROM lines GROUP BY source, line) l
            JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
            WHERE pages >= 5 AND pages > host_pages * 0.1),
        parts AS (
            SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
            FROM docs WHERE text IS NOT NULL),
        marked AS (
            SELECT p.rid, p.line_no, p.line, b.line IS NOT NULL AS dropped
            FROM parts p LEFT JOIN boilerplate b ON p.source IS NOT DISTINCT FROM b.source AND trim(p.line, ' ') = b.line),
        rebuilt AS (
            SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped), '') AS text,
                   count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped
            FROM marked GROUP BY rid)
        SELECT d.doc_id, d.source, r.text, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped
        FROM docs d LEFT JOIN rebuilt r ON d.rid = r.rid""",
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(octet_length(encode(html)), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS n,
                     first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS owner FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND n > 1 THEN owner END AS refers_to
        FROM m""",
}
