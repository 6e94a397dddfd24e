"""The queries of this package and, where SQL can express one over whole tables, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, jaccard, langid, packing, quality, substrings, vectors, warc
from .shared import shared_folder, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter("NOT held_out"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs)).select("doc_id", "quality", "posterior", "keep")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup(docs, passage=substrings.PASSAGE).select("doc_id", "text", "n_removed")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(table(spark, sf_dir, "pages"), shared_folder(spark))
    return back.select(F.col("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_topk": op2_topk,
    "op3_langid": op3_langid,
    "op4_jaccard": op4_jaccard,
    "op5_quality": op5_quality,
    "op6_html": op6_html,
    "op7_packing": op7_packing,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_warc": op10_warc,
}

_SOUND = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE_SQL: dict[str, str] = {
    "op2_topk": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::DOUBLE) AS e FROM embeddings WHERE {_SOUND}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op4_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g'), ' ') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 1 AND w[1] = '' THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
        t AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        link AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
                 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(low.b, s.doc_id)) AS component_id
        FROM s LEFT JOIN low ON low.a = s.doc_id
    """,
    "op8_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                             WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.9),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper, octet_length(encode(html))::BIGINT AS size FROM p)
        SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN size >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN size >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
        FROM m
    """,
}
