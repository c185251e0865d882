"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, language_id, lm_scoring, main_text, order_minhash, packing, pii, sharded_lloyd, simhash, threshold_search, token_align, token_records
from .common import scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-records")
    token_records.write_token_records(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    index = token_records.with_starts(token_records.index_token_records(spark, path))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_documents(spark, sf_dir))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(_documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment_measures(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_lloyd.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dims=64, clusters=40, rounds=5, scale=256, seed="2:")


def op13_threshold_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_token_records, op3_lm_scoring, op4_pii, op5_main_text, op6_best_fit_packing, op7_simhash, op8_order_minhash, op9_byte_bpe, op10_language_id, op11_token_align, op12_sharded_lloyd, op13_threshold_top5, pipeline)
}

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SCALED = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v"


def _lloyd_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Every round written out: distances to all centroids, the least, and the columns' floored means."""
    parts = [
        f"k AS MATERIALIZED (SELECT vec_id, {_SCALED} FROM embeddings WHERE {_FINITE} AND len(embedding) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM k QUALIFY c < {clusters})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT vec_id, k.v, c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c{n}.v[i]) * (k.v[i] - c{n}.v[i])))::BIGINT AS d FROM k, c{n})")
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM d{n} GROUP BY vec_id)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT best.c AS c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{n})")
            parts.append(f"s{n} AS (SELECT c, i, floor(sum(x) / count(*))::BIGINT AS x FROM m{n} GROUP BY c, i)")
            parts.append(f"n{n} AS (SELECT c, list(x ORDER BY i) AS v FROM s{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(n{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN n{n} USING (c))")
    last = f"""
        SELECT vec_id, c::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c = best.c"""
    return "WITH " + ", ".join(parts) + last


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_sharded_lloyd": _lloyd_sql(),
    "op13_threshold_top5": f"""
        WITH k AS MATERIALIZED (SELECT vec_id, {_SCALED} FROM embeddings WHERE {_FINITE}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM k q JOIN k c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
    """,
}
