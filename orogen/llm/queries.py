"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import bpe, chat, conversation_repair, decontamination, langid, pii, secret_scan, simhash, token_alignment, token_files, topk, toxicity, url_filters
from orogen.shipping import ship


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_identification(_docs(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_docs(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_docs(spark, sf_dir), _vocabulary("word_bpe_49k.json"), end_id=1)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_docs(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_docs(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(ship(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(_docs(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audit(conversation_repair.damage(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")))


_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.t AS DOUBLE[]), CAST(c.t AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_language, op2_toxicity, op3_simhash, op4_topk, op5_secrets, op6_token_files, op7_chat, op8_pii, op9_decontamination, op10_bpe, op11_url_filters, op12_token_alignment, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": _TOP_K, "op5_secrets": secret_scan.oracle_sql(), "op11_url_filters": url_filters.oracle_sql(), "op13_conversation_repair": conversation_repair.oracle_sql()}
