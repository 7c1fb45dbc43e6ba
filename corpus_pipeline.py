"""A training-data pipeline over documents; each stage calls one of the numbered operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import bpe, decontamination, langid, pii, simhash
from orogen.llm.common import cut, free_names
from orogen.shipping import ship

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LEAST_SCORE = 0.4  # below this no language is likelier than the others together by any useful margin


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: those without a letter, and those whose likeliest language has a score under LEAST_SCORE. A missing lang is filled in.

    Null and empty texts have no letter and go. Repeated rows are judged alike and each stay. Where no row has a language nothing is learned, and only documents without a letter
    go. An empty table gives an empty one; the columns stay as they are, whatever their names.
    """
    ship(spark)
    said_lang, said_score = free_names(docs, "_lang_pred", "_lang_score")
    model = langid.train(docs, order=F.xxhash64(F.col("doc_id"), F.lit("sample")))
    said = langid.predict(docs, model, docs.columns, names=(said_lang, said_score))
    kept = said.where((F.col(said_lang) != langid.UNKNOWN) & (F.col(said_score) >= LEAST_SCORE)) if model else said.where(F.col("text").rlike(r"\p{L}"))
    return kept.select(*(F.coalesce("lang", said_lang).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group stays: the smallest doc_id, null ids last.

    Null and empty texts are one group; repeated ids with different texts stand for themselves; of equal rows one stays; an empty table gives an empty one.
    """
    ship(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule finds contaminated by benchmark passages go.

    Null and empty texts have no words and stay; equal texts are judged alike, each row for itself; ids play no part; an empty benchmark or table takes nothing away.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is masked, and n_chars follows the new text.

    No row goes. A null text stays null, with a null n_chars; texts of any length are read whole; repeated rows each stay; an empty table gives an empty one.
    """
    ship(spark)
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for every row.

    A null or empty text has no tokens; repeated rows each have a row; other columns are not looked at; an empty table gives no row.
    """
    ship(spark)
    return bpe.encode_decode(docs, TOKENIZER)


STAGES = [("language id", language), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("pii", mask_personal_data), ("bpe", tokenise)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
