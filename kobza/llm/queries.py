"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kobza.llm.bpe_automaton import encode_digests
from kobza.llm.common import crc_rest, table, tokenizer_path
from kobza.llm.context_mixing import score_texts
from kobza.llm.cover_tree import near_duplicates
from kobza.llm.jaccard import jaccard_components
from kobza.llm.langid import identify_languages
from kobza.llm.oracles import SQL
from kobza.llm.packing import pack_documents
from kobza.llm.quality import score_quality
from kobza.llm.secrets import secret_digests
from kobza.llm.toxicity import score_toxicity
from kobza.llm.vantage_tree import nearest_neighbours


def rest_is(modulus: int, rest: int) -> Column:
    return F.coalesce(crc_rest(F.col("doc_id"), modulus) == rest, F.lit(False))


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rest_is(3, 1))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), rest_is(7, 2))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_vantage_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), rest_is(4, 2))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rest_is(5, 3))


def op10_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pu_quality, op2_best_fit_packing, op3_context_mixing, op4_jaccard_join, op5_cover_tree_dedup, op6_vantage_tree_search, op7_gru_language, op8_bpe_automaton, op9_toxicity_chain, op10_randomness_secrets)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
