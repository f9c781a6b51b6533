"""The corpus pipeline: each stage reads what its predecessor kept, and writes Parquet.

All stages but the last return the columns of what they read, whatever further columns there are and whatever their
names; rows of one doc_id are rows of their own unless said otherwise; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kobza.llm.common import clear, shared_folder, shrink_executors, table, tokenizer_path
from kobza.llm.jaccard import jaccard_components
from kobza.llm.langid import UNKNOWN, identify_languages
from kobza.llm.packing import pack_documents
from kobza.llm.secrets import redact_secrets
from kobza.llm.toxicity import score_toxicity


def columns(docs: DataFrame) -> list[F.Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def carried(docs: DataFrame, needed: list[str]) -> DataFrame:
    """doc_id, the columns needed, and all others in one struct, so that no operator's column clashes with them."""
    needed = ["doc_id", *(c for c in needed if c in docs.columns)]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(True).alias(unused(docs)), *others).alias("_others"))


def unused(docs: DataFrame) -> str:
    """A name that no column has: a struct needs a field even where nothing is carried."""
    name = "_"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def restored(found: DataFrame, docs: DataFrame, needed: list[str]) -> DataFrame:
    return found.select(*[F.col(f"`{c}`") if c in ("doc_id", *needed) else F.col(f"_others.`{c}`").alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; a text that is null or has no letter is rejected, as is every text where
    there is nothing to learn from. Null languages teach nothing. Texts are read whole; repeated rows are treated alike."""
    needed = ["text", "lang"]
    found = identify_languages(carried(docs, needed), F.lit(False), keep=[*needed, "_others"])
    return restored(found.where(F.col("lang_pred") != UNKNOWN), docs, needed)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not predict to be toxic. Null and empty texts have no words and are kept; documents
    without a label are judged like all others. Texts are read whole; repeated rows are treated alike."""
    needed = ["text"]
    scored = score_toxicity(carried(docs, needed), table(spark, sf_dir, "labels"), F.lit(False), keep=[*needed, "_others"])
    return restored(scored.where("predicted = 0"), docs, needed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id. Documents without shingles (null, empty or blank
    texts) all stay, and so do rows without a doc_id. Of equal rows one stays; other rows of one doc_id stay together."""
    first = jaccard_components(docs).where("doc_id = component_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").select(*columns(docs))
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark, and n_chars, where there is such a column,
    counted anew (null for a null text). Texts are scanned whole; repeated rows are treated alike."""
    clean = redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their sequences and places there. A null or empty text is one piece, its separator; a
    very long one as many as it needs. Repeated rows are packed as often as they occur; other columns are not read."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def lean(stage: Callable) -> Callable:
    """The stage, begun with executors that have given back what the stage before has left in their heaps."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]
STAGES = [(name, lean(stage)) for name, stage in STAGES]
#: No SQL expresses the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written below the session's shared folder and read again; a
    table that the next stage has read is emptied."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            clear(spark, before)
        before = path
    return docs
