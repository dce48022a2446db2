"""Corpus preparation in five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's input. All but the last return the columns
of ``documents``; the last returns what is read back from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.llm import dartminhash, decontam, langid, mixing, tokenbin
from tagweave.llm.common import Stages
from tagweave.llm.queries import END_ID, tokenizer_path
from tagweave.session import prepare
from tagweave.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; text without letters or null is rejected."""
    prepare(spark)
    return langid.keep_known(spark, docs, langid.training_fold(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest."""
    prepare(spark)
    return dartminhash.keep_one(docs, dartminhash.near_duplicates(spark, docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    prepare(spark)
    return decontam.drop_contaminated(spark, docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight; a document taken twice comes twice."""
    prepare(spark)
    return mixing.mixed_documents(spark, docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    prepare(spark)
    return tokenbin.token_files(spark, docs, tokenizer_path(), END_ID)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_files", token_files)]

#: Cross-parsing, signatures and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    prepare(spark)
    stages = Stages(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stages.write(stage(spark, docs, sf_dir), name)
    return docs
