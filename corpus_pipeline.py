"""Corpus pipeline: from raw documents to token shards in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written as Parquet and read again by the next one. All but the
last return the columns of ``documents``.

Nulls, empty texts, repeated rows and an empty table have the results that the
operators' docstrings state: a text without a letter goes in the first stage,
a row repeated in all columns is one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbook.llm.common import table, written
from matchbook.llm.decontaminate import decontaminate
from matchbook.llm.langid import keep_known_languages, language_model
from matchbook.llm.mixing import ADDED as MIX_COLUMNS
from matchbook.llm.mixing import mix_sources
from matchbook.llm.neardup import keep_representatives
from matchbook.llm.tokens import tokenize_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which the string kernel finds none of the languages.

    The kernel learns from the labelled documents outside the held-out fold.
    """
    return keep_known_languages(docs, language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the representative of each class of near duplicates."""
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window of words with the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources have the same expected share; a copy is a row."""
    mixed = mix_sources(docs)
    return mixed.drop(*MIX_COLUMNS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards and list their documents, copies included, as read from them."""
    return tokenize_documents(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]
ORACLE_SQL = None  # a trained kernel, signatures and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
