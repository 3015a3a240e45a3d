"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm import chat, decontaminate, langid, lines, mixing, neardup, phrases, quality, substrings, tokens, urlfilter, whitening, wrappers
from matchbook.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_mix_sources", mixing.ORACLE)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"))


@register("op2_decontaminate", decontaminate.ORACLE)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@register("op3_url_filter", urlfilter.ORACLE)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf, "pages").select("page_id", "url")).drop("url")


@register("op4_html_wrappers")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, sf, "pages").select("page_id", "url", "html"))


@register("op5_quality_rules", quality.ORACLE)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents").select("doc_id", "text")).drop("text", "clean_text")


@register("op6_near_duplicates")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text")) \
        .select("doc_id", "class_id", "is_representative")


@register("op7_token_shards")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.tokenize_documents(table(spark, sf, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.language_model(docs)
    return langid.identify(langid.held_out(docs.select("doc_id", "text")), model) \
        .select("doc_id", "held_out", "lang_pred", "score")


@register("op9_sentence_spans")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.dedup_spans(table(spark, sf, "documents").select("doc_id", "text"))


@register("op10_chat_formatting", chat.ORACLE)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return chat.format_chats(table(spark, sf, "conversations"))


@register("op11_phrase_collocations", phrases.ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents").select("text", "lang"))


@register("op12_line_dedup", lines.ORACLE)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op13_embedding_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    whole = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return whitening.by_component(whole.drop("embedding"))
