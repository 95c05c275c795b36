"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagoscope.llm import (
    centroid_clustering, embedding_dedup, language_id, lexical_search, license_scan, line_dedup,
    minhash_dedup, mixing, quality_rules, sentencepiece_codec, sharding, token_counts, toxicity,
)
from pagoscope.llm.common import find_package, labelled_rows
from pagoscope.llm.oracle import ORACLE  # noqa: F401  registered with the queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def keep(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@register("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@register("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(~language_id.held_out()))
    ids = language_id.identify(docs, net)
    return ids.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@register("op7_embedding_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


@register("op2_minhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "group_id", "kept"
    )


@register("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix(docs, labels).drop("text_hash")


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(labelled_rows(3) == 1, F.lit(False))
    machine = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@register("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


@register("op11_centroid_clustering")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.assignments(table(spark, sf_dir, "embeddings"))


@register("op12_lexical_search")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_sharding")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))
