"""The queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prosegrain.llm import url_filters as urls
from prosegrain.llm.common import table
from prosegrain.llm.decontamination import contaminated
from prosegrain.llm.mixing import mix_plan
from prosegrain.llm.quality_classifier import quality_classifier
from prosegrain.llm.quality_rules import quality_rules
from prosegrain.llm.sharding import shards
from prosegrain.llm.simhash import simhash_components
from prosegrain.llm.token_counts import token_counts
from prosegrain.llm.token_files import token_files
from prosegrain.llm.toxicity import toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, posterior quality and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 bytes and sentencepiece tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of three-word shingles and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    return mix_plan(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    listed = spark.createDataFrame([(x,) for x in urls.LISTED], "url string")
    return urls.url_filters(table(spark, sf_dir, "pages"), listed)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that are not held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to token files and read back."""
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that overlap."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal bytes."""
    return shards(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_simhash, op4_mixing, op5_url_filters, op6_toxicity, op7_token_files, op8_decontamination, op9_sharding, op10_quality_classifier)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": urls.oracle()}
