"""Registered queries of the text operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlake.llm import (
    dartminhash,
    decontaminate,
    extract,
    importance,
    langid,
    negatives,
    packing,
    piececount,
    quality,
    secrets,
    substrings,
    tokenfiles,
    toxicity,
)
from pairlake.llm.common import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piececount.digest(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_documents(spark, sf_dir))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_documents(spark, sf_dir))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.digest(_documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.digest(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.digest(table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_documents(spark, sf_dir), _tokenizer("byte_bpe_multi_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_extract,
        op2_token_counts,
        op3_decontaminate,
        op4_toxicity,
        op5_pack,
        op6_secrets,
        op7_substrings,
        op8_quality,
        op9_near_duplicates,
        op10_token_files,
        op11_hard_negatives,
        op12_importance,
        op13_language,
    )
}
ORACLES: dict[str, str] = {
    "op6_secrets": secrets.ORACLE,
    "op8_quality": quality.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_importance": importance.ORACLE,
}
