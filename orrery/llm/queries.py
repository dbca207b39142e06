"""The registered queries of the text-corpus operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontam, language, mixing, neardup, negatives, pii, quality, secrets, sharding, simhash, substrings, tokens, whitening
from orrery.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.query(spark, documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(spark, documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.query(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(spark, documents(spark, sf_dir))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(documents(spark, sf_dir))


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.query(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_mix_sources, op2_token_counts, op3_personal_data, op4_quality_rules, op5_secret_scan, op6_decontaminate, op7_near_duplicates, op8_language, op9_shard,
        op10_repeated_substrings, op11_hard_negatives, op12_simhash_groups, op13_whitening, pipeline,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": decontam.SQL, "op7_near_duplicates": neardup.SQL, "op11_hard_negatives": negatives.SQL}
