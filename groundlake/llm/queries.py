"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hmm, licenses, maintext, quality, sharding, simhash, spelling, sst, toxicity, warc, whitening
from .common import documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(documents(spark, sf_dir))


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op5_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(documents(spark, sf_dir).select("doc_id", "lang", "text")).select("doc_id", "quality.*")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).drop("url")


def op7_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sst.token_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=16)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("decoded_same")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it doesn't fit a long; ``deviation_exact`` has it to 38 digits."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("deviation", "deviation_exact").withColumn("deviation", F.expr("try_cast(deviation_exact AS bigint)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_decontaminate, op3_hidden_markov, op4_license_templates, op5_divergence_rules, op6_warc, op7_token_tables, op8_toxic_sentences, op9_ring_shards, op10_byte_bpe, op11_main_text, op12_spelling_variants, op13_whitening)
    return {f.__name__: f for f in found}


ORACLES: dict[str, str] = {}
