"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, toxicity
from .common import documents
from .fingerprints import fingerprints
from .jaccard import near_duplicate_classes
from .orc_tokens import tokens_round_trip
from .outliers import quality
from .packing import pack
from .secret_scan import secret_digest
from .token_counts import token_counts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, sf_dir))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "copies", "copy", "shuffle_key")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op10_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_orc": op2_token_orc,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_robust_outliers": op5_robust_outliers,
    "op6_token_counts": op6_token_counts,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_language_id": op8_language_id,
    "op9_curve_packing": op9_curve_packing,
    "op10_prefix_fingerprints": op10_prefix_fingerprints,
}

#: DuckDB SQL of those that SQL expresses.
ORACLES: dict[str, str] = {"op7_poisson_mix": mixing.ORACLE}
