"""The registered query of each operator, over its whole table with production parameters, and its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from artifactgate.llm import decontaminate, embeddings, lines, minhash, mixing, phrases, pii, preferences, quality, tokens, toxicity, warc, whitening
from artifactgate.llm.common import table


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.report(table(spark, sf_dir, "conversations"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op8_decontaminate, op9_minhash, op6_toxicity, op4_lines, op1_mixing, op5_embeddings, op2_pii, op7_quality, op3_warc, op10_preferences, op11_phrases, op12_tokens, op13_whitening)}

ORACLES: dict[str, str] = {"op8_decontaminate": decontaminate.ORACLE_SQL, "op9_minhash": minhash.ORACLE_SQL, "op3_warc": warc.ORACLE_SQL, "op5_embeddings": embeddings.ORACLE_SQL, "op10_preferences": preferences.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL}
