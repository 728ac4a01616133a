"""The queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, cells, language, lm, mixing, partenum, pivots, suffixes, token_files, wrapper

TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality; background: all documents. Rounded to 6 places."""
    out = lm.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").filter("quality = 1"))
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


def op2_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = mixing.weighed(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return mixing.plan(weighed).select("doc_id", "size", "source_size", "target", "taken")


def op5_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.joined(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_removed(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op8_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.grouped(_read(spark, sf_dir, "embeddings"))


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extracted(_read(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_pivots": op2_pivots,
    "op3_bpe": op3_bpe,
    "op4_mix": op4_mix,
    "op5_partenum": op5_partenum,
    "op6_suffixes": op6_suffixes,
    "op7_token_files": op7_token_files,
    "op8_cells": op8_cells,
    "op9_wrapper": op9_wrapper,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op1_lm": lm.ORACLE,
    "op2_pivots": pivots.ORACLE,
    "op4_mix": mixing.ORACLE,
    "op5_partenum": partenum.ORACLE,
    "op6_suffixes": suffixes.ORACLE,
    "op8_cells": cells.ORACLE,
}
