"""A corpus pipeline: language ID, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents, and more that docs may have, whatever their names. Every stage
works on all that the one before kept. Cases, stage by stage: null and empty texts are
rejected by language_id, so later stages meet them only if called alone: jaccard_join keeps
them, suffix_dedup leaves them as they are, mix takes them with complete epochs of their
source alone (they have no words), and bpe encodes them as no ids. Documents without an id are rows like others, but that
jaccard_join and suffix_dedup neither drop nor cut them. Repeated rows are repeated; rows
that share an id stay or go together. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, language, mixing, partenum, suffixes
from lacuna.llm.common import discard, staged

#: A text of LETTERS letters or more in which no language has a score of SCORE is in none (words repeated over and
#: over, say); of shorter ones the score tells too little.
LETTERS, SCORE = 200, 0.35


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID rejects texts in no language: null texts, texts without a letter, long ones like no language.

    Documents without a language get the one found.
    """
    own = {c: f"own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    found = language.identified(docs.withColumnsRenamed(own), "lang", *own.values())
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    fine = (F.col("lang_pred") != language.UNKNOWN) & ((F.col("score") >= SCORE) | (letters < LETTERS))
    kept = found.filter(fine).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return partenum.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a document with a smaller id has too go from the text; n_chars follows."""
    return suffixes.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the mixed documents, as digests, and their round trip."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify), ("jaccard_join", join_near), ("suffix_dedup", cut_repeats), ("mix", mix), ("bpe", encode)]

#: Similarity joins, suffix matches and BPE have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        discard(before)  # of a stage's output, the next one's is all that is needed
    return STAGES[-1][1](spark, docs, sf_dir)
