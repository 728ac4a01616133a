"""Sinks: CSV and Parquet folders, partitioned results, JSON documents and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Header, ISO dates, nothing for null; one folder a value of the partition columns."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").option("nullValue", "").option("emptyValue", "").partitionBy(*partition_by).csv(path)


def to_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def to_json(spark: SparkSession, path: str, **parts: Column) -> None:
    """One document whose members are the named literals or structs."""
    spark.range(1).select(F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])).alias("value")).write.mode("overwrite").text(path)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
