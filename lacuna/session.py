"""Session factory and small session helpers shared by every plan."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build(cores: int | None = None, app: str = "lacuna", **conf: str) -> SparkSession:
    """A local session with the settings the plans assume: UTC, ANSI casts, AQE."""
    n = cores or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
