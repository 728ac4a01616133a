"""Rows to keep: first, last and best of a key, with explicit order; grids of parameters; quality tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.functions.labels import holds


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the first in the order, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def last_value(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """key and the value in the row that is last by order: an aggregate, so it is combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_use(df: DataFrame, keys: Sequence[str], observation: str, at: str) -> DataFrame:
    """The earliest row that uses each observation: a value carried forward counts once."""
    return keep_first(df.filter(F.col(observation).isNotNull()), [*keys, observation], [at])


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")


def grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations of a few literal values, one column a name."""
    out = spark.range(1).drop("id")
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return out


def usable_quote(age: Column, interest: Column, price: Column, most_days: int = 4) -> Column:
    """Recent, with open interest and a positive price; missing is no."""
    return holds((age <= most_days) & (interest > 0) & (price > 0))


def quality_tier(age: Column, volume_share: Column, median_interest: Column, interest: Column) -> Column:
    """primary, curve_mark or none: how far a quote can be trusted."""
    primary = holds((volume_share >= 0.5) & (median_interest >= 500) & (age <= 3))
    return F.when(primary, "primary").when(holds((interest >= 100) & (age <= 4)), "curve_mark").otherwise("none")
