"""Panels that the queries share, in both languages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.series import Series
from lacuna.session import table

Plan = tuple[Callable[[SparkSession, str], DataFrame], str | None]

S = Series(("series",), "d")


def r6(x: Column | str) -> Column:
    """Rounded for comparison between engines."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def big(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quotes: a series per priority; mean price of the day in whole cents, first, last, high, low, orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("d"), "o_totalprice", "o_orderkey")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return o.groupBy("series", "d").agg(
        (cents / 100 / F.count("*")).alias("price"), F.count("*").alias("n"), F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low")
    )


DAILY = """daily AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS d, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100 / count(*) AS price,
  count(*) AS n, arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close, max(o_totalprice) AS high, min(o_totalprice) AS low
  FROM orders GROUP BY ALL)"""

#: The panel with holes: no price on days whose number modulo 7 is 0.
def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).withColumn("x", F.when(F.pmod(F.unix_date("d"), F.lit(7)) != 0, F.col("price")))


HOLED = DAILY + """, holed AS (SELECT *, CASE WHEN date_diff('day', DATE '1970-01-01', d) % 7 <> 0 THEN price END AS x FROM daily)"""


def targets(spark: SparkSession, sf_dir: str, horizon: int = 30, slack: int = 4) -> DataFrame:
    """The panel with its forward targets and a feature, the change over the week before."""
    from lacuna.operators.joins import forward_targets

    days = daily(spark, sf_dir).select("series", "d", "price").withColumn("f", S.calendar_change("price", 7))
    return forward_targets(days, S, "price", [horizon], slack)


TARGETS = DAILY + """, lagged AS (SELECT a.series, a.d, a.price, CASE WHEN e.d >= a.d - 11 THEN ln(a.price / e.price) END AS f
  FROM daily a ASOF LEFT JOIN daily e ON a.series = e.series AND e.d <= a.d - 7),
targets AS (SELECT a.series, a.d, a.price, a.f, e.d AS "end", ln(e.price / a.price) AS ret, e.price - a.price AS change, sign(e.price - a.price)::INT AS direction
  FROM lagged a ASOF JOIN daily e ON a.series = e.series AND e.d >= a.d + 30 WHERE e.d <= a.d + 34)"""
