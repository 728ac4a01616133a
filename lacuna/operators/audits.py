"""Data-quality audits as tables of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.functions.labels import holds
from lacuna.operators.series import Series

#: What spreadsheets show for failed formulas (fixed values).
SHEET_ERRORS = ("#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A", "#NULL!", "#NUM!")


def counted(test: Column) -> Column:
    return F.sum(holds(test).cast("long"))


def bar_faults(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """Bars whose high is under, or low over, their open or close."""
    o, h, lo, c = (F.col(x) for x in (open_, high, low, close))
    return counted((h < F.greatest(o, c)) | (lo > F.least(o, c)))


def off_tick(x: str, per_unit: float) -> Column:
    """Values that are no multiple of 1 / per_unit."""
    scaled = F.col(x) * per_unit
    return counted(F.abs(scaled - F.round(scaled)) > 1e-9)


def change_faults(df: DataFrame, s: Series, close: str, change: str, percent: str, by: float = 0.011) -> DataFrame:
    """Rows whose reported change or percent change is not that of the closes."""
    before = s.lag(close)
    out = df.withColumn("__d", F.col(close) - before).withColumn("__p", F.try_divide(F.col(close) - before, before) * 100)
    return out.groupBy(*s.by).agg(F.count("__d").alias("compared"), counted(F.abs(F.col("__d") - F.col(change)) > 1e-9).alias("change_faults"), counted(F.abs(F.col("__p") - F.col(percent)) > by).alias("percent_faults"))


def completeness(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """Rows, present values of each column, repeated and unordered dates."""
    before = df.withColumn("__repeats", F.count("*").over(Window.partitionBy(*s.by, s.at)))
    return before.groupBy(*s.by).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in columns], counted(F.col("__repeats") > 1).alias("repeated"), F.countDistinct(s.at).alias("dates"))


def frequency_name(df: DataFrame, s: Series) -> DataFrame:
    """daily or weekly, by the median gap."""
    gaps = df.withColumn("__g", s.gap_days())
    return gaps.groupBy(*s.by).agg(F.percentile("__g", 0.5).alias("median_gap")).withColumn("frequency", F.when(F.col("median_gap") >= 6, "weekly").otherwise("daily"))


def alignment(df: DataFrame, by: Sequence[str], age: str) -> DataFrame:
    """How old the matches of an as-of join are."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count(age).alias("matched"), F.min(age).alias("least_age"), F.percentile(age, 0.5).alias("median_age"), F.percentile(age, 0.95).alias("p95_age"), F.max(age).alias("largest_age"))


def missing_weekdays(df: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Weekdays between a key's first and last date without a row."""
    span = df.groupBy(*by).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    every = span.select(*by, F.explode(F.sequence("lo", "hi")).alias(at)).filter(F.weekday(at) < 5)
    return every.join(df.select(*by, at).distinct(), [*by, at], "left_anti")


def sheet_errors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells that show a spreadsheet error, by column and error."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("cell")) for c in columns])).alias("x")).select("x.*")
    return long.filter(F.col("cell").isin(*SHEET_ERRORS)).groupBy("column", "cell").count()


def rolls(df: DataFrame, s: Series, symbol: str, price: str, same_contract: str) -> DataFrame:
    """One row a change of contract: gap in days, raw and same-contract log return and their difference, the basis."""
    raw = df.withColumn("from_symbol", s.lag(symbol)).withColumn("gap", s.gap_days()).withColumn("raw_return", s.log_change(price)).withColumn("rolled", s.changed(symbol))
    return raw.filter("rolled").select(*s.by, s.at, "from_symbol", F.col(symbol).alias("to_symbol"), "gap", "raw_return", F.col(same_contract).alias("same_contract_return"), (F.col("raw_return") - F.col(same_contract)).alias("basis"))


def roll_identity(df: DataFrame, raw: str, same_contract: str, basis: str, rolled: str) -> DataFrame:
    """Changes of contract, those with a basis, and the largest error of raw = same contract + basis there."""
    error = F.abs(F.col(raw) - F.col(same_contract) - F.col(basis))
    return df.filter(F.col(rolled)).agg(F.count("*").alias("rolls"), F.count(basis).alias("with_basis"), F.max(error).alias("largest_error"))


def nearby_returns(df: DataFrame, by: Sequence[str], ret: str, rolled: str) -> DataFrame:
    """Spread of returns on days with and without a change of contract."""
    on = F.col(rolled)
    return df.groupBy(*by).agg(F.count(F.when(on, F.col(ret))).alias("roll_days"), F.stddev_samp(F.when(on, F.col(ret))).alias("roll_sd"), F.stddev_samp(F.when(~on, F.col(ret))).alias("other_sd"), F.max(F.abs(ret)).alias("largest"))


def panel_document(df: DataFrame, s: Series, match: str, usable: str, gap: int) -> DataFrame:
    """One row a series: rows, dates, matches, usable rows, and its gaps of more than so many days as an array."""
    gaps = s.gaps(df, gap).groupBy(*s.by).agg(F.array_sort(F.collect_list(F.struct("from", "to", "days"))).alias("gaps"))
    counts = df.groupBy(*s.by).agg(F.count("*").alias("rows"), F.min(s.at).alias("first"), F.max(s.at).alias("last"), F.count(match).alias("matched"), counted(F.col(usable)).alias("usable"))
    return counts.join(gaps, list(s.by), "left")
