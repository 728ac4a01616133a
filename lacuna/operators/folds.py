"""Selections that walk a series in order and carry state from row to row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _walk(rows: Column, keep, after) -> Column:
    """Rows that keep(state, row) admits; the state is after(row) of the last one kept."""
    start = F.struct(F.lit(None).cast("date").alias("s"), F.slice(rows, 1, 0).alias("out"))
    step = lambda a, x: F.when(keep(a["s"], x), F.struct(after(x).alias("s"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    return F.aggregate(rows, start, step, lambda a: a["out"])


def greedy(df: DataFrame, by: Sequence[str], start: str, end: str, take: Sequence[str] = ()) -> DataFrame:
    """Rows whose start is not before the end of the row kept last, walking by start.

    One ordered fold a key; picks are few, as they do not overlap.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), *take)))
    kept = _walk(rows, lambda last, x: last.isNull() | (x["s"] >= last), lambda x: x["e"])
    return df.filter(F.col(end).isNotNull()).groupBy(*by).agg(kept.alias("__k")).select(*by, F.explode("__k").alias("__k")).select(*by, F.col("__k.s").alias(start), F.col("__k.e").alias(end), *[f"__k.{c}" for c in take])


def greedy_count(df: DataFrame, by: Sequence[str], start: str, end: str, name: str = "n_effective") -> DataFrame:
    """How many rows greedy() keeps of each key."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))))
    state = F.struct(F.lit(None).cast("date").alias("s"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.when(a["s"].isNull() | (x["s"] >= a["s"]), F.struct(x["e"].alias("s"), (a["n"] + 1).alias("n"))).otherwise(a)
    return df.filter(F.col(end).isNotNull()).groupBy(*by).agg(F.aggregate(rows, state, step, lambda a: a["n"]).alias(name))


def spaced(df: DataFrame, by: Sequence[str], at: str, days: int, keep_last: bool = False) -> DataFrame:
    """Rows at least so many days after the one kept last; keep_last adds the latest row, flagged."""
    rows = F.array_sort(F.collect_set(F.col(at)))
    start = F.struct(F.lit(None).cast("date").alias("s"), F.slice(rows, 1, 0).alias("out"))
    step = lambda a, x: F.when(a["s"].isNull() | (F.datediff(x, a["s"]) >= days), F.struct(x.alias("s"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    out = df.groupBy(*by).agg(F.aggregate(rows, start, step, lambda a: a["out"]).alias("k"), F.max(at).alias("__last"))
    if keep_last:
        out = out.withColumn("k", F.when(F.array_contains("k", F.col("__last")), F.col("k")).otherwise(F.concat("k", F.array("__last"))))
    spread = out.select(*by, F.posexplode("k").alias("place", at))
    return spread.select(*by, at)


def row_spaced(df: DataFrame, by: Sequence[str], index: str, rows: int) -> DataFrame:
    """Rows at least so many row numbers after the one kept last: with consecutive numbers, every rows-th."""
    order = F.array_sort(F.collect_list(F.col(index).cast("long")))
    start = F.struct(F.lit(None).cast("long").alias("s"), F.slice(order, 1, 0).alias("out"))
    step = lambda a, x: F.when(a["s"].isNull() | (x - a["s"] >= rows), F.struct(x.alias("s"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    return df.groupBy(*by).agg(F.aggregate(order, start, step, lambda a: a["out"]).alias("k")).select(*by, F.explode("k").alias(index))


def phase_cohorts(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Every distinct greedy chain that begins before the first row's end: (key, cohort, start, end).

    A cohort is numbered by its chain's first start. The rows of a key are one array; each
    of the few starting points walks it once.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))))
    packed = df.filter(F.col(end).isNotNull()).groupBy(*by).agg(rows.alias("r"))
    starts = packed.withColumn("from", F.explode(F.filter("r", lambda x: x["s"] < F.col("r")[0]["e"])))
    chain = _walk(F.filter("r", lambda x: x["s"] >= F.col("from")["s"]), lambda last, x: last.isNull() | (x["s"] >= last), lambda x: x["e"])
    chains = starts.select(*by, chain.alias("c")).dropDuplicates([*by, "c"])
    return chains.select(*by, F.col("c")[0]["s"].alias("cohort"), F.explode("c").alias("x")).select(*by, "cohort", F.col("x.s").alias(start), F.col("x.e").alias(end))


def modulo_cohort(at: Column, horizon: Column | int, origin: str = "2000-01-01") -> Column:
    """Days since the origin modulo the horizon: the phase that a row belongs to."""
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    return F.pmod(F.datediff(at, F.lit(origin).cast("date")), h)
