"""Windows over irregular series.

A series is a key (`by`, one or more columns) with rows ordered by `at`. Every window is
partitioned by the key, so series are spread over the cluster; none is global. Rows are
frames of the series unless days are named. "Past" frames leave the current row out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lacuna.functions.labels import holds


@dataclass(frozen=True)
class Series:
    """Key and order of a table of series."""

    by: tuple[str, ...]
    at: str

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.at)

    @property
    def days(self) -> WindowSpec:
        """Ordered by day number, for frames in calendar days."""
        return Window.partitionBy(*self.by).orderBy(F.unix_date(F.col(self.at)))

    def within(self, *more: str) -> Series:
        return Series((*self.by, *more), self.at)

    def past(self, n: int, skip: int = 1) -> WindowSpec:
        return self.ordered.rowsBetween(-(n - 1) - skip, -skip)

    def last(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def earlier(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, -1)

    # -- order and gaps

    def lag(self, x: str | Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.ordered)

    def lead(self, x: str | Column, k: int = 1) -> Column:
        return F.lead(x, k).over(self.ordered)

    def gap_days(self, k: int = 1) -> Column:
        return F.datediff(F.col(self.at), self.lag(self.at, k))

    def segments(self, df: DataFrame, gap: int, name: str = "segment") -> DataFrame:
        """Numbers the stretches between gaps of more than `gap` days."""
        opened = df.withColumn("__gap", self.gap_days())
        return opened.withColumn(name, F.sum(F.when(F.col("__gap") > gap, 1).otherwise(0)).over(self.so_far)).drop("__gap")

    def gaps(self, df: DataFrame, longer: int) -> DataFrame:
        """(key, from, to, days) of gaps longer than so many days, longest first."""
        out = df.withColumn("from", self.lag(self.at)).withColumn("days", self.gap_days())
        return out.filter(F.col("days") > longer).select(*self.by, "from", F.col(self.at).alias("to"), "days").orderBy(F.desc("days"), *self.by, "from")

    def changed(self, x: str) -> Column:
        """Whether x differs from the row before; false on a first row."""
        return holds(F.col(x) != self.lag(x))

    # -- fills

    def carried(self, x: str, most: int | None = None) -> Column:
        """The last value seen, if it is no older than `most` days."""
        value = F.last(x, ignorenulls=True).over(self.so_far)
        return value if most is None else F.when(self.age(x) <= most, value)

    def age(self, x: str) -> Column:
        """Days since x was last present."""
        return F.datediff(F.col(self.at), F.last(F.when(F.col(x).isNotNull(), F.col(self.at)), ignorenulls=True).over(self.so_far))

    def filled_once(self, x: str) -> Column:
        """x, or the row before's x: fills one missing value in a row."""
        return F.coalesce(F.col(x), self.lag(x))

    # -- rolling statistics

    def z(self, x: str, n: int, least: int | None = None, past: bool = True, population: bool = False) -> Column:
        """Distance from the mean of n rows in their standard deviations; null under `least` values or at sd 0."""
        frame = self.past(n) if past else self.last(n)
        sd = (F.stddev_pop if population else F.stddev_samp)(x).over(frame)
        return F.when(F.count(x).over(frame) >= (least or n), (F.col(x) - F.avg(x).over(frame)) / F.nullif(sd, F.lit(0.0)))

    def robust_z(self, x: str, n: int, least: int | None = None) -> Column:
        """Distance from the past median in 1.4826 median absolute deviations."""
        frame = self.past(n)
        seen = F.collect_list(x).over(frame)
        middle = F.percentile(x, 0.5).over(frame)
        apart = F.array_sort(F.transform(seen, lambda v: F.abs(v - middle)))
        k = F.size(apart)
        mad = (F.element_at(apart, F.floor((k + 1) / 2).cast("int")) + F.element_at(apart, F.floor(k / 2 + 1).cast("int"))) / 2
        return F.when(k >= (least or n), (F.col(x) - middle) / F.nullif(1.4826 * mad, F.lit(0.0)))

    def mean(self, x: str | Column, n: int, least: int, skip: int = 1) -> Column:
        frame = self.past(n, skip)
        return F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame))

    def sd(self, x: str, n: int, least: int) -> Column:
        frame = self.past(n)
        return F.when(F.count(x).over(frame) >= least, F.stddev_samp(x).over(frame))

    def median(self, x: str, n: int, least: int, skip: int = 1) -> Column:
        frame = self.past(n, skip)
        return F.when(F.count(x).over(frame) >= least, F.percentile(x, 0.5).over(frame))

    def unchanged(self, x: str) -> Column:
        """1 where x repeats the row before's value, else 0; 0 on a first row."""
        return holds(F.col(x) == self.lag(x)).cast("double")

    def moved(self, x: str) -> Column:
        """Whether x differs from the row before; first rows and missing values count as moves."""
        return F.coalesce(F.col(x) != self.lag(x), F.lit(True))

    def days_since(self, test: str) -> Column:
        """Days since a boolean column last held."""
        return F.datediff(F.col(self.at), F.last(F.when(F.col(test), F.col(self.at)), ignorenulls=True).over(self.so_far))

    # -- changes

    def log_change(self, x: str, k: int = 1) -> Column:
        """log of x over its value k rows before."""
        before = self.lag(x, k)
        return F.when((F.col(x) > 0) & (before > 0), F.log(F.col(x) / before))

    def calendar_change(self, x: str, days: int, slack: int = 4) -> Column:
        """log of x over the last value `days` to `days + slack` days before."""
        before = F.last(x).over(self.days.rangeBetween(-(days + slack), -days))
        return F.when((F.col(x) > 0) & (before > 0), F.log(F.col(x) / before))

    def native_change(self, x: str, k: int, every: int) -> Column:
        """The log change over k rows, only where they are exactly k periods of `every` days."""
        return F.when(self.gap_days(k) == every * k, self.log_change(x, k))

    def unbroken_sum(self, df: DataFrame, x: str, n: int, name: str) -> DataFrame:
        """Sum of the last n values, null where one of them is missing."""
        return df.withColumn(name, F.when(F.count(x).over(self.last(n)) == n, F.sum(x).over(self.last(n))))

    def index(self, r: str, start: float = 100.0) -> Column:
        """start * exp of the running sum of log returns; missing returns count as 0."""
        return start * F.exp(F.sum(F.coalesce(F.col(r), F.lit(0.0))).over(self.so_far))

    def linked(self, r: str, start: float = 100.0) -> Column:
        """start * the running product of 1 + r."""
        return start * F.exp(F.sum(F.log1p(F.coalesce(F.col(r), F.lit(0.0)))).over(self.so_far))

    def runs(self, df: DataFrame, test: Column) -> DataFrame:
        """(key, first, last, rows) of stretches of rows where the test holds."""
        marked = df.withColumn("__on", holds(test)).withColumn("__run", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(self.so_far))
        return marked.filter("__on").groupBy(*self.by, "__run").agg(F.min(self.at).alias("first"), F.max(self.at).alias("last"), F.count("*").alias("rows")).drop("__run")

    def running(self, x: str | Column) -> Column:
        """Sum of x up to and with the row; missing values add nothing, and it is 0 before the first."""
        return F.coalesce(F.sum(x).over(self.ordered.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))

    def entries_of(self, on: Column) -> Column:
        """Whether a condition starts to hold here: it holds, and did not at the row before."""
        return holds(on) & ~holds(F.lag(on).over(self.ordered))

    def entries(self, on: str, segment: str | None = None) -> Column:
        """Whether a signal starts here: it is on, and was off before or in another segment."""
        was = self.lag(on)
        fresh = ~holds(was)
        if segment:
            fresh = fresh | holds(F.col(segment) != self.lag(segment))
        return holds(F.col(on)) & fresh


def ewma_volatility(df: DataFrame, s: Series, r: str, name: str = "ewma_vol", keep: float = 0.94) -> DataFrame:
    """Volatility from the returns before each row: v <- keep v + (1 - keep) r^2, from the first return's square.

    Rows after a missing return have none. Recursive, so a pass over each series in order;
    key the series by segment to start anew after gaps.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(s.at)
        v, prior, out = None, None, []
        for x in rows["__r"]:
            if prior is not None:
                v = prior * prior if v is None else keep * v + (1 - keep) * prior * prior
            out.append(None if prior is None else math.sqrt(v))
            prior = None if pd.isna(x) else x
        rows["__vol"] = pd.array(out, "Float64")
        return rows[[*s.by, s.at, "__vol"]]

    kept = df.select(*s.by, s.at, F.col(r).alias("__r"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*s.by, s.at)) + ", __vol double"
    folded = kept.groupBy(*s.by).applyInPandas(fold, schema)
    return df.join(folded, [*s.by, s.at], "left").withColumnRenamed("__vol", name)
