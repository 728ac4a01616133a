"""Point-in-time joins: strict as-of, forward targets within a tolerance, next-row attachment, purging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.operators.series import Series


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], lt: str, rt: str, take: Sequence[str], strict: bool = True, bucket: Column | None = None, prefix: str = "") -> DataFrame:
    """Each left row with the latest right row of its key before it (strict) or not after it.

    Unmatched rows stay, with nulls; rt and the columns taken come as prefix + name. Both
    sides are unioned and sorted once by key and time, so it costs one shuffle and no
    range join. With `bucket`, an expression of the time column that never falls as time
    rises, a key is sorted in parts and the parts' last right rows are carried over in a
    second, small pass: a key that holds a large share of all rows does not land in one task.
    Of right rows with one time the one with the largest values of `take`, in their order, counts.
    """
    names = [rt, *take]
    l_side = left.withColumn("__t", F.col(lt)).withColumn("__side", F.lit(0 if strict else 2)).withColumn("__left", F.struct(*left.columns))
    r_side = right.filter(F.col(rt).isNotNull()).withColumn("__t", F.col(rt)).withColumn("__side", F.lit(1)).withColumn("__right", F.struct(*names))
    both = l_side.select(*by, "__t", "__side", "__left").unionByName(r_side.select(*by, "__t", "__side", "__right"), allowMissingColumns=True)
    key = list(by)
    if bucket is not None:
        both = both.withColumn("__b", bucket)
        key.append("__b")
    order = Window.partitionBy(*key).orderBy("__t", "__side", "__right").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__m", F.last("__right", ignorenulls=True).over(order)).filter("__left IS NOT NULL")
    if bucket is not None:
        lasts = both.filter("__right IS NOT NULL").groupBy(*key).agg(F.max_by("__right", F.struct("__t", "__right")).alias("__l"))
        spine = lasts.unionByName(both.filter("__left IS NOT NULL").select(*key).distinct(), allowMissingColumns=True).groupBy(*key).agg(F.first("__l", ignorenulls=True).alias("__l"))
        carry = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = spine.withColumn("__c", F.last("__l", ignorenulls=True).over(carry)).select(*key, "__c")
        found = found.join(carried, key, "left").withColumn("__m", F.coalesce("__m", "__c"))
    return found.select("__left.*", *[F.col(f"__m.{c}").alias(f"{prefix}{c}") for c in names])


def stale_to_null(df: DataFrame, age: Column, most: Column | int, columns: Sequence[str]) -> DataFrame:
    """The columns, null where the age is above the limit; an unknown age keeps them."""
    limit = F.lit(most) if isinstance(most, int) else most
    return df.withColumns({c: F.when(~F.coalesce(age > limit, F.lit(False)), F.col(c)) for c in columns})


def forward_targets(df: DataFrame, s: Series, price: str, horizons: Sequence[int], slack: int = 4, gap: int | None = None, crossing: str = "none") -> DataFrame:
    """One row per row and horizon: the first later row H to H + slack days on, and what the price did.

    crossing: 'none' takes any end; 'segment' rejects ends with another number of gaps of
    more than `gap` days up to them than the origin has. Dates must be unique in a series.
    Horizons without an end are left out. Ranges of days need no join.
    """
    out, columns = df, [*s.by, s.at, price]
    if crossing == "segment":
        out, columns = s.segments(df, gap, "__segment"), [*columns, "__segment"]
    ends = [F.first(F.struct(F.col(s.at).alias("end"), F.col(price).alias("p"), *([F.col("__segment").alias("g")] if crossing == "segment" else []))).over(s.days.rangeBetween(h, h + slack)) for h in horizons]
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), e.alias("e")) for h, e in zip(horizons, (F.col(f"__e{h}") for h in horizons), strict=True)]))
    out = out.withColumns({f"__e{h}": e for h, e in zip(horizons, ends, strict=True)}).withColumn("__t", each)
    end = F.col("__t.e.p")
    ok = F.col("__t.e").isNotNull() & (F.col(price) > 0) & (end > 0)
    if crossing == "segment":
        ok = ok & (F.col("__t.e.g") == F.col("__segment"))
    return out.filter(ok).select(
        *[c for c in df.columns], F.col("__t.horizon").alias("horizon"), F.col("__t.e.end").alias("end"), F.log(end / F.col(price)).alias("ret"), (end - F.col(price)).alias("change"), F.signum(end - F.col(price)).cast("int").alias("direction")
    )


def attach_next(source: DataFrame, panel: DataFrame, by: Sequence[str], available: str, at: str, take: Sequence[str]) -> DataFrame:
    """Each panel row that is the first after some source rows, with the latest of them.

    Source rows after the panel's last row are dropped.
    """
    src = source.select(*by, F.col(available).alias("__t"), F.lit(2).alias("__side"), F.struct(available, *take).alias("__src"))
    pan = panel.select(*by, F.col(at).alias("__t"), F.lit(1).alias("__side")).distinct()
    both = src.unionByName(pan, allowMissingColumns=True)
    after = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(1, Window.unboundedFollowing)
    nxt = both.withColumn(at, F.first(F.when(F.col("__side") == 1, F.col("__t")), ignorenulls=True).over(after))
    best = nxt.filter(F.col("__src").isNotNull() & F.col(at).isNotNull()).groupBy(*by, at).agg(F.max_by("__src", "__t").alias("__src"))
    return best.select(*by, at, "__src.*")


def matured(origins: DataFrame, train: DataFrame, by: Sequence[str], at: str, end: str, sums: Sequence[Column]) -> DataFrame:
    """Aggregates over the training rows whose target ended strictly before each origin.

    sums are running sums, so instead of an inequality join both sides are unioned and
    summed once in the order of time; ends equal to the origin come after it.
    """
    names = [f"__s{i}" for i in range(len(sums))]
    t = train.select(*by, F.col(end).alias("__t"), F.lit(1).alias("__side"), *[x.cast("double").alias(n) for x, n in zip(sums, names, strict=True)])
    o = origins.withColumn("__o", F.struct(*origins.columns)).select(*by, F.col(at).alias("__t"), F.lit(0).alias("__side"), "__o")
    order = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, -1)
    both = t.unionByName(o, allowMissingColumns=True)
    summed = both.withColumns({n: F.coalesce(F.sum(n).over(order), F.lit(0.0)) for n in names})
    return summed.filter("__o IS NOT NULL").select("__o.*", *[F.col(n).alias(f"sum_{i}") for i, n in enumerate(names)])


def unique_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df; running it fails if a key repeats."""
    n = F.count("*").over(Window.partitionBy(*columns))
    return df.withColumn("__n", n).filter(F.assert_true(F.col("__n") == 1, F.lit(f"keys {columns} repeat")).isNull()).drop("__n")


def paired(a: DataFrame, b: DataFrame, on: Sequence[str], suffix: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Rows of both tables with equal keys, other columns told apart by suffix."""
    a = a.withColumnsRenamed({c: c + suffix[0] for c in a.columns if c not in on})
    b = b.withColumnsRenamed({c: c + suffix[1] for c in b.columns if c not in on})
    return a.join(b, list(on))
