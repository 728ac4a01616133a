"""Resampling inference with a hash instead of a random stream: any engine and any order gives the same draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.operators.folds import greedy

#: Statistics this close count as equal, so that no comparison hangs on the order of a sum.
EQUAL = 1e-9

def hashed(*parts: Column, below: Column) -> Column:
    """A number from 0 up to `below`, from the first 32 bits of an md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), below.cast("long"))


def block_length(horizon: Column, spacing: Column, n: Column, least: int = 3, up: bool = False) -> Column:
    """Rows that a horizon spans, rounded half to even (up: to the next whole number); `least` at least, a third of the rows at most."""
    rows = F.ceil(horizon / spacing) if up else F.bround(horizon / spacing)
    return F.least(F.greatest(F.lit(least), rows.cast("int")), F.greatest(F.lit(least), F.floor(n / 3).cast("int")))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds i from 0 and n, the rows of the group."""
    w = Window.partitionBy(*by)
    return df.withColumn("i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("n", F.count("*").over(w))


def block_means(rows: DataFrame, by: Sequence[str], xs: Sequence[str], reps: int, block: Column | int, seed: int) -> DataFrame:
    """Means of each x in replicates of circular blocks. rows: by, i, n and xs (see numbered).

    A replicate draws ceil(n / block) starts; block k covers start, start + 1, ... modulo n
    and the last is cut at n rows. All xs share the draws of their group. Instead of
    joining rows to every draw, prefix sums give each block's sum from two look-ups.
    """
    b = F.lit(block) if isinstance(block, int) else block
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*by)
    sums = rows.select(*by, "i", "n", b.cast("long").alias("__b"), *[F.coalesce(F.sum(x).over(w), F.lit(0.0)).alias(f"__p_{x}") for x in xs], *[F.sum(x).over(total).alias(f"__t_{x}") for x in xs])
    groups = sums.filter("i = 0").select(*by, "n", "__b", *[f"__t_{x}" for x in xs])
    draws = groups.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("__b")) - 1)))
    draws = draws.withColumn("__s", hashed(F.lit(seed), F.col("rep"), F.col("__k"), below=F.col("n"))).withColumn("__len", F.least(F.col("__b"), F.col("n") - F.col("__k") * F.col("__b")))
    draws = draws.withColumn("__e", F.pmod(F.col("__s") + F.col("__len"), F.col("n"))).withColumn("__round", F.floor((F.col("__s") + F.col("__len")) / F.col("n")))
    at = sums.select(*by, F.col("i").alias("__s"), *[F.col(f"__p_{x}").alias(f"__s_{x}") for x in xs])
    to = sums.select(*by, F.col("i").alias("__e"), *[F.col(f"__p_{x}").alias(f"__e_{x}") for x in xs])
    part = draws.join(at, [*by, "__s"]).join(to, [*by, "__e"])
    mean = lambda x: F.sum(F.col(f"__e_{x}") + F.col("__round") * F.col(f"__t_{x}") - F.col(f"__s_{x}")) / F.first("n")
    return part.groupBy(*by, "rep").agg(*[mean(x).alias(x) for x in xs])


def block_interval(rows: DataFrame, by: Sequence[str], x: str, reps: int, block: Column | int, seed: int, least: int = 5) -> DataFrame:
    """Mean, 95 % interval, standard error and one-sided p of a mean from block replicates; null under `least` rows."""
    means = block_means(rows, by, [x], reps, block, seed)
    spread = means.groupBy(*by).agg(F.percentile(x, 0.025).alias("ci_low"), F.percentile(x, 0.975).alias("ci_high"), F.stddev_samp(x).alias("se"), ((1 + F.sum((F.col(x) <= 0).cast("int"))) / (reps + 1)).alias("p_one_sided"))
    known = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean")).join(spread, list(by))
    return known.select(*by, "n", "mean", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("ci_low", "ci_high", "se", "p_one_sided")])


def block_correlation(rows: DataFrame, by: Sequence[str], x: str, y: str, reps: int, block: Column | int, seed: int) -> DataFrame:
    """Pearson's r of pairs with its 95 % interval from block replicates; pairs are drawn together."""
    sums = {"__x": F.col(x), "__y": F.col(y), "__xx": F.col(x) ** 2, "__yy": F.col(y) ** 2, "__xy": F.col(x) * F.col(y)}
    means = block_means(rows.withColumns(sums), by, list(sums), reps, block, seed)
    vx, vy = F.col("__xx") - F.col("__x") ** 2, F.col("__yy") - F.col("__y") ** 2
    r = F.when((vx > 1e-15) & (vy > 1e-15), (F.col("__xy") - F.col("__x") * F.col("__y")) / F.sqrt(vx * vy))
    spread = means.withColumn("__r", r).groupBy(*by).agg(F.percentile("__r", 0.025).alias("ci_low"), F.percentile("__r", 0.975).alias("ci_high"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).join(spread, list(by))


def shifted(rows: DataFrame, by: Sequence[str], x: str, y: str, shifts: Sequence[int] | None = None) -> DataFrame:
    """Correlation of x with y moved round by each shift, 1 to n - 1 where none are given: (by, shift, r). One join of rows by place."""
    each = F.when(F.col("n") > 1, F.sequence(F.lit(1).cast("long"), F.col("n") - 1)) if shifts is None else F.array(*[F.lit(s).cast("long") for s in shifts])
    moved = rows.withColumn("shift", F.explode(each)).withColumn("j", F.pmod(F.col("i") + F.col("shift"), F.col("n")))
    other = rows.select(*by, F.col("i").alias("j"), F.col(y).alias("__y"))
    return moved.join(other, [*by, "j"]).groupBy(*by, "shift").agg(F.corr(x, "__y").alias("r"))


def shift_p(rows: DataFrame, by: Sequence[str], x: str, y: str, shifts: Sequence[int] | None = None) -> DataFrame:
    """Two-sided p of a correlation against its circular shifts; all of them where none are given."""
    real = rows.groupBy(*by).agg(F.corr(x, y).alias("r0"), (F.max("n") if shifts is None else F.lit(len(shifts) + 1)).alias("__all"))
    null = real.join(shifted(rows, by, x, y, shifts), list(by), "left" if shifts is None else "inner")
    beaten = F.coalesce(F.sum((F.abs("r") >= F.abs("r0") - EQUAL).cast("int")), F.lit(0)) if shifts is None else F.sum((F.abs("r") >= F.abs("r0") - EQUAL).cast("int"))
    return null.groupBy(*by).agg(F.first("r0").alias("r"), ((1 + beaten) / F.first("__all")).alias("p"))


def quantile(values: Column, q: float) -> Column:
    """Quantile of the numbers of an array, linear between neighbours; null of an empty one."""
    ordered, place = F.array_sort(values), (F.size(values) - 1) * q
    low = F.floor(place).cast("int")
    at = lambda i: F.get(ordered, i)
    return F.when(F.size(values) > 0, at(low) + (place - low) * (F.coalesce(at(low + 1), at(low)) - at(low)))


def share_beyond(nulls: Column, value: Column) -> Column:
    """(1 + how many of the nulls reach the value) / (1 + how many there are)."""
    return F.when(value.isNotNull(), (1 + F.size(F.filter(nulls, lambda x: x >= value - EQUAL))) / (1 + F.size(nulls)))


def max_null(rows: DataFrame, family: Sequence[str], xs: Sequence[str], reps: int, block: Column | int, seed: int, joint: bool = True, iid: bool = False) -> DataFrame:
    """Studentised max-null over candidates xs of a family: t, raw and adjusted p.

    t = mean / se, se the sd of the replicate means; the null of a family is the largest
    of (replicate mean - mean) / se over its candidates, replicate by replicate.
    joint: all candidates share the draws of a replicate, else each has its own and the
    replicates meet by number. iid: se is that of independent rows, sd / sqrt(n).
    A family's replicates are one array, so nothing is joined with itself.
    """
    keys = list(family)
    if joint:
        means = block_means(rows, family, xs, reps, block, seed)
    else:
        means = block_means(rows, family, xs[:1], reps, block, seed)
        for i, x in enumerate(xs[1:], 1):
            means = means.join(block_means(rows, family, [x], reps, block, seed + i), [*keys, "rep"])
    known = [e for x in xs for e in (F.avg(x).alias(f"__m_{x}"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"__i_{x}"))]
    drawn = means.groupBy(*keys).agg(F.collect_list(F.struct(*xs)).alias("__reps"), *[F.stddev_samp(x).alias(f"__b_{x}") for x in xs])
    both = rows.groupBy(*keys).agg(*known).join(drawn, keys)
    se = {x: F.nullif(F.col(f"__{'i' if iid else 'b'}_{x}"), F.lit(0.0)) for x in xs}
    studentised = lambda x: F.transform("__reps", lambda r: (r[x] - F.col(f"__m_{x}")) / se[x])
    z = {x: studentised(x) for x in xs}
    both = both.select(*keys, *[F.col(f"__m_{x}") for x in xs], *[se[x].alias(f"__se_{x}") for x in xs], *[z[x].alias(f"__z_{x}") for x in xs])
    tops = F.transform(F.arrays_zip(*[f"__z_{x}" for x in xs]), lambda r: F.greatest(*[r[f"__z_{x}"] for x in xs]) if len(xs) > 1 else r[f"__z_{xs[0]}"])
    both = both.withColumn("__tops", F.filter(tops, lambda x: x.isNotNull()))
    each = [
        F.struct(
            F.lit(x).alias("candidate"), F.col(f"__m_{x}").alias("mean"), F.col(f"__se_{x}").alias("se"), (F.col(f"__m_{x}") / F.col(f"__se_{x}")).alias("t"),
            share_beyond(F.filter(F.col(f"__z_{x}"), lambda z: z.isNotNull()), F.col(f"__m_{x}") / F.col(f"__se_{x}")).alias("raw_p"), share_beyond(F.col("__tops"), F.col(f"__m_{x}") / F.col(f"__se_{x}")).alias("adjusted_p"),
        )
        for x in xs
    ]
    return both.select(*keys, F.explode(F.array(*each)).alias("c"), quantile(F.col("__tops"), 0.95).alias("null_95")).select(*keys, "c.*", "null_95")


def shifts(groups: DataFrame, by: Sequence[str], reps: int, margin: Column | int, seed: int) -> DataFrame:
    """(by, n, rep, shift): for each replicate a circular shift from the margin to n less the margin; groups: by and n, one row each.

    Where that leaves no shift, any from 1 to n - 1.
    """
    m = (F.lit(margin) if isinstance(margin, int) else margin).cast("long")
    low = F.when(F.col("n") > 2 * m, m).otherwise(F.lit(1).cast("long"))
    drawn = groups.filter("n > 1").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("__low", low)
    return drawn.withColumn("shift", F.col("__low") + hashed(F.lit(seed), F.col("rep"), *[F.col(c) for c in by], below=F.greatest(F.lit(1), F.col("n") - 2 * F.col("__low")))).drop("__low")


def against_largest(real: DataFrame, null: DataFrame, family: Sequence[str], stat: str) -> DataFrame:
    """real with the adjusted p of stat against the largest null over the candidates, replicate by replicate, and facts of that null.

    real: a row for each candidate of a family; null: family, rep and stat, any number of candidates each.
    """
    keys = list(family)
    tops = null.groupBy(*keys, "rep").agg(F.max(stat).alias("top")).filter("top IS NOT NULL").groupBy(*keys).agg(F.collect_list("top").alias("__tops"))
    best = real.groupBy(*keys).agg(F.max(stat).alias("best"))
    facts = tops.join(best, keys).select(*keys, "__tops", "best", F.size("__tops").alias("replicates"), F.aggregate("__tops", F.lit(0.0), lambda a, x: a + x).alias("__sum"))
    facts = facts.withColumns({"null_mean": F.col("__sum") / F.col("replicates"), "null_95": quantile(F.col("__tops"), 0.95), "family_p": share_beyond(F.col("__tops"), F.col("best"))})
    out = real.join(facts, keys, "left")
    return out.withColumn("adjusted_p", share_beyond(F.col("__tops"), F.col(stat))).drop("__tops", "__sum")


def model_shift_null(ledger: DataFrame, family: Sequence[str], candidate: str, actual: str, baseline: str, predicted: str, reps: int, seed: int, least: int = 10) -> DataFrame:
    """Skill of each candidate's ledger against the best skill of circularly shifted predictions over all candidates.

    ledger: family, candidate, i and n (numbered within the candidate), actual, baseline and
    predicted. Every replicate shifts each candidate's predictions by its own draw, a tenth
    of the rows at least; candidates under `least` rows stay out of the null.
    """
    keys = [*family, candidate]
    skill = F.avg(F.abs(F.col(actual) - F.col(baseline)) - F.abs(F.col(actual) - F.col(predicted)))
    real = ledger.groupBy(*keys).agg(F.count("*").alias("n"), skill.alias("skill"))
    drawn = shifts(real.filter(F.col("n") >= least).select(*keys, "n"), keys, reps, F.greatest(F.lit(2), F.floor(F.col("n") / 10)), seed)
    rows = ledger.select(*keys, "i", actual, baseline).join(drawn, keys).withColumn("__j", F.pmod(F.col("i") - F.col("shift"), F.col("n")))
    moved = rows.join(ledger.select(*keys, F.col("i").alias("__j"), predicted), [*keys, "__j"])
    null = moved.groupBy(*keys, "rep").agg(skill.alias("skill"))
    return against_largest(real, null, family, "skill").withColumn("deflated", F.col("skill") - F.col("null_95"))


def rule_shift_null(rows: DataFrame, family: Sequence[str], ret: str, rules: Sequence[str], effective: DataFrame, reps: int, seed: int, margin: int = 70) -> DataFrame:
    """Standardised edge of each rule, mean signed return * sqrt(n_effective) / sd, against the largest under joint circular shifts.

    rows: family, i, n, ret and one column of signs for each rule (0: no call); effective:
    family, candidate and n_effective. A replicate moves the signs of all rules of a family by
    one shift. The null's sd is that of the returns it calls; rules with under 5 calls or
    under 3 effective rows have no statistic.
    """
    keys = list(family)
    stack = f"stack({len(rules)}, {', '.join(f'{x!r}, {x}' for x in rules)}) as (candidate, __s)"
    signs = rows.selectExpr(*keys, "i", "n", stack).filter("__s != 0")
    told = rows.select(*keys, F.col("i").alias("__j"), F.col(ret).alias("__y")).filter("__y IS NOT NULL")
    spread = rows.groupBy(*keys).agg(F.stddev_samp(ret).alias("__sd"))
    real = signs.join(told.withColumnRenamed("__j", "i"), [*keys, "i"]).groupBy(*keys, "candidate").agg(F.count("*").alias("called"), F.avg(F.col("__s") * F.col("__y")).alias("mean"))
    real = real.join(spread, keys).join(effective, [*keys, "candidate"])
    edge = lambda sd: F.when(F.col("n_effective") >= 3, F.col("mean") * F.sqrt("n_effective") / F.nullif(F.col(sd), F.lit(0.0)))
    real = real.withColumn("edge", edge("__sd")).drop("__sd")
    low = F.least(F.lit(margin), F.greatest(F.lit(10), F.floor(F.col("n") / 5)))
    drawn = shifts(rows.groupBy(*keys).agg(F.max("n").alias("n")), keys, reps, low, seed)
    moved = signs.join(drawn.drop("n"), keys).withColumn("__j", F.pmod(F.col("i") + F.col("shift"), F.col("n"))).join(told, [*keys, "__j"])
    null = moved.groupBy(*keys, "rep", "candidate").agg(F.count("*").alias("__k"), F.avg(F.col("__s") * F.col("__y")).alias("mean"), F.stddev_samp("__y").alias("__sd")).filter("__k >= 5")
    null = null.join(effective, [*keys, "candidate"]).withColumn("edge", edge("__sd"))
    return against_largest(real, null.filter("edge IS NOT NULL"), family, "edge")


def greedy_shift_null(rows: DataFrame, family: Sequence[str], start: str, end: str, ret: str, signals: Sequence[str], reps: int, seed: int, margin: int = 91) -> DataFrame:
    """t of the greedily chosen returns of each signal, against the largest t of signals moved round, chosen anew in every replicate.

    rows: family, i, n, start, end, ret and a boolean column for each signal. Greedy
    selections run side by side, one a family, replicate and signal; t wants 5 rows.
    """
    keys = list(family)
    stack = f"stack({len(signals)}, {', '.join(f'{x!r}, {x}' for x in signals)}) as (candidate, __on)"
    on = rows.selectExpr(*keys, "i", "n", stack).filter("__on")
    drawn = shifts(rows.groupBy(*keys).agg(F.max("n").alias("n")), keys, reps, margin, seed).drop("n")
    still = rows.select(*keys).distinct().select(*keys, F.lit(-1).alias("rep"), F.lit(0).cast("long").alias("shift"))
    moved = on.join(drawn.unionByName(still), keys).withColumn("i", F.pmod(F.col("i") + F.col("shift"), F.col("n"))).drop("n")
    called = moved.join(rows.select(*keys, "i", start, end, ret).filter(F.col(ret).isNotNull()), [*keys, "i"])
    chosen = greedy(called, [*keys, "rep", "candidate"], start, end, [ret])
    sd = F.stddev_samp(ret)
    t = F.when((F.count(ret) >= 5) & (sd > 0), F.avg(ret) / (sd / F.sqrt(F.count(ret))))
    found = chosen.groupBy(*keys, "rep", "candidate").agg(F.count(ret).alias("n_greedy"), F.avg(ret).alias("mean"), t.alias("t"))
    return against_largest(found.filter("rep = -1").drop("rep"), found.filter("rep >= 0 AND t IS NOT NULL").select(*keys, "rep", "t"), family, "t")


def holm(df: DataFrame, by: Sequence[str], p: str, name: str = "holm_p") -> DataFrame:
    """Holm's step-down: running largest of (m - rank + 1) p, 1 at most; missing p stay missing and do not count."""
    w = Window.partitionBy(*by, F.col(p).isNull()).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*by, F.col(p).isNull()))
    scaled = df.withColumn("__h", (m - F.row_number().over(w) + 1) * F.col(p))
    highest = F.max("__h").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), highest))).drop("__h")


def binomial_tail(n: Column, hits: Column) -> Column:
    """Chance of so many heads at least in n fair throws.

    Terms follow from each other, C(n, k) = C(n, k - 1) (n - k + 1) / k, so no factorial is formed.
    """
    first = F.struct((F.lit(0.5) ** n).alias("term"), F.when(hits <= 0, F.lit(0.5) ** n).otherwise(F.lit(0.0)).alias("sum"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * (n - k + 1) / k
        return F.struct(term.alias("term"), (a["sum"] + F.when(k >= hits, term).otherwise(F.lit(0.0))).alias("sum"))

    steps = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.aggregate(steps, first, step, lambda a: a["sum"]))
