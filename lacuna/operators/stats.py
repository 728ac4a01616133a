"""Grouped statistics, scorecards and stability checks. All are distributive sums where they can be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.functions.labels import holds

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def bundle(x: str, quantiles: Sequence[float] = QUANTILES) -> list[Column]:
    """n, mean, sd, least, quantiles (exact, linear) and largest of x."""
    names = [f"p{round(q * 100):02d}" for q in quantiles]
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"),
        *[F.percentile(x, list(quantiles))[i].alias(n) for i, n in enumerate(names)], F.max(x).alias("max"),  # one aggregate, made once
    ]


def shape(x: str) -> list[Column]:
    """Population skewness and excess kurtosis."""
    return [F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess_kurtosis")]


def rate(test: Column) -> Column:
    """Share of rows where a test holds; missing counts as not."""
    return F.avg(holds(test).cast("double"))


def correlation(x: str, y: str, least: int = 3) -> Column:
    """Pearson's r; null under `least` pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when((F.count(a) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))


def ranked(df: DataFrame, by: Sequence[str], x: str, name: str) -> DataFrame:
    """Average rank of x in its group; equal values share it."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(x))
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return df.withColumn(name, rank + (ties - 1) / 2)


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Correlation of average ranks over the rows that have both values."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ranked(ranked(both, by, x, "__rx"), by, y, "__ry").groupBy(*by).agg(correlation("__rx", "__ry").alias(name), F.count("*").alias("n"))


def leave_one_out(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """n, r and the least, median and largest r without one row, from moments."""
    pair = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")})
    centred = pair.join(pair.groupBy(*by).agg(F.avg("__x").alias("__mx"), F.avg("__y").alias("__my")), list(by))
    centred = centred.withColumns({"__x": F.col("__x") - F.col("__mx"), "__y": F.col("__y") - F.col("__my")})
    parts = {"n": F.lit(1.0), "sx": F.col("__x"), "sy": F.col("__y"), "sxy": F.col("__x") * F.col("__y"), "sxx": F.col("__x") ** 2, "syy": F.col("__y") ** 2}
    sums = centred.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    out = centred.join(sums, list(by))
    less = {k: F.col(k) - v for k, v in parts.items()}
    r = (less["n"] * less["sxy"] - less["sx"] * less["sy"]) / F.sqrt((less["n"] * less["sxx"] - less["sx"] ** 2) * (less["n"] * less["syy"] - less["sy"] ** 2))
    full = F.corr("__x", "__y")
    return out.withColumn("__r", r).groupBy(*by).agg(F.count("*").alias("n"), full.alias("r"), F.min("__r").alias("loo_min"), F.percentile("__r", 0.5).alias("loo_median"), F.max("__r").alias("loo_max"))


def top_share(df: DataFrame, by: Sequence[str], x: str, ks: Sequence[int]) -> DataFrame:
    """Share of the total of x that its k largest rows have. The k largest come from a limited rank, not a full sort."""
    best = df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(x), *by))).filter(F.col("__k") <= max(ks))
    tops = best.groupBy(*by).agg(*[F.sum(F.when(F.col("__k") <= k, F.col(x))).alias(f"__top{k}") for k in ks])
    totals = df.groupBy(*by).agg(F.sum(x).alias("__all"))
    return tops.join(totals, list(by)).select(*by, *[(F.col(f"__top{k}") / F.nullif(F.col("__all"), F.lit(0.0))).alias(f"top{k}_share") for k in ks])


def t_statistic(x: str, least: int = 5) -> Column:
    """Mean over its standard error; minus infinity under `least` values or without spread."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= least) & (sd > 0), F.avg(x) / (sd / F.sqrt(F.count(x)))).otherwise(F.lit(float("-inf")))


def confusion(actual: str, predicted: str, classes: Sequence[int] = (-1, 0, 1)) -> list[Column]:
    """Counts of all pairs of classes, as aggregates named c_actual_predicted (m for minus)."""
    name = lambda k: f"m{-k}" if k < 0 else str(k)
    return [F.sum(holds((F.col(actual) == a) & (F.col(predicted) == p)).cast("long")).alias(f"c_{name(a)}_{name(p)}") for a in classes for p in classes]


def confusion_scores(df: DataFrame, classes: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """accuracy, balanced accuracy, macro F1 and Matthews correlation from confusion counts; classes without rows are left out of means."""
    name = lambda k: f"m{-k}" if k < 0 else str(k)
    c = {(a, p): F.col(f"c_{name(a)}_{name(p)}") for a in classes for p in classes}
    add = lambda xs: sum(xs[1:], xs[0])
    row, col = {k: add([c[k, p] for p in classes]) for k in classes}, {k: add([c[a, k] for a in classes]) for k in classes}
    n, hit = add(list(row.values())), add([c[k, k] for k in classes])
    recall = {k: F.try_divide(c[k, k], row[k]) for k in classes}
    precision = {k: F.try_divide(c[k, k], col[k]) for k in classes}
    f1 = [F.when(row[k] + col[k] > 0, 2 * c[k, k] / (row[k] + col[k])) for k in classes]
    mean = lambda xs: F.try_divide(add([F.coalesce(x, F.lit(0.0)) for x in xs]), add([x.isNotNull().cast("int") for x in xs]))
    cross = add([row[k] * col[k] for k in classes])
    spread = (n * n - add([row[k] * row[k] for k in classes])) * (n * n - add([col[k] * col[k] for k in classes]))
    return df.withColumns(
        {
            "n": n,
            "accuracy": F.try_divide(hit, n),
            "balanced_accuracy": mean(list(recall.values())),
            "macro_f1": mean(f1),
            "mcc": F.when(spread > 0, (n * hit - cross) / F.sqrt(spread.cast("double"))),
            **{f"recall_{name(k)}": recall[k] for k in classes},
            **{f"precision_{name(k)}": precision[k] for k in classes},
        }
    )


def forecast_scores(actual: str, predicted: str, baseline: str) -> list[Column]:
    """n, errors against a baseline and zero, skill, RMSE, out-of-sample R^2 and direction hits."""
    a, p, b = F.col(actual), F.col(predicted), F.col(baseline)
    miss, base = F.abs(a - p), F.abs(a - b)
    return [
        F.count("*").alias("n"), F.avg(miss).alias("mae"), F.avg(base).alias("baseline_mae"), F.avg(F.abs(a)).alias("zero_mae"), F.avg(base - miss).alias("skill"),
        F.sqrt(F.avg((a - p) ** 2)).alias("rmse"), (1 - F.sum((a - p) ** 2) / F.nullif(F.sum((a - b) ** 2), F.lit(0.0))).alias("oos_r2"), rate(F.signum(a) == F.signum(p)).alias("direction_hit"),
    ]


def rule_scores(call: str) -> list[Column]:
    """Scorecard of a rule from outcome columns: rows, calls, coverage, hits, signed returns and changes, economic hits."""
    on = F.col(call) != 0
    called = lambda x: F.when(on, F.col(x))
    return [
        F.count("*").alias("eligible_n"), F.sum(on.cast("long")).alias("called_n"), F.avg(on.cast("double")).alias("coverage"), F.sum((F.col(call) > 0).cast("long")).alias("up_calls"), F.sum((F.col(call) < 0).cast("long")).alias("down_calls"),
        F.avg(called("hit")).alias("hit_rate"), F.avg(called("signed_ret")).alias("mean_signed_ret"), F.percentile(called("signed_change"), 0.5).alias("median_signed_change"), F.avg(called("economic_hit")).alias("economic_hit_rate"), F.avg(called("signed_net_value")).alias("mean_net_value"),
    ]


def thirds(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str) -> DataFrame:
    """Mean of x in the first, middle and last third of the rows, in order; earlier thirds are larger."""
    cut = df.withColumn("third", F.ntile(3).over(Window.partitionBy(*by).orderBy(*order)))
    return cut.groupBy(*by, "third").agg(F.count("*").alias("n"), F.avg(x).alias("mean"))


def half_signs(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, y: str, least: int = 4) -> DataFrame:
    """Rank correlation in the first and second half of the rows, and whether their signs agree."""
    w = Window.partitionBy(*by)
    cut = df.withColumn("__half", F.when(F.row_number().over(w.orderBy(*order)) <= F.floor(F.count("*").over(w) / 2), 1).otherwise(2))
    each = spearman(cut, [*by, "__half"], x, y)
    side = lambda h: F.max(F.when((F.col("__half") == h) & (F.col("n") >= least), F.col("rho")))
    return each.groupBy(*by).agg(side(1).alias("first_half"), side(2).alias("second_half")).withColumn("stable", holds(F.col("first_half") * F.col("second_half") > 0))


def periods(df: DataFrame, by: Sequence[str], at: str, parts: int) -> DataFrame:
    """Numbers rows by which of so many equally long spans of the group's dates they are in."""
    lo, hi = F.min(at).over(Window.partitionBy(*by)), F.max(at).over(Window.partitionBy(*by))
    share = F.datediff(F.col(at), lo) * parts / F.greatest(F.datediff(hi, lo), F.lit(1))
    return df.withColumn("period", F.least(F.floor(share), F.lit(parts - 1)) + 1)


def threshold_calls(df: DataFrame, by: Sequence[str], actual: str, predicted: str, quantiles: Sequence[float] = (0.5, 0.67, 0.75)) -> DataFrame:
    """Hits among the predictions whose size is above a quantile of all sizes. The quantile sees all rows: descriptive only."""
    size = df.withColumn("__s", F.abs(F.col(predicted)))
    cuts = size.groupBy(*by).agg(*[F.percentile("__s", q).alias(f"__q{i}") for i, q in enumerate(quantiles)])
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"__q{i}").alias("cut")) for i, q in enumerate(quantiles)]))
    long = cuts.select(*by, each.alias("c")).select(*by, "c.*")
    on = size.join(long, list(by)).filter(F.col("__s") >= F.col("cut"))
    return on.groupBy(*by, "quantile").agg(F.first("cut").alias("cut"), F.count("*").alias("n"), rate(F.signum(actual) == F.signum(predicted)).alias("hit_rate"))


def expanding_majority(df: DataFrame, by: Sequence[str], at: str, sign: str) -> DataFrame:
    """majority: the commoner sign of all earlier rows (1 where they tie), and n_before of them."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    up = F.avg((F.col(sign) > 0).cast("double")).over(w)
    return df.withColumn("n_before", F.count("*").over(w)).withColumn("majority", F.when(up >= 0.5, 1).when(up < 0.5, -1))
