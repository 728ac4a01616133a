"""Statistics, scorecards and resampling inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions.labels import brier, gamma3_cdf, log_loss, on_simplex, outcome, vessel
from lacuna.operators import resample, stats
from lacuna.plans.base import DAILY, TARGETS, S, Plan, big, daily, r6, targets
from lacuna.session import table


def stats_bundle(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = lines.groupBy("l_returnflag").agg(*stats.bundle("l_extendedprice", (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)))
    return out.select("l_returnflag", "n", *[r6(c).alias(c) for c in out.columns if c not in ("l_returnflag", "n")])


def shape_stats(spark, sf_dir):
    r = daily(spark, sf_dir).withColumn("r", S.log_change("price")).groupBy("series").agg(*stats.shape("r"), F.stddev_pop("r").alias("sd_pop"), F.stddev_samp("r").alias("sd"))
    return r.select("series", *[r6(c).alias(c) for c in ("skew", "excess_kurtosis", "sd_pop", "sd")])


def autocorrelation(spark, sf_dir):
    r = daily(spark, sf_dir).withColumn("r", S.log_change("price"))
    lagged = r.withColumns({f"l{k}": S.lag("r", k) for k in (1, 5, 10)})
    return lagged.groupBy("series").agg(*[r6(stats.correlation("r", f"l{k}")).alias(f"ac{k}") for k in (1, 5, 10)])


def rank_correlation(spark, sf_dir):
    out = stats.spearman(daily(spark, sf_dir), ["series"], "price", "n")
    pearson = daily(spark, sf_dir).groupBy("series").agg(stats.correlation("price", "n").alias("pearson"))
    return out.join(pearson, "series").select("series", "n", r6("rho").alias("rho"), r6("pearson").alias("pearson"))


def leave_one_out(spark, sf_dir):
    m = daily(spark, sf_dir).groupBy("series", F.trunc("d", "MM").alias("m")).agg(F.avg("price").alias("p"), F.sum("n").alias("q"))
    out = stats.leave_one_out(m, ["series"], "p", "q")
    return out.select("series", "n", *[r6(c).alias(c) for c in ("r", "loo_min", "loo_median", "loo_max")])


def top_share(spark, sf_dir):
    out = stats.top_share(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", [1, 5, 10])
    return out.select("o_orderstatus", *[r6(c).alias(c) for c in ("top1_share", "top5_share", "top10_share")])


def extremes(spark, sf_dir):
    d = daily(spark, sf_dir)
    return d.groupBy("series").agg(F.min_by("d", F.struct("close", "d")).alias("lowest"), F.max_by("d", F.struct("close", "d")).alias("highest"), F.min(F.when(F.col("n") >= 3, F.col("d"))).alias("first_busy"), r6(stats.rate(F.col("n") > 1)).alias("busy_share"), F.countDistinct("n").alias("sizes"))


def month_end(spark, sf_dir):
    """Last quote of each month, as weekly and monthly grains of one source."""
    d = daily(spark, sf_dir)
    return d.groupBy("series", F.last_day("d").alias("month_end")).agg(r6(F.max_by("price", "d")).alias("last"), F.avg("n").alias("mean_orders"), F.count("*").alias("rows"))


def bucketed(spark, sf_dir):
    """Rows by regime of the day's orders."""
    n = F.col("n")
    regime = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").otherwise("6+")
    return daily(spark, sf_dir).groupBy("series", regime.alias("regime")).agg(F.count("*").alias("rows"), r6(F.avg("price")).alias("mean"))


def confusion_metrics(spark, sf_dir):
    """The reversal of the week before against the next month's direction."""
    t = targets(spark, sf_dir).filter("f IS NOT NULL").withColumn("p", F.when(F.col("f") > 0.2, -1).when(F.col("f") < -0.2, 1).otherwise(0))
    out = stats.confusion_scores(t.groupBy("series").agg(*stats.confusion("direction", "p")))
    return out.select("series", "n", "c_1_1", "c_m1_m1", "c_m1_1", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "mcc", "recall_1", "precision_m1")])


def forecast_scorecard(spark, sf_dir):
    t = targets(spark, sf_dir).filter("f IS NOT NULL").withColumn("p", F.col("f") * -0.5).withColumn("b", F.lit(0.01))
    out = t.groupBy("series").agg(*stats.forecast_scores("ret", "p", "b"))
    return out.select("series", "n", *[r6(c).alias(c) for c in out.columns if c not in ("series", "n")])


def thirds_stability(spark, sf_dir):
    out = stats.thirds(targets(spark, sf_dir), ["series"], ["d"], "ret")
    return out.select("series", big("third").alias("third"), "n", r6("mean").alias("mean"))


def half_stability(spark, sf_dir):
    out = stats.half_signs(targets(spark, sf_dir), ["series"], ["d"], "f", "ret")
    return out.select("series", r6("first_half").alias("first_half"), r6("second_half").alias("second_half"), "stable")


def period_means(spark, sf_dir):
    out = stats.periods(targets(spark, sf_dir), ["series"], "d", 3).groupBy("series", "period").agg(F.count("*").alias("n"), r6(F.avg("ret")).alias("mean"), r6(stats.t_statistic("ret")).alias("t"))
    return out.withColumn("period", big("period"))


def threshold_calls(spark, sf_dir):
    t = targets(spark, sf_dir).filter("f IS NOT NULL").withColumn("p", -F.col("f"))
    out = stats.threshold_calls(t, ["series"], "ret", "p")
    return out.select("series", "quantile", r6("cut").alias("cut"), "n", r6("hit_rate").alias("hit_rate"))


def sign_majority(spark, sf_dir):
    """The sign of the week before against the commoner sign so far."""
    t = targets(spark, sf_dir).filter("f IS NOT NULL").withColumn("sign", F.when(F.col("ret") >= 0, 1).otherwise(-1))
    e = stats.expanding_majority(t, ["series"], "d", "sign").filter("n_before >= 12")
    return e.groupBy("series").agg(F.count("*").alias("n"), r6(stats.rate(F.signum("f") == F.col("sign"))).alias("rule"), r6(stats.rate(F.col("majority") == F.col("sign"))).alias("majority"))


def outcomes(spark, sf_dir):
    t = targets(spark, sf_dir).withColumn("call", F.when(F.col("f") > 0, 1).otherwise(-1)).withColumn("horizon", F.lit(30))
    return t.withColumns(outcome(F.col("call"), F.col("ret"), F.col("change"), F.col("horizon"))).select("series", "d", r6("signed_change").alias("signed_change"), r6("net_hold_change").alias("net_hold_change"), big("economic_target").alias("economic_target"), big("economic_hit").alias("economic_hit"), r6("signed_net_value").alias("signed_net_value"))


def scenario_kernel(spark, sf_dir):
    """Parts as vessels: what a gamma kernel releases over the next days, by kernel and window."""
    kind, share = vessel(F.col("p_type"))
    p = table(spark, sf_dir, "part").select(((F.col("p_partkey") * 7) % 400).alias("age"), (F.col("p_retailprice") * share).alias("t"), kind.alias("kind"))
    p = p.filter(F.col("age").between(0, 365))
    grid = F.explode(F.array(*[F.struct(F.lit(float(th)).alias("theta"), F.lit(h).cast("long").alias("window")) for th in (30, 45) for h in (30, 45, 60, 90)]))
    x = p.withColumn("g", grid).withColumn("freed", F.col("t") * (gamma3_cdf(F.col("age") + F.col("g.window"), F.col("g.theta")) - gamma3_cdf(F.col("age"), F.col("g.theta"))))
    return x.groupBy(F.col("g.theta").alias("theta"), F.col("g.window").alias("window")).agg(F.count("*").alias("vessels"), F.round(F.sum("freed"), 4).alias("release"))


def recent_totals(spark, sf_dir):
    """Parts as vessels: how many came in the last 30 to 365 days, and what they weigh and yield."""
    _, share = vessel(F.col("p_type"))
    p = table(spark, sf_dir, "part").select(((F.col("p_partkey") * 7) % 400).alias("age"), F.col("p_retailprice").alias("ldt"), (F.col("p_retailprice") * share).alias("t"))
    each = F.explode(F.filter(F.array(*[F.lit(x).cast("long") for x in (30, 60, 90, 120, 180, 365)]), lambda x: F.col("age").between(0, x)))
    return p.withColumn("lookback", each).groupBy("lookback").agg(F.count("*").alias("vessels"), F.round(F.sum("ldt"), 4).alias("ldt"), F.round(F.sum("t"), 4).alias("plate"))


def class_losses(spark, sf_dir):
    t = targets(spark, sf_dir).filter("f IS NOT NULL")
    hot = [(F.col("direction") == k).cast("double") for k in (-1, 0, 1)]
    p = on_simplex([F.col("f"), F.lit(0.1), -F.col("f")], [F.lit(0.4), F.lit(0.1), F.lit(0.5)])
    mine = sum((h * q for h, q in zip(hot[1:], p[1:], strict=True)), hot[0] * p[0])
    return t.groupBy("series").agg(r6(F.avg(brier(hot, p))).alias("brier"), r6(F.avg(log_loss(mine))).alias("log_loss"))


def block_bootstrap(spark, sf_dir):
    rows = resample.numbered(targets(spark, sf_dir), ["series"], ["d"])
    out = resample.block_interval(rows, ["series"], "ret", 200, 21, 20260812)
    return out.select("series", "n", *[r6(c).alias(c) for c in ("mean", "ci_low", "ci_high", "se", "p_one_sided")])


def block_correlation(spark, sf_dir):
    rows = resample.numbered(targets(spark, sf_dir).filter("f IS NOT NULL"), ["series"], ["d"])
    out = resample.block_correlation(rows, ["series"], "f", "ret", 200, 21, 11)
    return out.select("series", "n", *[r6(c).alias(c) for c in ("r", "ci_low", "ci_high")])


def circular_shift(spark, sf_dir):
    rows = resample.numbered(targets(spark, sf_dir).filter("f IS NOT NULL"), ["series"], ["d"])
    out = resample.shift_p(rows, ["series"], "f", "ret", list(range(10, 410, 10)))
    return out.select("series", r6("r").alias("r"), r6("p").alias("p"))


def circular_shift_all(spark, sf_dir):
    """Every shift from 1 to n - 1."""
    rows = resample.numbered(targets(spark, sf_dir).filter("f IS NOT NULL"), ["series"], ["d"])
    return resample.shift_p(rows, ["series"], "f", "ret").select("series", r6("r").alias("r"), r6("p").alias("p"))


def max_null(spark, sf_dir):
    t = targets(spark, sf_dir).filter("f IS NOT NULL")
    t = t.withColumns({"a": F.abs("ret") - F.abs(F.col("ret") - 0.01), "b": F.abs("ret") - F.abs(F.col("ret") + F.col("f") * 0.1), "c": -F.col("f") * F.col("ret")})
    out = resample.max_null(resample.numbered(t, ["series"], ["d"]), ["series"], ["a", "b", "c"], 200, 21, 7)
    return out.select("series", "candidate", *[r6(c).alias(c) for c in ("mean", "se", "t", "raw_p", "adjusted_p", "null_95")])


def holm(spark, sf_dir):
    """Step-down over p values made from parts: 1 - share of the price in its brand's largest."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.avg("p_size") / 400 - 0.05).alias("p0"), F.count("*").alias("k"))
    p = p.withColumn("p", F.when(F.col("k") % 5 != 0, F.abs("p0"))).withColumn("family", F.substring("p_brand", 7, 1))
    return resample.holm(p, ["family"], "p").select("p_brand", "family", r6("p").alias("p"), r6("holm_p").alias("holm_p"))


def binomial_tail(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10).cast("long").alias("n"), ((F.col("n_nationkey") * 7) % 20).cast("long").alias("hits"))
    return n.select("n", "hits", F.round(resample.binomial_tail(F.col("n"), F.col("hits")), 9).alias("tail"))


W = "PARTITION BY series ORDER BY d"
POP = "WITH {d}, r AS (SELECT series, d, ln(price / lag(price) OVER (" + W + ")) AS r FROM daily)"
BOOT = """n AS (SELECT series, count(*) AS n FROM {t} GROUP BY series), i AS (SELECT *, row_number() OVER ({w}) - 1 AS i FROM {t}),
s AS (SELECT series, n, rep, k, (('0x' || substr(md5('{seed}:' || rep || ':' || k), 1, 8))::BIGINT) % n AS start FROM n, (SELECT unnest(range(0, {reps})) AS rep) a, LATERAL (SELECT unnest(range(0, ceil(n / {b}.0)::BIGINT)) AS k) b),
e AS (SELECT s.series, rep, (start + j) % n AS i FROM s, (SELECT unnest(range(0, {b})) AS j) c WHERE k * {b} + j < n),
m AS (SELECT e.series, rep, {avgs} FROM e JOIN i ON e.series = i.series AND e.i = i.i GROUP BY ALL)"""
Q = ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS p{round(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
RANKED = "(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"
PLANS: dict[str, Plan] = {
    "stats_bundle": (stats_bundle, f"SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd, min(l_extendedprice) AS min, {Q}, max(l_extendedprice) AS max FROM lineitem GROUP BY 1"),
    "shape_stats": (shape_stats, POP.format(d=DAILY) + """, c AS (SELECT series, r - avg(r) OVER (PARTITION BY series) AS x, r FROM r WHERE r IS NOT NULL)
SELECT series, round(avg(x ** 3) / avg(x ** 2) ** 1.5, 6) AS skew, round(avg(x ** 4) / avg(x ** 2) ** 2 - 3, 6) AS excess_kurtosis, round(stddev_pop(r), 6) AS sd_pop, round(stddev_samp(r), 6) AS sd FROM c GROUP BY series"""),
    "autocorrelation": (autocorrelation, POP.format(d=DAILY) + f""", l AS (SELECT series, r, lag(r, 1) OVER ({W}) AS a, lag(r, 5) OVER ({W}) AS b, lag(r, 10) OVER ({W}) AS c FROM r)
SELECT series, round(corr(r, a), 6) + 0.0 AS ac1, round(corr(r, b), 6) + 0.0 AS ac5, round(corr(r, c), 6) + 0.0 AS ac10 FROM l GROUP BY series"""),
    "rank_correlation": (rank_correlation, f"""WITH {DAILY}, k AS (SELECT *, {RANKED.format(by="series", x="price")} AS a, {RANKED.format(by="series", x="n")} AS b FROM daily)
SELECT series, count(*) AS n, round(corr(a, b), 6) + 0.0 AS rho, round(corr(price, n), 6) + 0.0 AS pearson FROM k GROUP BY series"""),
    "leave_one_out": (leave_one_out, f"""WITH {DAILY}, m AS (SELECT series, date_trunc('month', d) AS m, avg(price) AS x, sum(n)::DOUBLE AS y FROM daily GROUP BY ALL),
l AS (SELECT a.series, a.m, corr(b.x, b.y) AS r FROM m a JOIN m b ON a.series = b.series AND a.m <> b.m GROUP BY ALL), f AS (SELECT series, count(*) AS n, corr(x, y) AS r FROM m GROUP BY series)
SELECT f.series, any_value(f.n) AS n, round(any_value(f.r), 6) + 0.0 AS r, round(min(l.r), 6) + 0.0 AS loo_min, round(median(l.r), 6) + 0.0 AS loo_median, round(max(l.r), 6) + 0.0 AS loo_max FROM l JOIN f ON l.series = f.series GROUP BY f.series"""),
    "top_share": (top_share, """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS k FROM orders)
SELECT o_orderstatus, round(sum(CASE WHEN k <= 1 THEN o_totalprice END) / sum(o_totalprice), 6) AS top1_share, round(sum(CASE WHEN k <= 5 THEN o_totalprice END) / sum(o_totalprice), 6) AS top5_share, round(sum(CASE WHEN k <= 10 THEN o_totalprice END) / sum(o_totalprice), 6) AS top10_share FROM k GROUP BY 1"""),
    "extremes": (extremes, f"""WITH {DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY close, d) AS a, row_number() OVER (PARTITION BY series ORDER BY close DESC, d DESC) AS b FROM daily)
SELECT series, min(CASE WHEN a = 1 THEN d END) AS lowest, min(CASE WHEN b = 1 THEN d END) AS highest, min(CASE WHEN n >= 3 THEN d END) AS first_busy, round(avg((n > 1)::INT), 6) AS busy_share, count(DISTINCT n) AS sizes FROM k GROUP BY series"""),
    "month_end": (month_end, f"WITH {DAILY} SELECT series, last_day(d) AS month_end, round(arg_max(price, d), 6) AS last, avg(n) AS mean_orders, count(*) AS rows FROM daily GROUP BY ALL"),
    "bucketed": (bucketed, f"WITH {DAILY}, b AS (SELECT *, CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 5 THEN '4-5' ELSE '6+' END AS regime FROM daily) SELECT series, regime, count(*) AS rows, round(avg(price), 6) AS mean FROM b GROUP BY ALL"),
    "confusion_metrics": (confusion_metrics, f"""WITH {TARGETS}, t AS (SELECT series, direction AS a, CASE WHEN f > 0.2 THEN -1 WHEN f < -0.2 THEN 1 ELSE 0 END AS p FROM targets WHERE f IS NOT NULL),
c AS (SELECT series, count(*) AS n, sum((a = p)::INT) AS hit, sum((a = -1 AND p = -1)::INT) AS mm, sum((a = 0 AND p = 0)::INT) AS zz, sum((a = 1 AND p = 1)::INT) AS pp, sum((a = -1 AND p = 1)::INT) AS mp,
 sum((a = -1)::INT) AS am, sum((a = 0)::INT) AS az, sum((a = 1)::INT) AS ap, sum((p = -1)::INT) AS qm, sum((p = 0)::INT) AS qz, sum((p = 1)::INT) AS qp FROM t GROUP BY series)
SELECT series, n, pp::BIGINT AS c_1_1, mm::BIGINT AS c_m1_m1, mp::BIGINT AS c_m1_1, round(hit / n, 6) AS accuracy, round(list_avg([mm / nullif(am, 0), zz / nullif(az, 0), pp / nullif(ap, 0)]), 6) AS balanced_accuracy,
 round(list_avg([2 * mm / nullif(am + qm, 0), 2 * zz / nullif(az + qz, 0), 2 * pp / nullif(ap + qp, 0)]), 6) AS macro_f1,
 round((n * hit - am * qm - az * qz - ap * qp)::DOUBLE / sqrt(((n * n - am * am - az * az - ap * ap) * (n * n - qm * qm - qz * qz - qp * qp))::DOUBLE), 6) + 0.0 AS mcc, round(pp / nullif(ap, 0), 6) AS recall_1, round(mm / nullif(qm, 0), 6) AS precision_m1 FROM c"""),
    "forecast_scorecard": (forecast_scorecard, f"""WITH {TARGETS}, t AS (SELECT series, ret AS a, f * -0.5 AS p, 0.01 AS b FROM targets WHERE f IS NOT NULL)
SELECT series, count(*) AS n, round(avg(abs(a - p)), 6) AS mae, round(avg(abs(a - b)), 6) AS baseline_mae, round(avg(abs(a)), 6) AS zero_mae, round(avg(abs(a - b) - abs(a - p)), 6) + 0.0 AS skill, round(sqrt(avg((a - p) ** 2)), 6) AS rmse,
 round(1 - sum((a - p) ** 2) / sum((a - b) ** 2), 6) + 0.0 AS oos_r2, round(avg((sign(a) = sign(p))::INT), 6) AS direction_hit FROM t GROUP BY series"""),
    "thirds_stability": (thirds_stability, f"WITH {TARGETS}, t AS (SELECT series, ret, ntile(3) OVER ({W}) AS third FROM targets) SELECT series, third, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean FROM t GROUP BY ALL"),
    "half_stability": (half_stability, f"""WITH {TARGETS}, h AS (SELECT *, CASE WHEN row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY series) / 2.0) THEN 1 ELSE 2 END AS half FROM targets), p AS (SELECT * FROM h WHERE f IS NOT NULL),
k AS (SELECT series, half, {RANKED.format(by="series, half", x="f")} AS a, {RANKED.format(by="series, half", x="ret")} AS b FROM p), c AS (SELECT series, half, corr(a, b) AS rho FROM k GROUP BY ALL),
o AS (SELECT series, max(CASE WHEN half = 1 THEN rho END) AS x, max(CASE WHEN half = 2 THEN rho END) AS y FROM c GROUP BY series) SELECT series, round(x, 6) + 0.0 AS first_half, round(y, 6) + 0.0 AS second_half, coalesce(x * y > 0, false) AS stable FROM o"""),
    "period_means": (period_means, f"""WITH {TARGETS}, s AS (SELECT *, min(d) OVER (PARTITION BY series) AS lo, max(d) OVER (PARTITION BY series) AS hi FROM targets),
t AS (SELECT series, ret, least(floor((d - lo) * 3 / (hi - lo)::DOUBLE), 2)::BIGINT + 1 AS period FROM s) SELECT series, period, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 6) + 0.0 AS t FROM t GROUP BY ALL"""),
    "threshold_calls": (threshold_calls, f"""WITH {TARGETS}, t AS (SELECT series, ret, -f AS p FROM targets WHERE f IS NOT NULL), q AS (SELECT unnest([0.5, 0.67, 0.75])::DOUBLE AS quantile),
c AS (SELECT series, 0.5::DOUBLE AS quantile, quantile_cont(abs(p), 0.5) AS cut FROM t GROUP BY series UNION ALL SELECT series, 0.67, quantile_cont(abs(p), 0.67) FROM t GROUP BY series UNION ALL SELECT series, 0.75, quantile_cont(abs(p), 0.75) FROM t GROUP BY series)
SELECT t.series, quantile, round(any_value(cut), 6) AS cut, count(*) AS n, round(avg((sign(ret) = sign(p))::INT), 6) AS hit_rate FROM t JOIN c ON t.series = c.series AND abs(p) >= cut GROUP BY t.series, quantile"""),
    "sign_majority": (sign_majority, f"""WITH {TARGETS}, t AS (SELECT series, d, f, CASE WHEN ret >= 0 THEN 1 ELSE -1 END AS sign FROM targets WHERE f IS NOT NULL),
e AS (SELECT *, count(*) OVER w AS k, CASE WHEN avg((sign > 0)::INT) OVER w >= 0.5 THEN 1 ELSE -1 END AS majority FROM t WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series, count(*) AS n, round(avg((sign(f) = sign)::INT), 6) AS rule, round(avg((majority = sign)::INT), 6) AS majority FROM e WHERE k >= 12 GROUP BY series"""),
    "outcomes": (outcomes, f"""WITH {TARGETS}, t AS (SELECT *, CASE WHEN f > 0 THEN 1 ELSE -1 END AS call FROM targets) SELECT series, d, round(call * change, 6) + 0.0 AS signed_change, round(change - 900, 6) + 0.0 AS net_hold_change,
 sign(change - 900)::BIGINT AS economic_target, (sign(change - 900) = call)::BIGINT AS economic_hit, round(call * (change - 900), 6) + 0.0 AS signed_net_value FROM t"""),
    "recent_totals": (recent_totals, """WITH p AS (SELECT (p_partkey * 7) % 400 AS age, p_retailprice AS ldt, p_retailprice * CASE WHEN upper(p_type) LIKE '%TANKER%' OR upper(p_type) LIKE '%LNG%' OR upper(p_type) LIKE '%LPG%' THEN 0.765 WHEN upper(p_type) LIKE '%BULK%' THEN 0.66 WHEN upper(p_type) LIKE '%CONTAINER%' THEN 0.65
 WHEN upper(p_type) LIKE '%CARGO%' OR upper(p_type) LIKE '%RORO%' THEN 0.63 WHEN upper(p_type) SIMILAR TO '.*(PLATFORM|RIG|DRILL|BARGE).*' THEN 0.35 ELSE 0.60 END AS t FROM part), l AS (SELECT unnest([30, 60, 90, 120, 180, 365])::BIGINT AS lookback)
SELECT lookback, count(*) AS vessels, round(sum(ldt), 4) AS ldt, round(sum(t), 4) AS plate FROM l JOIN p ON age BETWEEN 0 AND lookback GROUP BY lookback"""),
    "scenario_kernel": (scenario_kernel, """WITH p AS (SELECT (p_partkey * 7) % 400 AS age, p_retailprice * CASE WHEN upper(p_type) LIKE '%TANKER%' OR upper(p_type) LIKE '%LNG%' OR upper(p_type) LIKE '%LPG%' THEN 0.765 WHEN upper(p_type) LIKE '%BULK%' THEN 0.66 WHEN upper(p_type) LIKE '%CONTAINER%' THEN 0.65
 WHEN upper(p_type) LIKE '%CARGO%' OR upper(p_type) LIKE '%RORO%' THEN 0.63 WHEN upper(p_type) SIMILAR TO '.*(PLATFORM|RIG|DRILL|BARGE).*' THEN 0.35 ELSE 0.60 END AS t FROM part),
g AS (SELECT theta, w FROM (SELECT unnest([30.0, 45.0])::DOUBLE AS theta) CROSS JOIN (SELECT unnest([30, 45, 60, 90])::BIGINT AS w)), x AS (SELECT theta, w, t, age / theta AS a, (age + w) / theta AS b FROM p CROSS JOIN g WHERE age BETWEEN 0 AND 365)
SELECT theta, w AS "window", count(*) AS vessels, round(sum(t * (exp(-a) * (1 + a + a * a / 2) - exp(-b) * (1 + b + b * b / 2))), 4) AS release FROM x GROUP BY ALL"""),
    "class_losses": (class_losses, f"""WITH {TARGETS}, t AS (SELECT series, direction AS y, greatest(f, 0) + 0.06 AS m, 0.1 + 0.015 AS z, greatest(-f, 0) + 0.075 AS p FROM targets WHERE f IS NOT NULL), q AS (SELECT series, y, m / (m + z + p) AS m, z / (m + z + p) AS z, p / (m + z + p) AS p FROM t)
SELECT series, round(avg(((y = -1)::INT - m) ** 2 + ((y = 0)::INT - z) ** 2 + ((y = 1)::INT - p) ** 2), 6) AS brier, round(avg(-ln(greatest(CASE y WHEN -1 THEN m WHEN 0 THEN z ELSE p END, 1e-12))), 6) AS log_loss FROM q GROUP BY series"""),
    "block_bootstrap": (block_bootstrap, f"""WITH {TARGETS}, {BOOT.format(t="targets", w=W, seed=20260812, reps=200, b=21, avgs="avg(ret) AS x")}, o AS (SELECT series, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, stddev_samp(x) AS se, (1 + sum((x <= 0)::INT)) / 201.0 AS p FROM m GROUP BY series)
SELECT t.series, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean, round(any_value(lo), 6) + 0.0 AS ci_low, round(any_value(hi), 6) + 0.0 AS ci_high, round(any_value(se), 6) AS se, round(any_value(p), 6)::DOUBLE AS p_one_sided FROM targets t JOIN o ON t.series = o.series GROUP BY t.series"""),
    "block_correlation": (block_correlation, f"""WITH {TARGETS}, t AS (SELECT series, d, f, ret FROM targets WHERE f IS NOT NULL), {BOOT.format(t="t", w=W, seed=11, reps=200, b=21, avgs="corr(f, ret) AS x")}, o AS (SELECT series, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM m GROUP BY series)
SELECT t.series, count(*) AS n, round(corr(f, ret), 6) + 0.0 AS r, round(any_value(lo), 6) + 0.0 AS ci_low, round(any_value(hi), 6) + 0.0 AS ci_high FROM t JOIN o ON t.series = o.series GROUP BY t.series"""),
    "circular_shift_all": (circular_shift_all, None),
    "circular_shift": (circular_shift, f"""WITH {TARGETS}, t AS (SELECT series, f, ret, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM targets WHERE f IS NOT NULL), s AS (SELECT unnest(range(10, 410, 10)) AS s),
c AS (SELECT a.series, s, corr(a.f, b.ret) AS r FROM t a CROSS JOIN s JOIN t b ON a.series = b.series AND b.i = (a.i + s) % a.n GROUP BY ALL), o AS (SELECT series, corr(f, ret) AS r0 FROM t GROUP BY series)
SELECT o.series, round(any_value(r0), 6) + 0.0 AS r, round((1 + sum((abs(r) >= abs(r0) - 1e-9)::INT)) / 41.0, 6)::DOUBLE AS p FROM c JOIN o ON c.series = o.series GROUP BY o.series"""),
    "max_null": (max_null, f"""WITH {TARGETS}, t AS (SELECT series, d, abs(ret) - abs(ret - 0.01) AS a, abs(ret) - abs(ret + f * 0.1) AS b, -f * ret AS c FROM targets WHERE f IS NOT NULL), {BOOT.format(t="t", w=W, seed=7, reps=200, b=21, avgs="avg(a) AS a, avg(b) AS b, avg(c) AS c")},
l AS (UNPIVOT m ON a, b, c INTO NAME candidate VALUE v), o0 AS (SELECT series, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM t GROUP BY series), o AS (UNPIVOT o0 ON a, b, c INTO NAME candidate VALUE mean), se AS (SELECT series, candidate, stddev_samp(v) AS se FROM l GROUP BY ALL),
z AS (SELECT l.series, l.candidate, rep, (v - mean) / se AS z, mean / se AS t, mean, se FROM l JOIN o USING (series, candidate) JOIN se USING (series, candidate)), w AS (SELECT series, rep, max(z) AS top FROM z GROUP BY ALL)
SELECT z.series, z.candidate, round(any_value(mean), 6) + 0.0 AS mean, round(any_value(se), 6) AS se, round(any_value(t), 6) + 0.0 AS t, round((1 + sum((z.z >= t - 1e-9)::INT)) / 201.0, 6)::DOUBLE AS raw_p, round((1 + sum((top >= t - 1e-9)::INT)) / 201.0, 6)::DOUBLE AS adjusted_p,
 round(quantile_cont(top, 0.95), 6) AS null_95 FROM z JOIN w ON z.series = w.series AND z.rep = w.rep GROUP BY z.series, z.candidate"""),
    "holm": (holm, """WITH p AS (SELECT p_brand, substr(p_brand, 7, 1) AS family, CASE WHEN count(*) % 5 <> 0 THEN abs(avg(p_size) / 400 - 0.05) END AS p FROM part GROUP BY p_brand),
k AS (SELECT *, (count(*) OVER (PARTITION BY family, p IS NULL) - row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p) + 1) * p AS h FROM p)
SELECT p_brand, family, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, max(h) OVER (PARTITION BY family, p IS NULL ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END, 6) AS holm_p FROM k"""),
    "binomial_tail": (binomial_tail, """WITH n AS (SELECT (n_nationkey + 10)::BIGINT AS n, ((n_nationkey * 7) % 20)::BIGINT AS hits FROM nation), k AS (SELECT n, hits, unnest(range(hits, n + 1)) AS k FROM n WHERE hits <= n),
s AS (SELECT n, hits, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) AS tail FROM k GROUP BY ALL) SELECT n.n, n.hits, round(least(1.0, coalesce(tail, 0)), 9) AS tail FROM n LEFT JOIN s ON n.n = s.n AND n.hits = s.hits"""),
}
