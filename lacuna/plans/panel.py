"""Windows over series: gaps, fills, rolling statistics, changes, indices, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.functions.labels import row_mean
from lacuna.operators.series import ewma_volatility
from lacuna.plans.base import DAILY, HOLED, S, Plan, big, daily, holed, r6


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("series", "d", r6("price").alias("price"), "n", "open", "close", "high", "low")


def gap_segments(spark, sf_dir):
    df = S.segments(daily(spark, sf_dir), 3).groupBy("series", "segment").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("rows"), r6(F.min_by("price", "d")).alias("first_price"), r6(F.max_by("price", "d")).alias("last_price"))
    return df.withColumn("segment", big("segment"))


def gap_list(spark, sf_dir):
    return S.gaps(daily(spark, sf_dir), 5).select("series", "from", "to", big("days").alias("days"))


def rolling_z(spark, sf_dir):
    df = daily(spark, sf_dir)
    return df.select("series", "d", r6(S.z("price", 60)).alias("z60"), r6(S.z("price", 60, 45)).alias("z60_45"), r6(S.z("price", 40, 30)).alias("z40_30"), r6(S.z("price", 20, past=False, population=True)).alias("z20_pop")).filter("z40_30 IS NOT NULL")


def rolling_z_by_segment(spark, sf_dir):
    df = S.segments(daily(spark, sf_dir), 6)
    return df.select("series", "d", big("segment").alias("segment"), r6(S.within("segment").z("price", 20)).alias("z")).filter("z IS NOT NULL")


def rolling_robust(spark, sf_dir):
    df = daily(spark, sf_dir)
    return df.select("series", "d", r6(S.robust_z("price", 21)).alias("robust_z"), r6(S.median("price", 20, 15, 3)).alias("lagged_median")).filter("robust_z IS NOT NULL")


def fills(spark, sf_dir):
    return holed(spark, sf_dir).select("series", "d", r6(S.carried("x", 7)).alias("carried"), big(S.age("x")).alias("age"), r6(S.filled_once("x")).alias("filled_once"))


def momentum(spark, sf_dir):
    df = daily(spark, sf_dir)
    return df.select("series", "d", r6(S.calendar_change("price", 10)).alias("calendar_10"), r6(S.log_change("price", 5)).alias("rows_5"), r6(S.native_change("price", 2, 1)).alias("native_2"))


def momentum_present_rows(spark, sf_dir):
    df = holed(spark, sf_dir).filter("x IS NOT NULL")
    return df.select("series", "d", *[r6(S.log_change("x", k)).alias(f"m{k}") for k in (1, 5, 10)])


def monthly_momentum(spark, sf_dir):
    m = daily(spark, sf_dir).groupBy("series", F.trunc("d", "MM").alias("d")).agg(F.max_by("price", "d").alias("price")).filter(F.month("d") % 5 != 0)
    apart = (F.year("d") - F.year(S.lag("d"))) * 12 + F.month("d") - F.month(S.lag("d"))
    return m.select("series", "d", F.last_day("d").alias("available"), r6(S.log_change("price") / apart).alias("per_month"), big(apart).alias("months"))


def rolling_returns(spark, sf_dir):
    r = holed(spark, sf_dir).withColumn("r", F.when(S.gap_days() <= 3, S.log_change("x")))
    r = S.unbroken_sum(r, "r", 5, "sum5").withColumn("zero", S.unchanged("n"))
    return r.select("series", "d", r6("r").alias("r"), r6("sum5").alias("sum5"), r6(S.sd("r", 10, 7)).alias("sd10"), r6(S.mean("zero", 20, 15)).alias("unchanged_share"))


def capped_momentum(spark, sf_dir):
    e = daily(spark, sf_dir).withColumn("r", S.log_change("price")).withColumn("event", S.changed("n").cast("int"))
    w = S.last(5)
    return e.select("series", "d", big(F.sum("event").over(w)).alias("events"), r6(F.when((F.count("r").over(w) >= 4) & (F.sum("event").over(w) <= 3), F.sum("r").over(w))).alias("m5"))


def change_age(spark, sf_dir):
    df = holed(spark, sf_dir).withColumn("moved", S.moved("n"))
    return df.select("series", "d", "moved", big(S.days_since("moved")).alias("days"))


def ewma_vol(spark, sf_dir):
    df = holed(spark, sf_dir).withColumn("r", S.log_change("x"))
    return ewma_volatility(df.select("series", "d", "r"), S, "r").select("series", "d", r6("ewma_vol").alias("vol"))


def indices(spark, sf_dir):
    df = daily(spark, sf_dir).withColumn("r", S.log_change("price")).withColumn("p", F.expm1(F.col("r") / 100))
    return df.select("series", "d", r6(S.index("p")).alias("index"), r6(S.linked("p")).alias("linked"))


def lead_returns(spark, sf_dir):
    m = daily(spark, sf_dir).groupBy("series", F.trunc("d", "MM").alias("d")).agg(F.max_by("price", "d").alias("price"))
    return m.select("series", "d", *[r6(F.log(S.lead("price", k) / F.col("price"))).alias(f"fwd{k}") for k in (1, 2, 3)])


def runs_longest(spark, sf_dir):
    runs = S.runs(daily(spark, sf_dir), F.col("n") >= 2)
    w = Window.partitionBy("series").orderBy(F.desc("rows"), "first")
    return runs.withColumn("k", F.row_number().over(w)).filter("k <= 8").select("series", "first", "last", "rows", big("k").alias("k"))


def runs_equal(spark, sf_dir):
    runs = S.runs(daily(spark, sf_dir).withColumn("same", S.unchanged("n")), F.col("same") == 1)
    return runs.groupBy("series", "rows").agg(F.count("*").alias("runs"))


def trailing_eligible(spark, sf_dir):
    busy = daily(spark, sf_dir).withColumn("busy", (F.col("n") >= 2).cast("double"))
    df = busy.withColumn("share", S.mean("busy", 20, 20, 0)).withColumn("mid", S.median("n", 20, 20, 0))
    return df.groupBy("series").agg(F.min(F.when((F.col("share") >= 0.4) & (F.col("mid") >= 1), F.col("d"))).alias("first_eligible"))


def signal_entries(spark, sf_dir):
    df = S.segments(daily(spark, sf_dir), 6).withColumn("z", S.within("segment").z("price", 20)).withColumn("on", F.coalesce(F.col("z") > 1, F.lit(False)))
    return df.withColumn("entry", S.entries("on", "segment")).groupBy("series").agg(F.sum(big("on")).alias("on_rows"), F.sum(big("entry")).alias("entries"))


def live_rows(spark, sf_dir):
    live = daily(spark, sf_dir).groupBy("series").agg(F.max("d").alias("last"), F.max_by(F.struct("price", "n"), "d").alias("x"))
    return live.select("series", "last", r6("x.price").alias("price"), "x.n")


def top_moves(spark, sf_dir):
    df = daily(spark, sf_dir).withColumn("r", S.log_change("price"))
    return df.filter("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "series", "d").limit(15).select("series", "d", r6("r").alias("r"))


def row_means(spark, sf_dir):
    df = holed(spark, sf_dir).withColumn("y", F.when(F.col("n") > 1, F.col("close")))
    return df.select("series", "d", r6(row_mean(F.col("x"), F.col("y"))).alias("mean"))


def running_basis(spark, sf_dir):
    """Months as contracts: what the price moved at each change beyond its own day's change, and the running sum of that."""
    df = daily(spark, sf_dir).withColumn("month", F.date_format("d", "yyyy-MM"))
    basis = F.when(S.changed("month"), F.col("close") - (F.col("close") - F.col("open")) - S.lag("close"))
    df = df.withColumn("basis", basis).withColumn("running", S.running("basis"))
    return df.select("series", "d", F.round("basis", 4).alias("basis"), F.round("running", 4).alias("running"))


def contract_returns(spark, sf_dir):
    """Priorities as contracts; the busiest of the month before is the nearby one."""
    d = daily(spark, sf_dir).withColumn("m", F.trunc("d", "MM"))
    busy = Window.partitionBy("m").orderBy(F.desc("v"), "series")
    near = d.groupBy("m", "series").agg(F.sum("n").alias("v")).withColumn("k", F.row_number().over(busy)).filter("k = 1").select(F.add_months("m", 1).alias("m"), F.col("series").alias("symbol"))
    own = d.withColumn("same", F.when(S.gap_days() <= 7, S.log_change("price")))
    nearby = own.join(F.broadcast(near), (own["m"] == near["m"]) & (own["series"] == near["symbol"])).drop(near["m"])  # one row a month
    q = S.__class__(("root",), "d")
    rows = nearby.withColumn("root", F.lit("all")).select("root", "d", "symbol", "price", "same")
    rows = rows.withColumn("rolled", q.changed("symbol")).withColumn("raw", q.log_change("price"))
    out = rows.withColumn("basis", F.when(F.col("rolled"), F.col("raw") - F.col("same"))).withColumn("adjusted", q.index("same"))
    return out.select("d", "symbol", "rolled", r6("raw").alias("raw"), r6("same").alias("same"), r6("basis").alias("basis"), r6(F.log("adjusted")).alias("log_adjusted"))


W = "PARTITION BY series ORDER BY d"
PLANS: dict[str, Plan] = {
    "daily_panel": (daily_panel, f"WITH {DAILY} SELECT series, d, round(price, 6) AS price, n, open, close, high, low FROM daily"),
    "gap_segments": (gap_segments, f"""WITH {DAILY}, g AS (SELECT *, date_diff('day', lag(d) OVER ({W}), d) AS gap FROM daily),
s AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER ({W})::BIGINT AS segment FROM g)
SELECT series, segment, min(d) AS first, max(d) AS last, count(*) AS rows, round(arg_min(price, d), 6) AS first_price, round(arg_max(price, d), 6) AS last_price FROM s GROUP BY ALL"""),
    "gap_list": (gap_list, f"WITH {DAILY}, g AS (SELECT series, lag(d) OVER ({W}) AS \"from\", d AS \"to\", date_diff('day', lag(d) OVER ({W}), d) AS days FROM daily) SELECT * FROM g WHERE days > 5"),
    "rolling_z": (rolling_z, f"""WITH {DAILY}, z AS (SELECT series, d,
 round(CASE WHEN count(*) OVER a >= 60 THEN (price - avg(price) OVER a) / nullif(stddev_samp(price) OVER a, 0) END, 6) AS z60,
 round(CASE WHEN count(*) OVER a >= 45 THEN (price - avg(price) OVER a) / nullif(stddev_samp(price) OVER a, 0) END, 6) AS z60_45,
 round(CASE WHEN count(*) OVER b >= 30 THEN (price - avg(price) OVER b) / nullif(stddev_samp(price) OVER b, 0) END, 6) AS z40_30,
 round(CASE WHEN count(*) OVER c >= 20 THEN (price - avg(price) OVER c) / nullif(stddev_pop(price) OVER c, 0) END, 6) AS z20_pop FROM daily
 WINDOW a AS ({W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), b AS ({W} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), c AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT * FROM z WHERE z40_30 IS NOT NULL"""),
    "rolling_z_by_segment": (rolling_z_by_segment, f"""WITH {DAILY}, g AS (SELECT *, date_diff('day', lag(d) OVER ({W}), d) AS gap FROM daily),
s AS (SELECT *, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER ({W})::BIGINT AS segment FROM g),
z AS (SELECT series, d, segment, round(CASE WHEN count(*) OVER a >= 20 THEN (price - avg(price) OVER a) / nullif(stddev_samp(price) OVER a, 0) END, 6) AS z FROM s
 WINDOW a AS (PARTITION BY series, segment ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT * FROM z WHERE z IS NOT NULL"""),
    "rolling_robust": (rolling_robust, f"""WITH {DAILY}, w AS (SELECT series, d, price, list(price) OVER a AS l, median(price) OVER a AS m, count(*) OVER b AS nb, median(price) OVER b AS mb FROM daily
 WINDOW a AS ({W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), b AS ({W} ROWS BETWEEN 22 PRECEDING AND 3 PRECEDING))
SELECT series, d, round((price - m) / nullif(1.4826 * list_median(list_transform(l, lambda v: abs(v - m))), 0), 6) AS robust_z, round(CASE WHEN nb >= 15 THEN mb END, 6) AS lagged_median FROM w WHERE len(l) >= 21"""),
    "fills": (fills, f"""WITH {HOLED}, a AS (SELECT series, d, last_value(x IGNORE NULLS) OVER w AS v, date_diff('day', last_value(CASE WHEN x IS NOT NULL THEN d END IGNORE NULLS) OVER w, d) AS age,
 coalesce(x, lag(x) OVER ({W})) AS f FROM holed WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series, d, round(CASE WHEN age <= 7 THEN v END, 6) AS carried, age, round(f, 6) AS filled_once FROM a"""),
    "momentum": (momentum, f"""WITH {DAILY}, a AS (SELECT *, lag(price, 5) OVER ({W}) AS p5, lag(price, 2) OVER ({W}) AS p2, lag(d, 2) OVER ({W}) AS d2 FROM daily),
b AS (SELECT a.*, e.price AS pc, e.d AS dc FROM a ASOF LEFT JOIN daily e ON a.series = e.series AND e.d <= a.d - 10)
SELECT series, d, round(CASE WHEN dc >= d - 14 THEN ln(price / pc) END, 6) + 0.0 AS calendar_10, round(ln(price / p5), 6) + 0.0 AS rows_5, round(CASE WHEN d - d2 = 2 THEN ln(price / p2) END, 6) + 0.0 AS native_2 FROM b"""),
    "momentum_present_rows": (momentum_present_rows, f"""WITH {HOLED} SELECT series, d, round(ln(x / lag(x, 1) OVER ({W})), 6) + 0.0 AS m1, round(ln(x / lag(x, 5) OVER ({W})), 6) + 0.0 AS m5, round(ln(x / lag(x, 10) OVER ({W})), 6) + 0.0 AS m10 FROM holed WHERE x IS NOT NULL"""),
    "monthly_momentum": (monthly_momentum, f"""WITH {DAILY}, m AS (SELECT series, date_trunc('month', d)::DATE AS d, arg_max(price, daily.d) AS price FROM daily GROUP BY series, date_trunc('month', d)::DATE),
k AS (SELECT *, lag(price) OVER ({W}) AS p0, (year(d) - year(lag(d) OVER ({W}))) * 12 + month(d) - month(lag(d) OVER ({W})) AS months FROM m WHERE month(d) % 5 <> 0)
SELECT series, d, last_day(d) AS available, round(ln(price / p0) / months, 6) + 0.0 AS per_month, months::BIGINT AS months FROM k"""),
    "rolling_returns": (rolling_returns, f"""WITH {HOLED}, r AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER ({W}), d) <= 3 THEN ln(x / lag(x) OVER ({W})) END AS r, CASE WHEN n = lag(n) OVER ({W}) THEN 1.0 ELSE 0.0 END AS same FROM holed)
SELECT series, d, round(r, 6) + 0.0 AS r, round(CASE WHEN count(r) OVER a = 5 THEN sum(r) OVER a END, 6) + 0.0 AS sum5, round(CASE WHEN count(r) OVER b >= 7 THEN stddev_samp(r) OVER b END, 6) AS sd10,
 round(CASE WHEN count(*) OVER c >= 15 THEN avg(same) OVER c END, 6) AS unchanged_share FROM r
WINDOW a AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), c AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""),
    "capped_momentum": (capped_momentum, f"""WITH {DAILY}, e AS (SELECT *, ln(price / lag(price) OVER ({W})) AS r, CASE WHEN n <> lag(n) OVER ({W}) THEN 1 ELSE 0 END AS event FROM daily)
SELECT series, d, (sum(event) OVER a)::BIGINT AS events, round(CASE WHEN count(r) OVER a >= 4 AND sum(event) OVER a <= 3 THEN sum(r) OVER a END, 6) + 0.0 AS m5 FROM e WINDOW a AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""),
    "change_age": (change_age, f"""WITH {HOLED}, m AS (SELECT series, d, coalesce(n <> lag(n) OVER ({W}), true) AS moved FROM holed)
SELECT series, d, moved, date_diff('day', last_value(CASE WHEN moved THEN d END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d) AS days FROM m"""),
    "ewma_vol": (ewma_vol, f"""WITH RECURSIVE {HOLED}, r AS (SELECT series, d, ln(x / lag(x) OVER ({W})) AS r, row_number() OVER ({W}) AS i FROM holed),
p AS (SELECT series, d, i, lag(r) OVER (PARTITION BY series ORDER BY i) AS prior FROM r),
e AS (SELECT series, i, d, NULL::DOUBLE AS v, prior FROM p WHERE i = 1 UNION ALL
 SELECT p.series, p.i, p.d, CASE WHEN p.prior IS NULL THEN e.v WHEN e.v IS NULL THEN p.prior * p.prior ELSE 0.94 * e.v + 0.06 * p.prior * p.prior END, p.prior FROM e JOIN p ON p.series = e.series AND p.i = e.i + 1)
SELECT series, d, round(CASE WHEN prior IS NOT NULL THEN sqrt(v) END, 6) AS vol FROM e"""),
    "indices": (indices, f"""WITH {DAILY}, r AS (SELECT series, d, exp(ln(price / lag(price) OVER ({W})) / 100) - 1 AS p FROM daily)
SELECT series, d, round(100 * exp(sum(coalesce(p, 0)) OVER a), 6) AS index, round(100 * exp(sum(ln(1 + coalesce(p, 0))) OVER a), 6) AS linked FROM r WINDOW a AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "lead_returns": (lead_returns, f"""WITH {DAILY}, m AS (SELECT series, date_trunc('month', d)::DATE AS d, arg_max(price, daily.d) AS price FROM daily GROUP BY series, date_trunc('month', d)::DATE)
SELECT series, d, round(ln(lead(price, 1) OVER ({W}) / price), 6) + 0.0 AS fwd1, round(ln(lead(price, 2) OVER ({W}) / price), 6) + 0.0 AS fwd2, round(ln(lead(price, 3) OVER ({W}) / price), 6) + 0.0 AS fwd3 FROM m"""),
    "runs_longest": (runs_longest, f"""WITH {DAILY}, a AS (SELECT *, sum(CASE WHEN n >= 2 THEN 0 ELSE 1 END) OVER ({W}) AS run FROM daily),
b AS (SELECT series, min(d) AS first, max(d) AS last, count(*) AS rows FROM a WHERE n >= 2 GROUP BY series, run), c AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY rows DESC, first) AS k FROM b) SELECT * FROM c WHERE k <= 8"""),
    "runs_equal": (runs_equal, f"""WITH {DAILY}, s AS (SELECT *, coalesce(n = lag(n) OVER ({W}), false) AS same FROM daily), a AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER ({W}) AS run FROM s),
b AS (SELECT series, count(*) AS rows FROM a WHERE same GROUP BY series, run) SELECT series, rows, count(*) AS runs FROM b GROUP BY ALL"""),
    "trailing_eligible": (trailing_eligible, f"""WITH {DAILY}, a AS (SELECT series, d, count(*) OVER w AS k, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) OVER w AS share, median(n) OVER w AS mid FROM daily WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT series, min(CASE WHEN k >= 20 AND share >= 0.4 AND mid >= 1 THEN d END) AS first_eligible FROM a GROUP BY series"""),
    "signal_entries": (signal_entries, f"""WITH {DAILY}, g AS (SELECT *, date_diff('day', lag(d) OVER ({W}), d) AS gap FROM daily),
s AS (SELECT *, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER ({W}) AS segment FROM g),
z AS (SELECT *, coalesce(CASE WHEN count(*) OVER a >= 20 THEN (price - avg(price) OVER a) / nullif(stddev_samp(price) OVER a, 0) END > 1, false) AS on_ FROM s WINDOW a AS (PARTITION BY series, segment ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, on_ AND (NOT coalesce(lag(on_) OVER ({W}), false) OR coalesce(segment <> lag(segment) OVER ({W}), false)) AS entry FROM z)
SELECT series, sum(on_::INT)::BIGINT AS on_rows, sum(entry::INT)::BIGINT AS entries FROM e GROUP BY series"""),
    "live_rows": (live_rows, f"WITH {DAILY} SELECT series, max(d) AS last, round(arg_max(price, d), 6) AS price, arg_max(n, d) AS n FROM daily GROUP BY series"),
    "top_moves": (top_moves, f"WITH {DAILY}, r AS (SELECT series, d, ln(price / lag(price) OVER ({W})) AS r FROM daily) SELECT series, d, round(r, 6) AS r FROM r WHERE r IS NOT NULL ORDER BY abs(r) DESC, series, d LIMIT 15"),
    "row_means": (row_means, f"WITH {HOLED}, y AS (SELECT *, CASE WHEN n > 1 THEN close END AS y FROM holed) SELECT series, d, round(CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE (x + y) / 2 END, 6) AS mean FROM y"),
    "running_basis": (running_basis, f"""WITH {DAILY}, l AS (SELECT series, d, open, close, lag(close) OVER ({W}) AS before, strftime(d, '%Y-%m') AS m, lag(strftime(d, '%Y-%m')) OVER ({W}) AS m0 FROM daily), b AS (SELECT series, d, CASE WHEN m0 IS NOT NULL AND m <> m0 THEN close - (close - open) - before END AS basis FROM l)
SELECT series, d, round(basis, 4) + 0.0 AS basis, round(coalesce(sum(basis) OVER ({W}), 0), 4) + 0.0 AS running FROM b"""),
    "contract_returns": (contract_returns, f"""WITH {DAILY}, v AS (SELECT date_trunc('month', d)::DATE AS m, series, sum(n) AS v FROM daily GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY v DESC, series) AS k FROM v), near AS (SELECT (m + INTERVAL 1 MONTH)::DATE AS m, series AS symbol FROM k WHERE k = 1),
own AS (SELECT *, date_trunc('month', d)::DATE AS m, CASE WHEN date_diff('day', lag(d) OVER ({W}), d) <= 7 THEN ln(price / lag(price) OVER ({W})) END AS same FROM daily),
n AS (SELECT d, symbol, price, same FROM own JOIN near ON own.m = near.m AND own.series = near.symbol),
r AS (SELECT *, coalesce(symbol <> lag(symbol) OVER (ORDER BY d), false) AS rolled, ln(price / lag(price) OVER (ORDER BY d)) AS raw FROM n)
SELECT d, symbol, rolled, round(raw, 6) + 0.0 AS raw, round(same, 6) + 0.0 AS same, round(CASE WHEN rolled THEN raw - same END, 6) + 0.0 AS basis,
 round(ln(100) + sum(coalesce(same, 0)) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS log_adjusted FROM r"""),
}
