"""Point-in-time joins, relational set operations and ordered selections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.functions.labels import fade_call, outcome
from lacuna.operators import folds, joins
from lacuna.operators.stats import rule_scores
from lacuna.plans.base import DAILY, TARGETS, S, Plan, big, daily, r6, targets
from lacuna.session import table


def _events(spark, sf_dir, kind, *names):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    ts, eid, value = names
    return e.select("user_id", F.col("ts").alias(ts), F.col("event_id").alias(eid), F.col("value").alias(value))


def asof_strict(spark, sf_dir):
    """Purchases with the last error of the user strictly before; a user's rows are sorted by day of the month, not all at once."""
    left, right = _events(spark, sf_dir, "purchase", "ts", "event_id", "value"), _events(spark, sf_dir, "error", "rts", "error_id", "error_value")
    right = right.groupBy("user_id", "rts").agg(F.max_by("error_value", "error_id").alias("error_value"), F.max("error_id").alias("error_id"))
    out = joins.asof(left, right, ["user_id"], "ts", "rts", ["error_id", "error_value"], bucket=F.to_date("__t"))
    age = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("rts").cast("timestamp"))) / 1_000_000)
    return out.select("event_id", "error_id", "error_value", big(age).alias("age_seconds"))


def asof_tolerance(spark, sf_dir):
    left, right = _events(spark, sf_dir, "purchase", "ts", "event_id", "value"), _events(spark, sf_dir, "error", "rts", "error_id", "error_value")
    right = right.groupBy("user_id", "rts").agg(F.max_by("error_value", "error_id").alias("error_value"), F.max("error_id").alias("error_id"))
    out = joins.asof(left, right, ["user_id"], "ts", "rts", ["error_id", "error_value"])
    age = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("rts").cast("timestamp"))) / 1_000_000)
    return joins.stale_to_null(out.withColumn("age", age), F.col("age"), 86400, ["error_id", "error_value"]).select("event_id", "error_id", "error_value")


def forward_target(spark, sf_dir):
    days = daily(spark, sf_dir).select("series", "d", "price")
    out = joins.forward_targets(days, S, "price", [5, 10, 15, 30, 45, 60, 90])
    return out.select("series", "d", big("horizon").alias("horizon"), "end", r6("ret").alias("ret"), r6("change").alias("change"), big("direction").alias("direction"))


def forward_target_no_gap(spark, sf_dir):
    days = daily(spark, sf_dir).select("series", "d", "price")
    out = joins.forward_targets(days, S, "price", [5, 30], 3, gap=4, crossing="segment")
    return out.select("series", "d", big("horizon").alias("horizon"), "end", r6("ret").alias("ret"))


def attach_next_origin(spark, sf_dir):
    """Monthly figures of each series, available at month end, attached to the first quote after."""
    days = daily(spark, sf_dir)
    m = days.groupBy("series", F.last_day("d").alias("available")).agg(F.sum("n").alias("value"))
    return joins.attach_next(m, days.filter(F.dayofmonth("d") > 3), ["series"], "available", "d", ["value"])


def outer_momentum(spark, sf_dir):
    """Two series' changes on all days that either has."""
    one = lambda k, name: daily(spark, sf_dir).filter(F.substring("series", 1, 1) == k).select("d", S.log_change("price").alias(name))
    return one("1", "a").join(one("3", "b"), "d", "full_outer").select("d", r6("a").alias("a"), r6("b").alias("b"))


def month_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("m")).agg(F.count("*").alias("orders"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("m")).agg(F.sum("l_quantity").alias("returned"))
    return orders.join(lines, "m", "left").select("m", "orders", r6("returned").alias("returned"))


def lagged_key_join(spark, sf_dir):
    """Each month's first supplier row joined to its own row of the month before, keys checked to be unique."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("m")).agg(F.sum("l_quantity").alias("q"))
    before = joins.unique_on(lines.select("k", F.add_months("m", 1).alias("m"), F.col("q").alias("q0")), ["k", "m"])
    return lines.join(before, ["k", "m"], "left").select("k", "m", "q", "q0")


def paired_models(spark, sf_dir):
    """Two predictors of the same origins, side by side."""
    t = targets(spark, sf_dir)
    a = t.filter("f IS NOT NULL").select("series", "d", "ret", (F.col("f") * 0.1).alias("p"))
    b = t.filter("f < 0.5").select("series", "d", "ret", F.lit(0.0).alias("p"))
    both = joins.paired(a, b, ["series", "d"]).withColumn("gain", F.abs(F.col("ret_b") - F.col("p_b")) - F.abs(F.col("ret_a") - F.col("p_a")))
    return both.groupBy("series").agg(F.count("*").alias("n"), r6(F.avg("gain")).alias("gain"))


def matured_counts(spark, sf_dir):
    """At each quote how many targets had matured, by direction."""
    t = targets(spark, sf_dir)
    out = joins.matured(t.select("series", "d"), t, ["series"], "d", "end", [F.lit(1.0), (F.col("direction") > 0).cast("double"), F.col("ret")])
    return out.select("series", "d", big("sum_0").alias("matured"), big("sum_1").alias("up"), r6("sum_2").alias("ret"))


def latest_per_key(spark, sf_dir):
    """First and last event of each user and type, with explicit tie-breaks."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type")
    kept = e.withColumn("first", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("last", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))))
    return kept.filter("first = 1 OR last = 1").select("user_id", "event_type", "event_id", r6("value").alias("value"))


def date_sets(spark, sf_dir):
    """Weekdays without a quote, days common to two series, and days of one alone, by series and kind."""
    from lacuna.operators.audits import missing_weekdays

    days = daily(spark, sf_dir).select("series", "d")
    urgent = days.filter(F.substring("series", 1, 1) == "1").select("d")
    missing = missing_weekdays(days, ["series"], "d").groupBy("series").agg(F.count("*").alias("n")).withColumn("kind", F.lit("missing"))
    common = days.join(urgent, "d", "left_semi").groupBy("series").agg(F.count("*").alias("n")).withColumn("kind", F.lit("common"))
    alone = days.join(urgent, "d", "left_anti").groupBy("series").agg(F.count("*").alias("n")).withColumn("kind", F.lit("alone"))
    return missing.unionByName(common).unionByName(alone)


def greedy_nonoverlap(spark, sf_dir):
    t = targets(spark, sf_dir)
    return folds.greedy(t, ["series"], "d", "end")


def effective_n(spark, sf_dir):
    t = joins.forward_targets(daily(spark, sf_dir).select("series", "d", "price"), S, "price", [5, 15, 30, 60, 90])
    return folds.greedy_count(t, ["series", "horizon"], "d", "end").select("series", big("horizon").alias("horizon"), "n_effective")


def row_spacing(spark, sf_dir):
    numbered = daily(spark, sf_dir).withColumn("i", F.row_number().over(S.ordered)).filter("n > 1")
    return folds.row_spaced(numbered, ["series"], "i", 20)


def spaced_origins(spark, sf_dir):
    """Quotes at least 7 days apart with 80 matured targets; the latest is always one."""
    t = targets(spark, sf_dir)
    ready = joins.matured(t.select("series", "d"), t, ["series"], "d", "end", [F.lit(1.0)]).filter("sum_0 >= 80")
    return folds.spaced(ready, ["series"], "d", 7, keep_last=True)


def phase_cohorts(spark, sf_dir):
    chains = folds.phase_cohorts(targets(spark, sf_dir), ["series"], "d", "end")
    return chains.groupBy("series", "cohort").agg(F.count("*").alias("n"), F.max("end").alias("last"))


def modulo_phases(spark, sf_dir):
    """Greedy counts inside each phase of the horizon."""
    t = targets(spark, sf_dir).withColumn("phase", folds.modulo_cohort(F.col("d"), 30))
    return folds.greedy_count(t, ["series", "phase"], "d", "end").select("series", big("phase").alias("phase"), "n_effective")


def scored_rule(spark, sf_dir):
    """The flagship chain: quotes, gap segments, past z, 30-day targets, fade calls, scorecard."""
    days = S.segments(daily(spark, sf_dir).select("series", "d", "price"), 6).withColumn("z", S.within("segment").z("price", 20))
    t = joins.forward_targets(days, S, "price", [30]).withColumn("call", fade_call(F.col("z")))
    t = t.withColumns(outcome(F.col("call"), F.col("ret"), F.col("change"), F.col("horizon")))
    out = t.groupBy("series").agg(*rule_scores("call"))
    return out.select("series", "eligible_n", "called_n", "up_calls", "down_calls", *[r6(c).alias(c) for c in ("coverage", "hit_rate", "mean_signed_ret", "median_signed_change", "economic_hit_rate", "mean_net_value")])


W = "PARTITION BY series ORDER BY d"
PURCHASES = """l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts AS rts, arg_max(value, event_id) AS error_value, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY ALL)"""
EACH = """SELECT a.series, a.d, h.h AS horizon, e.d AS "end", a.price AS p0, e.price AS p1 FROM daily a CROSS JOIN h ASOF JOIN (SELECT daily.*, h.h FROM daily CROSS JOIN h) e ON a.series = e.series AND h.h = e.h AND e.d >= a.d + h.h::INT"""
GREEDY = """RECURSIVE {prelude}, g AS (SELECT {keys}, min(d) AS d FROM {t} GROUP BY {keys}), walk AS (
 SELECT {tkeys}, t.d, t."end" FROM g JOIN {t} t ON {on} AND t.d = g.d
 UNION ALL SELECT {wkeys}, n.d, n."end" FROM walk w JOIN LATERAL (SELECT t.d, t."end" FROM {t} t WHERE {won} AND t.d >= w."end" ORDER BY t.d LIMIT 1) n ON true)"""


def _greedy(prelude: str, t: str, *keys: str) -> str:
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    return GREEDY.format(prelude=prelude, t=t, keys=", ".join(keys), tkeys=of("t"), wkeys=of("w"), on=" AND ".join(f"t.{k} = g.{k}" for k in keys), won=" AND ".join(f"t.{k} = w.{k}" for k in keys))


HORIZONS = DAILY + f""", h AS (SELECT unnest([5, 15, 30, 60, 90])::BIGINT AS h), ht AS (SELECT series, horizon, d, "end" FROM ({EACH}) WHERE "end" <= d + horizon::INT + 4)"""
PHASED = TARGETS + """, pt AS (SELECT *, (date_diff('day', DATE '2000-01-01', d) % 30 + 30) % 30 AS phase FROM targets)"""
READY = TARGETS + """, ready AS (SELECT o.series, o.d FROM targets o JOIN targets t ON t.series = o.series AND t."end" < o.d GROUP BY ALL HAVING count(*) >= 80)"""

PLANS: dict[str, Plan] = {
    "asof_strict": (asof_strict, f"""WITH {PURCHASES} SELECT event_id, error_id, error_value, date_diff('microsecond', rts, ts) // 1000000 AS age_seconds FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.rts"""),
    "asof_tolerance": (asof_tolerance, f"""WITH {PURCHASES}, j AS (SELECT *, date_diff('microsecond', rts, ts) // 1000000 > 86400 AS old FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.rts)
SELECT event_id, CASE WHEN NOT coalesce(old, false) THEN error_id END AS error_id, CASE WHEN NOT coalesce(old, false) THEN error_value END AS error_value FROM j"""),
    "forward_target": (forward_target, f"""WITH {DAILY}, h AS (SELECT unnest([5, 10, 15, 30, 45, 60, 90])::BIGINT AS h), t AS ({EACH})
SELECT series, d, horizon, "end", round(ln(p1 / p0), 6) + 0.0 AS ret, round(p1 - p0, 6) + 0.0 AS change, sign(p1 - p0)::BIGINT AS direction FROM t WHERE "end" <= d + horizon::INT + 4"""),
    "forward_target_no_gap": (forward_target_no_gap, f"""WITH g AS (SELECT * FROM (WITH {DAILY} SELECT *, date_diff('day', lag(d) OVER ({W}), d) AS gap FROM daily)),
daily AS (SELECT *, sum(CASE WHEN gap > 4 THEN 1 ELSE 0 END) OVER ({W}) AS seg FROM g), h AS (SELECT unnest([5, 30])::BIGINT AS h),
t AS (SELECT a.series, a.d, h.h AS horizon, e.d AS "end", a.price AS p0, e.price AS p1, a.seg AS s0, e.seg AS s1 FROM daily a CROSS JOIN h ASOF JOIN (SELECT daily.*, h.h FROM daily CROSS JOIN h) e ON a.series = e.series AND h.h = e.h AND e.d >= a.d + h.h::INT)
SELECT series, d, horizon, "end", round(ln(p1 / p0), 6) + 0.0 AS ret FROM t WHERE "end" <= d + horizon::INT + 3 AND s0 = s1"""),
    "attach_next_origin": (attach_next_origin, f"""WITH {DAILY}, m AS (SELECT series, last_day(d) AS available, sum(n)::BIGINT AS value FROM daily GROUP BY ALL), p AS (SELECT series, d FROM daily WHERE day(d) > 3),
j AS (SELECT m.*, p.d FROM m ASOF JOIN p ON m.series = p.series AND p.d > m.available) SELECT series, d, max(available) AS available, arg_max(value, available) AS value FROM j GROUP BY ALL"""),
    "outer_momentum": (outer_momentum, f"""WITH {DAILY}, r AS (SELECT series, d, ln(price / lag(price) OVER ({W})) AS r FROM daily), a AS (SELECT d, r FROM r WHERE series[1] = '1'), b AS (SELECT d, r FROM r WHERE series[1] = '3')
SELECT coalesce(a.d, b.d) AS d, round(a.r, 6) + 0.0 AS a, round(b.r, 6) + 0.0 AS b FROM a FULL JOIN b ON a.d = b.d"""),
    "month_join": (month_join, """WITH o AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS orders FROM orders GROUP BY 1), l AS (SELECT date_trunc('month', l_shipdate)::DATE AS m, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o.m, orders, round(returned, 6) AS returned FROM o LEFT JOIN l ON o.m = l.m"""),
    "lagged_key_join": (lagged_key_join, """WITH l AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate)::DATE AS m, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT a.k, a.m, a.q, b.q AS q0 FROM l a LEFT JOIN l b ON a.k = b.k AND a.m = (b.m + INTERVAL 1 MONTH)::DATE"""),
    "paired_models": (paired_models, f"""WITH {TARGETS} SELECT series, count(*) AS n, round(avg(abs(ret) - abs(ret - f * 0.1)), 6) + 0.0 AS gain FROM targets WHERE f < 0.5 GROUP BY series"""),
    "matured_counts": (matured_counts, f"""WITH {TARGETS} SELECT o.series, o.d, count(t.d) AS matured, count(CASE WHEN t.direction > 0 THEN 1 END) AS up, round(coalesce(sum(t.ret), 0), 6) + 0.0 AS ret FROM targets o LEFT JOIN targets t ON t.series = o.series AND t."end" < o.d GROUP BY ALL"""),
    "latest_per_key": (latest_per_key, """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b FROM events)
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM k WHERE a = 1 OR b = 1"""),
    "date_sets": (date_sets, f"""WITH {DAILY}, span AS (SELECT series, min(d) AS lo, max(d) AS hi FROM daily GROUP BY series), every AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM span),
u AS (SELECT d FROM daily WHERE series[1] = '1')
SELECT series, count(*) AS n, 'missing' AS kind FROM (SELECT series, d FROM every WHERE isodow(d) <= 5 EXCEPT SELECT series, d FROM daily) GROUP BY series
UNION ALL SELECT series, count(*), 'common' FROM daily WHERE d IN (SELECT d FROM u) GROUP BY series UNION ALL SELECT series, count(*), 'alone' FROM daily WHERE d NOT IN (SELECT d FROM u) GROUP BY series"""),
    "greedy_nonoverlap": (greedy_nonoverlap, f"""WITH {_greedy(TARGETS, "targets", "series")} SELECT * FROM walk"""),
    "effective_n": (effective_n, f"""WITH {_greedy(HORIZONS, "ht", "series", "horizon")} SELECT series, horizon, count(*) AS n_effective FROM walk GROUP BY ALL"""),
    "row_spacing": (row_spacing, f"""WITH RECURSIVE {DAILY}, r AS (SELECT series, n, row_number() OVER ({W})::INT AS i FROM daily), k AS (SELECT series, i FROM r WHERE n > 1),
w AS (SELECT series, min(i) AS i FROM k GROUP BY series UNION ALL SELECT w.series, n.i FROM w JOIN LATERAL (SELECT k.i FROM k WHERE k.series = w.series AND k.i - w.i >= 20 ORDER BY k.i LIMIT 1) n ON true) SELECT series, i::BIGINT AS i FROM w"""),
    "spaced_origins": (spaced_origins, f"""WITH RECURSIVE {READY}, w AS (SELECT series, min(d) AS d FROM ready GROUP BY series UNION ALL SELECT w.series, n.d FROM w JOIN LATERAL (SELECT k.d FROM ready k WHERE k.series = w.series AND k.d >= w.d + 7 ORDER BY k.d LIMIT 1) n ON true)
SELECT series, d FROM w UNION SELECT series, max(d) FROM ready GROUP BY series"""),
    "phase_cohorts": (phase_cohorts, f"""WITH RECURSIVE {TARGETS}, f AS (SELECT series, arg_min("end", d) AS e FROM targets GROUP BY series),
walk AS (SELECT t.series, t.d AS start, t.d, t."end" FROM targets t JOIN f ON t.series = f.series AND t.d < f.e
 UNION ALL SELECT w.series, w.start, n.d, n."end" FROM walk w JOIN LATERAL (SELECT t.d, t."end" FROM targets t WHERE t.series = w.series AND t.d >= w."end" ORDER BY t.d LIMIT 1) n ON true)
SELECT series, start AS cohort, count(*) AS n, max("end") AS last FROM walk GROUP BY ALL"""),
    "modulo_phases": (modulo_phases, f"""WITH {_greedy(PHASED, "pt", "series", "phase")} SELECT series, phase::BIGINT AS phase, count(*) AS n_effective FROM walk GROUP BY ALL"""),
    "rule_scorecard": (scored_rule, f"""WITH {DAILY}, g AS (SELECT *, date_diff('day', lag(d) OVER ({W}), d) AS gap FROM daily), s AS (SELECT *, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER ({W}) AS segment FROM g),
z AS (SELECT *, CASE WHEN count(*) OVER a >= 20 THEN (price - avg(price) OVER a) / nullif(stddev_samp(price) OVER a, 0) END AS z FROM s WINDOW a AS (PARTITION BY series, segment ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
t AS (SELECT a.*, ln(e.price / a.price) AS ret, e.price - a.price AS change, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 ELSE 0 END AS call FROM z a ASOF JOIN daily e ON a.series = e.series AND e.d >= a.d + 30 WHERE e.d <= a.d + 34)
SELECT series, count(*) AS eligible_n, count(CASE WHEN call <> 0 THEN 1 END) AS called_n, count(CASE WHEN call > 0 THEN 1 END) AS up_calls, count(CASE WHEN call < 0 THEN 1 END) AS down_calls, round(avg(CASE WHEN call <> 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
 round(avg(CASE WHEN call <> 0 THEN (sign(change) = call)::INT END), 6) AS hit_rate, round(avg(CASE WHEN call <> 0 THEN call * ret END), 6) + 0.0 AS mean_signed_ret, round(median(CASE WHEN call <> 0 THEN call * change END), 6) + 0.0 AS median_signed_change,
 round(avg(CASE WHEN call <> 0 THEN (sign(change - 900) = call)::INT END), 6) AS economic_hit_rate, round(avg(CASE WHEN call <> 0 THEN call * (change - 900) END), 6) + 0.0 AS mean_net_value FROM t GROUP BY series"""),
}
