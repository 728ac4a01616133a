"""Ridge models, purged walk-forward, gates and family selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import folds, models, stats
from lacuna.plans.base import DAILY, TARGETS, S, Plan, big, daily, r6, targets
from lacuna.plans.pit import _greedy


def ridge_one(spark, sf_dir):
    """A one-feature ridge at every quote, trained on the targets that ended before it; running sums, no join."""
    t = targets(spark, sf_dir)
    out = models.ridge_one(t, t, ["series"], "d", "end", "f", "ret", 10.0, 80).filter("predicted IS NOT NULL")
    return out.select("series", "d", "train_n", r6("predicted").alias("predicted"), r6("baseline").alias("baseline"))


def ridge_scorecard(spark, sf_dir):
    t = targets(spark, sf_dir)
    out = models.ridge_one(t, t, ["series"], "d", "end", "f", "ret", 10.0, 80).filter("predicted IS NOT NULL")
    out = out.groupBy("series").agg(*stats.forecast_scores("ret", "predicted", "baseline"))
    return out.select("series", "n", *[r6(c).alias(c) for c in ("mae", "baseline_mae", "skill", "direction_hit")])


def class_frequencies(spark, sf_dir):
    t = targets(spark, sf_dir)
    out = models.class_frequency(t, t, ["series"], "d", "end", "direction")
    return out.select("series", "d", *[r6(f"f_{i}").alias(f"f_{i}") for i in range(3)])


def past_skill(spark, sf_dir):
    """Skill over matured rows, and over all earlier rows as the studies first had it."""
    t = targets(spark, sf_dir).filter("f IS NOT NULL").withColumn("p", F.col("f") * -0.1).select("series", "d", "end", "ret", "p")
    a = models.past_skill(t, ["series"], "d", "end", "ret", "p").select("series", "d", F.col("past_n").alias("n_matured"), r6("past_skill").alias("skill_matured"))
    b = models.past_skill(t, ["series"], "d", "end", "ret", "p", matured_only=False).select("series", "d", F.col("past_n").alias("n_all"), r6("past_skill").alias("skill_all"))
    return a.join(b, ["series", "d"])


def family_selection(spark, sf_dir):
    t = targets(spark, sf_dir).groupBy("series", F.year("d").alias("family")).agg(F.avg("ret").alias("a"), F.stddev_samp("ret").alias("b"), F.max("ret").alias("c"))
    best = models.best_family(t.withColumn("ok", F.col("a") > 0), ["series"], "ok", "a", "b", "c")
    return best.select("series", big("family").alias("family"), "ok", r6("score").alias("score"))


def analog_bands(spark, sf_dir):
    t = targets(spark, sf_dir).filter("f < -0.3")
    out = models.analog_band(t, ["series"], "ret", F.lit(38500.0))
    return out.select("series", "n", r6("band_low").alias("band_low"), r6("band_high").alias("band_high"), "defensible")


def _rules(spark, sf_dir):
    """The panel numbered by series, with a fading and a following rule as signs of a call."""
    from lacuna.operators import resample

    t = resample.numbered(targets(spark, sf_dir).filter("f IS NOT NULL"), ["series"], ["d"])
    sign = lambda test, s: F.when(test, s).otherwise(F.lit(0.0))
    return t.withColumns({"fade": sign(F.abs("f") > 0.2, -F.signum("f")), "follow": sign(F.abs("f") > 0.4, F.signum("f"))})


def _rule_null(spark, sf_dir, reps=40):
    from lacuna.operators import resample

    rows = _rules(spark, sf_dir)
    called = rows.selectExpr("series", "d", "`end`", "stack(2, 'fade', fade, 'follow', follow) as (candidate, s)").filter("s != 0")
    return resample.rule_shift_null(rows, ["series"], "ret", ["fade", "follow"], folds.greedy_count(called, ["series", "candidate"], "d", "end"), reps, 20260812)


def rule_shift_null(spark, sf_dir):
    """Each rule's standardised edge against the largest edge of both rules under joint circular shifts."""
    out = _rule_null(spark, sf_dir)
    return out.select("series", "candidate", "called", "n_effective", *[r6(c).alias(c) for c in ("mean", "edge", "adjusted_p", "null_mean", "null_95", "family_p")])


def rule_gates(spark, sf_dir):
    """Which rules pass the gate of effective counts, interval, phases, the max-null's adjusted p and economic hits, all computed."""
    t = _rules(spark, sf_dir).selectExpr("series", "d", "ret", "stack(2, 'fade', fade, 'follow', follow) as (candidate, s)").filter("s != 0").withColumn("signed", F.col("s") * F.col("ret"))
    keys = ["series", "candidate"]
    worst = t.withColumn("phase", folds.modulo_cohort(F.col("d"), 30)).groupBy(*keys, "phase").agg(F.avg("signed").alias("m")).groupBy(*keys).agg(F.min("m").alias("worst_phase"))
    all_ = t.groupBy(*keys).agg((F.avg("signed") - 2 * F.stddev_samp("signed") / F.sqrt(F.count("*"))).alias("ci_low"), F.avg((F.col("signed") > 0).cast("double")).alias("economic_hit_rate"))
    out = all_.join(worst, keys).join(_rule_null(spark, sf_dir).select(*keys, F.col("n_effective").alias("nonoverlap_n"), "adjusted_p"), keys)
    return out.select(*keys, "nonoverlap_n", *[r6(c).alias(c) for c in ("ci_low", "worst_phase", "adjusted_p", "economic_hit_rate")], models.rule_gate().alias("passes"))


def model_shift_null(spark, sf_dir):
    """Skill of three forecasts against the best skill of their circular shifts."""
    from lacuna.operators import resample

    t = resample.numbered(targets(spark, sf_dir).filter("f IS NOT NULL"), ["series"], ["d"]).withColumn("base", F.lit(0.01))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), (F.col("f") * w).alias("predicted")) for k, w in (("a", -0.1), ("b", 0.05), ("c", -0.6))]))
    out = resample.model_shift_null(t.withColumn("c", each).select("series", "i", "n", "ret", "base", "c.*"), ["series"], "candidate", "ret", "base", "predicted", 30, 77)
    return out.select("series", "candidate", "n", *[r6(c).alias(c) for c in ("skill", "adjusted_p", "null_mean", "null_95", "family_p", "deflated")])


def _features(spark, sf_dir):
    d = daily(spark, sf_dir).select("series", "d", "price", "n")
    d = d.withColumns({"f1": S.calendar_change("price", 7), "f2": S.z("price", 20), "f3": F.col("n").cast("double")})
    from lacuna.operators.joins import forward_targets

    t = forward_targets(d, S, "price", [30])
    origins = folds.spaced(t, ["series"], "d", 28).withColumn("origin", F.lit(True))
    return t.join(origins, ["series", "d"], "left").withColumn("origin", F.coalesce("origin", F.lit(False)))


SETTINGS = models.Settings(features=("f1", "f2", "f3"))


def walk_forward(spark, sf_dir):
    """The prediction ledger of a three-feature ridge with nested penalty choice; no SQL form."""
    return models.walk_forward(_features(spark, sf_dir), ["series", "horizon"], "d", "origin", SETTINGS)


def gated_calls(spark, sf_dir):
    """The ledger with point-in-time skill, calls and reasons; no SQL form."""
    ledger = walk_forward(spark, sf_dir).select("series", "horizon", "d", "end", "actual", "predicted", "half_band", "probabilities").withColumn("price", F.lit(38500.0))
    skilled = models.past_skill(ledger, ["series", "horizon"], "d", "end", "actual", "predicted")
    return models.gated_call(skilled, "probabilities", "predicted", "half_band", "price", F.col("horizon")).drop("probabilities")


def live_forecasts(spark, sf_dir):
    """Forecasts at the last quote of each series from what had matured by then; no SQL form."""
    panel = daily(spark, sf_dir).select("series", "d", "price", "n")
    panel = panel.withColumns({"f1": S.calendar_change("price", 7), "f2": S.z("price", 20), "f3": F.col("n").cast("double")})
    t = _features(spark, sf_dir).drop("origin").filter("horizon = 30")
    rows = models.live_rows(panel, t, ["series"], "d")
    return models.walk_forward(rows, ["series"], "d", "origin", SETTINGS)


def live_decisions(spark, sf_dir):
    """The evidence gate on live forecasts, every fact of it computed from the ledgers of two models; no SQL form."""
    from lacuna.operators import resample
    from lacuna.session import table

    live = live_forecasts(spark, sf_dir).select("series", "d", "predicted", "half_band", "train_n", F.element_at("probabilities", 1).alias("p_down"), F.element_at("probabilities", -1).alias("p_up"))
    rows = _features(spark, sf_dir)
    gain = F.abs("actual") - F.abs(F.col("actual") - F.col("predicted"))
    ledger = models.walk_forward(rows, ["series", "horizon"], "d", "origin", SETTINGS).select("series", "d", "end", gain.alias("gain"))
    plain = models.walk_forward(rows, ["series", "horizon"], "d", "origin", models.Settings(features=("f1",))).select("series", "d", gain.alias("plain"))
    past = resample.numbered(ledger.join(plain, ["series", "d"]), ["series"], ["d"])
    p = resample.max_null(past, ["series"], ["gain", "plain"], 200, 4, 31).filter("candidate = 'gain'").select("series", "adjusted_p")
    interval = resample.block_interval(past, ["series"], "gain", 200, 4, 32).select("series", F.col("n").alias("past_n"), F.col("mean").alias("past_skill"), "ci_low")
    thirds = stats.thirds(past, ["series"], ["d"], "gain").groupBy("series").agg(F.min("mean").alias("worst_third"))
    chains = folds.phase_cohorts(past, ["series"], "d", "end").join(past.select("series", "d", "gain"), ["series", "d"])
    phases = chains.groupBy("series", "cohort").agg(F.avg("gain").alias("m")).groupBy("series").agg(F.min("m").alias("worst_phase"))
    apart = folds.greedy_count(past, ["series"], "d", "end", "nonoverlap_n")
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("day"))
    aged = models.with_staleness(live.select("series", "d"), seen, ["series"], "d", "day", 4).select("series", F.col("source_age").alias("age"))
    facts = live
    for part in (interval, p, thirds, phases, apart, aged):
        facts = facts.join(part, "series", "left")
    facts = facts.withColumns({"most_age": F.lit(4), "price": F.lit(38500.0)})
    return models.evidence_gate(facts, "price", "predicted", "half_band", F.lit(30)).select("series", "d", "predicted", "past_n", "nonoverlap_n", "past_skill", "ci_low", "worst_third", "worst_phase", "adjusted_p", "age", "decision", "reasons")


def live_staleness(spark, sf_dir):
    """For the last quote of each series, the latest error of a user seen strictly before it, and whether it is stale."""
    from lacuna.session import table

    live = daily(spark, sf_dir).groupBy("series").agg(F.max("d").alias("d"))
    seen = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey").groupBy("series", "day").agg(F.max("o_orderkey").alias("source"))
    out = models.with_staleness(live, seen, ["series"], "d", "day", 3, ["source"])
    return out.select("series", "d", "day", "source", "source_age", "source_stale")


def incremental_gain(spark, sf_dir):
    """What a second and third feature save on the same origins; no SQL form."""
    base = models.Settings(features=("f1",), alphas=(10.0,))
    added = models.Settings(features=("f1", "f2", "f3"), alphas=(10.0,))
    out = models.incremental(_features(spark, sf_dir), ["series", "horizon"], "d", "origin", base, added)
    return out.groupBy("series").agg(F.count("*").alias("n"), r6(F.avg("gain")).alias("gain"))


def factor_registry(spark, sf_dir):
    """Priorities as external factors with their settings, joined to what they cover."""
    from lacuna.session import table

    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    made = models.registry(spark, [models.Factor(n, "daily" if i % 2 else "weekly", "observed", i < 4, 10 + i, (4, 10)[i % 2], (15, 30)) for i, n in enumerate(names)])
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("factor")).agg(F.count("*").alias("rows"))
    return made.join(seen, "factor", "left").select("factor", "frequency", "causal", big("least_train").alias("least_train"), big("most_age").alias("most_age"), "rows")


def version_deltas(spark, sf_dir):
    """Skill of two penalties on the same origins."""
    t = targets(spark, sf_dir)
    one = lambda alpha, name: models.ridge_one(t, t, ["series"], "d", "end", "f", "ret", alpha, 80).filter("predicted IS NOT NULL").select("series", "d", "ret", F.abs(F.col("ret") - F.col("predicted")).alias(name))
    both = one(1.0, "a").join(one(100.0, "b").drop("ret"), ["series", "d"])
    return both.groupBy("series").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 8).alias("delta"))


GRID = (20, 40, 60), (0.75, 1.0, 1.25), (5, 10, 15, 30, 45, 60, 90)


def stress_grid(spark, sf_dir):
    """63 candidates of a past-z signal (look-back, threshold, horizon): called, entered and greedy rows, phases, halves, thirds and intervals; no SQL form."""
    from lacuna.operators.joins import forward_targets

    looks, cuts, horizons = GRID
    d = S.segments(daily(spark, sf_dir).select("series", "d", "price"), 6)
    s = S.within("segment")
    z = d.withColumns({f"z{n}": s.z("price", n, -(-3 * n // 4)) for n in looks})
    z = z.withColumns({f"in{n}_{i}": s.entries_of(F.col(f"z{n}") <= -x) for n in looks for i, x in enumerate(cuts)})
    t = forward_targets(z, S, "price", list(horizons))
    grid = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("look"), F.lit(x).alias("at"), F.col(f"z{n}").alias("z"), F.col(f"in{n}_{i}").alias("entered")) for n in looks for i, x in enumerate(cuts)]))
    spans = t.groupBy("series", "horizon").agg(F.min("d").alias("lo"), F.date_add(F.max("d"), 1).alias("hi"))
    on = t.withColumn("g", grid).select("series", "horizon", "d", "end", "ret", "g.*").filter(F.col("z") <= -F.col("at"))
    return models.stress(on, ["series", "horizon", "look", "at"], "d", "end", "ret", "entered", spans, ["series", "horizon"]).withColumn("horizon", big("horizon"))


def greedy_null(spark, sf_dir):
    """Three thresholds of one signal: t of greedily chosen returns against the largest t under circular shifts, chosen anew each time."""
    from lacuna.operators import resample

    t = resample.numbered(targets(spark, sf_dir).filter("f IS NOT NULL"), ["series"], ["d"])
    t = t.withColumns({f"under_{i}": F.col("f") < x for i, x in enumerate((-0.2, -0.3, -0.4))})
    out = resample.greedy_shift_null(t, ["series"], "d", "end", "ret", ["under_0", "under_1", "under_2"], 12, 99)
    return out.select("series", "candidate", "n_greedy", *[r6(c).alias(c) for c in ("mean", "t", "adjusted_p", "null_95", "family_p")])


W = "PARTITION BY series ORDER BY d"
RIDGE = """SELECT o.series, o.d, any_value(o.ret) AS ret, count(*) AS train_n, avg(t.ret) + covar_pop(t.f, t.ret) * count(*) / (var_pop(t.f) * count(*) + {a}) * (any_value(o.f) - avg(t.f)) AS predicted, avg(t.ret) AS baseline
 FROM targets o JOIN targets t ON t.series = o.series AND t."end" < o.d WHERE t.f IS NOT NULL AND o.f IS NOT NULL GROUP BY o.series, o.d HAVING count(*) >= 80"""
#: From real (series, candidate, {stat}) and nul (series, rep, stat): what the largest null says.
JUDGED = """tops AS (SELECT series, rep, max(stat) AS top FROM nul GROUP BY ALL), nf AS (SELECT series, avg(top) AS null_mean, quantile_cont(top, 0.95) AS null_95, count(*) AS replicates FROM tops GROUP BY series),
jb AS (SELECT series, max({stat}) AS best FROM real GROUP BY series), jf AS (SELECT jb.series, (1 + (SELECT count(*) FROM tops WHERE tops.series = jb.series AND top >= best - 1e-9)) / (1 + replicates) AS family_p FROM jb JOIN nf USING (series)),
judged AS (SELECT real.*, null_mean, null_95, family_p, CASE WHEN {stat} IS NOT NULL THEN (1 + (SELECT count(*) FROM tops WHERE tops.series = real.series AND top >= {stat} - 1e-9)) / (1 + replicates) END AS adjusted_p FROM real LEFT JOIN nf USING (series) LEFT JOIN jf USING (series))"""
RULE_NULL = _greedy(TARGETS + f""", t AS (SELECT series, d, "end", ret, f, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM targets WHERE f IS NOT NULL),
called_ AS (SELECT series, d, "end", ret, i, n, 'fade' AS candidate, -sign(f) AS s FROM t WHERE abs(f) > 0.2 UNION ALL SELECT series, d, "end", ret, i, n, 'follow', sign(f) FROM t WHERE abs(f) > 0.4)""", "called_", "series", "candidate") + f""",
eff AS (SELECT series, candidate, count(*) AS n_effective FROM walk GROUP BY ALL), sds AS (SELECT series, stddev_samp(ret) AS sd FROM t GROUP BY series),
real AS (SELECT series, candidate, called, mean, n_effective, CASE WHEN n_effective >= 3 THEN mean * sqrt(n_effective) / nullif(sd, 0) END AS edge FROM (SELECT series, candidate, count(*) AS called, avg(s * ret) AS mean FROM called_ GROUP BY ALL) JOIN sds USING (series) JOIN eff USING (series, candidate)),
dr AS (SELECT series, n, rep, CASE WHEN n > 2 * m THEN m ELSE 1 END AS low FROM (SELECT DISTINCT series, n, least(70, greatest(10, n // 5)) AS m FROM t), (SELECT unnest(range(0, 40)) AS rep)),
sh AS (SELECT *, low + (('0x' || substr(md5('20260812:' || rep || ':' || series), 1, 8))::BIGINT) % greatest(1, n - 2 * low) AS shift FROM dr),
nul AS (SELECT series, rep, mean * sqrt(n_effective) / nullif(sd, 0) AS stat FROM (SELECT c.series, sh.rep, c.candidate, count(*) AS k, avg(c.s * r.ret) AS mean, stddev_samp(r.ret) AS sd FROM called_ c JOIN sh ON sh.series = c.series JOIN t r ON r.series = c.series AND r.i = (c.i + sh.shift) % c.n GROUP BY ALL) JOIN eff USING (series, candidate) WHERE k >= 5 AND n_effective >= 3 AND sd > 0),
""" + JUDGED.format(stat="edge")
PLANS: dict[str, Plan] = {
    "ridge_one_feature": (ridge_one, f"WITH {TARGETS}, r AS ({RIDGE.format(a=10)}) SELECT series, d, train_n, round(predicted, 6) + 0.0 AS predicted, round(baseline, 6) + 0.0 AS baseline FROM r"),
    "walkforward_one_feature": (ridge_scorecard, f"WITH {TARGETS}, r AS ({RIDGE.format(a=10)}) SELECT series, count(*) AS n, round(avg(abs(ret - predicted)), 6) AS mae, round(avg(abs(ret - baseline)), 6) AS baseline_mae, round(avg(abs(ret - baseline) - abs(ret - predicted)), 6) + 0.0 AS skill, round(avg((sign(ret) = sign(predicted))::INT), 6) AS direction_hit FROM r GROUP BY series"),
    "class_frequencies": (class_frequencies, f"""WITH {TARGETS}, c AS (SELECT o.series, o.d, count(t.d) AS n, count(CASE WHEN t.direction = -1 THEN 1 END) AS a, count(CASE WHEN t.direction = 0 THEN 1 END) AS b, count(CASE WHEN t.direction = 1 THEN 1 END) AS c FROM targets o LEFT JOIN targets t ON t.series = o.series AND t."end" < o.d GROUP BY ALL)
SELECT series, d, round((a + 1) / (n + 3), 6) AS f_0, round((b + 1) / (n + 3), 6) AS f_1, round((c + 1) / (n + 3), 6) AS f_2 FROM c"""),
    "past_skill": (past_skill, f"""WITH {TARGETS}, t AS (SELECT series, d, "end", abs(ret) - abs(ret + f * 0.1) AS g FROM targets WHERE f IS NOT NULL), m AS (SELECT o.series, o.d, count(t.d) AS n, avg(t.g) AS g FROM t o LEFT JOIN t ON t.series = o.series AND t."end" < o.d GROUP BY ALL),
a AS (SELECT series, d, count(*) OVER w AS n, avg(g) OVER w AS g FROM t WINDOW w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT m.series, m.d, m.n AS n_matured, round(m.g, 6) + 0.0 AS skill_matured, a.n AS n_all, round(a.g, 6) + 0.0 AS skill_all FROM m JOIN a ON m.series = a.series AND m.d = a.d"""),
    "family_selection": (family_selection, f"""WITH {TARGETS}, t AS (SELECT series, year(d) AS family, avg(ret) AS a, stddev_samp(ret) AS b, max(ret) AS c FROM targets GROUP BY ALL), k AS (SELECT *, a > 0 AS ok, a + b / 2 + c / 4 AS score FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ok DESC, score DESC) AS k FROM k) SELECT series, family::BIGINT AS family, ok, round(score, 6) AS score FROM o WHERE k = 1"""),
    "analog_bands": (analog_bands, f"WITH {TARGETS} SELECT series, count(*) AS n, round(38500 * exp(quantile_cont(ret, 0.1)), 6) AS band_low, round(38500 * exp(quantile_cont(ret, 0.9)), 6) AS band_high, count(*) >= 9 AS defensible FROM targets WHERE f < -0.3 GROUP BY series"),
    "rule_shift_null": (rule_shift_null, f"""WITH {RULE_NULL} SELECT series, candidate, called, n_effective, round(mean, 6) + 0.0 AS mean, round(edge, 6) + 0.0 AS edge, round(adjusted_p, 6) AS adjusted_p, round(null_mean, 6) + 0.0 AS null_mean, round(null_95, 6) + 0.0 AS null_95, round(family_p, 6) AS family_p FROM judged"""),
    "rule_gates": (rule_gates, f"""WITH {RULE_NULL}, st AS (SELECT series, candidate, d, s * ret AS v FROM called_), ph AS (SELECT series, candidate, (date_diff('day', DATE '2000-01-01', d) % 30 + 30) % 30 AS phase, avg(v) AS m FROM st GROUP BY ALL), w AS (SELECT series, candidate, min(m) AS worst FROM ph GROUP BY ALL),
a AS (SELECT series, candidate, avg(v) - 2 * stddev_samp(v) / sqrt(count(*)) AS lo, avg((v > 0)::INT) AS hit FROM st GROUP BY ALL)
SELECT series, candidate, n_effective AS nonoverlap_n, round(lo, 6) + 0.0 AS ci_low, round(worst, 6) + 0.0 AS worst_phase, round(adjusted_p, 6) AS adjusted_p, round(hit, 6) AS economic_hit_rate, n_effective >= 20 AND lo > 0 AND worst >= 0 AND adjusted_p <= 0.05 AND hit > 0.5 AS passes FROM a JOIN w USING (series, candidate) JOIN judged USING (series, candidate)"""),
    "model_shift_null": (model_shift_null, f"""WITH {TARGETS}, t AS (SELECT series, ret, f, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM targets WHERE f IS NOT NULL), k AS (SELECT * FROM (VALUES ('a', -0.1), ('b', 0.05), ('c', -0.6)) v(candidate, w)),
led AS (SELECT series, candidate, i, n, ret, f * w::DOUBLE AS p FROM t, k), real AS (SELECT series, candidate, count(*) AS n, avg(abs(ret - 0.01::DOUBLE) - abs(ret - p)) AS skill FROM led GROUP BY ALL),
dr AS (SELECT series, candidate, n, rep, CASE WHEN n > 2 * m THEN m ELSE 1 END AS low FROM (SELECT *, greatest(2, n // 10) AS m FROM real WHERE n >= 10), (SELECT unnest(range(0, 30)) AS rep)),
sh AS (SELECT *, low + (('0x' || substr(md5('77:' || rep || ':' || series || ':' || candidate), 1, 8))::BIGINT) % greatest(1, n - 2 * low) AS shift FROM dr),
nul AS (SELECT sh.series, sh.candidate, rep, avg(abs(l.ret - 0.01::DOUBLE) - abs(l.ret - o.p)) AS stat FROM sh JOIN led l ON l.series = sh.series AND l.candidate = sh.candidate JOIN led o ON o.series = sh.series AND o.candidate = sh.candidate AND o.i = (l.i - shift % l.n + l.n) % l.n GROUP BY ALL),
{JUDGED.format(stat="skill")}
SELECT series, candidate, n, round(skill, 6) + 0.0 AS skill, round(adjusted_p, 6) AS adjusted_p, round(null_mean, 6) + 0.0 AS null_mean, round(null_95, 6) + 0.0 AS null_95, round(family_p, 6) AS family_p, round(skill - null_95, 6) + 0.0 AS deflated FROM judged"""),
    "greedy_null": (greedy_null, f"""WITH {_greedy(TARGETS + f""", t AS (SELECT series, d, "end", ret, f, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM targets WHERE f IS NOT NULL), k AS (SELECT * FROM (VALUES ('under_0', -0.2), ('under_1', -0.3), ('under_2', -0.4)) v(candidate, cut)),
dr AS (SELECT series, n, rep, CASE WHEN n > 182 THEN 91 ELSE 1 END AS low FROM (SELECT DISTINCT series, n FROM t), (SELECT unnest(range(0, 12)) AS rep)),
sh AS (SELECT series, rep, low + (('0x' || substr(md5('99:' || rep || ':' || series), 1, 8))::BIGINT) % greatest(1, n - 2 * low) AS shift FROM dr UNION ALL SELECT DISTINCT series, -1, 0 FROM t),
c AS (SELECT s.series, sh.rep, k.candidate, r.d, r."end", r.ret FROM t s JOIN k ON s.f < k.cut::DOUBLE JOIN sh ON sh.series = s.series JOIN t r ON r.series = s.series AND r.i = (s.i + sh.shift) % s.n)""", "c", "series", "rep", "candidate")},
x AS (SELECT walk.series, walk.rep, walk.candidate, count(*) AS n_greedy, avg(c.ret) AS mean, CASE WHEN count(*) >= 5 AND stddev_samp(c.ret) > 0 THEN avg(c.ret) / (stddev_samp(c.ret) / sqrt(count(*))) END AS t FROM walk JOIN c ON c.series = walk.series AND c.rep = walk.rep AND c.candidate = walk.candidate AND c.d = walk.d GROUP BY ALL),
real AS (SELECT series, candidate, n_greedy, mean, t AS t_ FROM x WHERE rep = -1), nul AS (SELECT series, rep, t AS stat FROM x WHERE rep >= 0 AND t IS NOT NULL),
{JUDGED.format(stat="t_")}
SELECT series, candidate, n_greedy, round(mean, 6) + 0.0 AS mean, round(t_, 6) + 0.0 AS t, round(adjusted_p, 6) AS adjusted_p, round(null_95, 6) + 0.0 AS null_95, round(family_p, 6) AS family_p FROM judged"""),
    "live_staleness": (live_staleness, f"""WITH {DAILY}, l AS (SELECT series, max(d) AS d FROM daily GROUP BY 1), s AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS day, max(o_orderkey) AS source FROM orders WHERE o_totalprice > 300000 GROUP BY ALL)
SELECT l.series, l.d, s.day, s.source, date_diff('day', s.day, l.d)::INT AS source_age, date_diff('day', s.day, l.d) > 3 AS source_stale FROM l ASOF LEFT JOIN s ON l.series = s.series AND s.day < l.d"""),
    "version_deltas": (version_deltas, f"WITH {TARGETS}, a AS ({RIDGE.format(a=1)}), b AS ({RIDGE.format(a=100)}) SELECT a.series, count(*) AS n, round(avg(abs(b.ret - b.predicted) - abs(a.ret - a.predicted)), 8) + 0.0 AS delta FROM a JOIN b ON a.series = b.series AND a.d = b.d GROUP BY a.series"),
    "factor_registry": (factor_registry, """WITH f AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS factor, unnest(range(0, 5)) AS i), o AS (SELECT o_orderpriority AS factor, count(*) AS rows FROM orders GROUP BY 1)
SELECT f.factor, CASE WHEN i % 2 = 1 THEN 'daily' ELSE 'weekly' END AS frequency, i < 4 AS causal, 10 + i AS least_train, CASE WHEN i % 2 = 0 THEN 4 ELSE 10 END::BIGINT AS most_age, rows FROM f LEFT JOIN o ON f.factor = o.factor"""),
    "live_forecasts": (live_forecasts, None),
    "live_decisions": (live_decisions, None),
    "incremental_gain": (incremental_gain, None),
    "walk_forward": (walk_forward, None),
    "gated_calls": (gated_calls, None),
    "stress_grid": (stress_grid, None),
}
