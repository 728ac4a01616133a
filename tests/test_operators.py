"""Edge cases and invariants of the operators."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.functions import casts, labels
from lacuna.operators import folds, joins, models, resample, stats
from lacuna.operators.series import Series, ewma_volatility
from lacuna.sources import readers, writers

S = Series(("k",), "d")
DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def series(spark, points, key="a"):
    return spark.createDataFrame([(key, day(n), None if x is None else float(x)) for n, x in points], "k string, d date, x double")


def test_strict_asof_ignores_equal_times_and_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 20.0), ("a", 5, 30.0)], "k string, rt long, v double")
    got = {(r.k, r.t): r.v for r in joins.asof(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 20.0, ("b", 5): None}
    loose = {(r.k, r.t): r.v for r in joins.asof(left, right, ["k"], "t", "rt", ["v"], strict=False).collect()}
    assert loose == {("a", 1): 10.0, ("a", 5): 30.0, ("b", 5): None}


def test_bucketed_asof_equals_plain(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice("ab"), rng.randrange(300)) for _ in range(200)], "k string, t long")
    right = spark.createDataFrame([(k, t, float(i)) for i, (k, t) in enumerate({(rng.choice("ab"), rng.randrange(300)) for _ in range(60)})], "k string, rt long, v double")
    plain = joins.asof(left, right, ["k"], "t", "rt", ["v"])
    split = joins.asof(left, right, ["k"], "t", "rt", ["v"], bucket=F.floor(F.col("__t") / 7))
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.collect()))


def test_forward_target_limits(spark):
    df = series(spark, [(0, 1.0), (5, 2.0), (14, 4.0), (20, 3.0)])
    got = {(r.d, r.horizon): (r.end, r.direction) for r in joins.forward_targets(df, S, "x", [5, 10], 4).collect()}
    assert got[DAY, 5] == (day(5), 1)
    assert got[DAY, 10] == (day(14), 1)  # 10 + 4 days on
    assert got[day(5), 5] == (day(14), 1)  # 9 days on, the last that 5 + 4 allows
    assert (day(5), 10) not in got  # 15 days on is a day too late
    crossing = joins.forward_targets(df, S, "x", [5], 4, gap=8, crossing="segment").collect()
    assert {(r.d, r.end) for r in crossing} == {(DAY, day(5)), (day(14), day(20))}


def test_null_price_at_the_end_gives_no_target(spark):
    df = series(spark, [(0, 1.0), (5, None), (6, 2.0)])
    assert joins.forward_targets(df, S, "x", [5], 4).count() == 0


def test_gap_of_exactly_the_limit_keeps_the_segment(spark):
    got = [r.segment for r in S.segments(series(spark, [(0, 1.0), (14, 1.0), (29, 1.0)]), 14).orderBy("d").collect()]
    assert got == [0, 0, 1]


def test_rolling_z_matches_pandas_and_stays_null_at_sd_0(spark):
    x = pd.Series(np.random.default_rng(0).normal(size=60))
    got = [r.z for r in series(spark, list(enumerate(x))).withColumn("z", S.z("x", 20)).orderBy("d").collect()]
    past = x.shift(1).rolling(20)
    want = (x - past.mean()) / past.std()
    assert got[:20] == [None] * 20 and np.allclose(got[20:], want[20:])
    flat = series(spark, [(i, 1.0) for i in range(30)]).withColumn("z", S.z("x", 20))
    assert flat.filter("z IS NOT NULL").count() == 0


def test_fill_reaches_one_missing_value_only(spark):
    got = [r.f for r in series(spark, [(0, 1.0), (1, None), (2, None), (3, 2.0)]).withColumn("f", S.filled_once("x")).orderBy("d").collect()]
    assert got == [1.0, 1.0, None, 2.0]


def test_ewma_against_a_loop(spark):
    r = [None, 0.1, -0.2, None, 0.3, 0.05]
    got = [x.v for x in ewma_volatility(series(spark, list(enumerate(r))), S, "x", "v").orderBy("d").collect()]
    v, want = None, []
    for before in [None, *r[:-1]]:
        if before is not None:
            v = before**2 if v is None else 0.94 * v + 0.06 * before**2
        want.append(None if before is None else math.sqrt(v))
    assert got == pytest.approx(want)


def test_greedy_never_overlaps_and_skips_nothing(spark):
    rng = random.Random(3)
    spans = sorted({(rng.randrange(300), rng.randrange(5, 30)) for _ in range(150)})
    spans = list({s: (s, n) for s, n in spans}.values())
    df = spark.createDataFrame([("a", day(s), day(s + n)) for s, n in spans], "k string, d date, e date")
    got = sorted((r.d, r.e) for r in folds.greedy(df, ["k"], "d", "e").collect())
    want, last = [], None
    for s, n in sorted(spans):
        if last is None or s >= last:
            want.append((day(s), day(s + n)))
            last = s + n
    assert got == want
    assert folds.greedy_count(df, ["k"], "d", "e").first().n_effective == len(want)


def test_matured_is_strict(spark):
    t = spark.createDataFrame([("a", DAY, day(5), 1.0), ("a", day(5), day(9), 2.0), ("a", day(6), day(9), 4.0)], "k string, d date, e date, y double")
    got = {r.d: r.sum_0 for r in joins.matured(t.select("k", "d"), t, ["k"], "d", "e", [F.col("y")]).collect()}
    assert got == {DAY: 0.0, day(5): 0.0, day(6): 1.0}


def test_ridge_sums_match_normal_equations(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=60), rng.normal(size=60)
    t = spark.createDataFrame([("a", day(i), day(i + 3), float(x[i]), float(y[i])) for i in range(60)], "k string, d date, e date, x double, y double")
    got = models.ridge_one(t, t, ["k"], "d", "e", "x", "y", 10.0, 20).orderBy(F.desc("d")).first()
    a = np.column_stack([np.ones(56), x[:56]])
    slope = models.ridge(a - [0, x[:56].mean()], y[:56], 10.0)[1]
    assert got.train_n == 56 and got.predicted == pytest.approx(y[:56].mean() + slope * (x[59] - x[:56].mean()))


def test_walk_forward_never_trains_on_what_ends_later(spark):
    rng = np.random.default_rng(6)
    n = 260
    f, noise = rng.normal(size=n), rng.normal(size=n) * 0.1
    rows = [("a", day(i), day(i + 5), float(f[i] * 0.5 + noise[i]), int(np.sign(f[i])), i % 40 == 0, float(f[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, d date, end date, ret double, direction int, origin boolean, f double")
    out = models.walk_forward(df, ["k"], "d", "origin", models.Settings(features=("f",), least_inner=40)).orderBy("d").collect()
    assert [r.train_n for r in out] == [i - 5 for i in range(0, n, 40) if i - 5 >= 80]
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in out)
    assert np.corrcoef([r.actual for r in out], [r.predicted for r in out])[0, 1] > 0.9


def test_block_means_match_explicit_draws(spark):
    n, b, reps = 23, 5, 7
    x = np.random.default_rng(8).normal(size=n)
    rows = resample.numbered(series(spark, list(enumerate(x))), ["k"], ["d"])
    got = {r.rep: r.x for r in resample.block_means(rows, ["k"], ["x"], reps, b, 99).collect()}
    import hashlib

    for rep in range(reps):
        at = []
        for k in range(math.ceil(n / b)):
            start = int(hashlib.md5(f"99:{rep}:{k}".encode()).hexdigest()[:8], 16) % n
            at += [(start + j) % n for j in range(b)]
        assert got[rep] == pytest.approx(x[at[:n]].mean())


def test_holm_and_binomial(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = {r.p: r.holm_p for r in resample.holm(df, [], "p").collect()}
    assert got == {0.01: pytest.approx(0.03), 0.03: pytest.approx(0.06), 0.04: pytest.approx(0.06), None: None}
    tail = spark.createDataFrame([(10, 8), (10, 0), (0, 0), (5, 6)], "n long, h long").select(resample.binomial_tail(F.col("n"), F.col("h")).alias("p")).collect()
    assert [r.p for r in tail] == [pytest.approx(56 / 1024), 1.0, 1.0, 0.0]


def test_block_length_rounds_half_to_even(spark):
    df = spark.createDataFrame([(25.0, 10.0, 100), (35.0, 10.0, 100), (90.0, 1.0, 60), (5.0, 5.0, 4)], "h double, s double, n int")
    assert [r.b for r in df.select(resample.block_length(F.col("h"), F.col("s"), F.col("n")).alias("b")).collect()] == [3, 4, 20, 3]


def test_empty_class_is_left_out_of_means(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", -1, 1)], "k string, y int, p int")
    got = stats.confusion_scores(df.groupBy("k").agg(*stats.confusion("y", "p"))).first()
    assert got.accuracy == pytest.approx(2 / 3) and got.balanced_accuracy == pytest.approx(0.5) and got.recall_0 is None and got.mcc is None


def test_ties_in_the_largest_class_go_to_the_first(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    assert df.select(labels.first_best(F.col("p")).alias("k")).first().k == 1


def test_casts(spark):
    df = spark.createDataFrame([("1,234.5%", "12.5K", "16-Apr-2026", "45000", "IS7U26"), ("x", None, "nope", "3/4/2025", "ZZ")], "a string, b string, c string, d string, e string")
    r = df.select(casts.number(F.col("a")).alias("a"), casts.magnitude(F.col("b")).alias("b"), casts.day_first(F.col("c")).alias("c"), casts.any_date(F.col("d")).alias("d"), casts.contract(F.col("e"), "IS7").alias("e")).collect()
    assert (r[0].a, r[0].b, r[0].c, r[0].d) == (1234.5, 12500.0, dt.date(2026, 4, 16), dt.date(2023, 3, 15))
    assert tuple(r[0].e) == (9, 2026, 2026 * 12 + 8)
    assert (r[1].a, r[1].b, r[1].c, r[1].d) == (None, None, None, dt.date(2025, 3, 4)) and tuple(r[1].e) == (None, None, None)


def test_ages_keep_or_null_columns(spark):
    df = spark.createDataFrame([(4, 1.0), (5, 2.0), (None, 3.0)], "age int, x double")
    assert [r.x for r in joins.stale_to_null(df, F.col("age"), 4, ["x"]).collect()] == [1.0, None, 3.0]


def test_repeated_keys_fail(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(PySparkException):
        joins.unique_on(df, ["k"]).collect()


def test_sections_and_writers(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('﻿Title,,\nSTATUS: ok,\n,\nFIRST BLOCK,\nMonth,Value\n2024-01,"1,000"\n2024-02,2\nend of block,\n2024-03,9\nSECOND BLOCK,\nMonth,Value\n2024-05,5\n')
    rows = readers.cells(readers.numbered_lines(spark, str(tmp_path / "sheet.csv")))
    got = readers.section_months(rows, "FIRST BLOCK").orderBy("i").collect()
    assert [(r.period, r.value) for r in got] == [("2024-01", "1,000"), ("2024-02", "2")]
    assert readers.anchored(rows, "Month").count() == 7
    named = readers.sections(rows, {"FIRST": "one", "SECOND": "two"}).filter("section = 'two'")
    assert named.count() == 3
    writers.to_csv(spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "g string, n int, t string"), str(tmp_path / "out"), ["g"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    writers.to_json(spark, str(tmp_path / "meta"), config=F.struct(F.lit(3).alias("reps")), seed=F.lit(7))
    assert readers.document(spark, str(tmp_path / "meta")).first().config.reps == 3
    import hashlib

    data = (tmp_path / "sheet.csv").read_bytes()
    assert writers.content_hashes(spark, str(tmp_path / "sheet.csv")).first().sha256 == hashlib.sha256(data).hexdigest()


def test_hidden_fields_tables_and_charts(spark):
    page = """<input type="hidden" name="a" value="1"/><input name="b" type='hidden' value="x&amp;y"><table><tbody><tr><td>R&amp;D</td><td> <b>5</b> </td></tr><tr><td>z</td></tr></tbody></table><script>labels:['J','F'],data:[1.5,2]</script>"""
    df = spark.createDataFrame([(1, page)], "id int, html string")
    assert df.select(readers.hidden_fields(F.col("html")).alias("m")).first().m == {"a": "1", "b": "x&amp;y"}
    assert [(r.ordinal, r.cells) for r in readers.table_rows(df, "html").orderBy("ordinal").collect()] == [(1, ["R&D", "5"]), (2, ["z"])]
    points = df.select(readers.chart_points(F.col("html"), r"labels:\[([^\]]*)\]", r"data:\[([^\]]*)\]", 2).alias("p")).first().p
    assert [tuple(p) for p in points] == [("J", 1.5), ("F", 2.0)]


def test_streams(spark):
    from lacuna.streaming import events

    stream = events.stream(spark, "/root/testdata/sf0.001", "events")
    events.drained(events.tumbling(stream), "t_tumbling", "append").stop()
    counted = spark.sql("SELECT sum(n) AS n FROM t_tumbling").first().n
    assert 0 < counted <= 1000
    events.drained(events.sessions(stream), "t_sessions", "append").stop()
    assert spark.sql("SELECT count(*) AS n FROM t_sessions").first().n > 0
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    bought, failed = batch.filter("event_type = 'purchase'"), batch.filter("event_type = 'error'")
    assert events.available(bought, failed, "user_id", "2 days").filter("released >= ts").count() == 0


def test_circular_p_takes_every_shift(spark):
    rng = np.random.default_rng(5)
    x, n = rng.normal(size=70), 70
    y = x * 0.2 + rng.normal(size=70)
    rows = spark.createDataFrame([("a", i, n, float(x[i]), float(y[i])) for i in range(n)] + [("b", 0, 1, 1.0, 2.0)], "k string, i long, n long, x double, y double")
    r = np.corrcoef(x, y)[0, 1]
    want = (1 + sum(abs(np.corrcoef(x, np.roll(y, -s))[0, 1]) >= abs(r) for s in range(1, n))) / n
    assert resample.shifted(rows, ["k"], "x", "y").count() == n - 1
    got = {a.k: a for a in resample.shift_p(rows, ["k"], "x", "y").collect()}
    assert got["a"].r == pytest.approx(r) and got["a"].p == pytest.approx(want) and got["b"].p == 1


def test_block_lengths_rounded_up_with_another_least(spark):
    row = spark.createDataFrame([(30, 7.0, 100), (5, 7.0, 100), (90, 7.0, 12)], "h int, s double, n long")
    even, up = resample.block_length(F.col("h"), F.col("s"), F.col("n")), resample.block_length(F.col("h"), F.col("s"), F.col("n"), 2, True)
    assert [tuple(r) for r in row.select(even, up).collect()] == [(4, 5), (3, 2), (4, 4)]


def test_max_null_variants(spark):
    """Own draws for each candidate give other replicates; an i.i.d. se is sd over the root of n."""
    rows = resample.numbered(spark.createDataFrame([("a", i, math.sin(i) + 0.3, math.cos(3 * i)) for i in range(40)], "g string, t int, x double, y double"), ["g"], ["t"])
    kinds = {(j, i): {r.candidate: r for r in resample.max_null(rows, ["g"], ["x", "y"], 60, 4, 3, joint=j, iid=i).collect()} for j in (True, False) for i in (True, False)}
    x = np.array([math.sin(i) + 0.3 for i in range(40)])
    assert kinds[True, True]["x"].se == pytest.approx(x.std(ddof=1) / math.sqrt(40)) and kinds[True, False]["x"].se != pytest.approx(kinds[True, True]["x"].se)
    assert kinds[True, False]["x"].raw_p == kinds[False, False]["x"].raw_p and kinds[True, False]["y"].se != kinds[False, False]["y"].se
    for each in kinds.values():
        for r in each.values():
            assert r.raw_p <= r.adjusted_p <= 1 and r.t == pytest.approx(r.mean / r.se)


def test_settings_of_other_studies():
    """Bounds from known values alone; one split without a purge."""
    x = np.array([[0.0], [1.0], [2.0], [100.0], [np.nan], [np.nan], [np.nan], [np.nan]])
    first, known = (models.prepare(x, models.Settings(features=("a",), winsor=(0.0, 0.75), impute_first=i)) for i in (True, False))
    assert first[2][0] == 1.625 and known[2][0] == 26.5
    rng = np.random.default_rng(0)
    x, t = rng.normal(size=(200, 1)), np.arange(200)
    y = x[:, 0] * 2 + rng.normal(size=200) * 0.1
    purged = models.Settings(features=("a",), folds=(0.8, 1.0), alphas=(0.1, 1000.0))
    plain = models.Settings(features=("a",), folds=(0.8, 1.0), alphas=(0.1, 1000.0), purged=False)
    late = t + 150  # targets end so late that nothing is left to train on once purged
    assert models.choose_alpha(x, y, t, late, plain) == 0.1 and models.choose_alpha(x, y, t, late, purged) == 1000.0


def test_asof_ties_have_an_order(spark):
    left = spark.createDataFrame([("a", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 4, x) for x in (1.0, 9.0, 3.0)], "k string, rt long, v double")
    for rows in (right, right.orderBy(F.desc("v"))):
        assert joins.asof(left, rows, ["k"], "t", "rt", ["v"]).first().v == joins.asof(left, rows, ["k"], "t", "rt", ["v"], bucket=F.col("__t")).first().v == 9.0
