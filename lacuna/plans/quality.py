"""Data-quality audits, parsing of text columns and extraction from markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import casts
from lacuna.functions.labels import clip, hinge, interaction, nearly, reasons, vessel
from lacuna.operators import audits
from lacuna.operators.selection import first_use, grid, quality_tier, usable_quote
from lacuna.plans.base import DAILY, HOLED, S, Plan, big, daily, holed, r6
from lacuna.session import table
from lacuna.sources import readers


def bar_audit(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("high", F.when(F.col("n") % 3 == 0, F.col("close")).otherwise(F.col("high")))
    return d.groupBy("series").agg(F.count("*").alias("rows"), audits.bar_faults().alias("bar_faults"), audits.off_tick("close", 2).alias("off_tick"))


def change_audit(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("change", F.col("close") - F.col("open")).withColumn("percent", F.col("change") / F.col("open") * 100)
    return audits.change_faults(d, S, "close", "change", "percent")


def completeness(spark, sf_dir):
    return audits.completeness(holed(spark, sf_dir), S, ["price", "x"])


def frequency(spark, sf_dir):
    out = audits.frequency_name(daily(spark, sf_dir).filter("n >= 4"), S)
    return out.select("series", r6("median_gap").alias("median_gap"), "frequency")


def alignment_age(spark, sf_dir):
    from lacuna.operators.joins import asof

    d = daily(spark, sf_dir)
    left, right = d.select("series", "d"), d.filter("n >= 3").select("series", F.col("d").alias("rd"), F.col("price").alias("p"))
    out = asof(left, right, ["series"], "d", "rd", ["p"]).withColumn("age", F.datediff("d", "rd"))
    return audits.alignment(out, ["series"], "age").select("series", "rows", "matched", big("least_age").alias("least_age"), r6("median_age").alias("median_age"), r6("p95_age").alias("p95_age"), big("largest_age").alias("largest_age"))


def age_counts(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("gap", S.gap_days())
    return d.groupBy("series", big("gap").alias("gap")).agg(F.count("*").alias("rows"))


def sheet_errors(spark, sf_dir):
    cell = F.when(F.col("n_nationkey") % 4 == 0, "#REF!").when(F.col("n_nationkey") % 7 == 0, " #N/A").otherwise(F.col("n_name"))
    out = audits.sheet_errors(table(spark, sf_dir, "nation").select(cell.alias("a"), F.col("n_name").alias("b")), ["a", "b"])
    return out.select("column", "cell", F.col("count").alias("cells"))


def lenient_casts_all(spark, sf_dir):
    """Numbers, magnitudes, dates, slugs and kinds from text with faults."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, "n/a").when(k % 3 == 0, F.concat(F.format_number("o_totalprice", 2), F.lit("%"))).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    size = F.concat((k % 90 + 1).cast("string"), F.element_at(F.array(*map(F.lit, ("", "K", "M", "B"))), (k % 4 + 1).cast("int")))
    day = F.col("o_orderdate").cast("date")
    date = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "M/d/yyyy")).when(k % 4 == 2, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")).otherwise("soon")
    return o.select(k.alias("k"), casts.number(raw).alias("number"), casts.magnitude(size).alias("magnitude"), casts.any_date(date).alias("date"), casts.slug(F.col("o_orderpriority")).alias("slug"), casts.kind(raw).alias("kind"))


def lenient_casts(spark, sf_dir):
    """The first keys only, as in the SQL."""
    return lenient_casts_all(spark, sf_dir).filter("k < 4000")


def contract_codes_all(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("IS7"), F.substring(F.lit("FGHJKMNQUVXZABC"), (F.col("p_partkey") % 15 + 1).cast("int"), F.lit(1)), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")).alias("symbol"))
    c = casts.contract(F.col("symbol"), "IS7")
    return p.select("p_partkey", "symbol", big(c["month"]).alias("month"), big(c["year"]).alias("year"), big(c["serial"]).alias("serial"))


def contract_codes(spark, sf_dir):
    """The first keys only, as in the SQL."""
    return contract_codes_all(spark, sf_dir).filter("p_partkey <= 500")


def keyword_classes(spark, sf_dir):
    kind, share = vessel(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_type"), F.lit(" bulk carrier"))).when(F.col("p_partkey") % 5 == 0, F.lit("Lng Tanker")).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").groupBy(kind.alias("kind"), share.alias("share")).agg(F.count("*").alias("parts"))


def basis_terms(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("z", S.z("price", 20)).withColumn("y", S.z("n", 20)).filter("z IS NOT NULL")
    up, down = hinge(F.col("z"))
    return d.select("series", "d", r6(up).alias("up"), r6(down).alias("down"), r6(interaction(F.col("z"), F.col("y"))).alias("cross"), r6(clip(F.col("z"), -2.0, 2.0)).alias("clipped"))


def reason_texts(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("gap", S.gap_days())
    why = reasons([(F.col("n") < 2, "thin"), (F.col("gap") > 3, "stale"), (F.col("price") < 100000, "low"), (F.col("n") == 1, "thin")])
    return d.withColumn("why", why).groupBy("series", "why").agg(F.count("*").alias("rows"), F.sum(nearly(F.col("high"), F.col("low")).cast("long")).alias("flat"))


def page_links(spark, sf_dir):
    """Link targets of pages, in order."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("place", "href")).select("page_id", big("place").alias("place"), "href")


def page_cells(spark, sf_dir):
    """List items of pages as cells, tags out and references decoded."""
    p = table(spark, sf_dir, "pages")
    items = F.regexp_extract_all(F.col("html"), F.lit("<li>(.*?)</li>"), 1)
    return p.select("page_id", F.size(items).cast("long").alias("items"), F.array_join(F.transform(items, readers.without_tags), "|").alias("texts"))


def event_props_all(spark, sf_dir):
    """Keys and values of the JSON column, through a map."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(m).alias("key", "value"))


def event_props(spark, sf_dir):
    """The first ids only, as in the SQL."""
    return event_props_all(spark, sf_dir).filter("event_id < 500")


def user_sessions(spark, sf_dir):
    """Sessions of users with pauses under six hours (batch form of the stream)."""
    from lacuna.streaming.events import sessions

    out = sessions(table(spark, sf_dir, "events"), "6 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), r6(F.sum("total")).alias("total"), F.max("n").alias("longest"))


def nearby_audit(spark, sf_dir):
    d = daily(spark, sf_dir).withColumns({"ret": S.log_change("price"), "rolled": S.changed("n")})
    out = audits.nearby_returns(d.filter("ret IS NOT NULL"), ["series"], "ret", "rolled")
    return out.select("series", "roll_days", *[r6(c).alias(c) for c in ("roll_sd", "other_sd", "largest")])


def roll_table(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("symbol", F.concat(F.lit("c"), F.month("d").cast("string"))).withColumn("same", F.when(S.gap_days() <= 2, S.log_change("close")))
    out = audits.rolls(d, S, "symbol", "price", "same")
    return out.select("series", "d", "from_symbol", "to_symbol", big("gap").alias("gap"), r6("raw_return").alias("raw_return"), r6("basis").alias("basis"))


def panel_documents(spark, sf_dir):
    d = holed(spark, sf_dir).withColumn("ok", F.col("n") >= 2)
    out = audits.panel_document(d, S, "x", "ok", 4)
    return out.select("series", "rows", "first", "last", "matched", "usable", F.size("gaps").cast("long").alias("gaps"), F.aggregate("gaps", F.lit(0).cast("long"), lambda a, g: F.greatest(a, g["days"].cast("long"))).alias("longest"))


def quality_tiers(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("busy", (F.col("n") >= 2).cast("double"))
    d = d.withColumns({"share": S.mean("busy", 20, 15), "mid": S.median("n", 20, 15), "age": S.gap_days()})
    tier = quality_tier(F.col("age"), F.col("share"), F.col("mid") * 250, F.col("n") * 50)
    return d.groupBy("series", tier.alias("tier")).agg(F.count("*").alias("rows"), F.sum(usable_quote(F.col("age"), F.col("n") - 1, F.col("price")).cast("long")).alias("usable"))


def first_uses(spark, sf_dir):
    """A value carried forward counts at its first row only."""
    d = holed(spark, sf_dir).withColumn("seen", F.last(F.when(F.col("x").isNotNull(), F.col("d")), ignorenulls=True).over(S.so_far))
    return first_use(d, ["series"], "seen", "d").filter("n > 1").select("series", "d", "seen")


def parameter_grid(spark, sf_dir):
    return grid(spark, look=[20, 40], cut=[0.75, 1.0, 1.25], horizon=[15, 30])


W = "PARTITION BY series ORDER BY d"
PLANS: dict[str, Plan] = {
    "bar_audit": (bar_audit, f"""WITH {DAILY}, b AS (SELECT series, open, close, low, CASE WHEN n % 3 = 0 THEN close ELSE high END AS high FROM daily)
SELECT series, count(*) AS rows, sum((high < greatest(open, close) OR low > least(open, close))::INT)::BIGINT AS bar_faults, sum((abs(close * 2 - round(close * 2)) > 1e-9)::INT)::BIGINT AS off_tick FROM b GROUP BY series"""),
    "change_audit": (change_audit, f"""WITH {DAILY}, c AS (SELECT series, close - open AS change, (close - open) / open * 100 AS percent, close - lag(close) OVER ({W}) AS dd, (close - lag(close) OVER ({W})) / lag(close) OVER ({W}) * 100 AS pp FROM daily)
SELECT series, count(dd) AS compared, sum(coalesce(abs(dd - change) > 1e-9, false)::INT)::BIGINT AS change_faults, sum(coalesce(abs(pp - percent) > 0.011, false)::INT)::BIGINT AS percent_faults FROM c GROUP BY series"""),
    "completeness": (completeness, f"WITH {HOLED} SELECT series, count(*) AS rows, count(price) AS n_price, count(x) AS n_x, (count(*) - count(DISTINCT d))::BIGINT AS repeated, count(DISTINCT d) AS dates FROM holed GROUP BY series"),
    "inferred_frequency": (frequency, f"WITH {DAILY}, g AS (SELECT series, date_diff('day', lag(d) OVER ({W}), d) AS g FROM daily WHERE n >= 4) SELECT series, round(median(g), 6) AS median_gap, CASE WHEN median(g) >= 6 THEN 'weekly' ELSE 'daily' END AS frequency FROM g GROUP BY series"),
    "alignment_age": (alignment_age, f"""WITH {DAILY}, r AS (SELECT series, d AS rd FROM daily WHERE n >= 3), j AS (SELECT l.series, date_diff('day', rd, l.d) AS age FROM daily l ASOF LEFT JOIN r ON l.series = r.series AND l.d > r.rd)
SELECT series, count(*) AS rows, count(age) AS matched, min(age) AS least_age, round(median(age), 6) AS median_age, round(quantile_cont(age, 0.95), 6) AS p95_age, max(age) AS largest_age FROM j GROUP BY series"""),
    "age_counts": (age_counts, f"WITH {DAILY}, g AS (SELECT series, date_diff('day', lag(d) OVER ({W}), d) AS gap FROM daily) SELECT series, gap, count(*) AS rows FROM g GROUP BY ALL"),
    "sheet_errors": (sheet_errors, "SELECT 'a' AS \"column\", trim(c) AS cell, count(*) AS cells FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN '#REF!' WHEN n_nationkey % 7 = 0 THEN ' #N/A' ELSE n_name END AS c FROM nation) WHERE trim(c) IN ('#REF!', '#N/A') GROUP BY ALL"),
    "lenient_casts_all": (lenient_casts_all, None),
    "lenient_casts": (lenient_casts, """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderdate::DATE AS d, o_orderpriority AS s FROM orders WHERE o_orderkey < 4000)
SELECT k, CASE WHEN k % 5 <> 0 THEN round(p, 2) END AS number, ((k % 90 + 1) * [1, 1000, 1000000, 1000000000][k % 4 + 1])::DOUBLE AS magnitude, CASE WHEN k % 4 < 3 THEN d END AS date, lower(regexp_replace(regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
 CASE WHEN k % 5 = 0 OR k % 3 = 0 THEN 'text' ELSE 'float' END AS kind FROM o"""),
    "contract_codes_all": (contract_codes_all, None),
    "contract_codes": (contract_codes, """WITH p AS (SELECT p_partkey, substr('FGHJKMNQUVXZABC', (p_partkey % 15 + 1)::INT, 1) AS l, (p_partkey % 60)::BIGINT AS y FROM part WHERE p_partkey <= 500)
SELECT p_partkey, 'IS7' || l || lpad(y::VARCHAR, 2, '0') AS symbol, nullif(instr('FGHJKMNQUVXZ', l), 0) AS month, CASE WHEN instr('FGHJKMNQUVXZ', l) > 0 THEN 2000 + y END AS year, CASE WHEN instr('FGHJKMNQUVXZ', l) > 0 THEN (2000 + y) * 12 + instr('FGHJKMNQUVXZ', l) - 1 END AS serial FROM p"""),
    "keyword_classes": (keyword_classes, """WITH t AS (SELECT upper(CASE WHEN p_partkey % 3 = 0 THEN p_type || ' bulk carrier' WHEN p_partkey % 5 = 0 THEN 'Lng Tanker' ELSE p_type END) AS t FROM part),
k AS (SELECT CASE WHEN t LIKE '%TANKER%' OR t LIKE '%LNG%' OR t LIKE '%LPG%' THEN 'tanker' WHEN t LIKE '%BULK%' THEN 'bulker' WHEN t LIKE '%CONTAINER%' THEN 'container' WHEN t LIKE '%CARGO%' OR t LIKE '%RORO%' THEN 'general_cargo' WHEN t SIMILAR TO '.*(PLATFORM|RIG|DRILL|BARGE).*' THEN 'special_structure' ELSE 'other' END AS kind FROM t)
SELECT kind, CASE kind WHEN 'tanker' THEN 0.765 WHEN 'bulker' THEN 0.66 WHEN 'container' THEN 0.65 WHEN 'general_cargo' THEN 0.63 WHEN 'special_structure' THEN 0.35 ELSE 0.6 END::DOUBLE AS share, count(*) AS parts FROM k GROUP BY ALL"""),
    "basis_terms": (basis_terms, f"""WITH {DAILY}, z AS (SELECT series, d, CASE WHEN count(*) OVER a >= 20 THEN (price - avg(price) OVER a) / nullif(stddev_samp(price) OVER a, 0) END AS z, CASE WHEN count(*) OVER a >= 20 THEN (n - avg(n) OVER a) / nullif(stddev_samp(n) OVER a, 0) END AS y FROM daily WINDOW a AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT series, d, round(greatest(z - 1, 0), 6) AS up, round(greatest(-z - 1, 0), 6) AS down, CASE WHEN y IS NOT NULL THEN round(greatest(least(z * y, 6), -6), 6) + 0.0 END AS cross, round(greatest(least(z, 2), -2), 6) + 0.0 AS clipped FROM z WHERE z IS NOT NULL"""),
    "reason_texts": (reason_texts, f"""WITH {DAILY}, g AS (SELECT *, date_diff('day', lag(d) OVER ({W}), d) AS gap FROM daily),
w AS (SELECT series, high, low, array_to_string(list_filter([CASE WHEN n < 2 THEN 'thin' END, CASE WHEN gap > 3 THEN 'stale' END, CASE WHEN price < 100000 THEN 'low' END], lambda x: x IS NOT NULL), '; ') AS why FROM g)
SELECT series, why, count(*) AS rows, sum((abs(high - low) <= 1e-9)::INT)::BIGINT AS flat FROM w GROUP BY ALL"""),
    "page_links": (page_links, """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages) SELECT page_id, unnest(range(0, len(h))) AS place, unnest(h) AS href FROM l"""),
    "page_cells": (page_cells, r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS h FROM pages)
SELECT page_id, len(h) AS items, array_to_string(list_transform(h, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), '|') AS texts FROM l"""),
    "event_props_all": (event_props_all, None),
    "event_props": (event_props, """WITH e AS (SELECT event_id, props::JSON AS j FROM events WHERE event_id < 500), k AS (SELECT event_id, j, unnest(json_keys(j)) AS key FROM e) SELECT event_id, key, json_extract_string(j, '$."' || key || '"') AS value FROM k"""),
    "user_sessions": (user_sessions, """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g),
c AS (SELECT user_id, s, count(*) AS n, sum(value) AS total FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, round(sum(total), 6) AS total, max(n) AS longest FROM c GROUP BY user_id"""),
    "nearby_audit": (nearby_audit, f"""WITH {DAILY}, r AS (SELECT series, ln(price / lag(price) OVER ({W})) AS r, coalesce(n <> lag(n) OVER ({W}), false) AS rolled FROM daily)
SELECT series, count(CASE WHEN rolled THEN r END) AS roll_days, round(stddev_samp(CASE WHEN rolled THEN r END), 6) AS roll_sd, round(stddev_samp(CASE WHEN NOT rolled THEN r END), 6) AS other_sd, round(max(abs(r)), 6) AS largest FROM r WHERE r IS NOT NULL GROUP BY series"""),
    "roll_table": (roll_table, f"""WITH {DAILY}, r AS (SELECT series, d, 'c' || month(d) AS symbol, price, lag(d) OVER ({W}) AS d0, lag(price) OVER ({W}) AS p0, CASE WHEN d - lag(d) OVER ({W}) <= 2 THEN ln(close / lag(close) OVER ({W})) END AS same FROM daily)
SELECT series, d, 'c' || month(d0) AS from_symbol, symbol AS to_symbol, (d - d0)::BIGINT AS gap, round(ln(price / p0), 6) + 0.0 AS raw_return, round(ln(price / p0) - same, 6) + 0.0 AS basis FROM r WHERE d0 IS NOT NULL AND month(d0) <> month(d)"""),
    "panel_documents": (panel_documents, f"""WITH {HOLED}, g AS (SELECT *, d - lag(d) OVER ({W}) AS gap FROM holed)
SELECT series, count(*) AS rows, min(d) AS first, max(d) AS last, count(x) AS matched, sum((n >= 2)::INT)::BIGINT AS usable, nullif(count(CASE WHEN gap > 4 THEN 1 END), 0)::BIGINT AS gaps, max(CASE WHEN gap > 4 THEN gap END)::BIGINT AS longest FROM g GROUP BY series"""),
    "quality_tiers": (quality_tiers, f"""WITH {DAILY}, w AS (SELECT *, d - lag(d) OVER ({W}) AS age, CASE WHEN count(*) OVER a >= 15 THEN avg((n >= 2)::INT) OVER a END AS share, CASE WHEN count(*) OVER a >= 15 THEN median(n) OVER a END AS mid FROM daily WINDOW a AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN share >= 0.5 AND mid * 250 >= 500 AND age <= 3 THEN 'primary' WHEN n * 50 >= 100 AND age <= 4 THEN 'curve_mark' ELSE 'none' END AS tier FROM w)
SELECT series, tier, count(*) AS rows, sum(coalesce(age <= 4 AND n > 1 AND price > 0, false)::INT)::BIGINT AS usable FROM t GROUP BY ALL"""),
    "first_uses": (first_uses, f"""WITH {HOLED}, s AS (SELECT series, d, n, last_value(CASE WHEN x IS NOT NULL THEN d END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM holed),
k AS (SELECT *, row_number() OVER (PARTITION BY series, seen ORDER BY d) AS k FROM s WHERE seen IS NOT NULL) SELECT series, d, seen FROM k WHERE k = 1 AND n > 1"""),
    "parameter_grid": (parameter_grid, "SELECT look, cut, horizon FROM (SELECT unnest([20, 40])::INT AS look) CROSS JOIN (SELECT unnest([0.75, 1.0, 1.25])::DOUBLE AS cut) CROSS JOIN (SELECT unnest([15, 30])::INT AS horizon)"),
}
