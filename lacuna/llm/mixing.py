"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operators only.

Each document draws the exponential key -ln(u) / quality weight, u from a hash of its id.
Within a source documents are ordered by key. A source's target buys complete epochs of
the source first; the rest goes to the documents first in that order, up to the prefix
sum that comes nearest the target. Prefix sums have two levels: a source's keys are cut
into ranges of about RANGE_ROWS documents, ranges are summed before the shuffle, and only
the sums of ranges are ordered by source. The cuts are even in the source's own mixture of
exponential distributions, one for each class of like weights, so ranges stay even whatever
the weights are and however large the source. No task holds a whole source.

Cases: null text has size 0 and takes nothing; a null source is a source of its own, last;
null, equal or repeated ids are ordered by size after the key; an empty table mixes to an
empty one; missing weights and those not above 0 count as 1; columns beside the named ones
are kept by mixed() and not read by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lacuna.llm.common import staged, unused

#: Words as the contracts have them: runs of all but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Source weights by rank of the source, repeating; most epochs of a source; documents in a range of keys; classes of weights from one to its double.
WEIGHTS, MOST, RANGE_ROWS, CLASSES = (5, 2, 1), 3, 4_000, 4
#: Sources whose mixtures of weights, under a kilobyte each, are broadcast at most; more are joined by source.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality_weight(quality: Column) -> Column:
    """2 for good documents, 0.5 for bad ones, 1 where nothing is known."""
    return F.coalesce(0.5 + 1.5 * quality, F.lit(1.0))


def targets(sources: DataFrame) -> DataFrame:
    """Adds target to one row per source with columns skey, source, source_size.

    Filling caps in the order of cap over weight gives what resharing the excess again and
    again converges to: the first source that its share does not fill sets the level.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    by_level = W.orderBy("ratio", "skey")
    out = sources.withColumn("sw", weight).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    out = out.withColumn("ratio", F.col("cap") / F.col("sw")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    out = out.withColumn("filled", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("level", (F.col("total") - F.col("filled")) / F.sum("sw").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    free = F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "skey", "level"))
    out = out.withColumn("first_free", F.min(free).over(everything))
    return out.withColumn("target", F.coalesce(F.least("cap", F.col("sw") * F.col("first_free.level")), F.col("cap"))).select("skey", "source_size", "target")


def spreads(keyed: DataFrame) -> DataFrame:
    """skey, ranges and mix (share and mean of each class of weights) of every source."""
    kinds = keyed.groupBy("skey", F.floor(F.log2("weight") * CLASSES).alias("kind")).agg(F.count("*").alias("n"), F.avg("weight").alias("mean"))
    mix = F.sort_array(F.collect_list(F.struct("kind", "n", "mean")))  # a few classes: weights range over few powers of two
    return kinds.groupBy("skey").agg(F.sum("n").alias("all"), mix.alias("kinds")).select(
        "skey",
        F.ceil(F.col("all") / RANGE_ROWS).alias("ranges"),
        F.transform("kinds", lambda k: F.struct((k["n"] / F.col("all")).alias("share"), k["mean"].alias("mean"))).alias("mix"),
    )


def share_below(key: Column, mix: Column) -> Column:
    """The share of a source's documents that have smaller keys, as its weights let expect; it grows with the key."""
    return F.aggregate(mix, F.lit(0.0), lambda sum_, k: sum_ + k["share"] * (1 - F.exp(-k["mean"] * key)))


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weight: str = "weight") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of docs."""
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    u = (F.conv(F.substring(F.md5(ident), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    chance = F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(F.lit(1.0))
    keyed = staged(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source))).alias("skey"),
            F.col(size).cast("long").alias("size"),
            chance.alias("weight"),
            (-F.log(u) / chance).alias("key"),
        ),
        "mixing",
    )
    known = staged(spreads(keyed), "spreads")
    known = F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known
    keyed = keyed.join(known, "skey").withColumn("cut", F.floor(F.least(share_below(F.col("key"), F.col("mix")), F.lit(1 - 1e-12)) * F.col("ranges"))).drop("mix", "ranges", "weight")
    cuts = keyed.groupBy("skey", "cut").agg(F.sum("size").alias("cut_size"), F.min("source").alias("source"))
    sources = cuts.groupBy("skey").agg(F.sum("cut_size").alias("source_size"), F.min("source").alias("source"))
    before = F.coalesce(F.sum("cut_size").over(W.partitionBy("skey").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = cuts.select("skey", "cut", before.alias("cut_before")).join(targets(sources), "skey")
    inside = W.partitionBy("skey", "cut").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = keyed.join(cuts, ["skey", "cut"]).withColumn("before", F.col("cut_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    chosen = (F.col("before") + F.col("size") / 2 <= rest).cast("long")
    out = out.withColumn("copies", epochs.cast("long") + F.when(F.col("size") > 0, chosen).otherwise(F.lit(0)))
    return out.select("doc_id", "source", "size", F.col("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, size in words and quality weight of every document."""
    quality = labels.groupBy("doc_id").agg(F.avg("quality").alias("q"))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return sized.join(quality, "doc_id", "left").select("doc_id", "source", "size", quality_weight(F.col("q")).alias("weight"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix: each row of docs as often as the plan takes it, with its own columns.

    Rows alike in doc_id, source and size share the most copies that one of them has.
    """
    copies = plan(weighed(docs, labels)).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    of = {c: unused(docs, c) for c in (*copies.columns, "copy")}
    copies = copies.withColumnsRenamed(of)
    same = [docs["doc_id"].eqNullSafe(F.col(of["doc_id"])), docs["source"].eqNullSafe(F.col(of["source"])), n_words(docs["text"]) == F.col(of["size"])]
    joined = docs.join(copies, same).withColumn(of["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(of["copies"]))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH q AS (SELECT doc_id, avg(quality) AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(documents.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / coalesce(0.5 + 1.5 * q.q, 1.0) AS key
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS sw, (3 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / sw AS ratio, coalesce(source, '') AS skey FROM r),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(sw) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f),
t AS (
  SELECT source, source_size, coalesce(least(cap, sw * (SELECT arg_min(level, ratio) FROM l WHERE level < ratio)), cap) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-12) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
