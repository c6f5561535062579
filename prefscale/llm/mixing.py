"""Mixing sources to target weights.

Every row has a hash-random place in its source. Sums of words over equal ranges of places give a distributed prefix
sum; the range in which a source's budget ends is the only one that is sorted. A source's cut is then one row (whole
epochs, the place where the last epoch ends, the words left there), so the big table is read without a shuffle.

Defined results: a null text has no words and takes none; an empty table gives no rows; rows that repeat a doc_id share
one place and, at the cut, share what is left by their size; a null source is a source of its own, last in the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.llm.text import HASH_BITS, packed, place, range_bits, unpacked, word_count
from prefscale.session import cut, table

SEED = "mix"
MOST_EPOCHS = 3
#: Sources up to this number are sent to every task; beyond it their cuts are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(totals: DataFrame, weights: Sequence[int], most: int = MOST_EPOCHS) -> DataFrame:
    """Totals (source, source_size) with ``target``: shares by weight, none above ``most`` times its source.

    Weights go to the sources by code point, null last, and repeat. Sharing the excess again and again by weight ends at
    one level per unit of weight: sources whose cap lies below the level get their cap, the others level x weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = totals.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    rows = rows.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    by = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    rows = rows.withColumn("_capped", F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_open", F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("_whole", F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = rows.withColumn("_level", (F.col("_whole") - F.col("_capped")).cast("double") / F.col("_open"))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("_w"))
    return rows.select("source", "source_size", target.alias("target"))


def cuts(sized: DataFrame, weights: Sequence[int], rows: int, per_range: int = 50_000) -> DataFrame:
    """Per source: source_size, target, whole ``epochs``, and where the last epoch ends: place, doc_id, words left, words there."""
    bits = range_bits(rows, per_range)
    spot = F.shiftright("_at", HASH_BITS - bits).cast("int") if bits else F.lit(0)
    ranges = cut(sized.groupBy("source", spot.alias("_range")).agg(F.sum("size").alias("_sum")))
    totals = ranges.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    plan = source_targets(totals, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs)
    plan = plan.withColumn("_left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = cut(plan)
    near = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    at = ranges.withColumn("_upto", F.sum("_sum").over(near)).alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    at = at.where("_left > _upto - _sum and _left <= _upto and _left > 0").select(F.col("r.source").alias("_s"), F.col("_range").alias("_edge"), (F.col("_upto") - F.col("_sum")).alias("_before"), "_left")
    edge = sized.join(at, sized["source"].eqNullSafe(at["_s"]) & (spot == at["_edge"]))
    edge = edge.groupBy("source", "_at", "doc_id", "_before", "_left").agg(F.sum("size").alias("_there"))
    line = W.partitionBy("source").orderBy("_at", F.col("doc_id").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("_upto", F.col("_before") + F.sum("_there").over(line))
    edge = edge.where("_left > _upto - _there and _left <= _upto")
    edge = edge.select(F.col("source").alias("_s"), F.col("_at").alias("cut_at"), F.col("doc_id").alias("cut_id"), (F.col("_left") - F.col("_upto") + F.col("_there")).alias("cut_words"), F.col("_there").alias("cut_there"))
    return plan.join(edge, plan["source"].eqNullSafe(edge["_s"]), "left").drop("_s", "_left")


def taken(size: Column) -> Column:
    """Words that the mix takes of a row, from its size, its place and its source's cut."""
    id_, cut_id = F.col("doc_id"), F.col("cut_id")
    # a null doc_id comes after every other one
    earlier = (F.col("_at") < F.col("cut_at")) | ((F.col("_at") == F.col("cut_at")) & F.coalesce(id_ < cut_id, id_.isNotNull() & cut_id.isNull()))
    there = (F.col("_at") == F.col("cut_at")) & id_.eqNullSafe(cut_id)
    part = F.floor(F.col("cut_words") * size / F.col("cut_there")).cast("long")
    return F.col("epochs") * size + F.when(F.col("cut_at").isNull(), 0).when(earlier, size).when(there, part).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), seed: str = SEED) -> DataFrame:
    """``docs`` with the columns size, source_size, target and taken.

    The mix has as many words as ``docs``, shared among the sources by weight. Other columns of ``docs`` stay; columns
    of the four names are replaced.
    """
    at = place(F.col("doc_id"), seed=seed)
    thin = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), at.alias("_at")))
    n = thin.count()
    plan = cut(cuts(thin, weights, n))
    few = plan.count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "_source")
    made = ("size", "source_size", "target", "taken")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    kept = packed(kept, "doc_id", "text", "source").withColumn("size", word_count(F.col("text"))).withColumn("_at", at)
    rows = kept.join(F.broadcast(plan) if few else plan, kept["source"].eqNullSafe(plan["_source"]))
    return rows.withColumn("taken", taken(F.col("size"))).select("_packed", *made).select("_packed.*", *made)


def mixed_rows(docs: DataFrame, weights: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it whole, to the nearest time; the columns stay."""
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    return unpacked(mix(packed(docs, "doc_id", "text", "source"), weights).select("_packed", F.explode(F.array_repeat(F.lit(1), copies))))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS spot
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM t),
c AS (SELECT *, (3 * source_size)::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()
                 - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
g AS (SELECT source, source_size,
             least((3 * source_size)::DOUBLE, coalesce((SELECT max(level) FROM l WHERE level <= ratio), 0.0) * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM g),
q AS (SELECT *, floor(target - epochs * source_size)::BIGINT AS rest FROM p),
s AS (SELECT d.*, q.source_size, q.target, q.epochs, q.rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY spot, doc_id NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
             sum(size) OVER (PARTITION BY d.source, spot, doc_id)::BIGINT AS there
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - there < rest THEN floor((rest - upto + there) * size / there) ELSE 0 END)::BIGINT AS taken
FROM s
"""
