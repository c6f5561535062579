"""Orders and choice statistics that need one pass over the rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.operators.breaking import weight_of
from prefscale.operators.evaluate import is_small, with_thetas


def borda(rankings: DataFrame) -> DataFrame:
    """(item, score): one point for each item ranked behind, over partial rankings too."""
    points = F.transform("items", lambda x, i: F.struct(x.alias("item"), (F.size("items") - i - 1).alias("s")))
    rows = rankings.select(F.explode(points).alias("p"), weight_of(rankings).alias("weight"))
    return rows.groupBy("p.item").agg(F.sum(F.col("p.s") * F.col("weight")).alias("score"))


def order_items(scores: DataFrame, value: str = "score", component: str | None = None) -> DataFrame:
    """``scores`` with ``rank`` from 1: items by falling value, ties by item, in each component. A table of items."""
    by = W.partitionBy(component) if component else W.partitionBy(F.lit(0))
    return scores.withColumn("rank", F.row_number().over(by.orderBy(F.desc(value), "item")))


def preference_order(pairs: DataFrame) -> DataFrame:
    """(item, score, rank, is_transitive) by majority wins (a tie counts half): the topological order of the majority
    graph where that is complete and acyclic, which ``is_transitive`` tells."""
    score = F.sum(F.when(F.col("p") > 0.5, 1.0).when(F.col("p") == 0.5, 0.5).otherwise(0.0))
    scores = pairs.groupBy("item").agg(score.alias("score"))
    whole = scores.agg((F.count_distinct("score") == F.count("*")).alias("is_transitive"))
    return order_items(scores).join(F.broadcast(whole))  # one row


def win_counts(rankings: DataFrame, a0: float = 0.0) -> DataFrame:
    """(item, wins): weight of the rankings in which the item stands, but not last; plus a prior."""
    ahead = F.slice("items", 1, F.greatest(F.size("items") - 1, F.lit(0)))
    rows = rankings.select(F.explode(ahead).alias("item"), weight_of(rankings).alias("weight"))
    return rows.groupBy("item").agg((F.sum("weight") + a0).alias("wins"))


def placed(rankings: DataFrame, params: DataFrame) -> DataFrame:
    """(ranking_id, component, pos, item, weight, len, w): each entry with its item's e^theta. params is a table of
    items and components, joined by item; a small one goes to every task, as few items would be few and large groups."""
    rows = rankings.select("ranking_id", F.posexplode("items").alias("pos", "item"), F.size("items").alias("len"), weight_of(rankings).alias("weight"))
    return rows.join(F.broadcast(params) if is_small(params) else params, "item").withColumn("w", F.exp("theta"))


def suffix_weight_sums(entries: DataFrame) -> DataFrame:
    """``entries`` with ``suffix``: the sum of w from a place to the ranking's end."""
    back = W.partitionBy("ranking_id", "component").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    return entries.withColumn("suffix", F.sum("w").over(back))


def prefix_reciprocal_sums(entries: DataFrame) -> DataFrame:
    """``entries`` with ``prefix``: the running sum of 1 / suffix, which the last place takes from the one before."""
    on = W.partitionBy("ranking_id", "component").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    chosen = F.when(F.col("pos") <= F.col("len") - 2, 1 / F.col("suffix")).otherwise(0.0)
    return entries.withColumn("prefix", F.sum(chosen).over(on))


def running(values: Column) -> Column:
    """The sums of an array of numbers up to each place."""
    start = F.struct(F.array().cast("array<double>").alias("all"), F.lit(0.0).alias("sum"))

    def step(acc: Column, v: Column) -> Column:
        return F.struct(F.concat(acc["all"], F.array(acc["sum"] + v)).alias("all"), (acc["sum"] + v).alias("sum"))

    return F.aggregate(values, start, step, lambda acc: acc["all"])


def with_suffixes(rankings: DataFrame, params: DataFrame) -> DataFrame:
    """(component, thetas, items, weight, suffix): each ranking with each model and, by place, the sum of e^theta from there to
    its end; items that the model lacks weigh nothing. Made in the row, so nothing is shuffled for a small model."""
    rows = with_thetas(rankings.where("items is not null").select("items", weight_of(rankings).alias("weight")), params)
    weights = F.transform("items", lambda x: F.coalesce(F.exp(F.col("thetas")[x]), F.lit(0.0)))
    return rows.withColumn("suffix", F.reverse(running(F.reverse(weights))))


def choice_denominators(rankings: DataFrame, params: DataFrame) -> DataFrame:
    """(component, item, denom): what an item's wins are divided by in a minorise-maximise step. Only sums are shuffled."""
    rows = with_suffixes(rankings, params)
    chosen = running(F.transform("suffix", lambda s, i: F.when((i <= F.size("items") - 2) & (s > 0), 1 / s).otherwise(0.0)))
    entry = F.explode(F.zip_with("items", chosen, lambda x, p: F.struct(x.alias("item"), p.alias("prefix"))))
    rows = rows.select("component", "thetas", "weight", entry.alias("e")).where("thetas[e.item] is not null")
    return rows.groupBy("component", "e.item").agg(F.sum(F.col("weight") * F.col("e.prefix")).alias("denom"))


def luce_flows(rankings: DataFrame, params: DataFrame) -> DataFrame:
    """(component, loser, winner, rate): weight of the pair over the suffix sum at the winner's place. Only sums are shuffled."""
    rows = with_suffixes(rankings, params)
    pair = lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda y: F.struct(y.alias("loser"), x.alias("winner"), (F.col("weight") / F.get("suffix", i)).alias("rate")))
    rows = rows.select("component", "thetas", F.explode(F.flatten(F.transform("items", pair))).alias("p"))
    rows = rows.where("thetas[p.winner] is not null and thetas[p.loser] is not null")
    return rows.groupBy("component", "p.loser", "p.winner").agg(F.sum("p.rate").alias("rate"))
