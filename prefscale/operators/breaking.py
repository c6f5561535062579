"""Rankings broken into comparisons, and pair statistics.

rankings: (ranking_id, items best first, weight). Comparisons are made within the row and summed before the shuffle, so
what is shuffled is at most (items squared) rows a task, whatever the number of rankings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscale.functions.hashing import hash_key


def weight_of(rankings: DataFrame) -> Column:
    return F.col("weight").cast("double") if "weight" in rankings.columns else F.lit(1.0)


def full_pairs(items: Column) -> Column:
    """All (winner, loser) of a ranking, with their places."""
    rest = lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y, j: F.struct(x.alias("winner"), y.alias("loser"), i.alias("pos_i"), (i + 1 + j).alias("pos_j")))
    return F.flatten(F.transform(items, rest))


def matched_pairs(items: Column, seed: object, ranking_id: Column) -> Column:
    """A random matching of the places of a ranking: each item in one pair at most."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(hash_key(seed, ranking_id, i).alias("k"), i.alias("pos"), x.alias("item"))))

    def pair(own: Column, p: Column) -> Column:
        a, b = F.get(own, 2 * p), F.get(own, 2 * p + 1)
        one, two = F.when(a["pos"] < b["pos"], a).otherwise(b), F.when(a["pos"] < b["pos"], b).otherwise(a)
        return F.struct(one["item"].alias("winner"), two["item"].alias("loser"), one["pos"].alias("pos_i"), two["pos"].alias("pos_j"))

    half = F.floor(F.size(items) / 2).cast("int")
    every = lambda own: F.transform(F.sequence(F.lit(0), F.greatest(half - 1, F.lit(0))), lambda p: pair(own, p))
    return F.when(half > 0, F.get(F.transform(F.array(keyed), every), F.lit(0)))  # in an array of one, so it is sorted once, not for each pair


def rank_break(rankings: DataFrame, scheme: str = "full", seed: object = 0) -> DataFrame:
    """(ranking_id, winner, loser, pos_i, pos_j, weight): all pairs, or those of a random matching."""
    items = F.col("items")
    pairs = full_pairs(items) if scheme == "full" else matched_pairs(items, seed, F.col("ranking_id"))
    rows = rankings.select("ranking_id", F.explode(pairs).alias("p"), weight_of(rankings).alias("weight"))
    return rows.select("ranking_id", "p.winner", "p.loser", "p.pos_i", "p.pos_j", "weight")


def rank_break_weighted(rankings: DataFrame, kappa: DataFrame) -> DataFrame:
    """Comparisons with the weight that ``kappa`` (pos_i, pos_j, kappa) has for their places, times the ranking's."""
    rows = rank_break(rankings).join(kappa, ["pos_i", "pos_j"])
    return rows.select("ranking_id", "winner", "loser", "pos_i", "pos_j", (F.col("weight") * F.col("kappa")).alias("weight"))


def count_comparisons(comparisons: DataFrame) -> DataFrame:
    return comparisons.groupBy("winner", "loser").agg(F.sum("weight").alias("wins"))


def pair_counts(rankings: DataFrame, scheme: str = "full", seed: object = 0) -> DataFrame:
    """(winner, loser, wins): summed weights."""
    return count_comparisons(rank_break(rankings, scheme, seed))


def pair_probs(counts: DataFrame, smoothing: str = "none", nu: float = 1.0) -> DataFrame:
    """(item, opponent, wins, total, p): p is the share in which item beat opponent. One shuffle on the unordered pair.

    smoothing: ``none``; ``all`` adds nu to both sides of every compared pair; ``degenerate`` only where one side is 0.
    """
    lo, hi = F.least("winner", "loser"), F.greatest("winner", "loser")
    won = lambda c: F.sum(F.when(F.col("winner") == c, F.col("wins")).otherwise(0.0))
    both = counts.groupBy(lo.alias("lo"), hi.alias("hi")).agg(won(lo).alias("a"), won(hi).alias("b")).where("lo <> hi")
    add = {"none": F.lit(0.0), "all": F.lit(float(nu)), "degenerate": F.when((F.col("a") == 0) | (F.col("b") == 0), float(nu)).otherwise(0.0)}[smoothing]
    both = both.withColumn("add", add)
    side = lambda i, j, x: F.struct(F.col(i).alias("item"), F.col(j).alias("opponent"), (F.col(x) + F.col("add")).alias("wins"))
    total = F.col("a") + F.col("b") + 2 * F.col("add")
    rows = both.select(F.explode(F.array(side("lo", "hi", "a"), side("hi", "lo", "b"))).alias("s"), total.alias("total")).where("total > 0")
    return rows.select("s.item", "s.opponent", "s.wins", "total", (F.col("s.wins") / F.col("total")).alias("p"))


def pair_moments(rankings: DataFrame) -> DataFrame:
    """(winner, loser, moment): share of the rankings' weight in which the pair occurs in this order."""
    m = rankings.agg(F.sum(weight_of(rankings)).alias("m"))
    rows = pair_counts(rankings).join(F.broadcast(m))  # one row
    return rows.select("winner", "loser", (F.col("wins") / F.col("m")).alias("moment"))


def clip_probs(pairs: DataFrame, eps: float = 0.001) -> DataFrame:
    return pairs.withColumn("p", F.greatest(F.least("p", F.lit(1 - eps)), F.lit(eps)))


def drop_extreme_pairs(pairs: DataFrame, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    return pairs.where((F.col("p") >= lo) & (F.col("p") <= hi))
