"""From ratings and ballots to rankings, and what narrows rankings down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.functions.hashing import hash_key, hash_uniform
from prefscale.operators.breaking import weight_of


def item_rating_stats(ratings: DataFrame, by: str = "item_id") -> DataFrame:
    """(by, n, total, avg) of an item's, or a user's, ratings."""
    return ratings.groupBy(by).agg(F.count("rating").alias("n"), F.sum("rating").alias("total"), F.avg("rating").alias("avg"))


def filter_items_by_support(stats: DataFrame, cutoff: int) -> DataFrame:
    return stats.where(F.col("n") > cutoff)


def filter_active(ratings: DataFrame, min_user: int, min_item: int) -> DataFrame:
    """Ratings of users and items that have more than the least number of ratings, both counted once, before."""
    users = ratings.groupBy("user_id").count().where(F.col("count") > min_user).select("user_id")
    items = ratings.groupBy("item_id").count().where(F.col("count") > min_item).select("item_id")
    return ratings.join(items, "item_id", "left_semi").join(users, "user_id", "left_semi").select(*ratings.columns)


def top_n_by_count(ratings: DataFrame, num_users: int, num_items: int) -> tuple[DataFrame, DataFrame]:
    """The most active users and the most rated items, as (id, n)."""
    most = lambda by, k: ratings.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)
    return most("user_id", num_users), most("item_id", num_items)


def dense_index(counts: DataFrame, by: str) -> DataFrame:
    """(by, n, idx): ids by falling count from 0. For tables of chosen ids, which a limit has made small."""
    return counts.withColumn("idx", F.row_number().over(W.orderBy(F.desc("n"), by)) - 1)


def dedupe_ratings(ratings: DataFrame, order: str) -> DataFrame:
    """One rating per user and item: that of the largest ``order``."""
    return ratings.groupBy("user_id", "item_id").agg(F.max_by("rating", order).alias("rating"))


def index_ratings(ratings: DataFrame, num_users: int, num_items: int) -> DataFrame:
    """(user, item, rating) of the most active users and most rated items, with dense indexes for ids."""
    users, items = top_n_by_count(ratings, num_users, num_items)
    u = dense_index(users, "user_id").select("user_id", F.col("idx").alias("user"))
    i = dense_index(items, "item_id").select("item_id", F.col("idx").alias("item"))
    return ratings.join(u, "user_id").join(i, "item_id").select("user", "item", "rating")


def drop_empty_users(users: DataFrame, ratings: DataFrame) -> DataFrame:
    return users.join(ratings.select("user_id"), "user_id", "left_semi")


def rankings_from_scores(scores: DataFrame, key: str, item: str = "item", score: str = "score") -> DataFrame:
    """(ranking_id, items): per key the items by falling score, ties by item."""
    best = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))))
    return scores.groupBy(F.col(key).alias("ranking_id")).agg(F.transform(best, lambda x: x["i"]).alias("items"))


def long_rankings(rankings: DataFrame) -> DataFrame:
    """(ranking_id, pos, item)."""
    return rankings.select("ranking_id", F.posexplode("items").alias("pos", "item"))


def compact_rankings(rankings: DataFrame) -> DataFrame:
    """Identical rankings as one row with their summed weight."""
    return rankings.groupBy("items").agg(F.sum(weight_of(rankings)).alias("weight"))


def menu(items: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(i)) for i in items]).cast("array<int>")


def project_to_menu(rankings: DataFrame, items: Sequence[int], reindex: bool = False) -> DataFrame:
    """Each ranking restricted to some items in its own order; reindex: numbered by their place in ``items``."""
    only = F.filter("items", lambda x: F.array_contains(menu(items), x.cast("int")))
    if reindex:
        only = F.transform(only, lambda x: (F.array_position(menu(items), x.cast("int")) - 1).cast("int"))
    return rankings.withColumn("items", only)


def thin_rankings(rankings: DataFrame, p0: float, seed: object = 0) -> DataFrame:
    """Each entry kept with probability p0; rankings left with less than two items go."""
    kept = F.filter("items", lambda x, i: hash_uniform(seed, F.col("ranking_id"), i) < p0)
    return rankings.withColumn("items", kept).where(F.size("items") > 1)


def item_position_stats(rankings: DataFrame) -> DataFrame:
    """(item, n, mean_pos, var_pos): the population variance of an item's places."""
    return long_rankings(rankings).groupBy("item").agg(F.count("*").alias("n"), F.avg("pos").alias("mean_pos"), F.var_pop("pos").alias("var_pos"))


def select_high_variance_items(rankings: DataFrame, k: int) -> DataFrame:
    return item_position_stats(rankings).orderBy(F.desc("var_pos"), "item").limit(k)


def top_k_prefix(rankings: DataFrame, k: int) -> DataFrame:
    return rankings.withColumn("items", F.slice("items", 1, k))


def unranked_items(rankings: DataFrame, n: int) -> DataFrame:
    """(ranking_id, items): items of 0 to n - 1 that a ranking leaves out."""
    return rankings.select("ranking_id", F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.col("items").cast("array<int>")).alias("items"))


def distinct_menus(rankings: DataFrame) -> DataFrame:
    return rankings.select(F.array_sort("items").alias("items")).distinct()


def hash_ranked(rankings: DataFrame, seed: object) -> DataFrame:
    """``rankings`` with ``rank`` from 0 in the order of a hash. Ranges of the hash (4096) are counted, and rows are
    sorted within their range only, so no task gets all rows."""
    rows = rankings.withColumn("_k", hash_key(seed, F.col("ranking_id"))).withColumn("_range", F.substring("_k", 1, 3))
    counts = rows.groupBy("_range").agg(F.count("*").alias("n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_range").orderBy("_k", "ranking_id")
    rows = rows.join(F.broadcast(counts), "_range")  # 4096 rows at most
    return rows.withColumn("rank", F.row_number().over(inside) - 1 + F.col("_before")).drop("_k", "_range", "_before")


def split_rankings(rankings: DataFrame, train: float = 0.8, val: float = 0.2, seed: object = 119, mode: str = "exact") -> DataFrame:
    """``rankings`` with ``part``: train, val or test. exact: the given counts to the row, by a sort on a hash;
    hash: by thresholds on a hash, without a sort or a shuffle, for tables of any size."""
    if mode == "hash":
        u = hash_uniform(seed, F.col("ranking_id"))
        part = F.when(u < train * (1 - val), "train").when(u < train, "val").otherwise("test")
        return rankings.withColumn("part", part)
    m = rankings.count()
    n_train = int(m * train)
    n_val = int(n_train * val)
    part = F.when(F.col("rank") < n_train - n_val, "train").when(F.col("rank") < n_train, "val").otherwise("test")
    return hash_ranked(rankings, seed).withColumn("part", part)


def learning_curve_prefixes(rankings: DataFrame, ratios: Sequence[float], seed: object = 119, mode: str = "hash") -> DataFrame:
    """Rankings with ``ratio``, once in every prefix that they belong to; prefixes are nested. exact: a prefix has exactly
    int(count x ratio) of them, by ``rank`` (from 0 without gaps, as the train part of ``split_rankings`` has it) or, where
    there is none, by the order of a hash; hash: by thresholds on a hash, without a sort or a shuffle."""
    if mode == "hash":
        at, upto = hash_uniform(seed, F.col("ranking_id")), F.lit
    else:
        m = rankings.count()
        rankings = rankings if "rank" in rankings.columns else hash_ranked(rankings, seed)
        at, upto = F.col("rank"), lambda r: F.lit(int(m * r))
    every = F.filter(F.array(*[F.struct(F.lit(float(r)).alias("ratio"), upto(float(r)).alias("upto")) for r in ratios]), lambda r: at < r["upto"])
    return rankings.withColumn("ratio", F.explode(F.transform(every, lambda r: r["ratio"])))


def parse_ballots(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(votes, items, tied_tail) of lines ``count,item,...,{tied,...}``; ids from 0, other tokens are dropped."""
    numbers = lambda text: F.transform(F.filter(F.split(text, ","), lambda s: F.trim(s).rlike("^[0-9]+$")), lambda s: F.trim(s).cast("int") - 1)
    line = F.col(column)
    tail = F.regexp_extract(line, r"\{([^}]*)\}", 1)
    head = F.regexp_replace(line, r"\{[^}]*\}", "")
    votes = F.trim(F.split(head, ",")[0])
    rows = lines.where(votes.rlike("^[0-9]+$"))
    all_numbers = numbers(head)
    return rows.select(*keep, votes.cast("long").alias("votes"), F.slice(all_numbers, 2, F.greatest(F.size(all_numbers), F.lit(1))).alias("items"), numbers(tail).alias("tied_tail"))


def extend_ties(ballots: DataFrame, key: Column, seed: object = 0) -> Column:
    """Items with the tied tail behind them, in an order by hash of ``key``."""
    tail = F.array_sort(F.transform("tied_tail", lambda x: F.struct(hash_key(seed, key, x).alias("k"), x.alias("i"))))
    return F.concat("items", F.transform(tail, lambda s: s["i"]))


def rankings_from_ballots(ballots: DataFrame, seed: object = 0, expand: bool = True) -> DataFrame:
    """expand: a ranking for each vote, its tail in random order; else one for each ballot with its votes for a weight.
    ballots: (ballot_id, votes, items, tied_tail)."""
    if not expand:
        return ballots.select(F.col("ballot_id").cast("string").alias("ranking_id"), "items", F.col("votes").cast("double").alias("weight"))
    rows = ballots.where("votes > 0").withColumn("vote", F.explode(F.sequence(F.lit(1).cast("long"), F.col("votes"))))
    key = F.concat_ws(":", F.col("ballot_id").cast("string"), F.col("vote").cast("string"))
    return rows.withColumn("ranking_id", key).select("ranking_id", extend_ties(rows, key, seed).alias("items"), F.lit(1.0).alias("weight"))
