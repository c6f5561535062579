"""Sampled rankings and comparisons: reproducible, as every draw is a hash of its keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.functions.hashing import hash_uniform
from prefscale.operators.prepare import hash_ranked


def noise_of(kind: str, u: Column) -> Column:
    """A draw from its uniform: gumbel (Plackett-Luce), exponential or logistic."""
    if kind == "gumbel":
        return -F.log(-F.log(u))
    if kind == "exponential":
        return -F.log(1 - u)
    if kind == "logistic":
        return F.log(u / (1 - u))
    raise ValueError(kind)


def normal_noise(seed: object, *keys: Column) -> Column:
    """A normal draw from two uniforms."""
    u, v = hash_uniform(f"{seed}/a", *keys), hash_uniform(f"{seed}/b", *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.lit(3.141592653589793) * v)


#: A noise by name, or a function from a uniform to a draw (an inverse distribution function).
Noise = str | Callable[[Column], Column]


def drawn(kind: Noise, seed: object, *keys: Column) -> Column:
    if callable(kind):
        return kind(hash_uniform(seed, *keys))
    return normal_noise(seed, *keys) if kind == "normal" else noise_of(kind, hash_uniform(seed, *keys))


def item_noise(noise: Noise | Mapping[int, Noise], seed: object, ranking: Column, item: Column) -> Column:
    """The draw of an item; of a mapping item -> noise its own, and for items that it lacks none."""
    if not isinstance(noise, Mapping):
        return drawn(noise, seed, ranking, item)
    own = [F.when(item == i, drawn(kind, seed, ranking, item)) for i, kind in noise.items()]
    return F.coalesce(*own, F.lit(0.0))


def item_array(params: DataFrame, *keys: str) -> DataFrame:
    """(component, other keys, model): items with thetas of a component, as one array."""
    return params.groupBy("component", *keys).agg(F.sort_array(F.collect_list(F.struct("item", "theta"))).alias("model"))


def sample_rankings(params: DataFrame, m: int, noise: Noise | Mapping[int, Noise] = "gumbel", seed: object = 0, menus: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(ranking_id, component, items): per component, and menu if given (menu_id, items), m rankings by falling
    utility plus noise: a name, an inverse distribution function as a Column function, or a mapping of items to either.
    ``keys`` are further columns of params (say a time) that tell models apart; they stay. Made within the row; menus
    are as large as they are."""
    base = item_array(params, *keys)
    if menus is not None:
        base = base.join(menus.select("menu_id", F.col("items").alias("menu")))
        base = base.withColumn("model", F.filter("model", lambda x: F.array_contains("menu", x["item"])))
    part = F.concat_ws(":", *[F.col(c).cast("string") for c in ("component", *keys, *(["menu_id"] if menus is not None else []))])
    rows = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("ranking_id", F.concat_ws(":", part, F.col("draw").cast("string")))
    return rows.select("ranking_id", "component", *keys, ranked(F.col("model"), noise, seed).alias("items"))


def ranked(model: Column, noise: Noise | Mapping[int, Noise], seed: object) -> Column:
    by = F.transform(model, lambda x: F.struct((-(x["theta"] + item_noise(noise, seed, F.col("ranking_id"), x["item"]))).alias("u"), x["item"].alias("item")))
    return F.transform(F.array_sort(by), lambda x: x["item"])


def sample_mixture_rankings(params: DataFrame, mixture: DataFrame, m: int, noise: Noise | Mapping[int, Noise] = "gumbel", seed: object = 0) -> DataFrame:
    """(ranking_id, component, items): m rankings, each of a component drawn by alpha."""
    upto = F.sum("alpha").over(W.orderBy("component").rowsBetween(W.unboundedPreceding, 0))
    spans = mixture.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("alpha"))
    last = spans.agg(F.max("component").alias("last"))
    models = item_array(params).join(spans, "component").join(last)
    rows = mixture.sparkSession.range(m).select(F.col("id").cast("string").alias("ranking_id")).withColumn("u", hash_uniform(f"{seed}/z", F.col("ranking_id")))
    rows = rows.join(F.broadcast(models), (F.col("u") >= F.col("from")) & ((F.col("u") < F.col("upto")) | (F.col("component") == F.col("last"))))
    return rows.select("ranking_id", "component", ranked(F.col("model"), noise, seed).alias("items"))


def sample_comparisons(pairs: DataFrame, draws: int, seed: object = 0) -> DataFrame:
    """(draw, winner, loser): outcomes of each unordered pair (item < opponent), item winning with probability p."""
    rows = pairs.where("item < opponent").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    won = hash_uniform(seed, F.col("item"), F.col("opponent"), F.col("draw")) < F.col("p")
    return rows.select("draw", F.when(won, F.col("item")).otherwise(F.col("opponent")).alias("winner"), F.when(won, F.col("opponent")).otherwise(F.col("item")).alias("loser"))


def sample_menu_rankings(rankings: DataFrame, menus: DataFrame, m: int, seed: object = 0) -> DataFrame:
    """(menu_id, draw, items): per menu, m rankings drawn with replacement and restricted to it.

    Rankings get a dense number by their hash order; a draw is a number by hash.
    """
    total = rankings.agg(F.count("*").alias("total"))
    numbered = hash_ranked(rankings, seed).select(F.col("rank").alias("n"), F.col("items").alias("whole"))
    draws = menus.select("menu_id", F.col("items").alias("menu")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).join(F.broadcast(total))
    draws = draws.withColumn("n", F.floor(hash_uniform(seed, F.col("menu_id"), F.col("draw")) * F.col("total")).cast("long"))
    return draws.join(numbered, "n").select("menu_id", "draw", F.filter("whole", lambda x: F.array_contains("menu", x)).alias("items"))
