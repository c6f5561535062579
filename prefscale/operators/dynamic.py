"""A model per time step: many fits at once, each on its step's pair table.

counts: (t, winner, loser, wins), for example of ``kernel_pair_counts``, which smooths over neighbouring steps. Up to
MAX_ITEMS items, neighbouring steps form a group; groups are solved side by side on the executors, and within one each fit
starts from the step before. Above that, all steps walk together over the table of their pairs. Results don't depend on the
grouping: what a start may leave open (the shares of items that were never compared with one another) is set apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscale.functions import kernels as k
from prefscale.functions.links import Link, link as named_link
from prefscale.operators.estimators import MAX_ITEMS, walked
from prefscale.session import ship

ESTIMATORS = ("rank_centrality", "bradley_terry", "gmm", "cml", "least_squares")
#: Rows of pairs that a group of steps may have.
GROUP_ROWS = 2_000_000
FITTED = "t long, item int, theta double, iterations long, converged boolean"


def linked_parts(met: np.ndarray) -> np.ndarray:
    """The smallest item of each item's part of the graph of compared pairs."""
    labels = np.arange(len(met))
    while True:
        near = np.minimum(labels, np.where(met, labels, len(met)).min(1, initial=len(met)))
        near = near[near]
        if (near == labels).all():
            return labels
        labels = near


def even_shares(pi: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """``pi`` scaled so that each part has its items' number as its share, as from an even start."""
    sizes, sums = np.bincount(parts, minlength=len(pi)), np.bincount(parts, pi, len(pi))
    return pi * (sizes / np.where(sums > 0, sums, 1.0))[parts] / len(pi)


def fit_step(wins: np.ndarray, start: np.ndarray | None, estimator: str, link: Link, nu: float, lambd: float, max_iters: int, eps: float) -> tuple[np.ndarray, int | None, bool | None]:
    """(theta, iterations, whether it settled) of one step's wins[winner, loser]; the last two null for Newton's method."""
    n = len(wins)
    met = (wins + wins.T) > 0
    if estimator in ("rank_centrality", "bradley_terry"):
        parts = linked_parts(met)
        pi = even_shares(np.full(n, 1 / n) if start is None else np.exp(start - start.max()), parts)
        smooth = wins + nu * met
        if estimator == "rank_centrality":
            steps = k.chain(k.shares_of(wins, nu))
            move = lambda pi: pi @ steps
        else:
            won, both = smooth.sum(1), smooth + smooth.T

            def move(pi: np.ndarray) -> np.ndarray:
                down = np.where(met, both / np.maximum(pi[:, None] + pi, 1e-300), 0.0).sum(1)
                return even_shares(np.where(down > 0, won / np.where(down > 0, down, 1.0), pi), parts)

        for turn in range(1, max_iters + 1):
            new = move(pi)
            change, pi = np.linalg.norm(new - pi), new
            if change < eps:
                return k.centred(np.log(np.maximum(pi, 1e-300))), turn, True
        return k.centred(np.log(np.maximum(pi, 1e-300))), max_iters, False
    p = np.where(met, (wins + nu * met) / np.where(met, wins + wins.T + 2 * nu, 1.0), 0.0)
    if estimator == "gmm":
        return k.fit_gmm(p, link, lambd, start), None, None
    if estimator == "cml":
        return k.fit_cml(p, link, lambd, start), None, None
    return k.fit_least_squares(p, met, link, lambd), None, None


def fit_over_time(counts: DataFrame, n: int, estimator: str = "rank_centrality", nu: float = 1.0, link: str | Link = "logit", lambd: float = 1e-3, max_iters: int = 100_000, eps: float = 1e-12, together: int | None = None) -> DataFrame:
    """(t, item, theta, iterations, converged): theta centred at each t for all ``n`` items; a t without counts has no rows.

    ``rank_centrality``: the walk over shares with nu added to compared pairs; ``bradley_terry``: maximum likelihood of the
    comparisons, by minorise-maximise; ``gmm``, ``cml``, ``least_squares``: as the ``pair_*`` fits, with a ridge lambd.
    together: how many neighbouring steps share a group. Rows with a null t or item are left out; counts of a pair that
    come in several rows are added.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(estimator)
    known = counts.where("t is not null and winner is not null and loser is not null and winner <> loser")
    known = known.select(F.col("t").cast("long"), F.col("winner").cast("int"), F.col("loser").cast("int"), F.col("wins").cast("double"))
    if n > MAX_ITEMS:
        if estimator != "rank_centrality":
            raise ValueError(f"{n} items are too many for {estimator}; the limit is {MAX_ITEMS}")
        return walks(known, n, nu, max_iters, eps)
    ship(counts.sparkSession)
    many = together or max(1, min(32, GROUP_ROWS // (n * n)))
    named = named_link(link)

    def group(part: pd.DataFrame) -> pd.DataFrame:
        out, start = [], None
        for t, rows in part.groupby("t", sort=True):
            wins = np.zeros((n, n))
            np.add.at(wins, (rows["winner"].to_numpy(), rows["loser"].to_numpy()), rows["wins"].to_numpy())
            start, turns, settled = fit_step(wins, start, estimator, named, nu, lambd, max_iters, eps)
            out.append(pd.DataFrame({"t": t, "item": np.arange(n, dtype=np.int32), "theta": start, "iterations": pd.array([turns] * n, "Int64"), "converged": pd.array([settled] * n, "boolean")}))
        return pd.concat(out)

    # summed before the shuffle, so a group has at most so many steps' pair tables
    summed = known.groupBy("t", "winner", "loser").agg(F.sum("wins").alias("wins"))
    return summed.groupBy(F.floor(F.col("t") / many).alias("g")).applyInPandas(group, FITTED)


def walks(counts: DataFrame, n: int, nu: float, max_iters: int, eps: float) -> DataFrame:
    """The same by walks on the tables of pairs, all steps at once."""
    pair = F.struct(F.col("t"), F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi"))
    up = F.sum(F.when(F.col("winner") < F.col("loser"), F.col("wins")).otherwise(0.0))
    both = counts.groupBy(pair.alias("p")).agg(up.alias("a"), F.sum("wins").alias("all")).where("all > 0")
    share = (F.col("a") + nu) / (F.col("all") + 2 * nu)
    way = lambda src, dst, p: F.struct(F.col(f"p.{src}").alias("src"), F.col(f"p.{dst}").alias("dst"), p.alias("rate"))
    rates = both.select("p.t", F.explode(F.array(way("hi", "lo", share), way("lo", "hi", 1 - share))).alias("w")).select("t", "w.*")
    return walked(rates, n, max_iters, eps, ["t"]).select("t", "item", "theta", "iterations", "converged")


def course_error(fitted: DataFrame, truth: DataFrame) -> DataFrame:
    """(t, err): squared distance of the fitted from the true utilities (t, item, theta), both centred, at each t."""
    true = truth.groupBy("t").agg(F.avg("theta").alias("mean")).join(truth, "t").select("t", "item", (F.col("theta") - F.col("mean")).alias("true"))
    return fitted.join(true, ["t", "item"]).groupBy("t").agg(F.sum(F.pow(F.col("theta") - F.col("true"), F.lit(2.0))).alias("err"))
