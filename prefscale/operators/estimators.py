"""Item utilities from rankings: one Spark pass over the rankings per iteration, or one in all and a small solve.

What comes to the driver is the pair table (at most items squared rows) or one number an item, never rankings. Fits
return params (component 0, item, theta), centred.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.functions import kernels as k
from prefscale.functions.links import Link, link as named_link
from prefscale.operators.breaking import pair_counts, pair_probs, weight_of
from prefscale.operators.lowrank import low_rank_model, nonnegative_factors, rankings_from_factors
from prefscale.session import kept, shared_folder, ship, written

PARAMS = ("component", "item", "theta")
#: Item-by-item tables are made and solved in one place up to this number of items.
MAX_ITEMS = 3_000


def params_frame(like: DataFrame, thetas: np.ndarray, items: list[int] | None = None) -> DataFrame:
    thetas = np.atleast_2d(thetas)
    names = list(range(thetas.shape[1])) if items is None else items
    rows = [(c, int(i), float(t)) for c, row in enumerate(thetas) for i, t in zip(names, row, strict=True)]
    return like.sparkSession.createDataFrame(rows, "component int, item int, theta double")


def check_dense(n: int) -> None:
    if n > MAX_ITEMS:
        raise ValueError(f"{n} items are too many for a dense table; the limit is {MAX_ITEMS}")


def wins_matrix(counts: DataFrame, n: int, value: str = "wins") -> np.ndarray:
    """wins[winner, loser] of the summed pair table."""
    check_dense(n)
    rows = counts.select("winner", "loser", value).toPandas()
    out = np.zeros((n, n))
    out[rows["winner"].to_numpy(int), rows["loser"].to_numpy(int)] = rows[value].to_numpy(float)
    return out


def probs_matrix(pairs: DataFrame, n: int) -> np.ndarray:
    return wins_matrix(pairs.select(F.col("item").alias("winner"), F.col("opponent").alias("loser"), F.col("p").alias("wins")), n)


def say_if_cut(settled: bool, turns: int) -> None:
    """A warning where a fit ended by its number of turns and not by its rule."""
    if not settled:
        warnings.warn(f"the fit has not settled in {turns} iterations", stacklevel=3)


#: Rankings of a packed block, and its columns: a matrix of items padded with -1, weights and hashes of ranking_id.
BLOCK_ROWS = 4_096
BLOCKS = "n_rows int, width int, item_matrix binary, weights binary, keys binary"


def packed_blocks(rankings: DataFrame) -> DataFrame:
    """Rankings of at least two items as rows of BLOCKS: each holds up to BLOCK_ROWS of like length, so that passes over
    them need no work per ranking."""
    ship(rankings.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
            starts, values = lists.offsets.to_numpy()[:-1], lists.values.to_numpy(zero_copy_only=False).astype(np.int32)
            weights, keys = batch.column("weight").to_numpy(zero_copy_only=False).astype(float), batch.column("key").to_numpy(zero_copy_only=False)
            kinds = np.frexp(sizes)[1]  # lengths up to the same power of two share a block
            for kind in np.unique(kinds[sizes > 1]):
                own = np.flatnonzero((kinds == kind) & (sizes > 1))
                for at in range(0, len(own), BLOCK_ROWS):
                    rows = own[at : at + BLOCK_ROWS]
                    places = np.arange(sizes[rows].max())
                    there = places < sizes[rows][:, None]
                    idx = np.where(there, values[np.where(there, starts[rows][:, None] + places, 0)], -1).astype("<i4")
                    cells = [len(rows), len(places), idx.tobytes(), weights[rows].astype("<f8").tobytes(), keys[rows].astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], BLOCK_NAMES)

    rows = rankings.select(F.col("items").cast("array<int>"), weight_of(rankings).alias("weight"), F.xxhash64("ranking_id").alias("key"))
    return rows.mapInArrow(work, BLOCKS)


BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


@contextmanager
def held_blocks(rankings: DataFrame) -> Iterator[DataFrame]:
    """``rankings`` packed and held while passes go over them; what is packed already stays as it is."""
    if rankings.columns == BLOCK_NAMES:
        yield rankings
        return
    with kept(packed_blocks(rankings)) as rows:
        yield rows


#: Up to so many sums of all tasks together come to the driver as they are; more are added by a shuffle first.
DIRECT_SUMS = 1 << 21


def pass_over(rankings: DataFrame, n: int, work, kinds: int = 1, keyed: bool = False) -> np.ndarray:
    """Sums over all rankings of what ``work(idx, weight)`` gives for a block: an array of ``kinds`` numbers, added per task,
    then on the driver or, if tasks times kinds are many, by a groupBy over its places. One job of a task a core; rankings
    don't leave their tasks. keyed: ``work`` also gets a hash of each ranking_id. Passes that are repeated should be given ``held_blocks``."""
    blocks = rankings if rankings.columns == BLOCK_NAMES else packed_blocks(rankings)

    def block(total: np.ndarray, rows: int, width: int, items, weights, keys) -> None:
        idx = np.frombuffer(items, "<i4").reshape(rows, width).astype(np.int64)
        own = [np.frombuffer(keys, "<i8")] if keyed else []
        total += np.ravel(work(idx, np.frombuffer(weights, "<f8"), *own))

    tasks = blocks.rdd.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)
    if kinds * tasks.getNumPartitions() <= DIRECT_SUMS:

        def sums(parts: Iterator[Row]) -> Iterator[bytes]:
            total = np.zeros(kinds)
            for part in parts:
                block(total, *part)
            yield total.astype("<f8").tobytes()

        # an RDD keeps its plan from pass to pass, which as a DataFrame takes longer than the pass
        return sum((np.frombuffer(x, "<f8") for x in tasks.mapPartitions(sums).collect()), np.zeros(kinds))

    def total_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(kinds)
        for batch in batches:
            for rows, width, *cells in zip(*[batch.column(c) for c in BLOCK_NAMES], strict=True):
                block(total, rows.as_py(), width.as_py(), *[c.as_buffer() for c in cells])
        return total

    return added(blocks.coalesce(tasks.getNumPartitions()), total_of, kinds)


def added(rows: DataFrame, total_of, kinds: int) -> np.ndarray:
    """The sum over tasks of ``total_of(batches)``, an array of ``kinds`` numbers that a task makes of its Arrow batches."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([total_of(batches).astype("<f8").tobytes()])], ["v"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = total_of(batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

    out = np.zeros(kinds)
    if kinds * rows.rdd.getNumPartitions() <= DIRECT_SUMS:
        for v in rows.mapInArrow(whole, "v binary").toArrow()["v"]:
            out += np.frombuffer(v.as_buffer(), "<f8")
        return out
    sums = rows.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return out


def rank_centrality(rankings: DataFrame, n: int, nu: float = 1.0, max_iters: int = 1000, eps: float = 1e-12) -> DataFrame:
    """Stationary distribution of a walk from losers to winners over smoothed shares; theta = ln of it. Above MAX_ITEMS
    the walk goes over the table of pairs, a join and a sum a step."""
    if n > MAX_ITEMS:
        rates = pair_probs(pair_counts(rankings), "all", nu).select(F.col("opponent").alias("src"), F.col("item").alias("dst"), F.col("p").alias("rate"))
        return walked(rates, n, max_iters, eps).select(*PARAMS)
    wins = wins_matrix(pair_counts(rankings), n)
    pi = k.power_iteration(k.chain(k.shares_of(wins, nu)), max_iters, eps)
    return params_frame(rankings, k.centred(np.log(pi)))


#: Steps of a walk between two cuts of its lineage, at which it is also seen whether it has settled.
STEPS_A_CUT = 10


def walked(rates: DataFrame, n: int, max_iters: int, eps: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, component, item, theta, iterations, converged) from the stationary distribution of a chain with these rates
    (keys, src, dst, rate), one per key, by power iteration on tables: as ``kernels.chain`` and
    ``kernels.power_iteration``. The table of steps stays partitioned by where they start, so only the n shares (a key)
    are shuffled."""
    keys = list(keys)
    rates = written(rates.where("src <> dst and rate > 0"))
    out = rates.groupBy(*keys, "src").agg(F.sum("rate").alias("out"))
    top = out.groupBy(*keys).agg(F.max("out").alias("top"))
    items = rates.sparkSession.range(n).select(F.col("id").cast("int").alias("item"))
    every = rates.select(*keys).distinct().crossJoin(items) if keys else items
    parts = [*keys, "src"]
    stay = every.withColumnRenamed("item", "src").join(out, parts, "left")
    stay = stay.join(top, keys) if keys else stay.crossJoin(F.broadcast(top))  # one row a key
    stay = stay.select(*parts, F.col("src").alias("dst"), (1 - F.coalesce("out", F.lit(0.0)) / F.col("top")).alias("p"))
    moves = rates.join(top, keys) if keys else rates.crossJoin(F.broadcast(top))
    moves = moves.select(*keys, F.col("src").cast("int"), F.col("dst").cast("int"), (F.col("rate") / F.col("top")).alias("p"))
    pi, done, turn = written(every.withColumn("pi", F.lit(1.0 / n))), False, 0
    with kept(written(moves.unionByName(stay)).repartition(*parts)) as steps:
        while not done and turn < max_iters:
            last = pi
            for _ in range(min(STEPS_A_CUT, max_iters - turn)):
                last, turn = pi, turn + 1
                pi = last.withColumnRenamed("item", "src").join(steps, parts).groupBy(*keys, F.col("dst").alias("item")).agg(F.sum(F.col("pi") * F.col("p")).alias("pi"))
            both = written(pi.join(last.withColumnRenamed("pi", "old"), [*keys, "item"]))
            pi = both.select(*keys, "item", "pi")
            far = both.groupBy(*keys).agg(F.sqrt(F.sum(F.pow(F.col("pi") - F.col("old"), F.lit(2.0)))).alias("far"))
            done = (far.agg(F.max("far")).first()[0] or 0.0) < eps
    say_if_cut(done, max_iters)
    mean = F.avg(F.log("pi")).over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))  # a row an item
    return pi.select(*keys, F.lit(0).alias("component"), "item", (F.log("pi") - mean).alias("theta"), F.lit(turn).cast("long").alias("iterations"), F.lit(done).alias("converged"))


def rank_centrality_from_probs(pairs: DataFrame, n: int, lambd: float = 0.0, max_iters: int = 1000, eps: float = 1e-12) -> DataFrame:
    if n > MAX_ITEMS:
        return walked(pairs.select(F.col("opponent").alias("src"), F.col("item").alias("dst"), (F.col("p") + lambd).alias("rate")), n, max_iters, eps).select(*PARAMS)
    p = probs_matrix(pairs, n)
    met = (p + p.T) > 0
    pi = k.power_iteration(k.chain(np.where(met, p.T + lambd, 0.0)), max_iters, eps)
    return params_frame(pairs, k.centred(np.log(pi)))


def luce_spectral(rankings: DataFrame, n: int, nu: float = 0.01, max_iters: int = 5_000, tol: float = 1e-8) -> DataFrame:
    """Luce spectral ranking: flows at the current estimate, the chain's stationary distribution, until it settles. Above
    MAX_ITEMS items the flows are a table of the pairs that occur (``luce_spectral_sparse``)."""
    if n > MAX_ITEMS:
        return luce_spectral_sparse(rankings, n, nu, max_iters, tol)
    pi = np.full(n, 1 / n)
    with held_blocks(rankings) as rows:
        for _ in range(max_iters):
            theta = np.log(pi)
            rates = pass_over(rows, n, lambda idx, w, theta=theta: k.flows(theta, idx, w), n * n).reshape(n, n)
            new = k.stationary(k.smooth_flows(rates, nu))
            done = np.linalg.norm(new - pi) < tol
            pi = new
            if done:
                break
    say_if_cut(done, max_iters)
    return params_frame(rankings, k.centred(np.log(pi)))


#: Pairs that a task sums up before it hands them on.
HELD_PAIRS = 1 << 20
#: Numbers of a slice of sums that tasks hand on together.
SLICE = 1 << 14


def repeated_pairs(blocks: DataFrame) -> DataFrame:
    """As rows of BLOCKS without keys, of width 2: pairs of different items that stand together in more than one ranking, with
    how much more than a pair that one has beaten the other in only counts for (all times, if both have). Tasks sum up at
    most HELD_PAIRS pairs at a time, and only sums are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ups, size = [], [], 0
        for batch in batches:
            for rows, width, items, weights in zip(*[batch.column(c) for c in BLOCK_NAMES[:4]], strict=True):
                idx = np.frombuffer(items.as_buffer(), "<i4").reshape(rows.as_py(), width.as_py()).astype(np.int64)
                idx = idx[np.frombuffer(weights.as_buffer(), "<f8") > 0]
                for t in range(idx.shape[1] - 1):
                    one, two = np.broadcast_to(idx[:, t : t + 1], idx[:, t + 1 :].shape), idx[:, t + 1 :]
                    use = (two >= 0) & (two != one)
                    one, two = one[use], two[use]
                    keys, ups, size = [*keys, np.minimum(one, two) << 32 | np.maximum(one, two)], [*ups, one < two], size + len(one)
                    if size >= HELD_PAIRS:
                        yield as_batch(keys, ups)
                        keys, ups, size = [], [], 0
        if size:
            yield as_batch(keys, ups)

    def as_batch(keys: list[np.ndarray], ups: list[np.ndarray]) -> pa.RecordBatch:
        own, at = np.unique(np.concatenate(keys), return_inverse=True)
        up, every = np.bincount(at, np.concatenate(ups), len(own)).astype(np.int64), np.bincount(at, minlength=len(own))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (own, up, every - up)], ["pair", "up", "down"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "more"))
            if len(pair):
                idx = np.stack([pair >> 32, pair & 0xFFFFFFFF], 1).astype("<i4")
                cells = [len(pair), 2, idx.tobytes(), more.astype("<f8").tobytes(), None]
                yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], BLOCK_NAMES)

    sums = blocks.mapInArrow(work, "pair long, up long, down long").groupBy("pair").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    more = F.col("up") + F.col("down") - F.when((F.col("up") == 0) | (F.col("down") == 0), 1).otherwise(0)
    return sums.where("up + down > 1").select("pair", more.alias("more")).mapInArrow(packed, BLOCKS)


def chain_sums(blocks: DataFrame, pi: np.ndarray, nu: float) -> tuple[np.ndarray, np.ndarray]:
    """What flows into each item at the shares ``pi``, and at which rate it is left: by the rankings in ``blocks``, and by nu both
    ways between items that met, from which the ``repeated_pairs`` among the blocks are taken off again. One job; tasks add
    slices of their sums before these reach the driver."""
    n = len(pi)

    def work(parts: Iterator[Row]) -> Iterator[tuple[int, np.ndarray]]:
        total, met = np.zeros((2, n)), np.zeros(n, np.int64)
        into, rate = total
        for rows, width, items, weights, keys in parts:
            idx, weight = np.frombuffer(items, "<i4").reshape(rows, width), np.frombuffer(weights, "<f8")
            if keys is None:
                for own, other in (idx.T, idx.T[::-1]):
                    np.subtract.at(into, own, nu * weight * pi[other])
                    np.subtract.at(met, own, weight.astype(np.int64))
                continue
            idx, weight = idx[weight > 0], weight[weight > 0][:, None]
            there, share = idx >= 0, np.append(pi, 0.0)[idx]
            s = np.cumsum(share[:, ::-1], 1)[:, ::-1]
            behind = np.concatenate([s[:, 1:], np.zeros((len(s), 1))], 1)
            chosen = np.concatenate([there[:, 1:], np.zeros((len(s), 1), bool)], 1)
            once = np.where(chosen, weight / np.where(there, s, 1.0), 0.0)
            np.add.at(into, idx[there], (once * behind + nu * (s[:, :1] - share))[there])
            np.add.at(rate, idx[there], (np.cumsum(once, 1) - once)[there])
            np.add.at(met, idx[there], np.broadcast_to(there.sum(1)[:, None] - 1, idx.shape)[there])
        rate += nu * met
        flat = total.ravel()
        for at in range(0, 2 * n, SLICE):
            if flat[at : at + SLICE].any():
                yield at, flat[at : at + SLICE]

    out = np.zeros(2 * n)
    tasks = blocks.rdd.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)
    sums = tasks.mapPartitions(work)
    for at, x in sums.reduceByKey(np.add).collect() if n > SLICE else sums.collect():
        out[at : at + SLICE] += x
    return out[:n], out[n:]


#: Steps that a fit is extrapolated from, and how many times a share may grow or shrink in a step.
STEPS_HELD, FURTHEST = 5, 16.0


def luce_spectral_sparse(rankings: DataFrame, n: int, nu: float = 0.01, max_iters: int = 5_000, tol: float = 1e-8) -> DataFrame:
    """``luce_spectral`` for many items, without a table of flows: what flows into an item and out of it at the present shares are
    sums over the rankings, one pass an iteration, and only pairs that met more than once have a row, for nu. An item's next
    share is what flows in over the rate at which it is left; steps are extrapolated from the last STEPS_HELD, until that
    makes the imbalance worse. The driver holds a few numbers an item. Settled when a step changes the estimate by less than
    ``tol`` of its own length. Items of no ranking keep an equal share; with nu = 0 each item must lose to some other and
    win against some, or it has no finite strength."""
    pi, done, held, last = np.full(n, 1 / n), False, [], np.inf
    with held_blocks(rankings) as rows, kept(rows.unionByName(repeated_pairs(rows)) if nu else rows) as blocks:
        for _ in range(max_iters):
            into, rate = chain_sums(blocks, pi, nu)
            if np.any((rate <= 0) & (into > 1e-12 * pi)):
                raise ValueError("some items never lose, so their strength has no bound; give a nu above 0")
            use = rate > 0
            flow = pi * rate
            balance = np.abs(into - flow)[use].sum() / max(flow.sum(), 1e-300)
            change = np.log(np.clip(into[use] / np.maximum(flow[use], 1e-300), 1 / FURTHEST, FURTHEST))
            far = np.linalg.norm(pi[use] * np.expm1(change)) / np.linalg.norm(pi)
            done = bool(far < tol and balance < tol)
            here = np.log(pi[use])
            if not balance <= 2 * last:
                held, change = [], change / 2  # the start of a chain that swings
            held, last = [*held, (here, change)][-STEPS_HELD - 1 :], balance
            step = change
            if len(held) > 1 and not done:
                moved, bent = (np.diff(np.array(x), axis=0) for x in zip(*held, strict=True))
                step = change - np.linalg.lstsq(bent @ bent.T, bent @ change, rcond=1e-12)[0] @ (moved + bent)
            new = np.exp(np.clip(here + np.clip(step, -np.log(FURTHEST), np.log(FURTHEST)), np.log(1e-300), None))
            pi = pi.copy()
            pi[use] = new / new.sum() * (use.sum() / n)
            if done:
                break
    say_if_cut(done, max_iters)
    return params_frame(rankings, k.centred(np.log(pi)))


def luce_spectral_map(rankings: DataFrame, n: int, a0: float = 1.0, b0: float | None = None, max_iters: int = 5_000, tol: float = 1e-9) -> tuple[DataFrame, float]:
    """The same with a gamma prior, by its fixed point pi = (wins + a0 d) / (denominators + b0), where d is the mass of
    the prior's own state. Returns params and d."""
    b0 = float(n) if b0 is None else b0
    pi, d = np.full(n, 1 / (n + 1)), 1 / (n + 1)
    with held_blocks(rankings) as rows:
        wins = pass_over(rows, n, lambda idx, w: k.win_sums(idx, w, n), n)
        for _ in range(max_iters):
            theta = np.log(pi)
            den = pass_over(rows, n, lambda idx, w, theta=theta: k.denominators(theta, idx, w), n)
            new = (wins + a0 * d) / (den + b0)
            new_d = b0 * new.sum() / (a0 * n)
            total = new.sum() + new_d
            new, new_d = new / total, new_d / total
            done = np.linalg.norm(new - pi) < tol
            pi, d = new, new_d
            if done:
                break
    say_if_cut(done, max_iters)
    return params_frame(rankings, k.centred(np.log(pi))), float(d)


def luce_mm(rankings: DataFrame, n: int, alpha: float = 0.0, max_iters: int = 5_000, tol: float = 1e-9) -> DataFrame:
    """Minorise-maximise: theta = ln((wins + alpha) / (denominators + alpha)), until the change is small."""
    theta = np.zeros(n)
    with held_blocks(rankings) as rows:
        wins = pass_over(rows, n, lambda idx, w: k.win_sums(idx, w, n), n)
        for _ in range(max_iters):
            den = pass_over(rows, n, lambda idx, w, theta=theta: k.denominators(theta, idx, w), n)
            new = k.centred(np.log(np.maximum(wins + alpha, 1e-12) / np.maximum(den + alpha, 1e-12)))
            done = np.abs(new - theta).sum() <= tol * n
            theta = new
            if done:
                break
    say_if_cut(done, max_iters)
    return params_frame(rankings, theta)


def shares(counts: DataFrame, n: int, nu: float = 0.0, degenerate: bool = False) -> np.ndarray:
    wins = wins_matrix(counts, n)
    met = (wins + wins.T) > 0
    add = met & ((wins == 0) | (wins.T == 0)) if degenerate else met
    w = wins + nu * add
    total = w + w.T
    return np.where(met, w / np.where(total > 0, total, 1.0), 0.0)


def pair_gmm(rankings: DataFrame, n: int, link: str | Link = "logit", lambd: float = 0.0) -> DataFrame:
    return params_frame(rankings, k.fit_gmm(shares(pair_counts(rankings), n), named_link(link), lambd))


def pair_cml(rankings: DataFrame, n: int, link: str | Link = "logit", scheme: str = "full", lambd: float = 0.0, nu: float = 1.0, seed: object = 0, reg: str = "l1") -> DataFrame:
    """Composite likelihood, less lambda times the sum of |U| (``l1``) or half that of U^2 (``l2``)."""
    p = shares(pair_counts(rankings, scheme, seed), n, nu, degenerate=True)
    return params_frame(rankings, k.fit_cml(p, named_link(link), lambd, reg=reg))


def pair_least_squares(pairs: DataFrame, n: int, link: str | Link = "logit", lambd: float = 1.0) -> DataFrame:
    """pairs should leave out shares of 0 and 1 (``drop_extreme_pairs``)."""
    p = probs_matrix(pairs, n)
    return params_frame(pairs, k.fit_least_squares(p, p > 0, named_link(link), lambd))


def pair_low_rank(pairs: DataFrame, n: int, link: str | Link = "logit", rank: int = 2) -> DataFrame:
    """phi of the shares, cut to a low rank, its rows averaged."""
    p = probs_matrix(pairs, n)
    m = np.where(p > 0, named_link(link).np_phi(np.where(p > 0, p, 0.5)), 0.0)
    u, s, vt = np.linalg.svd(m)
    low = (u[:, :rank] * s[:rank]) @ vt[:rank]
    return params_frame(pairs, k.centred(low.mean(1)))


def pair_factorize(pairs: DataFrame, n: int, link: str | Link = "logit", rank: int = 2, lambd: float = 0.01, seed: int = 0) -> DataFrame:
    """Regularised completion of phi of the shares by alternating least squares; theta is an item's mean over all."""
    from pyspark.ml.recommendation import ALS

    rows = pairs.select(F.col("item").cast("int"), F.col("opponent").cast("int"), named_link(link).phi(F.col("p")).cast("float").alias("phi"))
    model = ALS(rank=rank, regParam=lambd, userCol="item", itemCol="opponent", ratingCol="phi", seed=seed).fit(rows)
    # the mean of an item's products with all others is its product with their mean: one row of ``rank`` numbers
    mean = model.itemFactors.select(F.posexplode("features").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("f"))
    dot = F.aggregate(F.zip_with("features", "f", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    theta = model.userFactors.join(F.broadcast(mean)).select(F.col("id").alias("item"), dot.alias("theta"))
    mean = theta.agg(F.avg("theta").alias("mean"))
    return theta.join(F.broadcast(mean)).select(F.lit(0).alias("component"), "item", (F.col("theta") - F.col("mean")).alias("theta"))


def pair_low_rank_model(pairs: DataFrame, link: str | Link = "logit", rank: int = 2, loss: str = "huber", penalty: str = "l1", lambd: float = 0.01, seed: object = 0, tol: float = 1e-6) -> DataFrame:
    """phi of the shares completed by ``low_rank_model``, with any of its losses and penalties; theta is an item's mean over
    all opponents."""
    entries = pairs.select(F.col("item").alias("row"), F.col("opponent").alias("col"), named_link(link).phi(F.col("p")).alias("value"))
    found = low_rank_model(entries, rank, loss, penalty, penalty, lambd, tol=tol, seed=seed)
    mean = F.array(*[F.avg(F.get("features", F.lit(k))) for k in range(rank)])  # an item's mean product is its product with the mean
    rows = found.rows.crossJoin(F.broadcast(found.cols.agg(mean.alias("mean"))))  # one row
    dot = F.aggregate(F.zip_with("features", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    theta = rows.select(F.col("id").cast("int").alias("item"), dot.alias("theta"))
    return theta.crossJoin(F.broadcast(theta.agg(F.avg("theta").alias("mean")))).select(F.lit(0).alias("component"), "item", (F.col("theta") - F.col("mean")).alias("theta"))


def tilted(mean: np.ndarray, var: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of a Gaussian times F: in closed form for the normal F, by quadrature for the logistic one."""
    if model == "probit":
        from prefscale.functions.links import log_normal_cdf_np

        z = mean / np.sqrt(1 + var)
        _, ratio = log_normal_cdf_np(z)
        return mean + ratio * var / np.sqrt(1 + var), np.maximum(var - ratio * (z + ratio) * var**2 / (1 + var), 1e-12)
    if model != "logit":
        raise ValueError(model)
    nodes, weights = np.polynomial.hermite_e.hermegauss(48)
    x = mean[:, None] + np.sqrt(var)[:, None] * nodes
    f = weights / (1 + np.exp(-np.clip(x, -500, 500)))
    whole = np.maximum(f.sum(1), 1e-300)
    first = (f * x).sum(1) / whole
    return first, np.maximum((f * np.square(x - first[:, None])).sum(1) / whole, 1e-12)


def pair_posterior(comparisons: DataFrame, alpha: float = 1.0, group_cols: list[str] | None = None, rounds: int = 2_000, model: str = "probit", tol: float = 1e-9) -> DataFrame:
    """(group columns, item, mean, variance, rounds, converged): Gaussian posterior of utilities, prior variance 1 / alpha,
    ``probit`` or ``logit`` comparisons, by expectation propagation with one site per distinct (winner, loser) and its
    multiplicity, damped by half, until no site moves by more than tol; converged is false if ``rounds`` didn't do.
    A group is at most MAX_ITEMS items, whatever the number of its comparisons."""
    ship(comparisons.sparkSession)
    cols = group_cols or ["_all"]
    rows = comparisons if group_cols else comparisons.withColumn("_all", F.lit(0))
    sites = rows.groupBy(*cols, "winner", "loser").agg(F.sum("weight" if "weight" in comparisons.columns else F.lit(1.0)).alias("n"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        items = np.unique(part[["winner", "loser"]].to_numpy())
        check_dense(len(items))
        a, b = np.searchsorted(items, part["winner"]), np.searchsorted(items, part["loser"])
        m, n = part["n"].to_numpy(float), len(items)
        tau, nu = np.zeros(len(a)), np.zeros(len(a))  # a site's precision and precision-mean of the difference
        done, turn = len(a) == 0, 0
        while not done and turn < rounds:
            prec = alpha * np.eye(n) + k.spread_pairs(a, b, m * tau, n)
            cov = np.linalg.inv(prec)
            mean = cov @ k.gradient_of(a, b, m * nu, n)
            var = cov[a, a] + cov[b, b] - 2 * cov[a, b]
            mu = mean[a] - mean[b]
            cav_tau = np.maximum(1 / var - tau, 1e-9)
            cav_mu = (mu / var - nu) / cav_tau
            new_mu, new_var = tilted(cav_mu, 1 / cav_tau, model)
            move = [np.maximum(1 / new_var - cav_tau, 0.0) - tau, new_mu / new_var - cav_mu * cav_tau - nu]
            tau, nu, turn = tau + 0.5 * move[0], nu + 0.5 * move[1], turn + 1
            done = max(np.abs(x).max() for x in move) <= tol
        prec = alpha * np.eye(n) + k.spread_pairs(a, b, m * tau, n)
        cov = np.linalg.inv(prec)
        out = pd.DataFrame({"item": items, "mean": cov @ k.gradient_of(a, b, m * nu, n), "variance": np.diag(cov), "rounds": turn, "converged": done})
        for c in cols:
            out.insert(0, c, part[c].iloc[0])
        return out[[*cols, "item", "mean", "variance", "rounds", "converged"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in cols], "item long, mean double, variance double, rounds long, converged boolean"])
    out = sites.groupBy(*cols).applyInPandas(one, schema)
    return out if group_cols else out.drop("_all")


def complete_ratings(ratings: DataFrame, rank: int = 30, iters: int = 30, num_items: int | None = None, seed: int = 0, joined: bool = False) -> DataFrame:
    """(ranking_id, items): full rankings for every user by a non-negative factorisation. Missing ratings are missing,
    not zeros; ``complete_ratings_zeros`` takes them as zeros. ratings: (user, item, rating). joined: items as texts."""
    from pyspark.ml.recommendation import ALS

    shared_folder(ratings.sparkSession)  # at its checkpoints the fit drops the shuffles before them
    model = ALS(rank=rank, maxIter=iters, nonnegative=True, userCol="user", itemCol="item", ratingCol="rating", seed=seed, checkpointInterval=2).fit(ratings)
    return rankings_from_factors(model.userFactors, model.itemFactors, num_items, joined)


def complete_ratings_zeros(ratings: DataFrame, rank: int = 30, num_items: int | None = None, seed: object = 0, tol: float = 1e-5, joined: bool = False) -> DataFrame:
    """The same with zeros where there is no rating, by ``nonnegative_factors``."""
    entries = ratings.select(F.col("user").alias("row"), F.col("item").alias("col"), F.col("rating").alias("value"))
    found = nonnegative_factors(entries, rank, tol=tol, seed=seed)
    return rankings_from_factors(found.rows, found.cols, num_items, joined)


#: Items of a block of ``score_grid``.
GRID_ITEMS = 4_096


def score_grid(user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """(user, item, score): every user (id, features) with every item (id, features), which is the result's own size.
    Items are packed in blocks of about GRID_ITEMS, and users meet each block by its number, so no side is sent whole."""
    blocks = max(1, -(-item_factors.count() // GRID_ITEMS))
    items = item_factors.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "features")).alias("all"))
    dot = lambda f: F.aggregate(F.zip_with("features", f, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    users = user_factors.select(F.col("id").alias("user"), "features", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"))
    rows = users.join(items, "block").select("user", "features", F.explode("all").alias("i"))
    return rows.select("user", F.col("i.id").alias("item"), dot(F.col("i.features")).alias("score"))
