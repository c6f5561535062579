"""Clusters of rankings by their pair vectors, and starts for mixtures from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscale.functions import kernels as k
from prefscale.functions.hashing import mixed
from prefscale.operators.breaking import full_pairs, weight_of
from prefscale.operators.estimators import check_dense
from prefscale.operators.mixture import random_start
from prefscale.session import kept, ship

#: Vectors up to this length get a Gram matrix; beyond it their leading directions are found by iterated passes.
MAX_DIM = 5_000


def pair_vectors(idx: np.ndarray, n: int) -> np.ndarray:
    """One entry for each pair i < j: one half if i is ahead, minus one half if behind, 0 if either isn't ranked."""
    pos = np.full((len(idx), n), np.nan)
    rows, cols = np.nonzero(idx >= 0)
    pos[rows, idx[rows, cols]] = cols
    i, j = np.triu_indices(n, 1)
    return np.nan_to_num(np.sign(pos[:, j] - pos[:, i]) / 2)


#: Numbers of a sketch, and entries (rankings x items) that are sketched at a time.
SKETCH_WIDTH, SKETCH_CELLS = 1_024, 1 << 16


def pair_sketch(idx: np.ndarray, width: int = SKETCH_WIDTH) -> np.ndarray:
    """``pair_vectors`` folded to ``width`` numbers by a count sketch, without ever being written out: a hash of the pair says
    where its entry is added and with which sign. Inner products stay right on the mean, with a variance of about the
    product of the squared lengths over the width. Items may have any ids."""
    out = np.zeros((len(idx), width))
    many = max(1, SKETCH_CELLS // max(1, idx.shape[1]))
    for at in range(0, len(idx), many):
        some = idx[at : at + many].astype(np.uint64)
        there = idx[at : at + many] >= 0
        row = np.arange(len(some))[:, None] * width
        total = np.zeros(len(some) * width)
        for t in range(some.shape[1] - 1):
            ahead, behind, use = some[:, t : t + 1], some[:, t + 1 :], there[:, t + 1 :]
            key = mixed(mixed(np.minimum(ahead, behind)) ^ (np.maximum(ahead, behind) * np.uint64(0x9E3779B97F4A7C15)))
            place = row + (key % np.uint64(width)).astype(np.int64)
            sign = np.where(ahead < behind, 0.5, -0.5) * np.where(key >> np.uint64(63), 1.0, -1.0)
            total += np.bincount(place[use], sign[use], len(total))
        out[at : at + many] = total.reshape(len(some), width)
    return out


#: What makes a ranking's vector: a name, or a function from the items' Column to an array of numbers.
Embedding = str | Callable[[Column], Column]


#: Vectors that a task makes at a time.
VECTOR_ROWS = 256


@dataclass
class Vectors:
    """Rankings as vectors, made in the task that uses them, VECTOR_ROWS at a time: ``rows`` (ranking_id, v,
    weight) have what ``matrix`` makes them from."""

    rows: DataFrame
    matrix: Callable[[pa.ListArray], np.ndarray]

    def cache(self) -> Vectors:
        return Vectors(self.rows.cache(), self.matrix)

    def moved(self, to: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """(ranking_id, v) with v as ``to`` gives it."""

        matrix = self.matrix

        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, _ in made(parts, matrix):
                y = np.ascontiguousarray(to(x), float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([ids, lists], ["ranking_id", "v"])

        return self.rows.mapInArrow(work, f"ranking_id {self.rows.schema['ranking_id'].dataType.simpleString()}, v array<double>")


def made(parts: Iterator[pa.RecordBatch], matrix: Callable[[pa.ListArray], np.ndarray]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, vectors, weights), VECTOR_ROWS at a time."""
    for part in parts:
        for at in range(0, part.num_rows, VECTOR_ROWS):
            some = part.slice(at, VECTOR_ROWS)
            yield some.column("ranking_id"), matrix(some.column("v")), some.column("weight").to_numpy(zero_copy_only=False).astype(float)


def places(lists: pa.ListArray) -> np.ndarray:
    """The lists as a matrix of their numbers, padded with -1."""
    starts, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    at = np.arange(sizes.max(initial=0))
    there = at < sizes[:, None]
    return np.where(there, lists.values.to_numpy(zero_copy_only=False)[np.where(there, starts[:, None] + at, 0)] if there.any() else 0, -1)


def embedded(rankings: DataFrame, n: int, embedding: Embedding, width: int = SKETCH_WIDTH) -> tuple[Vectors, int]:
    """The vectors of the rankings that have items, and their length. ``sketch``: of ``width`` numbers, however many items there are; the others
    have one for each pair of items."""
    ship(rankings.sparkSession)
    rows = rankings.where(F.size("items") > 0).select("ranking_id", "items", weight_of(rankings).cast("double").alias("weight"))
    if callable(embedding):
        rows = rows.select("ranking_id", embedding(F.col("items")).cast("array<double>").alias("v"), "weight")
        first = rows.select(F.size("v").alias("k")).first()
        dim = first["k"] if first else 0
        return Vectors(rows, lambda lists: lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), dim)), dim
    if embedding not in ("signed", "disjoint", "sketch"):
        raise ValueError(embedding)
    rows = rows.select("ranking_id", F.col("items").cast("array<long>").alias("v"), "weight")
    if embedding == "sketch":
        return Vectors(rows, lambda lists: pair_sketch(places(lists), width)), width
    return Vectors(rows, lambda lists: pair_vectors(places(lists), n)), n * (n - 1) // 2


def summed(vectors: Vectors, work, size: int) -> np.ndarray:
    """Sums over all vectors of the array that ``work(x, weight)`` gives for a batch."""
    matrix = vectors.matrix

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x, weight in made(parts, matrix):
            total += work(x, weight).ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "x"])

    rows = vectors.rows.mapInArrow(partial, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[rows["at"].to_numpy()] = rows["x"].to_numpy()
    return out


def leading(vectors: Vectors, dim: int, components: int, centred: bool = False, rounds: int = 1_000, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of X'X (or of the weighted covariance), their vectors, and the trace.

    Up to MAX_DIM entries from the whole matrix, summed in one pass; beyond it by subspace iteration, a pass each, of
    which only dim x (components + 8) numbers a task travel, until the values settle; if ``rounds`` don't do, it raises.
    """
    if dim <= MAX_DIM:
        sums = summed(vectors, lambda x, w: np.concatenate([((x * w[:, None]).T @ x).ravel(), w @ x, [w.sum()]]), dim * dim + dim + 1)
        g, s, m = sums[: dim * dim].reshape(dim, dim), sums[dim * dim : -1], max(sums[-1], 1e-300)
        g = g / m - np.outer(s, s) / m**2 if centred else g
        values, basis = np.linalg.eigh(g)
        order = np.argsort(values)[::-1][:components]
        return values[order], basis[:, order], float(np.trace(g))
    width = min(dim, components + 8)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    values = np.zeros(width)
    for _ in range(rounds):
        sums = summed(vectors, lambda x, w, q=basis: np.concatenate([(x.T @ (w[:, None] * (x @ q))).ravel(), w @ x, [w.sum(), (w * (x * x).sum(1)).sum()]]), dim * width + dim + 2)
        y, s, m, trace = sums[: dim * width].reshape(dim, width), sums[dim * width : -2], max(sums[-2], 1e-300), sums[-1]
        if centred:
            y, trace = y / m - np.outer(s, s @ basis) / m**2, trace / m - s @ s / m**2
        new, turn = np.linalg.eigh(basis.T @ y)
        order = np.argsort(new)[::-1]
        settled = np.abs(new[order] - values)[:components].max() <= 1e-9 * max(abs(new).max(), 1e-300)
        values, vectors_now = new[order], basis @ turn[:, order]
        if settled:
            break
        basis = np.linalg.qr(y)[0]
    else:
        raise RuntimeError(f"the leading directions did not settle in {rounds} passes")
    return values[:components], vectors_now[:, :components], float(trace)


def pair_weights_pca(rankings: DataFrame, n: int, degree: int = 10, max_w: float = 1.0) -> np.ndarray:
    """A weight for each pair: the components' absolute entries, by share of variance, scaled to max_w at most."""
    rows, dim = embedded(rankings, n, "signed")
    values, vectors, whole = leading(rows, dim, min(degree, dim), centred=True)
    w = (np.abs(vectors) * (np.maximum(values, 0) / max(whole, 1e-300))).sum(1)
    return w / max(w.max(), 1e-300) * max_w


def pair_matrix(weights: np.ndarray, n: int) -> np.ndarray:
    """Weights of pairs i < j as a symmetric table of items, as ``fit_mixture`` takes them."""
    out = np.zeros((n, n))
    out[np.triu_indices(n, 1)] = weights
    return out + out.T


def projection(vectors: Vectors, dim: int, components: int, reduce: str, lambd: float, seed: int) -> np.ndarray | None:
    """The matrix by which vectors are reduced; None if they stay."""
    rng = np.random.default_rng(seed)
    if reduce == "none":
        return None
    if reduce in ("rand_gauss", "rand_sparse"):
        to = min(dim, max(1, int(8 * np.log(max(2, vectors.rows.count())))))
        if reduce == "rand_gauss":
            return rng.normal(size=(dim, to)) / np.sqrt(to)
        return rng.choice([1.0, 0.0, -1.0], size=(dim, to), p=[1 / 6, 2 / 3, 1 / 6]) * np.sqrt(3 / to)
    if reduce == "nuclear":  # needs all singular values
        if dim > MAX_DIM:
            raise ValueError(f"vectors of {dim} entries are too long for reduce='nuclear'; the limit is {MAX_DIM}")
        values, v, _ = leading(vectors, dim, dim)
        s = np.sqrt(np.maximum(values, 0))
        return (v * (np.maximum(s - lambd, 0) / np.maximum(s, 1e-12))) @ v.T
    if reduce not in ("pca", "pca_scaled", "svd"):
        raise ValueError(reduce)
    values, top, _ = leading(vectors, dim, min(components, dim), seed=seed)
    if reduce == "pca":  # rows of U
        return top / np.maximum(np.sqrt(np.maximum(values, 0)), 1e-12)
    # rows of U S; distances of the rank-K reconstruction (svd) are the same in these coordinates
    return top


def cluster_rankings(rankings: DataFrame, components: int, n: int, embedding: Embedding = "signed", reduce: str = "pca_scaled", lambd: float = 1.0, seed: int = 0, width: int = SKETCH_WIDTH, centres: bool = True) -> tuple[DataFrame, np.ndarray | None]:
    """(ranking_id, label) and the centres, as shares in which an item is ahead of another per cluster. ``disjoint`` keeps
    only the coordinates of a random pairing of the items; a function makes its own vector from the items, for example
    ``lambda items: embed_positional(items, n)``. ``sketch`` is for many items: vectors of ``width`` numbers, whatever n is.
    The centres are items x items tables, of at most MAX_ITEMS items; centres=False leaves them out (None)."""
    if centres:
        check_dense(n)
    vectors, dim = embedded(rankings, n, embedding, width)
    to = projection(vectors, dim, components, reduce, lambd, seed)
    if embedding == "disjoint":
        use = np.zeros(dim, bool)
        at = {p: q for q, p in enumerate(zip(*np.triu_indices(n, 1), strict=True))}
        order = np.random.default_rng(seed).permutation(n)
        for a, b in order[: n // 2 * 2].reshape(-1, 2):
            use[at[min(a, b), max(a, b)]] = True
        to = use.astype(float)[:, None] * (np.eye(dim)[:, use] if to is None else to)
    shared = rankings.sparkSession.sparkContext.broadcast(to)  # entries x components; all of it for nuclear only
    rows = vectors.moved(lambda x: x if shared.value is None else x @ shared.value)
    points = rows.select("ranking_id", array_to_vector("v").alias("features"))
    with kept(points) as held:
        model = KMeans(k=components, seed=seed, maxIter=1_000).fit(held)  # until the centres stay
    labels = model.transform(points).select("ranking_id", F.col("prediction").alias("label"))
    if not centres:
        return labels, None
    return labels, cluster_centres(rankings.join(labels, "ranking_id"), components, n)


def cluster_centres(labelled: DataFrame, components: int, n: int) -> np.ndarray:
    """share[cluster, i, j] in which i is ahead of j; one pass for all clusters."""
    pairs = labelled.withColumn("weight", weight_of(labelled))
    rows = pairs.select("label", F.explode(full_pairs(F.col("items"))).alias("p"), "weight")
    counts = rows.groupBy("label", "p.winner", "p.loser").agg(F.sum("weight").alias("wins")).toPandas()
    out = np.zeros((components, n, n))
    out[counts["label"].to_numpy(int), counts["winner"].to_numpy(int), counts["loser"].to_numpy(int)] = counts["wins"].to_numpy(float)
    return out


def init_mixture(rankings: DataFrame, components: int, n: int, method: str = "rc", seed: int = 0, link: str = "logit", embedding: Embedding = "signed", reduce: str = "pca_scaled") -> np.ndarray:
    """Starting utilities: ``random``, or a fit per cluster: ``rc``, ``gmm``, ``lrmc`` (least squares), ``cml``."""
    from prefscale.functions.links import link as named_link

    if method == "random":
        return random_start(components, n, seed)
    _, wins = cluster_rankings(rankings, components, n, embedding, reduce, seed=seed)
    named, out = named_link(link), []
    for w in wins:
        met = (w + w.T) > 0
        p = np.where(met, (w + 1) / (w + w.T + 2), 0.0)
        if method == "rc":
            out.append(k.centred(np.log(k.power_iteration(k.chain(k.shares_of(w, 1.0)), 2000, 1e-12) + 1e-12)))
        elif method == "gmm":
            out.append(k.fit_gmm(p, named, 1e-3))
        elif method == "lrmc":
            out.append(k.fit_least_squares(p, met, named, 1.0))
        elif method == "cml":
            out.append(k.fit_cml(p, named, 1e-3, k.fit_least_squares(p, met, named, 1.0)))
        else:
            raise ValueError(method)
    return np.array(out)

