"""Fits over a grid of component numbers, data sizes and methods, scored on held-out rankings."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscale.operators.clustering import init_mixture
from prefscale.operators.estimators import held_blocks
from prefscale.operators.evaluate import mixture_log_likelihood
from prefscale.operators.mixture import fit_mixture
from prefscale.operators.prepare import split_rankings
from prefscale.session import kept

RESULT = "method string, k int, ratio double, m long, metric string, value double"


def evaluate_grid(rankings: DataFrame, n: int, ks: Sequence[int], ratios: Sequence[float], methods: Sequence[str] = ("mm",), seed: int = 119, max_iters: int = 5_000, start: str = "random", timings: bool = True) -> DataFrame:
    """(method, k, ratio, m, metric, value): per cell the validation and test log-likelihood, the number of iterations,
    whether the fit ended by its rule (1 or 0) and, if asked for, the seconds. The split is exact, and the prefixes of the
    train set are exact and nested. Each prefix is packed once and held for all its cells."""
    with kept(split_rankings(rankings, seed=seed)) as parts:
        return rankings.sparkSession.createDataFrame(cells(parts, n, ks, ratios, methods, seed, max_iters, start, timings), RESULT)


def cells(parts: DataFrame, n: int, ks: Sequence[int], ratios: Sequence[float], methods: Sequence[str], seed: int, max_iters: int, start: str, timings: bool) -> list[tuple]:
    train, held = parts.where("part = 'train'"), {p: parts.where(F.col("part") == p) for p in ("val", "test")}
    whole, rows = train.count(), []
    for ratio in ratios:
        m = int(whole * ratio)
        prefix = train.where(F.col("rank") < m)
        with held_blocks(prefix) as blocks:
            for k in ks:
                first = init_mixture(prefix, k, n, start, seed)
                for method in methods:
                    began = time.time()
                    fit = fit_mixture(blocks, k, n, method, first, max_iters=max_iters, c=1.1, d=0.1)
                    cell = {"iterations": float(fit.iterations), "converged": float(fit.converged)}
                    if timings:
                        cell["seconds"] = time.time() - began
                    for name, part in held.items():
                        cell[f"{name}_ll"] = mixture_log_likelihood(part, fit.params(parts), fit.mixture(parts)).first()["ll"]
                    rows += [(method, k, float(ratio), m, metric, value) for metric, value in cell.items()]
    return rows
