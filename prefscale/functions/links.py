"""Link functions between utility differences and choice probabilities: phi = F^-1, F and its density."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """phi, F and dF as Column functions; the same on NumPy arrays in ``np_*`` for fits on pair tables."""

    phi: Callable[[Column], Column]
    cdf: Callable[[Column], Column]
    pdf: Callable[[Column], Column]
    np_phi: Callable[[np.ndarray], np.ndarray]
    np_cdf: Callable[[np.ndarray], np.ndarray]
    np_pdf: Callable[[np.ndarray], np.ndarray]


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of an array: a series of positive terms near 0, a continued fraction beyond."""
    x = np.asarray(x, float)
    y = np.abs(x)
    near = y < 2.0
    t = np.where(near, y, 0.0)
    term, total = t, t
    for n in range(1, 60):
        term = term * 2 * t * t / (2 * n + 1)
        total = total + term
    z = np.where(near, 2.0, y)
    down = z
    for n in range(120, 0, -1):
        down = z + n / 2 / down
    out = np.where(near, 1 - 2 / math.sqrt(math.pi) * np.exp(-t * t) * total, np.exp(-z * z) / (down * math.sqrt(math.pi)))
    return np.where(x < 0, 2 - out, out)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, float) / math.sqrt(2))


def normal_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution by Newton steps on the cdf, from a logistic start."""
    p = np.asarray(p, float)
    x = np.log(p / (1 - p)) / 1.702
    for _ in range(60):
        step = np.clip((normal_cdf(x) - p) / np.maximum(normal_pdf(x), 1e-300), -1, 1)
        x = x - step
        if not np.any(np.abs(step) > 1e-14 * np.maximum(np.abs(x), 1)):
            break
    return x


def log_normal_cdf_np(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln Phi(z) and its derivative; for z far to the left by the asymptotic series of the tail."""
    z = np.asarray(z, float)
    near = np.maximum(z, -30.0)
    value = np.log(normal_cdf(near))
    far = z < -30.0
    y = 1 / np.square(np.where(far, z, -30.0))
    series = 1 - y + 3 * y**2 - 15 * y**3
    tail = -0.5 * np.square(z) - np.log(-np.where(far, z, -30.0)) - 0.5 * math.log(2 * math.pi) + np.log(series)
    value = np.where(far, tail, value)
    return value, np.exp(-0.5 * np.square(z) - 0.5 * math.log(2 * math.pi) - value)


def logit(sigma: float = 1.0) -> Link:
    cdf = lambda x: 1 / (1 + F.exp(-x / sigma))
    np_cdf = lambda x: 1 / (1 + np.exp(-np.clip(np.asarray(x) / sigma, -500, 500)))
    return Link(
        phi=lambda p: F.log(p / (1 - p)) * sigma,
        cdf=cdf,
        pdf=lambda x: cdf(x) * (1 - cdf(x)) / sigma,
        np_phi=lambda p: np.log(p / (1 - p)) * sigma,
        np_cdf=np_cdf,
        np_pdf=lambda x: np_cdf(x) * (1 - np_cdf(x)) / sigma,
    )


#: Terms of the series and levels of the continued fraction of the incomplete gamma function, and Newton steps of its inverse.
TERMS, NEWTON_STEPS = 120, 40


def log_upper_gamma(a: float, y: Column) -> Column:
    """ln Q(a, y), Q being the upper incomplete gamma function over the whole one, for a constant a > 0 and y >= 0: by the
    series of the lower one for y < a + 1, by a continued fraction beyond, where Q may be far too small for a double."""
    levels = F.sequence(F.lit(1), F.lit(TERMS))
    term = lambda acc, n: F.struct((acc["t"] * y / (n + a)).alias("t"), (acc["s"] + acc["t"] * y / (n + a)).alias("s"))
    total = F.aggregate(levels, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), term, lambda acc: acc["s"])
    lower = F.exp(a * F.log(y) - y - math.lgamma(a + 1)) * total
    down = F.aggregate(F.reverse(levels), y + 2 * TERMS + 1 - a, lambda f, k: y + 2 * k - 1 - a - k * (k - a) / f)
    return F.when(y <= 0, 0.0).when(y < a + 1, F.log1p(-lower)).otherwise(a * F.log(y) - y - math.lgamma(a) - F.log(down))


def np_log_upper_gamma(a: float, y: np.ndarray) -> np.ndarray:
    y = np.asarray(y, float)
    near = y < a + 1
    low = np.where(near & (y > 0), y, 1.0)
    term = total = np.ones_like(low)
    for n in range(1, TERMS + 1):
        term = term * low / (n + a)
        total = total + term
    lower = np.where(y > 0, np.exp(a * np.log(low) - low - math.lgamma(a + 1)) * total, 0.0)
    high = np.where(near, a + 1.0, y)
    down = high + 2 * TERMS + 1 - a
    for k in range(TERMS, 0, -1):
        down = high + 2 * k - 1 - a - k * (k - a) / down
    return np.where(near, np.log1p(-np.where(near, lower, 0.0)), a * np.log(high) - high - math.lgamma(a) - np.log(down))


def upper_place(beta: float, log_u: Column) -> Column:
    """The x >= 0 with ln Q(1 / beta, x^beta) = log_u, by Newton steps on that logarithm from 0 on. It is concave in x for
    beta >= 1 and convex below, so the steps come near from one side, after the first at the latest."""
    a, norm = 1 / beta, math.log(beta) - math.lgamma(1 / beta)

    def step(x: Column, _: Column) -> Column:
        y = F.pow(x, F.lit(beta))
        here = F.struct(log_upper_gamma(a, y).alias("q"), x.alias("x"), y.alias("y"))
        # the slope of ln Q is -density / Q, the density being beta / Gamma(1 / beta) e^-y
        return F.aggregate(F.array(here), x, lambda _x, h: F.greatest(h["x"] + (h["q"] - log_u) * F.exp(h["q"] + h["y"] - norm), F.lit(0.0)))

    return F.when(log_u.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step))


def np_upper_place(beta: float, log_u: np.ndarray) -> np.ndarray:
    a, norm = 1 / beta, math.log(beta) - math.lgamma(1 / beta)
    x = np.zeros_like(np.asarray(log_u, float))
    for _ in range(NEWTON_STEPS):
        y = np.power(x, beta)
        q = np_log_upper_gamma(a, y)
        x = np.maximum(x + (q - log_u) * np.exp(q + y - norm), 0.0)
    return x


def gennorm(beta: float, sigma: float = 1.0) -> Link:
    """The generalised normal of shape beta: its density falls by e^-|x / sigma|^beta. All of it is Column functions."""
    if beta == 1:
        return laplace(sigma)
    a, log_top = 1 / beta, math.log(beta / (2 * sigma)) - math.lgamma(1 / beta)

    def cdf(x: Column) -> Column:
        tail = F.exp(log_upper_gamma(a, F.pow(F.abs(x / sigma), F.lit(beta)))) / 2
        return F.when(x < 0, tail).otherwise(1 - tail)

    def np_cdf(x: np.ndarray) -> np.ndarray:
        tail = np.exp(np_log_upper_gamma(a, np.power(np.abs(np.asarray(x, float) / sigma), beta))) / 2
        return np.where(np.asarray(x) < 0, tail, 1 - tail)

    def np_phi(p: np.ndarray) -> np.ndarray:
        p = np.asarray(p, float)
        return np.where(p < 0.5, -sigma, sigma) * np_upper_place(beta, np.log(2 * np.minimum(p, 1 - p)))

    return Link(
        phi=lambda p: F.when(p < 0.5, -sigma).otherwise(sigma) * upper_place(beta, F.log(2 * F.least(p, 1 - p))),
        cdf=cdf,
        pdf=lambda x: F.exp(log_top - F.pow(F.abs(x / sigma), F.lit(beta))),
        np_phi=np_phi,
        np_cdf=np_cdf,
        np_pdf=lambda x: np.exp(log_top - np.power(np.abs(np.asarray(x, float) / sigma), beta)),
    )


def probit(sigma: float = 1.0) -> Link:
    """The normal of deviation sqrt(2) sigma, which is the generalised one of shape 2 and scale 2 sigma."""
    s, columns = math.sqrt(2) * sigma, gennorm(2.0, 2 * sigma)
    return replace(columns, np_phi=lambda p: normal_ppf(p) * s, np_cdf=lambda x: normal_cdf(x / s), np_pdf=lambda x: normal_pdf(x / s) / s)


def gumbel_ev(sigma: float = 1.0, c: float = 0.5) -> Link:
    """Generalised extreme values of shape c: F = exp(-(1 - c x / sigma)^(1/c)) below sigma / c, 1 above it."""
    inner = lambda x: F.greatest(1 - c * x / sigma, F.lit(0.0))
    np_inner = lambda x: np.maximum(1 - c * np.asarray(x) / sigma, 0.0)
    return Link(
        phi=lambda p: (1 - F.pow(-F.log(p), F.lit(c))) / c * sigma,
        cdf=lambda x: F.exp(-F.pow(inner(x), F.lit(1 / c))),
        pdf=lambda x: F.exp(-F.pow(inner(x), F.lit(1 / c))) * F.pow(inner(x), F.lit(1 / c - 1)) / sigma,
        np_phi=lambda p: (1 - np.power(-np.log(p), c)) / c * sigma,
        np_cdf=lambda x: np.exp(-np.power(np_inner(x), 1 / c)),
        np_pdf=lambda x: np.exp(-np.power(np_inner(x), 1 / c)) * np.power(np_inner(x), 1 / c - 1) / sigma,
    )


def laplace(sigma: float = 1.0) -> Link:
    """The generalised normal of shape 1."""
    return Link(
        phi=lambda p: F.when(p < 0.5, F.log(2 * p)).otherwise(-F.log(2 * (1 - p))) * sigma,
        cdf=lambda x: F.when(x < 0, F.exp(x / sigma) / 2).otherwise(1 - F.exp(-x / sigma) / 2),
        pdf=lambda x: F.exp(-F.abs(x) / sigma) / (2 * sigma),
        np_phi=lambda p: np.where(p < 0.5, np.log(2 * p), -np.log(2 * (1 - p))) * sigma,
        np_cdf=lambda x: np.where(np.asarray(x) < 0, np.exp(np.minimum(x, 0) / sigma) / 2, 1 - np.exp(-np.maximum(x, 0) / sigma) / 2),
        np_pdf=lambda x: np.exp(-np.abs(x) / sigma) / (2 * sigma),
    )


NAMED: dict[str, Callable[..., Link]] = {"logit": logit, "probit": probit, "gumbel_ev": gumbel_ev, "gennorm": gennorm, "laplace": laplace}


def link(which: str | Link, **options: float) -> Link:
    """A named link, or one that the caller has made."""
    return which if isinstance(which, Link) else NAMED[which](**options)


def log_normal_cdf(z: Column) -> Column:
    """ln Phi(z), however far to the left."""
    tail = log_upper_gamma(0.5, z * z / 2) - math.log(2)
    return F.when(z < 0, tail).otherwise(F.log1p(-F.exp(tail)))
