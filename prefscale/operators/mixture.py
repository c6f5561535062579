"""Mixtures of Plackett-Luce models by EM: one Spark job per iteration.

A job computes, batch by batch, the posterior of each ranking under the current model and adds up what the next step
needs (wins, denominators, flows or pair weights per component); only these sums leave the tasks, so the driver holds
as much as the model does, however many rankings there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefscale.functions import kernels as k
from prefscale.functions.hashing import key_streams, stream_uniforms
from prefscale.functions.links import Link, link as named_link
from prefscale.operators.breaking import pair_moments
from prefscale.operators.estimators import BLOCK_NAMES, check_dense, held_blocks, params_frame, pass_over, say_if_cut, wins_matrix
from prefscale.operators.evaluate import responsibilities

STEPS = ("mm", "spectral", "map", "gmm", "cml", "surrogate")


@dataclass
class MixtureFit:
    thetas: np.ndarray
    alpha: np.ndarray
    log_likelihood: list[float] = field(default_factory=list)
    #: Whether the stop rule held, or max_iters came first.
    converged: bool = False

    @property
    def iterations(self) -> int:
        return len(self.log_likelihood)

    def params(self, like: DataFrame) -> DataFrame:
        return params_frame(like, self.thetas)

    def mixture(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.createDataFrame([(c, float(a)) for c, a in enumerate(self.alpha)], "component int, alpha double")


def start_array(start: np.ndarray | DataFrame | None, components: int, n: int, seed: int) -> np.ndarray:
    """Starting utilities: given as an array or as params (component, item, theta; items left out start at 0), or random."""
    if start is None:
        return random_start(components, n, seed)
    if not isinstance(start, DataFrame):
        return np.array(start, float)
    out = np.zeros((components, n))
    for r in start.where((F.col("component") < components) & (F.col("item") < n)).collect():  # as large as the model
        out[r["component"], r["item"]] = r["theta"]
    return out


def random_start(components: int, n: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed).normal(size=(components, n))
    return draw - draw.mean(1, keepdims=True)


def spectral_step(flows: np.ndarray, nu: float) -> np.ndarray:
    return k.centred(np.log(k.stationary(k.smooth_flows(flows, nu))))


def pair_log_likelihood(thetas: np.ndarray, idx: np.ndarray, link: Link, pair_weights: np.ndarray | None = None) -> np.ndarray:
    """(rankings, components): each ranking as independent comparisons, weighted by their pair if asked for."""
    out = np.zeros((len(idx), len(thetas)))
    for c, theta in enumerate(thetas):
        u = theta[np.maximum(idx, 0)]
        for t in range(idx.shape[1] - 1):
            there = idx[:, t + 1 :] >= 0
            w = 1.0 if pair_weights is None else pair_weights[np.maximum(idx[:, t : t + 1], 0), np.maximum(idx[:, t + 1 :], 0)]
            out[:, c] += np.where(there, w * np.log(np.maximum(link.np_cdf(u[:, t : t + 1] - u[:, t + 1 :]), 1e-300)), 0.0).sum(1)
    return out


#: Steps that a fit goes plainly before it is accelerated.
PLAIN_STEPS = 10
#: How many times the squared change may be after a jump what it was before, in fits of pair tables: where parts of a step shrink
#: slowly a jump stirs up those that shrink fast, which the next steps mend. From so many iterations on it is less, lest a fit
#: should go round in circles.
STIRRED, LATER_STIRRED, LATER = 64.0, 4.0, 500


class Jumps:
    """Squared extrapolation of a fixed point x = F(x): after every two steps, x goes on the way that they bend to, so many
    times as far as they shrink slowly. Unlike Newton's steps these lead away from saddles, as the steps do. A jump that makes
    things worse is taken back (``back``), and the next ones are shorter."""

    def __init__(self):
        self.x: list[np.ndarray] = []
        self.longest, self.jumped, self.plain = 4.0, False, np.zeros(0)

    def next(self, x: np.ndarray, image: np.ndarray) -> np.ndarray:
        if self.jumped:  # a step from where the jump led to, before the next two
            self.x, self.jumped = [], False
            return image
        self.x, self.plain = [*self.x, x], image
        if len(self.x) < 2:
            return image
        first, second = self.x
        step, bend = second - first, image - 2 * second + first
        length = max(1.0, min(self.longest, float(np.linalg.norm(step) / max(np.linalg.norm(bend), 1e-300))))
        if length == self.longest:
            self.longest *= 4
        self.x, self.jumped = [], length > 1
        return first + 2 * length * step + length**2 * bend if self.jumped else image

    def back(self) -> np.ndarray:
        self.x, self.jumped, self.longest = [], False, max(self.longest / 8, 4.0)
        return self.plain


class Climb:
    """Quasi-Newton steps (L-BFGS) up a slope that EM steps tell: a step times what it counts (``scale``: wins, or rankings of a
    component) is the slope, and 1 / scale the first guess of the curvature's inverse, so without memory it goes the EM step.
    Only pairs of steps and slopes that bend downwards are kept, so it leaves saddles as the steps do. Where it came down, ``back``
    shortens the step twice, then gives the EM step and forgets."""

    #: Steps that are remembered, the longest change of a parameter in a step, and how often a step is shortened.
    KEPT, LONGEST, SHORTER = 10, 2.0, 2

    def __init__(self):
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.jumped, self.tries, self.base, self.way, self.slope, self.plain = False, 0, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0)

    def next(self, x: np.ndarray, image: np.ndarray, scale: np.ndarray) -> np.ndarray:
        slope = scale * (image - x)
        if self.jumped:
            step, bend = x - self.base, self.slope - slope
            if step @ bend > 1e-10 * np.sqrt((step @ step) * (bend @ bend)):
                self.steps = [*self.steps, (step, bend)][-self.KEPT :]
        way, shares = slope.copy(), []
        for step, bend in reversed(self.steps):
            shares.append((step @ way) / (step @ bend))
            way -= shares[-1] * bend
        if self.steps:
            step, bend = self.steps[-1]
            way *= (step @ bend) / (bend @ (bend / scale))
        way /= scale
        for (step, bend), share in zip(self.steps, reversed(shares), strict=True):
            way += step * (share - (bend @ way) / (step @ bend))
        way *= min(1.0, self.LONGEST / max(float(np.abs(way).max()), 1e-300))
        self.base, self.way, self.slope, self.plain, self.jumped, self.tries = x, way, slope, image, True, 0
        return x + way

    def back(self) -> np.ndarray:
        self.tries += 1
        if self.tries <= self.SHORTER:
            return self.base + self.way / 4**self.tries
        self.steps, self.jumped = [], False
        return self.plain


def fit_mixture(rankings: DataFrame, components: int, n: int, m_step: str = "mm", start: np.ndarray | DataFrame | None = None, max_iters: int = 5_000, tol: float = 1e-6, seed: int = 0, link: str | Link = "logit", nu: float = 0.01, a0: float = 0.0, c: float = 1.0, d: float = 0.0, alpha0: float = 1.0, step_size: float = 0.5, trim: float | None = None, hard: bool | str = False, inner: int = 1, extra_refinement: bool = False, pair_weights: np.ndarray | None = None) -> MixtureFit:
    """EM with the given M step; stops when the squared change of the utilities is below tol, which ``converged`` tells; if
    max_iters comes first it is false, and a warning is given. ``mm``, ``map`` and ``spectral`` ascend the likelihood (the
    posterior); ``gmm``, ``cml`` and ``surrogate`` fit pair tables instead, each by its own objective, and the likelihood may
    fall on the way. After some plain steps they are accelerated (``mm`` and ``map`` by ``Climb``, the others by ``Jumps``; not
    with trim or hard): a jump counts where what they ascend doesn't fall, or else where the next step is not over eight times as
    long as the last. Rankings of one item count for nothing. trim: smaller posteriors become 0; hard: the largest posterior becomes 1, or with ``draw`` that of one
    component drawn by a hash of (ranking_id, seed, iteration). spectral: ``inner`` Luce iterations, a pass each, with the
    same posteriors; extra_refinement: a second run from the first one's end with up to 100. surrogate: pair_weights
    (items x items, symmetric; say ``pair_weights_pca``) multiply the comparisons in both steps. All M steps but mm and
    map make items x items tables, of at most MAX_ITEMS items."""
    if m_step not in STEPS:
        raise ValueError(m_step)
    if rankings.columns != BLOCK_NAMES:
        given = {x: v for x, v in locals().items() if x != "rankings"}
        with held_blocks(rankings) as rows:
            return fit_mixture(rows, **given)
    if extra_refinement and m_step == "spectral":
        options = {"max_iters": max_iters, "tol": tol, "seed": seed, "nu": nu, "trim": trim, "hard": hard}
        first = fit_mixture(rankings, components, n, m_step, start, **options)
        more = fit_mixture(rankings, components, n, m_step, first.thetas, inner=100, **options)
        return MixtureFit(more.thetas, more.alpha, first.log_likelihood + more.log_likelihood, more.converged)
    if m_step not in ("mm", "map"):
        check_dense(n)
    pair_w = None if pair_weights is None else np.asarray(pair_weights, float)
    thetas = start_array(start, components, n, seed)
    alpha = np.full(components, 1 / components)
    fit, named = MixtureFit(thetas, alpha), named_link(link)
    per = {"mm": 2 * n, "map": 2 * n}.get(m_step, n * n)
    size = components * per

    def job(thetas: np.ndarray, alpha: np.ndarray, turn: int, at: np.ndarray):
        """Sums under the posteriors of (thetas, alpha), with flows at the utilities ``at``."""

        def work(idx: np.ndarray, weight: np.ndarray, key: np.ndarray) -> np.ndarray:
            if m_step == "surrogate":
                like = pair_log_likelihood(thetas, idx, named, pair_w)
            else:
                places, gap = k.turned(idx, n)
                inverses, logs = zip(*[k.chances(theta, places, gap) for theta in thetas], strict=True)
                like = np.array(logs).T
            q, total = k.posterior(like + np.log(np.maximum(alpha, 1e-300)))
            if trim is not None:
                q = np.where(q < trim, 0.0, q)
                q /= np.maximum(q.sum(1, keepdims=True), 1e-300)
            if hard:
                drawn = (stream_uniforms(key_streams(key, seed, turn), 1) > np.cumsum(q, 1)[:, :-1]).sum(1) if hard == "draw" else q.argmax(1)
                q = (np.arange(q.shape[1]) == drawn[:, None]).astype(float)
            own = (q * weight[:, None]).T
            if m_step in ("mm", "map"):
                out = k.turned_sums(places, gap, inverses, own, n)
            elif m_step == "spectral":
                there = inverses if at is thetas else [k.chances(theta, places, gap)[0] for theta in at]
                out = [table.T.ravel() for table in k.pair_tables(idx, [(s * w).T for w, s in zip(own, there, strict=True)], n)]
            else:
                out = [k.pair_tables(idx, [np.broadcast_to(w[:, None], idx.shape) for w in own], n).ravel()]
            return np.concatenate([*out, (q * weight[:, None]).sum(0), [(total * weight).sum(), weight.sum()]])

        return pass_over(rankings, n, work, size + components + 2, keyed=True)

    def vector(thetas: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        return np.concatenate([thetas.ravel(), np.log(np.maximum(alpha, 1e-300))])

    def move(at: np.ndarray) -> None:
        fit.thetas, fit.alpha = at[: components * n].reshape(components, n), np.exp(at[components * n :] - at[components * n :].max())
        fit.thetas = fit.thetas - fit.thetas.mean(1, keepdims=True)
        fit.alpha = fit.alpha / fit.alpha.sum()

    climbs, gain, loss = m_step in ("mm", "map"), *((a0, a0) if m_step == "mm" else (c - 1, d))
    jumps, change, goal, smooth, ascends = Climb() if climbs else Jumps(), np.inf, -np.inf, trim is None and not hard, climbs or m_step == "spectral"
    while (turn := fit.iterations) < max_iters:
        sums = job(fit.thetas, fit.alpha, turn, fit.thetas)
        stats, mass, total, m = sums[:size].reshape(components, per), sums[size:-2], sums[-2], sums[-1]
        if m == 0:
            fit.converged = True
            break
        before, goal = goal, total + ((gain * fit.thetas - loss * np.exp(fit.thetas)).sum() if climbs and (gain or loss) else 0.0)
        if m_step == "map":
            goal += (alpha0 - 1) * np.log(np.maximum(fit.alpha, 1e-300)).sum()
        if jumps.jumped and ascends and not goal >= before:
            goal = before
            move(jumps.back())
            continue
        new = []
        for j in range(components):
            old = fit.thetas[j]
            if climbs:
                up, down = gain + stats[j, :n], loss + stats[j, n:]
                new.append(k.centred(np.log(np.maximum(up, 1e-10) / np.maximum(down, 1e-10))))
                continue
            table = stats[j].reshape(n, n)
            if m_step == "spectral":
                new.append(spectral_step(table, nu))
                continue
            if pair_w is not None:
                table = table * pair_w
            met = (table + table.T) > 0
            table = table + nu * met
            p = np.where(met, table / np.where(met, table + table.T, 1.0), 0.0)
            if m_step == "gmm":
                new.append(k.fit_gmm(p, named, 1e-6, old))
            else:
                best = k.fit_cml(table / max(table.sum(), 1e-300), named, 1e-6, old)
                new.append((1 - step_size) * old + step_size * best if m_step == "surrogate" else best)
        for _ in range(inner - 1 if m_step == "spectral" else 0):
            flows = job(fit.thetas, fit.alpha, turn, np.array(new))[:size].reshape(components, n, n)
            last, new = new, [spectral_step(table, nu) for table in flows]
            if np.square(np.array(new) - np.array(last)).sum() < tol:
                break
        last, change = change, float(np.square(np.array(new) - fit.thetas).sum())
        if jumps.jumped and not ascends and not change <= (STIRRED if turn < LATER else LATER_STIRRED) * last:
            change = last
            move(jumps.back())
            continue
        fit.log_likelihood.append(float(total / m))
        alpha = np.maximum((alpha0 - 1 + mass) / (components * alpha0 - components + m), 1e-12) if m_step == "map" else mass / m
        here, fit.thetas, fit.alpha = vector(fit.thetas, fit.alpha), np.array(new), alpha / alpha.sum()
        if change < tol:
            fit.converged = True
            break
        if smooth and turn >= PLAIN_STEPS and turn + 1 < max_iters:
            shared = mass + (alpha0 - 1 if m_step == "map" else 0.0)
            counts = [np.maximum(np.concatenate([(gain + stats[:, :n]).ravel(), shared]), 1e-10)] if climbs else []
            move(jumps.next(here, vector(fit.thetas, fit.alpha), *counts))
    say_if_cut(fit.converged, max_iters)
    return fit


def own_draws(q: np.ndarray, weight: np.ndarray, streams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, component, how many of the row's rankings have it, their summed unit exponentials per place).

    A ranking of weight 1 draws one component. One of weight w stands for w rankings, each of which draws its own: their
    numbers are multinomial, their summed exponentials gammas; a broken rest of w is one more, of that weight.
    """
    upto = np.cumsum(q, 1)[:, :-1]
    u = stream_uniforms(streams, width + 1)
    single = np.flatnonzero(weight == 1)
    rows, kinds = [single], [(u[single, :1] > upto[single]).sum(1)]
    counts, draws = [np.ones(len(single))], [-np.log(u[single, 1:])]
    for i in np.flatnonzero(weight != 1):
        own = np.random.Generator(np.random.Philox(key=int(streams[i])))
        many = own.multinomial(int(weight[i]), q[i] / q[i].sum()).astype(float)
        many[int((u[i, 0] > upto[i]).sum())] += weight[i] - int(weight[i])
        here = np.flatnonzero(many)
        rows.append(np.full(len(here), i))
        kinds.append(here)
        counts.append(many[here])
        draws.append(own.gamma(many[here][:, None], size=(len(here), width)))
    return np.concatenate(rows), np.concatenate(kinds), np.concatenate(counts), np.concatenate(draws)


def sample_posterior(rankings: DataFrame, components: int, n: int, n_samples: int = 100, burn: int = 20, seed: int = 0, c: float = 1.0, d: float = 1.0, alpha0: float = 1.0, start: np.ndarray | DataFrame | None = None) -> MixtureFit:
    """Gibbs sampling; each sweep is one pass that draws every ranking's component and choice times and adds up what the
    conditional gammas and the Dirichlet need. A ranking's draws come from a hash of (ranking_id, seed, sweep), so they
    don't depend on how rows are dealt to tasks or batches; rows that repeat a ranking_id draw alike. Returns means over
    the kept sweeps."""
    if rankings.columns != BLOCK_NAMES:
        with held_blocks(rankings) as rows:
            return sample_posterior(rows, components, n, n_samples, burn, seed, c, d, alpha0, start)
    rng = np.random.default_rng(seed)
    p = np.exp(start_array(start, components, n, seed))
    w = np.full(components, 1 / components)
    summed, shares, per = np.zeros((components, n)), np.zeros(components), 2 * n
    for sweep in range(burn + n_samples):
        thetas, logs = np.log(p), np.log(w)

        def work(idx: np.ndarray, weight: np.ndarray, key: np.ndarray, thetas=thetas, logs=logs, sweep=sweep) -> np.ndarray:
            q, _ = k.posterior(k.log_likelihood(thetas, idx) + logs)
            rows, z, many, unit = own_draws(q, weight, key_streams(key, seed, sweep), idx.shape[1])
            out = []
            for j, theta in enumerate(thetas):
                own = z == j
                mine, got = idx[rows[own]], many[own]
                s, on = k.suffix_sums(theta, mine), k.choosing(mine)
                run, there = np.cumsum(np.where(on, unit[own] / np.where(on, s, 1.0), 0.0), 1), mine >= 0
                out += [k.win_sums(mine, got, n), np.bincount(mine[there], run[there], n)]
            return np.concatenate([*out, np.bincount(z, many, len(thetas))])

        sums = pass_over(rankings, n, work, components * per + components, keyed=True)
        stats, mass = sums[: components * per].reshape(components, 2, n), sums[components * per :]
        p = rng.gamma(c + stats[:, 0], 1 / (d + stats[:, 1])) + 1e-300
        w = rng.dirichlet(alpha0 + mass)
        if sweep >= burn:
            logp = np.log(p)
            summed += logp - logp.mean(1, keepdims=True)
            shares += w
    return MixtureFit(summed / n_samples, shares / n_samples)


def mixture_moments(rankings: DataFrame, components: int, n: int, lambd: float = 1e-3, link: str | Link = "logit", seed: int = 0, iters: int = 500) -> MixtureFit:
    """Utilities and shares whose mixed pair probabilities match the pair moments, by Gauss-Newton on the driver."""
    m = wins_matrix(pair_moments(rankings), n, "moment")
    a, b = np.nonzero(np.triu((m + m.T) > 0, 1))
    target = m[a, b] / (m[a, b] + m[b, a])
    named, thetas, logits = named_link(link), random_start(components, n, seed), np.zeros(components)
    damp, size = 1.0, components * n

    def residual(thetas: np.ndarray, logits: np.ndarray):
        alpha = np.exp(logits - logits.max())
        alpha /= alpha.sum()
        f = np.array([named.np_cdf(t[a] - t[b]) for t in thetas])
        return np.concatenate([alpha @ f - target, np.sqrt(lambd) * thetas.ravel()]), f, alpha

    r, f, alpha = residual(thetas, logits)
    for _ in range(iters):
        jac = np.zeros((len(r), size + components))
        for j in range(components):
            g = alpha[j] * named.np_pdf(thetas[j][a] - thetas[j][b])
            jac[np.arange(len(a)), j * n + a] += g
            jac[np.arange(len(a)), j * n + b] -= g
            jac[: len(a), size + j] = alpha[j] * (f[j] - alpha @ f)
        jac[len(a) :, :size] = np.sqrt(lambd) * np.eye(size)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(size + components), jac.T @ r)
        t2, l2 = thetas - step[:size].reshape(components, n), logits - step[size:]
        r2, f2, alpha2 = residual(t2, l2)
        if r2 @ r2 < r @ r:
            small = r @ r - r2 @ r2 < 1e-12
            thetas, logits, r, f, alpha, damp = t2, l2, r2, f2, alpha2, damp / 3
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return MixtureFit(thetas - thetas.mean(1, keepdims=True), alpha)


def soft_labels(rankings: DataFrame, fit: MixtureFit) -> DataFrame:
    """(ranking_id, component): the likeliest component of each ranking."""
    q = responsibilities(rankings, fit.params(rankings), fit.mixture(rankings))
    return q.groupBy("ranking_id").agg(F.max(F.struct("q", (-F.col("component")).alias("c"))).alias("b")).select("ranking_id", (-F.col("b.c")).alias("component"))

