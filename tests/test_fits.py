"""Estimators and mixtures: agreement among them, and recovery of known models."""

import numpy as np
import pandas as pd
import pytest

from prefscale.functions import kernels
from prefscale.functions.links import logit
from prefscale.operators import breaking, clustering, estimators, evaluate, mixture, sampling


def sampled(n, m, seed):
    rng = np.random.default_rng(seed)
    theta = rng.normal(size=n)
    theta -= theta.mean()
    rows = np.argsort(-(theta + rng.gumbel(size=(m, n))), axis=1)
    menus = [set(rng.permutation(n)[: rng.integers(2, n + 1)].tolist()) for _ in rows]  # a menu drawn apart from the order
    return theta, [[i for i in r.tolist() if i in menu] for r, menu in zip(rows, menus, strict=True)]


@pytest.fixture(scope="module")
def data(spark):
    theta, rows = sampled(6, 1500, 3)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "ranking_id long, items array<int>").cache()
    return theta, df


def values(params, n=6):
    out = np.zeros(n)
    for r in params.collect():
        out[r["item"]] = r["theta"]
    return out


def test_spectral_and_mm_agree_and_recover(data):
    theta, df = data
    mm = values(estimators.luce_mm(df, 6))
    spectral = values(estimators.luce_spectral(df, 6))
    assert mm == pytest.approx(spectral, abs=1e-3)
    assert np.abs(mm - theta).max() < 0.2


def test_partitioning_does_not_matter(data):
    _, df = data
    assert values(estimators.luce_mm(df.repartition(7), 6, max_iters=5)) == pytest.approx(values(estimators.luce_mm(df.coalesce(1), 6, max_iters=5)), abs=1e-9)


def test_map_with_flat_prior_is_one_mm_step(data):
    _, df = data
    start = np.zeros((1, 6))
    a = mixture.fit_mixture(df, 1, 6, "map", start, max_iters=1, c=1.0, d=0.0)
    b = mixture.fit_mixture(df, 1, 6, "mm", start, max_iters=1)
    assert a.thetas == pytest.approx(b.thetas)


def test_pair_methods_recover(data):
    theta, df = data
    full = df.where("size(items) = 6")
    pairs = breaking.drop_extreme_pairs(breaking.pair_probs(breaking.pair_counts(full), "all", 1.0))
    for got in (
        estimators.rank_centrality(full, 6),
        estimators.pair_gmm(full, 6),
        estimators.pair_cml(full, 6),
        estimators.pair_least_squares(pairs, 6),
        estimators.pair_low_rank(pairs, 6),
    ):
        assert np.corrcoef(values(got), theta)[0, 1] > 0.95
    own = estimators.pair_cml(full, 6, link=logit())  # a link of the caller's
    assert values(own) == pytest.approx(values(estimators.pair_cml(full, 6)))


def test_posterior_by_group(spark, data):
    theta, df = data
    rows = breaking.rank_break(df.where("size(items) = 6")).withColumnRenamed("ranking_id", "g").selectExpr("g % 2 AS g", "winner", "loser", "weight")
    got = estimators.pair_posterior(rows, 1.0, ["g"]).toPandas()
    assert set(got["g"]) == {0, 1} and (got["variance"] > 0).all()
    one = got[got["g"] == 0].sort_values("item")["mean"].to_numpy()
    assert np.corrcoef(one, theta)[0, 1] > 0.95


@pytest.fixture(scope="module")
def two_groups(spark):
    rng = np.random.default_rng(5)
    a = np.array([2.0, 1.0, 0.5, -0.5, -1.0, -2.0])
    both = np.array([a, -a])
    z = (rng.random(1200) < 0.4).astype(int)
    rows = [np.argsort(-(both[c] + rng.gumbel(size=6))).tolist() for c in z]
    df = spark.createDataFrame([(i, r, int(c)) for i, (r, c) in enumerate(zip(rows, z, strict=True))], "ranking_id long, items array<int>, true int")
    return both, df.cache()


@pytest.mark.parametrize("step", mixture.STEPS)
def test_mixtures_find_two_groups(spark, two_groups, step):
    both, df = two_groups
    start = clustering.init_mixture(df, 2, 6, "rc", seed=2)
    fit = mixture.fit_mixture(df, 2, 6, step, start, max_iters=15, c=1.1, d=0.1)
    labels = mixture.soft_labels(df, fit).withColumnRenamed("component", "pred").join(df, "ranking_id")
    assert evaluate.clustering_accuracy(labels).first()["accuracy"] > 0.9
    if step == "mm":
        ll = fit.log_likelihood
        assert all(b >= a - 1e-9 for a, b in zip(ll, ll[1:]))
        truth = estimators.params_frame(df, both)
        assert evaluate.mixture_l2_error(fit.params(df), truth).first()["err"] < 1.0
        assert evaluate.mixture_log_likelihood(df, fit.params(df), fit.mixture(df)).first()["ll"] == pytest.approx(ll[-1], abs=1e-2)


@pytest.mark.parametrize("reduce", ["pca", "pca_scaled", "svd", "nuclear", "rand_gauss", "rand_sparse", "none"])
def test_clusters(two_groups, reduce):
    _, df = two_groups
    labels, wins = clustering.cluster_rankings(df, 2, 6, reduce=reduce, seed=1)
    pred = labels.withColumnRenamed("label", "pred").join(df, "ranking_id")
    assert evaluate.clustering_accuracy(pred).first()["accuracy"] > (0.6 if reduce.startswith("rand") or reduce == "pca" else 0.85)  # whitened noise counts as much in pca
    assert wins.shape == (2, 6, 6)


def test_starts_posterior_samples_and_moments(two_groups):
    both, df = two_groups
    for method in ("random", "gmm", "lrmc", "cml"):
        assert clustering.init_mixture(df, 2, 6, method).shape == (2, 6)
    got = mixture.sample_posterior(df, 2, 6, n_samples=15, burn=10, start=both * 0.5)
    assert np.corrcoef(got.thetas.ravel(), both.ravel())[0, 1] > 0.9
    assert mixture.mixture_moments(df, 2, 6, iters=100).alpha.sum() == pytest.approx(1)
    w = clustering.pair_weights_pca(df, 6, 3)
    assert w.max() == pytest.approx(1) and len(w) == 15
    assert clustering.cluster_rankings(df, 2, 6, embedding="disjoint")[0].count() == 1200


def test_error_falls_with_data(spark):
    theta, rows = sampled(5, 4000, 9)
    err = []
    for m in (100, 4000):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows[:m])], "ranking_id long, items array<int>")
        err.append(np.linalg.norm(values(estimators.luce_mm(df, 5, max_iters=60), 5) - theta))
    assert err[1] < err[0]


def test_random_noise_is_reproducible(spark):
    params = estimators.params_frame(spark.range(1), np.zeros((1, 4)))
    a = sampling.sample_rankings(params, 50, "normal", 7).repartition(5)
    b = sampling.sample_rankings(params, 50, "normal", 7).coalesce(1)
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("step", ["mm", "map", "spectral"])
def test_fits_end_by_their_rule(two_groups, step):
    both, df = two_groups
    fit = mixture.fit_mixture(df, 2, 6, step, both * 0.3, c=1.1, d=0.1)
    assert fit.converged and fit.iterations > 5
    further = mixture.fit_mixture(df, 2, 6, step, both * 0.3, c=1.1, d=0.1, max_iters=4 * fit.iterations, tol=0.0)
    assert not further.converged and further.iterations == 4 * fit.iterations
    assert fit.alpha == pytest.approx(further.alpha, abs=2e-3)
    assert np.abs(fit.thetas - further.thetas).max() < 0.02


def test_a_cut_fit_says_so(two_groups):
    _, df = two_groups
    with pytest.warns(UserWarning, match="not settled in 2"):
        assert not mixture.fit_mixture(df, 2, 6, "mm", max_iters=2).converged
    with pytest.warns(UserWarning, match="not settled in 1"):
        estimators.luce_mm(df, 6, max_iters=1)


@pytest.mark.parametrize("direct", [0, 1 << 21])
def test_packed_blocks_hold_every_ranking(spark, monkeypatch, direct):
    monkeypatch.setattr(estimators, "DIRECT_SUMS", direct)
    rng = np.random.default_rng(4)
    rows = [(i, rng.permutation(40)[: rng.integers(0, 41)].tolist() if i % 17 else None, float(i % 3 + 1)) for i in range(5_000)]
    df = spark.createDataFrame(rows, "ranking_id long, items array<int>, weight double").repartition(3)
    want = np.zeros(40)
    for _, items, w in rows:
        for x in (items or [])[:-1]:
            want[x] += w
    from prefscale.functions import kernels as k

    with estimators.held_blocks(df) as blocks:
        got = estimators.pass_over(blocks, 40, lambda idx, w: k.win_sums(idx, w, 40), 40)
        assert got == pytest.approx(want)
        assert blocks.count() < 60
    assert estimators.pass_over(df, 40, lambda idx, w, key: [len(set(key.tolist()))], 1, keyed=True)[0] == sum(len(r[1] or []) > 1 for r in rows)
    assert estimators.pass_over(df.limit(0), 40, lambda idx, w: k.win_sums(idx, w, 40), 40).sum() == 0


def choices(n, m, size, seed):
    """m rankings of ``size`` of n items, drawn from strengths that lie evenly between -1 and 1."""
    rng = np.random.default_rng(seed)
    theta = rng.permutation(np.linspace(-1, 1, n))
    picked = rng.integers(0, n, (m, size))
    picked = picked[[len(set(r)) == size for r in picked.tolist()]]
    order = np.argsort(-(theta[picked] + rng.gumbel(size=picked.shape)), axis=1)
    return theta, np.take_along_axis(picked, order, 1)


def test_sparse_flows_give_the_dense_fit(data):
    _, df = data
    for nu in (0.0, 0.01):
        assert values(estimators.luce_spectral_sparse(df, 6, nu)) == pytest.approx(values(estimators.luce_spectral(df, 6, nu)), abs=1e-6)
    lone = values(estimators.luce_spectral_sparse(df, 7), 7)
    assert lone[:6] - lone[:6].mean() == pytest.approx(values(estimators.luce_spectral(df, 6)), abs=1e-6)


def test_sparse_flows_pass_on_parts_of_their_sums(data, monkeypatch):
    _, df = data
    monkeypatch.setattr(estimators, "HELD_PAIRS", 50)
    assert values(estimators.luce_spectral_sparse(df, 6)) == pytest.approx(values(estimators.luce_spectral(df, 6)), abs=1e-6)


def test_items_that_never_lose_need_smoothing(spark):
    df = spark.createDataFrame([(0, [0, 1, 2]), (1, [0, 2, 1])], "ranking_id long, items array<int>")
    with pytest.raises(ValueError, match="never lose"):
        estimators.luce_spectral_sparse(df, 3, nu=0.0)
    assert values(estimators.luce_spectral_sparse(df, 3), 3)[0] > 0


def test_many_items_by_sparse_flows(spark):
    n = estimators.MAX_ITEMS + 200
    theta, rows = choices(n, 40_000, 5, 4)
    df = spark.createDataFrame(pd.DataFrame({"ranking_id": range(len(rows)), "items": rows.tolist()}))
    got = values(estimators.luce_spectral(df, n, nu=0.0, tol=1e-6), n)
    wins, denom = kernels.win_sums(rows, np.ones(len(rows)), n), kernels.denominators(got, rows, np.ones(len(rows)))
    assert wins == pytest.approx(np.exp(got) * denom, rel=1e-3, abs=1e-3)  # the likelihood has no slope there
    assert np.corrcoef(got, theta)[0, 1] > 0.9


def test_jumps_shorten_slow_fits_and_are_taken_back():
    slow = np.array([0.999, 0.99, 0.5])
    x, jumps, steps = np.array([1.0, -2.0, 3.0]), mixture.Jumps(), 0
    while np.abs(x * slow - x).max() > 1e-9:
        x, steps = jumps.next(x, x * slow), steps + 1
    assert steps < 400  # without jumps over 13,000
    jumps = mixture.Jumps()
    one, two = jumps.next(np.ones(1), np.full(1, 0.9)), jumps.next(np.full(1, 0.9), np.full(1, 0.82))
    assert one == 0.9 and jumps.jumped and two < 0.82 and jumps.back() == 0.82 and not jumps.jumped


def test_pair_tables_are_those_of_each_pair():
    rng = np.random.default_rng(8)
    for n, width, twice in ((7, 7, False), (7, 7, True), (30, 5, False), (6, 1, False)):
        rows = [rng.permutation(n)[: rng.integers(1, width + 1)].tolist() for _ in range(50)]
        if twice:
            rows[3] = [2, 5, 2]
        idx, _ = kernels.matrix(rows, 1)
        rates = [rng.random(idx.shape), rng.random(idx.shape)]
        want = np.zeros((2, n, n))
        for r, items in enumerate(rows):
            for i, a in enumerate(items):
                for b in items[i + 1 :]:
                    want[:, a, b] += [x[r, i] for x in rates]
        assert kernels.pair_tables(idx, rates, n) == pytest.approx(want)


def test_a_pass_has_a_task_a_core_and_no_plan_of_its_own(spark, monkeypatch):
    df = spark.createDataFrame([(i, [i % 5, 5]) for i in range(200)], "ranking_id long, items array<int>").repartition(40)
    with estimators.held_blocks(df) as blocks:
        blocks.count()
        monkeypatch.setattr(estimators, "added", None)  # sums this few come as they are
        spark.sparkContext.setJobGroup("one pass", "")
        assert estimators.pass_over(blocks, 6, lambda idx, w: kernels.win_sums(idx, w, 6), 6).tolist() == [40.0] * 5 + [0.0]
        tracker = spark.sparkContext.statusTracker()
        [job] = tracker.getJobIdsForGroup("one pass")
        last = tracker.getStageInfo(max(tracker.getJobInfo(job).stageIds))  # what it stands on was there already
        assert last.numTasks <= spark.sparkContext.defaultParallelism
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sparse_fit_has_few_passes_and_smooths_pairs_met_one_way(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.permutation(40)[: rng.integers(0, 5)].tolist(), float(i % 3)) for i in range(400)]
    rows += [(1000 + i, [0, 1], 1.0) for i in range(3)] + [(2000, [39, 38, 37], 0.0)]
    df = spark.createDataFrame(rows, "ranking_id long, items array<int>, weight double").repartition(5)
    met = {}
    for _, items, w in rows:
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                met[a, b] = met.get((a, b), 0) + (w > 0)
    assert any(v > 1 and not met.get((b, a)) for (a, b), v in met.items()) and any(v and met.get((b, a)) for (a, b), v in met.items())
    for nu in (0.01, 5.0):
        spark.sparkContext.setJobGroup(f"fit {nu}", "")
        got = estimators.luce_spectral_sparse(df, 40, nu)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {nu}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert values(got, 40) == pytest.approx(values(estimators.luce_spectral(df, 40, nu), 40), abs=1e-5)
        assert jobs < 60


def test_vectors_are_made_in_the_task_that_uses_them(two_groups, capsys):
    _, df = two_groups
    labels, _ = clustering.cluster_rankings(df, 2, 6, "sketch", width=64, centres=False)
    assert labels.count() == 1200
    capsys.readouterr()
    labels.explain()
    assert capsys.readouterr().out.count("MapIn") == 1  # no second Python worker that reads whole batches of vectors
    rows = df.select("ranking_id", "items").where("ranking_id < 700").coalesce(1)
    vectors, dim = clustering.embedded(rows, 6, "sketch", 16)
    to = np.arange(32.0).reshape(16, 2)
    got = {r["ranking_id"]: r["v"] for r in vectors.moved(lambda x: x @ to).collect()}
    held = rows.collect()
    want = clustering.pair_sketch(kernels.matrix([r["items"] for r in held], 1)[0], 16)
    assert dim == 16 and np.array([got[r["ranking_id"]] for r in held]) == pytest.approx(want @ to)
    assert clustering.summed(vectors, lambda x, w: w @ x, 16) == pytest.approx(want.sum(0))


@pytest.mark.parametrize("step", ["mm", "map"])
def test_climbs_take_few_passes_to_the_top(spark, monkeypatch, step):
    rng = np.random.default_rng(11)
    one = rng.normal(size=8) / 2
    both = np.array([one, one + rng.normal(size=8) / 2])  # groups so alike that EM goes slowly
    rows = [np.argsort(-(both[c] + rng.gumbel(size=8)))[: rng.integers(3, 9)].tolist() for c in rng.integers(0, 2, 4_000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "ranking_id long, items array<int>")
    passes, real = [], mixture.pass_over
    monkeypatch.setattr(mixture, "pass_over", lambda *a, **o: passes.append(1) or real(*a, **o))
    fit = mixture.fit_mixture(df, 2, 8, step, seed=1, c=1.1, d=0.1, tol=1e-10)
    assert fit.converged and len(passes) < 80  # by plain extrapolation over 190
    assert fit.log_likelihood[-1] > -5.803056


def test_climbs_shorten_a_step_twice_and_then_go_the_plain_one():
    climb = mixture.Climb()
    x, image, scale = np.array([1.0, -1.0]), np.array([0.9, -0.8]), np.array([3.0, 5.0])
    assert climb.next(x, image, scale) == pytest.approx(image) and climb.jumped
    assert climb.back() == pytest.approx(x + (image - x) / 4) and climb.jumped
    assert climb.back() == pytest.approx(x + (image - x) / 16) and climb.jumped
    assert climb.back() == pytest.approx(image) and not climb.jumped


def test_sums_over_turned_batches_are_those_of_the_rows():
    rng = np.random.default_rng(3)
    idx, _ = kernels.matrix([rng.permutation(9)[: rng.integers(2, 10)].tolist() for _ in range(300)])
    weight = rng.random(300)
    for far in (1.0, 300.0):  # shares of e^-600 and less are not multiplied
        theta = far * np.linspace(-1, 1, 9)
        places, gap = kernels.turned(idx, 9)
        inverse, logs = kernels.chances(theta, places, gap)
        wins, den = kernels.turned_sums(places, gap, [inverse], weight[None], 9)
        assert logs == pytest.approx(kernels.log_likelihood(theta[None], idx)[:, 0], rel=1e-12, abs=1e-12)
        assert wins == pytest.approx(kernels.win_sums(idx, weight, 9)) and den == pytest.approx(kernels.denominators(theta, idx, weight))


def test_pair_table_fits_jump_further(spark, monkeypatch):
    rng = np.random.default_rng(11)
    one = rng.normal(size=8) / 2
    both = np.array([one, one + rng.normal(size=8) / 2])
    rows = [np.argsort(-(both[c] + rng.gumbel(size=8)))[: rng.integers(3, 9)].tolist() for c in rng.integers(0, 2, 4_000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "ranking_id long, items array<int>")
    passes, real = [], mixture.pass_over
    monkeypatch.setattr(mixture, "pass_over", lambda *a, **o: passes.append(1) or real(*a, **o))
    fit = mixture.fit_mixture(df, 2, 8, "gmm", seed=1)
    assert fit.converged and len(passes) < 160  # with jumps that may but double the step 199
    assert fit.alpha.max() == pytest.approx(0.978, abs=3e-3)


def test_pair_tables_of_long_rankings():
    rng = np.random.default_rng(2)
    n = 140  # more places than a byte tells
    idx, _ = kernels.matrix([rng.permutation(n)[: rng.integers(2, n + 1)].tolist() for _ in range(12)])
    rate, want = rng.random(idx.shape), np.zeros((n, n))
    for r, items in enumerate(idx):
        for t, a in enumerate(items[items >= 0]):
            want[a, items[items >= 0][t + 1 :]] += rate[r, t]
    assert kernels.pair_tables(idx, [rate], n)[0] == pytest.approx(want)
