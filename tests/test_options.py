"""Options of fits, samples and clusters, large engines against small ones, and draws that depend on keys only."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefscale.functions import embeddings as emb
from prefscale.functions import kernels as k
from prefscale.functions.links import logit
from prefscale.operators import breaking, clustering, estimators, evaluate, mixture, sampling
from tests.test_fits import sampled, values

MODEL = np.array([[2.0, 1.0, 0.5, -0.5, -1.0, -2.0], [-2.0, -1.0, -0.5, 0.5, 1.0, 2.0]])


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(5)
    z = (rng.random(600) < 0.4).astype(int)
    rows = [np.argsort(-(MODEL[c] + rng.gumbel(size=6))).tolist() for c in z]
    return spark.createDataFrame([(i, r, 1.0) for i, r in enumerate(rows)], "ranking_id long, items array<int>, weight double").cache()


def test_posterior_draws_do_not_depend_on_partitions(two):
    a = mixture.sample_posterior(two.repartition(7), 2, 6, 3, 2, start=MODEL)
    b = mixture.sample_posterior(two.coalesce(1), 2, 6, 3, 2, start=MODEL)
    assert a.thetas == pytest.approx(b.thetas, abs=1e-6) and a.alpha == pytest.approx(b.alpha, abs=1e-9)


def test_a_weight_draws_as_so_many_rankings(spark):
    few = [[0, 1, 2], [2, 1, 0], [1, 0, 2]]
    whole = spark.createDataFrame([(i, few[i % 3]) for i in range(900)], "ranking_id long, items array<int>")
    packed = spark.createDataFrame([(i, r, 300.0) for i, r in enumerate(few)], "ranking_id long, items array<int>, weight double")
    a, b = (mixture.sample_posterior(x, 1, 3, 40, 10) for x in (whole, packed))
    assert a.thetas == pytest.approx(b.thetas, abs=0.1)


def test_own_draws_have_the_spread_of_their_weight():
    streams = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    q = np.tile([0.25, 0.75], (3000, 1))
    _, z, many, unit = mixture.own_draws(q, np.full(3000, 8.0), streams, 2)
    assert many[z == 1].mean() == pytest.approx(6, abs=0.1) and np.bincount(z, many).sum() == 24_000
    assert (unit[:, 0] - many).mean() == pytest.approx(0, abs=0.1) and np.var(unit[:, 0] - many) == pytest.approx(many.mean(), rel=0.1)
    rows, z, many, unit = mixture.own_draws(q, np.ones(3000), streams, 2)
    assert (rows == np.arange(3000)).all() and (many == 1).all() and z.mean() == pytest.approx(0.75, abs=0.03)
    assert unit.mean() == pytest.approx(1, abs=0.05) and unit.var() == pytest.approx(1, abs=0.15)


def test_rank_centrality_over_tables_is_the_dense_one(spark, monkeypatch):
    _, rows = sampled(6, 300, 3)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "ranking_id long, items array<int>").cache()
    pairs = breaking.pair_probs(breaking.pair_counts(df), "all", 1.0).cache()
    dense = values(estimators.rank_centrality(df, 7, max_iters=12, eps=0.0), 7), values(estimators.rank_centrality_from_probs(pairs, 7, 0.1, 12, 0.0), 7)
    monkeypatch.setattr(estimators, "MAX_ITEMS", 3)
    assert values(estimators.rank_centrality(df, 7, max_iters=12, eps=0.0), 7) == pytest.approx(dense[0])
    assert values(estimators.rank_centrality_from_probs(pairs, 7, 0.1, 12, 0.0), 7) == pytest.approx(dense[1])
    for refused in (lambda: mixture.fit_mixture(df, 2, 7, "gmm"), lambda: estimators.pair_gmm(df, 7)):
        with pytest.raises(ValueError, match="too many"):
            refused()
    assert estimators.luce_mm(df, 7, alpha=0.5, max_iters=2).count() == 7


def test_large_models_go_to_the_rankings_that_need_them(two, monkeypatch):
    params, shares = estimators.params_frame(two, MODEL), two.sparkSession.createDataFrame([(0, 0.6), (1, 0.4)], "component int, alpha double")
    more = two.unionByName(two.limit(5))

    def every():
        ll = sorted((r["ranking_id"], r["component"], round(r["ll"], 9)) for r in evaluate.pl_log_likelihood(more, params).collect())
        q = [sorted((r["ranking_id"], r["component"], round(r["q"], 9)) for r in f(more, params, shares).collect()) for f in (evaluate.responsibilities, evaluate.pairwise_responsibilities)]
        return ll, q, round(evaluate.mixture_log_likelihood(more, params, shares).first()["ll"], 9)

    small = every()
    monkeypatch.setattr(evaluate, "MODEL_ROWS", 3)
    assert every() == small


@pytest.mark.parametrize("reg", ["l1", "l2"])
def test_composite_likelihood_with_a_penalty_is_at_its_best(reg):
    rng = np.random.default_rng(4)
    p = rng.random((5, 5)) * (1 - np.eye(5))
    best = k.fit_cml(p, logit(), 0.3, reg=reg)

    def value(u):
        return -(p * np.log(1 / (1 + np.exp(-(u[:, None] - u[None, :]))))).sum() + 0.3 * (np.abs(u).sum() if reg == "l1" else u @ u / 2)

    assert all(value(best) <= value(best + k.centred(rng.normal(size=5)) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(50))
    strong = k.fit_cml(p, logit(), 100.0, reg="l1")
    assert np.abs(strong).max() < 1e-4


def test_logit_posterior_of_two_items_by_quadrature(spark):
    rows = spark.createDataFrame([(0, 1, 3.0), (1, 0, 1.0)], "winner int, loser int, weight double")
    got = {r["item"]: (r["mean"], r["variance"]) for r in estimators.pair_posterior(rows, 1.0, rounds=200, model="logit").collect()}
    d = np.linspace(-12, 12, 20001)  # the difference has the prior variance 2
    f = np.exp(-(d**2) / 4) / (1 + np.exp(-d)) ** 3 / (1 + np.exp(d))
    mean = (f * d).sum() / f.sum()
    assert got[0][0] - got[1][0] == pytest.approx(mean, abs=0.02) and got[0][0] == pytest.approx(-got[1][0], abs=1e-9)
    with pytest.raises(ValueError):
        estimators.tilted(np.zeros(1), np.ones(1), "other")


def test_score_grid_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    users, items = rng.normal(size=(13, 3)), rng.normal(size=(29, 3))
    frame = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<double>")
    for block in (4_096, 5):
        monkeypatch.setattr(estimators, "GRID_ITEMS", block)
        got = {(r["user"], r["item"]): r["score"] for r in estimators.score_grid(frame(users), frame(items)).collect()}
        assert len(got) == 13 * 29 and all(got[u, i] == pytest.approx(users[u] @ items[i]) for u, i in got)
    assert estimators.score_grid(frame(users), frame(items[:0])).count() == 0


def test_noise_of_the_callers_own(spark):
    params = estimators.params_frame(spark.range(1), np.array([[0.0, 0.1, 0.2]]))
    gumbel = lambda u: -F.log(-F.log(u))
    own = sampling.sample_rankings(params, 30, gumbel, 1)
    assert own.exceptAll(sampling.sample_rankings(params, 30, "gumbel", 1)).count() == 0
    still = sampling.sample_rankings(params, 20, lambda u: F.lit(0.0), 1).select("items").distinct().collect()
    assert [r["items"] for r in still] == [[2, 1, 0]]
    some = sampling.sample_rankings(params, 200, {0: "logistic", 1: lambda u: u * 0}, 1).select("items").distinct().collect()
    assert all(r["items"].index(2) < r["items"].index(1) for r in some) and len(some) > 1  # items without noise keep their order


def test_sampled_models_by_time(spark):
    params = spark.createDataFrame([(0, i, float(i * t), t) for t in (-9, 9) for i in range(3)], "component int, item int, theta double, t int")
    got = sampling.sample_rankings(params, 10, lambda u: F.lit(0.0), keys=["t"]).collect()
    assert len({r["ranking_id"] for r in got}) == 20 and all(r["items"] == ([2, 1, 0] if r["t"] > 0 else [0, 1, 2]) for r in got)


def test_clusters_of_embeddings_of_the_callers_own(two):
    for own in (lambda items: emb.embed_positional(items, 6), lambda items: emb.embed_topk(items, 6, 3), lambda items: emb.embed_pairwise_expected(items, 6)):
        labels, wins = clustering.cluster_rankings(two, 2, 6, own, "pca_scaled")
        assert wins.shape == (2, 6, 6) and labels.count() == 600
        shares = wins[:, 0, 5] / (wins[:, 0, 5] + wins[:, 5, 0])
        assert shares.max() > 0.8 and shares.min() < 0.3
    with pytest.raises(ValueError):
        clustering.cluster_rankings(two, 2, 6, "other")


def test_leading_directions_by_passes_are_those_of_the_whole_matrix(two, monkeypatch):
    rows, dim = clustering.embedded(two, 6, "signed")
    rows = rows.cache()
    whole = [clustering.leading(rows, dim, 2, centred) for centred in (False, True)]
    monkeypatch.setattr(clustering, "MAX_DIM", 4)
    for (values_, vectors, trace), centred in zip(whole, (False, True), strict=True):
        got = clustering.leading(rows, dim, 2, centred, rounds=60)
        assert got[0] == pytest.approx(values_, rel=1e-4) and got[2] == pytest.approx(trace)
        assert np.abs(got[1].T @ vectors) == pytest.approx(np.eye(2), abs=0.05)
    assert clustering.cluster_rankings(two, 2, 6)[0].count() == 600
    assert len(clustering.pair_weights_pca(two, 6)) == 15


def test_refinement_hard_draws_and_pair_weights(two):
    start = MODEL * 0.3
    plain = mixture.fit_mixture(two, 2, 6, "spectral", start, max_iters=4)
    more = mixture.fit_mixture(two, 2, 6, "spectral", start, max_iters=4, extra_refinement=True)
    assert more.log_likelihood[:4] == pytest.approx(plain.log_likelihood) and len(more.log_likelihood) > 4
    assert more.log_likelihood[-1] >= plain.log_likelihood[-1] - 1e-3
    hard = [mixture.fit_mixture(two.repartition(n), 2, 6, "mm", start, max_iters=3, hard="draw").thetas for n in (1, 5)]
    assert hard[0] == pytest.approx(hard[1], abs=1e-6)
    ones = np.ones((6, 6))
    a, b = (mixture.fit_mixture(two, 2, 6, "surrogate", start, max_iters=2, pair_weights=w).thetas for w in (None, ones))
    assert a == pytest.approx(b)
    w = clustering.pair_matrix(clustering.pair_weights_pca(two, 6), 6)
    assert (w == w.T).all() and not w.diagonal().any()
    assert mixture.fit_mixture(two, 2, 6, "surrogate", start, max_iters=2, pair_weights=w).thetas.shape == (2, 6)


def test_a_start_may_be_a_table_of_params(two):
    start = MODEL * 0.3
    table = estimators.params_frame(two, start)
    a, b = (mixture.fit_mixture(two, 2, 6, "mm", x, max_iters=2).thetas for x in (start, table))
    assert a == pytest.approx(b)
    assert mixture.start_array(table.where("item < 5"), 2, 6, 0)[:, 5].tolist() == [0.0, 0.0]


def test_posterior_with_weights_of_one_ranking_each_order():
    items = [list(p) for p in itertools.permutations(range(3))]
    idx, rows = k.matrix(items)
    assert len(rows) == 6 and k.log_likelihood(np.zeros((1, 3)), idx) == pytest.approx(np.log(1 / 6))


def test_sketches_keep_inner_products():
    rng = np.random.default_rng(6)
    idx = np.full((40, 30), -1)
    for r in range(40):
        items = rng.permutation(30)[: rng.integers(2, 31)]
        idx[r, : len(items)] = items
    exact = clustering.pair_vectors(idx, 30)
    sketch = clustering.pair_sketch(idx, 4096)
    norms = np.sqrt((exact * exact).sum(1))
    apart = np.abs(sketch @ sketch.T - exact @ exact.T) / np.maximum(norms[:, None] * norms, 1e-9)
    assert apart.mean() < 0.02 and apart.max() < 0.12  # about 1 / sqrt(4096)
    assert clustering.pair_sketch(idx[:, :1], 8).tolist() == np.zeros((40, 8)).tolist()


def test_groups_of_two_thousand_items_are_found(spark):
    rng = np.random.default_rng(8)
    tastes = rng.normal(size=(2, 2000)) * 3
    rows = []
    for r in range(60):
        menu = rng.permutation(2000)[:120]
        rows.append((r, menu[np.argsort(-(tastes[r % 2][menu] + rng.gumbel(size=120)))].tolist(), r % 2))
    df = spark.createDataFrame(rows, "ranking_id long, items array<int>, true int")
    labels, none = clustering.cluster_rankings(df, 2, 5_000_000, "sketch", width=512, centres=False, reduce="none")
    assert none is None and labels.count() == 60
    with pytest.raises(ValueError, match="too many"):
        clustering.cluster_rankings(df, 2, 5_000_000, "sketch")
    whole = spark.createDataFrame([(r, np.argsort(-(tastes[r % 2] + rng.gumbel(size=2000))).tolist(), r % 2) for r in range(24)], "ranking_id long, items array<int>, true int")
    labels, _ = clustering.cluster_rankings(whole, 2, 2000, "sketch", width=512, centres=False)
    pred = labels.withColumnRenamed("label", "pred").join(whole, "ranking_id")
    assert evaluate.clustering_accuracy(pred).first()["accuracy"] == 1
