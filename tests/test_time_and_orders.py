"""Fits per time step, strongly connected components and levels, against dense runs and brute force."""

import math
import random

import numpy as np
import pytest

from prefscale.operators import breaking, consensus, dynamic, estimators, graph

COUNTS = "t int, winner int, loser int, wins double"


def random_counts(seed, steps=6, n=5, m=40):
    rng = np.random.default_rng(seed)
    rows = [(int(t), int(a), int(b), float(w)) for t, a, b, w in zip(rng.integers(0, steps, m), rng.integers(0, n, m), rng.integers(0, n, m), rng.uniform(0.1, 3, m), strict=True)]
    return [r for r in rows if r[1] != r[2]]


def values(df):
    return {(r["t"], r["item"]): r["theta"] for r in df.collect()}


@pytest.mark.parametrize("estimator", dynamic.ESTIMATORS)
def test_a_step_is_fitted_as_if_alone_however_steps_are_grouped(spark, estimator):
    rows = random_counts(1)
    df = spark.createDataFrame(rows, COUNTS)
    got = [values(dynamic.fit_over_time(df.repartition(3), 5, estimator, together=g)) for g in (1, 4)]
    assert got[0].keys() == {(t, i) for t in {r[0] for r in rows} for i in range(5)}
    assert got[0] == pytest.approx(got[1], abs=1e-6)
    one = spark.createDataFrame([r for r in rows if r[0] == 2], COUNTS)
    alone = values(dynamic.fit_over_time(one, 5, estimator))
    assert alone == pytest.approx({k: v for k, v in got[0].items() if k[0] == 2}, abs=1e-6)


def test_a_step_is_the_static_fit(spark):
    rng = np.random.default_rng(2)
    rankings = spark.createDataFrame([(i, rng.permutation(5).tolist()) for i in range(200)], "ranking_id long, items array<int>")
    counts = breaking.pair_counts(rankings).selectExpr("7L t", "winner", "loser", "wins")
    want = {r["item"]: r["theta"] for r in estimators.rank_centrality(rankings, 5).collect()}
    fitted = dynamic.fit_over_time(counts, 5).collect()
    assert {r["item"]: r["theta"] for r in fitted} == pytest.approx(want, abs=1e-8)
    assert all(r["converged"] and r["iterations"] > 1 for r in fitted)
    assert not any(r["converged"] for r in dynamic.fit_over_time(counts, 5, max_iters=2).collect())


def test_many_items_walk_on_tables(spark, monkeypatch):
    df = spark.createDataFrame(random_counts(3, steps=3, m=60), COUNTS)
    dense = values(dynamic.fit_over_time(df, 5, eps=1e-10))
    monkeypatch.setattr(dynamic, "MAX_ITEMS", 4)
    assert values(dynamic.fit_over_time(df, 5, eps=1e-10)) == pytest.approx(dense, abs=1e-6)
    with pytest.raises(ValueError, match="too many"):
        dynamic.fit_over_time(df, 5, "gmm")


@pytest.mark.parametrize("estimator", ["rank_centrality", "bradley_terry", "cml"])
def test_a_known_course_is_found_better_with_more_data(spark, estimator):
    n, steps, rng = 6, 8, np.random.default_rng(4)
    true = np.array([[math.sin(t / 3 + i) for i in range(n)] for t in range(steps)])
    truth = spark.createDataFrame([(t, i, float(true[t, i])) for t in range(steps) for i in range(n)], "t long, item int, theta double")
    errors = []
    for m in (60, 6_000):
        rows = []
        for t in range(steps):
            a = rng.integers(0, n, m)
            b = (a + rng.integers(1, n, m)) % n
            first = rng.uniform(size=m) < 1 / (1 + np.exp(true[t, b] - true[t, a]))
            rows += [(t, int(w), int(x), 1.0) for w, x in zip(np.where(first, a, b), np.where(first, b, a), strict=True)]
        fitted = dynamic.fit_over_time(spark.createDataFrame(rows, COUNTS), n, estimator, lambd=1e-9)
        errors.append(sum(r["err"] for r in dynamic.course_error(fitted, truth).collect()) / steps)
    assert errors[1] < errors[0] / 5
    assert errors[1] < 0.1


def test_awkward_counts(spark):
    df = spark.createDataFrame([(None, 0, 1, 1.0), (1, None, 1, 1.0), (1, 2, 2, 9.0), (3, 0, 1, 1.0), (3, 0, 1, 1.0), (3, 1, 0, 0.0)], COUNTS)
    got = values(dynamic.fit_over_time(df, 4, nu=1.0))
    assert got.keys() == {(3, i) for i in range(4)}
    assert got[3, 0] - got[3, 1] == pytest.approx(math.log(3))  # 3 wins to 1
    assert got[3, 2] == got[3, 3]
    assert dynamic.fit_over_time(df.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        dynamic.fit_over_time(df, 4, "other")


def tarjan(nodes, edges):
    """Strongly connected components by depth-first search."""
    out, on, low, index, stack, count = {}, set(), {}, {}, [], [0]
    after = {v: [b for a, b in edges if a == v] for v in nodes}

    def visit(v):
        index[v] = low[v] = count[0]
        count[0] += 1
        stack.append(v)
        on.add(v)
        for w in after[v]:
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            part = []
            while not part or part[-1] != v:
                part.append(stack.pop())
                on.discard(part[-1])
            out.update(dict.fromkeys(part, min(part)))

    for v in nodes:
        if v not in index:
            visit(v)
    return out


def random_graphs(seed, many=40):
    """Disjoint random directed graphs of all densities, a long path, a long circle and nodes with a loop only."""
    rng, edges = random.Random(seed), []
    for g in range(many):
        n, p = rng.randrange(1, 14), rng.choice([0.05, 0.1, 0.15, 0.3])
        edges += [(100 * g + a, 100 * g + b) for a in range(n) for b in range(n) if rng.random() < p]
    edges += [(100_000 + i, 100_001 + i) for i in range(12)] + [(200_000 + i, 200_000 + (i + 1) % 15) for i in range(15)]
    return edges + [(300_000, 300_000)] + edges[:5]


def test_strong_components_and_levels_by_brute_force(spark):
    edges = random_graphs(5)
    nodes = sorted({v for e in edges for v in e})
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
    parts = graph.strong_components(df)
    want = tarjan(nodes, edges)
    assert {r["node"]: r["component"] for r in parts.collect()} == want
    over = {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    level = dict.fromkeys(want.values(), 0)
    for _ in nodes:
        for a, b in over:
            level[b] = max(level[b], level[a] + 1)
    assert {r["component"]: r["level"] for r in graph.component_levels(df.where("src is not null and dst is not null"), parts).collect()} == level
    empty = graph.strong_components(df.limit(0))
    assert empty.count() == 0 and graph.component_levels(df.limit(0), empty).count() == 0


PAIRS = "item int, opponent int, total double, p double"


def test_levels_are_copelands_order_without_circles(spark):
    order = [4, 1, 3, 0, 2]
    rows = [(a, b, 10.0, 0.7 if order.index(a) < order.index(b) else 0.3) for a in range(5) for b in range(5) if a != b]
    pairs = spark.createDataFrame(rows, PAIRS)
    got = {r["item"]: r["rank"] for r in graph.preference_levels(pairs).collect()}
    assert got == {r["item"]: r["rank"] for r in consensus.preference_order(pairs).collect()} == {x: i + 1 for i, x in enumerate(order)}


def test_levels_with_a_circle_a_tie_and_a_margin(spark):
    won = [(5, 0), (5, 1), (5, 2), (0, 1), (1, 2), (2, 0), (2, 3)]
    rows = [x for a, b in won for x in ((a, b, 6.0, 0.8), (b, a, 6.0, 0.2))] + [(3, 4, 2.0, 0.5), (4, 3, 2.0, 0.5)]
    pairs = spark.createDataFrame(rows, PAIRS)
    got = [(r["item"], r["component"], r["level"]) for r in sorted(graph.preference_levels(pairs).collect(), key=lambda r: r["rank"])]
    assert got == [(4, 4, 0), (5, 5, 0), (0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 3, 2)]
    assert {r["level"] for r in graph.preference_levels(pairs, margin=0.4).collect()} == {0}
    assert {r["level"] for r in graph.preference_levels(pairs, min_total=7).collect()} == {0}
    assert graph.preference_levels(pairs.limit(0)).count() == 0
