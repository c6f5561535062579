"""Queries that must read all their rows, on tables where a cut shows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefscale.jobs import fixtures as fx
from prefscale.jobs import registry
from prefscale.operators import breaking, evaluate, graph, mixture
from tests.compare import DATA, connection, same_rows

LARGER = "/root/testdata/sf0.01"


def test_weighted_breaking_has_every_place(spark):
    got = registry.QUERIES["rank_break_weighted"](spark, LARGER).toPandas()
    same_rows(got, connection(LARGER).sql(registry.SQL["rank_break_weighted"]).df())
    want = {}
    for r in fx.nation_rankings(spark, LARGER).collect():
        for i, a in enumerate(r["items"]):
            for j in range(i + 1, len(r["items"])):
                want[a, r["items"][j]] = want.get((a, r["items"][j]), 0) + 1 / (1 + i + j)
    assert {(r.winner, r.loser): r.wins for r in got.itertuples()} == pytest.approx(want, abs=2e-6)


def components(edges):
    """By union and find: node -> the smallest node of its component."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def test_components_of_all_parts_and_suppliers(spark):
    got = {r["node"]: r["component"] for r in registry.QUERIES["connected_components"](spark, LARGER).collect()}
    lines = connection(LARGER).sql("SELECT l_partkey, l_suppkey + 1000000000 FROM lineitem").fetchall()
    assert got == components(lines) and len(got) == 2100


def test_components_of_a_large_hot_and_long_graph(spark):
    rng = random.Random(4)
    path = list(range(300))
    rng.shuffle(path)
    edges = list(zip(path, path[1:]))
    edges += [(10_000, 10_001 + i) for i in range(500)]
    edges += [(20_000 + rng.randrange(300), 20_000 + rng.randrange(300)) for _ in range(200)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components(edges)


def test_every_user_gets_every_item(spark):
    [(users, items)] = connection(DATA).sql("SELECT count(DISTINCT o_custkey), count(DISTINCT l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()
    got = registry.QUERIES["complete_ratings"](spark, DATA).collect()
    assert sorted(r["ranking_id"] for r in got) == list(range(users))
    assert all(sorted(map(int, r["items"].split(","))) == list(range(items)) for r in got)


@pytest.mark.parametrize(("name", "operator", "counts"), [("fit_mixture_mm", "fit_mixture", {"max_iters", "tol"}), ("sample_posterior", "sample_posterior", {"n_samples", "burn"}), ("mixture_moments", "mixture_moments", {"iters"})])
def test_fits_run_to_their_own_stop(spark, monkeypatch, name, operator, counts):
    class Seen(Exception):
        pass

    def see(*args, **named):
        raise Seen(named)

    monkeypatch.setattr(mixture, operator, see)
    with pytest.raises(Seen) as got:
        registry.QUERIES[name](spark, DATA)
    assert not counts & set(got.value.args[0])


def test_assignment_by_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(300):
        n = int(rng.integers(1, 6))
        m = int(rng.integers(n, 7))
        cost = rng.integers(-4, 5, (n, m)).astype(float) if trial % 2 else rng.normal(size=(n, m))
        got = evaluate.assignment(cost)
        assert len(set(got)) == n
        assert cost[range(n), got].sum() == pytest.approx(min(cost[range(n), p].sum() for p in itertools.permutations(range(m), n)))


def test_twelve_labels_are_matched(spark):
    rows = [(i, (i * 5 + 3) % 12) for i in range(12) for _ in range(5)] + [(i, j) for i in range(12) for j in range(12)]
    got = evaluate.clustering_accuracy(spark.createDataFrame(rows, "true int, pred int")).first()["accuracy"]
    assert got == pytest.approx(12 * 6 / len(rows))
    params = spark.createDataFrame([(c, i, float((c * 7 + i * i) % 13)) for c in range(10) for i in range(4)], "component int, item int, theta double")
    turned = params.withColumn("component", (params["component"] * 3 + 1) % 10)
    assert evaluate.mixture_l2_error(params, turned).first()["err"] == pytest.approx(0, abs=1e-6)
    assert evaluate.mixture_l2_error(params.limit(0), turned).first()["err"] == 0


def test_pairs_met_often_are_those_of_the_pair_table(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PAIRS", 300)
    monkeypatch.setattr(graph, "GROUP_PAIRS", 100)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.permutation(60)[: rng.integers(0, 12)] * 30_000_000).tolist() if i % 9 else None, float(i % 3) / 2) for i in range(700)]
    rows += [(1000 + i, [7, 11], 1.0) for i in range(50)] + [(2000, [5, 5, 9], 3.0)]
    df = spark.createDataFrame(rows, "ranking_id long, items array<long>, weight double").repartition(3)
    want = breaking.pair_probs(breaking.pair_counts(df)).where("total >= 3")
    got = graph.pairs_met_often(df, 3.0)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert graph.pairs_met_often(df.limit(0), 3.0).count() == 0
    levels = graph.preference_levels(got, 0.1, 3.0, df.where("size(items) > 1").select(F.explode("items").alias("item")))
    assert sorted(map(tuple, levels.collect())) == sorted(map(tuple, graph.preference_levels(breaking.pair_probs(breaking.pair_counts(df)), 0.1, 3.0).collect()))
