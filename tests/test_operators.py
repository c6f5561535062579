"""Hand-made cases and brute force for the ranking operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefscale.functions import embeddings as emb
from prefscale.functions import kernels as k
from prefscale.functions.links import gennorm, gumbel_ev, laplace, log_normal_cdf_np, logit, probit
from prefscale.operators import breaking, consensus, evaluate, graph, prepare, sampling
from prefscale.sources import readers
from prefscale.streaming import timed

MICRO = [[0, 1, 2], [0, 2, 1], [1, 0, 2]]


def rankings(spark, rows, weights=None):
    data = [(i, r, float(weights[i]) if weights else 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ranking_id long, items array<int>, weight double")


def as_dict(df, *keys):
    return {tuple(r[x] for x in keys[:-1]): r[keys[-1]] for r in df.collect()}


def test_micro_pair_counts_and_borda(spark):
    r = rankings(spark, MICRO)
    assert as_dict(breaking.pair_counts(r), "winner", "loser", "wins") == {(0, 1): 2, (1, 0): 1, (0, 2): 3, (1, 2): 2, (2, 1): 1}
    assert as_dict(consensus.borda(r), "item", "score") == {(0,): 5, (1,): 3, (2,): 1}
    order = consensus.preference_order(breaking.pair_probs(breaking.pair_counts(r))).orderBy("rank").collect()
    assert [x["item"] for x in order] == [0, 1, 2] and order[0]["is_transitive"]


def test_short_and_empty_rankings_have_no_comparisons(spark):
    r = rankings(spark, [[1], [], [0, 1]])
    assert breaking.rank_break(r).count() == 1
    assert breaking.rank_break(r, "random").count() == 1
    assert as_dict(consensus.win_counts(r), "item", "wins") == {(0,): 1}
    params = spark.createDataFrame([(0, 0, 0.5), (0, 1, -0.5)], "component int, item int, theta double")
    lls = as_dict(evaluate.pl_log_likelihood(r, params), "ranking_id", "ll")
    assert lls[(0,)] == 0 and lls[(1,)] == 0 and lls[(2,)] < 0


def test_weights_are_repeats(spark):
    once = rankings(spark, MICRO, [2, 1, 3])
    many = rankings(spark, [MICRO[0]] * 2 + [MICRO[1]] + [MICRO[2]] * 3)
    assert as_dict(breaking.pair_counts(once), "winner", "loser", "wins") == as_dict(breaking.pair_counts(many), "winner", "loser", "wins")
    assert as_dict(prepare.compact_rankings(many).withColumn("i", F.col("items").cast("string")), "i", "weight") == {(str(m),): w for m, w in zip(MICRO, (2, 1, 3), strict=True)}


def test_random_matching_pairs_each_place_once(spark):
    r = rankings(spark, [list(range(n)) for n in (2, 3, 7, 8)])
    pairs = breaking.rank_break(r, "random", 3).collect()
    for i, n in enumerate((2, 3, 7, 8)):
        places = [p for x in pairs if x["ranking_id"] == i for p in (x["pos_i"], x["pos_j"])]
        assert len(places) == len(set(places)) == n // 2 * 2
    assert all(x["pos_i"] < x["pos_j"] for x in pairs)


def test_plackett_luce_sums_to_one(spark):
    perms = [list(p) for p in itertools.permutations(range(4))]
    params = spark.createDataFrame([(0, i, t) for i, t in enumerate((0.3, -1.2, 0.9, 0.0))], "component int, item int, theta double")
    total = evaluate.pl_log_likelihood(rankings(spark, perms), params).agg(F.sum(F.exp("ll"))).first()[0]
    assert total == pytest.approx(1)


def test_expected_embedding_by_enumeration(spark):
    partial, n = [3, 1], 4
    fits = [p for p in itertools.permutations(range(n)) if [x for x in p if x in partial] == partial]
    want = [np.mean([p.index(i) < p.index(j) for p in fits]) for i in range(n) for j in range(i + 1, n)]
    got = rankings(spark, [partial]).select(emb.embed_pairwise_expected(F.col("items"), n).alias("e")).first()["e"]
    assert got == pytest.approx(want)


def test_lehmer_and_positions(spark):
    row = rankings(spark, [[2, 0, 1]]).select(emb.embed_lehmer(F.col("items")).alias("a"), emb.embed_positional(F.col("items"), 3).alias("b")).first()
    assert row["a"] == [0, 1, 1] and row["b"] == [1, 2, 0]


def test_kernels_match_window_forms(spark):
    rng = np.random.default_rng(0)
    rows = [rng.permutation(6)[: rng.integers(1, 7)].tolist() for _ in range(60)]
    theta = rng.normal(size=6)
    params = spark.createDataFrame([(0, i, float(t)) for i, t in enumerate(theta)], "component int, item int, theta double")
    r = rankings(spark, rows)
    idx, _ = k.matrix(rows)
    den = as_dict(consensus.choice_denominators(r, params), "item", "denom")
    assert [den[(i,)] for i in range(6)] == pytest.approx(k.denominators(theta, idx, np.ones(len(idx))).tolist())
    flow = as_dict(consensus.luce_flows(r, params), "loser", "winner", "rate")
    table = k.flows(theta, idx, np.ones(len(idx)))
    assert all(table[a, b] == pytest.approx(v) for (a, b), v in flow.items())
    assert k.log_likelihood(theta[None], idx).sum() == pytest.approx(evaluate.pl_log_likelihood(r, params).agg(F.sum("ll")).first()[0])


@pytest.mark.parametrize("which", [logit(), laplace(), probit(), gumbel_ev(), gennorm(1.5)])
def test_links_invert(which):
    p = np.array([0.05, 0.3, 0.5, 0.8, 0.95])
    assert which.np_cdf(which.np_phi(p)) == pytest.approx(p, abs=1e-4)
    x, h = np.array([-0.7, 0.1, 0.6]), 1e-4
    assert (which.np_cdf(x + h) - which.np_cdf(x - h)) / (2 * h) == pytest.approx(which.np_pdf(x), abs=1e-3)


def test_log_normal_cdf_far_left():
    value, slope = log_normal_cdf_np(np.array([-40.0, -5.0, 0.0]))
    assert value[2] == pytest.approx(math.log(0.5)) and value[0] == pytest.approx(-804.608, abs=1e-2)
    assert slope[0] == pytest.approx(40, abs=0.1)


def test_components_and_connectivity(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = as_dict(graph.connected_components(edges), "node", "component")
    assert {got[(i,)] for i in range(41)} == {0} and got[(101,)] == 100
    assert not graph.is_connected(edges, 43)
    assert graph.is_connected(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), 3)
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ballots_from_files(spark, tmp_path):
    (tmp_path / "b.toc").write_text("3\n1,A\n2,B\n3,C\n5,5,2\n4,1,2,{3}\n1,{2,3}\n")
    rows = {(r["votes"], tuple(r["items"]), tuple(r["tied_tail"])) for r in readers.read_ballots(spark, str(tmp_path)).collect()}
    assert rows == {(4, (0, 1), (2,)), (1, (), (1, 2))}
    ranked = prepare.rankings_from_ballots(readers.read_ballots(spark, str(tmp_path)))
    assert ranked.count() == 5 and all(len(set(r["items"])) == len(r["items"]) for r in ranked.collect())


def test_rating_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u,i,r,t\n1,2,3.5,9\n4,5,1,9\n")
    (tmp_path / "a.dat").write_text("1::2::3::9\n")
    (tmp_path / "a.json").write_text('{"item_id": 2, "user_id": 1, "rating": 4}\n')
    assert sorted(tuple(r) for r in readers.read_ratings(spark, str(tmp_path / "a.csv"), header=True).collect()) == [(1, 2, 3.5), (4, 5, 1.0)]
    assert [tuple(r) for r in readers.read_ratings(spark, str(tmp_path / "a.dat"), "::").collect()] == [(1, 2, 3.0)]
    assert [tuple(r) for r in readers.read_ratings_json(spark, str(tmp_path / "a.json")).collect()] == [(1, 2, 4.0)]


def test_rankings_and_results_round_trip(spark, tmp_path):
    r = rankings(spark, MICRO)
    readers.write_rankings(r, str(tmp_path / "r"))
    assert readers.read_rankings(spark, str(tmp_path / "r")).exceptAll(r).count() == 0
    res = spark.createDataFrame([("d", "mm", 2, 100, "ll", -1.0)], "dataset string, method string, k int, m long, metric string, value double")
    readers.write_results(res, str(tmp_path / "res"))
    assert (tmp_path / "res" / "method=mm").exists()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", [0, 1, 2]), ("2024-01-01 05:00:00", [1, 0]), ("2024-01-02 05:00:00", [2, 1]), ("2024-01-05 00:00:00", [0, 1])]
    df = spark.createDataFrame(rows, "ts string, items array<int>").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = timed.pair_counts_by_time(stream, watermark="1 hour").writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from pairs").collect()}
    want = {tuple(r) for r in timed.pair_counts_by_time(df).collect()}
    assert got <= want and {r for r in want if r[0].day < 5} == got  # the last window is still open


def test_sampling_recovers_the_model(spark):
    params = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (0, 2, -1.0)], "component int, item int, theta double")
    r = sampling.sample_rankings(params, 3000)
    first = r.where(F.col("items")[0] == 0).count() / 3000
    assert first == pytest.approx(math.e / (math.e + 1 + 1 / math.e), abs=0.03)
    mix = spark.createDataFrame([(0, 0.25), (1, 0.75)], "component int, alpha double")
    both = params.unionByName(params.withColumn("component", F.lit(1)).withColumn("theta", -F.col("theta")))
    z = as_dict(sampling.sample_mixture_rankings(both, mix, 4000).groupBy("component").count(), "component", "count")
    assert z[(0,)] / 4000 == pytest.approx(0.25, abs=0.03) and sum(z.values()) == 4000


def test_split_parts_are_disjoint_and_whole(spark):
    r = rankings(spark, [[i % 5, 5] for i in range(103)])
    for mode in ("exact", "hash"):
        parts = prepare.split_rankings(r, mode=mode).select("ranking_id", "part")
        each = [parts.where(F.col("part") == p).select("ranking_id") for p in ("train", "val", "test")]
        assert evaluate.check_split(each, r.select("ranking_id")).count() == 0
    exact = as_dict(prepare.split_rankings(r).groupBy("part").count(), "part", "count")
    assert exact == {("train",): 66, ("val",): 16, ("test",): 21}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_random_matching_sorts_a_ranking_once(spark):
    rows = spark.createDataFrame([(0, [3, 1, 2])], "ranking_id long, items array<int>")
    assert plan_of(breaking.rank_break(rows, "random", 1)).count("array_sort(") == 1


def test_entries_meet_a_small_model_in_their_task(spark):
    rows = spark.createDataFrame([(i, [i % 3, 3, 4]) for i in range(20)], "ranking_id long, items array<int>")
    params = spark.range(5).select(F.lit(0).alias("component"), F.col("id").cast("int").alias("item"), F.lit(0.5).alias("theta"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = consensus.placed(rows, params)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
