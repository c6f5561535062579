"""SQL functions give the rows of their DataFrame forms, in a JVM plan."""

import pytest
from pyspark.sql import functions as F

from prefscale.functions import embeddings as emb
from prefscale.functions.sql import SCALARS, TABLES, register_sql
from prefscale.operators import breaking, evaluate

ROWS = [(1, [3, 1, 2, 0]), (2, [4]), (3, []), (4, None), (1, [3, 1, 2, 0]), (5, [0, 4])]


@pytest.fixture(scope="module")
def rankings(spark):
    assert len(register_sql(spark)) == len(SCALARS) + len(TABLES)
    register_sql(spark)  # again does no harm
    return spark.createDataFrame(ROWS, "ranking_id long, items array<int>")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rank_break(spark, rankings):
    got = spark.sql("SELECT ranking_id, b.* FROM {r} r, LATERAL rank_break(r.items) b", r=rankings)
    assert rows(got) == rows(breaking.rank_break(rankings).drop("weight"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Python" not in plan


def test_pair_entries_and_places(spark, rankings):
    got = spark.sql("SELECT ranking_id, e.* FROM {r} r, LATERAL pair_entries(r.items, 5) e", r=rankings)
    assert rows(got) == rows(emb.embed_pairwise(breaking.rank_break(rankings), 5))
    got = spark.sql("SELECT ranking_id, e.* FROM {r} r, LATERAL ranked_items(r.items) e", r=rankings)
    assert rows(got) == rows(rankings.select("ranking_id", F.posexplode("items")))


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_embeddings(spark, rankings, n):
    known = rankings.where("items is not null")
    items = F.col("items")
    want = known.select("ranking_id", emb.embed_lehmer(items), emb.embed_positional(items, n), emb.embed_topk(items, n, 2), emb.embed_disjoint_pairs(items, n), emb.embed_pairwise_expected(items, n))
    got = spark.sql(f"SELECT ranking_id, embed_lehmer(items), embed_positional(items, {n}), embed_topk(items, {n}, 2), embed_disjoint_pairs(items, {n}), embed_pairwise_expected(items, {n}) FROM {{r}}", r=known)
    assert rows(got) == rows(want)


def test_likelihood_and_accuracy(spark, rankings):
    params = spark.createDataFrame([(0, i, i / 3 - 1) for i in range(5)], "component int, item int, theta double")
    maps = params.agg(F.map_from_entries(F.collect_list(F.struct("item", "theta"))).alias("thetas"))
    known = rankings.where("items is not null")
    got = spark.sql("SELECT ranking_id, pl_log_likelihood(items, thetas), top_k_accuracy(items, array(3, 0, 1), 2) FROM {r} CROSS JOIN {m}", r=known, m=maps)
    ll = {r["ranking_id"]: r["ll"] for r in evaluate.pl_log_likelihood(known, params).collect()}
    for ranking_id, value, acc in got.collect():
        assert value == pytest.approx(ll[ranking_id])
        assert acc == {1: 0.5, 2: 0.0, 3: 0.0, 5: 0.5}[ranking_id]
