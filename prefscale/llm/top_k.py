"""Exact top-k inner-product search with one ball tree per shard.

Vectors of one length are dealt to cells by their nearest pivot, and cells to shards of bounded size, so that a shard
holds vectors that lie together; each shard builds a ball tree once. Queries are rows of the table, so a shard's queries
first search their own shard, which gives each a k-th score that no later candidate may fall below. They go on in packed
blocks with their vectors, best hits and k-th scores. The trees' roots (a centre and a radius a shard) are sent to all
tasks: a query goes to another shard only if the root's bound reaches its k-th score. It goes in two waves: to the
shards with the best bounds first, then, with the k-th score that it has by then, to all others that still may hold a
hit. Within a tree, nodes are taken in the order of the upper bound ``q.c + |q| r`` of their inner products, and the
search ends when the bound is below the k-th score.

The pivots are up to MAX_PIVOTS vectors of the smallest hashes; they only steer which vectors lie together. All vectors
are in a tree, and results are exact whatever the pivots. Roots are at most MAX_SHARDS in all: beyond that, shards grow.

Defined results: vectors that are null, hold a null or a non-finite component, or have no vec_id take no part; rows
that repeat a vec_id are one row (the greatest vector of them); vectors are compared with vectors of their length only;
equal scores go to the smaller vec_id; a query with fewer candidates than k gets all of them. Scores are exact while
they fit a long.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.session import cut, ship, table

K = 5
QUERY_STEP = 50
SHARD_ROWS = 8_192
BLOCK_ROWS = 512
#: Blocks of queries that meet a shard in one group.
STRIPE_BLOCKS = 16
#: Pivots of a length, lengths that get pivots (the most common ones), and shards in all.
MAX_PIVOTS, PIVOT_LENGTHS, MAX_SHARDS = 1_024, 16, 65_536
#: Shards that a query goes to in the first wave.
WAVE = 4
LEAF = 64
EXACT_FLOAT = float(1 << 53)
#: The floor of a query that hasn't k candidates yet.
LOWEST = -(1 << 63)
#: A block of queries: ids, vectors, hits (k a query) and the shards searched so far, pickled.
BLOCK = "dim int, home long, number int, state binary"
SENT = "dim int, shard long, stripe int, home long, number int, queries long, state binary"
FOUND = "dim int, home long, number int, hits binary"
HITS = "query_id long, vec_id long, score long"


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """What no inner product of a query (rows) with a point of a ball (columns) can exceed."""
    size = np.sqrt((queries * queries).sum(1))[:, None]
    # rounding must not cut a tie off: the error of a sum of products is bounded by the product of the sizes
    return queries @ centres.T + size * radii + 1e-6 + 1e-9 * size * (np.sqrt((centres * centres).sum(1)) + radii)


class BallTree:
    """Points in leaves; per node a centre, a radius and its children (or -1 and the range of its points)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order, centres, radii, spans, below = [], [], [], [], []
        stack = [(np.arange(len(ids)), -1, 0)]
        while stack:
            part, parent, side = stack.pop()
            own = points[part].astype(np.float64)
            centre = own.mean(0)
            far = np.sqrt(((own - centre) ** 2).sum(1))
            number = len(centres)
            centres.append(centre)
            radii.append(far.max())
            below.append([-1, -1])
            spans.append((len(order), len(order)))
            if parent >= 0:
                below[parent][side] = number
            if len(part) <= LEAF or far.max() == 0:
                order.extend(part.tolist())
                spans[-1] = (len(order) - len(part), len(order))
                continue
            a = own[far.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            rank = np.argsort(own @ (b - a), kind="stable")
            half = len(part) // 2
            stack.append((part[rank[half:]], number, 1))
            stack.append((part[rank[:half]], number, 0))
        self.ids, self.points = ids[order], points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.spans, self.below = spans, below
        self.largest = float(np.abs(points).max(initial=0))

    def search(self, own_id: int, query: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, -id) that reach ``floor``, but not the query's own row."""
        q = query.astype(np.float64)
        bounds = upper_bounds(q[None, :], self.centres, self.radii)[0]
        safe = self.largest * np.abs(q).sum() < EXACT_FLOAT
        heap, best = [(-bounds[0], 0)], []
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            left, right = self.below[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            a, b = self.spans[node]
            scores = (self.points[a:b] @ q).astype(np.int64) if safe else self.points[a:b].astype(np.int64) @ query.astype(np.int64)
            near = np.flatnonzero((scores >= floor) & (self.ids[a:b] != own_id))
            if len(near):
                near = near[np.lexsort((self.ids[a:b][near], -scores[near]))[:k]]
                best = sorted([*best, *zip(scores[near].tolist(), (-self.ids[a:b][near]).tolist(), strict=True)], reverse=True)[:k]
                if len(best) == k:
                    floor = max(floor, best[-1][0])
        return best


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vec, dim): integer vectors of the rows that take part, one a vec_id."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    vec = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).groupBy("vec_id").agg(F.max("vec").alias("vec")).withColumn("dim", F.size("vec"))


def pivots_of(vectors: DataFrame, sizes: list, shard_rows: int) -> dict[int, np.ndarray]:
    """By length, vectors of the smallest hashes, about one for each shard, each once."""
    many = {r["dim"]: min(MAX_PIVOTS, -(-r["n"] // shard_rows)) for r in sizes[:PIVOT_LENGTHS]}
    out = {}
    for dim, n in many.items():
        if n > 1:
            rows = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vec").collect()
            out[dim] = np.unique(np.array([r["vec"] for r in rows], np.float64), axis=0)
    return out


def dealt(vectors: DataFrame, pivots: dict[int, np.ndarray], shard_rows: int) -> DataFrame:
    """``vectors`` with shard: the nearest pivot's cell, and within a cell a part of about shard_rows by hash."""

    @F.pandas_udf("long")
    def cell(vecs: pd.Series, dims: pd.Series) -> pd.Series:
        out = np.zeros(len(vecs), np.int64)
        for dim in dims.unique():
            if (p := pivots.get(int(dim))) is None:
                continue
            own = np.flatnonzero((dims == dim).to_numpy())
            for i in range(0, len(own), 1024):
                some = own[i : i + 1024]
                x = np.stack(vecs.iloc[some].to_list()).astype(np.float64)
                out[some] = ((p * p).sum(1) / 2 - x @ p.T).argmin(1)
        return pd.Series(out)

    rows = cut(vectors.withColumn("cell", cell("vec", "dim"))) if pivots else vectors.withColumn("cell", F.lit(0).cast("long"))
    parts = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return rows.join(parts, ["dim", "cell"]).select("dim", (F.shiftleft("cell", 32) + part).alias("shard"), "vec_id", "vec")


def plant(rows: pd.DataFrame) -> pd.DataFrame:
    tree = BallTree(rows["vec_id"].to_numpy(np.int64), np.array(rows["vec"].tolist()).reshape(len(rows), -1))
    root = pickle.dumps((tree.centres[0], float(tree.radii[0])), protocol=5)
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "shard": rows["shard"].iloc[:1], "tree": [pickle.dumps(tree, protocol=5)], "root": [root]})


def nothing(ddl: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in ddl.split(", ")])


def first_search(k: int, block_rows: int):
    """A shard's own queries search it, and become blocks."""

    def work(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(trees) and len(queries):
            tree, shard = pickle.loads(trees["tree"].iloc[0]), int(trees["shard"].iloc[0])
            queries = queries.sort_values("vec_id")
            for i in range(0, len(queries), block_rows):
                some = queries.iloc[i : i + block_rows]
                ids, vecs = some["vec_id"].to_numpy(np.int64), np.array(some["vec"].tolist()).reshape(len(some), -1)
                state = {"ids": ids, "vecs": vecs, "hits": [tree.search(own, vec, k, LOWEST) for own, vec in zip(ids, vecs, strict=True)], "seen": [[shard]] * len(ids)}
                out.append((int(some["dim"].iloc[0]), shard, i // block_rows, pickle.dumps(state, protocol=5)))
        return pd.DataFrame(out, columns=["dim", "home", "number", "state"]) if out else nothing(BLOCK)

    return work


def floors_of(hits: list, k: int) -> np.ndarray:
    return np.array([h[-1][0] if len(h) == k else LOWEST for h in hits], np.int64)


def sends(roots, stripes: dict[int, int], k: int, most: int | None):
    """Blocks -> for each shard the queries whose k-th score its root's bound reaches, at most ``most`` shards a query."""

    def wanted(dim: int, state: dict, floors: np.ndarray) -> np.ndarray:
        shards, centres, radii = roots.value[dim]
        out, step = [], max(1, 2_000_000 // len(shards))
        for i in range(0, len(floors), step):
            bounds = upper_bounds(state["vecs"][i : i + step].astype(np.float64), centres, radii)
            bounds[bounds < floors[i : i + step, None]] = -np.inf
            for own, seen in zip(bounds, state["seen"][i : i + step], strict=True):
                own[np.searchsorted(shards, seen)] = -np.inf
            if most is not None and len(shards) > most:
                np.put_along_axis(bounds, np.argpartition(-bounds, most - 1, axis=1)[:, most:], -np.inf, axis=1)
            out.append(bounds > -np.inf)
        return np.concatenate(out)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, home, number, blob in zip(part["dim"], part["home"], part["number"], part["state"], strict=True):
                state, shards = pickle.loads(blob), roots.value[dim][0]
                floors = floors_of(state["hits"], k)
                go = wanted(dim, state, floors)
                stripe = int(np.searchsorted(shards, home)) * stripes[dim] // len(shards)
                targets = np.flatnonzero(go.any(0))
                for i in range(0, len(targets), 256):
                    rows = []
                    for j in targets[i : i + 256]:
                        own = np.flatnonzero(go[:, j])
                        sent = {"at": own, "ids": state["ids"][own], "vecs": state["vecs"][own], "floors": floors[own]}
                        rows.append((dim, int(shards[j]), stripe, home, number, len(own), pickle.dumps(sent, protocol=5)))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])

    return work


def searches(k: int, last: bool):
    """Blocks' queries search a shard's tree: (shard, places in the block, hits by place); in the last wave only hits count."""

    def work(trees: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(trees) and len(sent):
            tree, shard = pickle.loads(trees["tree"].iloc[0]), int(trees["shard"].iloc[0])
            for dim, home, number, blob in zip(sent["dim"], sent["home"], sent["number"], sent["state"], strict=True):
                s = pickle.loads(blob)
                hits = {int(at): more for at, own, vec, floor in zip(s["at"], s["ids"], s["vecs"], s["floors"], strict=True) if (more := tree.search(own, vec, k, int(floor)))}
                if hits or not last:
                    out.append((dim, home, number, pickle.dumps((shard, [] if last else s["at"].tolist(), hits), protocol=5)))
        return pd.DataFrame(out, columns=["dim", "home", "number", "hits"]) if out else nothing(FOUND)

    return work


def merges(k: int):
    """A block with what its queries found elsewhere."""

    def work(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return nothing(BLOCK)
        state = pickle.loads(blocks["state"].iloc[0])
        for blob in found["hits"]:
            shard, places, hits = pickle.loads(blob)
            for at in places:
                state["seen"][at] = [*state["seen"][at], shard]
            for at, more in hits.items():
                state["hits"][at] = sorted([*state["hits"][at], *more], reverse=True)[:k]
        return blocks[["dim", "home", "number"]].assign(state=[pickle.dumps(state, protocol=5)])

    return work


def meet(trees: DataFrame, sent: DataFrame, k: int, last: bool) -> DataFrame:
    """Each (dim, shard, stripe) of blocks searches its shard's tree."""
    keys = ["dim", "shard", "stripe"]
    wanted = sent.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("stripe").alias("t")).distinct()
    copies = trees.join(wanted, (F.col("dim") == F.col("d")) & (F.col("shard") == F.col("s"))).select(F.col("d").alias("dim"), F.col("s").alias("shard"), F.col("t").alias("stripe"), "tree")
    return copies.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(searches(k, last), FOUND)


def searched(rows: DataFrame, is_query, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(hits, meetings): (query_id, vec_id, score) of the k best of the rows where ``is_query`` holds, and how many
    queries went to which shard besides their own: (dim, shard, queries)."""
    spark = rows.sparkSession
    ship(spark)
    vectors = cut(whole_vectors(rows))
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked")).orderBy(F.desc("n"), "dim").limit(MAX_SHARDS).collect()
    shard_rows = max(shard_rows, -(-sum(r["n"] for r in sizes) // MAX_SHARDS))
    placed = cut(dealt(vectors, pivots_of(vectors, sizes, shard_rows), shard_rows))
    trees = cut(placed.groupBy("dim", "shard").applyInPandas(plant, "dim int, shard long, tree binary, root binary"))
    asked = placed.where(is_query)
    keys = ["dim", "shard"]
    blocks = cut(trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(first_search(k, block_rows), BLOCK))
    many = [r["dim"] for r in sizes if r["n"] > shard_rows]  # the others have one shard
    by: dict[int, list] = {}
    for r in trees.where(F.col("dim").isin(many)).select("dim", "shard", "root").collect() if many else []:
        by.setdefault(r["dim"], []).append((r["shard"], *pickle.loads(r["root"])))
    if not by:
        return blocks.mapInPandas(hits_of, HITS), None
    by = {dim: sorted(x, key=lambda r: r[0]) for dim, x in by.items()}
    roots = spark.sparkContext.broadcast({dim: (np.array([r[0] for r in x], np.int64), np.array([r[1] for r in x]), np.array([r[2] for r in x])) for dim, x in by.items()})
    stripes = {r["dim"]: max(1, r["asked"] // (block_rows * STRIPE_BLOCKS)) for r in sizes}
    home, meetings = ["dim", "home", "number"], []
    for most in (WAVE, None):
        sent = cut(blocks.where(F.col("dim").isin(many)).mapInPandas(sends(roots, stripes, k, most), SENT))
        found = meet(trees, sent, k, most is None)
        blocks = cut(blocks.groupBy(*home).cogroup(found.groupBy(*home)).applyInPandas(merges(k), BLOCK))
        meetings.append(sent.select("dim", "shard", "queries"))
    return blocks.mapInPandas(hits_of, HITS), meetings[0].unionByName(meetings[1])


def hits_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for blob in part["state"]:
            state = pickle.loads(blob)
            rows = [(own, -neg, score) for own, hits in zip(state["ids"], state["hits"], strict=True) for score, neg in hits]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(rows: DataFrame, is_query, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows (vec_id, embedding) -> (query_id, rank, vec_id, score) for the rows where ``is_query``, a condition on vec_id, holds."""
    hits, _ = searched(rows, is_query, k, shard_rows, block_rows)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, max([floor(256 * x::DOUBLE)::BIGINT for x in embedding]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
