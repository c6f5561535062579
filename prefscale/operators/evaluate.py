"""Likelihoods, errors and matches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefscale.functions.hashing import hash_uniform
from prefscale.functions.links import link as named_link
from prefscale.operators.breaking import weight_of


#: Models of up to so many rows (components x items) are sent to every task; the rows of a larger one go to the rankings
#: that hold their items.
MODEL_ROWS = 200_000


def param_maps(params: DataFrame) -> DataFrame:
    """(component, thetas): one map item -> theta a component; as large as the model."""
    return params.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("item", "theta"))).alias("thetas"))


def centre(params: DataFrame) -> DataFrame:
    """Thetas moved to mean 0 in each component; a component that is not finite becomes all zeros."""
    means = params.groupBy("component").agg(F.avg("theta").alias("mean"), F.max(F.isnan("theta") | (F.abs("theta") == float("inf"))).alias("bad"))
    theta = F.when(F.col("bad"), 0.0).otherwise(F.col("theta") - F.col("mean"))
    return params.join(means, "component").select("component", "item", theta.alias("theta"))


def softmax(params: DataFrame) -> DataFrame:
    """``params`` with ``share``: e^theta over its sum in the component, by a max-shifted sum."""
    top = params.groupBy("component").agg(F.max("theta").alias("top"))
    rows = params.join(top, "component").withColumn("e", F.exp(F.col("theta") - F.col("top")))
    sums = rows.groupBy("component").agg(F.sum("e").alias("sum"))
    return rows.join(sums, "component").select("component", "item", "theta", (F.col("e") / F.col("sum")).alias("share"))


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of e^x over an array, shifted by its largest."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def ranking_log_likelihood(items: Column, thetas: Column) -> Column:
    """Plackett-Luce log-likelihood of a ranking, from its end: each place adds theta minus ln of the suffix sum."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("ll"))

    def step(acc: Column, item: Column) -> Column:
        theta = thetas[item]
        whole = acc["sum"] + F.exp(theta)
        return F.struct(whole.alias("sum"), (acc["ll"] + F.when(acc["sum"] > 0, theta - F.log(whole)).otherwise(0.0)).alias("ll"))

    return F.aggregate(F.reverse(items), start, step, lambda acc: acc["ll"])


def is_small(params: DataFrame) -> bool:
    return params.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS


def own_maps(rows: DataFrame, params: DataFrame) -> DataFrame:
    """(items, component, thetas) for the distinct ``items`` of ``rows``: maps of their own items only."""
    own = rows.select("items").distinct().select("items", F.explode(F.array_distinct("items")).alias("item")).join(params, "item")
    return own.groupBy("items", "component").agg(F.map_from_entries(F.collect_list(F.struct("item", "theta"))).alias("thetas"))


def with_thetas(rows: DataFrame, params: DataFrame) -> DataFrame:
    """``rows`` (items, ...) with component and thetas, a map. A small model goes to every task as one map a component, and
    nothing is shuffled; of a large one each row gets its own items."""
    if is_small(params):
        return rows.join(F.broadcast(param_maps(params)))
    return rows.join(params.select("component").distinct()).join(own_maps(rows, params), ["items", "component"], "left")


def pl_log_likelihood(rankings: DataFrame, params: DataFrame) -> DataFrame:
    """(ranking_id, component, ll, weight)."""
    rows = with_thetas(rankings.select("ranking_id", "items", weight_of(rankings).alias("weight")), params)
    return rows.select("ranking_id", "component", ranking_log_likelihood(F.col("items"), F.col("thetas")).alias("ll"), "weight")


def model_row(params: DataFrame, mixture: DataFrame) -> DataFrame:
    """One row: an array of (component, ln alpha, thetas)."""
    total = mixture.agg(F.sum("alpha").alias("total"), F.count("*").alias("k"))
    rows = param_maps(params).join(mixture, "component").join(total)
    share = F.col("alpha") / F.col("total")
    log_alpha = F.log(F.when(F.isnan(share) | share.isNull(), 1.0 / F.col("k")).otherwise(share))
    return rows.agg(F.array_sort(F.collect_list(F.struct("component", log_alpha.alias("log_alpha"), "thetas")), lambda a, b: a["component"] - b["component"]).alias("model"))


def with_model(rows: DataFrame, params: DataFrame, mixture: DataFrame) -> DataFrame:
    """``rows`` with ``model``, an array of (component, ln alpha, thetas); of a large model only the row's own items."""
    if is_small(params):
        return rows.join(F.broadcast(model_row(params, mixture)))
    shares = model_row(params.groupBy("component").agg(F.min("item").alias("item")).withColumn("theta", F.lit(0.0)), mixture)
    shares = shares.select(F.explode("model").alias("m")).select("m.component", "m.log_alpha")
    own = own_maps(rows, params).join(shares, "component").groupBy("items")
    own = own.agg(F.array_sort(F.collect_list(F.struct("component", "log_alpha", "thetas")), lambda a, b: a["component"] - b["component"]).alias("model"))
    return rows.join(own, "items", "left")


def responsibilities(rankings: DataFrame, params: DataFrame, mixture: DataFrame, trim: float | None = None, hard: bool = False, seed: object = 0) -> DataFrame:
    """(ranking_id, component, q, weight): posterior of each component. trim: smaller ones become 0 and the rest are
    scaled up; hard: one component is drawn by hash and gets 1."""
    rows = with_model(rankings.select("ranking_id", "items", weight_of(rankings).alias("weight")), params, mixture)
    logs = F.transform("model", lambda m: ranking_log_likelihood(F.col("items"), m["thetas"]) + m["log_alpha"])
    rows = rows.withColumn("logs", logs)
    rows = rows.withColumn("q", F.transform("logs", lambda x: F.exp(x - log_sum_exp(F.col("logs")))))
    if trim is not None:
        rows = rows.withColumn("q", F.transform("q", lambda x: F.when(x < trim, 0.0).otherwise(x)))
        rows = rows.withColumn("q", F.transform("q", lambda x: x / F.aggregate("q", F.lit(0.0), lambda s, y: s + y)))
    if hard:
        u = hash_uniform(seed, F.col("ranking_id"))
        upto = lambda i: F.aggregate(F.slice("q", 1, i), F.lit(0.0), lambda s, y: s + y)
        rows = rows.withColumn("q", F.transform("q", lambda x, i: ((u >= upto(i)) & (u < upto(i) + x)).cast("double")))
    return rows.select("ranking_id", "weight", F.explode(F.arrays_zip(F.transform("model", lambda m: m["component"]).alias("component"), F.col("q").alias("q"))).alias("x")).select("ranking_id", "x.component", "x.q", "weight")


def mixture_weights(resp: DataFrame) -> DataFrame:
    """(component, alpha): mean responsibility, scaled to sum 1."""
    sums = resp.groupBy("component").agg(F.sum(F.col("q") * F.col("weight")).alias("s"))
    total = sums.agg(F.sum("s").alias("total"))
    return sums.join(F.broadcast(total)).select("component", (F.col("s") / F.col("total")).alias("alpha"))


def mixture_log_likelihood(rankings: DataFrame, params: DataFrame, mixture: DataFrame) -> DataFrame:
    """One row: ``ll``, the weighted mean over the rankings of ln of the mixture's likelihood."""
    rows = with_model(rankings.select("items", weight_of(rankings).alias("weight")), centre(params), mixture)
    logs = F.transform("model", lambda m: ranking_log_likelihood(F.col("items"), m["thetas"]) + m["log_alpha"])
    return rows.select(log_sum_exp(logs).alias("x"), "weight").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("ll"))


def pair_differences(params: DataFrame) -> DataFrame:
    """(component, item, opponent, diff): theta of item minus theta of opponent. A join of a model with itself."""
    other = params.select("component", F.col("item").alias("opponent"), F.col("theta").alias("other"))
    return params.join(other, "component").where("item <> opponent").select("component", "item", "opponent", (F.col("theta") - F.col("other")).alias("diff"))


def pairwise_log_likelihood(pairs: DataFrame, params: DataFrame, link: str = "logit") -> DataFrame:
    """(component, ll): sum over pairs of p ln F(theta of item - theta of opponent). Only the pairs given are joined with the
    model, once for each of their items."""
    own = params.select("component", "item", "theta")
    other = params.select("component", F.col("item").alias("opponent"), F.col("theta").alias("other"))
    rows = pairs.where("item <> opponent").select("item", "opponent", "p").join(own, "item").join(other, ["component", "opponent"])
    return rows.groupBy("component").agg(F.sum(F.col("p") * F.log(named_link(link).cdf(F.col("theta") - F.col("other")))).alias("ll"))


def expected_pair_vector(params: DataFrame, link: str = "logit") -> DataFrame:
    """(component, item, opponent, value) for item < opponent: half of F(d) less half of F(-d)."""
    cdf = named_link(link).cdf
    rows = pair_differences(params).where("item < opponent")
    return rows.select("component", "item", "opponent", (cdf(F.col("diff")) / 2 - cdf(-F.col("diff")) / 2).alias("value"))


def pairwise_responsibilities(rankings: DataFrame, params: DataFrame, mixture: DataFrame, link: str = "logit") -> DataFrame:
    """(ranking_id, component, q, weight): the posterior when a ranking counts as independent comparisons."""
    cdf = named_link(link).cdf
    rows = with_model(rankings.select("ranking_id", "items", weight_of(rankings).alias("weight")), params, mixture)

    def score(m: Column) -> Column:
        ahead = lambda x, i: F.aggregate(F.slice("items", i + 2, F.size("items")), F.lit(0.0), lambda s, y: s + F.log(cdf(m["thetas"][x] - m["thetas"][y])))
        return F.aggregate(F.transform("items", ahead), m["log_alpha"], lambda s, x: s + x)

    rows = rows.withColumn("logs", F.transform("model", score))
    rows = rows.withColumn("q", F.transform("logs", lambda x: F.exp(x - log_sum_exp(F.col("logs")))))
    return rows.select("ranking_id", "weight", F.explode(F.arrays_zip(F.transform("model", lambda m: m["component"]).alias("component"), F.col("q").alias("q"))).alias("x")).select("ranking_id", "x.component", "x.q", "weight")


def top_k_accuracy(a: Column, b: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k))) / k


def l2_error(params: DataFrame, truth: DataFrame) -> DataFrame:
    """(component, err): norm of the difference of centred thetas."""
    t = centre(truth).withColumnRenamed("theta", "true")
    return centre(params).join(t, ["component", "item"]).groupBy("component").agg(F.sqrt(F.sum(F.pow(F.col("theta") - F.col("true"), 2))).alias("err"))


def component_distances(params: DataFrame, truth: DataFrame) -> DataFrame:
    """(a, b, d2): squared distance of each component of params from each of truth."""
    t = centre(truth).select(F.col("component").alias("b"), "item", F.col("theta").alias("true"))
    return centre(params).join(t, "item").groupBy(F.col("component").alias("a"), "b").agg(F.sum(F.pow(F.col("theta") - F.col("true"), 2)).alias("d2"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of a table with at least as many columns, its column in the one-to-one matching of least cost, by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        least, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at = start, -1
        while row >= 0:
            if at >= 0:
                done[at] = True
            gap = cost[row] - u[row] - v
            better = ~done & (gap < least)
            least[better], before[better] = gap[better], at
            at = int(np.argmin(np.where(done, np.inf, least)))
            step = least[at]
            u[start] += step
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            row = owner[at]
        while at >= 0:
            owner[at] = owner[before[at]] if before[at] >= 0 else start
            at = before[at]
    out = np.empty(n, int)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def best_matching(table: DataFrame, a: str, b: str, value: str, largest: bool) -> DataFrame:
    """One row: ``best``, the best total of a one-to-one matching of a table of labels, which the driver holds."""
    cells = {(r[a], r[b]): float(r[value]) for r in table.select(a, b, value).collect()}
    left, right = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    if len(left) > len(right):
        left, right, cells = right, left, {(y, x): v for (x, y), v in cells.items()}
    values = np.array([[cells.get((x, y), 0.0) for y in right] for x in left]).reshape(len(left), len(right))
    if not np.isfinite(values).all():
        raise ValueError("matching is for finite values")
    best = sum(values[range(len(left)), assignment(-values if largest else values)])
    return table.sparkSession.range(1).select(F.lit(float(best)).alias("best"))


def mixture_l2_error(params: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ``err``, the norm of the difference under the best matching of components."""
    return best_matching(component_distances(params, truth), "a", "b", "d2", False).select(F.sqrt("best").alias("err"))


def confusion_counts(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return labels.groupBy(true, pred).agg(F.count("*").alias("n"))


def clustering_accuracy(labels: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """One row: ``accuracy`` under the best one-to-one matching of labels."""
    counts = confusion_counts(labels, true, pred)
    total = counts.agg(F.sum("n").alias("total"))
    return best_matching(counts, true, pred, "n", True).join(total).select((F.col("best") / F.col("total")).alias("accuracy"))


def component_separation(params: DataFrame) -> DataFrame:
    """One row: the smallest distance between two components."""
    other = params.select(F.col("component").alias("c2"), "item", F.col("theta").alias("other"))
    d = params.join(other, "item").where("component < c2").groupBy("component", "c2").agg(F.sqrt(F.sum(F.pow(F.col("theta") - F.col("other"), 2))).alias("d"))
    return d.agg(F.min("d").alias("separation"))


def timed_error(params: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: summed squared error over all (t, item)."""
    t = truth.select("t", "item", F.col("theta").alias("true"))
    return params.join(t, ["t", "item"]).agg(F.sum(F.pow(F.col("theta") - F.col("true"), 2)).alias("err"))


def check_split(parts: Sequence[DataFrame], whole: DataFrame) -> DataFrame:
    """Rows of a split that overlap or are missing: empty if the parts are disjoint and cover the whole."""
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    return together.exceptAll(whole).unionByName(whole.exceptAll(together))
