"""Rankings as vectors, as Column expressions on ``items`` (best first, items 0 to n - 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_lehmer(items: Column) -> Column:
    """Entry t: how many of the items ranked before t have a larger id."""
    return F.transform(items, lambda x, t: F.size(F.filter(F.slice(items, 1, t), lambda y: y > x)))


def universe(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")


def embed_positional(items: Column, n: int) -> Column:
    """Positions by item, from 0; 0 too for items that are not ranked."""
    return F.transform(universe(n), lambda i: F.greatest(F.array_position(items, i) - 1, F.lit(0)).cast("int"))


def embed_topk(items: Column, n: int, k: int) -> Column:
    return F.transform(universe(n), lambda i: F.array_contains(F.slice(items, 1, k), i).cast("int"))


def ahead(items: Column, a: Column, b: Column) -> Column:
    """1 if a comes before b, -1 if after, 0 if neither is ranked; a ranked item comes before one that is not."""
    pa, pb = F.array_position(items, a), F.array_position(items, b)
    return F.when((pa == 0) & (pb == 0), 0).when((pb == 0) | ((pa > 0) & (pa < pb)), 1).otherwise(-1)


def embed_disjoint_pairs(items: Column, n: int) -> Column:
    if n < 2:
        return F.array().cast("array<int>")
    return F.transform(F.sequence(F.lit(0), F.lit(n // 2 - 1)), lambda p: ahead(items, (2 * p).cast("int"), (2 * p + 1).cast("int")))


def pair_index(i: Column, j: Column, n: int) -> Column:
    """The place of the pair i < j in a vector of all pairs."""
    return (n * i - i * (i + 1) / 2 + (j - i - 1)).cast("long")


def embed_pairwise(comparisons: DataFrame, n: int, encoding: str = "signed") -> DataFrame:
    """Sparse pair vectors (ranking_id, idx, value) from (ranking_id, winner, loser). ``01``: 1 if the smaller item is
    ahead; ``signed``: one half or minus one half; ``full``: both orders of the pair in n x n entries, 1 and -1."""
    lo, hi = F.least("winner", "loser"), F.greatest("winner", "loser")
    first = F.col("winner") < F.col("loser")
    if encoding == "full":
        both = F.explode(F.array(F.struct((F.col("winner") * n + F.col("loser")).cast("long").alias("idx"), F.lit(1.0).alias("value")), F.struct((F.col("loser") * n + F.col("winner")).cast("long").alias("idx"), F.lit(-1.0).alias("value"))))
        return comparisons.select("ranking_id", both.alias("x")).select("ranking_id", "x.idx", "x.value")
    value = F.when(first, 1.0).otherwise(0.0) if encoding == "01" else F.when(first, 0.5).otherwise(-0.5)
    rows = comparisons.select("ranking_id", pair_index(lo, hi, n).alias("idx"), value.alias("value"))
    return rows.where("value <> 0") if encoding == "01" else rows


def embed_pairwise_expected(items: Column, n: int) -> Column:
    """Chance, over all full rankings that agree with a partial one, that the smaller item of each pair is ahead.

    Of s ranked items, one at place r is ahead of an unranked item in (s - r) of the s + 1 gaps where that can go.
    """
    s = F.size(items)

    def chance(i: Column, j: Column) -> Column:
        pi, pj = F.array_position(items, i), F.array_position(items, j)
        gap = lambda p: (s - p + 1).cast("double") / (s + 1)  # noqa: E731  p from 1
        return (
            F.when((pi == 0) & (pj == 0), 0.5)
            .when((pi > 0) & (pj > 0), F.when(pi < pj, 1.0).otherwise(0.0))
            .when(pi > 0, gap(pi))
            .otherwise(1 - gap(pj))
        )

    if n < 2:
        return F.array().cast("array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: F.transform(F.sequence(i + 1, F.lit(n - 1)), lambda j: chance(i.cast("int"), j.cast("int"))))
    return F.flatten(rows)
