"""The same functions for ``spark.sql``: temporary SQL functions, which Spark inlines into the query's own JVM plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(arguments) -> (what it returns, its body). Rankings are arrays of items, best first.
SCALARS = {
    "embed_lehmer(items ARRAY<INT>)": ("ARRAY<INT>", "transform(items, (x, t) -> size(filter(slice(items, 1, t), y -> y > x)))"),
    "embed_positional(items ARRAY<INT>, n INT)": ("ARRAY<INT>", "CASE WHEN n > 0 THEN transform(sequence(0, n - 1), i -> CAST(greatest(array_position(items, i) - 1, 0) AS INT)) ELSE CAST(array() AS ARRAY<INT>) END"),
    "embed_topk(items ARRAY<INT>, n INT, k INT)": ("ARRAY<INT>", "CASE WHEN n > 0 THEN transform(sequence(0, n - 1), i -> CAST(array_contains(slice(items, 1, k), i) AS INT)) ELSE CAST(array() AS ARRAY<INT>) END"),
    "embed_disjoint_pairs(items ARRAY<INT>, n INT)": (
        "ARRAY<INT>",
        """CASE WHEN n > 1 THEN transform(transform(sequence(0, n DIV 2 - 1), p -> struct(array_position(items, CAST(2 * p AS INT)) AS a, array_position(items, CAST(2 * p + 1 AS INT)) AS b)),
        q -> CASE WHEN q.a = 0 AND q.b = 0 THEN 0 WHEN q.b = 0 OR (q.a > 0 AND q.a < q.b) THEN 1 ELSE -1 END) ELSE CAST(array() AS ARRAY<INT>) END""",
    ),
    "embed_pairwise_expected(items ARRAY<INT>, n INT)": (
        "ARRAY<DOUBLE>",
        """CASE WHEN n > 1 THEN flatten(transform(sequence(0, n - 2), i -> transform(transform(sequence(i + 1, n - 1), j -> struct(array_position(items, i) AS a, array_position(items, j) AS b)),
        q -> CASE WHEN q.a = 0 AND q.b = 0 THEN 0.5D WHEN q.a > 0 AND q.b > 0 THEN CASE WHEN q.a < q.b THEN 1D ELSE 0D END
        WHEN q.a > 0 THEN CAST(size(items) - q.a + 1 AS DOUBLE) / (size(items) + 1) ELSE 1D - CAST(size(items) - q.b + 1 AS DOUBLE) / (size(items) + 1) END))) ELSE CAST(array() AS ARRAY<DOUBLE>) END""",
    ),
    "pl_log_likelihood(items ARRAY<INT>, thetas MAP<INT, DOUBLE>)": (
        "DOUBLE",
        """aggregate(reverse(items), named_struct('sum', 0D, 'll', 0D), (acc, item) -> named_struct('sum', acc.sum + exp(thetas[item]),
        'll', acc.ll + CASE WHEN acc.sum > 0 THEN thetas[item] - ln(acc.sum + exp(thetas[item])) ELSE 0D END), acc -> acc.ll)""",
    ),
    "top_k_accuracy(a ARRAY<INT>, b ARRAY<INT>, k INT)": ("DOUBLE", "size(array_intersect(slice(a, 1, k), slice(b, 1, k))) / CAST(k AS DOUBLE)"),
}
#: The same for functions that return rows, to be used as ``FROM rankings r, LATERAL rank_break(r.items)``.
TABLES = {
    "rank_break(items ARRAY<INT>)": (
        "winner INT, loser INT, pos_i INT, pos_j INT",
        """SELECT p.winner, p.loser, p.pos_i, p.pos_j FROM explode(flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)),
        (y, j) -> struct(x AS winner, y AS loser, i AS pos_i, i + 1 + j AS pos_j))))) AS t(p)""",
    ),
    "ranked_items(items ARRAY<INT>)": ("pos INT, item INT", "SELECT pos, item FROM posexplode(items) AS t(pos, item)"),
    "pair_entries(items ARRAY<INT>, n INT)": (
        "idx BIGINT, value DOUBLE",
        """SELECT p.idx, p.value FROM explode(flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> struct(
        CAST(n * least(x, y) - least(x, y) * (least(x, y) + 1) DIV 2 + greatest(x, y) - least(x, y) - 1 AS BIGINT) AS idx, CASE WHEN x < y THEN 0.5D ELSE -0.5D END AS value))))) AS t(p)""",
    ),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Makes the functions of SCALARS and TABLES known to ``spark.sql`` in this session; those of the same names are
    replaced. Returns their names. A null ranking has no rows; scalar functions of it are null, or as for no items."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body}")
    return [head.partition("(")[0] for head in (*SCALARS, *TABLES)]
