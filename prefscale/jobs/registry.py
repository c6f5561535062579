"""Queries over the given tables, one or more per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefscale.functions import embeddings as emb
from prefscale.functions.links import gennorm, gumbel_ev, laplace, logit, probit
from prefscale.functions.sql import register_sql
from prefscale.jobs import fixtures as fx
from prefscale.jobs import grid
from prefscale.operators import breaking, clustering, consensus, dynamic, estimators, evaluate, graph, mixture, prepare, sampling
from prefscale.session import written
from prefscale.streaming import timed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6
HASH = "('0x' || substr(md5({}), 1, 13))::BIGINT"
UNIFORM = "((('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, since sums of doubles differ in their last digits; whole numbers as long."""
    kinds = {f.name: f.dataType for f in df.schema}
    cols = [F.round(c, DIGITS).alias(c) if isinstance(t, T.DoubleType) else F.col(c).cast("long").alias(c) if isinstance(t, (T.IntegerType, T.ShortType)) else F.col(c) for c, t in kinds.items()]
    return df.select(*cols)


def text(column: str = "items"):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


def items_sql(where: str = "", order: str = "pos") -> str:
    return f"SELECT ranking_id, string_agg(item::VARCHAR, ',' ORDER BY {order}) AS items FROM r {where} GROUP BY ranking_id"


# --- comparisons and pair statistics


@query("rank_break_random", f"WITH {fx.R_BRAND}, h AS (SELECT *, row_number() OVER (PARTITION BY ranking_id ORDER BY md5('7|' || ranking_id::VARCHAR || '|' || pos::VARCHAR)) - 1 AS h FROM r), m AS (SELECT a.ranking_id, a.item AS i, a.pos AS p, z.item AS j, z.pos AS q FROM h a JOIN h z ON a.ranking_id = z.ranking_id AND a.h % 2 = 0 AND z.h = a.h + 1) SELECT ranking_id, (CASE WHEN p < q THEN i ELSE j END)::BIGINT AS winner, (CASE WHEN p < q THEN j ELSE i END)::BIGINT AS loser FROM m")
def rank_break_random(s, d):
    return rounded(breaking.rank_break(fx.brand_rankings(s, d), "random", 7).select("ranking_id", "winner", "loser"))


WEIGHTED = f"WITH {fx.R_NATION}, {fx.PAIRS} SELECT winner::BIGINT AS winner, loser::BIGINT AS loser, round(sum(1.0 / (1 + pos_i + pos_j)), 6) AS wins FROM k GROUP BY 1, 2"


def rank_break_weighted(s, d):
    at = lambda c: s.range(fx.N_NATIONS).select(F.col("id").cast("int").alias(c))
    kappa = at("pos_i").join(at("pos_j")).withColumn("kappa", 1 / (1.0 + F.col("pos_i") + F.col("pos_j")))
    return rounded(breaking.count_comparisons(breaking.rank_break_weighted(fx.nation_rankings(s, d), kappa)))


query("rank_break_weighted", WEIGHTED)(rank_break_weighted)


@query("pair_counts_brand", f"WITH {fx.R_BRAND}, {fx.COUNTS} SELECT winner::BIGINT AS winner, loser::BIGINT AS loser, wins FROM w")
def pair_counts_brand(s, d):
    return rounded(breaking.pair_counts(fx.brand_rankings(s, d)))


def probs_sql(add: str) -> str:
    return f"WITH {fx.R_BRAND}, {fx.PROBS}, x AS (SELECT v.item, v.opponent, v.a, o.a AS o FROM v JOIN v o ON v.item = o.opponent AND v.opponent = o.item) SELECT item::BIGINT AS item, opponent::BIGINT AS opponent, a + {add} AS wins, a + o + 2 * {add} AS total, round((a + {add}) / (a + o + 2 * {add}), 6) AS p FROM x"


def pair_probs(smoothing: str, nu: float = 1.0) -> Query:
    return lambda s, d: rounded(breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d)), smoothing, nu))


query("pair_probs_none", probs_sql("0.0::DOUBLE"))(pair_probs("none"))
query("pair_probs_all", probs_sql("2.0::DOUBLE"))(pair_probs("all", 2.0))
query("pair_probs_degenerate", probs_sql("(CASE WHEN a = 0 OR o = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"))(pair_probs("degenerate"))


@query("pair_moments", f"WITH {fx.R_NATION}, {fx.COUNTS} SELECT winner::BIGINT AS winner, loser::BIGINT AS loser, round(wins / (SELECT count(DISTINCT ranking_id) FROM r), 6) AS moment FROM w")
def pair_moments(s, d):
    return rounded(breaking.pair_moments(fx.nation_rankings(s, d)))


@query("clip_and_drop_pairs", probs_sql("0.0::DOUBLE").replace("round((a + 0.0::DOUBLE) / (a + o + 2 * 0.0::DOUBLE), 6) AS p FROM x", "round(greatest(least(a / (a + o), 0.55), 0.45), 6) AS p FROM x WHERE a / (a + o) BETWEEN 0.4 AND 0.6"))
def clip_and_drop(s, d):
    pairs = breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d)))
    return rounded(breaking.clip_probs(breaking.drop_extreme_pairs(pairs, 0.4, 0.6), 0.45))


# --- orders and choice statistics


@query("borda", f"WITH {fx.R_BRAND} SELECT item::BIGINT AS item, sum(n - pos - 1)::DOUBLE AS score, row_number() OVER (ORDER BY sum(n - pos - 1) DESC, item) AS rank FROM r GROUP BY item")
def borda(s, d):
    return rounded(consensus.order_items(consensus.borda(fx.brand_rankings(s, d))))


@query("preference_order_brand", f"WITH {fx.R_BRAND}, {fx.PROBS}, x AS (SELECT v.item, v.a, o.a AS o FROM v JOIN v o ON v.item = o.opponent AND v.opponent = o.item), c AS (SELECT item, sum(CASE WHEN a > o THEN 1.0 WHEN a = o THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM x GROUP BY item) SELECT item::BIGINT AS item, score, row_number() OVER (ORDER BY score DESC, item) AS rank, (SELECT count(DISTINCT score) = count(*) FROM c) AS is_transitive FROM c")
def preference_order_brand(s, d):
    return rounded(consensus.preference_order(breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d)))))


@query("win_counts", f"WITH {fx.R_BRAND} SELECT item::BIGINT AS item, count(*)::DOUBLE AS wins FROM r WHERE pos < n - 1 GROUP BY item")
def win_counts(s, d):
    return rounded(consensus.win_counts(fx.brand_rankings(s, d)))


@query("choice_denominators", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.LL}, t AS (SELECT *, sum(CASE WHEN pos <= n - 2 THEN 1 / suffix ELSE 0 END) OVER (PARTITION BY ranking_id, component ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM s) SELECT component::BIGINT AS component, item::BIGINT AS item, round(sum(prefix), 6) AS denom FROM t GROUP BY 1, 2")
def choice_denominators(s, d):
    return rounded(consensus.choice_denominators(fx.brand_rankings(s, d), fx.fixed_params(s)))


@query("suffix_prefix_sums", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.LL}, t AS (SELECT *, sum(CASE WHEN pos <= n - 2 THEN 1 / suffix ELSE 0 END) OVER (PARTITION BY ranking_id, component ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM s) SELECT ranking_id, component::BIGINT AS component, pos::BIGINT AS pos, round(suffix, 6) AS suffix, round(prefix, 6) AS prefix FROM t")
def suffix_prefix_sums(s, d):
    entries = consensus.suffix_weight_sums(consensus.placed(fx.brand_rankings(s, d), fx.fixed_params(s)))
    return rounded(consensus.prefix_reciprocal_sums(entries).select("ranking_id", "component", "pos", "suffix", "prefix"))


@query("luce_flows", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.LL} SELECT a.component::BIGINT AS component, z.item::BIGINT AS loser, a.item::BIGINT AS winner, round(sum(1 / a.suffix), 6) AS rate FROM s a JOIN s z ON a.ranking_id = z.ranking_id AND a.component = z.component AND a.pos < z.pos GROUP BY 1, 2, 3")
def luce_flows(s, d):
    return rounded(consensus.luce_flows(fx.brand_rankings(s, d), fx.fixed_params(s)))


# --- likelihoods and posteriors


@query("pl_log_likelihood", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.LL} SELECT ranking_id, component::BIGINT AS component, round(ll, 6) AS ll FROM ll")
def pl_log_likelihood(s, d):
    return rounded(evaluate.pl_log_likelihood(fx.brand_rankings(s, d), fx.fixed_params(s)).drop("weight"))


@query("responsibilities", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.MIXTURE}, {fx.RESP} SELECT ranking_id, component::BIGINT AS component, round(q, 6) AS q FROM q")
def responsibilities(s, d):
    return rounded(evaluate.responsibilities(fx.brand_rankings(s, d), fx.fixed_params(s), fx.fixed_mixture(s)).drop("weight"))


@query("responsibilities_trimmed", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.MIXTURE}, {fx.RESP}, t AS (SELECT ranking_id, component, CASE WHEN q < 0.1 THEN 0 ELSE q END AS q FROM q) SELECT ranking_id, component::BIGINT AS component, round(q / sum(q) OVER (PARTITION BY ranking_id), 6) AS q FROM t")
def responsibilities_trimmed(s, d):
    return rounded(evaluate.responsibilities(fx.brand_rankings(s, d), fx.fixed_params(s), fx.fixed_mixture(s), trim=0.1).drop("weight"))


@query("responsibilities_hard", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.MIXTURE}, {fx.RESP}, t AS (SELECT *, sum(q) OVER (PARTITION BY ranking_id ORDER BY component) AS upto FROM q) SELECT ranking_id, component::BIGINT AS component, ({UNIFORM.format("'5|' || ranking_id::VARCHAR")} >= upto - q AND {UNIFORM.format("'5|' || ranking_id::VARCHAR")} < upto)::INTEGER::DOUBLE AS q FROM t")
def responsibilities_hard(s, d):
    return rounded(evaluate.responsibilities(fx.brand_rankings(s, d), fx.fixed_params(s), fx.fixed_mixture(s), hard=True, seed=5).drop("weight"))


PAIR_LL = "pl AS (SELECT ranking_id, p.component, sum(-ln(1 + exp(-(p.theta - o.theta)))) AS ll FROM k JOIN params p ON p.item = winner JOIN params o ON o.item = loser AND o.component = p.component GROUP BY 1, 2)"


@query("pairwise_responsibilities", f"WITH {fx.R_NATION}, {fx.PARAMS}, {fx.MIXTURE}, {fx.PAIRS}, {PAIR_LL}, i AS (SELECT DISTINCT ranking_id, component FROM r, mixture), j AS (SELECT ranking_id, component, coalesce(ll, 0) + ln(alpha) AS x FROM i JOIN mixture USING (component) LEFT JOIN pl USING (ranking_id, component)), m AS (SELECT *, max(x) OVER (PARTITION BY ranking_id) AS top FROM j) SELECT ranking_id, component::BIGINT AS component, round(exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY ranking_id), 6) AS q FROM m")
def pairwise_responsibilities(s, d):
    return rounded(evaluate.pairwise_responsibilities(fx.nation_rankings(s, d), fx.fixed_params(s), fx.fixed_mixture(s)).drop("weight"))


@query("mixture_weights", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.MIXTURE}, {fx.RESP} SELECT component::BIGINT AS component, round(sum(q) / (SELECT sum(q) FROM q), 6) AS alpha FROM q GROUP BY 1")
def mixture_weights(s, d):
    return rounded(evaluate.mixture_weights(evaluate.responsibilities(fx.brand_rankings(s, d), fx.fixed_params(s), fx.fixed_mixture(s))))


CENTRED = "params AS (SELECT component, item, theta - avg(theta) OVER (PARTITION BY component) AS theta FROM raw)"


@query("mixture_log_likelihood", f"WITH {fx.R_BRAND}, {fx.PARAMS.replace('params AS', 'raw AS', 1)}, {CENTRED}, {fx.MIXTURE}, {fx.LL}, j AS (SELECT ranking_id, ll + ln(alpha) AS x FROM ll JOIN mixture USING (component)), t AS (SELECT ranking_id, max(x) AS top FROM j GROUP BY 1), l AS (SELECT ranking_id, max(top) + ln(sum(exp(x - top))) AS l FROM j JOIN t USING (ranking_id) GROUP BY 1) SELECT round(avg(l), 6) AS ll FROM l")
def mixture_log_likelihood(s, d):
    return rounded(evaluate.mixture_log_likelihood(fx.brand_rankings(s, d), fx.fixed_params(s), fx.fixed_mixture(s)))


@query("pairwise_log_likelihood", f"WITH {fx.R_BRAND}, {fx.PARAMS}, {fx.PROBS}, x AS (SELECT v.item, v.opponent, v.a / (v.a + o.a) AS p FROM v JOIN v o ON v.item = o.opponent AND v.opponent = o.item) SELECT p.component::BIGINT AS component, round(sum(x.p * -ln(1 + exp(o.theta - p.theta))), 6) AS ll FROM x JOIN params p ON p.item = x.item JOIN params o ON o.item = x.opponent AND o.component = p.component GROUP BY 1")
def pairwise_log_likelihood(s, d):
    return rounded(evaluate.pairwise_log_likelihood(breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d))), fx.fixed_params(s)))


# --- ratings, menus, splits


@query("item_rating_stats", f"WITH {fx.RATINGS} SELECT item_id, count(rating) AS n, round(sum(rating), 6) AS total, round(avg(rating), 6) AS avg FROM ratings GROUP BY 1 HAVING count(rating) > 20")
def item_rating_stats(s, d):
    return rounded(prepare.filter_items_by_support(prepare.item_rating_stats(fx.ratings(s, d)), 20))


ACTIVE = f"{fx.RATINGS}, active AS (SELECT * FROM ratings WHERE user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) > 35) AND item_id IN (SELECT item_id FROM ratings GROUP BY 1 HAVING count(*) > 28))"


@query("filter_active", f"WITH {ACTIVE} SELECT user_id, item_id, round(rating, 6) AS rating FROM active")
def filter_active(s, d):
    return rounded(prepare.filter_active(fx.ratings(s, d), 35, 28))


@query("index_ratings", f'WITH {ACTIVE}, u AS (SELECT user_id, count(*) AS n FROM active GROUP BY 1 ORDER BY n DESC, user_id LIMIT 200), i AS (SELECT item_id, count(*) AS n FROM active GROUP BY 1 ORDER BY n DESC, item_id LIMIT 100), x AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS "user" FROM u), y AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) - 1 AS item FROM i) SELECT "user", item, round(rating, 6) AS rating FROM active JOIN x USING (user_id) JOIN y USING (item_id)')
def index_ratings(s, d):
    return rounded(prepare.index_ratings(prepare.filter_active(fx.ratings(s, d), 35, 28), 200, 100))


@query("dedupe_ratings", "WITH x AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS rating, l_orderkey * 1000 + l_linenumber * 100 + l_quantity AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT user_id, item_id, arg_max(rating, o) AS rating FROM x GROUP BY 1, 2")
def dedupe_ratings(s, d):
    x = fx.table(s, d, "lineitem").join(fx.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("rating"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("o"))
    return rounded(prepare.dedupe_ratings(x, "o"))


@query("rankings_from_scores", f"WITH {fx.R_NATION} {items_sql()}")
def rankings_from_scores(s, d):
    return fx.nation_rankings(s, d).select("ranking_id", text())


@query("compact_rankings", f"WITH {fx.R_BRAND}, t AS ({items_sql()}) SELECT items, count(*)::DOUBLE AS weight FROM t GROUP BY 1")
def compact_rankings(s, d):
    return rounded(prepare.compact_rankings(fx.brand_rankings(s, d)).select(text(), "weight"))


@query("project_to_menu", f"WITH {fx.R_NATION}, t AS (SELECT ranking_id, pos, list_position([2, 3, 5, 7, 11], item) - 1 AS item FROM r WHERE item IN (2, 3, 5, 7, 11)), g AS (SELECT ranking_id, string_agg(item::VARCHAR, ',' ORDER BY pos) AS items FROM t GROUP BY 1) SELECT i.ranking_id, coalesce(items, '') AS items FROM (SELECT DISTINCT ranking_id FROM r) i LEFT JOIN g USING (ranking_id)")
def project_to_menu(s, d):
    return prepare.project_to_menu(fx.nation_rankings(s, d), [2, 3, 5, 7, 11], reindex=True).select("ranking_id", text())


@query("thin_rankings", f"WITH {fx.R_NATION}, t AS (SELECT * FROM r WHERE {UNIFORM.format("'3|' || ranking_id::VARCHAR || '|' || pos::VARCHAR")} < 0.4) SELECT ranking_id, string_agg(item::VARCHAR, ',' ORDER BY pos) AS items FROM t GROUP BY 1 HAVING count(*) > 1")
def thin_rankings(s, d):
    return prepare.thin_rankings(fx.nation_rankings(s, d), 0.4, 3).select("ranking_id", text())


@query("item_position_stats", f"WITH {fx.R_BRAND} SELECT item::BIGINT AS item, count(*) AS n, round(avg(pos), 6) AS mean_pos, round(var_pop(pos), 6) AS var_pos FROM r GROUP BY 1")
def item_position_stats(s, d):
    return rounded(prepare.item_position_stats(fx.brand_rankings(s, d)))


@query("select_high_variance_items", f"WITH {fx.R_NATION} SELECT item::BIGINT AS item, count(*) AS n, round(avg(pos), 6) AS mean_pos, round(var_pop(pos), 6) AS var_pos FROM r GROUP BY 1 ORDER BY var_pop(pos) DESC, item LIMIT 10")
def select_high_variance_items(s, d):
    return rounded(prepare.select_high_variance_items(fx.nation_rankings(s, d), 10))


@query("top_k_prefix", f"WITH {fx.R_BRAND} {items_sql('WHERE pos < 3')}")
def top_k_prefix(s, d):
    return prepare.top_k_prefix(fx.brand_rankings(s, d), 3).select("ranking_id", text())


@query("unranked_items", f"WITH {fx.R_NATION}, m AS (SELECT ranking_id, i AS item FROM (SELECT DISTINCT ranking_id FROM r), range(25) x(i) EXCEPT SELECT ranking_id, item FROM r), g AS (SELECT ranking_id, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM m GROUP BY 1) SELECT ranking_id, coalesce(items, '') AS items FROM (SELECT DISTINCT ranking_id FROM r) LEFT JOIN g USING (ranking_id)")
def unranked_items(s, d):
    return prepare.unranked_items(fx.nation_rankings(s, d), fx.N_NATIONS).select("ranking_id", text())


@query("distinct_menus", f"WITH {fx.R_BRAND}, t AS ({items_sql(order='item')}) SELECT DISTINCT items FROM t")
def distinct_menus(s, d):
    return prepare.distinct_menus(fx.brand_rankings(s, d)).select(text())


@query("split_rankings_exact", f"WITH {fx.R_BRAND}, i AS (SELECT DISTINCT ranking_id FROM r), n AS (SELECT ranking_id, row_number() OVER (ORDER BY md5('119|' || ranking_id::VARCHAR), ranking_id) AS place, count(*) OVER () AS m FROM i), c AS (SELECT *, floor(m * 0.8) AS tr, floor(floor(m * 0.8) * 0.2) AS va FROM n) SELECT ranking_id, CASE WHEN place <= tr - va THEN 'train' WHEN place <= tr THEN 'val' ELSE 'test' END AS part FROM c")
def split_exact(s, d):
    return prepare.split_rankings(fx.brand_rankings(s, d)).select("ranking_id", "part")


@query("split_rankings_hash", f"WITH {fx.R_BRAND}, i AS (SELECT DISTINCT ranking_id, {UNIFORM.format("'119|' || ranking_id::VARCHAR")} AS u FROM r) SELECT ranking_id, CASE WHEN u < 0.8 * (1 - 0.2) THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS part FROM i")
def split_hash(s, d):
    return prepare.split_rankings(fx.brand_rankings(s, d), mode="hash").select("ranking_id", "part")


@query("learning_curve_prefixes", f"WITH {fx.R_BRAND}, i AS (SELECT DISTINCT ranking_id, {UNIFORM.format("'119|' || ranking_id::VARCHAR")} AS u FROM r) SELECT ratio::DOUBLE AS ratio, count(*) AS n FROM i, (VALUES (0.1), (0.3), (1.0)) v(ratio) WHERE u < ratio GROUP BY 1")
def learning_curve(s, d):
    return prepare.learning_curve_prefixes(fx.brand_rankings(s, d), [0.1, 0.3, 1.0]).groupBy("ratio").agg(F.count("*").alias("n"))


@query("learning_curve_prefixes_exact", f"WITH {fx.R_BRAND}, i AS (SELECT DISTINCT ranking_id FROM r), n AS (SELECT ranking_id, row_number() OVER (ORDER BY md5('119|' || ranking_id::VARCHAR), ranking_id) - 1 AS rank, count(*) OVER () AS m FROM i), c AS (SELECT *, floor(m * 0.8) - floor(floor(m * 0.8) * 0.2) AS tr FROM n) SELECT ratio::DOUBLE AS ratio, ranking_id FROM c, (VALUES (0.1), (0.3), (1.0)) v(ratio) WHERE rank < tr AND rank < floor(tr * ratio)")
def learning_curve_exact(s, d):
    train = prepare.split_rankings(fx.brand_rankings(s, d)).where("part = 'train'")
    return prepare.learning_curve_prefixes(train, [0.1, 0.3, 1.0], mode="exact").select("ratio", "ranking_id")


BALLOTS = f"{fx.R_EVENTS}, o AS (SELECT ranking_id, list(item ORDER BY pos) AS items FROM r GROUP BY 1), g AS (SELECT items, count(*) AS votes FROM o WHERE len(items) > 2 GROUP BY 1)"


@query("parse_ballots", f"WITH {BALLOTS} SELECT votes, array_to_string(items[1:2], ',') AS items, array_to_string(items[3:], ',') AS tied_tail FROM g")
def parse_ballots(s, d):
    return prepare.parse_ballots(fx.ballot_lines(s, d)).select("votes", text("items"), text("tied_tail"))


@query("rankings_from_ballots", f"WITH {BALLOTS}, bb AS (SELECT votes, items, array_to_string(items, '') AS ballot_id FROM g), v AS (SELECT *, unnest(range(1, votes + 1)) AS vote FROM bb), e AS (SELECT ballot_id || ':' || vote::VARCHAR AS ranking_id, items, unnest(items[3:]) AS x FROM v), t AS (SELECT ranking_id, any_value(items) AS items, string_agg(x::VARCHAR, ',' ORDER BY md5('4|' || ranking_id || '|' || x::VARCHAR)) AS tail FROM e GROUP BY 1) SELECT ranking_id, array_to_string(items[1:2], ',') || ',' || tail AS items FROM t")
def rankings_from_ballots(s, d):
    parsed = prepare.parse_ballots(fx.ballot_lines(s, d))
    keyed = parsed.withColumn("ballot_id", F.array_join(F.concat("items", "tied_tail").cast("array<string>"), ""))
    return prepare.rankings_from_ballots(keyed, 4).select("ranking_id", text())


@query("top_k_accuracy", f"WITH {fx.R_NATION}, t AS (SELECT ranking_id, count(*) FILTER (pos < 5 AND item < 5) / 5.0::DOUBLE AS acc FROM r GROUP BY 1) SELECT ranking_id, acc FROM t")
def top_k_accuracy(s, d):
    return fx.nation_rankings(s, d).select("ranking_id", evaluate.top_k_accuracy(F.col("items"), emb.universe(5), 5).alias("acc"))


# --- embeddings


@query("embed_lehmer", f"WITH {fx.R_NATION}, c AS (SELECT a.ranking_id, a.pos, count(z.item) AS v FROM r a LEFT JOIN r z ON a.ranking_id = z.ranking_id AND z.pos < a.pos AND z.item > a.item GROUP BY 1, 2) SELECT ranking_id, string_agg(v::VARCHAR, ',' ORDER BY pos) AS items FROM c GROUP BY 1")
def embed_lehmer(s, d):
    return fx.nation_rankings(s, d).select("ranking_id", emb.embed_lehmer(F.col("items")).alias("items")).select("ranking_id", text())


GRID = "g AS (SELECT ranking_id, i::INTEGER AS i FROM (SELECT DISTINCT ranking_id FROM r), range(25) x(i)), p AS (SELECT g.ranking_id, g.i, r.pos FROM g LEFT JOIN r ON g.ranking_id = r.ranking_id AND g.i = r.item)"


@query("embed_positional", f"WITH {fx.R_NATION}, {GRID} SELECT ranking_id, string_agg(coalesce(pos, 0)::VARCHAR, ',' ORDER BY i) AS items FROM p GROUP BY 1")
def embed_positional(s, d):
    return fx.nation_rankings(s, d).select("ranking_id", emb.embed_positional(F.col("items"), 25).alias("items")).select("ranking_id", text())


@query("embed_topk", f"WITH {fx.R_NATION}, {GRID} SELECT ranking_id, string_agg(coalesce(pos < 4, FALSE)::INTEGER::VARCHAR, ',' ORDER BY i) AS items FROM p GROUP BY 1")
def embed_topk(s, d):
    return fx.nation_rankings(s, d).select("ranking_id", emb.embed_topk(F.col("items"), 25, 4).alias("items")).select("ranking_id", text())


@query("embed_disjoint_pairs", f"WITH {fx.R_NATION}, {GRID}, t AS (SELECT a.ranking_id, a.i, CASE WHEN a.pos IS NULL AND z.pos IS NULL THEN 0 WHEN z.pos IS NULL OR a.pos < z.pos THEN 1 ELSE -1 END AS v FROM p a JOIN p z ON a.ranking_id = z.ranking_id AND a.i % 2 = 0 AND z.i = a.i + 1) SELECT ranking_id, string_agg(v::VARCHAR, ',' ORDER BY i) AS items FROM t GROUP BY 1")
def embed_disjoint(s, d):
    return fx.nation_rankings(s, d).select("ranking_id", emb.embed_disjoint_pairs(F.col("items"), 25).alias("items")).select("ranking_id", text())


@query("embed_pairwise_signed", f"WITH {fx.R_BRAND}, {fx.PAIRS} SELECT ranking_id, (25 * least(winner, loser) - least(winner, loser) * (least(winner, loser) + 1) // 2 + greatest(winner, loser) - least(winner, loser) - 1)::BIGINT AS idx, CASE WHEN winner < loser THEN 0.5 ELSE -0.5 END::DOUBLE AS value FROM k")
def embed_pairwise(s, d):
    return emb.embed_pairwise(breaking.rank_break(fx.brand_rankings(s, d)), 25)


EXPECTED = "y AS (SELECT ranking_id, i::INTEGER AS i FROM (SELECT DISTINCT ranking_id FROM r), range(5) x(i)), p AS (SELECT y.ranking_id, y.i, r.pos, s.n FROM y LEFT JOIN r ON y.ranking_id = r.ranking_id AND y.i = r.item JOIN (SELECT DISTINCT ranking_id, n FROM r) s ON s.ranking_id = y.ranking_id)"


@query("embed_pairwise_expected", f"WITH {fx.R_DAYS}, {EXPECTED} SELECT a.i::BIGINT AS i, z.i::BIGINT AS j, round(avg(CASE WHEN a.pos IS NULL AND z.pos IS NULL THEN 0.5 WHEN a.pos IS NOT NULL AND z.pos IS NOT NULL THEN (a.pos < z.pos)::INTEGER WHEN a.pos IS NOT NULL THEN (a.n - a.pos) / (a.n + 1.0) ELSE 1 - (z.n - z.pos) / (z.n + 1.0) END), 6) AS v FROM p a JOIN p z ON a.ranking_id = z.ranking_id AND a.i < z.i GROUP BY 1, 2")
def embed_expected(s, d):
    rows = fx.daily_event_rankings(s, d).select(F.posexplode(emb.embed_pairwise_expected(F.col("items"), 5)).alias("k", "v"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(5) for j in range(i + 1, 5)])
    return rounded(rows.groupBy("k").agg(F.avg("v").alias("v")).withColumn("p", F.get(names, F.col("k"))).select("p.i", "p.j", "v"))


# --- errors, links, models


OWN = "raw AS (SELECT (ranking_id % 2)::INTEGER AS component, item, ln(count(*) + 1.0) AS theta FROM r GROUP BY 1, 2)"
OWN_CENTRED = f"{OWN}, {CENTRED}"


def own_params(s, d):
    """Two models from the data: ln of how often a brand occurs in even and in odd orders."""
    rows = fx.brand_rankings(s, d).select((F.col("ranking_id") % 2).cast("int").alias("component"), F.explode("items").alias("item"))
    return rows.groupBy("component", "item").agg(F.log(F.count("*") + 1.0).alias("theta"))


@query("mixture_l2_error", f"WITH {fx.R_BRAND}, {OWN_CENTRED}, t AS (SELECT a.component AS a, z.component AS b, sum((a.theta - z.theta) ** 2) AS d2 FROM params a JOIN params z ON a.item = z.item GROUP BY 1, 2) SELECT round(sqrt(least(sum(d2) FILTER (a = b), sum(d2) FILTER (a <> b))), 6) AS err FROM t")
def mixture_l2_error(s, d):
    p = own_params(s, d)
    return rounded(evaluate.mixture_l2_error(p, p.withColumn("component", (1 - F.col("component")).cast("int"))))


@query("l2_error", f"WITH {fx.R_BRAND}, {OWN_CENTRED} SELECT a.component::BIGINT AS component, round(sqrt(sum((a.theta - z.theta) ** 2)), 6) AS err FROM params a JOIN params z ON a.item = z.item AND a.component <> z.component GROUP BY 1")
def l2_error(s, d):
    p = own_params(s, d)
    return rounded(evaluate.l2_error(p, p.withColumn("component", (1 - F.col("component")).cast("int"))))


@query("component_separation", f"WITH {fx.R_BRAND}, {OWN} SELECT round(sqrt(sum((a.theta - z.theta) ** 2)), 6) AS separation FROM raw a JOIN raw z ON a.item = z.item AND a.component = 0 AND z.component = 1")
def component_separation(s, d):
    return rounded(evaluate.component_separation(own_params(s, d)))


@query("softmax", f"WITH {fx.R_BRAND}, {OWN} SELECT component::BIGINT AS component, item::BIGINT AS item, round(theta, 6) AS theta, round(exp(theta) / sum(exp(theta)) OVER (PARTITION BY component), 6) AS share FROM raw")
def softmax(s, d):
    return rounded(evaluate.softmax(own_params(s, d)))


@query("expected_pair_vector", f"WITH {fx.R_BRAND}, {OWN} SELECT a.component::BIGINT AS component, a.item::BIGINT AS item, z.item::BIGINT AS opponent, round(0.5 / (1 + exp(z.theta - a.theta)) - 0.5 / (1 + exp(a.theta - z.theta)), 6) AS value FROM raw a JOIN raw z ON a.component = z.component AND a.item < z.item")
def expected_pair_vector(s, d):
    return rounded(evaluate.expected_pair_vector(own_params(s, d)))


@query("timed_error", f"WITH {fx.R_DAYS}, x AS (SELECT dayofweek(day) + 1 AS t, item, ln(count(*) + 1.0) AS theta FROM r GROUP BY 1, 2), y AS (SELECT item, ln(count(*) / 7.0 + 1.0) AS theta FROM r GROUP BY 1) SELECT round(sum((x.theta - y.theta) ** 2), 6) AS err FROM x JOIN y USING (item)")
def timed_error(s, d):
    rows = fx.daily_event_rankings(s, d).select(F.dayofweek("day").alias("t"), F.explode("items").alias("item"))
    by_day = rows.groupBy("t", "item").agg(F.log(F.count("*") + 1.0).alias("theta"))
    whole = rows.groupBy("item").agg(F.log(F.count("*") / 7.0 + 1.0).alias("theta"))
    return rounded(evaluate.timed_error(by_day, by_day.select("t").distinct().join(whole)))


@query("drop_empty_users", f"WITH {ACTIVE} SELECT c_custkey AS user_id FROM customer WHERE c_custkey IN (SELECT user_id FROM active)")
def drop_empty_users(s, d):
    users = fx.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return prepare.drop_empty_users(users, prepare.filter_active(fx.ratings(s, d), 35, 28))


@query("dense_index", f"WITH {fx.RATINGS}, n AS (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1 ORDER BY n DESC, item_id LIMIT 50) SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) - 1 AS idx FROM n")
def dense_index(s, d):
    return rounded(prepare.dense_index(prepare.top_n_by_count(fx.ratings(s, d), 10, 50)[1], "item_id"))


LABELS = "l AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS t, o_orderkey % 3 AS p FROM orders), c AS (SELECT t, p, count(*) AS n FROM l GROUP BY 1, 2)"


def labels(s, d):
    state = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return fx.table(s, d, "orders").select(state.alias("true"), (F.col("o_orderkey") % 3).alias("pred"))


@query("confusion_counts", f'WITH {LABELS} SELECT t::BIGINT AS "true", p AS pred, n FROM c')
def confusion_counts(s, d):
    return rounded(evaluate.confusion_counts(labels(s, d)))


@query("clustering_accuracy", f"WITH {LABELS}, m AS (SELECT coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(e.n, 0) AS x FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) v(i, j, k) LEFT JOIN c a ON a.t = 0 AND a.p = i LEFT JOIN c b ON b.t = 1 AND b.p = j LEFT JOIN c e ON e.t = 2 AND e.p = k) SELECT round(max(x) / (SELECT sum(n) FROM c), 6) AS accuracy FROM m")
def clustering_accuracy(s, d):
    return rounded(evaluate.clustering_accuracy(labels(s, d)))


@query("links", f"WITH {fx.R_BRAND}, {fx.PROBS}, x AS (SELECT v.item, v.opponent, (v.a + 1) / (v.a + o.a + 2) AS p FROM v JOIN v o ON v.item = o.opponent AND v.opponent = o.item) SELECT item::BIGINT AS item, opponent::BIGINT AS opponent, round(ln(p / (1 - p)), 6) AS logit, round(CASE WHEN p < 0.5 THEN ln(2 * p) ELSE -ln(2 * (1 - p)) END, 6) AS laplace, round((1 - (-ln(p)) ** 0.5) / 0.5, 6) AS gumbel, round(1 / (1 + exp(-p)), 6) AS cdf FROM x")
def links(s, d):
    pairs = breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d)), "all", 1.0)
    p = F.col("p")
    return rounded(pairs.select("item", "opponent", logit().phi(p).alias("logit"), laplace().phi(p).alias("laplace"), gumbel_ev().phi(p).alias("gumbel"), logit().cdf(p).alias("cdf")))


def place_sql(beta: float, scale: float, p: str) -> str:
    """Halving steps for the inverse of the generalised normal, its distribution by the series of the gamma function."""
    lower = f"m * exp(-pow(m, {beta})) * list_sum([exp(n * ln(pow(m, {beta})) - lgamma({1 / beta!r} + n + 1)) for n in range(0, 120)])"
    return f"h_{p}(k, item, opponent, p, lo, hi) AS (SELECT 0, item, opponent, p, 0.0::DOUBLE, 8.0::DOUBLE FROM x UNION ALL SELECT k + 1, item, opponent, p, CASE WHEN low < want THEN m ELSE lo END, CASE WHEN low < want THEN hi ELSE m END FROM (SELECT *, {lower} AS low, abs(2 * p - 1) AS want FROM (SELECT *, (lo + hi) / 2 AS m FROM h_{p}) WHERE k < 52)), {p} AS (SELECT item, opponent, sign(p - 0.5) * {scale} * (lo + hi) / 2 AS v FROM h_{p} WHERE k = 52)"


@query("links_helpers", f"WITH RECURSIVE {fx.R_BRAND}, {fx.PROBS}, x AS (SELECT v.item, v.opponent, (v.a + 1) / (v.a + o.a + 2) AS p FROM v JOIN v o ON v.item = o.opponent AND v.opponent = o.item), {place_sql(2.0, 2.0, 'probit')}, {place_sql(1.5, 1.0, 'gennorm')} SELECT item::BIGINT AS item, opponent::BIGINT AS opponent, round(probit.v, 6) AS probit, round(gennorm.v, 6) AS gennorm FROM probit JOIN gennorm USING (item, opponent)")
def links_helpers(s, d):
    pairs = breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d)), "all", 1.0)
    return rounded(pairs.select("item", "opponent", probit().phi(F.col("p")).alias("probit"), gennorm(1.5).phi(F.col("p")).alias("gennorm")))


# --- sampling


@query("sample_comparisons", f"WITH {fx.R_BRAND}, {fx.PROBS}, x AS (SELECT v.item, v.opponent, v.a / (v.a + o.a) AS p FROM v JOIN v o ON v.item = o.opponent AND v.opponent = o.item WHERE v.item < v.opponent), t AS (SELECT item, opponent, p, unnest(range(1, 11)) AS draw FROM x) SELECT item::BIGINT AS item, opponent::BIGINT AS opponent, count(*) FILTER ({UNIFORM.format("'9|' || item::VARCHAR || '|' || opponent::VARCHAR || '|' || draw::VARCHAR")} < p) AS won FROM t GROUP BY 1, 2")
def sample_comparisons(s, d):
    pairs = breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d)))
    out = sampling.sample_comparisons(pairs, 10, 9)
    return rounded(out.groupBy(F.least("winner", "loser").alias("item"), F.greatest("winner", "loser").alias("opponent")).agg(F.sum((F.col("winner") < F.col("loser")).cast("long")).alias("won")))


@query("sample_menu_rankings", f"WITH {fx.R_EVENTS}, i AS (SELECT ranking_id, row_number() OVER (ORDER BY md5('2|' || ranking_id::VARCHAR), ranking_id) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT ranking_id FROM r)), m AS (SELECT DISTINCT p_partkey AS menu_id, [p_size % 5, (p_size + 1) % 5] AS menu FROM part), t AS (SELECT menu_id, menu, unnest(range(0, 3)) AS draw FROM m), f AS (SELECT t.*, floor({UNIFORM.format("'2|' || menu_id::VARCHAR || '|' || draw::VARCHAR")} * (SELECT max(total) FROM i))::BIGINT AS n FROM t), e AS (SELECT f.menu_id, f.draw, r.item, r.pos FROM f JOIN i USING (n) JOIN r USING (ranking_id) WHERE list_contains(f.menu, r.item)), g AS (SELECT menu_id, draw, string_agg(item::VARCHAR, ',' ORDER BY pos) AS items FROM e GROUP BY 1, 2) SELECT f.menu_id, f.draw, coalesce(items, '') AS items FROM f LEFT JOIN g USING (menu_id, draw)")
def sample_menu_rankings(s, d):
    menus = fx.table(s, d, "part").select(F.col("p_partkey").alias("menu_id"), F.array(F.col("p_size") % 5, (F.col("p_size") + 1) % 5).alias("items"))
    return rounded(sampling.sample_menu_rankings(fx.event_rankings(s, d), menus, 3, 2).select("menu_id", "draw", text()))


OWN_PARAMS = "params AS (SELECT (ranking_id % 2)::INTEGER AS component, item, ln(count(*) + 1.0::DOUBLE) AS theta FROM r GROUP BY 1, 2)"
DRAWN = f"g AS (SELECT *, theta - ln(-ln({UNIFORM.format("'1|' || ranking_id || '|' || item::VARCHAR")})) AS u FROM y) SELECT ranking_id, component, string_agg(item::VARCHAR, ',' ORDER BY u DESC, item) AS items FROM g GROUP BY 1, 2"


@query("sample_rankings", f"WITH {fx.R_BRAND}, {OWN_PARAMS}, t AS ({items_sql(order='item')}), m AS (SELECT DISTINCT items, md5(items) AS menu_id FROM t WHERE contains(items, ',')), x AS (SELECT menu_id, unnest(string_split(items, ','))::INTEGER AS item FROM m), y AS (SELECT component::VARCHAR || ':' || menu_id || ':' || draw::VARCHAR AS ranking_id, component, item, theta FROM x JOIN params USING (item), range(2) z(draw)), {DRAWN}")
def sample_rankings(s, d):
    menus = prepare.distinct_menus(fx.brand_rankings(s, d)).where(F.size("items") > 1).withColumn("menu_id", F.md5(F.array_join(F.col("items").cast("array<string>"), ",")))
    return sampling.sample_rankings(own_params(s, d), 2, "gumbel", 1, menus).select("ranking_id", "component", text())


@query("sample_mixture_rankings", f"WITH {fx.R_BRAND}, {OWN_PARAMS}, o AS (SELECT unnest(range(0, (SELECT count(*) FROM orders)))::VARCHAR AS ranking_id), c AS (SELECT ranking_id, CASE WHEN {UNIFORM.format("'1/z|' || ranking_id")} < 1 / 3.0::DOUBLE THEN 0 ELSE 1 END AS component FROM o), y AS (SELECT ranking_id, component, item, theta FROM c JOIN params USING (component)), {DRAWN}")
def sample_mixture_rankings(s, d):
    m = fx.table(s, d, "orders").count()
    return sampling.sample_mixture_rankings(own_params(s, d), fx.fixed_mixture(s), m, "gumbel", 1).select("ranking_id", "component", text())


# --- graphs and time


@query("comparison_graph", f"WITH {fx.R_DAYS}, {fx.COUNTS} SELECT a.winner::BIGINT AS src, a.loser::BIGINT AS dst FROM w a JOIN w z ON a.winner = z.loser AND a.loser = z.winner WHERE a.winner < a.loser")
def comparison_graph(s, d):
    return rounded(graph.comparison_graph(breaking.pair_probs(breaking.pair_counts(fx.daily_event_rankings(s, d)))))


def order_menus(s, d):
    lines = fx.table(s, d, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("items"))


@query("menu_graph", "SELECT DISTINCT min(l_partkey) OVER (PARTITION BY l_orderkey) AS src, l_partkey AS dst FROM lineitem")
def menu_graph(s, d):
    return graph.menu_graph(order_menus(s, d))


def supplier_graph(s, d):
    """Parts and the suppliers of their lines."""
    lines = fx.table(s, d, "lineitem")
    return lines.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"))


#: The smallest node within so many edges is the smallest of the component, as no two nodes lie farther apart.
WIDEST = 40
COMPONENTS = f"WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e), t(k, node, seen) AS (SELECT DISTINCT 0, a, a FROM s UNION ALL SELECT k + 1, s.b, min(t.seen) FROM t JOIN s ON t.node = s.a WHERE k < {WIDEST} GROUP BY k + 1, s.b) SELECT node, seen AS component FROM t WHERE k = {WIDEST}"


def connected_components(s, d):
    return graph.connected_components(supplier_graph(s, d))


query("connected_components", COMPONENTS)(connected_components)


TIMED = f"{fx.R_DAYS}, k AS (SELECT a.day, a.item AS winner, z.item AS loser FROM r a JOIN r z ON a.ranking_id = z.ranking_id AND a.pos < z.pos)"


@query("pair_counts_by_time", f"WITH {TIMED} SELECT date_trunc('day', day)::TIMESTAMP AS start, winner::BIGINT AS winner, loser::BIGINT AS loser, count(*)::DOUBLE AS wins FROM k GROUP BY 1, 2, 3")
def pair_counts_by_time(s, d):
    rows = fx.daily_event_rankings(s, d).withColumnRenamed("day", "ts")
    return rounded(timed.pair_counts_by_time(rows))


@query("kernel_pair_counts", f"WITH {TIMED}, c AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', day::TIMESTAMP) AS t, winner, loser, count(*)::DOUBLE AS wins FROM k GROUP BY 1, 2, 3), s AS (SELECT i AS t FROM range(30) x(i)) SELECT s.t, winner::BIGINT AS winner, loser::BIGINT AS loser, round(sum(wins * exp(-pow((s.t - c.t) / 1.5, 2) / 2) / sqrt(2 * pi())), 6) AS wins FROM c JOIN s ON abs(s.t - c.t) <= 4 GROUP BY 1, 2, 3")
def kernel_pair_counts(s, d):
    rows = fx.daily_event_rankings(s, d).withColumnRenamed("day", "ts")
    counts = timed.pair_counts_by_time(rows)
    counts = counts.select(F.date_diff("start", F.lit("2024-01-01")).alias("t"), "winner", "loser", "wins")
    return rounded(timed.kernel_pair_counts(counts, 30, 0.05))


@query("kernel_pair_counts_stream", f"WITH {TIMED}, c AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', day::TIMESTAMP) AS t, winner, loser, count(*)::DOUBLE AS wins FROM k GROUP BY 1, 2, 3), e AS (SELECT max(date_diff('day', TIMESTAMP '2024-01-01', day::TIMESTAMP)) AS open FROM r), s AS (SELECT i AS t FROM e, range(open) x(i) WHERE i + 4 < open) SELECT s.t, winner::BIGINT AS winner, loser::BIGINT AS loser, round(sum(wins * exp(-pow((s.t - c.t) / 1.5, 2) / 2) / sqrt(2 * pi())), 6) AS wins FROM c JOIN s ON abs(s.t - c.t) <= 4 GROUP BY 1, 2, 3")
def kernel_pair_counts_stream(s, d):
    """The smoothed counts of all days that the stream of rankings has closed."""
    source = written(fx.daily_event_rankings(s, d).select("ranking_id", F.col("day").alias("ts"), "items"))
    stream = s.readStream.schema(source.schema).parquet(source.inputFiles()[0].rpartition("/")[0])
    out = timed.kernel_pair_counts_stream(stream, 1.5, "1 day", "0 seconds", "2024-01-01")
    return rounded(timed.run_to_end(out).where("t >= 0"))


KERNEL = f"{TIMED}, c AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', day::TIMESTAMP) AS t, winner, loser, count(*)::DOUBLE AS wins FROM k GROUP BY 1, 2, 3), z AS (SELECT z.t, winner, loser, sum(wins * exp(-pow((z.t - c.t) / 1.5, 2) / 2) / sqrt(2 * pi())) AS wins FROM c JOIN (SELECT i AS t FROM range(30) x(i)) z ON abs(z.t - c.t) <= 4 GROUP BY 1, 2, 3), both_ways AS (SELECT t, winner AS i, loser AS j, wins AS a, 0.0::DOUBLE AS b FROM z UNION ALL SELECT t, loser, winner, 0.0, wins FROM z), p AS (SELECT t, i, j, sum(a) + 1 AS a, sum(a) + sum(b) + 2 AS n FROM both_ways GROUP BY 1, 2, 3)"
#: More turns than any step's fit takes to settle to the digits that are compared.
TURNS = 800
LN_T = "SELECT t, item::BIGINT AS item, round(theta - avg(theta) OVER (PARTITION BY t), 6) AS theta FROM (SELECT t, item, ln(pi) AS theta FROM it WHERE k = {})"


def smoothed_counts(s, d):
    counts = timed.pair_counts_by_time(fx.daily_event_rankings(s, d).withColumnRenamed("day", "ts"))
    counts = counts.select(F.date_diff("start", F.lit("2024-01-01")).alias("t"), "winner", "loser", "wins")
    return timed.kernel_pair_counts(counts, 30, 0.05)


@query("fit_over_time", f"WITH RECURSIVE {KERNEL}, o AS (SELECT t, j AS src, sum(a / n) AS out FROM p GROUP BY 1, 2), top AS (SELECT t, max(out) AS top FROM o GROUP BY 1), f AS (SELECT p.t, j AS src, i AS dst, a / n / top AS p FROM p JOIN top USING (t) UNION ALL SELECT o.t, src, src, 1 - out / top FROM o JOIN top USING (t)), it(k, t, item, pi) AS (SELECT 0, t, i, 0.2::DOUBLE FROM (SELECT DISTINCT t FROM p), range(5) x(i) UNION ALL SELECT k + 1, it.t, dst, sum(pi * f.p) FROM it JOIN f ON f.t = it.t AND f.src = it.item WHERE k < {TURNS} GROUP BY 1, 2, 3) {LN_T.format(TURNS)}")
def fit_over_time(s, d):
    """A day's order of event kinds, from counts smoothed over the days about it."""
    return rounded(dynamic.fit_over_time(smoothed_counts(s, d), fx.N_EVENTS).select("t", "item", "theta"))


@query("fit_over_time_likelihood", f"WITH RECURSIVE {KERNEL}, won AS (SELECT t, i AS item, sum(a) AS won FROM p GROUP BY 1, 2), it(k, t, item, pi) AS (SELECT 0, t, i, 0.2::DOUBLE FROM (SELECT DISTINCT t FROM p), range(5) x(i) UNION ALL SELECT k, t, item, pi / sum(pi) OVER (PARTITION BY t) FROM (SELECT it.k + 1 AS k, it.t, it.item, any_value(won) / sum(n / (it.pi + o.pi)) AS pi FROM it JOIN p ON p.t = it.t AND p.i = it.item JOIN it o ON o.t = it.t AND o.item = p.j JOIN won ON won.t = it.t AND won.item = it.item WHERE it.k < {TURNS} GROUP BY 1, 2, 3)) {LN_T.format(TURNS)}")
def fit_over_time_likelihood(s, d):
    return rounded(dynamic.fit_over_time(smoothed_counts(s, d), fx.N_EVENTS, "bradley_terry").select("t", "item", "theta"))


# --- orders with circles


def level_sql(edges: str) -> str:
    """Items, components, levels and ranks from ``v`` (item) and the edges of ``e`` (a, b)."""
    return f"{edges}, reach(a, b) AS (SELECT item, item FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), comp AS (SELECT x.a AS item, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1), ce AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN comp x ON x.item = e.a JOIN comp y ON y.item = e.b WHERE x.component <> y.component), way(c, k) AS (SELECT component, 0 FROM comp UNION SELECT ce.b, k + 1 FROM way JOIN ce ON way.c = ce.a), lv AS (SELECT c AS component, max(k) AS level FROM way GROUP BY 1), won AS (SELECT e.a AS item, count(*) AS won FROM e JOIN comp x ON x.item = e.a JOIN comp y ON y.item = e.b WHERE x.component = y.component GROUP BY 1) SELECT item::BIGINT AS item, component::BIGINT AS component, level::BIGINT AS level, row_number() OVER (ORDER BY level, component, coalesce(won, 0) DESC, item) AS rank FROM comp JOIN lv USING (component) LEFT JOIN won USING (item)"


X_EDGES = "x AS (SELECT v.item, v.opponent, v.a, v.a + o.a AS total, v.a / (v.a + o.a) AS p FROM v v JOIN v o ON v.item = o.opponent AND v.opponent = o.item)"


@query("preference_levels_brand", f"WITH RECURSIVE {fx.R_BRAND}, {fx.PROBS.replace('v AS (', 'v0 AS (')}, {X_EDGES.replace('FROM v v JOIN v o', 'FROM v0 v JOIN v0 o')}, v AS (SELECT DISTINCT item FROM x), e AS (SELECT item AS a, opponent AS b FROM x WHERE p > 0.5 + 0.03), {level_sql('u0 AS (SELECT 1)')}")
def preference_levels_brand(s, d):
    return rounded(graph.preference_levels(breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d))), 0.03))


def bought_parts(s, d):
    """Per customer the parts they bought, by quantity."""
    lines = fx.table(s, d, "lineitem").join(fx.table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return prepare.rankings_from_scores(lines.groupBy("o_custkey", F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("score")), "o_custkey")


R_PART = fx.R_NATION.replace("s_nationkey AS item", "l_partkey AS item").replace(" JOIN supplier ON l_suppkey = s_suppkey", "")


@query("preference_levels_part", f"WITH RECURSIVE {R_PART}, {fx.PROBS.replace('v AS (', 'v0 AS (')}, {X_EDGES.replace('FROM v v JOIN v o', 'FROM v0 v JOIN v0 o')}, v AS (SELECT DISTINCT item FROM x), e AS (SELECT item AS a, opponent AS b FROM x WHERE p > 0.5 + 0.2 AND total >= 4), {level_sql('u0 AS (SELECT 1)')}")
def preference_levels_part(s, d):
    """Parts with clear majorities of at least four comparisons: one large circle, small ones, and chains beside them."""
    rows = bought_parts(s, d)
    items = rows.where("size(items) > 1").select(F.explode("items").alias("item"))
    return rounded(graph.preference_levels(graph.pairs_met_often(rows, 4), 0.2, 4, items))


@query("connected_components_parts", f"WITH RECURSIVE {R_PART}, {fx.PROBS.replace('v AS (', 'v0 AS (')}, {X_EDGES.replace('FROM v v JOIN v o', 'FROM v0 v JOIN v0 o')}, e AS (SELECT item AS a, opponent AS b FROM x WHERE total >= 5), t(node, seen) AS (SELECT a, least(a, b) FROM e UNION SELECT e.b, t.seen FROM t JOIN e ON t.node = e.a) SELECT node, min(seen) AS component FROM t GROUP BY 1")
def connected_components_parts(s, d):
    """Parts that many customers bought both of: hundreds of components of unlike size."""
    edges = graph.pairs_met_often(bought_parts(s, d), 5).where("item < opponent")
    return graph.connected_components(edges.select(F.col("item").alias("src"), F.col("opponent").alias("dst")))


# --- fits


CHAIN = f"{fx.R_BRAND}, {fx.PROBS}, x AS (SELECT v.item AS winner, v.opponent AS loser, (v.a + 1) / (v.a + o.a + 2) AS p FROM v JOIN v o ON v.item = o.opponent AND v.opponent = o.item), f AS (SELECT loser AS src, winner AS dst, p / (SELECT max(t) FROM (SELECT sum(p) AS t FROM x GROUP BY loser)) AS p FROM x), f2 AS (SELECT * FROM f UNION ALL SELECT src, src, 1 - sum(p) FROM f GROUP BY src)"


@query("rank_centrality", f"WITH RECURSIVE {CHAIN}, it(k, item, pi) AS (SELECT 0, i::INTEGER, 1 / 25.0::DOUBLE FROM range(25) z(i) UNION ALL SELECT k + 1, dst, sum(pi * p) FROM it JOIN f2 ON it.item = f2.src WHERE k < 60 GROUP BY k + 1, dst), l AS (SELECT item, ln(pi / sum(pi) OVER ()) AS theta FROM it WHERE k = 60) SELECT 0::BIGINT AS component, item::BIGINT AS item, round(theta - avg(theta) OVER (), 6) AS theta FROM l")
def rank_centrality(s, d):
    return rounded(estimators.rank_centrality(fx.brand_rankings(s, d), fx.N_BRANDS, 1.0, 60, 0.0))


def mm_step(old: str, new: str) -> str:
    return f"e{new} AS (SELECT r.*, exp(theta) AS wt FROM r JOIN {old} USING (item)), s{new} AS (SELECT *, sum(wt) OVER (PARTITION BY ranking_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix FROM e{new}), t{new} AS (SELECT item, sum(CASE WHEN pos <= n - 2 THEN 1 / suffix ELSE 0 END) OVER (PARTITION BY ranking_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM s{new}), d{new} AS (SELECT item, sum(prefix) AS den FROM t{new} GROUP BY 1), l{new} AS (SELECT item, ln(wins / den) AS theta FROM wins JOIN d{new} USING (item)), {new} AS (SELECT item, theta - avg(theta) OVER () AS theta FROM l{new})"


@query("luce_mm_steps", f"WITH {fx.R_BRAND}, wins AS (SELECT item, count(*)::DOUBLE AS wins FROM r WHERE pos < n - 1 GROUP BY 1), m0 AS (SELECT i::INTEGER AS item, 0.0::DOUBLE AS theta FROM range(25) x(i)), {mm_step('m0', 'm1')}, {mm_step('m1', 'm2')}, {mm_step('m2', 'm3')} SELECT 0::BIGINT AS component, item::BIGINT AS item, round(theta, 6) AS theta FROM m3")
def luce_mm_steps(s, d):
    """Three iterations, so that SQL can tell each of them."""
    return rounded(estimators.luce_mm(fx.brand_rankings(s, d), fx.N_BRANDS, max_iters=3, tol=0.0))


#: More iterations than the fit takes to settle to the digits that are compared.
MM_TURNS = 200
MM_SQL = f"WITH RECURSIVE {fx.R_BRAND}, wins AS (SELECT item, count(*)::DOUBLE AS wins FROM r WHERE pos < n - 1 GROUP BY 1), m(k, item, theta) AS (SELECT 0, i::INTEGER, 0.0::DOUBLE FROM range(25) x(i) UNION ALL SELECT k, item, t - avg(t) OVER () FROM (SELECT k + 1 AS k, item, ln(any_value(wins) / sum(prefix)) AS t FROM (SELECT k, item, wins, sum(CASE WHEN pos <= n - 2 THEN 1 / suffix ELSE 0 END) OVER (PARTITION BY ranking_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM (SELECT m.k, r.*, wins, sum(exp(theta)) OVER (PARTITION BY ranking_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix FROM r JOIN m USING (item) JOIN wins USING (item) WHERE m.k < {MM_TURNS})) GROUP BY k, item)) SELECT 0::BIGINT AS component, item::BIGINT AS item, round(theta, 6) AS theta FROM m WHERE k = {MM_TURNS}"


@query("luce_mm", MM_SQL)
def luce_mm(s, d):
    """The whole fit, until it settles."""
    return rounded(estimators.luce_mm(fx.brand_rankings(s, d), fx.N_BRANDS))



@query("mixture_em_step", f"WITH {fx.R_BRAND.replace('FROM b)', 'FROM b), r2 AS (SELECT * FROM r WHERE n > 1)')}, {fx.PARAMS.replace('params AS', 'raw AS', 1)}, {CENTRED}, mixture AS (SELECT c::INTEGER AS component, 0.5::DOUBLE AS alpha FROM range(2) x(c)), {fx.RESP.replace('r.*', 'r2.*').replace('FROM r JOIN', 'FROM r2 JOIN')}, t AS (SELECT *, sum(CASE WHEN pos <= n - 2 THEN 1 / suffix ELSE 0 END) OVER (PARTITION BY ranking_id, component ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM s), a AS (SELECT component, item, sum(q * prefix) AS den, sum(CASE WHEN pos < n - 1 THEN q ELSE 0 END) AS wins FROM t JOIN q USING (ranking_id, component) GROUP BY 1, 2), l AS (SELECT component, item, ln(wins / den) AS theta FROM a) SELECT component::BIGINT AS component, item::BIGINT AS item, round(theta - avg(theta) OVER (PARTITION BY component), 6) AS theta FROM l")
def mixture_em_step(s, d):
    import numpy as np

    start = np.array([[((i + 3 * c) * 7 % 11) / 5 - 1 for i in range(25)] for c in range(2)])
    start -= start.mean(1, keepdims=True)
    rows = fx.brand_rankings(s, d)
    return rounded(mixture.fit_mixture(rows, 2, fx.N_BRANDS, "mm", start, max_iters=1).params(rows))


def stationary_sql(rates: str, new: str, rounds: int) -> str:
    """The stationary distribution (item, pi) of a chain with rates (src, dst, rate), by power iteration."""
    return f"c{new} AS (SELECT src, dst, rate / (SELECT max(t) FROM (SELECT sum(rate) AS t FROM {rates} GROUP BY src)) AS p FROM {rates}), d{new} AS (SELECT * FROM c{new} UNION ALL SELECT src, src, 1 - sum(p) FROM c{new} GROUP BY src), it{new}(k, item, pi) AS (SELECT 0, i::INTEGER, 1 / 25.0::DOUBLE FROM range(25) z(i) UNION ALL SELECT k + 1, dst, sum(pi * p) FROM it{new} JOIN d{new} ON item = src WHERE k < {rounds} GROUP BY k + 1, dst), {new} AS (SELECT item, pi / sum(pi) OVER () AS pi FROM it{new} WHERE k = {rounds})"


def suffix_sql(old: str, new: str) -> str:
    return f"e{new} AS (SELECT r.*, pi AS wt FROM r JOIN {old} USING (item)), s{new} AS (SELECT *, sum(wt) OVER (PARTITION BY ranking_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix FROM e{new})"


def flow_step(old: str, new: str) -> str:
    """Flows at the estimate ``old`` (item, pi), smoothed, and their stationary distribution."""
    flows = f"q{new} AS (SELECT z.item AS src, a.item AS dst, sum(1 / a.suffix) AS rate FROM s{new} a JOIN r z ON a.ranking_id = z.ranking_id AND a.pos < z.pos GROUP BY 1, 2), b{new} AS (SELECT coalesce(q.src, o.dst) AS src, coalesce(q.dst, o.src) AS dst, coalesce(q.rate, 0) + CASE WHEN q.rate IS NULL OR o.rate IS NULL THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM q{new} q FULL JOIN q{new} o ON q.src = o.dst AND q.dst = o.src)"
    return f"{suffix_sql(old, new)}, {flows}, {stationary_sql(f'b{new}', new, 600)}"


def gamma_step(old: str, new: str) -> str:
    """The fixed point's step from (item, pi) and the mass d of the prior's own state, for a0 = 1 and b0 = 25."""
    den = f"t{new} AS (SELECT item, sum(CASE WHEN pos <= n - 2 THEN 1 / suffix ELSE 0 END) OVER (PARTITION BY ranking_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM s{new}), den{new} AS (SELECT item, sum(prefix) AS den FROM t{new} GROUP BY 1)"
    return f"{suffix_sql(old, new)}, {den}, u{new} AS (SELECT item, (coalesce(wins, 0) + d) / (coalesce(den, 0) + 25) AS u FROM {old} LEFT JOIN wins USING (item) LEFT JOIN den{new} USING (item), d_{old}), {new} AS (SELECT item, u / (2 * sum(u) OVER ()) AS pi FROM u{new}), d_{new} AS (SELECT 0.5::DOUBLE AS d)"


LN_PI = "l AS (SELECT item, ln(pi) AS theta FROM {}) SELECT 0::BIGINT AS component, item::BIGINT AS item, round(theta - avg(theta) OVER (), 6) AS theta FROM l"
START_PI = "p0 AS (SELECT i::INTEGER AS item, 1 / {}::DOUBLE AS pi FROM range(25) x(i))"


@query("luce_spectral_steps", f"WITH RECURSIVE {fx.R_BRAND}, {START_PI.format(25)}, {flow_step('p0', 'p1')}, {flow_step('p1', 'p2')}, {LN_PI.format('p2')}")
def luce_spectral_steps(s, d):
    """Two iterations, so that SQL can tell the same."""
    return rounded(estimators.luce_spectral(fx.brand_rankings(s, d), fx.N_BRANDS, max_iters=2, tol=0.0))


@query("luce_spectral_map_steps", f"WITH {fx.R_BRAND}, wins AS (SELECT item, count(*)::DOUBLE AS wins FROM r WHERE pos < n - 1 GROUP BY 1), {START_PI.format(26)}, d_p0 AS (SELECT 1 / 26.0::DOUBLE AS d), {gamma_step('p0', 'p1')}, {gamma_step('p1', 'p2')}, {LN_PI.format('p2')}")
def luce_spectral_map_steps(s, d):
    """Two iterations, so that SQL can tell the same."""
    return rounded(estimators.luce_spectral_map(fx.brand_rankings(s, d), fx.N_BRANDS, max_iters=2, tol=0.0)[0])


@query("fit_mixture_map_step", SQL["mixture_em_step"].replace("ln(wins / den)", "ln((0.1 + wins) / (0.1 + den))"))
def fit_mixture_map_step(s, d):
    """One iteration of the fit with a gamma prior, from a stated start."""
    import numpy as np

    start = np.array([[((i + 3 * c) * 7 % 11) / 5 - 1 for i in range(25)] for c in range(2)])
    rows = fx.brand_rankings(s, d)
    return rounded(mixture.fit_mixture(rows, 2, fx.N_BRANDS, "map", start - start.mean(1, keepdims=True), max_iters=1, c=1.1, d=0.1).params(rows))


def fitted(f) -> Query:
    return lambda s, d: rounded(f(fx.brand_rankings(s, d), fx.N_BRANDS))


def over_pairs(f) -> Query:
    return lambda s, d: rounded(f(breaking.drop_extreme_pairs(breaking.pair_probs(breaking.pair_counts(fx.brand_rankings(s, d)), "all", 1.0)), fx.N_BRANDS))


SMOOTHED = f"{fx.R_BRAND}, {fx.PROBS}, x AS (SELECT v.item, v.opponent, (v.a + 1) / (v.a + o.a + 2) AS p FROM v JOIN v o ON v.item = o.opponent AND v.opponent = o.item), y AS (SELECT * FROM x WHERE p BETWEEN 0.001 AND 0.999)"
query("rank_centrality_from_probs", f"WITH RECURSIVE {SMOOTHED}, f AS (SELECT opponent AS src, item AS dst, p AS rate FROM y), {stationary_sql('f', 'p1', 600)}, {LN_PI.format('p1')}")(over_pairs(estimators.rank_centrality_from_probs))
LEAST_SQUARES = "h AS (SELECT item, opponent, ln(p / (1 - p)) AS phi FROM y), met AS (SELECT item, opponent, count(*) AS m FROM (SELECT item, opponent FROM h UNION ALL SELECT opponent, item FROM h) GROUP BY 1, 2), deg AS (SELECT item, sum(m) AS deg FROM met GROUP BY 1), rhs AS (SELECT item, sum(phi) AS rhs FROM (SELECT item, phi FROM h UNION ALL SELECT opponent, -phi FROM h) GROUP BY 1), it(step, item, theta) AS (SELECT 0, i::INTEGER, 0.0::DOUBLE FROM range(25) z(i) UNION ALL SELECT step + 1, met.item, (any_value(rhs) + sum(m * theta)) / (any_value(deg) + 0.5) FROM it JOIN met ON it.item = met.opponent JOIN deg ON deg.item = met.item JOIN rhs ON rhs.item = met.item WHERE step < 400 GROUP BY step + 1, met.item), l AS (SELECT item, theta FROM it WHERE step = 400) SELECT 0::BIGINT AS component, item::BIGINT AS item, round(theta - avg(theta) OVER (), 6) AS theta FROM l"
query("luce_spectral")(fitted(estimators.luce_spectral))
@query("luce_spectral_parts")
def luce_spectral_parts(s, d):
    """Strengths of all parts from the order of their quantities within orders, on a table of the pairs that occur."""
    rows = fx.part_rankings(s, d)
    n = fx.table(s, d, "part").agg(F.max("p_partkey")).first()[0] or 0
    return rounded(estimators.luce_spectral_sparse(rows, n, tol=1e-6))


query("luce_spectral_map")(fitted(lambda r, n: estimators.luce_spectral_map(r, n)[0]))
query("pair_gmm")(fitted(estimators.pair_gmm))
query("pair_cml")(fitted(estimators.pair_cml))
query("pair_least_squares", f"WITH RECURSIVE {SMOOTHED}, {LEAST_SQUARES}")(over_pairs(estimators.pair_least_squares))
query("pair_low_rank")(over_pairs(estimators.pair_low_rank))
query("pair_factorize")(over_pairs(estimators.pair_factorize))
query("pair_factorize_huber")(over_pairs(lambda p, n: estimators.pair_low_rank_model(p, tol=1e-3)))


@query("pair_posterior")
def pair_posterior(s, d):
    days = fx.daily_event_rankings(s, d)
    rows = breaking.rank_break(days).join(days.select("ranking_id", F.dayofweek("day").alias("weekday")), "ranking_id")
    return rounded(estimators.pair_posterior(rows, 1.0, ["weekday"]))


def mixture_fit(m_step: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = fx.nation_rankings(s, d)
        return rounded(mixture.fit_mixture(rows, 2, fx.N_NATIONS, m_step, seed=1, c=1.1, d=0.1, alpha0=1.0).params(rows))

    return run


for step in mixture.STEPS:
    query(f"fit_mixture_{step}")(mixture_fit(step))


@query("sample_posterior")
def sample_posterior(s, d):
    rows = fx.nation_rankings(s, d)
    return rounded(mixture.sample_posterior(rows, 2, fx.N_NATIONS).params(rows))


@query("mixture_moments")
def mixture_moments(s, d):
    rows = fx.nation_rankings(s, d)
    return rounded(mixture.mixture_moments(rows, 2, fx.N_NATIONS).params(rows))


@query("cluster_rankings")
def cluster_rankings(s, d):
    return clustering.cluster_rankings(fx.event_rankings(s, d), 2, fx.N_EVENTS)[0]


@query("cluster_rankings_sketch")
def cluster_rankings_sketch(s, d):
    """Customers by the orders of the nations they buy from, by sketches of all pairs."""
    return clustering.cluster_rankings(fx.nation_rankings(s, d), 3, fx.N_NATIONS, "sketch", width=256, centres=False)[0]


def indexed_ratings(s, d):
    ratings = fx.ratings(s, d)
    users, items = (ratings.select(c).distinct().count() for c in ("user_id", "item_id"))
    return prepare.index_ratings(ratings, users, items).select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("rating").cast("float"))


@query("complete_ratings")
def complete_ratings(s, d):
    return estimators.complete_ratings(indexed_ratings(s, d), joined=True)


@query("complete_ratings_zeros")
def complete_ratings_zeros(s, d):
    return estimators.complete_ratings_zeros(indexed_ratings(s, d), rank=8, tol=1e-3, joined=True)


@query("score_grid", "SELECT c_custkey AS user, n_nationkey::BIGINT AS item, round(c_acctbal / 1000 * (n_nationkey + 1) + c_nationkey * n_regionkey, 6) AS score FROM customer, nation")
def score_grid(s, d):
    """Customers with nations; their numbers serve as factors."""
    users = fx.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal").cast("double") / 1000, F.col("c_nationkey").cast("double")).alias("features"))
    items = fx.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.array((F.col("n_nationkey") + 1).cast("double"), F.col("n_regionkey").cast("double")).alias("features"))
    return rounded(estimators.score_grid(users, items))


@query("evaluate_grid")
def evaluate_grid(s, d):
    return rounded(grid.evaluate_grid(fx.nation_rankings(s, d), fx.N_NATIONS, [2, 3], [0.5, 1.0], ["mm", "spectral"], timings=False))


# --- the same functions called from Spark SQL


def spark_sql(s: SparkSession, rankings: DataFrame, text_of: str, **views: DataFrame) -> DataFrame:
    register_sql(s)
    return s.sql(text_of, rankings=rankings, **views)  # tables as parameters, so no view is left behind


@query("sql_rank_break", SQL["pair_counts_brand"])
def sql_rank_break(s, d):
    return spark_sql(s, fx.brand_rankings(s, d), "SELECT CAST(winner AS BIGINT) AS winner, CAST(loser AS BIGINT) AS loser, CAST(count(*) AS DOUBLE) AS wins FROM {rankings} r, LATERAL rank_break(r.items) GROUP BY 1, 2")


@query("sql_pl_log_likelihood", SQL["pl_log_likelihood"])
def sql_pl_log_likelihood(s, d):
    maps = fx.fixed_params(s).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("item", "theta"))).alias("thetas"))
    return spark_sql(s, fx.brand_rankings(s, d), "SELECT ranking_id, CAST(component AS BIGINT) AS component, round(pl_log_likelihood(items, thetas), 6) AS ll FROM {rankings} CROSS JOIN (SELECT /*+ BROADCAST(maps) */ * FROM {maps} AS maps)", maps=maps)


@query("sql_pair_entries", SQL["embed_pairwise_signed"])
def sql_pair_entries(s, d):
    return spark_sql(s, fx.brand_rankings(s, d), "SELECT ranking_id, idx, value FROM {rankings} r, LATERAL pair_entries(r.items, 25)")


def joined_vectors(function: str) -> Query:
    return lambda s, d: spark_sql(s, fx.nation_rankings(s, d), f"SELECT ranking_id, array_join(CAST({function} AS ARRAY<STRING>), ',') AS items FROM {{rankings}}")


query("sql_embed_lehmer", SQL["embed_lehmer"])(joined_vectors("embed_lehmer(items)"))
query("sql_embed_positional", SQL["embed_positional"])(joined_vectors("embed_positional(items, 25)"))
query("sql_embed_topk", SQL["embed_topk"])(joined_vectors("embed_topk(items, 25, 4)"))
query("sql_embed_disjoint_pairs", SQL["embed_disjoint_pairs"])(joined_vectors("embed_disjoint_pairs(items, 25)"))
