"""Rankings, ratings, ballots and models made from the given tables. Every order has a stated tie-break."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscale.operators.prepare import rankings_from_scores
from prefscale.session import table

N_BRANDS, N_NATIONS, N_EVENTS = 25, 25, 5


def brand_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Per order its brands, dearest line first."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    item = (F.substring("p_brand", 7, 3).cast("int") - 1).alias("item")
    return rankings_from_scores(lines.groupBy("l_orderkey", item).agg(F.max("l_extendedprice").alias("score")), "l_orderkey")


def nation_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Per customer the nations of their suppliers, by quantity."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rankings_from_scores(lines.groupBy("o_custkey", F.col("s_nationkey").alias("item")).agg(F.sum("l_quantity").alias("score")), "o_custkey")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_item(column: str = "event_type"):
    return (F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col(column)) - 1).cast("int").alias("item")


def event_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Per user the kinds of events by how often they occur."""
    return rankings_from_scores(table(spark, d, "events").groupBy("user_id", event_item()).agg(F.count("*").alias("score")), "user_id")


def part_rankings(spark: SparkSession, d: str) -> DataFrame:
    """(ranking_id, items) per order: its parts, numbered from 0, by quantity."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") - 1).alias("item")).agg(F.sum("l_quantity").alias("score"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("item").alias("i"))))
    return rows.groupBy(F.col("l_orderkey").alias("ranking_id")).agg(F.transform(best, lambda x: x["i"]).alias("items"))


def daily_event_rankings(spark: SparkSession, d: str) -> DataFrame:
    """(ranking_id, day, items) per user and day."""
    rows = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day"), event_item()).agg(F.count("*").alias("score"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("item").alias("i"))))
    rows = rows.groupBy("user_id", "day").agg(F.transform(best, lambda x: x["i"]).alias("items"))
    return rows.select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd")).alias("ranking_id"), "user_id", "day", "items")


def ratings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.avg("l_quantity").alias("rating"))


def ballot_lines(spark: SparkSession, d: str, ties: bool = True) -> DataFrame:
    """Distinct orders of event kinds as ballot lines, those below the second in braces."""
    groups = event_rankings(spark, d).groupBy("items").agg(F.count("*").alias("votes"))
    text = lambda a: F.array_join(F.transform(a, lambda x: (x + 1).cast("string")), ",")
    tail = F.slice("items", 3, F.size("items"))
    line = F.concat_ws(",", F.col("votes").cast("string"), text(F.slice("items", 1, 2)), F.concat(F.lit("{"), text(tail), F.lit("}"))) if ties else F.concat_ws(",", F.col("votes").cast("string"), text(F.col("items")))
    return groups.where(F.size("items") > 2).select(line.alias("value"))


def fixed_params(spark: SparkSession, components: int = 2, n: int = N_BRANDS) -> DataFrame:
    """A stated model: theta = ((7 (item + 3 component)) mod 11) / 5 - 1."""
    rows = spark.range(components).select(F.col("id").cast("int").alias("component")).join(spark.range(n).select(F.col("id").cast("int").alias("item")))
    return rows.withColumn("theta", ((F.col("item") + 3 * F.col("component")) * 7 % 11) / 5.0 - 1)


def fixed_mixture(spark: SparkSession, components: int = 2) -> DataFrame:
    total = components * (components + 1) / 2
    return spark.range(components).select(F.col("id").cast("int").alias("component"), ((F.col("id") + 1) / F.lit(float(total))).alias("alpha"))


# the same in SQL: r (ranking_id, item, pos, n), params, mixture
R_BRAND = """b AS (SELECT l_orderkey AS ranking_id, substr(p_brand, 7, 3)::INTEGER - 1 AS item, max(l_extendedprice) AS score
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT ranking_id, item, row_number() OVER (PARTITION BY ranking_id ORDER BY score DESC, item) - 1 AS pos, count(*) OVER (PARTITION BY ranking_id) AS n FROM b)"""
R_NATION = """b AS (SELECT o_custkey AS ranking_id, s_nationkey AS item, sum(l_quantity) AS score
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
r AS (SELECT ranking_id, item, row_number() OVER (PARTITION BY ranking_id ORDER BY score DESC, item) - 1 AS pos, count(*) OVER (PARTITION BY ranking_id) AS n FROM b)"""
EVENT_INDEX = "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::INTEGER - 1"
R_EVENTS = f"""b AS (SELECT user_id AS ranking_id, {EVENT_INDEX} AS item, count(*) AS score FROM events GROUP BY 1, 2),
r AS (SELECT ranking_id, item, row_number() OVER (PARTITION BY ranking_id ORDER BY score DESC, item) - 1 AS pos, count(*) OVER (PARTITION BY ranking_id) AS n FROM b)"""
R_DAYS = f"""b AS (SELECT user_id::VARCHAR || ':' || strftime(date_trunc('day', ts), '%Y-%m-%d') AS ranking_id, date_trunc('day', ts) AS day, {EVENT_INDEX} AS item, count(*) AS score FROM events GROUP BY 1, 2, 3),
r AS (SELECT ranking_id, day, item, row_number() OVER (PARTITION BY ranking_id ORDER BY score DESC, item) - 1 AS pos, count(*) OVER (PARTITION BY ranking_id) AS n FROM b)"""
RATINGS = "ratings AS (SELECT o_custkey AS user_id, l_partkey AS item_id, avg(l_quantity) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
PARAMS = "params AS (SELECT c::INTEGER AS component, i::INTEGER AS item, ((i + 3 * c) * 7 % 11) / 5.0::DOUBLE - 1 AS theta FROM range(2) x(c), range(25) y(i))"
MIXTURE = "mixture AS (SELECT c::INTEGER AS component, (c + 1) / 3.0::DOUBLE AS alpha FROM range(2) x(c))"
PAIRS = "k AS (SELECT a.ranking_id, a.item AS winner, z.item AS loser, a.pos AS pos_i, z.pos AS pos_j FROM r a JOIN r z ON a.ranking_id = z.ranking_id AND a.pos < z.pos)"
COUNTS = PAIRS + ",\nw AS (SELECT winner, loser, count(*)::DOUBLE AS wins FROM k GROUP BY 1, 2)"
PROBS = COUNTS + """,
u AS (SELECT winner AS item, loser AS opponent, wins, 0.0 AS lost FROM w UNION ALL SELECT loser, winner, 0.0, wins FROM w),
v AS (SELECT item, opponent, sum(wins) AS a, sum(lost) AS b FROM u GROUP BY 1, 2)"""
LL = """e AS (SELECT r.*, component, theta, exp(theta) AS wt FROM r JOIN params USING (item)),
s AS (SELECT *, sum(wt) OVER (PARTITION BY ranking_id, component ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix FROM e),
ll AS (SELECT ranking_id, component, sum(CASE WHEN pos < n - 1 THEN theta - ln(suffix) ELSE 0 END) AS ll FROM s GROUP BY 1, 2)"""
RESP = LL + """,
j AS (SELECT ranking_id, component, ll + ln(alpha) AS x FROM ll JOIN mixture USING (component)),
q AS (SELECT ranking_id, component, exp(x - max(x) OVER (PARTITION BY ranking_id)) / sum(exp(x)) OVER (PARTITION BY ranking_id) * exp(max(x) OVER (PARTITION BY ranking_id)) AS q FROM j)"""
