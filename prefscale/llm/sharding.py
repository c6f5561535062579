"""Sharding by balanced label propagation.

Documents with equal texts are linked. Links of a group are equal among its members, so the state is a table (group,
shard, rows) instead of one row per document: at most as many rows per group as there are shards, whatever its size.
Each round, a group's rows ask for the shard that already holds most of the group; requests are summed per pair of
shards, quotas grant exchanges both ways and what free room there is, and a distributed prefix sum over the requests
says which of them the quota covers. Afterwards rows get places in their shard; documents without links, which cut no
edge wherever they are, fill the room that is left, so that the law ``rows`` holds: counts differ by one at most.

Defined results: a null text has no bytes (size 1, crc32 0) and is equal to other null texts only; rows that repeat a
doc_id are rows like all others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prefscale.llm.text import place, range_bits, running_before
from prefscale.session import cut, table

SHARDS = 8
ROUNDS = 5
#: Rows that one task ranks at most, of a group or a range.
TASK_ROWS = 100_000


def spread(groups: DataFrame, shards: int) -> DataFrame:
    """The start: each group dealt out evenly, (group, at, shard, n)."""
    base = F.pmod(F.col("at"), F.lit(shards))
    n = F.floor((F.col("c") - F.pmod(F.col("shard") - base, F.lit(shards)) + shards - 1) / shards).cast("long")
    rows = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return rows.withColumn("n", n).where("n > 0").select("group", "at", "shard", "n")


def propagate(state: DataFrame, quotas: DataFrame, bits: int) -> DataFrame:
    """One round: what each group's rows ask for, what the quotas grant, and the state after the moves."""
    # ties go by a hash of group and shard, so that requests between two shards come both ways
    best = F.max(F.struct("n", F.hash("at", "shard").alias("h"), F.col("shard").alias("to")))
    wish = state.join(state.groupBy("group").agg(best.alias("b")).select("group", F.col("b.to").alias("to")), "group")
    wish = wish.where("shard <> to")
    asked = wish.groupBy("shard", "to").agg(F.sum("n").alias("asked"))
    back = asked.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("asked").alias("back"))
    load = state.groupBy("shard").agg(F.sum("n").alias("load"))
    free = quotas.join(load, "shard", "left").select(F.col("shard").alias("to"), F.greatest(F.col("quota") - F.coalesce("load", F.lit(0)), F.lit(0)).alias("free"))
    flow = asked.join(back, ["shard", "to"], "left").join(free, "to")
    flow = flow.withColumn("both", F.least("asked", F.coalesce("back", F.lit(0)))).withColumn("more", F.col("asked") - F.col("both"))
    all_more = F.sum("more").over(W.partitionBy("to"))
    share = F.when(all_more > 0, F.least(F.col("more"), F.floor(F.col("free") * F.col("more") / all_more))).otherwise(0)
    flow = flow.select("shard", "to", (F.col("both") + share).cast("long").alias("grant"))  # shards squared at most
    moves = running_before(wish.join(F.broadcast(flow), ["shard", "to"]), ["shard", "to"], "at", ["group"], "n", "before", bits)
    moves = moves.withColumn("m", F.greatest(F.least("n", F.col("grant") - F.col("before")), F.lit(0))).where("m > 0")
    step = F.explode(F.array(F.struct(F.col("shard").alias("s"), (-F.col("m")).alias("d")), F.struct(F.col("to").alias("s"), F.col("m").alias("d"))))
    moved = moves.select("group", "at", step.alias("x")).select("group", "at", F.col("x.s").alias("shard"), F.col("x.d").alias("n"))
    return state.unionByName(moved).groupBy("group", "at", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def ranked(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Linked rows with ``r``, their number within their group; a group above TASK_ROWS is ranked in salted parts."""
    salted = rows.join(sizes, "group").withColumn("_part", F.pmod(F.col("at"), F.ceil(F.col("c") / TASK_ROWS)).cast("int"))
    big = salted.where(F.col("c") > TASK_ROWS).groupBy("group", "_part").agg(F.count("*").alias("k"))
    earlier = W.partitionBy("group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    big = big.select("group", "_part", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("group", "_part").orderBy("at", "doc_id")
    return salted.join(big, ["group", "_part"], "left").withColumn("r", F.row_number().over(inside) - 1 + F.coalesce("_before", F.lit(0)))


def assign(thin: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """thin (doc_id, group, ...) with ``shard`` and ``slot``; thin should be cheap to read again."""
    total = thin.count()
    bits = range_bits(total, TASK_ROWS)
    rows = thin.withColumn("at", place(F.col("doc_id"), seed="shard"))
    sizes = cut(thin.groupBy("group").agg(F.count("*").alias("c")).where("c > 1"))
    quotas = thin.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(total // shards) + (F.col("id") < total % shards).cast("long")).alias("quota"))
    state = cut(spread(sizes.withColumn("at", place(F.col("group"), seed="group")), shards))
    for _ in range(rounds):
        state = cut(propagate(state, quotas, bits))
    # a group's rows by number: the first n go to its first shard, and so on
    spans = state.withColumn("from", F.sum("n").over(W.partitionBy("group").orderBy("shard")) - F.col("n"))
    spans = spans.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("from", "shard"))).alias("spans"))  # one entry a shard at most
    tied = ranked(rows, sizes).join(spans, "group")
    tied = tied.withColumn("shard", F.element_at(F.filter("spans", lambda x: x["from"] <= F.col("r")), -1)["shard"]).drop("spans", "c", "_part", "_before", "r")
    tied = cut(running_before(tied.withColumn("one", F.lit(1)), ["shard"], "at", ["doc_id"], "one", "slot", bits).drop("one"))
    tied = tied.join(F.broadcast(quotas), "shard")
    held = tied.where("slot < quota").drop("quota")
    # rows that nobody is linked to, and those for whom a shard had no room, fill what is left
    loose = rows.join(sizes.select("group"), "group", "left_anti").unionByName(tied.where("slot >= quota").select(*rows.columns))
    loose = running_before(loose.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), ["all"], "at", ["doc_id"], "one", "n", bits).drop("one", "all")
    used = held.groupBy("shard").agg(F.count("*").alias("used"))
    room = quotas.join(used, "shard", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("room", F.col("quota") - F.col("used"))
    room = room.withColumn("upto", F.sum("room").over(W.orderBy("shard"))).withColumn("from", F.col("upto") - F.col("room"))
    room = F.broadcast(room.where("room > 0").select("shard", "used", "from", "upto"))  # a row a shard at most
    loose = loose.join(room, (loose["n"] >= room["from"]) & (loose["n"] < room["upto"])).withColumn("slot", F.col("used") + F.col("n") - F.col("from"))
    return held.unionByName(loose.select(*held.columns)).drop("at")


def thin_rows(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    group = F.coalesce(F.sha2("text", 256), F.lit("null"))
    return docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), group.alias("group"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = cut(thin_rows(table(spark, sf_dir, "documents")))
    out = assign(thin)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
