"""Pair statistics over time, in batch and as a stream."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prefscale.operators.breaking import full_pairs, weight_of
from prefscale.session import shared_folder, ship


def pair_counts_by_time(rankings: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(start, winner, loser, wins) per event-time window. rankings: (items, ts, weight); the same plan for a stream,
    where rows later than the watermark are dropped and a window is emitted once it can't change any more."""
    rows = rankings.withWatermark("ts", watermark) if watermark else rankings
    rows = rows.select("ts", F.explode(full_pairs(F.col("items"))).alias("p"), weight_of(rankings).alias("weight"))
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = rows.groupBy(span.alias("w"), F.col("p.winner").alias("winner"), F.col("p.loser").alias("loser")).agg(F.sum("weight").alias("wins"))
    return out.select(F.col("w.start").alias("start"), "winner", "loser", "wins")


def kernel_pair_counts(counts: DataFrame, steps: int, h: float) -> DataFrame:
    """(t, winner, loser, wins): counts of all steps, weighted by a Gaussian of their distance over steps x h, cut at 3.
    counts: (t, winner, loser, wins), aggregated before; each row is sent only to the steps within reach."""
    width = steps * h
    reach = int(math.floor(3 * width))
    near = F.explode(F.sequence(F.greatest(F.col("t") - reach, F.lit(0)), F.least(F.col("t") + reach, F.lit(steps - 1))))
    rows = counts.withColumn("to", near)
    z = (F.col("to") - F.col("t")) / F.lit(width)
    k = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return rows.groupBy(F.col("to").alias("t"), "winner", "loser").agg(F.sum(F.col("wins") * k).alias("wins"))


class SmoothedPair(StatefulProcessor):
    """Counts of one pair by step, kept as long as a step that is still open can need them. A step's smoothed count is
    given when the last step within reach has ended."""

    def __init__(self, width: float, reach: int, step_ms: int, origin_ms: int):
        self.width, self.reach, self.step_ms, self.origin_ms = width, reach, step_ms, origin_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wins = handle.getMapState("wins", "t long", "wins double")

    def closes(self, t: int) -> int:
        """The time from which step t can't change any more."""
        return self.origin_ms + (t + self.reach + 1) * self.step_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for batch in rows:
            for t, wins in zip(batch["t"].tolist(), batch["wins"].tolist(), strict=True):
                old = self.wins.getValue((t,))[0] if self.wins.containsKey((t,)) else 0.0
                self.wins.updateValue((t,), (old + wins,))
                timers |= {self.closes(to) for to in range(t - self.reach, t + self.reach + 1)}
        for at in sorted(timers):
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = (expiredTimerInfo.getExpiryTimeInMs() - self.origin_ms) // self.step_ms - 1 - self.reach
        total = 0.0
        for s in range(t - self.reach, t + self.reach + 1):
            if self.wins.containsKey((s,)):
                total += self.wins.getValue((s,))[0] * math.exp(-(((t - s) / self.width) ** 2) / 2) / math.sqrt(2 * math.pi)
        if self.wins.containsKey((t - self.reach,)):
            self.wins.removeKey((t - self.reach,))  # no later step reaches back to it
        yield pd.DataFrame({"t": [t], "winner": [key[0]], "loser": [key[1]], "wins": [total]})

    def close(self) -> None:
        pass


def kernel_pair_counts_stream(rankings: DataFrame, width: float, step: str = "1 day", watermark: str = "1 day", origin: str = "1970-01-01") -> DataFrame:
    """(t, winner, loser, wins) as ``kernel_pair_counts`` has them, from a stream of rankings (ranking_id, ts, items, weight).

    Steps of the length ``step`` (of fixed length: up to days or weeks) are numbered from ``origin`` on, with negative
    numbers before it; a step comes out once, when the watermark has passed the last step that it draws on. Rows later than
    the watermark are dropped, and so are repeats of a ranking_id within it. Pairs are counted per step before they reach
    the state, so a pair's state gets one row a step. Needs the RocksDB state store (``use_rocksdb``)."""
    ship(rankings.sparkSession)
    step_ms, origin_ms = (int(x) for x in rankings.sparkSession.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {step}), unix_millis(to_timestamp('{origin}'))").first())
    reach = int(math.floor(3 * width))
    rows = rankings.withColumn("weight", weight_of(rankings)).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["ranking_id"])
    rows = rows.select("ts", F.explode(full_pairs(F.col("items"))).alias("p"), "weight")
    span = F.window("ts", step, step, f"{origin_ms % step_ms} milliseconds")
    counts = rows.groupBy(span.alias("w"), F.col("p.winner").alias("winner"), F.col("p.loser").alias("loser")).agg(F.sum("weight").alias("wins"))
    t = F.floor((F.unix_millis("w.start") - origin_ms) / step_ms).cast("long")
    counts = counts.select(F.window_time("w").alias("ts"), t.alias("t"), F.col("winner").cast("long"), F.col("loser").cast("long"), "wins")
    return counts.groupBy("winner", "loser").transformWithStateInPandas(SmoothedPair(width, reach, step_ms, origin_ms), "t long, winner long, loser long, wins double", "append", "EventTime")


def use_rocksdb(spark) -> None:
    """States with timers and maps are kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_end(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows that ``stream`` gives for all that its sources hold now, written to ``folder``/out with a checkpoint beside it,
    so that a later run goes on from there; by default a new folder of the shared one."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    use_rocksdb(spark)
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
