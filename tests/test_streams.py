"""The stream of smoothed counts against the batch, with late and repeated rows and a restart."""

import random

from pyspark.sql import functions as F

from prefscale.streaming import timed

WIDTH, REACH = 0.9, 2  # 3 x 0.9, cut


def rankings(seed, days, repeat=True):
    """(ranking_id, ts, items, weight), days in order; ids are repeated on the same day."""
    rng, out = random.Random(seed), []
    for day in days:
        for i in range(6):
            items = rng.sample(range(4), rng.choice([1, 2, 3, 4]))
            row = (f"{day}:{i}", f"2024-01-{day + 1:02d} {rng.randrange(24):02d}:00:00", items, float(rng.choice([1, 2])))
            out += [row, row] if repeat and i == 0 else [row]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "ranking_id string, ts string, items array<int>, weight double").withColumn("ts", F.to_timestamp("ts")).coalesce(1)


def batch_of(spark, rows):
    counts = timed.pair_counts_by_time(frame(spark, sorted(set((a, b, tuple(c), d) for a, b, c, d in rows))))
    counts = counts.select(F.date_diff("start", F.lit("2024-01-01")).alias("t"), "winner", "loser", "wins")
    steps = 40
    return {(r["t"], r["winner"], r["loser"]): round(r["wins"], 9) for r in timed.kernel_pair_counts(counts, steps, WIDTH / steps).collect()}


def test_smoothed_stream_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "job")
    first, second = rankings(1, range(0, 8)), rankings(2, range(8, 15))
    late = [("late", "2024-01-02 03:00:00", [3, 2, 1, 0], 50.0)]  # a week behind the watermark when it comes
    again = [first[-1]]  # a repeat that comes in the second run

    def run():
        stream = spark.readStream.schema(frame(spark, first).schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = timed.kernel_pair_counts_stream(stream, WIDTH, "1 day", "1 day", "2024-01-01")
        rows = [(r["t"], r["winner"], r["loser"], round(r["wins"], 9)) for r in timed.run_to_end(out, target).collect()]
        assert len({r[:3] for r in rows}) == len(rows)  # each step once
        return {r[:3]: r[3] for r in rows}

    frame(spark, first).write.mode("append").parquet(source)
    before = run()
    frame(spark, again + second).write.mode("append").parquet(source)
    run()
    frame(spark, late).write.mode("append").parquet(source)
    after = run()  # from the checkpoint, twice
    last = max(r[1] for r in second)
    want = batch_of(spark, first + second)
    # the watermark is a day behind the last row, so the steps up to the day before that are over
    closed = int(last[8:10]) - 1 - 1 - 1 - REACH
    assert {k: v for k, v in after.items() if k[0] >= 0} == {k: v for k, v in want.items() if k[0] <= closed}
    assert before == {k: v for k, v in after.items() if k in before} and 0 < len(before) < len(after)


def test_empty_stream(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(tmp_path / "in"))
    assert timed.run_to_end(timed.kernel_pair_counts_stream(stream, WIDTH), str(tmp_path / "job")).count() == 0
