"""Files of ratings, ballots, rankings and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscale.operators.prepare import parse_ballots

RATINGS = "user_id long, item_id long, rating double"


def read_ratings(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """user, item and rating of separated lines (``,`` or ``::``); further columns are left out."""
    rows = spark.read.option("enforceSchema", "true").schema(f"{RATINGS}, rest string").csv(path, sep=sep, header=header)
    return rows.select("user_id", "item_id", "rating")


def read_ratings_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item_id long, user_id long, rating double").json(path).select("user_id", "item_id", "rating")


def read_ballots(spark: SparkSession, path: str) -> DataFrame:
    """(ballot_id, votes, items, tied_tail) of preference files: the number n of candidates, n lines of names, one line
    of totals, then a ballot a line. A file is a short list of distinct ballots."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    rows = files.select("file", F.trim(F.col("lines")[0]).cast("int").alias("n"), F.posexplode("lines").alias("pos", "value"))
    rows = rows.where(F.col("pos") > F.col("n") + 1).withColumn("ballot_id", F.concat_ws(":", "file", F.col("pos").cast("string")))
    return parse_ballots(rows, "value", keep=["ballot_id"])


def write_rankings(rankings: DataFrame, path: str) -> None:
    rankings.write.mode("overwrite").parquet(path)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Metrics (dataset, method, k, m, metric, value), a folder a method."""
    results.write.mode("overwrite").partitionBy("method").parquet(path)
