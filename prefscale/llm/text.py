"""Column expressions on texts that several operators share."""

from __future__ import annotations

import ctypes
import functools
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word: a longest run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
HASH_BITS = 60


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches, after which the memory that it has freed goes back to the system. Spark's Python workers
    live on from stage to stage, so what one holds for nothing is missing to the next."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(*parts: Column, seed: str) -> Column:
    """A hash-random place in [0, 2^60), the same in every run and in every engine that has md5."""
    whole = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("long")


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns of ``docs`` beside the whole row as ``_packed``, so that names that an operator makes clash with none."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_packed"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_packed.*")


def range_bits(rows: int, per_range: int) -> int:
    """How many leading bits of a place name a range that holds about ``per_range`` rows."""
    return max(0, min(24, (max(1, rows) // max(1, per_range)).bit_length()))


def running_before(df: DataFrame, keys: list[str], at: str, ties: list[str], value: str, out: str, bits: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows that come before by (``at``, ``ties``) among those of the same ``keys``.

    A distributed prefix sum: equal ranges of the hash-random column ``at`` are summed, the sums are accumulated over
    the ranges (a table of keys x ranges), and only within a range rows are sorted. No task holds more than one range,
    however many rows one key has. ``keys`` must not be null.
    """
    spot = "_range"
    rows = df.withColumn(spot, F.shiftright(F.col(at), HASH_BITS - bits).cast("int") if bits else F.lit(0))
    inside = W.partitionBy(*keys, spot).orderBy(at, *ties).rowsBetween(W.unboundedPreceding, -1)
    if not bits:
        return rows.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0))).drop(spot)
    sums = rows.groupBy(*keys, spot).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy(spot).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, spot, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    joined = rows.join(sums, [*keys, spot])
    return joined.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("_before")).drop(spot, "_before")
