"""Reversible line dedup: sharded cuckoo filters before exact reference-count tables.

The index has three tables. ``postings`` (kh, doc_id) says which document holds which line key, ``refs`` (shard, kh,
n_docs, max_doc) counts the documents of each key exactly, and ``filters`` has one cuckoo filter per shard with the
fingerprint of every key in ``refs``. A batch of documents is inserted by counting its keys, asking the filters, and
looking up only those keys that a filter may know; keys that a filter doesn't know, most of them in prose, are appended
without a join against the counts. Deleting documents takes their postings away, lowers the counts, and takes keys that
nobody holds any more out of the filters. Filters never decide a result: all counts are exact.

Defined results: a document is a doc_id; rows that repeat one are one document with the lines of all of them. Rows
without a doc_id hold no counted lines and lose none. A null or empty text is one empty line. Lines of shorter keys stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscale.llm.text import ascii_lower, packed, range_bits
from prefscale.session import cut, ship, table

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 250_000
BLANKS = " \t\n\x0b\x0c\r"
SLOTS = 4
LOAD = 0.85
KICKS = 400


class Full(Exception):
    """A filter has no room for a fingerprint."""


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; keys are rows of two 64-bit halves of a hash."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(16, int(keys / (LOAD * SLOTS)) + 1)
        return cls(1 << (need - 1).bit_length())

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        slots = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(slots), slots)

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def used(self) -> int:
        return int(np.count_nonzero(self.slots))

    def room(self) -> int:
        return int(self.buckets * SLOTS * LOAD) - self.used()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ ((mark.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(keys)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> None:
        mark, at, _ = self.places(keys)
        for turn in range(KICKS):
            if not len(mark):
                return
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            used = (self.slots[at] != 0).sum(1)
            fits = rank + used < SLOTS
            self.slots[at[fits], (used + rank)[fits]] = mark[fits]
            mark, at, rank = mark[~fits], at[~fits], rank[~fits]
            if turn and len(mark):  # one fingerprint a full bucket puts another one out
                head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                spot = (turn + at[head]) % SLOTS
                out = self.slots[at[head], spot].copy()
                self.slots[at[head], spot] = mark[head]
                mark[head] = out
            at = self.other(at, mark)
        if len(mark):
            raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint a key; the keys must have been inserted."""
        for mark, a, b in zip(*self.places(keys), strict=True):
            for at in (a, b):
                spot = np.flatnonzero(self.slots[at] == mark)
                if len(spot):
                    left = np.delete(self.slots[at], spot[0])
                    self.slots[at] = np.r_[left, np.zeros(1, np.uint16)]
                    break


def halves(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(kh, doc_id): the hashes of the line keys of each document that are long enough, each once."""
    keys = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    rows = docs.where("doc_id is not null").select(F.explode(F.array_distinct(F.transform(keys, key_hash))).alias("kh"), "doc_id")
    return rows.distinct()


def shard_of(shards: int) -> Column:
    return F.pmod(F.hash("kh"), F.lit(shards)).alias("shard")


@dataclass
class LineIndex:
    """Which lines are held by which documents; every method returns a new index."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, shards: int) -> LineIndex:
        ship(spark)
        return cls(
            spark.createDataFrame([], "kh binary, doc_id long"),
            spark.createDataFrame([], "shard int, kh binary, n_docs long, max_doc long"),
            spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("blob")),
            shards,
        )

    def insert(self, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
        """Adds documents. What the index holds of them already counts once, so a batch may be inserted again."""
        return self.insert_keys(cut(line_keys(docs, min_chars).join(self.postings, ["kh", "doc_id"], "left_anti")))

    def insert_keys(self, fresh: DataFrame) -> LineIndex:
        """Adds rows (kh, doc_id) that the index doesn't hold, each once."""
        batch = fresh.groupBy("kh").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        batch = batch.select(shard_of(self.shards), "kh", "n_docs", "max_doc")
        asked = cut(self._by_shard(batch, asks, "shard int, kh binary, n_docs long, max_doc long, known boolean"))
        maybe = asked.where("known").drop("known")
        unseen = maybe.join(self.refs.select("kh"), "kh", "left_anti").select(*batch.columns)
        added = asked.where("not known").drop("known").unionByName(unseen)
        more = maybe.select("kh", F.col("n_docs").alias("n"), F.col("max_doc").alias("m"))
        counted = self.refs.join(more, "kh", "left").select("shard", "kh", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "m").alias("max_doc"))
        refs = cut(counted.unionByName(added))
        filters = cut(self._by_shard(added.select("shard", "kh"), puts_in, "shard int, blob binary"))
        return LineIndex(self.postings.unionByName(fresh), refs, self._rebuilt(filters, refs), self.shards)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Takes documents (column doc_id) out again."""
        gone = doc_ids.select("doc_id").distinct()
        lost = self.postings.join(gone, "doc_id", "left_semi").groupBy("kh").agg(F.count("*").alias("n"))
        left = cut(self.postings.join(gone, "doc_id", "left_anti").select("kh", "doc_id"))
        lost = cut(lost)
        again = left.join(lost.select("kh"), "kh", "left_semi").groupBy("kh").agg(F.max("doc_id").alias("m"))
        now = self.refs.join(lost, "kh", "left").join(again, "kh", "left")
        now = cut(now.select("shard", "kh", (F.col("n_docs") - F.coalesce("n", F.lit(0))).alias("n_docs"), F.when(F.col("n").isNull(), F.col("max_doc")).otherwise(F.col("m")).alias("max_doc")))
        filters = cut(self._by_shard(now.where("n_docs = 0").select("shard", "kh"), takes_out, "shard int, blob binary"))
        return LineIndex(left, now.where("n_docs > 0"), filters, self.shards)

    def _by_shard(self, rows: DataFrame, work, schema: str) -> DataFrame:
        return self.filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(work, schema)

    def _rebuilt(self, filters: DataFrame, refs: DataFrame) -> DataFrame:
        """``filters``, those that were full (null) built anew, twice as large, from the exact table."""
        full = filters.where("blob is null").select("shard")
        built = refs.join(full, "shard", "left_semi").select("shard", "kh").groupBy("shard").applyInPandas(builds, "shard int, blob binary")
        whole = filters.where("blob is not null").unionByName(built)
        empty = filters.select("shard").join(whole.select("shard"), "shard", "left_anti").withColumn("blob", F.lit(None).cast("binary"))
        return cut(whole.unionByName(empty))

    def doomed(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, keys): the lines that each document loses."""
        hot = self.refs.where(F.col("n_docs") >= min_docs).select("kh", "max_doc")
        rows = self.postings.join(hot, "kh").where("doc_id < max_doc")
        return rows.groupBy("doc_id").agg(F.collect_set("kh").alias("keys"))  # at most a document's own lines


def asks(held: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    blob = held["blob"].iloc[0] if len(held) else None
    known = np.zeros(len(batch), bool) if blob is None or not len(batch) else CuckooFilter.load(blob).contains(halves(batch["kh"]))
    return batch.assign(known=known)


def puts_in(held: pd.DataFrame, added: pd.DataFrame) -> pd.DataFrame:
    blob = held["blob"].iloc[0]
    if len(added):
        known = CuckooFilter.sized(2 * len(added)) if blob is None else CuckooFilter.load(blob)
        blob = None  # full: to be built anew
        if known.room() >= len(added):
            try:
                known.insert(halves(added["kh"]))
                blob = known.dump()
            except Full:
                pass
    return pd.DataFrame({"shard": held["shard"].iloc[:1], "blob": [blob]})


def takes_out(held: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    blob = held["blob"].iloc[0]
    if len(gone) and blob is not None:
        known = CuckooFilter.load(blob)
        known.delete(halves(gone["kh"]))
        blob = known.dump()
    return pd.DataFrame({"shard": held["shard"].iloc[:1], "blob": [blob]})


def builds(rows: pd.DataFrame) -> pd.DataFrame:
    keys, size = halves(rows["kh"]), 2 * len(rows)
    while True:
        known = CuckooFilter.sized(size)
        try:
            known.insert(keys)
        except Full:
            size *= 2
            continue
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "blob": [known.dump()]})


def without_lines(docs: DataFrame, doomed: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text; other columns stay, those of the same names are replaced."""
    made = ("n_lines", "n_dropped", "kept_text")
    rows = packed(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made]), "doc_id", "text").join(doomed, "doc_id", "left")
    whole = lines_of(F.col("text"))
    stays = F.filter(whole, lambda x: ~F.array_contains(F.col("keys"), key_hash(line_key(x))))
    rows = rows.withColumn("_lines", F.when(F.col("keys").isNotNull(), stays))
    n = F.size(whole).cast("long")
    rows = rows.withColumn("n_lines", n).withColumn("n_dropped", F.when(F.col("keys").isNull(), F.lit(0)).otherwise(n - F.size("_lines")).cast("long"))
    rows = rows.withColumn("kept_text", F.when(F.col("keys").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("_lines", "\n")))
    return rows.select("_packed", *made).select("_packed.*", *made)


def build_index(docs: DataFrame, batches: int = 2) -> LineIndex:
    """An index of ``docs``, inserted in batches by doc_id."""
    keys = cut(line_keys(docs))
    shards = 1 << range_bits(keys.count(), SHARD_KEYS)
    index = LineIndex.empty(docs.sparkSession, shards)
    for b in range(batches):
        index = index.insert_keys(keys.where(F.pmod(F.hash("doc_id"), F.lit(batches)) == b))
    return index


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_lines(docs, build_index(docs).doomed())
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
h AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, h.last IS NOT NULL AND doc_id <> h.last AS dropped FROM k LEFT JOIN h ON k.k = h.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
