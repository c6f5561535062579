"""Periodic runs of words, by Kolpakov and Kucherov's method.

A run is a stretch of words with smallest period q, at least MIN_WORDS long and MIN_POWER periods long, that no
neighbouring word extends. Per text: the factors of its Lempel-Ziv factorisation come from a suffix automaton of the
words, whose states know where their substrings first end. A run that crosses or touches a factor's border is found from
there by Main's algorithm: longest common extensions to both sides of the border, by Z-functions over the factor and
twice the one before, which is as far as such a run can reach. A run that lies strictly inside a factor is a shifted copy
of one inside the factor's earlier occurrence, and is copied from there.

Where no window of MIN_WORDS * (MIN_POWER - 1) / MIN_POWER words occurs twice there can't be a run: each of its windows of
that size is its neighbour a period on or back. So a text is first cut into the stretches that such repeated windows
cover; each run lies, with all its words, in one of these, and they alone are factorised.

A text is one row, and all of it is read in one task: nothing is shuffled, and memory is bounded by the longest text.

Defined results: null and empty texts have no words and no runs; rows are independent of one another, so repeated rows
give repeated results; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefscale.llm.text import packed, unpacked
from prefscale.llm.windows import numbered, repeated_cover, words_of
from prefscale.session import ship, table

MIN_WORDS, MIN_POWER = 24, 3
#: Rows that are worked on together.
SLICE = 256

Run = tuple[int, int, int]


class SuffixAutomaton:
    """All substrings of a sequence; ``first`` has the place where a state's substrings first end."""

    def __init__(self, word: list[int]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(word):
            new = self.add(self.size[last] + 1, {}, i)
            at = last
            while at >= 0 and c not in self.step[at]:
                self.step[at][c] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
            else:
                to = self.step[at][c]
                if self.size[to] == self.size[at] + 1:
                    self.link[new] = to
                else:  # the shorter substrings of ``to`` get a state of their own
                    part = self.add(self.size[at] + 1, dict(self.step[to]), self.first[to])
                    self.link[part], self.link[to], self.link[new] = self.link[to], part, part
                    while at >= 0 and self.step[at].get(c) == to:
                        self.step[at][c] = part
                        at = self.link[at]
            last = new

    def add(self, size: int, step: dict[int, int], first: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.first.append(first)
        self.link.append(-1)
        return len(self.step) - 1


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors (start, length, start of an earlier occurrence, which may overlap; -1 for a new word)."""
    known = SuffixAutomaton(word)
    out, i, n = [], 0, len(word)
    while i < n:
        state = size = 0
        while i + size < n:
            to = known.step[state][word[i + size]]
            if known.first[to] - size >= i:  # first occurs here
                break
            state, size = to, size + 1
        out.append((i, max(size, 1), known.first[state] - size + 1 if size else -1))
        i += max(size, 1)
    return out


def z_function(s: list[int]) -> np.ndarray:
    """At each place the length of the longest common prefix of ``s`` and what follows there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, np.int64)


def crossing(word: list[int], low: int, b: int, high: int, min_words: int, power: int) -> Iterator[Run]:
    """Runs (start, end, period) within [low, high) that cross or touch the border before ``b``, perhaps with multiples of
    their period, and some that the window cuts off."""
    t, v = word[low:b], word[b:high]
    whole, a, c = t + v, len(t), len(v)
    back = t[::-1]

    def fitting(periods: np.ndarray, left: np.ndarray, right: np.ndarray, shift: int) -> Iterator[Run]:
        long = left + right + periods
        good = (long >= min_words) & (long >= power * periods)
        for p, x, y in zip(periods[good].tolist(), left[good].tolist(), right[good].tolist(), strict=True):
            yield b - x - (p if shift else 0), b + y + (0 if shift else p), p

    if c:  # a period to the right of the border: what v shares with itself p on, and t with what ends p on
        p = np.arange(1, c + 1)
        on = np.r_[z_function(v)[1:], 0]
        before = z_function(back + [-1] + whole[::-1])[a + 1 :][c - p] if a else np.zeros(c, np.int64)
        yield from fitting(p, before, on, 0)
    if a:  # a period to the left: mirrored
        p = np.arange(1, a + 1)
        before = np.r_[z_function(back)[1:], 0]
        on = z_function(v + [-1] + whole)[c + 1 :][a - p] if c else np.zeros(a, np.int64)
        yield from fitting(p, before, on, 1)


def runs_of(word: list[int], min_words: int = MIN_WORDS, power: int = MIN_POWER) -> list[Run]:
    """All runs (start, length, period) of a sequence of numbers, by start, then period."""
    n = len(word)
    parts = factors(word)
    found: dict[tuple[int, int], int] = {}
    starting: dict[int, list[tuple[int, int]]] = {}

    def put(s: int, e: int, p: int) -> None:
        known = found.get((s, e))
        if known is None:
            starting.setdefault(s, []).append((e, p))
        if known is None or p < known:
            found[s, e] = p

    for i in range(1, len(parts) + 1):
        b = parts[i][0] if i < len(parts) else n
        size, before = parts[i][1] if i < len(parts) else 0, parts[i - 1][1]
        low, high = max(0, b - 2 * before - size - 1), b + size
        if high - low >= min_words:
            for s, e, p in crossing(word, low, b, high, min_words, power):
                if (s == 0 or word[s - 1] != word[s - 1 + p]) and (e == n or word[e] != word[e - p]):
                    put(s, e, p)
        if i < len(parts) and parts[i][2] >= 0 and size >= min_words:
            source = parts[i][2]
            shift, end = b - source, source + size
            for s in range(source + 1, end):
                for e, _ in starting.get(s, ()):
                    if e < end:
                        put(s + shift, e + shift, found[s, e])
    return sorted((s, e - s, p) for (s, e), p in found.items())


def text_runs(words: list[bytes], min_words: int = MIN_WORDS, power: int = MIN_POWER) -> list[Run]:
    """All runs (start, length, period) of a text's words, by start, then period."""
    cover = repeated_cover(words, -(-min_words * (power - 1) // power))
    edges = np.flatnonzero(np.diff(np.r_[False, cover, False].astype(np.int8)))
    out = []
    for a, b in edges.reshape(-1, 2).tolist():
        if b - a >= min_words:
            out += [(s + a, length, p) for s, length, p in runs_of(numbered(words[a:b]).tolist(), min_words, power)]
    return out


def without_runs(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        drop[s + p] += 1
        drop[s + length] -= 1
    gone = np.cumsum(drop) > 0
    return [w for w, g in zip(words, gone, strict=False) if not g]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods; of equal ones the first, then the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(docs: DataFrame, min_words: int = MIN_WORDS, power: int = MIN_POWER, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc, runs, collapsed): each row of ``docs`` packed as ``doc``, the runs (start, length, period) of its text's words,
    and the words that are left without the runs' repeats, joined by spaces. change: what is done to a row's words before,
    from its doc_id."""
    ship(docs.sparkSession)
    if min_words < 2 or power < 2:
        raise ValueError("runs have at least two words and two periods")
    rows = packed(docs).withColumnRenamed("_packed", "doc")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*rows.schema.fields, T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                doc = some.column("doc")
                runs, texts = [], []
                for key, text in zip(doc.field("doc_id").to_pylist(), doc.field("text"), strict=True):
                    words = words_of(text.as_py())
                    if change is not None:
                        words = change(key, words)
                    own = text_runs(words, min_words, power)
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                    texts.append(b" ".join(without_runs(words, own)).decode())
                yield pa.RecordBatch.from_arrays([doc, pa.array(runs, RUNS), pa.array(texts, pa.string())], ["doc", "runs", "collapsed"])

    return rows.mapInArrow(work, schema)


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, power: int = MIN_POWER) -> DataFrame:
    """``docs`` with texts that have lost the repeats of their runs. Texts without a run stay as they are, white space
    included."""
    rows = with_runs(docs, min_words, power)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("doc.text"))
    return unpacked(rows.select(F.col("doc").withField("text", text).alias("_packed")))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change: in a tenth of the documents, by hash, the words from some place on repeat a few."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column("doc").field("doc_id").to_pylist()
            for key, runs, text in zip(ids, batch.column("runs").to_pylist(), batch.column("collapsed"), strict=True):
                own = [(r["start"], r["length"], r["period"]) for r in runs]
                best = strongest(own)
                named = "".join("%d,%d,%d\n" % r for r in own).encode()
                one = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                out.append((key, len(own), *one, hashlib.sha256(named).hexdigest(), hashlib.sha256(text.as_py().encode()).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_runs(docs, change=planted).mapInArrow(digest, DIGEST)


#: A byte's eight steps of the checksum of reflected polynomial 0xEDB88320.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda c, z: list_reduce(list_prepend(xor(c, z), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32} AS h FROM documents),
s AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, h // 10 AS g,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a
  FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM s),
c AS (
  SELECT doc_id, i, w[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % p ELSE i END] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
k AS (
  SELECT doc_id, i, hash(doc_id, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS g FROM c),
often AS (SELECT g FROM k GROUP BY g HAVING count(*) > 1),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM (SELECT * FROM k WHERE g IN (SELECT g FROM often)) x
  JOIN k y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
wide AS (SELECT DISTINCT doc_id, q, i + j AS i FROM pairs, range(16) z(j)),
same AS (
  SELECT wide.doc_id, q, wide.i FROM wide
  JOIN c a ON a.doc_id = wide.doc_id AND a.i = wide.i JOIN c b ON b.doc_id = wide.doc_id AND b.i = wide.i + q AND a.w = b.w),
isle AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS spot FROM same) GROUP BY doc_id, q, spot),
run AS (SELECT doc_id, start, length, min(q) AS period FROM isle WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM run),
named AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
left_over AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM c ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(named.n, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(named.t, '')) AS runs_sha256, sha256(coalesce(left_over.t, '')) AS collapsed_sha256
FROM d LEFT JOIN named USING (doc_id) LEFT JOIN best ON best.doc_id = d.doc_id AND best.place = 1 LEFT JOIN left_over ON left_over.doc_id = d.doc_id
"""
