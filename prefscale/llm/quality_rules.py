"""Quality rules: base counts, and a modified Kneser-Ney model of symbols with bands of perplexity per language.

The model is of n-grams of ORDER symbols. A symbol is a code point folded into one of 64 classes (letters without case,
digits, white space, the rest by code), so an n-gram is a number below 64^ORDER, its own perfect hash, and no corpus,
however large, has more than that many: 16.8 million at order 4. That is what proves that the model may be sent to every
task; nothing is pruned, cut off or sampled to get there. All n-grams of all documents are counted by Spark: each task adds
up its own, and only (n-gram, count) is shuffled. Counts of lower orders are continuation counts (of how many symbols
stand before), discounts come from the counts of counts of each order, and the interpolated probabilities are computed
order by order as tables. Each order is kept as a sorted array of hashes beside one of probabilities, and contexts beside
their weights for the order below. A document is scored by binary search for all its n-grams together.

A language's band of bits per symbol is found from a histogram of all its documents. It reaches from the upper quartile
up by WIDEN times the distance of the quartiles (LEAST_BITS at least) and from the lower one down by twice as much; for a
text of fewer than STEADY code points it reaches further, by the root of how many times fewer, as short texts spread more.
A document outside its band is rejected: gibberish and tables above, set phrases and repeated symbols below.

Defined results: null and empty texts have no words, zero counts and no perplexity, and fail the base rules; a null
language is a language of its own; rows are judged one by one, so repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefscale.llm.text import packed
from prefscale.llm.windows import repeated_cover
from prefscale.session import cut, ship, table

#: Symbols are numbers below 2^SYMBOL_BITS; 0 stands before a text and after it.
SYMBOL_BITS, ORDER = 6, 4
#: The base rules of the contract.
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20
MARKS = "#*$%&|<>"
#: Bins of the histogram of bits per symbol, and how far a band goes beyond the quartiles.
BINS_PER_BIT, WIDEN, LEAST_BITS, STEADY = 1000, 4.0, 0.15, 600
#: Discounts of n-grams seen once, twice and more often where the counts of counts don't tell.
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)
#: Symbols that a task gathers before it adds up its n-grams.
TOGETHER = 1 << 21
#: Numbers of a model that travel in one row.
BLOCK = 1 << 16


def symbol_table() -> np.ndarray:
    """The symbol of each code point below 128."""
    c = np.arange(128)
    out = 29 + c % 7
    out[list(range(9, 14)) + [32]] = 1
    out[ord("0") : ord("9") + 1] = 28
    for first in ("a", "A"):
        out[ord(first) : ord(first) + 26] = np.arange(2, 28)
    return out.astype(np.int32)


ASCII = symbol_table()
#: 1: white space, 2: one of MARKS, 0: any other.
KINDS = np.array([1 if c in (*range(9, 14), 32) else 2 if c < 128 and chr(c) in MARKS else 0 for c in range(129)], np.int8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(points: np.ndarray) -> np.ndarray:
    out = ASCII[np.minimum(points, 127)]
    other = np.flatnonzero(points > 127)
    out[other] = 36 + points[other] % 28
    return out


def n_grams(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of each symbol of the texts and of each text's end, one text after another, and how many each text has."""
    ends = np.cumsum([len(t) + order for t in texts])  # order - 1 zeros before, one behind
    row = np.zeros(ends[-1] if len(texts) else 0, np.int32)
    own = np.ones(len(row), bool)
    for t, end in zip(texts, ends.tolist(), strict=True):
        first = end - 1 - len(t)
        row[first : end - 1] = symbols(t)
        own[first - order + 1 : first] = False
    code = row.copy()
    for back in range(1, order):
        code[back:] |= row[: len(row) - back] << (SYMBOL_BITS * back)
    return code[own], np.array([len(t) + 1 for t in texts])


def count_n_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, n): how often each n-gram of the texts occurs. Empty texts have none."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        held, size = [], 0

        def added() -> None:
            nonlocal codes, counts, held, size
            if held:
                more, n = np.unique(n_grams(held, order)[0], return_counts=True)
                both, where = np.unique(np.r_[codes, more], return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, where, np.r_[counts, n])
                codes, counts, held, size = both, total, [], 0

        for batch in batches:
            for text in batch.column("text"):
                points = code_points(text.as_py() or "")
                if len(points):
                    held.append(points)
                    size += len(points)
                if size > TOGETHER:
                    added()
        added()
        for at in range(0, len(codes), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + BLOCK], pa.int64()), pa.array(counts[at : at + BLOCK])], ["code", "n"])

    return docs.select("text").mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """One row (d1, d2, d3): what is taken off counts of one, two, and three or more."""
    n = [F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4)]
    row = counts.agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    told = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    own = [1 - 2 * y * F.col("n2") / F.col("n1"), 2 - 3 * y * F.col("n3") / F.col("n2"), 3 - 4 * y * F.col("n4") / F.col("n3")]
    return row.select(*[F.when(told, F.greatest(F.lit(0.0), d)).otherwise(plain).alias(f"d{i}") for i, (d, plain) in enumerate(zip(own, PLAIN_DISCOUNTS, strict=True), 1)])


def model_tables(counts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order from 1: (code, p) of the n-grams seen, interpolated, and (context, weight) for the order below.

    Tables of at most 64^order rows. The order below the first is even over all symbols.
    """
    levels = [counts]
    for k in range(order - 1, 0, -1):
        levels.insert(0, levels[0].select((F.col("code").bitwiseAND((1 << SYMBOL_BITS * k) - 1)).alias("code")).groupBy("code").agg(F.count("*").alias("n")))
    probabilities, weights = [], []
    for k, level in enumerate(levels, 1):
        level = cut(level)
        rows = level.crossJoin(F.broadcast(discounts(level)))  # one row
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("code", F.shiftright("code", SYMBOL_BITS).alias("context"), "n", off.alias("off"))
        weight = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight"))
        rows = rows.join(weight, "context")
        own = F.greatest(F.col("n") - F.col("off"), F.lit(0.0)) / F.col("total")
        if k == 1:
            p = rows.select("code", (own + F.col("weight") / (1 << SYMBOL_BITS)).alias("p"))
        else:
            below = probabilities[-1].select(F.col("code").alias("lower"), F.col("p").alias("below"))
            mask = (1 << SYMBOL_BITS * (k - 1)) - 1
            p = rows.join(below, rows["code"].bitwiseAND(mask) == F.col("lower")).select("code", (own + F.col("weight") * F.col("below")).alias("p"))
        probabilities.append(cut(p))
        weights.append(weight.select("context", "weight"))
    return probabilities, weights


def packed_arrays(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """A table of the model as sorted arrays: sorted and packed in tasks, put one behind another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, v = b.column(0).to_numpy().astype("<i4"), b.column(1).to_numpy().astype("<f8")
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array([int(k[0])]), pa.array([k.tobytes()]), pa.array([v.tobytes()])], ["first", "k", "v"])

    blocks = rows.select(F.col(key).cast("long"), F.col(value).cast("double")).repartitionByRange(key).sortWithinPartitions(key)
    got = sorted(blocks.mapInArrow(work, "first long, k binary, v binary").collect())  # at most 64^order numbers, see above
    return np.frombuffer(b"".join(r["k"] for r in got), "<i4"), np.frombuffer(b"".join(r["v"] for r in got), "<f8")


@dataclass
class KneserNey:
    """Per order from 1 the sorted n-grams and their log2 probabilities, and sorted contexts and their log2 weights."""

    codes: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the probability of each n-gram's last symbol after the others."""
        out = np.zeros(len(codes))
        rest = np.arange(len(codes))
        for k in range(len(self.codes), 0, -1):
            own = codes[rest] & ((1 << SYMBOL_BITS * k) - 1)
            at = np.searchsorted(self.codes[k - 1], own)
            hit = at < len(self.codes[k - 1])
            hit[hit] = self.codes[k - 1][at[hit]] == own[hit]
            out[rest[hit]] += self.logs[k - 1][at[hit]]
            rest, context = rest[~hit], own[~hit] >> SYMBOL_BITS
            if not len(rest):
                return out
            at = np.searchsorted(self.contexts[k - 1], context)
            hit = at < len(self.contexts[k - 1])
            hit[hit] = self.contexts[k - 1][at[hit]] == context[hit]
            out[rest[hit]] += self.weights[k - 1][at[hit]]  # a context that was never seen leaves all to the order below
        out[rest] -= SYMBOL_BITS
        return out


def train(docs: DataFrame, order: int = ORDER) -> KneserNey:
    """The model of all texts of ``docs``."""
    probabilities, weights = model_tables(count_n_grams(docs, order), order)
    p = [packed_arrays(t, "code", "p") for t in probabilities]
    w = [packed_arrays(t, "context", "weight") for t in weights]
    with np.errstate(divide="ignore"):
        return KneserNey([x[0] for x in p], [np.log2(x[1]) for x in p], [x[0] for x in w], [np.log2(x[1]) for x in w])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str, points: np.ndarray) -> tuple[int, ...]:
    """The numbers that COUNTS names."""
    kinds = KINDS[np.minimum(points, 128)]
    body = text.encode("utf-8", "replace")
    words = body.split()
    seen: set[bytes] = set()
    again = 0
    for line in body.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    spaces, marks = int(np.count_nonzero(kinds == 1)), int(np.count_nonzero(kinds == 2))
    return len(words), len(points) - spaces, marks, again, int(np.count_nonzero(repeated_cover(words, WINDOW)))


def text_bits(model: KneserNey, points: list[np.ndarray]) -> np.ndarray:
    """Minus the summed log2 probabilities of each text's symbols and its end.

    Each text's n-grams are sorted and looked up once, with their number; sorted ones are near one another in the model.
    """
    codes, sizes = n_grams(points, len(model.codes))
    bits = SYMBOL_BITS * len(model.codes)
    rows = np.sort((np.repeat(np.arange(len(points)), sizes) << bits) | codes)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    many = np.diff(np.r_[first, len(rows)])
    logs = model.log2((rows[first] & ((1 << bits) - 1)).astype(np.int32))
    return -np.bincount(rows[first] >> bits, many * logs, len(points))


def with_counts(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc, the columns of COUNTS, chars, bits): each row of ``docs`` packed as ``doc``; bits per symbol, null without text."""
    ship(docs.sparkSession)
    rows = packed(docs, "text").withColumnRenamed("_packed", "doc").select("doc", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 64^order n-grams
    whole = [*COUNTS, "chars"]
    schema = T.StructType([rows.schema["doc"], *[T.StructField(c, T.LongType()) for c in whole], T.StructField("bits", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, points, size = [], [], 0
                while at + len(texts) < batch.num_rows and size < TOGETHER:
                    texts.append(batch.column("text")[at + len(texts)].as_py() or "")
                    points.append(code_points(texts[-1]))
                    size += len(points[-1])
                sizes = np.array([len(p) for p in points])
                bits = [s / (n + 1) if n else None for s, n in zip(text_bits(shared.value, points).tolist(), sizes.tolist(), strict=True)]
                counts = np.array([base_counts(t, p) for t, p in zip(texts, points, strict=True)], np.int64)
                numbers = [pa.array(counts[:, i]) for i in range(len(COUNTS))] + [pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(at, len(texts)), *numbers, pa.array(bits, pa.float64())], schema.names)
                at += len(texts)

    return rows.mapInArrow(work, schema)


def bands(scored: DataFrame, widen: float = WIDEN) -> DataFrame:
    """(lang, low, high, reach) from ``scored`` (lang, bits): the quartiles of bits per symbol, and how far above the upper
    one the band of a long text ends."""
    known = scored.where("bits is not null").select("lang", F.floor(F.col("bits") * BINS_PER_BIT).alias("bin"))
    bins = known.groupBy("lang", "bin").agg(F.count("*").alias("n"))  # as many bins as a language spreads over
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("bin"))
    whole = F.sum("n").over(W.partitionBy("lang"))
    rows = bins.select("lang", "bin", upto.alias("upto"), whole.alias("whole"))
    at = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("whole"), F.col("bin"))) / BINS_PER_BIT  # noqa: E731
    rows = rows.groupBy("lang").agg(at(1).alias("low"), at(3).alias("high"))
    return rows.withColumn("reach", F.greatest(widen * (F.col("high") - F.col("low")), F.lit(LEAST_BITS)))


def judged(scored: DataFrame, widen: float = WIDEN) -> DataFrame:
    """``scored`` with base_failed and kept; it is read twice. Rows without text have no bits and fail by their words."""
    found = bands(scored, widen).withColumnRenamed("lang", "own_lang")
    rows = scored.join(found, F.col("lang").eqNullSafe(F.col("own_lang")), "left").drop("own_lang")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    reach = F.col("reach") * F.sqrt(F.greatest(F.lit(1.0), STEADY / F.greatest("chars", F.lit(1))))
    inside = F.col("bits").isNull() | ((F.col("bits") >= F.col("low") - 2 * reach) & (F.col("bits") <= F.col("high") + reach))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


def perplexity(bits: Column) -> Column:
    return F.pow(F.lit(2.0), bits)


def quality_rules(docs: DataFrame, widen: float = WIDEN) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor their language's band reject."""
    rows = with_counts(docs, train(docs)).withColumn("lang", F.col("doc.lang"))
    return judged(cut(rows), widen).where("kept").select("doc.*")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    scored = with_counts(docs, train(docs)).select("doc.doc_id", "doc.lang", *COUNTS, "chars", "bits")
    rows = judged(cut(scored))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", F.round(perplexity(F.col("bits")), 3).alias("perplexity"))


def level_sql(k: int, order: int) -> str:
    """Tables c{k} of counts, x{k} with discounts, w{k} of contexts and p{k} of probabilities."""
    below = f"(SELECT code, count(*) AS n FROM (SELECT code & {(1 << SYMBOL_BITS * k) - 1} AS code FROM c{k + 1}) GROUP BY code)"
    counts = "(SELECT code, count(*) AS n FROM g GROUP BY code)" if k == order else below
    plain = ", ".join(f"{d}::DOUBLE AS e{i}" for i, d in enumerate(PLAIN_DISCOUNTS, 1))
    lower = f"w.weight / {1 << SYMBOL_BITS}" if k == 1 else f"w.weight * (SELECT p FROM p{k - 1} q WHERE q.code = x.code & {(1 << SYMBOL_BITS * (k - 1)) - 1})"
    return f"""c{k} AS {counts},
m{k} AS (SELECT *, n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 AS told, n1 / (n1 + 2 * n2) AS y, {plain} FROM (
  SELECT {", ".join(f"(count(*) FILTER (n = {i}))::DOUBLE AS n{i}" for i in (1, 2, 3, 4))} FROM c{k})),
x{k} AS (SELECT code, code >> {SYMBOL_BITS} AS context, n,
  CASE WHEN n = 1 THEN CASE WHEN told THEN greatest(0, 1 - 2 * y * n2 / n1) ELSE e1 END
    WHEN n = 2 THEN CASE WHEN told THEN greatest(0, 2 - 3 * y * n3 / n2) ELSE e2 END
    ELSE CASE WHEN told THEN greatest(0, 3 - 4 * y * n4 / n3) ELSE e3 END END AS d FROM c{k}, m{k}),
w{k} AS (SELECT context, sum(n)::DOUBLE AS total, sum(d) / sum(n) AS weight FROM x{k} GROUP BY context),
p{k} AS (SELECT x.code, greatest(x.n - x.d, 0) / w.total + {lower} AS p FROM x{k} x JOIN w{k} w ON x.context = w.context)"""


#: Counts go from the longest n-grams to the shortest, probabilities the other way.
LEVELS_SQL = ",\n".join([x.rpartition(",\np")[0] for x in [level_sql(k, ORDER) for k in range(ORDER, 0, -1)]] + ["p" + level_sql(k, ORDER).rpartition(",\np")[2] for k in range(1, ORDER + 1)])
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, length(coalesce(text, '')) AS chars FROM documents),
u AS (SELECT doc_id, chars, unnest(range(1, chars + 1)) AS i, unnest(string_split(t, '')) AS c FROM d WHERE chars > 0),
s AS (
  SELECT doc_id, i, CASE WHEN v BETWEEN 97 AND 122 THEN v - 95 WHEN v BETWEEN 65 AND 90 THEN v - 63 WHEN v = 32 OR v BETWEEN 9 AND 13 THEN 1
    WHEN v BETWEEN 48 AND 57 THEN 28 WHEN v < 128 THEN 29 + v % 7 ELSE 36 + v % 28 END AS s
  FROM (SELECT doc_id, i, unicode(c) AS v FROM u)
  UNION ALL SELECT doc_id, chars + 1, 0 FROM d WHERE chars > 0),
g AS (
  SELECT doc_id, (s + {" + ".join(f"{1 << SYMBOL_BITS * b} * coalesce(lag(s, {b}) OVER o, 0)" for b in range(1, ORDER))})::BIGINT AS code
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
{LEVELS_SQL},
bits AS (SELECT doc_id, -sum(log2(p)) / count(*) AS bits FROM g JOIN p{ORDER} USING (code) GROUP BY doc_id),
h AS (SELECT lang, floor(bits * {BINS_PER_BIT})::BIGINT AS bin, count(*) AS n FROM d JOIN bits USING (doc_id) GROUP BY 1, 2),
f AS (SELECT lang, bin, sum(n) OVER (PARTITION BY lang ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang) AS whole FROM h),
q AS (SELECT lang, min(bin) FILTER (4 * upto >= whole) / {BINS_PER_BIT}::DOUBLE AS low, min(bin) FILTER (4 * upto >= 3 * whole) / {BINS_PER_BIT}::DOUBLE AS high FROM f GROUP BY lang),
r AS (SELECT *, greatest({WIDEN} * (high - low), {LEAST_BITS})::DOUBLE AS reach FROM q),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-]')),
again AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n FROM l GROUP BY doc_id),
wd AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^ 	-]+') AS w FROM d)),
win AS (SELECT doc_id, i, string_agg(w, ' ') OVER x AS g, count(*) OVER x AS k FROM wd WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
rep AS (SELECT doc_id, unnest(list(i)) AS i FROM win WHERE k = {WINDOW} GROUP BY doc_id, g HAVING count(*) > 1),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range({WINDOW}) z(j) GROUP BY doc_id),
b AS (
  SELECT doc_id, d.lang, chars, len(regexp_extract_all(t, '[^ 	-]+')) AS n_words, length(regexp_replace(t, '[ 	-]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(again.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, bits
  FROM d LEFT JOIN again USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN bits USING (doc_id)),
j AS (
  SELECT b.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed, low, high,
    reach * sqrt(greatest(1, {STEADY} / greatest(chars, 1)::DOUBLE)) AS reach
  FROM b LEFT JOIN r ON b.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (bits IS NULL OR (bits >= low - 2 * reach AND bits <= high + reach)) AS kept, round(pow(2, bits), 3) AS perplexity
FROM j
"""
