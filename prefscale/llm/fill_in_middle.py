"""Fill-in-the-middle by an index of distinct texts.

A text is a sequence of units (here lines), and a document's cut is two of their borders, chosen by a hash of its doc_id.
Where the units of a text end is the same for all its copies, so it is kept once per distinct text, as an Elias-Fano list:
the low bits of the ends packed, the high bits in unary, some two bits a unit and the logarithm of a unit's mean length.

1. Each map task groups its own texts by content (texts of the same hash are compared) and makes the list of each once; the
   tasks' lists meet by hash, and one of each text is left. Texts don't leave their task, only the short lists do.
2. Thin rows (doc_id, hash) are joined with the index, so a text with very many copies is a hot key only of these, which
   Spark splits, and each row selects its two ends from the list.
3. The cuts are joined back to the documents by doc_id and hash, where no key is hot, as a hashed build side: texts are
   shuffled once and never sorted. A cut is used only if its ends are ends of units of this very text with the right number
   of units before them, else the text's own list is made; so it never matters if two texts have one hash.

Defined results: a null text counts as empty; an empty text, or one that holds a mark itself, stays plain; a null doc_id is
hashed as the empty string; rows that repeat doc_id and text are cut alike.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscale.llm.text import packed
from prefscale.session import ship, table

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: The contract of the query: all texts that can be are cut, half of them with the suffix first.
SEED, CUT_PERCENT, SUFFIX_FIRST_PERCENT = "7", 100, 50
#: Characters of texts that a map task holds to compare others with.
HELD_CHARS = 16 << 20
#: Texts that are worked on together.
SLICE = 256


def line_ends(text: str) -> np.ndarray:
    """Where each line ends, its line feed included, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    return ends if not len(points) or (len(ends) and ends[-1] == len(points)) else np.r_[ends, len(points)]


def elias_fano(ends: np.ndarray) -> bytes:
    """A rising list of numbers."""
    n = len(ends)
    if not n:
        return struct.pack("<qB", 0, 0)
    low = max(0, int(ends[-1] // n).bit_length() - 1)
    bits = ((ends[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    high = np.zeros(int(ends[-1] >> low) + n, np.uint8)
    high[(ends >> low) + np.arange(n)] = 1
    return struct.pack("<qB", n, low) + np.packbits(bits.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(listed: bytes, i: int) -> int:
    """The i-th number of the list, from 0: place of the i-th set bit of the high part, and its low bits."""
    n, low = struct.unpack_from("<qB", listed)
    if not 0 <= i < n:
        raise IndexError(i)
    data = np.frombuffer(listed, np.uint8)[9:]
    cut = (n * low + 7) // 8
    upto = np.cumsum(np.bitwise_count(data[cut:]), dtype=np.int64)
    at = int(np.searchsorted(upto, i, side="right"))
    before = int(upto[at - 1]) if at else 0
    place = 8 * at + int(np.flatnonzero(np.unpackbits(data[cut + at], bitorder="little"))[i - before])
    first = i * low
    window = np.unpackbits(data[first // 8 : (first + low + 7) // 8], bitorder="little")[first % 8 :][:low]
    return ((place - i) << low) + int(window @ (1 << np.arange(low, dtype=np.int64)))


def can_be_cut(text: str) -> bool:
    return bool(text) and not any(m in text for m in MARKS)


INDEX = "text_key binary, n_units long, cuttable boolean, ends binary"


def text_index(texts: DataFrame) -> DataFrame:
    """texts (text_key, text) -> (text_key, n_units, cuttable, ends), a row for each distinct text."""
    ship(texts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, str] = {}
        size = 0
        for batch in batches:
            new = []
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text"), strict=True):
                body = text.as_py()
                if held.get(key) == body:
                    continue
                if size + len(body) > HELD_CHARS:
                    held, size = {}, 0
                held[key] = body
                size += len(body)
                ends = line_ends(body)
                new.append((key, len(ends), can_be_cut(body), elias_fano(ends)))
            if new:
                columns = zip(*new, strict=True)
                kinds = (pa.binary(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["text_key", "n_units", "cuttable", "ends"])

    rows = texts.mapInArrow(work, INDEX)
    return rows.groupBy("text_key").agg(F.min(F.struct("n_units", "cuttable", "ends")).alias("x")).select("text_key", "x.*")


def draws(key: str, seed: str) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def chosen(key: str, n: int, seed: str, cut_percent: int, suffix_first: int) -> tuple[str, int, int]:
    """(form, units of the prefix, units before the suffix) of a text that can be cut."""
    a, b, c, d = draws(key, seed)
    if c % 100 >= cut_percent:
        return "plain", 0, 0
    a, b = a % (n + 1), b % (n + 1)
    return "spm" if d % 100 < suffix_first else "psm", min(a, b), max(a, b)


CUT = "form string, first long, second long, from long, upto long"


def seeded_cuts(thin: DataFrame, index: DataFrame, seed: str, cut_percent: int, suffix_first: int) -> DataFrame:
    """thin (doc_key, text_key) -> with n_units and ``cut``: the form, the units before both borders, and where these lie."""

    @F.pandas_udf(CUT)
    def cut(keys: pd.Series, n: pd.Series, cuttable: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for key, units, can, listed in zip(keys, n, cuttable, ends, strict=True):
            form, i, j = chosen(key, units, seed, cut_percent, suffix_first) if can else ("plain", 0, 0)
            out.append((form, i, j, select(listed, i - 1) if i else 0, select(listed, j - 1) if j else 0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CUT.split(", ")])

    rows = thin.distinct().join(index, "text_key")
    return rows.select("doc_key", "text_key", "n_units", cut("doc_key", "n_units", "cuttable", "ends").alias("cut"))


def put_together(text: str, form: str, i: int, j: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text from an output and its form. No part holds a mark, so each mark is where it first stands."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX) :].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX) :].partition(PREFIX)
    return prefix + middle + suffix


def fits(text: str, n: int, units: int, at: int) -> bool:
    """Whether ``at`` is the end of the first ``units`` of the text's ``n`` lines."""
    if units in (0, n):
        return at == (len(text) if units else 0)
    return 0 < at <= len(text) and text[at - 1] == "\n" and text.count("\n", 0, at) == units


MADE = "fim_text string, form string, prefix_chars long, middle_chars long, n_units long"


def fill_in_middle(docs: DataFrame, seed: str = SEED, cut_percent: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """(doc, fim): each row of ``docs`` packed as ``doc``, and ``fim`` (fim_text, form, prefix_chars, middle_chars, n_units):
    the text with marks, ``psm``, ``spm`` or ``plain``, and the code points of two parts (null if plain)."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = packed(docs).withColumnRenamed("_packed", "doc")
    rows = rows.select("doc", F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")).alias("doc_key"), F.unhex(F.sha2(F.coalesce("doc.text", F.lit("")), 256)).alias("text_key"))
    thin = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    index = text_index(docs.select(F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text")))
    cuts = seeded_cuts(thin, index, seed, cut_percent, suffix_first)

    @F.pandas_udf(MADE)
    def made(texts: pd.Series, keys: pd.Series, n: pd.Series, cut: pd.DataFrame) -> pd.DataFrame:
        out = []
        for body, key, units, form, i, j, a, b in zip(texts, keys, n, *[cut[c] for c in cut.columns], strict=True):
            own = body.count("\n") + (body[-1:] not in ("", "\n"))
            want = chosen(key, own, seed, cut_percent, suffix_first) if can_be_cut(body) else ("plain", 0, 0)
            if (units, form, i, j) != (own, *want) or not (fits(body, own, i, a) and fits(body, own, j, b)):
                ends, units, (form, i, j) = line_ends(body), own, want  # another text's list
                a, b = int(ends[i - 1]) if i else 0, int(ends[j - 1]) if j else 0
            parts = (None, None) if form == "plain" else (a, b - a)
            out.append((put_together(body, form, a, b), form, *parts, units))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MADE.split(", ")]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    both = rows.join(cuts.hint("shuffle_hash"), ["doc_key", "text_key"])
    return both.select("doc", made(F.coalesce("doc.text", F.lit("")), "doc_key", "n_units", "cut").alias("fim"))


def restore(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from ``fim_text`` and ``form``."""
    return F.pandas_udf(lambda texts, forms: pd.Series([restored(t, f) for t, f in zip(texts, forms, strict=True)], dtype=object), "string")(output, form)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = made.select("doc.doc_id", F.col("fim.n_units").alias("n"), "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.fim_text", 256).alias("output_sha256"), restore(F.col("fim.fim_text"), F.col("fim.form")).alias("again"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("again", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
g AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM g),
p AS (
  SELECT *, coalesce(array_to_string(u[1:i], ''), '') AS a, coalesce(array_to_string(u[i + 1:j], ''), '') AS b, coalesce(array_to_string(u[j + 1:], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
