"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are counts over its whole UTF-8 bytes, words and lines. Each feature is cut into bins; boosting goes
round the features, each time growing a shallow tree over one feature's bins (then over pairs of features) and adding
its leaves to that feature's lookup table. A score is the logistic function of a sum of table entries, so whole batches
are scored by adding looked-up columns.

The model is fitted on the driver on a bounded sample: at most ``max_labelled`` labelled documents, those with the
smallest md5 of their doc_id. Everything else runs over all rows.

Defined results: null and empty texts have all features 0 and get a score like any other; a null doc_id counts as the
text '' for the folds; without labelled rows every score is 0.5; rows that repeat a doc_id are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefscale.llm.text import giving_back, packed, unpacked
from prefscale.session import ship, table

MAX_LABELLED = 40_000
FOLDS = 5
THRESHOLD = 0.3
BINS, PAIR_BINS = 48, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 80, 40, 8
RATE, RIDGE = 0.15, 1.0
UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
GROUPS = {"upper": UPPER, "lower": LOWER, "digit": DIGITS, "bang": b"!?", "bar": b"|", "sign": b"#$%&*@^~+=_<>\\/{}[]", "stop": b".,;:", "quote": b"\"'()-", "high": bytes(range(128, 256))}
FEATURES = ["log_bytes", "log_words", "word_bytes", "long_words", "distinct", "repeats", "middle_word", "lines", "same_lines", *GROUPS]


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    distinct = set(words)
    lines = raw.split(b"\n")
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    counts = [(len(raw) - len(raw.translate(None, chars))) / size for chars in GROUPS.values()]
    common = words.count(words[len(words) // 2]) / n if words else 0.0
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        sum(len(w) > 20 for w in distinct) / n,
        len(distinct) / n,
        repeats / n,
        common,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        *counts,
    ]


def feature_rows(texts: pd.Series) -> np.ndarray:
    return np.array([features(None if not isinstance(t, str) else t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def logistic(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a row of bins in two, and where it lies."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton steps of a tree of a few leaves over a row of bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def shallow_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree over a grid: one cut along the first feature, then one in each half along the second."""
    _, at = best_cut(g.sum(1), h.sum(1))
    out = np.zeros(g.shape)
    for rows in (slice(0, at), slice(at, None)):
        gs, hs = g[rows].sum(0), h[rows].sum(0)
        _, cut = best_cut(gs, hs)
        for cols in (slice(0, cut), slice(cut, None)):
            out[rows, cols] = RATE * gs[cols].sum() / (hs[cols].sum() + RIDGE)
    return out


@dataclass
class AdditiveModel:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, steps in enumerate(self.tables):
            f += steps[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), steps in self.pairs.items():
            f += steps[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return logistic(f)


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    if not len(y):
        return AdditiveModel()
    model = AdditiveModel(base=float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    width = x.shape[1]
    model.edges = [bin_edges(x[:, j], BINS) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(width)]
    f = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(width):
            p = logistic(f)
            size = len(model.tables[j])
            step = shallow(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size))
            model.tables[j] += step
            f += step[bins[j]]
    model.pair_edges = [bin_edges(x[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(width)]
    p = logistic(f)

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        a, b = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], w, a * b).reshape(a, b)

    gains = {}
    for i in range(width):
        for j in range(i + 1, width):
            g, h = grid(i, j, y - p), grid(i, j, p * (1 - p))
            gains[i, j] = float((g**2 / (h + RIDGE)).sum())
    for pair in sorted(gains, key=gains.get, reverse=True)[:PAIRS]:
        model.pairs[pair] = np.zeros((len(model.pair_edges[pair[0]]) + 1, len(model.pair_edges[pair[1]]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (i, j), steps in model.pairs.items():
            p = logistic(f)
            step = shallow_pair(grid(i, j, y - p), grid(i, j, p * (1 - p)))
            steps += step
            f += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> pd.DataFrame:
    """(text features, quality) of at most ``max_labelled`` documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled)
    # at most max_labelled pairs of numbers, so small enough to send to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "x": list(feature_rows(part["text"])), "y": part["quality"].astype("float64")})

    return rows.mapInPandas(giving_back(work), "doc_id long, x array<double>, y double").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "x").limit(max_labelled).toPandas()


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> AdditiveModel:
    ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, max_labelled)
    return fit(np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES)), rows["y"].to_numpy())


def with_score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``docs`` with ``score``: the model's probability of quality 1."""
    score = F.pandas_udf(lambda texts: pd.Series(model.score(feature_rows(texts))), "double")
    return docs.withColumn("score", score(F.coalesce("text", F.lit(""))))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject."""
    rows = with_score(packed(docs, "text"), train(docs, labels))
    return unpacked(rows.where(F.col("score") >= threshold))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
