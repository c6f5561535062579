"""Quality rules, fill-in-the-middle and periodic runs against brute force, exact round trips and awkward rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefscale.llm import fill_in_middle as fim
from prefscale.llm import periodic_runs as runs
from prefscale.llm import quality_rules as rules
from prefscale.llm.windows import repeated_cover
from tests.llm.cases import CLASHING, documents, empty

TEXTS = ["The cat sat on the mat.", "A dog ate the cat's food 12 times!", "", "zzz zzz zzz", "Ünïcödé wörds, 漢字 and \n lines", "The cat sat on a dog."] * 2


def plain_kneser_ney(texts, order):
    """p(n-gram) of modified Kneser-Ney by dicts, straight from its definition."""
    grams = Counter()
    for t in texts:
        if t:
            row = [0] * (order - 1) + [int(rules.symbols(rules.code_points(c))[0]) for c in t] + [0]
            grams.update(tuple(row[i : i + order]) for i in range(len(row) - order + 1))
    levels = [grams]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    p = None
    for counts in reversed(levels):
        n = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
        d = list(rules.PLAIN_DISCOUNTS)
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [max(0.0, 1 - 2 * y * n[1] / n[0]), max(0.0, 2 - 3 * y * n[2] / n[1]), max(0.0, 3 - 4 * y * n[3] / n[2])]
        total, off = defaultdict(float), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        p = {g: max(c - d[min(c, 3) - 1], 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * (p[g[1:]] if p else 1 / 64) for g, c in counts.items()}
    return p


@pytest.mark.parametrize("order", [2, 4])
def test_kneser_ney_by_brute_force(spark, order):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    model = rules.train(docs, order)
    want = plain_kneser_ney(TEXTS, order)
    assert len(model.codes[-1]) == len(want)
    for g, p in want.items():
        code = sum(s << 6 * i for i, s in enumerate(reversed(g)))
        assert math.isclose(model.log2(np.array([code], np.int32))[0], math.log2(p), rel_tol=1e-9)


def test_probabilities_sum_to_one_also_over_unseen(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model = rules.train(docs, 3)
    for context in [0, 2 << 6 | 3, int(model.contexts[-1][5]), 63 << 6 | 62]:
        codes = np.array([context << 6 | s for s in range(64)], np.int32)
        assert math.isclose(np.exp2(model.log2(codes)).sum(), 1.0, rel_tol=1e-9)


def test_text_bits_are_sums_over_symbols(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    model = rules.train(docs)
    texts = [*TEXTS, "never seen: QQQ~~~~"]
    points = [rules.code_points(t) for t in texts]
    alone = [-model.log2(rules.n_grams([p], 4)[0]).sum() for p in points]
    assert np.allclose(rules.text_bits(model, points), alone)


def test_gibberish_is_rejected_and_prose_stays(spark):
    rng = random.Random(3)
    syllables = ["ka", "to", "mi", "ren", "sol", "da", "vi"]
    prose = ["".join(rng.choice(syllables) + rng.choice(["", "", " "]) for _ in range(600)) for _ in range(200)]
    noise = [" ".join("".join(rng.choice("bcdfghjklmpqrstvwxyz0123#@") for _ in range(6)) for _ in range(200)) for _ in range(3)]
    rows = [(i, t, "xx") for i, t in enumerate(prose + noise)]
    kept = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(200))


def test_repeated_cover_by_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(40))]
        size = rng.randrange(1, 8)
        seen = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        want = np.zeros(len(words), bool)
        for i in range(len(words) - size + 1):
            want[i : i + size] |= seen[tuple(words[i : i + size])] > 1
        assert (repeated_cover(words, size) == want).all()


def test_elias_fano_gives_every_number_back():
    rng = random.Random(7)
    for _ in range(500):
        ends = np.cumsum([rng.randint(1, rng.choice([1, 3, 1000])) for _ in range(rng.randrange(100))]).astype(np.int64)
        listed = fim.elias_fano(ends)
        assert [fim.select(listed, i) for i in range(len(ends))] == ends.tolist()
        with pytest.raises(IndexError):
            fim.select(listed, len(ends))


def test_lists_are_short():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 80, 10_000))
    assert len(fim.elias_fano(ends)) < 10_000  # under eight bits a line


@pytest.mark.parametrize("spm", [0, 50, 100])
def test_middles_are_restored(spark, spm):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(["a\n", "b", "é", "\n", "<P", ">", "<S>" if i % 50 == 0 else "x"]) for _ in range(rng.randrange(30))), "s") for i in range(300)]
    made = fim.fill_in_middle(documents(spark, rows), suffix_first=spm)
    got = made.select("doc.doc_id", "doc.text", "fim.*", fim.restore(F.col("fim.fim_text"), F.col("fim.form")).alias("again")).collect()
    assert len(got) == 300
    for r in got:
        assert r["again"] == r["text"]
        assert (r["form"] == "plain") == (not fim.can_be_cut(r["text"]))
        assert r["form"] != ("psm" if spm == 100 else "spm" if spm == 0 else "")


def test_another_texts_list_is_not_used(spark, monkeypatch):
    """Texts under one hash: whichever list is kept, each row is cut by its own ends."""
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(["a\nbb\nccc\n", "one\ntwo", "x", "", "long line\n" * 9] * 3)], False)
    want = {r["doc_id"]: r["fim"] for r in fim.fill_in_middle(docs).select("doc.doc_id", "fim").collect()}
    monkeypatch.setattr(fim.F, "sha2", lambda c, n: F.lit("ab"))
    got = {r["doc_id"]: r["fim"] for r in fim.fill_in_middle(docs).select("doc.doc_id", "fim").collect()}
    assert got == want


def plain_runs(w, least, power):
    out = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, power * q) and i > s:
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


@pytest.mark.parametrize(("least", "power"), [(2, 2), (6, 3), (24, 3)])
def test_runs_by_brute_force(least, power):
    rng = random.Random(13)
    for _ in range(2500):
        k, n = rng.choice([1, 2, 3, 6]), rng.randrange(70)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = w[:a] + [w[a + i % p] for i in range(n - a)] + w[: rng.randrange(n + 1)]
        assert runs.text_runs([b"%d" % x for x in w], least, power) == plain_runs(w, least, power), w


def test_factors_are_the_longest_known():
    rng = random.Random(17)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        at = 0
        for start, size, source in runs.factors(w):
            assert start == at
            at += size
            earlier = lambda n, s=start: any(w[j : j + n] == w[s : s + n] for j in range(s))
            assert size == 1 and source < 0 or w[source : source + size] == w[start : start + size] and source < start
            assert start + size == len(w) or not earlier(size + (source >= 0))
        assert at == len(w)


def test_collapsed_texts_keep_one_period(spark):
    docs = documents(spark, [(1, "start " + "one two  three " * 20 + "end", "a"), (2, "no  run\there", "a")])
    got = {r["doc_id"]: r["text"] for r in runs.collapse_runs(docs).collect()}
    assert got == {1: "start one two three end", 2: "no  run\there"}


def test_awkward_rows(spark):
    for docs in (documents(spark), empty(spark)):
        docs = docs.withColumn("lang", F.col("source"))
        n = docs.count()
        assert runs.with_runs(docs).count() == n
        assert runs.collapse_runs(docs).columns == docs.columns
        made = fim.fill_in_middle(docs)
        assert made.count() == n
        assert set(CLASHING) < set(made.select("doc.*").columns)
        scored = rules.with_counts(docs, rules.train(docs)).withColumn("lang", F.col("doc.lang"))
        judged = rules.judged(scored).collect()
        assert len(judged) == n
        assert all((r["bits"] is None) == (not r["doc"]["text"]) for r in judged)
        assert all(not r["kept"] for r in judged if not r["doc"]["text"])
        kept = rules.quality_rules(docs)
        assert kept.columns == docs.columns
        assert kept.count() <= n
    long = [r for r in runs.with_runs(documents(spark)).collect() if r["doc"]["doc_id"] == 6]
    assert [tuple(r["runs"][0]) for r in long] == [(0, 120_000, 3)] * 2
    assert {r["collapsed"] for r in long} == {"lorem ipsum dolor"}
