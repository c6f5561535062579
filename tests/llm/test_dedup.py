import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefscale.llm import exact_dedup, line_dedup, ngram_join
from prefscale.llm.exact_dedup import Trie
from prefscale.llm.line_dedup import CuckooFilter, LineIndex
from tests.llm.cases import LONG, ROWS, documents, empty


@pytest.mark.parametrize("seed", range(30))
def test_trie_spills_and_finds_owners(seed):
    r = random.Random(seed)
    base = bytes(r.randrange(97, 100) for _ in range(60))
    items = [base[: r.randrange(0, 60)] + bytes(r.randrange(97, 99) for _ in range(r.randrange(0, 4))) for _ in range(200)]
    budget, spilled = r.choice([300, 2000, 10**9]), []
    trie = Trie(budget)
    for i, body in enumerate(items):
        trie.add(body, b"k", i, 1)
        if trie.full():
            spilled += trie.spill()
            assert not trie.full()
    parts = [*spilled, *trie.entries()]
    assert len(spilled) == 0 if budget == 10**9 else len(spilled) > 0
    got = {}
    for body, _, owner, count in parts:
        old = got.get(body, (owner, 0))
        got[body] = (min(old[0], owner), old[1] + count)
    assert got == {b: (items.index(b), c) for b, c in Counter(items).items()}


@pytest.mark.parametrize("budget", [1, 500, 10**9])
def test_both_rounds_of_tries_find_owners_at_any_budget(budget):
    r = random.Random(budget)
    rows = [("".join(r.choice("ab") for _ in range(r.randrange(0, 5))).encode(), i) for i in range(300)]
    frame = lambda x: pd.DataFrame([(hashlib.sha256(t).digest(), len(t), t, i, n) for t, i, n in x], columns=["text_key", "n_bytes", "body", "keep_id", "group_size"])
    local = pd.concat(exact_dedup.local_owners(iter([frame([(t, i, 1) for t, i in rows[k : k + 50]]) for k in range(0, 300, 50)]), budget))
    parts = local.sort_values(["n_bytes", "text_key"])
    final = pd.concat(exact_dedup.final_owners(iter([parts.iloc[:7], parts.iloc[7:]]), budget))
    want = {t: (min(i for u, i in rows if u == t), n) for t, n in Counter(t for t, _ in rows).items() if n > 1}
    assert {bytes(k): (o, n) for k, o, n in zip(final["text_key"], final["keep_id"], final["group_size"])} == {hashlib.sha256(t).digest(): x for t, x in want.items()}
    assert len(final) == len(want)


def test_exact_groups_of_awkward_rows(spark):
    got = exact_dedup.one_of_each(exact_dedup.exact_groups(documents(spark), budget=1000)).collect()
    normal = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t, _ in ROWS]
    groups = defaultdict(list)
    for (i, _, _), t in zip(ROWS, normal, strict=True):
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    assert Counter(r["text_sha256"] for r in got) == {k: len(v) for k, v in groups.items()}
    for r in got:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (min(known) if known else None)
    kept = exact_dedup.exact_dedup(documents(spark))
    assert kept.columns == documents(spark).columns
    assert kept.count() == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, size=(5000, 2)).astype(np.uint64)
    f = CuckooFilter.sized(len(keys))
    f.insert(keys)
    assert f.contains(keys).all() and f.used() == 5000
    g = CuckooFilter.load(f.dump())
    g.delete(keys[:2500])
    assert g.contains(keys[2500:]).all() and g.used() == 2500
    assert g.contains(keys[:2500]).mean() < 0.01
    with pytest.raises(line_dedup.Full):
        CuckooFilter(16).insert(keys)


LINE = "this line is long enough to be counted as a line of its own {}"


def line_rows(rng, n):
    return [(i, "\n".join(rng.choice([LINE.format(rng.randrange(8)), "  " + LINE.format(rng.randrange(8)).upper(), "short", ""]) for _ in range(rng.randrange(0, 6))), "a") for i in range(n)]


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(holders[key(x)]) < 5 or max(holders[key(x)]) == i) for i, t, _ in rows}


def test_lines_insert_delete_and_insert_again(spark):
    rows = line_rows(random.Random(4), 60)
    docs = documents(spark, rows)
    index = line_dedup.build_index(docs)
    text = lambda ix, d: {r["doc_id"]: r["kept_text"] for r in line_dedup.without_lines(d, ix.doomed()).collect()}
    assert text(index, docs) == brute_lines(rows)
    fewer = docs.where("doc_id < 25")
    less = index.delete(docs.where("doc_id >= 25").select("doc_id"))
    assert text(less, fewer) == brute_lines(rows[:25])
    back = less.insert(docs.where("doc_id >= 25"))
    assert text(back, docs) == brute_lines(rows)
    state = lambda ix: {(bytes(r["kh"]), r["n_docs"], r["max_doc"]) for r in ix.refs.collect()}
    assert state(back) == state(index)


def test_a_batch_inserted_again_changes_nothing(spark):
    rows = line_rows(random.Random(7), 40)
    docs = documents(spark, rows)
    once = line_dedup.build_index(docs)
    twice = once.insert(docs.where("doc_id < 30"))
    state = lambda ix: {(bytes(r["kh"]), r["n_docs"], r["max_doc"]) for r in ix.refs.collect()}
    assert state(twice) == state(once) and twice.postings.count() == once.postings.count()


def test_without_lines_keeps_columns_of_its_own_names(spark):
    docs = documents(spark, line_rows(random.Random(8), 30)).withColumns({c: F.lit("y") for c in ("_lines", "_packed", "kh")})
    got = line_dedup.without_lines(docs, line_dedup.build_index(docs).doomed())
    assert set(got.columns) == set(docs.columns) | {"n_dropped", "kept_text"}
    rows = got.collect()
    assert all(r["keys"] == "x" and r["_lines"] == r["_packed"] == r["kh"] == "y" for r in rows) and sum(r["n_dropped"] for r in rows)


def test_of_rows_of_one_id_and_text_the_smallest_raw_text_stays(spark):
    rows = [(1, "b  a", "x"), (1, "b a", "x"), (1, "b\ta", "x"), (2, "b a", "x")]
    for n in (1, 4):
        kept = exact_dedup.exact_dedup(documents(spark, rows).repartition(n)).collect()
        assert [(r["doc_id"], r["text"]) for r in kept] == [(1, "b\ta")]


def test_filters_are_rebuilt_when_full(spark):
    index = LineIndex.empty(spark, 1)
    for b in range(3):
        rows = [(1000 * b + i, LINE.format(f"{b} {i}"), "a") for i in range(40 * (1 + 20 * b))]
        index = index.insert(documents(spark, rows))
    blob = index.filters.first()["blob"]
    keys = line_dedup.halves(index.refs.select("kh").toPandas()["kh"])
    assert CuckooFilter.load(bytes(blob)).contains(keys).all() and index.refs.count() == 40 * 63


def test_lines_of_awkward_rows(spark):
    docs = documents(spark)
    got = line_dedup.without_lines(docs, line_dedup.build_index(docs).doomed()).collect()
    assert len(got) == len(ROWS) and all(r["n_dropped"] == 0 for r in got)
    assert all(r["kept_text"] == (t or "") for r in got for i, t, _ in ROWS if i == r["doc_id"] and i is not None)
    assert line_dedup.without_lines(empty(spark), line_dedup.build_index(empty(spark)).doomed()).count() == 0


def brute_components(rows, k, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(rng):
    """Texts and chains of edits of them, many at the edge of the threshold."""
    rows, words = [], [f"w{i}" for i in range(30)]
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([3, 6, 8, 15, 40, 90]))]
        for _ in range(rng.randrange(1, 14)):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(text))
                text = text[:at] + [rng.choice(words)] * rng.randrange(0, 3) + text[at + 1 :] or ["x"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_components_by_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    rows = near_rows(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(docs, 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_block_keys_meet_for_all_similar_sets():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = rng.integers(0, max(1, n // 6) + 1, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert np.intersect1d(ngram_join.block_keys(a, 85), ngram_join.block_keys(b, 85)).size
            apart = int(np.bitwise_count(ngram_join.parity_sketch(a) ^ ngram_join.parity_sketch(b)).sum())
            assert apart <= len(a) + len(b) - 2 * both


def test_near_awkward_rows(spark):
    got = ngram_join.link_components(documents(spark), 4, 85).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None}
    assert by[1] == by[2] == by[7] == (3, 1) and by[3] == (0, 3) and by[4] == (0, 4) and by[9] == (1, 9) and by[10] == (1, 9)
    assert by[6][0] == len({tuple(LONG.split()[i : i + 4]) for i in range(8)})
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    kept = ngram_join.near_dedup(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 8, 9]
    assert ngram_join.near_dedup(empty(spark)).count() == 0


def test_rows_that_repeat_an_id_are_compared_each_for_itself(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "y"), (7, b, "x"), (None, a, "x"), (8, "", "x"), (8, "", "x")]
    for n in (1, 4):
        kept = ngram_join.near_dedup(documents(spark, rows).repartition(n)).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, a), (3, a), (5, b), (8, "")]


@pytest.mark.parametrize("few", [0, 100_000])
def test_large_tables_of_ids_are_not_sent(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", few)
    monkeypatch.setattr(exact_dedup, "BROADCAST_TEXTS", few)
    rows = near_rows(random.Random(4))[:120]
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    want = brute_components(rows, 4, 85)
    assert {r["doc_id"] for r in ngram_join.near_dedup(docs).collect()} == {c for _, c in want.values()}
    first = {}
    for i, t in rows:
        first[t] = min(first.get(t, i), i)
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(docs).collect()} == set(first.values())
