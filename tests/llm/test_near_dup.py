import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import components, near_dup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute(rows, k, percent):
    """{doc_id: (set size, smallest id of its group)} by an inverted index over all tokens."""
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] * bool(w))
    parent, by_set, index = {i: i for i in sets}, defaultdict(list), defaultdict(list)
    for i, s in sets.items():
        if s:
            by_set[s].append(i)
    for same in by_set.values():
        for i in same:
            parent[find(parent, i)] = find(parent, same[0])
    distinct = list(by_set)
    for a, s in enumerate(distinct):
        overlap = Counter(b for t in s for b in index[t])
        for t in s:
            index[t].append(a)
        for b, o in overlap.items():
            if 100 * o >= percent * (len(s) + len(distinct[b]) - o):
                parent[find(parent, by_set[s][0])] = find(parent, by_set[distinct[b]][0])
    low = {}
    for i in sets:
        low[find(parent, i)] = min(low.get(find(parent, i), i), i)
    return {i: (len(s), low[find(parent, i)]) for i, s in sets.items()}


def planted(rng):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for n in (6, 12, 40, 70, 130, 300, 900):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["new%d" % rng.randrange(10**6)], [w[at], "more"]])
            texts.append(w)
    for _ in range(30):  # a shared passage with own words around it
        texts.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] + passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))])
    texts += [["a"], ["A"], ["a", "b"], [], ["a", "b", "c", "d"], ["A", "b", "c", "D"]]
    rng.shuffle(texts)
    return [(i * 3, " ".join(w)) for i, w in enumerate(texts)] + [(10_001, None), (10_002, " \t\n")]


@pytest.mark.parametrize(("k", "percent", "frequent"), [(4, 85, 2), (5, 80, 3), (4, 85, 16)])
def test_groups_equal_brute_force(spark, k, percent, frequent):
    rows = planted(random.Random(k + frequent))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(df, k, percent, frequent).collect()}
    assert got == brute(rows, k, percent)


def test_groups_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(docs, 4, 85).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85)


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "a b c d e f"), (5, None), (6, "other words stand here today"), (None, "x y z x y z"), (None, "X y z x y z"), (7, "one two three four five six"), (7, "one two three four five six"), (None, "one two three four five six")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    want = ["1", "5", "6", "7", "None"]
    assert sorted(str(r.doc_id) for r in near_dup.one_each(df).collect()) == want
    named = df.withColumns({c: F.lit(c) for c in ("_at", "at", "word", "mask", "row", "_row", "key", "label", "n")})
    got = near_dup.one_each(named)
    assert sorted(str(r.doc_id) for r in got.collect()) == want and got.columns == named.columns
    assert near_dup.groups(named).count() == len(rows)
    assert near_dup.one_each(df.limit(0)).count() == 0


def test_an_id_with_two_texts_loses_no_group(spark):
    rows = [(2, "a b c d e f"), (3, "a b c d e f"), (1, "m n o p q r"), (2, "m n o p q r")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert sorted((r.doc_id, r.text) for r in near_dup.one_each(df).collect()) == [(1, "m n o p q r"), (2, "a b c d e f")]


def test_a_full_bit_table_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BITS", 64)
    real = near_dup.frequent_bits
    monkeypatch.setattr(near_dup, "frequent_bits", lambda docs, k, least: real(docs, k, least, most=64))
    rows = planted(random.Random(11))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(df, 4, 85, 3).collect()}
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_an_item(percent):
    rng = np.random.default_rng(percent)
    for full in (True, False):
        table = np.full(1 << 10, 255, np.uint8) if full else rng.integers(0, 256, 1 << 10).astype(np.uint8) | rng.integers(0, 256, 1 << 10).astype(np.uint8)
        for n in [*range(1, 60), 97, 200, 500]:
            for _ in range(8):
                x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                drop, add = rng.integers(0, n // 3 + 1), rng.integers(0, n // 3 + 1)
                y = np.unique(np.append(x[rng.permutation(len(x))[drop:]], rng.integers(0, 1 << 63, add).astype(np.uint64)))
                both = len(np.intersect1d(x, y))
                if 100 * both < percent * (len(x) + len(y) - both) or np.array_equal(x, y):
                    continue
                (_, r1, o1), (_, r2, o2) = (near_dup.signatures(s, table, percent) for s in (x, y))
                assert len(np.intersect1d(r1, r2)) + len(np.intersect1d(o1, o2)), (n, drop, add)


def test_texts_of_shared_passages_only(spark):
    """Every token is frequent and lists are full of texts that don't link, with clusters among them."""
    rng = random.Random(21)
    passages = [[f"p{i}w{j}" for j in range(40)] for i in range(12)]
    rows = []
    for i in range(90):
        w = [x for p in rng.sample(passages, 3) for x in p]
        rows.append((i * 2, " ".join(w)))
        for c in range(rng.choice([0, 0, 1, 3])):  # near copies, some beyond the threshold
            v = list(w)
            for _ in range(rng.choice([1, 2, 4, 8])):
                v[rng.randrange(len(v))] = f"n{i}{c}{rng.randrange(10**6)}"
            rows.append((1000 + i * 10 + c, " ".join(v)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(df, k, percent, 3).collect()}
        assert got == brute(rows, k, percent)


def thue_morse(n):
    """Two words that any polynomial hash modulo a power of two takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 2048])
def test_patterned_words_stay_apart(spark, size):
    x, y = thue_morse(size)
    a, b = (" ".join([w] * 3 + [w + "x", w, w + "y"]) for w in (x, y))
    df = spark.createDataFrame([(1, a, "en", "s", 0), (2, b, "en", "s", 0), (3, a, "en", "s", 0)], DOCS)
    assert {r.doc_id: r.component_id for r in near_dup.groups(df, 4, 85).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_very_long_text(spark):
    rng = random.Random(8)
    w = [f"w{rng.randrange(10**7)}" for _ in range(300_000)]
    rows = [(4, " ".join(w)), (9, " ".join(w[:-300])), (5, "x" * 3_000_000 + " " + " ".join(w[:50]))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert {r.doc_id: r.component_id for r in near_dup.groups(df, 4, 85).collect()} == {4: 4, 9: 4, 5: 5}


def test_components_of_a_long_chain(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    df = spark.createDataFrame([*edges, *edges[:9], (None, 3), (4, None), (None, None)], "a long, b long").withColumns({c: F.lit(-1) for c in ("u", "v", "m", "node", "label")})
    got = {r.node: r.label for r in components.labels(df).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 102: 100}
    assert components.labels(df.limit(0)).count() == 0
