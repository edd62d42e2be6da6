"""Collision counting against every pair's cosine."""

import math

import numpy as np
import pytest

from weftline.llm import nearest as nn


def brute(ids, x, queries, k):
    """Per query the best k (id, cosine), ties to the smaller id."""
    norms = [math.sqrt(sum(float(c) ** 2 for c in v)) for v in x]
    out = {}
    for q in queries:
        at = ids.index(q)
        every = [(-sum(float(a) * float(b) for a, b in zip(x[at], v, strict=True)) / norms[at] / n, i) for i, v, n in zip(ids, x, norms, strict=True) if i != q]
        out[q] = [(i, -s) for s, i in sorted(every)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard", [1 << 22, 64 * 200])
def test_recall_on_clustered_and_random_vectors(spark, shard):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (12, 64))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(0, 0.6, (500, 64)), rng.normal(0, 1, (400, 64))])
    ids = list(range(len(x)))
    df = frame(spark, zip(ids, x, strict=True))
    got, want = results(nn.nearest(df, df.filter("vec_id % 50 = 0"), shard=shard)), brute(ids, x, range(0, 900, 50), 5)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hit >= 0.9 * 5 * len(want) and all(len(v) == 5 for v in got.values())
    exact = {(q, i): s for q, w in brute(ids, x, range(0, 900, 50), 899).items() for i, s in w}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, v in got.items() for i, s in v)


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(0, 1, 32)
    rows = [(i, one) for i in range(300)] + [(1000 + i, v) for i, v in enumerate(rng.normal(0, 1, (200, 32)))]
    df = frame(spark, rows)
    got = results(nn.nearest(df, df.filter("vec_id in (0, 150)")))
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[150]] == [0, 1, 2, 3, 4]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1e-3]), (1, [2.0, 1e-3]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (50, [-1e200, 1e190]), (100, [0.0, 0.0]), (150, [1.0])]
    df = frame(spark, rows)
    got = results(nn.nearest(df, df.filter("vec_id % 50 = 0")))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 50], 50: [1, 0]}  # all candidates, if fewer than five; other lengths are no candidates
    assert abs(got[0][0][1] - 2 / math.hypot(2, 1e-3)) < 1e-15 and got[0][1][1] == -1.0
    empty = df.limit(0)
    assert nn.nearest(empty, empty).count() == 0 and nn.nearest(df, empty).count() == 0


def test_repeated_rows_and_long_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, (40, 3000))
    rows = [(i, v) for i, v in enumerate(base)] + [(0, base[0])] * 60
    df = frame(spark, rows)
    got, want = results(nn.nearest(df, df.filter("vec_id = 0"), shard=3000 * 16)), brute(list(range(40)), base, [0], 5)
    assert got.keys() == {0} and len({i for i, _ in got[0]} & {i for i, _ in want[0]}) >= 4 and len({i for i, _ in got[0]}) == 5


def test_results_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(11)
    df = frame(spark, enumerate(rng.normal(0, 1, (300, 16))))
    asked = df.filter("vec_id % 10 = 0")
    assert results(nn.nearest(df, asked, shard=16 * 100)) == results(nn.nearest(df.repartition(9), asked.repartition(2), shard=16 * 100))


def test_query_reaches_the_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    got = results(nn.op12_nearest_neighbours(spark, sf_dir))
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = [i for i in ids if i % 50 == 0]
    assert set(got) == set(asked)
    hit = 0
    for q in asked:
        s = x @ x[ids.index(q)]
        s[ids.index(q)] = -9
        hit += len({ids[j] for j in np.argsort(-s, kind="stable")[:5]} & {i for i, _ in got[q]})
    assert hit >= 0.9 * 5 * len(asked)
