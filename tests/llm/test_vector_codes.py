"""Product codes against plain integer arithmetic."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from weftline.llm import vector_codes as vc


def brute(rows, entries, rounds, parts=4, scale=1024):
    """(id, code, error) and the codebooks, one vector and entry at a time."""
    whole = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    length = len(whole[0][1])
    ints = [(i, [max(-vc.FARTHEST, min(vc.FARTHEST, math.floor(c * scale))) for c in v]) for i, v in whole if len(v) == length]
    width = -(-length // parts)
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v in ints[:entries]] for p in range(parts)]

    def assigned():
        out = []
        for _, v in ints:
            out.append([min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p])) for p, x in enumerate(cut(v))])
        return out

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for n in range(len(books[p])):
                mine = [cut(v)[p] for (_, v), f in zip(ints, found, strict=True) if f[p][1] == n]
                if mine:
                    books[p][n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    coded = [(i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f)) for (i, _), f in zip(ints, assigned(), strict=True)]
    coded += [(i, None, None) for i, v in whole if len(v) != length]
    return coded, books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)


def check(spark, rows, entries, rounds):
    want, books = brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], entries, rounds)
    df = frame(spark, rows)
    got = vc.codebooks(df, entries=entries, rounds=rounds)
    flat = [c for p in books for e in p for c in e]
    assert vc.digest(got) == hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.vec_id, r.code, r.error) for r in vc.encoded(df, got).collect()], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("length", [16, 8, 6, 4, 3])
def test_codes_equal_brute_force(spark, length):
    rng = random.Random(length)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(length)]) for i in range(60)]
    rows += [(100 + i, list(rows[0][1])) for i in range(40)]  # a third of the rows are one vector
    check(spark, rows, 16, 3)


def test_odd_rows(spark):
    rng = random.Random(1)
    vector = lambda n=8: [rng.gauss(0, 1) for _ in range(n)]
    rows = [(i, vector()) for i in range(20)]
    rows += [(3, rows[3][1]), (3, vector()), (None, vector()), (30, None), (31, [None] * 8), (32, [float("nan")] * 8), (33, [float("inf")] + [0.0] * 7), (34, []), (35, vector(4)), (36, [0.0] * 8), (37, [1e30] * 8), (-5, vector())]
    check(spark, rows, 6, 2)
    check(spark, rows[:3], 256, 4)  # fewer vectors than entries


def test_no_vectors(spark, tmp_path):
    frame(spark, [(1, None)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vc.op11_vector_compression(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_a_long_table_with_other_columns(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v], None if i % 3 else i % 2, "x") for i, v in enumerate(rng.normal(0, 0.1, (700, 64)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vc.op11_vector_compression(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(vc.OP11_SQL).fetchall())


def test_the_filter_never_passes_over_the_nearest():
    rng = np.random.default_rng(4)
    for far in (3, 1000, 1 << 20, vc.FARTHEST):
        x = rng.integers(-far, far, (300, 16), endpoint=True)
        book = vc.Codebook(np.concatenate([x[:50], x[:14]]))
        code, best = book.nearest(x)
        every = ((x[:, None].astype(object) - book.entries[None].astype(object)) ** 2).sum(axis=2)
        assert (best == every.min(axis=1)).all() and (code == np.array([list(r).index(min(r)) for r in every])).all()
    entries = rng.normal(0, 130, (256, 16)).astype(np.int64)
    left = vc.Codebook(entries).candidates(rng.normal(0, 130, (2000, 16)).astype(np.int64)).sum(axis=1).mean()
    assert left < 40  # of 256


def test_query_equals_sql(spark, sf_dir):
    got = vc.op11_vector_compression(spark, sf_dir)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(sf_dir, 'embeddings.parquet')}'")
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(vc.OP11_SQL).fetchall())
