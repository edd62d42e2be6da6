import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_near_dup import thue_morse

from weftline.llm import substring_dedup
from weftline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, window):
    """{doc_id: (words, removed, kept)} from the smallest doc_id of every window."""
    low, split = {}, {i: (t or "").encode().split() for i, t in rows}
    for i, w in split.items():
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            low[key] = min(low.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if low[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), kept.decode())
    return out


def planted(rng):
    v = ["".join(rng.choice("abcdé") for _ in range(4)) for _ in range(400)]
    some = lambda n: [rng.choice(v) for _ in range(n)]
    passages = [some(n) for n in (9, 10, 11, 15, 30, 80)] + [["x"] * 40, ["x", "y"] * 15]
    rows = []
    for i in range(60):
        w = some(rng.randint(0, 20))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            s = rng.randrange(len(p))
            w += rng.choice([p, p[s:], p[:s]]) + some(rng.randint(0, 6))
        rows.append((i * 7 - 20, "  ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, rows[3][1].replace("  ", "\n"))]


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_cut_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(substring_dedup, "TABLE_BITS", bits)
    rows = planted(random.Random(5))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.cut(df, 10, 4).collect()}
    assert got == brute(rows, 10)
    assert sum(x[1] > 0 for x in got.values()) > 10


def test_op5_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, sf_dir).collect()}
    assert got == {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, (n, g, k) in brute(docs, 50).items()}


def test_odd_rows(spark):
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(1, text, "", "", 0), (1, text, "", "", 0), (None, text, "", "", 0), (2, text + " 61", "", "", 0)], DOCS)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.cut(df.withColumn("spans", F.lit(1))).collect())
    assert got == [("1", 60, 0), ("1", 60, 0), ("2", 61, 60), ("None", 60, 0)]
    assert substring_dedup.cut(df.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_words(spark):
    repeated, own = " ".join(f"r{i}" for i in range(60)), " ".join(f"o{i}" for i in range(60))
    df = spark.createDataFrame([(1, repeated, "", "", 0), (2, repeated, "", "", 0), (2, own, "", "", 0), (2, own, "", "", 0)], DOCS)
    odd = df.withColumns({c: F.lit(1) for c in ("body", "anchor", "at", "mask", "first", "spans")})
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.cut(odd).collect()) == [(1, 0), (2, 0), (2, 0), (2, 60)]


@pytest.mark.parametrize("size", [1024, 2048])
def test_patterned_words_stay_apart(spark, size):
    x, y = thue_morse(size)
    rows = [(1, " ".join([x] * 55)), (2, " ".join([y] * 55)), (3, " ".join([y] * 52)), (4, " ".join(thue_morse_words("p", "q", 64))), (5, " ".join(thue_morse_words("q", "p", 64)))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.cut(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)).collect()}
    assert got == brute(rows, 50) and got[2][1] == 0 and got[3][1] == 52


def thue_morse_words(a, b, n):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_a_very_long_text(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long[:70])), (2, " ".join(long)), (3, " ".join(long[1000:150_000])), (4, "x" * 2_000_000)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.cut(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)).collect()}
    assert got == brute(rows, 50)
