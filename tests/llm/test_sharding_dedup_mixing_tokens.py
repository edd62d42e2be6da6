import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, mixing, sharding, token_counts
from weftline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_rows():
    return [(1, "a b", "x"), (2, None, "x"), (3, "", None), (4, "a b", "x"), (4, "a b", "x"), (None, "ab", "y"), (6, " a\tb ", "y"), (7, "word " * 30000, "y"), (8, "  é 😀", "z")]


def test_walk_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 17, 100, 1023):
        for seed in (0, 9):
            got = [r[0] for r in spark.range(n).select(sharding.walked(F.col("id"), n, seed)).collect()]
            assert sorted(got) == list(range(n))
    far = spark.range(1000).select(sharding.walked(F.col("id") + (10**15 - 1000), 10**15, 3).alias("p")).collect()
    assert len({r.p for r in far}) == 1000 and all(0 <= r.p < 10**15 for r in far)


def test_shards_are_even_and_repeat(spark):
    df = docs_of(spark, odd_rows() * 3)
    a = sorted(map(str, sharding.shard(df, 4).collect()))
    b = sorted(map(str, sharding.shard(df.repartition(7), 4).collect()))
    assert a == b
    rows = sharding.shard(df, 4).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == df.count() and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(df.limit(0), 4).count() == 0
    assert sharding.shard(df.withColumn("shard", F.lit("mine")), 2).columns[-3:] == ["row_number", "shard", "slot"]


def chained(values, seed=42):
    """Spark's xxhash64 of longs (and ints, as one-element tuples); nulls leave the hash as it is."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), seed=seed).intdigest()
    return seed


def brute_place(number, n, seed=0):
    a = max(1, math.isqrt(n))
    b = max(1, -(-n // a))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    while True:
        left, right = divmod(number, b)
        for i in range(6):
            if i % 2:
                right = (right + signed(chained([left, (i,), (seed,)])) % b) % b
            else:
                left = (left + signed(chained([right, (i,), (seed,)])) % a) % a
        number = left * b + right
        if number < n:
            return number


def test_op1_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ranked = sorted(rows, key=lambda r: (chained(r), r))
    want = {}
    for number, r in enumerate(ranked):
        place = brute_place(number, len(rows))
        want[r[0]] = (place % 16, place // 16, number)
    got = {r.doc_id: (r.shard, r.slot, r.row_number) for r in QUERIES["op1_sharding"](spark, sf_dir).collect()}
    assert got == want


def test_op1_columns(spark, sf_dir):
    rows = QUERIES["op1_sharding"](spark, sf_dir).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        b = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)


def brute_groups(rows):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = defaultdict(list)
    for i, t, _ in rows:
        by[strip(t)].append((-len(t or ""), i is None, i))
    out = []
    for i, t, _ in rows:
        group = sorted(by[strip(t)], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((i, group[0][2], len(group), hashlib.sha256(strip(t).encode()).hexdigest()))
    return Counter(out)


def test_exact_groups_and_hash_clashes(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ,é0") for _ in range(n)) for n in (10, 900, 5000, 30000)]
    rows = odd_rows() + [(100 + i, base[i % 4] if i % 3 else base[i % 4].replace(" ", "\n "), "x") for i in range(24)]
    rows += [(300, base[3][:-1] + "Z", "x"), (301, "Z" + base[3], "x"), (302, "q" * 50000, "x")]
    df = docs_of(spark, rows)
    for hashed in (F.xxhash64, lambda c: F.pmod(F.length(c).cast("long"), F.lit(3))):
        got = exact_dedup.groups(df, hashed).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_groups(rows)
        stays = Counter(r.text_sha256 for r in got if r.kept)
        assert set(stays.values()) == {1} and set(stays) == {r.text_sha256 for r in got}
    assert exact_dedup.groups(df.limit(0)).count() == 0


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefghijklmnopé,59") for _ in range(60000))
    scripts = [body] + ["".join(chr(rng.randint(low, high)) for _ in range(60000)) for low, high in ((0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x627, 0x64A), (0x3041, 0x3096), (0x915, 0x939))]
    for body in scripts:
        one, two = spark.createDataFrame([(body,), ("XYZ" + body,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).collect()
        assert "".join(one.c) == body and len(set(one.c) & set(two.c)) > (0.9 if body == scripts[0] else 0.1) * len(one.c), ascii(body[:9])


def filled(sizes, weights, share=1.5, most=2.0):
    """Reshare by rounds until no source is above its most."""
    target, capped, budget = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        left = budget - sum(most * sizes[s] for s in capped)
        level = left / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if weights[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: most * sizes[s] for s in capped} | {s: weights[s] * level for s in free}
        capped |= set(over)


def check_mix(rows, sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    taken = Counter()
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.copies in (0, 1, 2)
        taken[r.source] += r["size"] * r.copies
    return taken, want


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 5, 8, 40, 41, 300]), rng.choice(["a", "b", "c", "é", "Z", None, "a", "a"])) for i in range(800)]
    rows += [(9000, "w " * 90000, "tiny"), (9001, None, "a")]
    df = docs_of(spark, rows).withColumn("size", mixing.word_count(F.col("text")))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    taken, want = check_mix(got, sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= (45_000 if s == "tiny" else 0.5)  # tiny has one document of 90,000 words
    again = mixing.mixed(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in again)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_clashing_columns_are_replaced(spark):
    df = docs_of(spark, odd_rows()).withColumn("size", mixing.word_count(F.col("text")))
    plain = Counter((r.doc_id, r.copies, r.target) for r in mixing.mixed(df).collect())
    odd = df.withColumns({c: F.lit("mine") for c in ("target", "copies", "key", "of_key", "n", "before", "extra", "keep_id", "_hash", "_place", "slot", "recipe", "_row", "n_tokens")})
    assert Counter((r.doc_id, r.copies, r.target) for r in mixing.mixed(odd).collect()) == plain
    assert sharding.shard(odd, 3).count() == exact_dedup.groups(odd).count() == token_counts.counted(odd).count() == df.count()


def reachable(lengths, counts):
    sums = {0}
    for length, c in zip(lengths, counts, strict=True):
        sums = {s + k * int(length) for s in sums for k in range(c + 1)}
    return sums


@pytest.mark.parametrize("longest", [30, 5000, 10**6])
def test_fit_equals_brute_force(longest):
    rng = random.Random(longest)
    for _ in range(200 if longest < 10**6 else 25):
        n = rng.randint(1, 6)
        lengths = np.array([rng.randint(1, longest) for _ in range(n)])
        lengths = np.unique(lengths)
        counts = np.array([rng.randint(1, 4 if longest < 10**6 else 2) for _ in lengths])
        if int((lengths * counts).sum()) > max(mixing.SPREAD, 4 * int(lengths.max())):
            continue
        sums, budget = reachable(lengths, counts), rng.randint(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums), (lengths, counts, budget)


def test_fit_beyond_its_spread_stays_near():
    rng = random.Random(9)
    for _ in range(40):
        lengths = np.unique([rng.randint(1, 3000) for _ in range(rng.randint(1, 400))])
        counts = np.array([rng.choice([1, 2, 50, 4000]) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) <= (1 if len(lengths) > 20 else lengths.max() / 2)
    assert mixing.fit(np.array([10**6]), np.array([10]), 1_900_000).tolist() == [2]
    assert mixing.fit(np.array([200_000, 300_000, 350_000]), np.array([1, 1, 1]), 500_000).tolist() == [1, 1, 0]


def test_repeated_rows_are_taken_as_often_as_needed(spark):
    rows = [(1, "a b c", "x")] * 40 + [(2, "a b", "x"), (3, None, "x"), (None, "a b c", "x"), (None, "a b c", "y"), (5, "w " * 50, "y")]
    df = docs_of(spark, rows).withColumn("size", mixing.word_count(F.col("text")))
    got = mixing.mixed(df).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter((i, t, s) for i, t, s in rows)
    taken, want = check_mix(got, Counter({"x": 125, "y": 53}))
    assert abs(taken["x"] - want["x"]) <= 1
    again = mixing.mixed(df.repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_token_counts_equal_the_library(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path())
    odd = ["", " ", "  ", "a", " a", "a ", "a  b   c ", "\n", "a\nb \n c", "<s> x </s>", "▁a▁▁b ", "é ﬁ ½", "日本語テキスト", "\x00 a", "\t a", "😀 😀", "   x"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counter = token_counts.Counted(token_counts.vocabulary_path())
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (-2, "a\u3000b \u00a0c\u200b d", "x"), (-2, "a", "x"), (None, "q" * 20_000, "x"), (-3, "word " * 300_000, "x")]
    assert counter.of(["", "a", " a"]) == [1, len(model.encode("a")), len(model.encode(" a"))]
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in rows)
    for df in (docs_of(spark, rows), docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("block", "part", "blob")}).repartition(5)):
        df = df.localCheckpoint()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(df).collect()) == want
    df = docs_of(spark, odd_rows() * 2)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(df).collect())
    assert got == Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in odd_rows() * 2)
    assert token_counts.counted(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        token_counts.counted(df, "/nowhere/x.model").collect()


def test_a_pre_token_has_one_range(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 2000)
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(200)), "x") for i in range(40)]
    df = docs_of(spark, rows).repartition(4, "doc_id").localCheckpoint()
    questions = token_counts.asked(df.select("doc_id", "text"), 8)
    assert questions.count() > 8
    lists = [pa.decompress(r.blob, decompressed_size=r["size"], codec="zstd", asbytes=True).split(token_counts.BETWEEN) for r in questions.collect()]
    assert {w.decode() for x in lists for w in x} == {w for _, t, _ in rows for w in t.split()}
    by = defaultdict(set)
    for r, x in zip(questions.collect(), lists, strict=True):
        for w in x:
            by[w].add(r.part)
    assert all(len(p) == 1 for p in by.values())


def test_fit_takes_a_long_document_that_comes_nearer():
    for lengths, counts, budget, want in [([3000], [1], 2000, 3000), ([3000], [1], 1000, 0), ([100, 3000], [1, 1], 2000, 3000), ([400_000], [1], 380_000, 400_000), ([7, 400_000], [1, 1], 380_000, 400_000), ([300_000, 900_000], [1, 1], 290_000, 300_000)]:
        lengths, counts = np.array(lengths), np.array(counts)
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and abs(int((lengths * take).sum()) - want) <= 7, (lengths, budget, take)
