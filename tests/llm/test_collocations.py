"""Collocations against counting every run of words."""

import random
import re
from collections import Counter

import duckdb
import pytest

from weftline.llm import collocations as co

GAP = " \t"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, frequent, top=2000, covered=100, longest=5):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {}
    long_ones = [(lang, p, a) for (lang, p), a in counts.items() if len(p) > 1 and a >= frequent]
    for lang, p, a in long_ones:
        inside = any(lang == other and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= covered * a for other, q, b in long_ones)
        if not inside:
            n = totals[lang]
            score, k = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((" ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], n, score))
    out = []
    for lang, rows in found.items():
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(t, lang, 1) for lang, t in docs], "text string, lang string, phrase int").repartition(3)


def results(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least", [1, 200, 1 << 24])
def test_equal_brute_force_in_any_blocks(spark, least):
    rng = random.Random(least)
    vocabulary = ["Aa", "b", "été", "ÉTÉ", "c d", "e-f", "x" * 80, "数"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?", "\x0b"]) for _ in range(rng.randrange(40)))
    docs = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(60)]
    docs += [("en", "the quick brown fox jumps over the lazy dog")] * 30 + [("de", "a a a a a a a a")] * 5  # repeated rows, overlaps
    docs += [("en", None), (None, None), ("fr", ""), ("fr", " .,\t\n"), ("fr", "one")]
    for frequent, top in ((4, 2000), (1, 5)):
        got = results(co.collocations(frame(spark, docs), frequent=frequent, top=top, least=least))
        assert got == brute(docs, frequent, top)


def test_a_very_long_text_and_words_that_cross_no_text(spark):
    long = ("lorem ipsum dolor. " * 40_000) + "sit"
    docs = [("en", long), ("en", "amet lorem"), ("en", "ipsum dolor")] + [("en", "b"), ("en", "c")] * 200
    got = results(co.collocations(frame(spark, docs)))
    assert got == brute(docs, 100) and [r[2] for r in got] == ["ipsum dolor", "lorem ipsum dolor"]


def test_empty_table(spark):
    assert co.collocations(frame(spark, []).limit(0)).count() == 0


def test_pruning_by_bits_only_ever_lets_more_pass(spark, monkeypatch):
    rng = random.Random(5)
    docs = [("en", " ".join(rng.choice("abcdefghij") for _ in range(60))) for _ in range(30)]
    monkeypatch.setattr(co, "LEAST_BITS", 64)
    monkeypatch.setattr(co, "MOST_BITS", 64)  # full of false hits
    assert results(co.collocations(frame(spark, docs), frequent=8)) == brute(docs, 8)


def test_products_beyond_64_bits_are_exact(spark):
    rows = [(30_000_000_019, 9_000_000_000_000_037, 50_000_000_021, 70_000_000_000_003), (10**13 + 1, 10**16 + 3, 10**13 + 7, 10**13 + 9), (100, 101, 100, 100)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(co.score("a", "n", "l", "r")).collect()
    assert sorted(x[0] for x in got) == sorted(1000 * a * n // (l * r) for a, n, l, r in rows)


def test_query_equals_sql(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    docs = [(rng.choice(["en", "de", None]), ", ".join(" ".join(rng.choices(words, weights=[30 - i for i in range(30)], k=8)) for _ in range(20)) + " new york city") for _ in range(300)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = results(co.op13_phrase_collocations(spark, str(tmp_path)))
    assert got and got == sorted(c.execute(co.OP13_SQL).fetchall())
