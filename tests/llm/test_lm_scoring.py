import math
import zlib
from collections import Counter

import numpy as np

from weftline.llm import common, lm_scoring
from weftline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    lists = [(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, [x.lower() for x in (t or "").encode().split()] + [None]) for i, t in rows]
    c = Counter(w for _, held, ws in lists if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, held, ws in lists)


def test_base_is_exact_and_the_model_is_better(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op2_lm_scoring"](spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == brute(docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in rows)


def test_words_outside_the_table_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLOTS", 1 << 18)
    rows = [(i, f"A the b{i % 5} c{i} the\tend", "en", "s", 0) for i in range(60)] + [(None, None, "", "", 0), (100, "", "", "", 0), (7, "x", "", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute([(r[0], r[1]) for r in rows])
    got = lm_scoring.scores(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    real = lm_scoring.Vocabulary.__init__

    def empty(self, common, endings, total, distinct):
        real(self, common.slice(0, 0), endings, total, distinct)

    monkeypatch.setattr(lm_scoring.Vocabulary, "__init__", empty)
    got = lm_scoring.scores(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert lm_scoring.scores(df.limit(0)).count() == 0


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    sums = rng.integers(0, 3, lm_scoring.CLASSES**2 + lm_scoring.CONTEXT**2 * lm_scoring.CLASSES)
    sums[: lm_scoring.CLASSES] = 0
    e = lm_scoring.Estimates(sums)
    c = np.arange(lm_scoring.CLASSES)
    for one, two in ((0, 0), (3, 40)):
        _, p3, p2, p1 = e.of(np.full(len(c), one), np.full(len(c), two), c)
        assert np.allclose([p3.sum(), p2.sum(), p1.sum()], 1)


def test_weights_raise_the_held_out_likelihood():
    import pyarrow as pa

    level = lambda p: int(lm_scoring._level(np.array([p]))[0])
    key = lambda b, p3, p2, p1: ((b * lm_scoring.LEVELS + level(p3)) * lm_scoring.LEVELS + level(p2)) * lm_scoring.LEVELS + level(p1)
    w = lm_scoring.mixture(pa.table({"key": [key(9, 0.5, 0.1, 0.01), key(9, 0.0, 0.1, 0.01), key(1, 0.0, 0.0, 0.02)], "n": [900, 100, 5000]}))
    assert np.allclose(w.sum(1), 1) and w[9, 0] > 0.8 and w[1, 2] > 0.9


def test_word_order_within_a_class_counts(spark, monkeypatch):
    real = lm_scoring.Vocabulary.__init__
    monkeypatch.setattr(lm_scoring.Vocabulary, "__init__", lambda self, common, *rest: real(self, common.slice(0, 0), *rest))
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, f"a{i % 20}xx b{i % 20}xx c{i % 20}xx d{i % 20}xx") for i in range(2000) if i not in held]
    rows += [(held[0], "a1xx b1xx c1xx d1xx"), (held[1], "b1xx d1xx a1xx c1xx"), (held[2], "a1xx b1xx c1xx d2xx"), (held[3], "e1xx b1xx c1xx d1xx")]
    got = {r.doc_id: r for r in lm_scoring.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    true, moved, last, first = (got[i].score for i in held[:4])
    assert true > moved + 4 and true > last + 1 and true > first + 1


def test_gram_counts_and_contexts_are_exact(spark):
    rng = np.random.default_rng(5)
    lists = [[f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 30))] for _ in range(200)]
    df = spark.createDataFrame([(i, i % 5 == 0, i % 5 == 1, " ".join(w)) for i, w in enumerate(lists)], "doc_id long, held_out boolean, deleted boolean, text string").repartition(3, "doc_id").localCheckpoint()
    full, part = Counter(), Counter()
    grams = [[tuple((["."] * 2 + w + ["."])[k + 2 - o : k + 3]) for k in range(len(w) + 1) for o in range(3)] for w in lists]
    for i, g in enumerate(grams):
        full.update(g if i % 5 else [])
        part.update(g if i % 5 == 1 else [])

    def act(piece, tokens, found):
        import pyarrow as pa

        text = np.repeat(piece.column(0).to_numpy(), np.diff(tokens[2], prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(text), *(pa.array(x[o]) for x in found for o in range(3))], names=["doc_id", *(f"{c}{o}" for c in "fp"[: len(found)] for o in range(3))])

    answers = lm_scoring.gram_counts(df)
    form = ", ".join(["doc_id long", *(f"{c}{o} long" for c in "fp" for o in range(3))])
    got = lm_scoring._met(df.filter("deleted").drop("deleted"), answers.filter("deleted"), 2, act, form).collect()
    want = Counter((i, *(full[g[k + o]] for o in range(3)), *(part[g[k + o]] for o in range(3))) for i, g in enumerate(grams) if i % 5 == 1 for k in range(0, len(g), 3))
    assert Counter(tuple(r) for r in got) == want


def test_word_probabilities_of_a_context_sum_to_one():
    # The context (end, a) was seen 5 times: before b 3 times and the end twice; a was seen 8 times: before b 5 times, a once and the end twice.
    low = np.array([0.4, 0.3, 0.2, 0.1])  # the end, a, b and all unseen words
    at = lambda c1, c2, c3, w: lm_scoring.word_terms(np.array([[8, c1, 9], [5, c2, 9], [0, c3, 9]]), np.array([2]), np.array([0.3, low[w], 0.4]))
    terms = [at(9, 2, 2, 0), at(8, 1, 0, 1), at(5, 5, 3, 2), at(0, 0, 0, 3)]
    assert np.isclose(sum(p3[1] for _, p3, _ in terms), 1) and np.isclose(sum(p2[1] for _, _, p2 in terms), 1)
    assert all(b[1] == 3 and b[0] == 4 for b, _, _ in terms)
    assert lm_scoring.word_terms(np.full((3, 1), 1 << 40), np.array([0]), np.ones(1))[0][0] == 41


def test_keys_of_words_and_n_grams_are_apart():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    keys = lm_scoring._grams(hashes, np.array([len(hashes) - 1]))
    assert (keys[:50_000] < 1 << 60).all() and (keys[50_000:] >= 1 << 60).all() and (keys < 1 << 63).all() and len(np.unique(keys)) == 150_000


def brute_scores(docs):
    """{doc_id: score} with plain dictionaries for everything but the classes of words."""
    import pyarrow as pa

    lists = {i: next(lm_scoring._tokens(pa.record_batch({"text": [t]})))[1:3] for i, t in docs}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in docs}
    train, deleted = [i for i in lists if fold[i] != 2], {i for i in lists if fold[i] == 3}
    words, kind = Counter(w for i in train for w in lists[i][0].tolist()), {}
    for h, k in lists.values():
        kind |= dict(zip(h.tolist(), k.tolist(), strict=True))
    by_ending = [(e, sum(n for w, n in words.items() if kind[w] == e), sum(kind[w] == e for w in words)) for e in {kind[w] for w in words}]
    common = pa.table({"word": pa.array(np.array(list(words), np.uint64).view(np.int64)), "ending": pa.array([kind[w] for w in words], pa.int32()), "n": pa.array(list(words.values()))})
    total, v = sum(words.values()), len(words)
    known = lm_scoring.Vocabulary(common, by_ending, total, v)
    end = int(lm_scoring.END)

    def events(i):
        """(word, pair, triple, context of one, of two, class events) of each token."""
        h, k = lists[i]
        classes, coarse = (x.tolist() for x in known.look(h, k))
        w = [end, end, *h.tolist()]
        c, near = [0, *classes], [0, 0, *coarse]
        for j in range(len(h)):
            yield w[j + 2], (w[j + 1], w[j + 2]), (w[j], w[j + 1], w[j + 2]), (c[j], c[j + 1]), (near[j] * lm_scoring.CONTEXT + near[j + 1], c[j + 1])

    def counted(ids):
        out = [Counter() for _ in range(5)]
        for i in ids:
            for e in events(i):
                for k, x in enumerate(e):
                    out[k][x] += 1
        starts = len(ids)
        before = Counter({end: 0})
        for (x, _), n in out[1].items():
            before[x] += n
        two = Counter()
        for (x, y, _), n in out[2].items():
            two[x, y] += n
        one_class, two_class, single = Counter(), Counter(), Counter()
        for (x, y), n in out[3].items():
            one_class[x] += n
            single[y] += n
        for (x, _), n in out[4].items():
            two_class[x] += n
        return out, before, two, one_class, two_class, single, starts

    level = lambda p, step: lm_scoring.LEVELS - 1 if p <= 0 else int(min(lm_scoring.LEVELS - 2, np.round(-step * np.log2(max(p, 1e-12)))))

    def class_terms(e, model):
        out, _, _, one, two, single, _ = model
        size = sum(single.values())
        p1 = single[e[3][1]] / size if size else 1 / lm_scoring.CLASSES
        p2 = out[3][e[3]] / one[e[3][0]] if one[e[3][0]] else p1
        p3 = out[4][e[4]] / two[e[4][0]] if two[e[4][0]] else p2
        return min(lm_scoring.BUCKETS - 1, math.ceil(math.log2(two[e[4][0]] + 1))), p3, p2, p1

    def word_terms(e, model, low):
        out, before, two = model[:3]
        p2 = out[1][e[1]] / before[e[1][0]] if before[e[1][0]] else low
        p3 = out[2][e[2]] / two[e[2][:2]] if two[e[2][:2]] else p2
        return min(lm_scoring.BUCKETS - 1, math.ceil(math.log2(two[e[2][:2]] + 1))), p3, p2

    def learned(terms, uniform, step):
        keys = Counter(((b * lm_scoring.LEVELS + level(p3, step)) * lm_scoring.LEVELS + level(p2, step)) * lm_scoring.LEVELS + level(p1, step) for b, p3, p2, p1 in terms)
        return lm_scoring.mixture(pa.table({"key": pa.array(list(keys), pa.int64()), "n": pa.array(list(keys.values()), pa.int64())}), uniform=uniform, step=step)

    def low(e, model, weights):
        b, *p = class_terms(e, model)
        share = sum(w * x for w, x in zip(weights[b], [*p, 1 / lm_scoring.CLASSES], strict=True))
        c = e[3][1]
        return share * (model[0][0][e[0]] + 1) / (model[5][c] + int(known.types[c]) + 1)

    full, rest = counted(train), counted([i for i in train if i not in deleted])
    classes = learned([class_terms(e, rest) for i in sorted(deleted) for e in events(i)], 1 / lm_scoring.CLASSES, lm_scoring.STEP)
    terms = []
    for i in sorted(deleted):
        for e in events(i):
            p1 = low(e, rest, classes)
            terms.append((*word_terms(e, rest, p1), p1))
    weights, scores = learned(terms, 1 / (v + 1), lm_scoring.WORD_STEP), {}
    for i in lists:
        scores[i] = 0
        for e in events(i):
            p1 = low(e, full, classes)
            b, p3, p2 = word_terms(e, full, p1)
            scores[i] += math.log10(sum(w * x for w, x in zip(weights[b], [p3, p2, p1, 1 / (v + 1)], strict=True)))
    return scores


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    names = [f"w{x}" if x % 3 else f"Word{x}end" for x in range(60)]
    rows = [(i, " ".join(names[int(x)] for x in np.minimum(rng.zipf(1.4, rng.integers(0, 40)), 60) - 1)) for i in range(150)] + [(1000, None), (1001, "unseen words only"), (1002, "x" * 5000 + " w1 w2")]
    got = {r.doc_id: r.score for r in lm_scoring.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").localCheckpoint()).collect()}
    want = brute_scores(rows)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) <= 1e-6 * max(1, abs(want[i])) for i in want), [(i, got[i], want[i]) for i in want if abs(got[i] - want[i]) > 1e-6][:5]


def test_odd_rows_and_names(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a b a"), (1, "a b a"), (None, "a b"), (None, "a b"), (4, None), (5, ""), (6, "word " * 200_000), (7, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "text").localCheckpoint()
    plain = sorted(map(str, lm_scoring.scores(df).collect()))
    named = df.withColumns({c: F.lit("mine") for c in ("held_out", "deleted", "block", "part", "blob", "word", "n", "score")}).localCheckpoint()
    assert sorted(map(str, lm_scoring.scores(named).collect())) == plain and len(plain) == len(rows)
    got = lm_scoring.scores(df).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(rows)


def test_patterned_words_are_two_words(spark):
    x, y = ("".join(p[bin(i).count("1") % 2] for i in range(1024)) for p in ("ab", "ba"))
    rows = [(i, x) for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(20, 99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = {r.doc_id: r.n_known for r in lm_scoring.scores(spark.createDataFrame([*rows, (held, y)], "doc_id long, text string")).collect()}
    assert got[held] == 1 and got[rows[0][0]] == 2


def test_hashes_follow_words():
    data = np.frombuffer(b"ab  cd\nab " + b"z" * 300_000 + b" ab", np.uint8)
    _, _, h, bounds = common.words(data, np.array([0, len(data)]))
    assert h[0] == h[2] == h[4] == np.uint64(common.hash_bytes(b"ab")) and len(set(h.tolist())) == 3 and bounds.tolist() == [0, 5]
    long = np.random.default_rng(2).integers(0, 2**63, 20000).astype(np.uint64)
    g = common.grams(np.concatenate([long, long[50:150]]), 30)
    assert (g[50:121] == g[20000:20071]).all() and len(np.unique(g[:20000])) == 20000
    for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 200):  # the same word in other places, and words that differ in one byte
        w = b"q" * n
        other = [w[:i] + b"r" + w[i + 1 :] for i in range(n)] + [w + b"q", w[1:] or b"z"]
        line = np.frombuffer(b" ".join([w, *other, w]), np.uint8)
        h = common.words(line, np.array([0, len(line)]))[2]
        assert h[0] == h[-1] and len(set(h.tolist())) == len(other) + 1
        assert len(set(h.tolist()) & set(common.words(line, np.array([0, len(line)]), seed=1)[2].tolist())) == 0
