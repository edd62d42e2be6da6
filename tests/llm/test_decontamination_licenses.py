import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import decontamination as dec
from weftline.llm import licenses
from weftline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_distance(item, near):
    row = [0] * (len(near) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(near, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, item, n):
    w = list(item)
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([[], ["zz%d" % rng.randrange(10**6)], [w[at], "zz%d" % rng.randrange(10**6)]])
    return w


def world(rng):
    vocabulary = ["the", "of", "and"] * 60 + ["w%d" % i for i in range(500)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    return some, [some(n) for n in (3, 9, 14, 22, 35, 60, 60, 120)]


def test_distance_equals_brute_force():
    rng = random.Random(1)
    for _ in range(100):
        item, near = [rng.randrange(4) for _ in range(rng.randint(1, 8))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        assert dec.distance(np.array(item, np.uint64), np.array(near, np.uint64)) == brute_distance(item, near)


def test_recall_at_the_tolerance_and_no_false_hits(spark):
    rng = random.Random(2)
    some, items = world(rng)
    rows, want = [], set()
    for i in range(400):
        k = rng.randrange(2, len(items))
        w = some(rng.randint(0, 80)) + edited(rng, items[k], int(dec.TOLERANCE * len(items[k]))) + some(rng.randint(0, 80))
        rows.append((i, " ".join(w).upper() + "!!"))
        want.add((i, k))
    rows += [(1000 + i, " ".join(some(200))) for i in range(100)] + [(2000, None), (2001, ""), (2002, " ".join(items[3])), (2003, items[0][0])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items) if k > 1] + [(90, None), (91, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dec.hits(df, bench).collect()}
    split = {i: (t or "").lower().replace("!!", "").split() for i, t in rows}
    for (i, k), d in got.items():
        assert d >= brute_distance(items[k], split[i]) and d <= dec.TOLERANCE * len(items[k])
    assert len(want & set(got)) >= 0.95 * len(want) and got[2002, 3] == 0
    kept = Counter(r.doc_id for r in dec.clean(df.withColumn("keep", F.lit(1)), bench).collect())
    assert kept == Counter(i for i, _ in rows) - Counter(i for i in {i for i, _ in got})
    assert dec.hits(df.limit(0), bench).count() == 0 and dec.hits(df, bench.limit(0)).count() == 0 and dec.clean(df, bench.limit(0)).count() == len(rows)


def test_recall_by_length_of_the_item():
    rng = random.Random(7)
    some, _ = world(rng)
    for n in [*range(1, 21), 24, 30]:
        items = [some(n) for _ in range(150)]
        index = dec.Index([(k, dec.plain_words(" ".join(w))) for k, w in enumerate(items)])
        docs = [dec.plain_words(" ".join(some(30) + edited(rng, w, int(dec.TOLERANCE * n)) + some(30))) for w in items]
        found = index.matches(np.concatenate(docs), np.cumsum([0] + [len(x) for x in docs]))
        caught = sum((k, k) in found for k in range(len(items)))
        assert caught == len(items) if n < dec.SEEDED else caught >= 0.95 * len(items), (n, caught)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_WORDS", 30)
    some, items = world(random.Random(3))
    df = spark.createDataFrame([(k, " ".join(some(9) + w), "en", "s", 0) for k, w in enumerate(items)], DOCS)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items) if len(w) > 8], "item_id long, text string")
    assert {(k, k) for k, w in enumerate(items) if len(w) > 8} <= {(r.doc_id, r.item_id) for r in dec.hits(df, bench).collect()}


def test_op7_finds_whole_items(spark, sf_dir):
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, sf_dir).collect()}
    assert {(i, k) for i, t in docs.items() for k, x in items.items() if x in t} <= got
    split = lambda t: [x for w in t.lower().split() if (x := "".join(c for c in w if c.isalnum() or ord(c) > 127))]
    for i, k in got:
        assert brute_distance(split(items[k]), split(docs[i])) <= dec.TOLERANCE * len(split(items[k]))


def test_edits_that_crowd_and_a_very_long_text(spark):
    rng = random.Random(17)
    some, _ = world(rng)
    items = [some(n) for n in (25, 30, 35, 40, 60) * 12]
    docs = []
    for w in items:  # all edits within one stretch of the item
        n = int(dec.TOLERANCE * len(w))
        at = rng.randrange(len(w) - n + 1)
        docs.append(some(20) + w[:at] + [f"other{rng.randrange(10**6)}" for _ in range(n)] + w[at + n :] + some(20))
    docs.append([x for w in items[:3] for x in some(100_000) + w])
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(docs)], DOCS).withColumns({c: F.lit("mine") for c in ("item_id", "distance")})
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.hits(df, bench).collect()}
    assert sum((k, k) in got for k in range(len(items))) >= 0.95 * len(items) and {(len(items), k) for k in range(3)} <= got


def brute_dice(template, text):
    pairs = lambda w: Counter(zip(w, w[1:], strict=False))
    a, w = pairs(template), text
    best = 0.0
    for i in range(len(w) - 1):
        for j in range(i + 2, min(len(w), i + 3 * len(template)) + 1):
            b = pairs(w[i:j])
            best = max(best, 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())))
    return best


def test_licences_equal_brute_force(spark):
    rng = random.Random(4)
    templates = (("A", "this work may be used by all who want this work to be used"), ("B", "all rights kept by us"), ("C", "free for all"))
    rows = []
    for i in range(120):
        w = [rng.choice("this work may be used by all rights kept free for x y z".split()) for _ in range(rng.randint(0, 12))]
        w += edited(rng, rng.choice(templates)[1].split(), rng.randint(0, 3)) + [rng.choice(["x", "all"]) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, "free"), (502, "Free,\n FOR all!")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    scanner, got = licenses.Scanner(templates), {}
    for i, t in rows:
        w = dec.plain_words(t)
        got |= {(i, templates[k][0]): round(x[0], 9) for (_, k), x in scanner.scan(w, np.array([0, len(w)])).items()}
    want = {}
    for i, t in rows:
        for name, template in templates:
            d = brute_dice(template.split(), (t or "").lower().replace(",", "").replace("!", "").split())
            if d >= licenses.DICE:
                want[i, name] = round(d, 9)
    assert got == want and (502, "C") in got
    rows_ = {(r.doc_id, r.license) for r in licenses.found(df.withColumns({"license": F.lit(1), "score": F.lit(1)}), templates).collect()}
    assert rows_ <= set(want) and {i for i, _ in rows_} == {i for i, _ in want}
    assert licenses.found(df.limit(0)).count() == 0


def test_starts_that_are_passed_over_change_nothing():
    rng = random.Random(6)
    some = ["a", "b", "c", "d", "e", "of", "the"]
    for _ in range(60):
        template = [rng.choice(some) for _ in range(rng.randint(2, 40))]
        w = [rng.choice([*some, "x", "y"]) for _ in range(rng.randint(0, 40))] + edited(rng, template, rng.randint(0, 6)) + [rng.choice([*some, "z"]) for _ in range(rng.randint(0, 30))]
        hashes = dec.plain_words(" ".join(w))
        got = licenses.Scanner([("t", " ".join(template))]).scan(hashes, np.array([0, len(hashes)])).get((0, 0), (0,))[0]
        want = brute_dice(template, w)
        assert round(got, 9) == round(want if want >= licenses.DICE else 0, 9)


def test_whole_licences_and_their_siblings(spark):
    known = dict(licenses.templates())
    names = [n for n, t in licenses.templates() if len(t.split()) > 30 and n not in {x for x, _ in licenses.NOTICES} or n in ("MIT", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "Apache-2.0", "MPL-2.0", "Unlicense")]
    names = sorted(set(names))
    assert len({n for n, _ in licenses.templates()}) >= 40 and sum(1 for _ in licenses.templates()) - len(licenses.NOTICES) >= 30
    rng = random.Random(2)
    rows = [(i, "\n".join(["# my code"] * 3) + "\n" + " ".join(edited(rng, known[n].split(), len(known[n].split()) // 200)) + "\nimport this " * 20, "en", "s", 0) for i, n in enumerate(names)]
    rows += [(900, "Licensed under CC BY-NC 4.0.", "", "", 0), (901, "This work is licensed under the GNU General Public License, version 2.", "", "", 0), (902, "see the license " * 50_000, "", "", 0), (None, "Licensed under CC BY-SA 4.0.", "", "", 0)]
    got = {}
    for r in licenses.found(spark.createDataFrame(rows, DOCS).repartition(4)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.score
    for i, n in enumerate(names):
        assert n in got[i] and got[i][n] >= 0.9, (n, got.get(i))
    assert list(got[900]) == ["CC-BY-NC-4.0"] and list(got[901]) == ["GPL-2.0"] and 902 not in got and list(got[None]) == ["CC-BY-SA-4.0"]


def test_op8_finds_notices(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.license) for r in QUERIES["op8_license_scan"](spark, sf_dir).collect()}
    for i, t in docs.items():
        for name, template in licenses.NOTICES:
            if template in t:
                assert (i, name) in got
    assert all(any(w in docs[i].lower() for w in ("licens", "permission", "redistribution", "software", "law")) for i, _ in got)


def test_other_versions_name_the_family_alone(spark):
    texts = {
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": "MPL", "This work is licensed under the GNU General Public License, version 1.": "GPL",
        "This Font Software is licensed under the SIL Open Font License, Version 1.0.": "OFL", "Licensed under the EUPL, Version 1.1 or as soon they will be approved by the European Commission subsequent versions of the EUPL": "EUPL",
        "Licensed under CC BY 3.0.": "CC-BY",
    }
    known = {n: t for n, t in reversed(licenses.NOTICES)}
    texts |= {known[n]: n for n in ("MPL-2.0", "GPL-2.0", "GPL-3.0", "OFL-1.1", "EUPL-1.2", "CC-BY-4.0", "Apache-2.0", "Apache-1.1", "MIT")}
    whole = dict(licenses.templates())["GPL-2.0"]
    texts |= {whole: "GPL-2.0", whole.replace("Version 2, June 1991", "Version 7, June 1991", 1): "GPL"}
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    got = {}
    for r in licenses.found(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, (t, name) in enumerate(texts.items()):
        assert name in got.get(i, set()) and not {n for n in got[i] if licenses.family(n) == licenses.family(name)} - {name}, (t[:80], got.get(i))


def test_licences_of_very_long_texts_and_repeated_rows(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    long = "lorem ipsum dolor sit amet " * 60_000 + notice + " consectetur" * 50_000
    rows = [(1, long, "", "", 0)] + [(2, notice, "", "", 0)] * 50 + [(3, None, "", "", 0), (4, "", "", "", 0), (None, notice, "", "", 0)]
    got = sorted(((r.doc_id, r.license, r.first_word) for r in licenses.found(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=repr)
    assert got == sorted([(1, "Apache-2.0", 300_000)] + [(2, "Apache-2.0", 0)] * 50 + [(None, "Apache-2.0", 0)], key=repr)
