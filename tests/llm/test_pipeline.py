import re
from collections import Counter, defaultdict

import pytest
from test_decontamination_licenses import brute_distance
from test_near_dup import brute as brute_groups
from test_sharding_dedup_mixing_tokens import filled

import corpus_pipeline
from weftline.llm import decontamination, toxicity


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents before each stage and the result of the last."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_toxic_documents_go(spark, sf_dir, stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    model = toxicity.fitted(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.scored(stages[0], model).collect()}
    assert after == Counter({x: n for x, n in before.items() if scores[x[0]] < 0.5}) and stages[1].columns == corpus_pipeline.COLUMNS


def test_one_of_each_group_stays(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    group = brute_groups([(x[0], x[1]) for x in before], 5, 80)
    assert after == Counter({x: n for x, n in before.items() if group[x[0]][1] == x[0]})


def test_contaminated_documents_go(spark, sf_dir, stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    words = lambda t: ["".join(c for c in w if c.isalnum() or ord(c) > 127) for w in (t or "").lower().split()]
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for x in before:
        text = [w for w in words(x[1]) if w]
        have = set(text)
        near = [i for i in items if sum(w in have for w in i) >= len(i) - int(decontamination.TOLERANCE * len(i))]
        held = any(brute_distance(i, text) <= int(decontamination.TOLERANCE * len(i)) for i in near)
        assert (x in after) == (not held)


def test_the_mix_repeats_and_drops(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))
    sizes, taken = Counter(), Counter()
    for x, n in before.items():
        sizes[x[3]] += n * size(x)
    for x, n in after.items():
        assert n <= 2 * before[x]
        taken[x[3]] += n * size(x)
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))})
    longest = defaultdict(int)
    for x in before:
        longest[x[3]] = max(longest[x[3]], size(x))
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)


def test_every_row_has_a_place(stages):
    rows = stages[5].collect()
    assert rows_of(stages[5]) == rows_of(stages[4])
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_and_empty_tables(spark, sf_dir, tmp_path):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.columns[:5] == corpus_pipeline.COLUMNS
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_with_equal_or_null_ids_leave_one_row(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _at string, row long"
    text = "one two three four five six seven eight nine ten"
    rows = [(7, text, "en", "a", 1, "x", 1), (7, text, "en", "b", 1, "x", 2), (None, text, "en", "a", 1, "x", 3), (7, text.upper(), "en", "a", 1, "x", 4), (8, "other " * 40_000, "en", "a", 1, "x", 5)]
    out = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, schema), sf_dir)
    assert sorted(r.doc_id for r in out.collect()) == [7, 8] and out.columns == corpus_pipeline.COLUMNS


def test_odd_rows(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    rows = [(1, None, None, None, None, "x"), (2, "", "", "", 0, "y"), (None, "a b c", "en", "s", 5, None), (4, "a b c", "en", "s", 5, None), (4, "a b c", "en", "s", 5, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() == docs.count()
