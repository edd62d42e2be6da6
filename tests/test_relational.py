import pytest
from pyspark.sql import functions as F

from weftline.operators import dml, windows
from weftline.operators import relational as R


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "n")], "k int, Name string")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(2, "x", "p"), (2, "w", "q"), (3, "y", "r"), (None, "z", "s")], "K int, NAME string, extra string")


def test_joins_merge_columns_without_case(left, right):
    inner = R.joiner(left, right, "k", "INNER JOIN")
    assert inner.columns == ["k", "Name", "extra"]
    assert rows(inner) == rows_of([(2, None, "p"), (2, None, "q"), (2, "b", "p"), (2, "b", "q")])
    assert (3, None, "r") in rows(R.joiner(left, right, "k", "right"))
    full = R.joiner(left, right, {"k": "K"}, "FULL OUTER")
    assert full.count() == 8 and (3, None, "r") in rows(full)
    assert R.joiner(left, right, "k").count() == 6  # left by default
    with pytest.raises(ValueError, match="unknown join"):
        R.how_of("sideways")


def rows_of(x):
    return sorted(x, key=repr)


def test_lookup_never_multiplies(left, right):
    out = R.lookup(left, right, {"k": "K"}, {"found": "NAME", "Name": "extra"}, order=["NAME"])
    assert out.columns == ["k", "found", "Name"] and rows(out) == rows_of([(1, None, None), (2, "w", "q"), (2, "w", "q"), (None, None, None)])
    assert rows(R.matched(left, right, {"k": "K"}).select("k", "is_match")) == rows_of([(1, False), (2, True), (2, True), (None, False)])


def test_expression_shadows_and_renames(left):
    assert R.expression(left, {"NAME": "upper(Name)", "id": "k"}).columns == ["NAME", "id"]
    assert R.expression(left, {"twice": "k * 2"}).columns == ["k", "Name", "twice"]
    assert R.expression(left, {"twice": "k * 2"}, False).columns == ["twice"]


def test_router_sends_null_conditions_to_the_default(left):
    parts = R.router(left, [("a", "Name = 'a'"), ("two", "k = 2"), ("rest", None)])
    assert rows(parts["a"]) == [(1, "a")] and parts["two"].count() == 2 and rows(parts["rest"]) == [(None, "n")]


def test_aggregates_wrap_other_columns(left):
    out = R.aggregator(left, ["k"], {"k": "k", "Name": "Name", "n": "count(*)", "s": "concat('sum(', max(Name), ')')"})
    assert {r.k: (r.Name, r.n) for r in out.collect()} == {1: ("a", 1), 2: ("b", 2), None: ("n", 1)}
    assert not R.is_aggregate("concat('sum(', x, ')')") and R.is_aggregate("1 + Sum (x)")
    assert R.aggregator(left.limit(0), [], {"n": "count(*)"}).first().n == 0


def test_unions_and_explosion(left, right):
    out = R.union_all({"l": left, "r": right}, ["k", "name", "extra"], {"l": {"extra": "'none'"}})
    assert out.count() == 8 and out.columns == ["k", "name", "extra"]
    wide = left.select("k", F.lit(1).alias("a1"), F.lit(2).alias("a2"))
    assert R.normalizer(wide, 3, ["k"], {"a": ["a1", "a2"]}).filter("a is null").count() == 4
    with pytest.raises(ValueError, match="input"):
        R.union_all({}, ["k"])


def test_names():
    assert R.short_aliases(["dw.dim_account", "stg_accounts", "x"]) == {"dw.dim_account": "acco", "stg_accounts": "acco2", "x": "x"}
    assert R.match_ports(["custname", "ORDER_ID", "nothing"], ["cust_name", "o_order_id"]) == {"custname": "cust_name", "ORDER_ID": "o_order_id"}


def test_global_numbers_are_dense(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)] + [(None,)], "v int").repartition(5)
    got = windows.numbered(df, ["v"]).collect()
    assert sorted(r.row_num for r in got) == list(range(1, 102)) and next(r.row_num for r in got if r.v is None) == 1
    assert all(r.row_num == r.v + 2 for r in got if r.v is not None)
    with pytest.raises(ValueError, match="order"):
        windows.numbered(df, [])


def test_updates_and_deletes_keep_rows_of_null_conditions(left):
    assert rows(dml.update(left, {"NAME": "'z'"}, "Name > 'a'")) == rows_of([(1, "a"), (2, None), (2, "z"), (None, "z")])
    assert rows(dml.delete(left, "Name > 'a'")) == rows_of([(1, "a"), (2, None)])
    with pytest.raises(KeyError):
        dml.update(left, {"nothing": "1"})
    with pytest.raises(ValueError, match="columns"):
        dml.insert(left, left, ["k"])
    assert dml.insert(left, left.select("k"), ["K"]).filter("Name is null").count() == 5


def test_merge_branches_and_ambiguous_sources(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (3, "y"), (None, "m")], "k int, v string")
    spec = dml.Merge("k", [dml.When({"v": "s.v"})], [dml.When({"k": "s.k", "v": "s.v"})], [dml.When(None, "t.v = 'b'")])
    assert rows(dml.merge(t, s, spec)) == rows_of([(1, "x"), (3, "y"), (None, "n"), (None, "m")])
    with pytest.raises(Exception, match="several source rows"):
        dml.merge(t, s.unionByName(s), spec).collect()
    only_new = dml.Merge("k", [], [dml.When({"k": "s.k", "v": "s.v"}, "s.k > 1")])
    assert rows(dml.merge(t, s.unionByName(s), only_new)) == rows_of([(1, "a"), (2, "b"), (None, "n"), (3, "y"), (3, "y")])
    assert rows(dml.merge(t, s, dml.Merge("k", [dml.When({"v": "s.v"})], match_condition="t.v = 'zzz'"))) == rows_of([(1, "a"), (2, "b"), (None, "n")])
    assert rows(dml.merge(t, s.limit(0), spec)) == rows_of([(1, "a"), (None, "n")])
    assert rows(dml.merge(t.limit(0), s.unionByName(s), dml.Merge("k", [], [dml.When({"k": "s.k"})]))) == rows_of([(1, None), (3, None), (None, None)] * 2)


def test_scd2_and_upsert(spark):
    dim = spark.createDataFrame([(7, "a", "x", "Y"), (8, "b", "x", "Y"), (5, "a", "w", "N")], "sk long, nk string, v string, current_flg string").withColumn("effective_dt", F.lit("2000").cast("string")).withColumn("end_dt", F.lit(None).cast("string"))
    new = spark.createDataFrame([("a", "y"), ("b", "x"), ("c", None)], "nk string, v string")
    out = {(r.sk, r.nk, r.v, r.current_flg, r.end_dt) for r in dml.scd2(dim, new, ["nk"], ["v"], "'2024'").collect()}
    assert out == {(7, "a", "x", "N", "2024"), (8, "b", "x", "Y", None), (5, "a", "w", "N", None), (9, "a", "y", "Y", None), (10, "c", None, "Y", None)}
    assert dml.upsert(dim, dim.limit(1).withColumn("v", F.lit("q")), ["sk"]).count() == 3


def test_a_join_needs_keys(spark):
    df = spark.range(3)
    with pytest.raises(ValueError, match="keys"):
        R.joiner(df, df, "", "left")
    assert R.joiner(df, df.toDF("x"), "", "cross").count() == 9


def test_an_upsert_keeps_its_key_unique(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, None), (3, "e")], "k long, v string")
    assert sorted(map(tuple, dml.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert dml.upsert(old.select("k"), new.select("k"), ["k"]).count() == 3


def test_windows_need_keys(spark):
    from weftline.operators import windows

    with pytest.raises(ValueError, match="keys"):
        windows.ranked(spark.range(2), [], ["id"], {"r": "rank"})
    with pytest.raises(ValueError, match="frame"):
        windows.framed(spark.range(2), ["id"], ["id"], {"n": "count(*)"}, kind="groups")


def test_exact_sums_and_tolerance(spark):
    from weftline.operators import parity

    a = spark.createDataFrame([(i, float(i)) for i in range(2000)], "n long, x double")
    b = a.withColumn("n", F.expr("case when n = 5 then 6 when n = 6 then 5 when n = 7 then 8 when n = 8 then 7 else n end")).withColumn("x", F.expr("x + 1e-9"))
    got = {r.column_name: r for r in parity.compared(a, b).collect()}
    assert got["n"].matches and got["n"].a_exact == got["n"].b_exact == "1999000"
    c = a.withColumn("n", F.expr("case when n = 5 then 2500 when n = 1999 then 1998 when n = 6 then 5 else n end"))
    assert not {r.column_name: r.matches for r in parity.compared(a, c).collect()}["n"]


def test_a_merge_keeps_null_keys_out_of_the_join(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (None, "m")], "k long, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N"), (None, "M")], "k long, v string")
    spec = dml.Merge("k", [dml.When({"v": "s.v"})], [dml.When({"k": "s.k", "v": "s.v"})], [dml.When({"v": "upper(t.v) || '!'"}, "t.v <> 'm'")])
    got = sorted(map(tuple, dml.merge(t, s, spec).collect()), key=repr)
    assert got == sorted([(1, "A!"), (2, "B"), (3, "C"), (None, "N!"), (None, "m"), (None, "N"), (None, "M")], key=repr)
