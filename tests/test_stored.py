import glob
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from weftline.operators import dml, parity, stored, targets
from weftline.queries_stored import _closed, _database
from weftline.sources import jdbc
from weftline.streaming import cdc


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["k"]
    base = spark.range(2000).selectExpr("id AS k", "'old' AS v")
    stored.created(base, path, keys, 16)
    before = files(path)
    new = spark.createDataFrame([(5, "new"), (5, "newer"), (9999, "new"), (None, "null key")], "k long, v string")
    done = stored.upserted(spark, path, new, keys)
    after = files(path)
    assert rows(stored.current(spark, path)) == rows(dml.upsert(base, new, keys))
    kept = {f for f, t in before.items() if after.get(f) == t}
    touched = {f.split("/_bucket_of_16=")[1].split("/")[0] for f in set(after) - set(before)}
    assert len(touched) == done <= 3 and {f for f in before if f.split("=")[1].split("/")[0] not in touched} == kept
    assert stored.upserted(spark, path, new.limit(0), keys) == 0 and files(path) == after
    stored.upserted(spark, path, new.filter("k is not null"), keys)  # again, as after a failure
    assert rows(stored.current(spark, path)) == rows(dml.upsert(base, new, keys))


def test_keys_are_found_whatever_their_type(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.created(spark.range(50).selectExpr("id AS k", "0 AS v"), path, ["k"], 8)
    stored.upserted(spark, path, spark.createDataFrame([("7", 1)], "k string, v int").select(F.col("k").cast("int").alias("k"), "v"), ["k"])
    assert stored.current(spark, path).filter("v = 1").select("k").collect() == [(7,)] and stored.current(spark, path).count() == 50


def test_merges_delete_whole_buckets_and_reach_rows_without_a_counterpart(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(i, i % 3) for i in range(40)] + [(None, 5)], "k int, v int")
    stored.created(base, path, ["k"], 32)
    gone = dml.Merge({"k": "id"}, [dml.When(None)], [])
    source = base.filter("k is not null").selectExpr("k AS id")
    stored.merged(spark, path, source, gone)
    assert rows(stored.current(spark, path)) == [(None, 5)]  # buckets that lost all rows are gone, not left as they were
    stored.created(base, path, ["k"], 32)
    spec = dml.Merge({"k": "id"}, [dml.When({"v": "s.w"}, "s.w > 1")], [dml.When({"k": "s.id", "v": "s.w"})], [dml.When({"v": "-1"})])
    source = spark.createDataFrame([(1, 9), (2, 0), (100, 7), (None, 8)], "id int, w int")
    stored.merged(spark, path, source, spec)
    assert rows(stored.current(spark, path)) == rows(dml.merge(base, source, spec))
    with pytest.raises(Exception, match="bucket that it hasn't read"):
        stored.merged(spark, path, spark.createDataFrame([(1000 + i, 0) for i in range(3)], "id int, w int"), dml.Merge({"k": "id"}, [], [dml.When({"k": "s.id * 7 + 3", "v": "0"})]))


def test_merge_scans_each_side_once(spark, tmp_path):
    spark.range(5).selectExpr("id AS k", "0 AS v").write.parquet(str(tmp_path / "a"))
    spark.range(3, 9).selectExpr("id AS k", "1 AS v").write.parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    out = dml.merge(a, b, dml.Merge("k", [dml.When({"v": "s.v"})], [dml.When({"k": "s.k", "v": "s.v"})]))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    assert rows(out) == [(0, 0), (1, 0), (2, 0)] + [(i, 1) for i in range(3, 9)]


def test_older_changes_in_later_batches_are_passed_over(spark, tmp_path):
    stored.created(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(tmp_path / "t"), ["k"], 4)
    kind = "k int, v string, at timestamp, n int, action string"
    when = lambda h: f"2024-01-01 {h:02}:00:00"
    batches = [
        [(1, "new", when(9), 0, "UPDATE"), (2, None, when(9), 0, "DELETE"), (3, "x", when(9), 1, "INSERT")],
        [(1, "older", when(8), 0, "UPDATE"), (2, "older", when(3), 0, "UPDATE"), (3, "tie", when(9), 0, "UPDATE"), (5, "no time", None, 0, "INSERT")],
        [(1, None, when(10), 0, "DELETE"), (3, "last", when(9), 2, "UPDATE"), (1, "older", when(9), 5, "UPDATE")],
    ]
    for i, b in enumerate(batches):
        at = str(tmp_path / f"in/{i}")
        spark.createDataFrame([(k, v, t, n, a) for k, v, t, n, a in b], "k int, v string, at string, n int, action string").withColumn("at", F.col("at").cast("timestamp")).select("k", "v", "at", "n", "action").coalesce(1).write.parquet(at)
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        cdc.follow_stored(stream, str(tmp_path / "t"), ["k"], "at", str(tmp_path / "log"), late="1 day", ties=["n"]).awaitTermination()
    assert rows(stored.current(spark, str(tmp_path / "t"))) == [(3, "last")]


def test_only_changes_of_one_time_are_sorted(monkeypatch):
    import pandas as pd

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, mark):
            self.exists, self.get = True, mark

        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

        def setTimeoutTimestamp(self, at):  # noqa: N802
            self.at = at

    run, state = cdc._newest(["_at", "n"], ["v"]), State()
    frame = lambda *rows: pd.DataFrame(rows, columns=["v", "_at", "n"])
    assert [f.v.tolist() for f in run((1,), iter([frame(("a", 5000, 0.5), ("b", 7000, 0.5), ("c", 7000, 2.5), ("d", 7000, 1.5))]), state)] == [["c"]]
    assert state.get == (7000, 2.5) and list(map(type, state.get)) == [int, float] and state.at == 8
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    assert [f.v.tolist() for f in run((1,), iter([frame(("e", 6000, 9.5)), frame(("f", 9000, 0.5), ("g", 8000, 3.5))]), state)] == [["f"]]
    assert list(run((1,), iter([frame(("h", 8999, 9.5))]), state)) == [] and state.get == (9000, 0.5)


def test_scans_are_split_and_filters_reach_the_database(spark):
    url = _database(spark)
    try:
        jdbc.put(spark.range(100).selectExpr("id AS k", "id * 2.5 AS amount", "cast(cast(id as string) as binary) AS raw", "if(id < 50, 'a', 'b') AS kind"), url, "things", {"kind": "VARCHAR(4)"})
        df = jdbc.scan(spark, url, "things", '"k"', 4)
        assert df.rdd.getNumPartitions() == 4 and df.count() == 100
        some = df.filter("amount > 200 AND kind = 'b'").select("k")
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(amount" in plan and "EqualTo(kind,b)" in plan and rows(some) == [(i,) for i in range(81, 100)]
        assert jdbc.scan_by(spark, url, "things", ["\"kind\" = 'a'", "\"kind\" <> 'a'"]).rdd.getNumPartitions() == 2
        assert jdbc.first_rows(spark, url, "things", 7).count() == 7
        with pytest.raises(ValueError, match="bounds can't split"):
            jdbc.scan(spark, url, "things", '"kind"', 4)
        tables, columns = jdbc.dictionary(spark, url, "derby")
        assert [r.table_name.lower() for r in tables.filter("schema_name = 'APP'").collect()] == ["things"]
        assert [r.column_name for r in columns.filter("schema_name = 'APP'").orderBy("position").collect()] == ["k", "amount", "raw", "kind"]
    finally:
        _closed(spark, url)


def test_a_schema_is_replicated_table_by_table(spark, tmp_path):
    url = _database(spark)
    try:
        jdbc.put(spark.range(20).selectExpr("id AS k", "cast('ab' as binary) AS raw"), url, "one")
        jdbc.put(spark.range(3).selectExpr("id AS k"), url, "two")
        jdbc.put(spark.range(0).selectExpr("id AS k"), url, "nothing")
        names = jdbc.replicate(spark, url, "derby", "app", str(tmp_path), {"one": '"k"', "nothing": '"k"'}, 3)
        assert sorted(n.lower() for n in names) == ["nothing", "one", "two"]
        assert rows(spark.read.parquet(str(tmp_path / "one"))) == sorted([(i, "6162") for i in range(20)], key=repr)
        assert spark.read.parquet(str(tmp_path / "two")).count() == 3 and spark.read.parquet(str(tmp_path / "nothing")).count() == 0
    finally:
        _closed(spark, url)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_targets_of_one_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "if(id = 4, null, id > 6) AS big").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    parts = {"big": ("big", {"id": "id"}), "all": (None, {"id": "cast(id as string)", "twice": "id * 2"}), "none": ("id > 99", {"twice": "id * 2"})}
    out = targets.split_written(df, parts, str(tmp_path / "out"))
    assert rows(out["big"]) == [(7,), (8,), (9,)] and out["none"].count() == 0 and out["none"].columns == ["twice"]
    assert rows(out["all"]) == sorted([(str(i), 2 * i) for i in range(10)], key=repr) and out["all"].dtypes == [("id", "string"), ("twice", "bigint")]


def test_a_write_brings_its_checks(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(1, "a"), (1, None), (2, None), (None, "c"), (None, "d")], "k int, v string").mapInPandas(counted, "k int, v string")
    got = rows(targets.checked_write(df, str(tmp_path / "t"), ["k"], ["k", "v"]))
    assert got == rows(spark.createDataFrame([("rows", None, 5), ("nulls", "k", 2), ("nulls", "v", 2), ("repeated keys", "k", 2)], "a string, b string, c long"))
    assert seen.value == 5  # computed once
    got = rows(targets.checked_write(df.limit(0), str(tmp_path / "none"), ["k"], ["k"]))
    assert got == rows(spark.createDataFrame([("rows", None, 0), ("nulls", "k", 0), ("repeated keys", "k", 0)], "a string, b string, c long"))


def test_a_stored_table_is_joined_where_it_lies(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:8]}"
    made = targets.stored_table(spark.range(500).selectExpr("id % 50 AS k", "id AS v").groupBy("k").agg(F.max("v").alias("v")), name, str(tmp_path / "t"), ["k"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = made.join(spark.range(100).withColumnRenamed("id", "k"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        side = plan[: plan.index("FileScan")]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in side.rsplit("Sort [k", 1)[-1]
        assert joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_profile_is_one_scan_and_one_exchange_of_values(spark, tmp_path):
    data = [(1, 1.5, "a", None, b"x"), (2, -0.0, "b", "2024-01-01", None), (2, 0.0, None, "2024-01-02", b"x"), (None, float("nan"), "a", "2024-01-02", b"y")]
    df = spark.createDataFrame(data, "i int, x double, s string, t string, raw binary").withColumn("t", F.col("t").cast("date")).withColumn("d", F.col("i").cast("decimal(10,2)") / 4).withColumn("l", F.array("i", F.lit(1)))
    df.write.parquet(str(tmp_path / "t"))
    out = parity.profile(spark.read.parquet(str(tmp_path / "t")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(position") == 2  # values, then a row for each column
    got = {r.column_name: r for r in out.collect()}
    assert {c: (r.row_count, r.nulls, r.distincts) for c, r in got.items()} == {"i": (4, 1, 2), "x": (4, 0, 3), "s": (4, 1, 2), "t": (4, 1, 2), "raw": (4, 1, 2), "d": (4, 1, 2), "l": (4, 0, 3)}
    assert (got["i"].total, got["i"].exact, got["i"].low, got["i"].high) == (5.0, "5", 1.0, 2.0) and got["d"].exact.rstrip("0") == "1.25" and (got["s"].low_text, got["s"].high_text) == ("a", "b")
    empty = {r.column_name: (r.row_count, r.nulls, r.distincts) for r in parity.profile(spark.read.parquet(str(tmp_path / "t")).limit(0)).collect()}
    assert empty == dict.fromkeys(got, (0, 0, 0))


def test_a_routers_targets_are_written_in_one_pass(spark, tmp_path):
    from weftline.plans import ir

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    orders = spark.range(30).selectExpr("id", "if(id = 3, null, id % 7) AS size").mapInPandas(counted, "id long, size long")
    g = ir.Graph("g", [
        ir.Source("s", table="orders"), ir.Router("r", "s", [("big", "size > 4"), ("rest", None)]),
        ir.Target("large", "r.big", {"id": "id", "twice": "size * 2"}), ir.Target("others", "r.rest", later={"note": "string"}),
        ir.Source("again", sql="SELECT count(*) AS n, max(note) AS note FROM others", reads=["others"]),
    ])
    made = g.run(ir.Context(spark, lambda _: orders, stages=str(tmp_path)))
    assert rows(made["large"]) == sorted([(i, i % 7 * 2) for i in range(30) if i != 3 and i % 7 > 4], key=repr)
    assert made["others"].columns == ["id", "size", "note"] and made["others"].filter("id = 3").count() == 1
    assert tuple(made["again"].first()) == (30 - made["large"].count(), None) and seen.value == 30


def test_repeated_targets_keep_their_types(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1})], "k int, l array<int>, m map<string, int>")
    out = targets.split_written(df, {"a": (None, {"k": "k", "l": "l"}), "b": ("k = 1", {"k": "cast(k as double)", "m": "m"})}, str(tmp_path / "t"))
    assert out["a"].dtypes == [("k", "int"), ("l", "array<int>")] and rows(out["a"]) == [(1, [1, 2])] and out["b"].first().m == {"a": 1}


def test_loaded_rows_are_whole_in_a_sealed_database(spark, tmp_path):
    rows_in = [(1, 'a "b", c', None, b"\x01\xff"), (2, "", 1.5e10, None), (3, None, -0.25, b""), (4, "line\none ", 0.0, b"x"), (5, " \\", 2.0, b"y")]
    df = spark.createDataFrame(rows_in, "k int, s string, x double, raw binary").withColumn("at", F.expr("timestamp'2024-01-02 03:04:05.000006' + make_interval(0, 0, 0, k)")).withColumn("day", F.to_date("at")).withColumn("n", (F.col("k") / 8).cast("decimal(12,3)"))
    folder = str(tmp_path / "a b")
    os.makedirs(folder)
    for again in ("things", "others"):
        jdbc.loaded(df.repartition(3), f"jdbc:derby:{folder}/live;create=true", again, f"{folder}/{again}", {"s": "VARCHAR(20)"})
    jdbc.loaded(df.filter("k > 9"), f"jdbc:derby:{folder}/live;create=true", "nothing", f"{folder}/nothing", {"s": "VARCHAR(20)"})
    url = jdbc.sealed(spark, folder, "live")
    try:
        assert rows(jdbc.scan(spark, url, "things", '"k"', 3)) == rows(df) == rows(jdbc.scan(spark, url, "others"))
        assert jdbc.scan(spark, url, "nothing", '"k"').count() == 0
    finally:
        _closed(spark, url)


CLUSTER = """
import sys
from pyspark.sql import SparkSession
from weftline import queries
import weftline.queries_stored
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.executor.memory", "600m").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
for name in ("jdbc_dictionary", "jdbc_replication"):
    print(name, sorted(map(tuple, queries.QUERIES[name](spark, sys.argv[1]).collect())))
spark.stop()
"""


def test_databases_are_reached_from_every_executor(spark, sf_dir, tmp_path):
    from weftline import queries

    ours = os.path.dirname(os.path.dirname(os.path.abspath(stored.__file__)))
    path = os.pathsep.join(p for p in (os.path.dirname(ours), os.environ.get("PYTHONPATH")) if p)
    out = subprocess.run([sys.executable, "-c", CLUSTER, sf_dir, str(tmp_path)], env=os.environ | {"PYTHONPATH": path}, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    got = [line for line in out.stdout.splitlines() if line.startswith("jdbc_")]
    assert got == [f"{name} {sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).collect()))}" for name in ("jdbc_dictionary", "jdbc_replication")], out.stderr[-2000:]
