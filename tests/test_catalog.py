from pyspark.sql import functions as F

from weftline.operators import catalog, parity
from weftline.operators import relational as R
from weftline.plans import ir, scripts


def names(df):
    return sorted(r[0] for r in df.collect())


def test_heuristics_take_the_first_rule(spark):
    rows = [("RAW_STG_X", "RAW"), ("stg_x", "STAGING"), ("F_SALES", "INTEGRATION"), ("vw_x", "REPORTING"), ("members", "RAW"), ("zzz", "UNKNOWN"), (None, "UNKNOWN")]
    df = spark.createDataFrame([(n,) for n, _ in rows], "name string").withColumn("layer", catalog.layer(F.col("name")))
    assert [r.layer for r in df.collect()] == [x for _, x in rows]
    assert spark.range(1).select(catalog.tag(F.lit("fact_fee_summary")), catalog.tag(F.lit("daily_feed")), catalog.tag(F.lit("x"))).first()[:] == ("reporting", "delivery", "transformation")


def test_undocumented_search_and_digest(spark):
    f = lambda x, s: spark.createDataFrame(x, s)
    assert names(catalog.undocumented(f([("out/A.csv",), ("b.csv",), ("a.csv",)], "csv_name string"), f([("B.CSV",)], "csv_name string"))) == ["a.csv"]
    tables = f([("DW.DIM_A", "INTEGRATION"), ("DW.STG_A", "STAGING"), ("DW.B", "STAGING")], "fqn string, layer string")
    assert names(catalog.search(tables, "a", "STAGING")) == ["DW.STG_A"] and catalog.search(tables).count() == 3
    got = {tuple(r) for r in catalog.digest(tables, f([("healthy",)], "status string"), f([("warn",), ("warn",)], "severity string")).collect()}
    assert got == {("tables.integration", 1), ("tables.staging", 2), ("pipelines.healthy", 1), ("flags.warn", 2)}


def test_flags_of_tables_and_usage(spark):
    f = lambda x, s: spark.createDataFrame(x, s)
    matched = f([("p", "o.csv", True, 0, 0, 0, True), ("q", None, False, 20, 19, 1, True), ("r", None, False, 100, 97, 3, True)], "pipeline_name string, output_csv string, csv_exists boolean, runs_total long, runs_success long, runs_failed long, has_definition boolean")
    got = {tuple(r) for r in catalog.flags(f([("T", "TABLE"), ("U", "TABLE"), ("V", "VIEW")], "fqn string, kind string"), f([("U", True), ("T", False)], "table_fqn string, is_pk boolean"), matched).collect()}
    assert got == {("warn", "Table has no primary key", "T"), ("critical", "Pipeline ran without logging", "p"), ("warn", "Pipeline failure rate 5.0%", "q")}
    assert {r.pipeline_name: (r.status, r.success_rate) for r in catalog.pipeline_usage(matched).collect()} == {"p": ("off-grid", 0.0), "q": ("failing", 95.0), "r": ("failing", 97.0)}


def test_parity_of_odd_tables(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, "x")], "k int, v double, s string")
    status = lambda x, y: parity.verdict(parity.compared(x, y), "t").first().status
    assert status(a, a) == "match" and status(a, a.limit(0)) == "drift" and status(a.limit(0), a.limit(0)) == "match"
    assert status(a, a.withColumn("v", F.col("v") + 1e-9)) == "drift"  # least and greatest are compared as they are
    assert status(a, a.withColumn("k", F.col("k").cast("double"))) == "match" and status(a, a.drop("s")) == "drift"
    assert {r.status for r in parity.verified({"x": (a, a, "oracle_origin"), "y": (a, None, "bq_derived")}, spark).collect()} == {"match", "missing_in_target"}


def test_copy_and_ddl(spark, tmp_path):
    (tmp_path / "f.csv").write_text("V,k\nx,2\n,3\n")
    t = spark.createDataFrame([(1, "a", 0.5)], "k int, v string, w double")
    out = scripts.bteq(f"COPY INTO stg.t FROM '{tmp_path}/f.csv' FILE_FORMAT = (TYPE = 'CSV');\nDELETE FROM stg.t WHERE k = 3;").run(ir.Context(spark, lambda n: {"t": t}[n]))
    assert sorted(map(tuple, out["t"].collect())) == [(1, "a", 0.5), (2, "x", None)]
    assert R.ddl_of(t, "t") == "CREATE TABLE `t` (\n  `k` int,\n  `v` string,\n  `w` double\n)"
    R.registered(spark, "one_view", "SELECT 1 AS x")
    assert spark.table("one_view").count() == 1 and R.dropped(spark, "one_view")
