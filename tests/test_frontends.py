import pytest
from pyspark.sql import functions as F

from weftline import queries
from weftline.functions import dialect, naming, types
from weftline.operators import catalog
from weftline.plans import ir, lineage, scripts, sqltext, ssis, xml_frontend
from weftline.sources import ddl, readers
from weftline.streaming import cdc


def context(spark, **views):
    return ir.Context(spark, lambda n: views[n])


def test_pipeline_with_statements_between_loads(spark):
    text = """<pipeline name="p"><connection/><steps>
      <extract_csv id="c" path="s3://x/rates.csv"/>
      <transform id="t" input="c"><math operation="divide" col1="a" col2="b" result_column="q"/><calculate_category column="q" low="1" high="2" result_column="cat"/><filter condition="a &gt; 0"/><sort columns="a"/></transform>
      <load id="l1" input="t" type="oracle" table="stg_rates"/>
      <execute_sql id="u"><query>UPDATE stg_rates SET is_done = (1 = 1), q = NVL(q, 0) WHERE cat = 'medium'; DELETE FROM stg_rates WHERE a = 9</query></execute_sql>
      <extract id="again"><query>SELECT cat, q, is_done FROM stg_rates</query></extract>
      <aggregate id="g" input="again" group_by="cat"><count/><sum column="q" result_column="total"/></aggregate>
      <load id="l2" input="g" type="csv" path="out/final.csv"/></steps></pipeline>"""
    p = xml_frontend.parse(text)
    assert p.sources == ["rates"] and p.targets == ["stg_rates", "final"]
    assert xml_frontend.used_columns(p.steps) == {"c": ["a", "b"]}
    rates = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (5.0, 0.0), (0.0, 1.0), (9.0, 1.0)], "a double, b double")
    out = xml_frontend.run(p, context(spark, rates=rates))
    assert sorted((r.cat, r.COUNT_all, r.total) for r in out["final"].collect()) == [("low", 1, 0.5), ("medium", 2, 1.5)]
    assert {r.is_done for r in out["stg_rates"].filter("cat = 'medium'").collect()} == {True}


@pytest.mark.parametrize("bad", ["<math operation='root' col1='a' val2='1' result_column='x'/>", "<simulate_performance/>"])
def test_operations_without_meaning_are_errors(bad):
    with pytest.raises(ValueError, match="operation"):
        xml_frontend.parse(f"<pipeline><steps><extract_csv id='c' path='a.csv'/><transform id='t' input='c'>{bad}</transform></steps></pipeline>")


def test_graphs_check_their_inputs():
    with pytest.raises(ValueError, match="nothing makes"):
        ir.Graph("g", [ir.Filter("f", "nowhere")]).ordered()
    with pytest.raises(ValueError, match="cycle"):
        ir.Graph("g", [ir.Filter("a", "b"), ir.Filter("b", "a")]).ordered()
    g = ir.Graph("g", [ir.Filter("b", "a"), ir.Source("a", table="t")])
    assert [n.name for n in g.ordered()] == ["a", "b"] and g.edges() == [("a", "b")]


def test_nodes_and_variables(spark):
    t = spark.createDataFrame([(1, 10, 20), (2, 30, 40)], "id int, m1 int, m2 int")
    g = ir.Graph("g", [
        ir.Source("s", table="t", where="id >= $$low"), ir.Normalizer("n", "s", 2, ["id"], {"m": ["m1", "m2"]}), ir.Sequence_("k", "n", "sk", ["id", "idx"]),
        ir.Router("r", "k", [("odd", "id = 1"), ("rest", None)]), ir.Union("u", ["r.odd", "r.rest"], ["sk", "m"]), ir.Aggregator("a", "u", [], {"total": "sum(m)", "top": "max(sk)"}),
    ])
    ctx = ir.Context(spark, lambda n: t, {"low": "1"})
    assert tuple(g.run(ctx)["a"].first()) == (100, 4)
    with pytest.raises(KeyError):
        naming.filled("$$x", {})


def test_scripts_keep_notes_and_order(spark):
    s = scripts.bteq(queries.BTEQ)
    assert s.targets == ["cust_orders", "customer_dim"] and "drop work.cust_orders" in s.notes and ".logon" in s.notes
    p = scripts.task_pipeline(queries.TASKS)
    assert p.order() == ["t_delta", "t_enrich"] and p.tasks["t_enrich"].after == ["t_delta"] and p.tasks["t_delta"].schedule == "30 MINUTE"
    assert p.streams["customer_cdc"].initial_rows and len(p.procedures["SP_ENRICH"]) == 2
    assert [tuple(r) for r in p.edges(spark).collect()] == [("t_delta", "t_enrich")]
    p.tasks["t_delta"].after.append("t_enrich")
    with pytest.raises(ValueError, match="cycle"):
        p.order()
    package = ssis.parse(queries.DTSX)
    assert package.targets == ["big_orders", "stg_orders"] and package.types["o_totalprice"] == "r8" and [type(n).__name__ for n in package.graph.nodes] == ["Source", "Target", "Lookup", "Expression", "Router", "Target"]


def test_stream_rows(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "x"), (4, None)], "k int, v string")
    got = {tuple(r) for r in scripts.stream_frame(old, new, ["k"]).collect()}
    assert got == {(2, "b", "DELETE", True), (2, "x", "INSERT", True), (3, "c", "DELETE", False), (4, None, "INSERT", False)}


def test_statements():
    text = "INSERT INTO a.t (x, y) SELECT b.x, ';' FROM s.b b, c JOIN d ON d.k = c.k -- end;\n; DELETE FROM t WHERE x IN (SELECT x FROM u);;\n MERGE INTO t USING (SELECT * FROM v) s ON t.k = s.k WHEN MATCHED THEN DELETE"
    a, b, c = map(sqltext.classify, sqltext.statements(text))
    assert (a.kind, a.target, a.sources, a.columns) == ("insert", "a.t", ["s.b", "c", "d"], ["x", "y"])
    assert (b.kind, b.target, b.sources) == ("delete", "t", ["u"]) and (c.kind, c.target, c.sources) == ("merge", "t", ["v"])
    assert sqltext.classify("WITH q AS (SELECT 1 FROM r) SELECT * FROM q, z").sources == ["r", "z"]
    assert sqltext.select_items("SELECT DISTINCT a.x, sum(a.y) total, CASE WHEN z = 1 THEN 2 END AS k, (SELECT max(q) FROM w) m FROM a") == [("x", "a.x"), ("total", "sum(a.y)"), ("k", "CASE WHEN z = 1 THEN 2 END"), ("m", "(SELECT max(q) FROM w)")]
    assert sqltext.columns_in("coalesce(a.x, 'b.c') + y") == [("a", "x"), (None, "y")]


def test_dialect_text(spark):
    one = spark.createDataFrame([(5, None, "2024-03-15 10:20:30", "ab cd")], "n int, z string, t string, w string").withColumn("d", F.to_timestamp_ntz("t"))
    cases = {
        "NVL(z, 'x')": "x", "TO_CHAR(d, 'yyyymmdd hh24:mi')": "20240315 10:20", "TRUNC(7.89, 1)": 7.8, "SUBSTR(w, 0, 2)": "ab", "INSTR(w, 'c')": 4, "CASE WHEN n <> NULL THEN 'set' END": "set",
        "DATEDIFF(mm, d, DATEADD(mm, 3, d))": 3, "REGEXP_SUBSTR(w, '[^ ]+', 1, 2)": "cd", "ISNULL(z, ISNULL(z, 'deep'))": "deep", "IS_NUMERIC(' 4 ')": True, "DECODE(n, 5, 'five', 'no')": "five", "CHARINDEX('b', w) + LEN(w)": 7,
        "CASE WHEN n = NULL THEN 1 ELSE 2 END": 2, "SAFE_DIVIDE(n, 0)": None, "concat('SYSDATE', 'NVL(a)')": None,
    }
    for text, want in list(cases.items())[:-1]:
        got = one.select(F.expr(dialect.expression(text)).alias("v")).first().v
        assert (float(got) if isinstance(want, float) else got) == want, text
    assert dialect.expression('a == "x" && b != 1 ? "p" : (c ? "q" : "r")', "ssis") == "CASE WHEN a = 'x'  AND  b <> 1 THEN 'p' ELSE(CASE WHEN c THEN 'q' ELSE 'r' END) END"
    assert dialect.expression('F + " " + L', "ssis", frozenset({"F", "L"})) == "concat(F, ' ', L)"
    assert dialect.query("SELECT a FROM t WHERE ROWNUM <= 5 AND b = NULL;") == "SELECT a FROM t WHERE b IS NULL LIMIT 5"
    assert dialect.type_name("NUMBER(10, 2)") == "decimal(10,2)" and dialect.type_name("varchar2(20)") == "string" and dialect.date_format("DD-MON-YYYY HH24:MI:SS") == "dd-MMM-yyyy HH:mm:ss"


def test_types_and_names():
    s = lambda x: types.spark_type(x).simpleString()
    assert [s(x) for x in ("NUMBER", "NUMBER(8)", "NUMBER(18,0)", "NUMBER(20)", "NUMBER(18,2)", "DATE", "TIMESTAMP(6)", "TIMESTAMP WITH TIME ZONE", "RAW(16)", "VARCHAR2(20 CHAR)", "odd")] == ["decimal(38,10)", "int", "bigint", "decimal(20,0)", "decimal(18,2)", "timestamp_ntz", "timestamp_ntz", "timestamp", "binary", "string", "string"]
    assert [types.guessed(c).simpleString() for c in ("is_x", "a_date", "b_at", "fee_rate", "c_id", "z")] == ["boolean", "date", "timestamp_ntz", "double", "bigint", "string"]
    assert (naming.pascal("dim_member x"), naming.snake("MemberNo 1"), naming.identifier("1 a-b"), naming.without_number("01_X")) == ("DimMemberX", "member_no_1", "_1_a_b", "x")
    assert naming.is_placeholder(":x") and naming.is_placeholder("?") and not naming.is_placeholder("x")


DDL = """-- tables
CREATE TABLE dw.dim_c (c_sk NUMBER(18) PRIMARY KEY, name VARCHAR2(50) NOT NULL, note VARCHAR2(10) DEFAULT 'a,(b');
CREATE TABLE fact (f_sk NUMBER(18), c_sk NUMBER(18) REFERENCES dw.dim_c(c_sk), amt NUMBER(18,2), CONSTRAINT pk PRIMARY KEY (f_sk), FOREIGN KEY (amt) REFERENCES dw.rates (r));
CREATE OR REPLACE VIEW dw.v AS SELECT c.name AS who, f.amt * 2 AS twice, f.* FROM fact f JOIN dw.dim_c c ON c.c_sk = f.c_sk;"""


def test_ddl_and_catalog(spark):
    tables = ddl.parse(DDL)
    t, c = ddl.frames(spark, tables)
    got = {(r.table_fqn, r.name): r for r in c.collect()}
    assert {r.fqn: r.kind for r in t.collect()} == {"DW.DIM_C": "TABLE", "MAIN.FACT": "TABLE", "DW.V": "VIEW"}
    assert got["DW.DIM_C", "C_SK"].is_pk and not got["DW.DIM_C", "NAME"].nullable and got["DW.DIM_C", "NOTE"].data_type == "VARCHAR2(10)"
    assert got["MAIN.FACT", "F_SK"].is_pk and got["MAIN.FACT", "C_SK"].fk_target == "DW.DIM_C.C_SK" and got["MAIN.FACT", "AMT"].fk_target == "DW.RATES.R" and got["MAIN.FACT", "AMT"].data_type == "NUMBER(18,2)"
    edges = {(e[0], e[1], e[3]) for e in lineage.view_edges("DW.V", tables[2].text)}
    assert edges == {("DW.DIM_C", "name", "who"), ("SOURCE.FACT", "amt", "twice"), ("SOURCE.FACT", "*", "*"), ("DW.DIM_C", "*", "*")} or {("DW.DIM_C", "name", "who"), ("SOURCE.FACT", "amt", "twice")} <= edges
    assert {r.name: r.s for r in c.select("name", catalog.sensitivity(F.lower("name")).alias("s")).collect()}["AMT"] == "FINANCIAL"


def test_pipeline_lineage(spark):
    p = xml_frontend.parse(queries.FLAGSHIP_XML)
    edges = lineage.frame(spark, lineage.pipeline_edges(p))
    by = {(r.source_fqn.rpartition(".")[2], r.source_column, r.target_fqn.rpartition(".")[2], r.target_column, r.operation) for r in edges.collect()}
    assert {("ORDERS", "o_totalprice", "ord", "o_totalprice", "extract"), ("CUSTOMER", "c_custkey", "cust", "o_custkey", "extract"), ("ord", "o_custkey", "j", "o_custkey", "join"), ("j", "o_totalprice", "t", "gross", "transform"), ("j", "c_mktsegment", "t", "bucket", "transform"), ("t", "bucket", "a", "bucket", "aggregate"), ("t", "gross", "a", "top_gross", "aggregate"), ("a", "n", "SEGMENT_REVENUE", "n", "load")} <= by
    assert not any(b[3] == "c_nationkey" and b[2] == "t" for b in by)
    df = spark.range(3).selectExpr("id as a", "id * 2 as b").selectExpr("a + b as c", "b").unionByName(spark.range(1).selectExpr("id as c", "id as b"))
    assert lineage.plan_columns(df) == {"c": ["id"], "b": ["id"]}


def test_files_and_writers(spark, tmp_path):
    path = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    for name, text in (("a.csv", "x,y\n1,\n2,b\n"), ("dba_segments.csv", "o\n"), ("p.xml", "<a/>"), ("awr_1.txt", "q"), ("t.sql", "--")):
        (tmp_path / "in" / name).write_text(text)
    files = readers.listing(spark, path)
    assert {r.path.rpartition("/")[2]: r.kind for r in files.collect()} == {"a.csv": "output", "dba_segments.csv": "dictionary", "p.xml": "etl", "awr_1.txt": "awr", "t.sql": "ddl"}
    kinds, first = readers.preview(files, 2)
    assert kinds.count() == 5 and first.count() == 2
    assert readers.csv_header(spark, f"{path}/a.csv") == (["x", "y"], 2) and readers.csv(spark, f"{path}/a.csv", upper=True).columns == ["X", "Y"]
    lines = spark.createDataFrame([("o", "n", "P", 2, "b"), ("o", "n", "P", 10, "c"), ("o", "n", "P", 1, "a")], "owner string, name string, type string, line int, text string")
    assert readers.source_text(lines).first().source == "abc"
    df = spark.createDataFrame([(bytearray(b"\x01\xff"), 1)], "b binary, n int")
    assert readers.replicated(df, 1).first().b == "01FF"
    out = readers.refreshed(spark, df, str(tmp_path / "t"), "t_view")
    assert out.count() == spark.table("t_view").count() == 1
    readers.write(df.select("n"), str(tmp_path / "c"), "csv")
    assert readers.csv(spark, str(tmp_path / "c")).first().n == "1"


def test_inventory(spark):
    f = spark.createDataFrame
    t, c = readers.inventory(
        f([("O", "T", "TABLE")], "owner string, table_name string, kind string"), f([("O", "T", 10, 5, "2020"), ("O", "T", 20, 5, "2021")], "owner string, segment_name string, bytes long, num_rows long, last_analyzed string"),
        f([("O", "T", "A", "NUMBER", "N"), ("O", "T", "B", "DATE", "Y")], "owner string, table_name string, column_name string, data_type string, nullable string"), f([("O", "T", "A")], "owner string, table_name string, column_name string"),
        f([("O", "T", "B", "O", "R", "K")], "owner string, table_name string, column_name string, r_owner string, r_table string, r_column string"),
    )
    assert (t.first().bytes, t.first().last_analyzed) == (30, "2021")
    assert {r.column_name: (r.is_pk, r.is_fk, r.fk_target) for r in c.collect()} == {"A": (True, False, None), "B": (False, True, "O.R.K")}


def test_changes_as_a_stream(spark, tmp_path):
    target, at = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), tmp_path / "table_0"
    target.write.parquet(str(at))
    state = {"path": str(at)}
    changes = spark.createDataFrame([(1, "x", 1, "UPDATE"), (1, "y", 2, "UPDATE"), (2, None, 1, "DELETE"), (3, "n", 1, "INSERT")], "k int, v string, at long, action string").withColumn("at", F.timestamp_seconds("at"))
    changes.coalesce(1).write.parquet(str(tmp_path / "changes"))

    def write(df, number):
        path = str(tmp_path / f"table_{number + 1}")
        df.write.mode("overwrite").parquet(path)
        state["path"] = path

    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "changes"))
    cdc.follow(stream, lambda: spark.read.parquet(state["path"]), write, ["k"], "at", str(tmp_path / "log")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(state["path"]).collect())) == [(1, "y"), (3, "n")]


def test_rewrites_leave_literals_alone():
    same = "note = 'a = NULL' AND word = 'SYSDATE' AND q = \"b = NULL\""
    assert dialect.expression(same) == same
    assert dialect.null_tests("a = NULL OR b = '= NULL'") == "a IS NULL OR b = '= NULL'"
    assert dialect.query("SELECT 'ROWNUM <= 3' AS a FROM t") == "SELECT 'ROWNUM <= 3' AS a FROM t"


def test_limits_stay_in_their_select():
    q = dialect.query
    assert q("SELECT x FROM (SELECT x FROM t WHERE ROWNUM <= 10) q ORDER BY x").replace("FROM(", "FROM (") == "SELECT x FROM (SELECT x FROM t LIMIT 10) q ORDER BY x"
    assert q("SELECT x FROM t WHERE a = 1 AND ROWNUM < 3 ORDER BY x") == "SELECT * FROM (SELECT x FROM t WHERE a = 1 LIMIT 2) ORDER BY x"
    assert q("SELECT x FROM t UNION ALL SELECT x FROM u WHERE ROWNUM = 1").split() == "SELECT x FROM t UNION ALL (SELECT x FROM u LIMIT 1)".split()
    with pytest.raises(ValueError, match="ROWNUM"):
        q("SELECT x FROM t WHERE ROWNUM <= 3 OR x = 1")


def test_old_outer_joins_of_both_directions():
    got = dialect.query("SELECT 1 FROM a, b, c WHERE a.x *= b.x AND a.y =* c.y AND b.z = 3")
    assert got.split() == "SELECT 1 FROM c LEFT JOIN a ON a.y = c.y LEFT JOIN b ON a.x = b.x AND b.z = 3".split()
    with pytest.raises(ValueError, match="table's name"):
        dialect.query("SELECT 1 FROM a, b WHERE x *= y")
    with pytest.raises(ValueError):
        dialect.outer_joins("a *= b AND c =* d")


def test_texts_are_joined_in_branches_and_operands():
    e = lambda t, *s: dialect.expression(t, "ssis", frozenset(s))
    assert e('c ? a + "-" + b : "z"') == "CASE WHEN c THEN concat(a, '-', b) ELSE 'z' END"
    assert e('UPPER(a + "x") == "YX"') == "UPPER(concat(a, 'x')) = 'YX'"
    assert e("n + 1 > 2 ? n + 2 : m", "t") == "CASE WHEN n + 1 > 2 THEN n + 2 ELSE m END"
    assert e("t + u", "t") == "concat(t, u)"


def test_a_destination_after_a_split_needs_a_path():
    text = """<x ObjectName="p"><pipeline><component componentClassID="a.OLEDBSource" name="s"><properties><property name="OpenRowset">t</property></properties></component>
    <component componentClassID="a.ConditionalSplit" name="c"><outputs><output name="o" isDefault="true"/></outputs></component>
    <component componentClassID="a.OLEDBDestination" name="d"><properties><property name="OpenRowset">u</property></properties></component></pipeline></x>"""
    with pytest.raises(ValueError, match="no path"):
        ssis.parse(text)
