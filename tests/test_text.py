import datetime

import pytest

from weftline.functions import defaults, dialect, naming
from weftline.operators import parity
from weftline.plans import ir, lineage, sqltext

SAME = ["x - 7", "a.b - 7", "'SYSDATE - 7'", "a / 2", "CASE status WHEN code THEN 1 END", "x BETWEEN a AND b", "count(*) / 3"]
CHANGED = {
    "o_orderdate - 7": "(o_orderdate - INTERVAL '7' DAY)",
    "SYSDATE + 1": "(localtimestamp() + INTERVAL '1' DAY)",
    "t.load_dt - 1/24": "(t.load_dt - INTERVAL '3600' SECOND)",
    "TRUNC(SYSDATE) - 0.5": "(cast(date_trunc('DAY', localtimestamp()) as timestamp_ntz) - INTERVAL '43200' SECOND)",
    "a.x / b.y": "a.x / nullif(b.y, 0)",
    "a / (b - c) / f(d)": "a / nullif((b - c), 0) / nullif(f(d), 0)",
    "CAST(x AS VARCHAR2(20))": "cast(x as string)",
    "CAST(NVL(x, 0) AS NUMBER(12,2))": "cast(coalesce(x, 0) as decimal(12,2))",
    "CAST(x AS CHAR(3))": "cast(x as string)",
    "CAST(x AS TIMESTAMP WITH TIME ZONE)": "cast(x as timestamp)",
    "CASE WHEN flag AND x > 1 THEN 1 END": "CASE WHEN cast(flag as int) = 1 AND x > 1 THEN 1 END",
    "CASE WHEN NOT t.flag OR x BETWEEN a AND b THEN 1 END": "CASE WHEN NOT cast(t.flag as int) = 1 OR x BETWEEN a AND b THEN 1 END",
    "TRUNC(x)": "(sign(x) * floor(abs(x)))",
    "CONVERT(VARCHAR(8), d, 112)": "left(date_format(d, 'yyyyMMdd'), 8)",
    "CONVERT(INT, x)": "cast(x as int)",
}


@pytest.mark.parametrize("text", SAME)
def test_what_needs_no_change_stays(text):
    assert dialect.expression(text) == text


@pytest.mark.parametrize("text", CHANGED)
def test_rewrites(text):
    assert dialect.expression(text) == CHANGED[text]


@pytest.mark.parametrize("text", ["CONVERT(VARCHAR(8), d, 999)", "CONVERT(INT, d, 112)", "INSTR(a, 'x', -1)", "INSTR(a, 'x', 1, n)", "TRUNC(order_date, 'FORTNIGHT')"])
def test_unknown_forms_are_errors(text):
    with pytest.raises(ValueError):
        dialect.expression(text)


def test_values(spark):
    one = lambda e: spark.sql(f"SELECT {dialect.expression(e)} AS x").first().x
    assert one("INSTR('banana', 'a', 1, 2)") == 4 and one("INSTR('aaa', 'aa', 1, 2)") == 2 and one("INSTR('banana', 'a', 1, 4)") == 0 and one("INSTR('banana', 'n')") == 3
    assert one("CONVERT(VARCHAR(8), DATE '1997-01-15', 112)") == "19970115" and one("CONVERT(VARCHAR(30), TIMESTAMP_NTZ '1997-01-15 10:11:12', 126)") == "1997-01-15T10:11:12.000"
    assert one("CONVERT(DATE, '15/01/1997', 103)") == datetime.date(1997, 1, 15)
    assert one("TRUNC(-12.7)") == -12 and one("TRUNC(12.78, 1)") == pytest.approx(12.7) and one("1 / NVL(0, 1)") is None
    assert one("CASE WHEN 1 = 1 AND (2 > 1) THEN 'y' END") == "y"


def test_row_numbers_need_an_order(spark):
    spark.range(5).selectExpr("id", "-id AS minus").createOrReplaceTempView("numbers_view")
    got = dialect.numbered_rows(spark, "SELECT ROWNUM AS n, q.id FROM (SELECT id FROM numbers_view ORDER BY id DESC) q WHERE q.id <> 3").collect()
    assert sorted((r.n, r.id) for r in got) == [(1, 4), (2, 2), (3, 1), (4, 0)]
    got = dialect.numbered_rows(spark, "SELECT id, ROWNUM FROM numbers_view", ["id"]).collect()
    assert sorted((r.ROWNUM, r.id) for r in got) == [(i + 1, i) for i in range(5)]
    for text in ("SELECT ROWNUM, id FROM numbers_view", "SELECT ROWNUM, id FROM (SELECT id, minus FROM numbers_view ORDER BY minus) q"):
        with pytest.raises(ValueError, match="order"):
            dialect.numbered_rows(spark, text)


def test_common_tables_before_a_statement():
    s = sqltext.classify("WITH q (a) AS (SELECT a FROM s.t), r AS (SELECT a FROM q) INSERT INTO u (x) SELECT a FROM r JOIN v ON 1 = 1")
    assert (s.kind, s.target, s.sources, s.columns) == ("insert", "u", ["s.t", "v"], ["x"]) and s.query.startswith("WITH q (a) AS") and s.query.endswith("SELECT a FROM r JOIN v ON 1 = 1")
    s = sqltext.classify("WITH q AS (SELECT a FROM t) MERGE INTO u x USING q y ON x.a = y.a WHEN MATCHED THEN UPDATE SET b = y.b")
    assert (s.kind, s.target, s.sources) == ("merge", "u", ["t"])
    assert sqltext.classify("WITH q AS (SELECT 1 AS a) SELECT a FROM q").kind == "select"


def test_variables_are_values_not_text(spark):
    evil = "x' OR '1' = '1"
    rows = spark.createDataFrame([(evil, 1), ("a", 2), ("O'Brien \\ Co", 3)], "name string, n int")
    ctx = ir.Context(spark, lambda _: rows, {"who": evil, "least": "0", "table": "people", "bad": "people; DROP"})
    found = lambda sql: sorted(r.n for r in ir.Graph("g", [ir.Source("s", sql=sql, reads=["people"])]).run(ctx)["s"].collect())
    assert found("SELECT n FROM $$table WHERE name = '$$who' AND n > ${least}") == [1]
    assert found("SELECT n FROM people WHERE concat('<', name, '>') = '<$$who>'") == [1]
    with pytest.raises(ValueError, match="plain name"):
        found("SELECT n FROM $$bad")
    with pytest.raises(KeyError):
        found("SELECT n FROM people WHERE n = $$unknown")
    assert rows.filter(naming.inlined("name = '$$x'", {"x": "O'Brien \\ Co"})).first().n == 3
    assert naming.inlined("d >= $$d AND f = $$f AND b = $$b", {"d": datetime.date(2024, 1, 2), "f": 1.5, "b": True}) == "d >= DATE'2024-01-02' AND f = double('1.5') AND b = TRUE"


def test_standard_values(spark):
    assert defaults.value_of("etljobid") == "-1" and defaults.value_of("ETLJobID", variables={"etl_job_id": 5}) == "5" and defaults.value_of("MyDeletedFlgOld") == "'N'" and defaults.value_of("colour") is None
    assert defaults.value_of("SiteID", ["PtyLocNum2"]) == "`PtyLocNum2`" and defaults.value_of("SiteID", variables={"site_id": 9}) == "9"
    assert defaults.value_of("CurrentFlg", change="insert") == "'Y'" and defaults.value_of("CurrentFlg", change="update").startswith("CASE")
    with pytest.raises(KeyError):
        defaults.value_of("SiteID")
    df = spark.createDataFrame([(1, None, "2020-01-01"), (2, "N", None)], "k int, ActiveFlg string, EffEndDate string")
    out = defaults.with_fields(df, {"activeflg": "string", "CurrentFlg": "string", "RowVersion": "int"}, change="insert")
    assert sorted((r.k, r.ActiveFlg, r.CurrentFlg, r.RowVersion) for r in out.collect()) == [(1, "Y", "Y", 1), (2, "N", "Y", 1)]
    out = defaults.with_fields(df, {"CurrentFlg": "string"}, change="update")
    assert sorted((r.k, r.CurrentFlg) for r in out.collect()) == [(1, "N"), (2, "Y")]
    with pytest.raises(KeyError):
        defaults.with_fields(df, {"Colour": "string"})


def test_texts_are_parsed_in_tasks_and_problems_are_rows(spark):
    df = spark.createDataFrame([("a", "SELECT x FROM t; DELETE FROM u"), ("b", None), ("c", "INSERT INTO")], "name string, text string")
    got = sorted((r.name, r.kind, r.target, r.problem is not None) for r in lineage.statements_of(df, keep=["name"]).collect())
    assert got[:2] == [("a", "delete", "u", False), ("a", "select", None, False)] and [g for g in got if g[0] == "b"] == [] and [g for g in got if g[0] == "c"][0][3]
    pipes = spark.createDataFrame([("<pipeline name='p'><steps>",), ("<pipeline name='q'><steps><extract id='a'><query>SELECT k FROM t</query></extract></steps></pipeline>",)], "text string")
    out = lineage.pipeline_lineage(pipes).collect()
    assert sorted((r.origin_object, r.source_column, r.problem is not None) for r in out if r.problem is None) == [("q", "k", False)] and sum(r.problem is not None for r in out) == 1


def test_texts_of_one_file_are_dealt_out_and_equal_ones_parsed_once(spark, tmp_path):
    spark.range(300).selectExpr("id", "if(id % 7 = 0, null, if(id % 5 = 0, 'bad', concat(id % 3, ' x y'))) AS text", "map('k', id) AS m").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    calls = spark.sparkContext.accumulator(0)

    def parse(text):
        calls.add(1)
        if text == "bad":
            raise ValueError("no words")
        return [(i, w) for i, w in enumerate(text.split()) if w != "0"]

    out = lineage.parsed(df, parse, "place int, word string", keep=["id", "m"])
    tasks = out.rdd.getNumPartitions()
    calls.value = 0
    got = sorted((r.id, r.m["k"], r.place, r.word, r.problem) for r in out.collect())
    want = []
    for i in range(300):
        if i % 7 and i % 5 == 0:
            want.append((i, i, None, None, "ValueError: no words"))
        elif i % 7:
            want += [(i, i, p, w, None) for p, w in enumerate(f"{i % 3} x y".split()) if w != "0"]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tasks >= spark.sparkContext.defaultParallelism and calls.value <= 4 * tasks < len(want)


def test_views_of_one_text_keep_their_names(spark):
    df = spark.createDataFrame([("A\nB", "SELECT x AS y FROM t"), ("C", "SELECT x AS y FROM t"), ("D", None), ("E", "no query"), (None, "SELECT z FROM u")], "name string, text string")
    got = {(r.target_fqn, r.origin_object, r.source_fqn, r.source_column, r.target_column, r.problem is not None) for r in lineage.view_lineage(df).collect()}
    assert got == {("A\nB", "A\nB", "SOURCE.T", "x", "y", False), ("C", "C", "SOURCE.T", "x", "y", False), (None, None, None, None, None, True), (None, None, "SOURCE.U", "z", "z", False)}


def test_statements_are_analysed_but_not_run(spark, tmp_path):
    texts = [
        ("good", "SELECT a, count(*) AS n FROM t GROUP BY a"), ("syntax", "SELECT a FROM\n t WHERE > 1"), ("column", "SELECT a,\n b FROM t"), ("table", "SELECT a FROM u"), ("function", "SELECT nosuch(a) FROM t"),
        ("group", "SELECT a, c FROM t GROUP BY a"), ("insert", "INSERT INTO t SELECT zz FROM t"), ("drop", f"DROP TABLE parquet.`{tmp_path}`"), ("merge", "MERGE INTO t USING s ON ("),
    ]
    got = {name: (check, line) for name, check, line, _, _ in parity.analysed(spark, texts, {"t": "a int, c int"})}
    assert got == {"syntax": ("syntax", 2), "column": ("unknown column", 2), "table": ("unknown table", 1), "function": ("unknown function", 1), "group": ("not grouped", None), "insert": ("unknown column", 1), "merge": ("syntax", 1)}
    assert all(t.name != "t" for t in spark.catalog.listTables())  # stubs are in a session of their own
