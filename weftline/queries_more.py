"""Further operators as queries: windows, statements in other dialects, sinks read back, front ends, lineage and catalog reports."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.functions import dialect, naming, types
from weftline.operators import catalog, dml, graph, parity, windows
from weftline.operators import relational as R
from weftline.plans import ir, lineage, sqltext, xml_frontend
from weftline.queries import _context, _edges, _lineage, _money, _pipelines, _runs, _tables, query
from weftline.session import shared_folder, table
from weftline.sources import ddl, readers


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# --- windows ------------------------------------------------------------------------


_W = "(PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus)"


@query(f"""SELECT o_orderkey, rank() OVER {_W} AS r, dense_rank() OVER {_W} AS d, percent_rank() OVER {_W} AS p, cume_dist() OVER {_W} AS c, CAST(ntile(3) OVER
  (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS t FROM orders""")
def q_rank_family(spark, d):
    o = windows.ranked(table(spark, d, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"], {"r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist"})
    return windows.ranked(o, ["o_custkey"], ["o_orderkey"], {"t": "ntile(3)"}).select("o_orderkey", "r", "d", "p", "c", "t")


_B = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query(f"SELECT o_orderkey, lead(o_totalprice, 2) OVER {_B}) AS two_on, lag(o_orderkey) OVER {_B}) AS one_back FROM orders")
def q_lead_lag(spark, d):
    return windows.shifted(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], {"two_on": ("o_totalprice", 2), "one_back": ("o_orderkey", -1)}).select("o_orderkey", "two_on", "one_back")


@query(f"""SELECT o_orderkey, first_value(o_orderkey) OVER {_B} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_key, last_value(o_orderstatus) OVER
  {_B} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_status, max(o_totalprice) OVER {_B} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS
  top_near FROM orders""")
def q_frames_rows(spark, d):
    order = ["o_orderdate", "o_orderkey"]
    o = windows.framed(table(spark, d, "orders"), ["o_custkey"], order, {"first_key": "first_value(o_orderkey)"})
    o = windows.framed(o, ["o_custkey"], order, {"last_status": "last_value(o_orderstatus)"}, 0, None)
    return windows.framed(o, ["o_custkey"], order, {"top_near": "max(o_totalprice)"}, -2, 1).select("o_orderkey", "first_key", "last_status", "top_near")


@query("""SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near,
  min(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM lineitem""")
def q_frames_range(spark, d):
    rows = windows.framed(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity"], {"near": "count(*)"}, -5, 5, "range")
    return windows.framed(rows, ["l_suppkey"], ["l_quantity"], {"low": "min(l_extendedprice)"}, kind="range").select("l_orderkey", "l_linenumber", "near", "low")


@query("""SELECT severity, object, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'error' THEN 2 WHEN 'warn' THEN 3 WHEN 'info' THEN 4
  ELSE 5 END, object NULLS LAST, severity NULLS LAST) AS place FROM (SELECT DISTINCT ['warn', 'critical', 'odd', 'info', 'error'][p_size % 5 + 1] AS
  severity, CASE WHEN p_size % 7 > 0 THEN p_brand END AS object FROM part)""")
def q_findings_by_severity(spark, d):
    rows = table(spark, d, "part").select(F.element_at(F.array(*map(F.lit, ("warn", "critical", "odd", "info", "error"))), (F.col("p_size") % 5 + 1).cast("int")).alias("severity"), F.when(F.col("p_size") % 7 > 0, F.col("p_brand")).alias("object")).distinct()
    return windows.by_severity(rows, ties=("object", "severity"), place="place").select("severity", "object", "place")


# --- dialects -----------------------------------------------------------------------


def _said(spark, d, sql, *names):
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)
    return spark.sql(dialect.query(sql))


@query("""SELECT c_custkey, n_name FROM (SELECT c_custkey, c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25) JOIN nation ON n_nationkey =
  c_nationkey ORDER BY c_custkey""")
def q_rownum_inner(spark, d):
    """ROWNUM limits the SELECT it stands in, here after an inner sort and before the join."""
    return _said(spark, d, "SELECT c_custkey, n_name FROM (SELECT * FROM (SELECT c_custkey, c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey) WHERE ROWNUM <= 25) q JOIN nation ON n_nationkey = c_nationkey ORDER BY c_custkey", "customer", "nation")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def q_fetch_first(spark, d):
    return _said(spark, d, "SELECT o_orderkey FROM orders WITH (NOLOCK) ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 15 ROWS ONLY", "orders")


@query("SELECT s_suppkey, n_name, c_custkey FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 0")
def q_outer_join_text(spark, d):
    """An old outer join beside a plain one; a condition on the optional table alone belongs to its join."""
    return _said(spark, d, "SELECT s.s_suppkey, n.n_name, c.c_custkey FROM supplier s, nation n, customer c WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey *= c.c_custkey AND c.c_acctbal > 0", "supplier", "nation", "customer")


@query("SELECT r_regionkey, 'a = NULL' AS note, 'SYSDATE' AS word, 0 AS failed, current_date AS today, true AS ran FROM region WHERE r_name IS NOT NULL")
def q_literals_and_session(spark, d):
    """Literals stay as they are; the clock and session variables become what they mean."""
    return _said(spark, d, "SELECT r_regionkey, 'a = NULL' AS note, 'SYSDATE' AS word, @@ERROR AS failed, TRUNC(SYSDATE, 'DAY')::date AS today, GETDATE() >= TRUNC(SYSDATE) AS ran FROM region WHERE r_name <> NULL", "region")


@query("""SELECT o_orderkey, date_trunc('day', o_orderdate)::timestamp AS d, date_trunc('day', o_orderdate)::timestamp AS dy, date_trunc('year',
  o_orderdate)::timestamp AS y, date_trunc('hour', o_orderdate)::timestamp AS h FROM orders""")
def q_date_part_codes(spark, d):
    """D, DY and DAY are days."""
    return table(spark, d, "orders").select("o_orderkey", *[F.expr(dialect.expression(f"TRUNC(o_orderdate, '{c}')")).alias(n) for n, c in (("d", "D"), ("dy", "DAY"), ("y", "SYYYY"), ("h", "HH24"))])


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'odd' ELSE 'even' END AS parity FROM part")
def q_int_as_boolean(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 2).alias("flag"))
    return p.select("p_partkey", F.expr(dialect.expression("CASE WHEN flag THEN 'odd' ELSE 'even' END")).alias("parity"))


@query('SELECT n_nationkey AS "select", n_name AS "group by", n_regionkey AS "from" FROM nation WHERE n_regionkey > 1')
def q_reserved_words(spark, d):
    n = table(spark, d, "nation").toDF("select", "group by", "from")
    return R.source(n, ["select", "group by", "from"], f"{R.quoted('from')} > 1")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def q_project_variables(spark, d):
    ctx = ir.Context(spark, lambda name: table(spark, d, name), {"status": "F", "least": "150000"})
    return ir.Graph("g", [ir.Source("s", table="orders", columns=["o_orderkey"], where="o_orderstatus = '$$status' and o_totalprice > ${least}")]).run(ctx)["s"]


@query("SELECT p_partkey, p_retailprice * 2 AS twice, p_retailprice * 2 + 1 AS more, length(trim(upper(p_name)))::INT AS n, least(p_size, 10)::INT AS small FROM part")
def q_alias_reuse(spark, d):
    """A later column reads an earlier one's alias; functions known under the same name are left alone."""
    return _said(spark, d, "SELECT p_partkey, p_retailprice * 2 AS twice, twice + 1 AS more, LENGTH(TRIM(UPPER(p_name))) AS n, LEAST(p_size, 10) AS small FROM part", "part")


@query("SELECT o_orderkey, o_orderdate::DATE AS order_day, o_orderdate AS made_at FROM orders")
def q_datetime_types(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("order_day"), F.col("o_orderdate").cast("string").alias("made_at"))
    return R.cast_keys(o, {"_day": "date", "_at": "timestamp_ntz"})


# --- nodes and joins -------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 20000 AND 90000")
def q_ir_filter(spark, d):
    g = ir.Graph("g", [ir.Source("s", table="orders", columns=["o_orderkey", "o_totalprice"]), ir.Filter("f", "s", "o_totalprice between 20000 and 90000"), ir.Target("out", "f")])
    return g.run(_context(spark, d))["out"]


@query("SELECT CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'rest' END AS target, o_orderkey FROM orders")
def q_ir_router_targets(spark, d):
    """Each group of a router in a target of its own."""
    g = ir.Graph("g", [ir.Source("s", table="orders"), ir.Router("r", "s", [("big", "o_totalprice > 200000"), ("rest", None)]), *[ir.Target(f"{x}_out", f"r.{x}", {"target": f"'{x}'", "o_orderkey": "o_orderkey"}) for x in ("big", "rest")]])
    made = g.run(_context(spark, d))
    return made["big_out"].unionByName(made["rest_out"])


@query("SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_short_aliases(spark, d):
    names = R.short_aliases(["dw.dim_customer", "dw.stg_cust", "dw.nation"])
    c, n = names["dw.dim_customer"], names["dw.nation"]
    return R.multi_source(table(spark, d, "customer"), c, [R.Joined(n, table(spark, d, "nation"), f"{c}.c_nationkey = {n}.n_nationkey")]).select("c_name", "n_name")


@query("SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_suppkey = n_nationkey")
def q_join_default_left(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("n_nationkey"), "s_suppkey")
    return R.joiner(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), s, "n_nationkey").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "s_suppkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AS is_match FROM customer")
def q_merge_match(spark, d):
    return R.matched(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 250000"), {"c_custkey": "o_custkey"})


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY 1")
def q_agg_array(spark, d):
    out = R.aggregator(table(spark, d, "orders"), ["o_custkey"], {"keys": dialect.expression("ARRAY_AGG(o_orderkey)")})
    return out.select("o_custkey", F.sort_array("keys").alias("keys"))


# --- sources and sinks, read back --------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def q_extract_csv(spark, d):
    """A CSV with the columns that later steps use, by the types that they need."""
    text = '<pipeline name="p"><steps><extract_csv id="a" path="in/orders.csv"/><transform id="b" input="a"><filter column="o_totalprice" operator="&gt;" value="100000"/><rename old_col="o_custkey" new_col="buyer"/><sort columns="o_orderkey"/></transform><aggregate id="c" input="b" group_by="o_orderkey,buyer"><max column="o_totalprice" result_column="top"/></aggregate><load id="l" input="c" type="csv" path="x.csv"/></steps></pipeline>'
    p, path = xml_frontend.parse(text), _scratch(spark, "orders-csv")
    readers.write(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, "csv")
    used = xml_frontend.used_columns(p.steps)["a"]
    rows = readers.csv(spark, path, "o_orderkey long, o_custkey long, o_totalprice double").select(*used)
    made = xml_frontend.run(p, _context(spark, d, orders=rows))["x"]
    return made.select("o_orderkey", F.col("buyer").alias("o_custkey"), F.col("top").alias("o_totalprice"))


@query("SELECT row_number() OVER (ORDER BY p_partkey DESC) AS place, p_partkey, p_name FROM part WHERE p_size >= 40")
def q_xml_filter_sort(spark, d):
    """The place is that in the sorted output."""
    p = xml_frontend.OPERATIONS["filter"]({"condition": "NVL(p_size, 0) >= 40"})(table(spark, d, "part"))
    out = xml_frontend.OPERATIONS["sort"]({"columns": "p_partkey", "order": "desc"})(p).select("p_partkey", "p_name")
    return windows.numbered(out.withColumn("_m", F.monotonically_increasing_id()), ["_m"], "place").drop("_m")


@query("SELECT upper(n_name) AS \"N_NAME\", n_nationkey::VARCHAR AS \"N_NATIONKEY\", (SELECT count(*) FROM nation) AS total FROM nation")
def q_csv_round_trip(spark, d):
    """A full refresh as CSV; read again all columns are texts under upper-case names."""
    path = _scratch(spark, "nation")
    readers.write(table(spark, d, "nation").select("n_nationkey", F.upper("n_name").alias("n_name")), path, "csv")
    columns, n = readers.csv_header(spark, path)
    return readers.csv(spark, path, upper=True).select(*map(str.upper, columns)).withColumn("total", F.lit(n).cast("long"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1 HAVING count(*) > 3")
def q_stage_commit(spark, d):
    """A load is written, and the next stage reads what is stored."""
    text = '<pipeline name="p"><steps><extract id="a"><query>SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice &gt; 50000</query></extract><load id="l1" input="a" type="oracle" table="kept_orders"/><extract id="b"><query>SELECT o_custkey, count(*) AS n FROM kept_orders GROUP BY o_custkey</query></extract><transform id="t" input="b"><filter column="n" operator="&gt;" value="3"/></transform><load id="l2" input="t" type="csv" path="frequent.csv"/></steps></pipeline>'
    ctx = _context(spark, d)
    ctx.stages = _scratch(spark, "stages")
    return xml_frontend.run(xml_frontend.parse(text), ctx)["frequent"]


@query("SELECT s_suppkey, s_name, NULL::DOUBLE AS score FROM supplier")
def q_schema_extension(spark, d):
    return dml.extended(table(spark, d, "supplier").select("s_suppkey", "s_name"), {"score": "double", "s_name": "string"})


@query("SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region UNION ALL SELECT n_regionkey, n_name, NULL FROM nation")
def q_copy_into(spark, d):
    path = _scratch(spark, "copy")
    readers.write(table(spark, d, "nation").select(F.col("n_regionkey").alias("R_REGIONKEY"), F.col("n_name").alias("r_name")), path, "csv")
    return readers.copied(table(spark, d, "region").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("note")), path)


@query("SELECT s_suppkey, hex(encode(s_name)) AS s_name FROM supplier")
def q_raw_replication(spark, d):
    return readers.replicated(table(spark, d, "supplier").select("s_suppkey", F.encode("s_name", "UTF-8").alias("s_name")))


@query("SELECT r_regionkey::BIGINT AS region_id, true AS is_open, r_name AS label FROM region")
def q_stub_source(spark, d):
    """A stub's guessed types take real rows."""
    rows = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("region_id"), F.lit(True).alias("is_open"), F.col("r_name").alias("label"))
    return types.stub(spark, ["region_id", "is_open", "label"]).union(rows)


@query("""SELECT kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'ddl' WHEN 1 THEN 'etl' WHEN 2 THEN
  'dictionary' WHEN 3 THEN 'output' ELSE 'other' END AS kind, event_id % 1000 AS size FROM events) GROUP BY 1""")
def q_source_preview(spark, d):
    ends = F.element_at(F.array(*map(F.lit, (".sql", ".xml", "_dba_x.csv", ".csv", ".bin"))), (F.col("event_id") % 5 + 1).cast("int"))
    files = table(spark, d, "events").select(F.concat(F.lit("b/"), "event_id", ends).alias("path"), (F.col("event_id") % 1000).alias("size"))
    return readers.preview(files.withColumn("kind", readers.file_kind(F.col("path"))))[0]


@query("""SELECT 'MAIN.' || upper(table_name) AS table_fqn, upper(column_name) AS name, (ordinal_position - 1)::INT AS position FROM information_schema.columns
  WHERE table_name IN ('orders', 'nation', 'part')""")
def q_ddl_tables(spark, d):
    """Each table's CREATE TABLE, written out and parsed again."""
    text = ";\n".join(R.ddl_of(table(spark, d, n), n) for n in ("orders", "nation", "part"))
    return ddl.frames(spark, ddl.parse(text.replace("`", '"')))[1].select("table_fqn", "name", "position")


@query("""WITH s AS (SELECT 'O' || n_regionkey AS owner, n_name AS table_name, CAST(sum(s_suppkey * 10) AS BIGINT) AS bytes, max(s_suppkey) AS row_count FROM
  supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT 'O' || n_regionkey || '.' || n_name AS fqn, bytes, row_count FROM nation LEFT
  JOIN s ON s.owner = 'O' || n_regionkey AND s.table_name = n_name""")
def q_dictionary_inventory(spark, d):
    """Catalog tables from dictionary extracts, with the sizes of their segments."""
    n = table(spark, d, "nation").select(F.concat(F.lit("O"), "n_regionkey").alias("owner"), F.col("n_name").alias("table_name"), "n_nationkey")
    segments = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("owner", F.col("table_name").alias("segment_name"), (F.col("s_suppkey") * 10).alias("bytes"), F.col("s_suppkey").alias("num_rows"), F.current_date().alias("last_analyzed"))
    columns = n.select("owner", "table_name", F.lit("ID").alias("column_name"), F.lit("NUMBER").alias("data_type"), F.lit(False).alias("nullable"))
    foreign = columns.select("owner", "table_name", "column_name", F.lit("O1").alias("r_owner"), F.lit("T").alias("r_table"), F.lit("ID").alias("r_column"))
    return readers.inventory(n.select("owner", "table_name", F.lit("TABLE").alias("kind")), segments, columns, columns, foreign)[0].select("fqn", "bytes", "row_count")


@query("SELECT s_suppkey AS k, coalesce(s_name, 'none') AS name FROM supplier UNION ALL SELECT c_custkey, upper(c_name) FROM customer")
def q_view_source(spark, d):
    """A view in another dialect, translated and registered under its name."""
    for n in ("supplier", "customer"):
        table(spark, d, n).createOrReplaceTempView(n)
    R.registered(spark, "everyone", dialect.query("SELECT s_suppkey AS k, NVL(s_name, 'none') AS name FROM supplier UNION ALL SELECT c_custkey, UPPER(c_name) FROM customer"))
    return spark.table("everyone")


# --- lineage ---------------------------------------------------------------------------------


def _nation_names(spark, d):
    """A table's name for each nation."""
    return table(spark, d, "nation").select(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("t"))


_T25 = "n AS (SELECT lower(replace(n_name, ' ', '_')) AS t FROM nation)"


@query(f"""WITH {_T25} SELECT t, k.kind, CASE WHEN k.kind <> 'select' THEN 'dw.' || t END AS target, CASE WHEN k.kind IN ('insert', 'merge', 'select') THEN
  'src.' || t END AS source FROM n, (VALUES ('insert'), ('update'), ('delete'), ('truncate'), ('merge'), ('select')) k(kind)""")
def q_statement_kinds(spark, d):
    script = "INSERT INTO dw.%1$s (a) SELECT a FROM src.%1$s; UPDATE dw.%1$s SET a = 1 WHERE b = 2; DELETE FROM dw.%1$s WHERE a = 1; TRUNCATE TABLE dw.%1$s; MERGE INTO dw.%1$s x USING src.%1$s y ON x.a = y.a WHEN MATCHED THEN UPDATE SET b = y.b; SELECT a FROM src.%1$s -- FROM dw.other"
    rows = _nation_names(spark, d).select("t", F.format_string(script, "t").alias("text"))
    return lineage.statements_of(rows, keep=["t"]).select("t", "kind", "target", F.when(F.size("sources") > 0, F.array_join("sources", ",")).alias("source"))


@query(f"""WITH {_T25} SELECT 'SOURCE.' || upper(t) AS source_fqn, c.s AS source_column, 'DW.V_' || upper(t) AS target_fqn, c.d AS target_column, 0.95::DOUBLE AS
  confidence FROM n, (VALUES ('id', 'id'), ('amount', 'total')) c(s, d) UNION ALL SELECT 'SOURCE.RATES', 'rate', 'DW.V_' || upper(t), 'total', 0.95 FROM
  n""")
def q_view_edges(spark, d):
    views = _nation_names(spark, d).select(F.concat(F.lit("DW.V_"), F.upper("t")).alias("name"), F.format_string("SELECT a.id, a.amount * r.rate AS total FROM %s a JOIN rates r ON r.k = a.k", "t").alias("text"))
    return lineage.view_lineage(views).select("source_fqn", "source_column", "target_fqn", "target_column", "confidence")


@query("""SELECT 'DW.' || p_brand AS source_fqn, 'C' || p_partkey AS source_column, CASE WHEN p_size % 3 = 0 THEN 'DW.T' || p_size ELSE 'T' || p_size END AS
  target_fqn, 'ID' AS target_column, 'fk' AS operation FROM part WHERE p_size % 4 > 0""")
def q_fk_edges(spark, d):
    target = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("DW.T"), "p_size", F.lit(".ID"))).otherwise(F.concat(F.lit("T"), "p_size", F.lit(".ID")))
    columns = table(spark, d, "part").select(F.concat(F.lit("DW."), "p_brand").alias("table_fqn"), F.concat(F.lit("C"), "p_partkey").alias("name"), (F.col("p_size") % 4 > 0).alias("is_fk"), target.alias("fk_target"))
    return graph.fk_edges(columns).drop("confidence")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'OUTPUTS.' || upper(event_type) WHEN 1 THEN 'EXTERNAL.' || upper(event_type) WHEN 2 THEN 'RAW.' ||
  upper(event_type) ELSE 'SOURCE.' || upper(event_type) END AS fqn FROM events""")
def q_fqn_names(spark, d):
    k = F.col("event_id") % 4
    name = F.when(k < 2, F.concat(F.lit("a/b/"), "event_type", F.lit(".CSV"))).when(k == 2, F.concat(F.lit("raw."), "event_type")).otherwise(F.col("event_type"))
    kind = F.when(k == 0, "output").when(k == 1, "external").otherwise("table")
    return table(spark, d, "events").select("event_id", graph.fqn(name, kind).alias("fqn"))


@query("""WITH c AS (SELECT DISTINCT 'DW.' || p_brand || '.' || p_size AS k FROM part), q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN lower('DW.' ||
  p_brand || '.' || p_size) ELSE p_size::VARCHAR END AS key FROM part) SELECT key, min(k) AS column_key FROM q JOIN c ON lower(k) = key OR lower(k) LIKE
  '%.' || key GROUP BY 1""")
def q_key_resolve(spark, d):
    p = table(spark, d, "part")
    columns = p.select(F.concat_ws(".", F.lit("DW"), "p_brand", "p_size").alias("column_key")).distinct()
    keys = p.select(F.when(F.col("p_partkey") % 2 == 0, F.lower(F.concat_ws(".", F.lit("DW"), "p_brand", "p_size"))).otherwise(F.col("p_size").cast("string")).alias("key")).distinct()
    return graph.resolved(keys, columns)


_E = """e AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION
  SELECT 'R' || r_regionkey, 'ALL' FROM region UNION SELECT 'C' || c_custkey, 'ALL' FROM customer WHERE c_acctbal > 9000)"""
_OWN = """o AS (SELECT node, CASE WHEN node LIKE 'C%' AND CAST(substr(node, 2) AS INT) % 97 = 0 THEN 4 WHEN node LIKE 'N%' AND CAST(substr(node, 2) AS INT) % 5
  = 0 THEN 3 ELSE 0 END AS s FROM (SELECT src AS node FROM e UNION SELECT dst FROM e))"""
_UP = f"WITH RECURSIVE {_E}, p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)"


def _explicit(spark, d, pii=97):
    e = _edges(spark, d)
    n = F.expr("try_cast(substr(node, 2) as int)")
    s = F.when(F.col("node").startswith("C") & (n % pii == 0), "PII").when(F.col("node").startswith("N") & (n % 5 == 0), "TAX").otherwise("PUBLIC")
    return e, graph.nodes_of(e).withColumn("explicit_sensitivity", s)


@query(f"""{_UP}, {_OWN}, m AS (SELECT t.node, t.s, greatest(t.s, coalesce(max(f.s), 0)) AS m FROM o t LEFT JOIN p ON p.dst = t.node LEFT JOIN o f ON f.node =
  p.src AND f.s >= 2 GROUP BY 1, 2) SELECT count(*) FILTER (s = 4) AS explicit_pii, count(*) FILTER (m = 4 AND s < 4) AS inherited_pii, count(*) FILTER
  (m >= 2) AS sensitive FROM m""")
def q_pii_reach(spark, d):
    e, columns = _explicit(spark, d)
    return graph.pii_reach(graph.propagated(columns, e), columns)


@query(f"""{_UP}, {_OWN}, r AS (SELECT node, CASE node WHEN 'N1' THEN 4 ELSE s END AS s FROM o) SELECT t.node,
  ['PUBLIC','INTERNAL','FINANCIAL','TAX','PII'][greatest(t.s, coalesce(max(f.s), 0)) + 1] AS sensitivity FROM r t LEFT JOIN p ON p.dst = t.node LEFT
  JOIN r f ON f.node = p.src AND f.s >= 2 GROUP BY t.node, t.s""")
def q_column_override(spark, d):
    """One class changed by hand, then propagated again."""
    e, columns = _explicit(spark, d)
    return graph.propagated(graph.overridden(columns, "N1", "PII"), e).select("node", "sensitivity")


@query("""WITH l AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'SOURCE.U' || user_id % 40 ELSE 'PIPELINE.P' || user_id % 15 || '.S' || event_id % 3 END AS
  source_fqn, CASE WHEN event_id % 2 = 0 THEN 'PIPELINE.P' || event_id % 15 || '.S' || event_id % 4 ELSE 'OUTPUTS.O' || event_id % 20 END AS target_fqn,
  event_type AS c FROM events) SELECT source_fqn, target_fqn, c AS source_column, CASE WHEN source_fqn LIKE 'SOURCE%' THEN 'RAW' END AS source_layer,
  CASE WHEN target_fqn LIKE 'OUTPUTS%' AND c = 'view' THEN 'PII' WHEN target_fqn LIKE 'OUTPUTS%' THEN 'PUBLIC' END AS target_sensitivity, target_fqn
  LIKE 'OUTPUTS%' AND c = 'view' AS is_pii_path FROM l""")
def q_edge_export(spark, d):
    """Lineage edges with layers and classes of both ends, through a CSV and back."""
    l = _lineage(spark, d).drop("operation").distinct()
    columns = l.filter("target_fqn like 'OUTPUTS%'").select(F.col("target_fqn").alias("table_fqn"), F.col("target_column").alias("name")).distinct().withColumn("sensitivity", F.when(F.col("name") == "view", "PII").otherwise("PUBLIC"))
    tables = l.filter("source_fqn like 'SOURCE%'").select(F.col("source_fqn").alias("fqn")).distinct().withColumn("layer", F.lit("RAW"))
    path = _scratch(spark, "edges")
    readers.write(graph.export(l, columns, tables), path, "csv")
    return readers.csv(spark, path).select("source_fqn", "target_fqn", "source_column", "source_layer", "target_sensitivity", F.col("is_pii_path").cast("boolean").alias("is_pii_path"))


# --- catalog reports ---------------------------------------------------------------------------


@query("SELECT DISTINCT event_type || '_' || user_id % 30 || '.csv' AS csv_name FROM events WHERE user_id % 30 NOT IN (SELECT n_nationkey FROM nation)")
def q_undocumented(spark, d):
    produced = table(spark, d, "events").select(F.concat(F.lit("Out/"), F.upper("event_type"), F.lit("_"), F.col("user_id") % 30, F.lit(".csv")).alias("csv_name"))
    documented = table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "events").select("event_type").distinct())).select(F.concat("event_type", F.lit("_"), "n_nationkey", F.lit(".CSV")).alias("csv_name"))
    return catalog.undocumented(produced, documented)


_T = "t AS (SELECT DISTINCT ['RAW_', 'STG_', 'DIM_', 'RPT_', 'OLD_LEGACY_', 'T'][p_size % 6 + 1] || p_partkey % 50 AS name FROM part)"
_LAYER = """CASE WHEN name LIKE 'RAW%' THEN 'RAW' WHEN name LIKE 'STG%' THEN 'STAGING' WHEN name LIKE 'DIM%' THEN 'INTEGRATION' WHEN name LIKE 'RPT%' THEN
  'REPORTING' ELSE 'UNKNOWN' END"""


@query(f"WITH {_T} SELECT 'DW.' || name AS fqn FROM t WHERE name LIKE 'STG%1%'")
def q_inventory_search(spark, d):
    t = _tables(spark, d).withColumn("layer", catalog.layer(F.col("name")))
    return catalog.search(t, "1", "STAGING").select("fqn")


_S = """r AS (SELECT event_type AS c, value > 20 AS ok FROM events), k AS (SELECT c, count(*) AS total, count(*) FILTER (ok) AS good FROM r GROUP BY 1), p AS
  (SELECT * FROM (VALUES ('view', true), ('click', true), ('never', false), ('dark', true)) v(name, csv_exists)), u AS (SELECT CASE WHEN total IS NULL
  THEN CASE WHEN csv_exists THEN 'off-grid' ELSE 'never-run' END WHEN good < total THEN 'failing' ELSE 'healthy' END AS status FROM p LEFT JOIN k ON c =
  name UNION ALL SELECT 'undocumented' FROM k WHERE c NOT IN (SELECT name FROM p)), f AS (SELECT CASE WHEN total IS NULL THEN CASE WHEN csv_exists THEN 'critical' ELSE 'warn'
  END WHEN 100.0 * (total - good) / total >= 10 THEN 'critical' ELSE 'warn' END AS severity FROM p LEFT JOIN k ON c = name WHERE total IS NULL OR 100.0 * (total - good) / total >= 5
  UNION ALL SELECT 'critical' FROM k WHERE c NOT IN (SELECT name FROM p) UNION ALL SELECT 'warn' FROM t)"""


@query(f"""WITH {_T}, {_S} SELECT 'tables.' || lower({_LAYER}) AS metric, count(*) AS value FROM t GROUP BY 1 UNION ALL SELECT 'pipelines.' || status, count(*)
  FROM u GROUP BY 1 UNION ALL SELECT 'flags.' || severity, count(*) FROM f GROUP BY 1""")
def q_digest(spark, d):
    """Counts of a summary: tables by layer, pipelines by status, findings by severity."""
    t = _tables(spark, d)
    matched = catalog.matched_runs(_pipelines(spark), catalog.run_stats(_runs(spark, d)))
    usage = catalog.pipeline_usage(matched)
    flags = catalog.flags(t, t.select(F.col("fqn").alias("table_fqn"), F.lit(False).alias("is_pk")), matched)
    return catalog.digest(t.withColumn("layer", catalog.layer(F.col("name"))), usage, flags)


@query("""SELECT kind, count(*) AS n, count(*) FILTER (inside) AS n_in_scope, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT inside), '') AS excluded
  FROM (SELECT 'table' AS kind, 'S' || s_suppkey AS name, s_acctbal <= 5000 AS inside FROM supplier UNION ALL SELECT 'pipeline', n_name, n_nationkey % 3
  > 0 FROM nation) GROUP BY 1""")
def q_scope_export(spark, d):
    """A scope's manifest as JSON and its rows as CSV, read back."""
    p = table(spark, d, "nation").select(F.lit(True).alias("has_definition"), F.col("n_name").alias("pipeline_name"), (F.col("n_nationkey") % 3).alias("runs_total"), F.lit(False).alias("csv_exists"))
    t = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("fqn"), F.when(F.col("s_acctbal") > 5000, "safe").otherwise("review").alias("verdict"))
    scope, folder = catalog.scope(p, t), _scratch(spark, "scope")
    readers.exported(spark, scope, catalog.manifest(scope), folder)
    n = readers.csv(spark, f"{folder}/scope").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.schema("kind string, n_in_scope long, excluded array<string>").json(f"{folder}/manifest").join(n, "kind").select("kind", "n", "n_in_scope", F.array_join("excluded", ",").alias("excluded"))


@query(f"""WITH n AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'source' WHEN n_nationkey = 7 THEN 'odd' ELSE 'model' END AS kind, n_nationkey AS k FROM nation), e AS (SELECT b.k, lower(a.name) AS src, lower(b.name) AS dst FROM n a JOIN n b ON b.k = a.k + 1 WHERE b.k % 3 > 0 UNION ALL SELECT -1, 'ghost' , lower(name) FROM n WHERE k = 4)
SELECT 'error' AS severity, 'missing setting' AS "check", 'warehouse' AS object UNION ALL SELECT 'error', 'bad name', name FROM n WHERE NOT regexp_full_match(name, '[A-Za-z_]\\w*') UNION ALL SELECT 'error', 'unknown kind', name FROM n WHERE kind = 'odd'
UNION ALL SELECT 'warn', 'reads nothing', lower(name) FROM n WHERE kind = 'model' AND lower(name) NOT IN (SELECT dst FROM e) UNION ALL SELECT DISTINCT 'error', 'unresolved reference', src FROM e WHERE src NOT IN (SELECT lower(name) FROM n) UNION ALL SELECT 'error', 'cycle', lower(name) FROM n WHERE k IN (10, 11)""")
def q_project_validation(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_nationkey")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "source").when(F.col("n_nationkey") == 7, "odd").otherwise("model")
    nodes = n.select(F.col("n_name").alias("name"), kind.alias("kind"))
    b = n.select(F.col("n_name").alias("dst"), F.col("n_nationkey").alias("k"))
    edges = n.join(b, F.col("k") == F.col("n_nationkey") + 1).filter("k % 3 > 0").select(F.col("n_name").alias("src"), "dst")
    back = n.filter("n_nationkey = 11").select(F.col("n_name").alias("src")).crossJoin(n.filter("n_nationkey = 10").select(F.col("n_name").alias("dst")))
    ghost = n.filter("n_nationkey = 4").select(F.lit("ghost").alias("src"), F.col("n_name").alias("dst"))
    return parity.validated(spark, {"name": "x", "default_schema": "s"}, nodes, edges.union(back).union(ghost))


@query(f"SELECT l_suppkey, {_money('l_quantity')} AS qty FROM lineitem GROUP BY 1")
def q_full_refresh(spark, d):
    """A target replaced as a whole and read under its name."""
    out = R.aggregator(table(spark, d, "lineitem"), ["l_suppkey"], {"qty": _money("l_quantity")})
    return readers.refreshed(spark, out, _scratch(spark, "refresh"), naming.identifier("qty by supplier"))
