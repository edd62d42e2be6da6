"""The operators as queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import dialect, naming
from weftline.operators import catalog, dml, graph, parity, windows
from weftline.operators import relational as R
from weftline.plans import ir, scripts, ssis, xml_frontend
from weftline.session import table
from weftline.sources import readers
from weftline.streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _money(e: str) -> str:
    """An exact sum as a double, whatever the order of its rows."""
    return f"cast(sum(cast({e} as decimal(18,4))) as double)"


def _context(spark: SparkSession, sf_dir: str, **views: DataFrame) -> ir.Context:
    return ir.Context(spark, lambda name: views[name] if name in views else table(spark, sf_dir, name.lower()))


# --- flagship ------------------------------------------------------------------

FLAGSHIP_XML = """
<pipeline name="segment_revenue"><steps>
  <extract id="ord"><query>SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND NVL(o_totalprice, 0) > 1000</query></extract>
  <extract id="cust"><query>SELECT c_custkey AS o_custkey, c_mktsegment, c_nationkey, c_acctbal FROM customer</query></extract>
  <join id="j" left="ord" right="cust" on="o_custkey" how="inner"/>
  <transform id="t" input="j">
    <math operation="multiply" col1="o_totalprice" val2="0.1" result_column="tax"/>
    <math operation="add" col1="o_totalprice" col2="tax" result_column="gross"/>
    <calculate_category column="c_acctbal" low="0" high="5000" result_column="standing"/>
    <concat cols="c_mktsegment,standing" separator="/" result_column="bucket"/>
    <drop columns="c_nationkey"/>
    <rename old_col="o_orderdate" new_col="ordered"/>
  </transform>
  <aggregate id="a" input="t" group_by="bucket"><count result_column="n"/><max column="gross" result_column="top_gross"/><min column="ordered" result_column="first_ordered"/></aggregate>
  <load id="l" input="a" type="csv" path="out/segment_revenue.csv"/>
</steps></pipeline>"""


@query("""
SELECT c_mktsegment || '/' || CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal > 5000 THEN 'high' ELSE 'medium' END AS bucket,
  count(*) AS n, max(o_totalprice + o_totalprice * 0.1::double) AS top_gross, min(o_orderdate) AS first_ordered
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND o_totalprice > 1000 GROUP BY 1""")
def q_pipeline_xml_segments(spark, d):
    """An XML pipeline from extract to load."""
    p = xml_frontend.parse(FLAGSHIP_XML)
    return xml_frontend.run(p, _context(spark, d))["segment_revenue"]


@query("""
SELECT o_orderkey, o_totalprice, coalesce(c_mktsegment, 'NONE') AS segment, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS big
FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def q_ir_graph(spark, d):
    """A hand-built graph: source, lookup, expression, router, target."""
    g = ir.Graph("g", [
        ir.Source("src", table="orders", columns=["o_orderkey", "o_custkey", "o_totalprice"], where="o_orderpriority = '1-URGENT'"),
        ir.Lookup("lkp", "src", "customer", {"o_custkey": "c_custkey"}, {"segment0": "c_mktsegment"}),
        ir.Expression("exp", "lkp", {"segment": "coalesce(segment0, 'NONE')", "big": "cast(o_totalprice > 200000 as int)"}),
        ir.Target("out", "exp", {c: c for c in ("o_orderkey", "o_totalprice", "segment", "big")}),
    ])
    return g.run(_context(spark, d))["out"]


# --- scans and projections -------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_quantity < 10")
def q_source_filter(spark, d):
    return R.source(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], "l_shipdate >= timestamp_ntz'1995-01-01' and l_quantity < 10")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_source_distinct(spark, d):
    return R.source(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], None, True)


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def q_source_multi(spark, d):
    t = lambda n: table(spark, d, n)
    return R.multi_source(t("orders"), "o", [R.Joined("c", t("customer"), "o.o_custkey = c.c_custkey"), R.Joined("n", t("nation"), "c.c_nationkey = n.n_nationkey", "left")], "o_totalprice > 300000").select("o_orderkey", "c_name", "n_name")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'")
def q_source_comma_join(spark, d):
    return R.multi_source(table(spark, d, "nation"), "n", [R.Joined("r", table(spark, d, "region"))], "n_regionkey = r_regionkey and r_name like 'A%'").select("n_name", "r_name")


@query("""WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_name AS custname, n AS ordercount FROM big JOIN customer ON o_custkey =
  c_custkey WHERE n > 12""")
def q_source_custom_sql(spark, d):
    """Custom SQL with its own WITH, under port names."""
    sql = "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_name AS cust_name, n AS order_count FROM big JOIN customer ON o_custkey = c_custkey WHERE n > 12"
    return ir.Graph("g", [ir.Source("s", sql=sql, reads=["orders", "customer"], columns=["custname", "ordercount"])]).run(_context(spark, d))["s"]


@query("SELECT p_partkey, p_retailprice * 2 AS twice, p_retailprice / nullif(p_size - 1, 0) AS per_size, p_size + 5 AS size5, p_retailprice - 1.5 AS less FROM part")
def q_expr_math(spark, d):
    df = table(spark, d, "part")
    for a in ({"operation": "multiply", "col1": "p_retailprice", "val2": "2", "result_column": "twice"}, {"operation": "subtract", "col1": "p_size", "val2": "1", "result_column": "s1"}, {"operation": "divide", "col1": "p_retailprice", "col2": "s1", "result_column": "per_size"}, {"operation": "add", "col1": "p_size", "val2": "5", "result_column": "size5"}, {"operation": "subtract", "col1": "p_retailprice", "val2": "1.5", "result_column": "less"}):
        df = xml_frontend.OPERATIONS["math"](a)(df)
    return df.select("p_partkey", "twice", "per_size", "size5", "less")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal > 5000 THEN 'high' ELSE 'medium' END AS standing FROM customer")
def q_expr_category(spark, d):
    return table(spark, d, "customer").select("c_custkey", dialect.category(F.col("c_acctbal"), 0, 5000).alias("standing"))


@query("SELECT p_partkey, concat_ws('-', p_brand, p_type) AS label FROM part")
def q_expr_concat(spark, d):
    return xml_frontend.OPERATIONS["concat"]({"cols": "p_brand,p_type", "separator": "-", "result_column": "label"})(table(spark, d, "part")).select("p_partkey", "label")


@query("SELECT s_suppkey, s_name AS supplier_name, s_nationkey FROM supplier")
def q_expr_rename_drop(spark, d):
    df = xml_frontend.OPERATIONS["rename"]({"old_col": "s_name", "new_col": "supplier_name"})(table(spark, d, "supplier"))
    return xml_frontend.OPERATIONS["drop"]({"columns": "s_acctbal"})(df)


@query("SELECT c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment AS segment, c_acctbal * 2 AS double_bal FROM customer")
def q_expr_shadow(spark, d):
    """A new column replaces its namesake, a rename takes its column's place, a used column stays."""
    return R.expression(table(spark, d, "customer"), {"c_name": "upper(c_name)", "segment": "c_mktsegment", "double_bal": "c_acctbal * 2"})


@query("SELECT * FROM part WHERE contains(p_name, 'red') OR contains(p_type, 'BRASS')")
def q_filter_text(spark, d):
    p = table(spark, d, "part")
    a = xml_frontend.OPERATIONS["filter_text"]({"column": "p_name", "contains": "red"})(p)
    return a.unionByName(xml_frontend.OPERATIONS["filter_text"]({"column": "p_type", "contains": "BRASS"})(p)).distinct()


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem")
def q_safe_divide(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dialect.safe_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"))


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, 'UNKNOWN') AS status, coalesce(CASE WHEN value < 10 THEN NULL
  ELSE value END, 0) AS amount FROM events""")
def q_defaults_applied(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("nullif(event_type, 'view')").alias("status"), F.expr("case when value >= 10 then value end").alias("amount"))
    return dialect.with_defaults(e)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority IS NOT NULL")
def q_predicates(spark, d):
    return table(spark, d, "orders").filter(F.expr(dialect.null_tests("o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority <> NULL"))).select("o_orderkey", "o_orderdate")


# --- joins ---------------------------------------------------------------------------


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("tag"))


def _customers(spark, d):
    return table(spark, d, "customer").select((F.col("c_custkey") + 40).alias("K"), "c_name", F.col("c_mktsegment").alias("TAG"))


_O = "(SELECT o_orderkey, o_custkey AS k, o_orderstatus AS tag FROM orders) o"
_C = "(SELECT c_custkey + 40 AS k, c_name, c_mktsegment AS tag FROM customer) c"
for _how, _k in (("inner", "o.k"), ("left", "o.k"), ("right", "coalesce(o.k, c.k)"), ("full", "coalesce(o.k, c.k)")):

    def _join(spark, d, how=_how):
        """Left columns, then right ones whose names aren't taken."""
        return R.joiner(_orders(spark, d), _customers(spark, d), "k", how)

    QUERIES[f"join_{_how}"] = _join
    ORACLE_SQL[f"join_{_how}"] = f"SELECT o.o_orderkey, {_k} AS k, o.tag, c.c_name FROM {_O} {_how.upper()} JOIN {_C} ON o.k = c.k"


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def q_join_cross(spark, d):
    return R.joiner(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"), "", "cross")


@query("SELECT l_orderkey, l_linenumber, p_brand AS brand, p_type AS kind FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def q_lookup_left(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.lookup(rows, table(spark, d, "part"), {"l_partkey": "p_partkey"}, {"brand": "p_brand", "kind": "p_type"}).drop("l_partkey")


@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS first_done FROM customer")
def q_lookup_sql_override(spark, d):
    """Of several reference rows of a key the first counts, so rows never multiply."""
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return R.lookup(table(spark, d, "customer").select("c_custkey"), done, {"c_custkey": "o_custkey"}, {"first_done": "o_orderkey"})


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_semi_exists(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return R.joiner(table(spark, d, "customer").select("c_custkey", "c_name"), big, "c_custkey", "semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)")
def q_anti_missing(spark, d):
    return R.joiner(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").filter("o_orderstatus = 'P' and o_totalprice > 100000"), {"c_custkey": "o_custkey"}, "anti")


@query("""SELECT c.c_custkey, c.c_acctbal FROM customer c LEFT JOIN customer p ON c.c_custkey = p.c_custkey AND p.c_acctbal >= 0 WHERE p.c_custkey IS NULL OR
  p.c_acctbal IS DISTINCT FROM (CASE WHEN c.c_custkey % 5 = 0 THEN c.c_acctbal + 1 ELSE c.c_acctbal END)""")
def q_new_or_changed(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    now = c.withColumn("c_acctbal", F.expr("case when c_custkey % 5 = 0 then c_acctbal + 1 else c_acctbal end"))
    out = R.new_or_changed(now, c.filter("c_acctbal >= 0"), ["c_custkey"], ["c_acctbal"])
    return out.join(c.withColumnRenamed("c_acctbal", "b"), "c_custkey").select("c_custkey", F.col("b").alias("c_acctbal"))


@query("""WITH s AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT s_nationkey, count(*) AS m FROM supplier GROUP BY 1) SELECT
  n_name, coalesce(n, 0) AS customers, coalesce(m, 0) AS suppliers FROM nation LEFT JOIN s ON n_nationkey = c_nationkey LEFT JOIN t ON n_nationkey =
  s_nationkey""")
def q_join_derived(spark, d):
    """Aggregates joined to a dimension, each aggregated before its join."""
    out = table(spark, d, "nation").select("n_name", "n_nationkey")
    out = R.joiner(out, R.aggregator(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), ["n_nationkey"], {"customers": "count(*)"}), "n_nationkey")
    out = R.joiner(out, R.aggregator(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), ["n_nationkey"], {"suppliers": "count(*)"}), "n_nationkey")
    return out.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


_DAYS = "(SELECT CAST(epoch(date_trunc('day', o_orderdate)) / 86400 AS BIGINT) AS day, count(*) AS n FROM orders GROUP BY 1)"


@query(f"SELECT a.day, a.n, b.n AS prev_n FROM {_DAYS} a LEFT JOIN {_DAYS} b ON a.day = b.day + 1")
def q_self_join_prior_day(spark, d):
    days = table(spark, d, "orders").groupBy(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return windows.beside(days, [], "day", 1, ["n"])


@query("SELECT s_suppkey, s_name, p_partkey FROM supplier LEFT JOIN part ON s_suppkey = p_partkey")
def q_legacy_outer_join(spark, d):
    cond, how = dialect.outer_joins("s_suppkey *= p_partkey")
    return table(spark, d, "supplier").join(table(spark, d, "part"), F.expr(cond), how).select("s_suppkey", "s_name", "p_partkey")


# --- aggregates ------------------------------------------------------------------------


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {_money('l_quantity')} AS qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price FROM
  lineitem GROUP BY 1, 2""")
def q_agg_basic(spark, d):
    return R.aggregator(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": "count(*)", "qty": _money("l_quantity"), "first_ship": "min(l_shipdate)", "top_price": "max(l_extendedprice)"})


@query("SELECT o_custkey, any_value(c_name) AS c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def q_agg_any_value_key(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    return R.aggregator(both, ["o_custkey"], {"o_custkey": "o_custkey", "c_name": "c_name", "n": "count(*)"})


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def q_agg_count_distinct(spark, d):
    return R.aggregator(table(spark, d, "lineitem"), ["l_returnflag"], {"suppliers": "count(distinct l_suppkey)", "parts": "count(distinct l_partkey)"})


@query(f"""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, {_money('case when o_orderstatus = chr(79) then o_totalprice else 0 end')} AS
  open_total FROM orders GROUP BY 1""")
def q_agg_conditional(spark, d):
    return R.aggregator(table(spark, d, "orders"), ["o_orderpriority"], {"done": "count_if(o_orderstatus = 'F')", "open_total": _money("case when o_orderstatus = 'O' then o_totalprice else 0 end")})


@query("SELECT count(*) AS n, min(o_orderdate) AS first, max(o_totalprice) AS top FROM orders")
def q_agg_global(spark, d):
    return R.aggregator(table(spark, d, "orders"), [], {"n": "count(*)", "first": "min(o_orderdate)", "top": "max(o_totalprice)"})


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def q_agg_string(spark, d):
    return R.aggregator(table(spark, d, "nation"), ["n_regionkey"], {"nations": "listagg(n_name, ',') within group (order by n_name)"})


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_agg_histogram(spark, d):
    return R.count_by(table(spark, d, "events"), "event_type")


# --- windows and limits --------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_num FROM orders")
def q_row_number_key(spark, d):
    return windows.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "row_num")


@query("SELECT c_name, 100 + row_number() OVER (ORDER BY c_custkey) AS sk FROM customer")
def q_surrogate_key(spark, d):
    old = table(spark, d, "supplier").agg(F.lit(100).cast("long").alias("sk"))
    return windows.surrogate_keys(table(spark, d, "customer").select("c_custkey", "c_name"), old, "sk", ["c_custkey"]).select("c_name", "sk")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def q_topk_hot_parts(spark, d):
    return windows.top(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), "n", 20, ["l_partkey"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def q_topk_per_customer(spark, d):
    return windows.top_per(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def q_latest_snapshot(spark, d):
    return windows.latest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


_PRIOR = "lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, CASE WHEN {_PRIOR} IS NULL OR {_PRIOR} = 0 THEN NULL ELSE (o_totalprice - {_PRIOR}) / {_PRIOR} * 100 END AS pct_change FROM orders")
def q_pct_change_prior(spark, d):
    o = table(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return windows.change(o, ["o_custkey"], "at", "o_totalprice").select("o_orderkey", "pct_change")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def q_recent_runs(spark, d):
    return readers.recent(table(spark, d, "orders"), "o_orderdate", 10, "o_orderkey").select("o_orderkey")


# --- sets, explosion, routing -----------------------------------------------------------------


@query("""SELECT c_custkey AS id, c_name AS name, 'C' AS kind, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, 'S', s_acctbal FROM supplier
  UNION ALL SELECT n_nationkey, n_name, 'N', NULL FROM nation""")
def q_union_all_mapped(spark, d):
    t = lambda n: table(spark, d, n)
    maps = {"c": {"id": "c_custkey", "name": "c_name", "kind": "'C'", "bal": "c_acctbal"}, "s": {"id": "s_suppkey", "name": "s_name", "kind": "'S'", "bal": "s_acctbal"}, "n": {"id": "cast(n_nationkey as bigint)", "name": "n_name", "kind": "'N'", "bal": "cast(null as double)"}}
    return R.union_all({"c": t("customer"), "s": t("supplier"), "n": t("nation")}, ["id", "name", "kind", "bal"], maps)


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def q_set_difference(spark, d):
    return R.difference(table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, "lineitem").filter("l_quantity > 49").select("l_partkey"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q_ordered_dedup(spark, d):
    return R.first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT p_partkey, i.generate_series::INT AS idx FROM part, generate_series(1, 3) i")
def q_normalizer_explode(spark, d):
    return R.repeated(table(spark, d, "part").select("p_partkey"), 3)


@query("""SELECT l_orderkey, l_linenumber, 1 AS idx, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 2, l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 3, l_tax FROM lineitem""")
def q_normalizer_groups(spark, d):
    return R.normalizer(table(spark, d, "lineitem"), 3, ["l_orderkey", "l_linenumber"], {"amount": ["l_quantity", "l_discount", "l_tax"]})


_GROUPS = [("big", "o_totalprice > 200000"), ("urgent", "o_orderpriority = '1-URGENT'"), ("rest", None)]


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def q_router_accept(spark, d):
    return R.router(table(spark, d, "orders"), _GROUPS)["big"].select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (coalesce(o_totalprice > 200000, false) OR coalesce(o_orderpriority = '1-URGENT', false))")
def q_router_default(spark, d):
    return R.router(table(spark, d, "orders"), _GROUPS)["rest"].select("o_orderkey")


@query("SELECT 'F' AS target, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def q_router_multi_target(spark, d):
    out = dml.split_targets(table(spark, d, "orders"), {s: (f"o_orderstatus = '{s}'", {"target": f"'{s}'", "id": "o_orderkey"}) for s in "FO"})
    return out["F"].unionByName(out["O"])


# --- statements ---------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def q_dml_update(spark, d):
    node = xml_frontend.statement_node("u", "UPDATE ${ref('customer')} SET c_acctbal = 0, c_mktsegment = 'DEBT' WHERE c_acctbal < 0")
    return node.evaluate(_context(spark, d)).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)")
def q_dml_delete(spark, d):
    return xml_frontend.statement_node("x", "DELETE FROM stg.supplier WHERE s_acctbal < 0").evaluate(_context(spark, d))


@query("SELECT * FROM region WHERE false")
def q_dml_truncate(spark, d):
    return xml_frontend.statement_node("x", "TRUNCATE TABLE region").evaluate(_context(spark, d))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT CAST(s_suppkey + 100 AS INT), s_name, NULL FROM supplier WHERE s_acctbal > 5000")
def q_insert_positional(spark, d):
    return xml_frontend.statement_node("i", "INSERT INTO dw.nation (n_nationkey, n_name) SELECT s_suppkey + 100, s_name FROM src.supplier WHERE s_acctbal > 5000").evaluate(_context(spark, d))


def _part_changes(spark, d):
    return table(spark, d, "part").filter("p_retailprice > 1200").select(F.when(F.col("p_partkey") % 8 == 0, F.col("p_partkey") + 1_000_000).otherwise(F.col("p_partkey")).alias("pk"), F.concat(F.lit("new "), "p_name").alias("pname"), (F.col("p_size") + 1).alias("psize"))


_CHANGES = """(SELECT CASE WHEN p_partkey % 8 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS pk, 'new ' || p_name AS pname, p_size + 1 AS psize FROM part WHERE
  p_retailprice > 1200)"""
_MERGE = """MERGE INTO dw.part tgt USING changes src ON tgt.p_partkey = src.pk WHEN MATCHED THEN UPDATE SET tgt.p_name = src.pname, p_size = src.psize WHEN NOT
  MATCHED THEN INSERT (p_partkey, p_name, p_size) VALUES (src.pk, src.pname, src.psize)"""


@query(f"""SELECT coalesce(p_partkey, pk) AS p_partkey, coalesce(pname, p_name) AS p_name, coalesce(psize, p_size) AS p_size, p_brand FROM part FULL JOIN
  {_CHANGES} ON p_partkey = pk""")
def q_merge_upsert(spark, d):
    node = xml_frontend.statement_node("m", _MERGE)
    return node.evaluate(_context(spark, d, changes=_part_changes(spark, d))).select("p_partkey", "p_name", "p_size", "p_brand")


@query(f"""SELECT p_partkey, CASE WHEN pk IS NOT NULL AND p_size > 25 THEN 0 ELSE p_size END AS p_size FROM part LEFT JOIN {_CHANGES} ON p_partkey = pk WHERE NOT
  (pk IS NOT NULL AND p_size <= 25 AND p_size > 10) UNION ALL SELECT pk, psize FROM {_CHANGES} WHERE pk >= 1000000 AND psize > 20""")
def q_merge_conditional(spark, d):
    """Conditions on every branch and a deletion."""
    spec = dml.Merge({"p_partkey": "pk"}, [dml.When({"p_size": "0"}, "t.p_size > 25"), dml.When(None, "t.p_size > 10")], [dml.When({"p_partkey": "s.pk", "p_size": "s.psize"}, "s.psize > 20")])
    return dml.merge(table(spark, d, "part").select("p_partkey", "p_size"), _part_changes(spark, d), spec)


@query(f"SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT pk FROM {_CHANGES}) UNION ALL SELECT pk, pname FROM {_CHANGES}")
def q_incremental_upsert(spark, d):
    rows = _part_changes(spark, d).select(F.col("pk").alias("p_partkey"), F.col("pname").alias("p_name"))
    return dml.upsert(table(spark, d, "part").select("p_partkey", "p_name"), rows, ["p_partkey"])


@query("""
WITH dim AS (SELECT c_custkey AS sk, c_custkey AS nk, c_mktsegment AS seg FROM customer WHERE c_acctbal >= 0),
src AS (SELECT c_custkey AS nk, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS seg FROM customer),
fresh AS (SELECT src.nk, src.seg FROM src LEFT JOIN dim ON src.nk = dim.nk WHERE dim.nk IS NULL OR dim.seg <> src.seg)
SELECT dim.sk, dim.nk, dim.seg, TIMESTAMP '2000-01-01' AS effective_dt, CASE WHEN dim.seg <> src.seg THEN TIMESTAMP '2024-01-01' END AS end_dt, CASE WHEN dim.seg <> src.seg THEN 'N' ELSE 'Y' END AS current_flg FROM dim JOIN src ON src.nk = dim.nk
UNION ALL SELECT (SELECT max(sk) FROM dim) + row_number() OVER (ORDER BY nk), nk, seg, TIMESTAMP '2024-01-01', NULL, 'Y' FROM fresh""")
def q_scd2_close_and_insert(spark, d):
    c = table(spark, d, "customer")
    dim = c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("sk"), F.col("c_custkey").alias("nk"), F.col("c_mktsegment").alias("seg"), F.expr("timestamp_ntz'2000-01-01'").alias("effective_dt"), F.lit(None).cast("timestamp_ntz").alias("end_dt"), F.lit("Y").alias("current_flg"))
    src = c.select(F.col("c_custkey").alias("nk"), F.expr("case when c_custkey % 5 = 0 then 'X' else c_mktsegment end").alias("seg"))
    return dml.scd2(dim, src, ["nk"], ["seg"], "timestamp_ntz'2024-01-01'")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def q_assert_unique(spark, d):
    return dml.broken_unique(table(spark, d, "orders"), ["o_custkey"])


@query("""SELECT 'o_orderkey' AS \"column\", count(*) FILTER (o_orderkey IS NULL) AS nulls FROM orders UNION ALL SELECT 'o_totalprice', count(*) FILTER
  (o_totalprice IS NULL) FROM orders""")
def q_assert_non_null(spark, d):
    return dml.null_counts(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


# --- dialects ---------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::timestamp AS m, date_trunc('quarter', o_orderdate)::timestamp AS q, date_trunc('week',
  o_orderdate)::timestamp AS w, date_trunc('day', o_orderdate)::timestamp AS dd FROM orders""")
def q_date_trunc_parts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[F.expr(dialect.expression(f"TRUNC(o_orderdate, '{c}')")).alias(n) for n, c in (("m", "MM"), ("q", "Q"), ("w", "IW"), ("dd", "DD"))])


@query("SELECT event_id, ts - INTERVAL 7 DAY AS week_ago FROM events")
def q_date_minus_days(spark, d):
    return table(spark, d, "events").select("event_id", dialect.minus_days(F.col("ts"), 7).alias("week_ago"))


@query("""SELECT o_orderkey, date_diff('year', o_orderdate, TIMESTAMP '1999-01-01') AS y, date_diff('month', o_orderdate, TIMESTAMP '1999-01-01') AS m,
  date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') AS d FROM orders""")
def q_date_diff_boundary(spark, d):
    at = F.expr("timestamp_ntz'1999-01-01'")
    return table(spark, d, "orders").select("o_orderkey", *[dialect.date_diff(p, F.col("o_orderdate"), at).alias(n) for n, p in (("y", "yyyy"), ("m", "mm"), ("d", "dd"))])


@query("SELECT event_id, (event_id % 3 = 0) AS number_ok, (event_id % 4 = 0) AS date_ok FROM events")
def q_is_date_is_number(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("case when event_id % 3 = 0 then ' 12.5 ' else 'x' || event_id end").alias("a"), F.expr("case when event_id % 4 = 0 then '20240229' else '20230229' end").alias("b"))
    return e.select("event_id", dialect.is_number(F.col("a")).alias("number_ok"), dialect.is_date(F.col("b")).alias("date_ok"))


@query("SELECT p_partkey, CAST(instr(p_name, 'e') AS INT) AS at, substr(p_name, 1, 3) AS start, chr(65 + CAST(p_partkey % 26 AS INT)) AS letter FROM part")
def q_instr_position(spark, d):
    return table(spark, d, "part").select("p_partkey", *[F.expr(dialect.expression(e)).alias(n) for n, e in (("at", "CHARINDEX('e', p_name)"), ("start", "SUBSTR(p_name, 0, 3)"), ("letter", "CHR(cast(65 + p_partkey % 26 as int))"))])


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS date_key, year(o_orderdate)::INT AS y FROM orders")
def q_to_char_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr(dialect.expression("cast(TO_NUMBER(TO_CHAR(o_orderdate, 'yyyymmdd')) as int)")).alias("date_key"), F.expr("extract(year from o_orderdate)").alias("y"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, p_brand || coalesce(CASE WHEN p_size > 25 THEN p_type END, '') AS label FROM part")
def q_words_and_null_concat(spark, d):
    return table(spark, d, "part").select("p_partkey", dialect.word(F.col("p_name"), 1).alias("first_word"), dialect.concat_null_as_empty(F.col("p_brand"), F.expr("case when p_size > 25 then p_type end")).alias("label"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'none') AS s, o_orderdate + INTERVAL 3 MONTH AS later,
  CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS price FROM orders""")
def q_legacy_functions(spark, d):
    e = {"s": "ISNULL(nullif(o_orderstatus, 'P'), 'none')", "later": "DATEADD(mm, 3, o_orderdate)", "price": "cast(CONVERT(DECIMAL(12,2), o_totalprice) as double)"}
    return table(spark, d, "orders").select("o_orderkey", *[F.expr(dialect.expression(x)).alias(n) for n, x in e.items()])


@query("SELECT DISTINCT regexp_replace(lower(p_type), '^[0-9]+_', '') AS canonical FROM part")
def q_canonical_names(spark, d):
    t = table(spark, d, "part").select(F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("_"), "p_type").alias("n"))
    return t.select(catalog.canonical(F.col("n")).alias("canonical")).distinct()


@query("""SELECT o_orderkey, array_to_string(list_transform(regexp_split_to_array(o_orderpriority, '[^A-Za-z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS pascal FROM orders""")
def q_pascal_names(spark, d):
    """Names of one or more words, with blanks and marks between them."""
    return table(spark, d, "orders").select("o_orderkey", naming.pascal_column(F.col("o_orderpriority")).alias("pascal"))


# --- foreign front ends --------------------------------------------------------------------------------

BTEQ = """.LOGON host/user,pw
.SET WIDTH 200
DROP TABLE work.cust_orders;
CREATE MULTISET TABLE work.cust_orders AS (
  SELECT o.o_custkey, COUNT(*) AS n, MAX(o.o_totalprice) AS top FROM stg.orders o WHERE o.o_orderstatus <> 'P' GROUP BY o.o_custkey
) WITH DATA PRIMARY INDEX (o_custkey);
COLLECT STATISTICS COLUMN (o_custkey) ON work.cust_orders;
MERGE INTO dw.customer_dim tgt USING work.cust_orders src ON tgt.c_custkey = src.o_custkey
WHEN MATCHED AND src.n > 10 THEN UPDATE SET c_mktsegment = 'FREQUENT'
WHEN NOT MATCHED THEN INSERT (c_custkey, c_mktsegment) VALUES (src.o_custkey, 'ORPHAN');
.IF ERRORCODE <> 0 THEN .QUIT 8;
.QUIT
"""


@query("""SELECT c_custkey, CASE WHEN n > 10 THEN 'FREQUENT' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM
  orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON c_custkey = o_custkey""")
def q_script_bteq(spark, d):
    made = scripts.bteq(BTEQ).run(_context(spark, d, customer_dim=table(spark, d, "customer")))
    return made["customer_dim"].select("c_custkey", "c_mktsegment")


TASKS = """
CREATE OR REPLACE STREAM raw.customer_cdc ON TABLE raw.customer APPEND_ONLY = FALSE SHOW_INITIAL_ROWS = TRUE;
CREATE OR REPLACE TASK etl.t_delta WAREHOUSE = w SCHEDULE = '30 MINUTE' AS
  INSERT INTO stg.delta (c_custkey, c_acctbal) SELECT m.c_custkey, m.c_acctbal FROM raw.customer_cdc m WHERE m.`METADATA$ACTION` IN ('INSERT', 'UPDATE');
CREATE OR REPLACE PROCEDURE etl.sp_enrich() RETURNS STRING LANGUAGE SQL AS
$$
BEGIN
  DELETE FROM stg.enriched WHERE c_custkey > 0;
  INSERT INTO stg.enriched (c_custkey, n, bal) SELECT d.c_custkey, COUNT(o.o_orderkey), MAX(d.c_acctbal) FROM stg.delta d JOIN raw.orders o ON o.o_custkey = d.c_custkey GROUP BY d.c_custkey;
  RETURN 'OK';
END;
$$;
CREATE OR REPLACE TASK etl.t_enrich WAREHOUSE = w AFTER etl.t_delta AS CALL etl.sp_enrich();
"""


@query("SELECT c_custkey, count(*) AS n, max(c_acctbal + 1) AS bal FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def q_script_tasks(spark, d):
    """A stream's changes through a task and a procedure."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.withColumn("c_acctbal", F.expr("case when c_acctbal > 0 then c_acctbal + 1 else c_acctbal end"))
    empty = c.limit(0)
    views = {"customer_cdc": scripts.stream_frame(c, new, ["c_custkey"]), "delta": empty, "enriched": empty.select("c_custkey", F.lit(0).cast("long").alias("n"), F.col("c_acctbal").alias("bal"))}
    return scripts.task_pipeline(TASKS).script().run(_context(spark, d, **views))["enriched"]


DTSX = """<?xml version="1.0"?>
<DTS:Executable xmlns:DTS="www.microsoft.com/SqlServer/Dts" DTS:ObjectName="orders_pkg">
 <DTS:Variables><DTS:Variable DTS:ObjectName="Since"><DTS:VariableValue>1996-01-01</DTS:VariableValue></DTS:Variable></DTS:Variables>
 <DTS:Executable DTS:ObjectName="flow"><DTS:ObjectData><pipeline>
  <component refId="src" componentClassID="Microsoft.OLEDBSource" name="src"><properties><property name="SqlCommand">SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM dbo.orders WHERE o_orderdate &gt;= ?</property></properties>
   <outputs><output refId="src.o" name="o"><columns><column name="o_orderkey" dataType="i8"/><column name="o_custkey" dataType="i8"/><column name="o_totalprice" dataType="r8"/><column name="o_orderstatus" dataType="wstr"/></columns></output></outputs></component>
  <component refId="big" componentClassID="Microsoft.OLEDBDestination" name="big_dst"><properties><property name="OpenRowset">[dbo].[big_orders]</property></properties><inputs><input refId="big.i" name="i"/></inputs></component>
  <component refId="lkp" componentClassID="Microsoft.Lookup" name="lkp"><properties><property name="ReferenceTableName">[dbo].[cust]</property><property name="JoinKeys">o_custkey</property></properties><inputs><input refId="lkp.i" name="i"/></inputs>
   <outputs><output refId="lkp.o" name="o"><columns><column name="segment" dataType="wstr"/></columns></output></outputs></component>
  <component refId="der" componentClassID="Microsoft.DerivedColumn" name="der"><inputs><input refId="der.i" name="i"/></inputs><outputs><output refId="der.o" name="o"><columns>
    <column name="size" dataType="wstr" expression="o_totalprice &gt;= 100000 ? &quot;BIG&quot; : &quot;SMALL&quot;"/>
    <column name="label" dataType="wstr" expression="o_orderstatus == &quot;P&quot; ? &quot;open&quot; : o_orderstatus + &quot;-&quot; + segment"/></columns></output></outputs></component>
  <component refId="split" componentClassID="Microsoft.ConditionalSplit" name="split"><inputs><input refId="split.i" name="i"/></inputs><outputs>
    <output refId="split.big" name="big"><properties><property name="EvaluationExpression">size == "BIG"</property></properties></output>
    <output refId="split.rest" name="rest" isDefault="true"/></outputs></component>
  <component refId="dst" componentClassID="Microsoft.OLEDBDestination" name="dst"><properties><property name="OpenRowset">[dbo].[stg_orders]</property></properties><inputs><input refId="dst.i" name="i"/></inputs></component>
  <paths><path startId="src.o" endId="lkp.i"/><path startId="lkp.o" endId="der.i"/><path startId="der.o" endId="split.i"/><path startId="split.big" endId="big.i"/><path startId="split.rest" endId="dst.i"/></paths>
 </pipeline></DTS:ObjectData></DTS:Executable>
</DTS:Executable>"""


@query("""SELECT CASE WHEN o_totalprice >= 100000 THEN 'big_orders' ELSE 'stg_orders' END AS target, o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'BIG'
  ELSE 'SMALL' END AS size, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE o_orderstatus || '-' || c_mktsegment END AS label FROM orders LEFT JOIN
  customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'""")
def q_package_ssis(spark, d):
    """Each output of a conditional split in its own destination."""
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    made = ssis.parse(DTSX).run(_context(spark, d, cust=cust))
    big, rest = (made[t].select(F.lit(t).alias("target"), "o_orderkey", "size", "label") for t in ("big_orders", "stg_orders"))
    return big.unionByName(rest)


# --- graphs: part type -> brand -> size chains and customer -> nation -> region ------------------------------


def _edges(spark, d):
    """A DAG over names: customers, nations, regions and an all node."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    a = c.select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("dst"))
    b = n.select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"))
    top = r.select(F.concat(F.lit("R"), "r_regionkey"), F.lit("ALL"))
    skip = c.filter("c_acctbal > 9000").select(F.concat(F.lit("C"), "c_custkey"), F.lit("ALL"))
    return a.union(b).union(top).union(skip).distinct()


_E = """e AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst FROM customer UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION
  SELECT 'R' || r_regionkey, 'ALL' FROM region UNION SELECT 'C' || c_custkey, 'ALL' FROM customer WHERE c_acctbal > 9000)"""
_P = f"WITH RECURSIVE {_E}, p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)"


@query(f"{_P} SELECT src, dst FROM p")
def q_closure_downstream(spark, d):
    return graph.closure(_edges(spark, d))


@query(f"{_P} SELECT DISTINCT src AS node, EXISTS (SELECT 1 FROM p q WHERE q.src = e.src AND q.dst = 'R1') AS reaches FROM e WHERE src LIKE 'C%'")
def q_reachability(spark, d):
    e = _edges(spark, d)
    return graph.reach_outputs(e, e.filter("src like 'C%'").select(F.col("src").alias("node")), graph.seeds(spark, ["R1"]))


@query(f"""WITH RECURSIVE {_E}, w AS (SELECT DISTINCT src AS node, 1 AS wave FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.wave + 1 FROM w
  JOIN e ON w.node = e.src) SELECT node, max(wave)::INT AS wave, false AS in_cycle FROM w GROUP BY 1""")
def q_wave_depth(spark, d):
    return graph.waves(_edges(spark, d))


_LOOPS = "l AS (SELECT src, dst FROM e UNION SELECT 'R2', 'C6' UNION SELECT 'ALL', 'ALL')"


@query(f"""WITH RECURSIVE {_E}, {_LOOPS}, p AS (SELECT src, dst FROM l UNION SELECT p.src, l.dst FROM p JOIN l ON p.dst = l.src) SELECT a.src AS node, min(a.dst)
  AS cycle FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY 1""")
def q_cycle_nodes(spark, d):
    e = _edges(spark, d).union(spark.createDataFrame([("R2", "C6"), ("ALL", "ALL")], "src string, dst string"))
    return graph.cycle_nodes(e)


def _lineage(spark, d):
    """Column edges out of events: users to pipeline steps to outputs, with operations by event type."""
    e = table(spark, d, "events")
    op = F.element_at(F.array(*map(F.lit, ("extract", "transform", "join", "aggregate", "load", "update", "fk"))), (F.col("event_id") % 7 + 1).cast("int"))
    src = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("SOURCE.U"), F.col("user_id") % 40)).otherwise(F.concat(F.lit("PIPELINE.P"), F.col("user_id") % 15, F.lit(".S"), F.col("event_id") % 3))
    dst = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("PIPELINE.P"), F.col("event_id") % 15, F.lit(".S"), F.col("event_id") % 4)).otherwise(F.concat(F.lit("OUTPUTS.O"), F.col("event_id") % 20))
    return e.select(src.alias("source_fqn"), F.col("event_type").alias("source_column"), dst.alias("target_fqn"), F.col("event_type").alias("target_column"), op.alias("operation"))


_L = """l AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'SOURCE.U' || user_id % 40 ELSE 'PIPELINE.P' || user_id % 15 END AS src,
 CASE WHEN event_id % 2 = 0 THEN 'PIPELINE.P' || event_id % 15 ELSE 'OUTPUTS.O' || event_id % 20 END AS dst, event_type AS col,
 ['extract', 'transform', 'join', 'aggregate', 'load', 'update', 'fk'][event_id % 7 + 1] AS operation FROM events)"""
_RANK = "CASE operation WHEN 'aggregate' THEN 100 WHEN 'join' THEN 90 WHEN 'transform' THEN 80 WHEN 'fk' THEN 60 WHEN 'extract' THEN 30 WHEN 'load' THEN 20 ELSE 0 END"


@query(f"WITH {_L} SELECT src, dst, arg_max(operation, {_RANK}) AS operation FROM l GROUP BY 1, 2")
def q_edge_collapse_priority(spark, d):
    return graph.collapsed(_lineage(spark, d))


_F = f"""WITH RECURSIVE {_L}, g AS (SELECT DISTINCT src, dst FROM l WHERE operation <> 'update'),
 dn AS (SELECT 'PIPELINE.P3' AS node UNION SELECT g.dst FROM dn JOIN g ON g.src = dn.node), up AS (SELECT 'PIPELINE.P3' AS node UNION SELECT g.src FROM up JOIN g ON g.dst = up.node),
 a AS (SELECT node FROM dn UNION SELECT node FROM up)"""


@query(f"{_F} SELECT src, dst, arg_max(operation, {_RANK}) AS operation FROM l WHERE src IN (FROM a) AND dst IN (FROM a) GROUP BY 1, 2")
def q_pipeline_focus(spark, d):
    return graph.focus(_lineage(spark, d), "P3")


@query(f"""WITH {_L}, u AS (SELECT src AS node, col, dst AS partner, operation FROM l UNION ALL SELECT dst, col, src, operation FROM l) SELECT node, col AS
  \"column\", bool_or(operation IN ('join', 'fk')) AS is_key, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, string_agg(DISTINCT
  partner, ',' ORDER BY partner) AS partners FROM u GROUP BY 1, 2""")
def q_column_partners(spark, d):
    flat = _lineage(spark, d).withColumn("source_fqn", graph.short(F.col("source_fqn"))).withColumn("target_fqn", graph.short(F.col("target_fqn")))
    return graph.partners(flat).select("node", "column", "is_key", F.array_join("operations", ",").alias("operations"), F.array_join("partners", ",").alias("partners"))


_SENS = """s AS (SELECT src AS node, CASE WHEN src LIKE 'C%' AND CAST(substr(src, 2) AS INT) % 9 = 0 THEN 4 WHEN src LIKE 'C%' AND CAST(substr(src, 2) AS INT) %
  4 = 0 THEN 2 WHEN src LIKE 'N%' AND CAST(substr(src, 2) AS INT) % 5 = 0 THEN 3 ELSE 0 END AS v FROM (SELECT src FROM e UNION SELECT dst FROM e))"""


@query(f"""{_P}, {_SENS} SELECT t.node, ['PUBLIC','INTERNAL','FINANCIAL','TAX','PII'][greatest(t.v, coalesce(max(f.v), 0)) + 1] AS sensitivity, coalesce(string_agg(DISTINCT
  CASE WHEN f.v > t.v THEN f.node END, ',' ORDER BY CASE WHEN f.v > t.v THEN f.node END), '') AS origins FROM s t LEFT JOIN (SELECT p.dst, s.node, s.v FROM p JOIN s ON p.src = s.node WHERE s.v >= 2) f ON
  f.dst = t.node GROUP BY t.node, t.v""")
def q_sensitivity_propagation(spark, d):
    e = _edges(spark, d)
    n = F.try_cast(F.substring("node", 2, 9), "int") if hasattr(F, "try_cast") else F.expr("try_cast(substr(node, 2) as int)")
    s = F.when(F.col("node").startswith("C") & (n % 9 == 0), "PII").when(F.col("node").startswith("C") & (n % 4 == 0), "FINANCIAL").when(F.col("node").startswith("N") & (n % 5 == 0), "TAX").otherwise("PUBLIC")
    columns = graph.nodes_of(e).withColumn("explicit_sensitivity", s)
    return graph.propagated(columns, e).join(graph.origins(columns, e), "node").select("node", "sensitivity", F.array_join("origins", ",").alias("origins"))


@query(f"""{_P}, u AS (SELECT src AS node, dst AS output FROM p WHERE dst LIKE 'R%' UNION SELECT dst, dst FROM e WHERE dst LIKE 'R%'), o AS (SELECT node,
  min(output) AS output FROM u GROUP BY 1 HAVING count(DISTINCT output) = 1) SELECT output, node FROM o WHERE output IN (SELECT output FROM o GROUP BY 1
  HAVING count(*) >= 2)""")
def q_exclusive_subgraph(spark, d):
    e = _edges(spark, d)
    return graph.exclusive(e, e.filter("dst like 'R%'").select(F.col("dst").alias("node")).distinct())


# --- catalog: events as a run log, event types as pipelines ------------------------------------------------------


def _runs(spark, d):
    return table(spark, d, "events").select(F.concat(F.lpad((F.col("user_id") % 12).cast("string"), 2, "0"), F.lit("_"), "event_type").alias("pipeline_name"), F.concat("event_type", F.lit(".csv")).alias("csv_generated"), F.when(F.col("value") > 20, "SUCCESS").otherwise("FAILED").alias("status"), F.col("ts").alias("start_time"))


_R = "r AS (SELECT lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') || '_' || event_type AS pipeline_name, event_type AS c, value > 20 AS ok, ts FROM events)"
_S = f"""WITH {_R}, k AS (SELECT c, count(*) AS total, count(*) FILTER (ok) AS good, min(ts) AS first_run, max(ts) AS last_run FROM r GROUP BY 1), p AS (SELECT
  * FROM (VALUES ('view', 'out/view.csv', true), ('click', 'out/click.csv', true), ('never', 'out/never.csv', false), ('dark', 'out/dark.csv', true))
  v(name, output_csv, csv_exists))"""


def _pipelines(spark):
    rows = [("view", "out/view.csv", True, ["orders", "customer"]), ("click", "out/click.csv", True, ["orders", "RAW.part"]), ("never", "out/never.csv", False, ["nation"]), ("dark", "out/dark.csv", True, ["customer"])]
    return spark.createDataFrame(rows, "name string, output_csv string, csv_exists boolean, source_tables array<string>")


@query(f"""WITH {_R} SELECT pipeline_name, count(*) AS runs_total, count(*) FILTER (ok) AS runs_success, count(*) FILTER (NOT ok) AS runs_failed, min(ts) AS
  first_run, max(ts) AS last_run FROM r GROUP BY 1""")
def q_run_stats_by_event_type(spark, d):
    return catalog.run_stats(_runs(spark, d)).drop("csv_generated")


@query(f"""{_S} SELECT p.name AS pipeline_name, coalesce(total, 0) AS runs_total, CASE WHEN total IS NULL THEN CASE WHEN csv_exists THEN 'off-grid' ELSE
  'never-run' END WHEN good < total THEN 'failing' ELSE 'healthy' END AS status FROM p LEFT JOIN k ON k.c = p.name UNION ALL SELECT (SELECT
  min(pipeline_name) FROM r WHERE r.c = k.c), total, 'undocumented' FROM k WHERE c NOT IN (SELECT name FROM p)""")
def q_pipeline_status(spark, d):
    m = catalog.matched_runs(_pipelines(spark), catalog.run_stats(_runs(spark, d)))
    return catalog.pipeline_usage(m).select("pipeline_name", "runs_total", "status")


@query(f"""{_S}, u AS (SELECT * FROM (VALUES ('view', 'SOURCE.ORDERS'), ('view', 'SOURCE.CUSTOMER'), ('click', 'SOURCE.ORDERS'), ('click', 'RAW.PART'), ('never',
  'SOURCE.NATION'), ('dark', 'SOURCE.CUSTOMER')) v(name, fqn)) SELECT fqn, CAST(sum(coalesce(total, 1)) AS BIGINT) AS read_count FROM u LEFT JOIN k ON
  k.c = u.name GROUP BY 1""")
def q_read_pressure(spark, d):
    p = _pipelines(spark)
    return catalog.read_pressure(p, catalog.matched_runs(p, catalog.run_stats(_runs(spark, d))))


@query(f"""{_S} SELECT CASE WHEN total IS NULL THEN CASE WHEN csv_exists THEN 'critical' ELSE 'warn' END WHEN 100.0 * (total - good) / total >= 10 THEN
  'critical' ELSE 'warn' END AS severity, p.name AS object FROM p LEFT JOIN k ON k.c = p.name WHERE total IS NULL OR 100.0 * (total - good) / total >= 5
  UNION ALL SELECT 'critical', (SELECT min(pipeline_name) FROM r WHERE r.c = k.c) FROM k WHERE c NOT IN (SELECT name FROM p) UNION ALL SELECT 'warn',
  'DW.' || name FROM (SELECT DISTINCT ['RAW_', 'STG_', 'DIM_', 'RPT_', 'OLD_LEGACY_', 'T'][p_size % 6 + 1] || p_partkey % 50 AS name FROM part) WHERE
  name NOT LIKE 'DIM%'""")
def q_catalog_flags(spark, d):
    t = _tables(spark, d)
    keys = t.select(F.col("fqn").alias("table_fqn"), F.col("name").startswith("DIM").alias("is_pk"))
    return catalog.flags(t, keys, catalog.matched_runs(_pipelines(spark), catalog.run_stats(_runs(spark, d)))).select("severity", "object")


def _awr(spark, d):
    e = table(spark, d, "events")
    sql = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("insert into DW.T"), F.col("user_id") % 9, F.lit(" select 1"))).otherwise(F.concat(F.lit("select * from DW.T"), F.col("user_id") % 7, F.lit(" join raw.base on 1 = 1")))
    return e.select(sql.alias("sql_text"), (F.col("event_id") % 4 + 1).alias("executions"), F.col("event_type").alias("user"), F.col("ts").alias("last_active"))


_A = """a AS (SELECT 'DW.T' || user_id % 9 AS fqn, true AS w, event_id % 4 + 1 AS n, event_type AS u FROM events WHERE event_id % 5 = 0 UNION ALL SELECT
  'DW.T' || user_id % 7, false, event_id % 4 + 1, event_type FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT 'RAW.BASE', false, event_id % 4 + 1,
  event_type FROM events WHERE event_id % 5 <> 0)"""
_AU = f"""WITH {_A}, g AS (SELECT fqn, CAST(sum(CASE WHEN w THEN 0 ELSE n END) AS BIGINT) AS read_count, CAST(sum(CASE WHEN w THEN n ELSE 0 END) AS BIGINT) AS
  write_count, count(DISTINCT u) AS distinct_users FROM a GROUP BY 1)"""


@query(f"{_AU} SELECT * FROM g")
def q_awr_usage(spark, d):
    return catalog.awr_usage(_awr(spark, d)).select("fqn", "read_count", "write_count", "distinct_users")


@query(f"{_AU} SELECT fqn FROM g WHERE write_count > 0 AND read_count = 0")
def q_write_only_orphans(spark, d):
    return catalog.write_only(catalog.awr_usage(_awr(spark, d)))


def _tables(spark, d):
    """A catalog out of parts: names by brand and size."""
    p = table(spark, d, "part")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("RAW_", "STG_", "DIM_", "RPT_", "OLD_LEGACY_", "T"))), (F.col("p_size") % 6 + 1).cast("int")), F.col("p_partkey") % 50)
    return p.select(name.alias("name")).distinct().select(F.concat(F.lit("DW."), "name").alias("fqn"), F.lit("DW").alias("schema_name"), "name", F.lit("TABLE").alias("kind"), F.expr("timestamp_ntz'2010-01-01' + make_dt_interval(cast(xxhash64('x') % 1 as int) + length(name) * 500)").alias("last_analyzed"))


_T = "t AS (SELECT DISTINCT ['RAW_', 'STG_', 'DIM_', 'RPT_', 'OLD_LEGACY_', 'T'][p_size % 6 + 1] || p_partkey % 50 AS name FROM part)"


@query(f"""WITH {_T} SELECT 'DW.' || name AS fqn FROM t WHERE 'DW.' || name NOT IN (SELECT 'DW.T' || user_id % 9 FROM events WHERE event_id % 5 = 0 UNION SELECT
  'DW.T' || user_id % 7 FROM events WHERE event_id % 5 <> 0)""")
def q_dead_objects(spark, d):
    return catalog.dead(_tables(spark, d), catalog.awr_usage(_awr(spark, d)))


@query(f"""WITH {_T} SELECT name, CASE WHEN name LIKE 'RAW!_%' ESCAPE '!' THEN 'RAW' WHEN name LIKE 'STG!_%' ESCAPE '!' THEN 'STAGING' WHEN name LIKE 'DIM!_%'
  ESCAPE '!' THEN 'INTEGRATION' WHEN name LIKE 'RPT!_%' ESCAPE '!' THEN 'REPORTING' ELSE 'UNKNOWN' END AS layer, CASE WHEN name LIKE 'RAW!_%' ESCAPE '!'
  OR name LIKE 'STG!_%' ESCAPE '!' THEN 'staging' WHEN name LIKE 'DIM!_%' ESCAPE '!' THEN 'reporting' ELSE 'transformation' END AS tag FROM t""")
def q_layer_rules(spark, d):
    return _tables(spark, d).select("name", catalog.layer(F.col("name")).alias("layer"), catalog.tag(F.col("name")).alias("tag"))


_NAMES = ("c_customer", "fund_fee", "tax_log", "ref_state", "x", "account_txn", "member_name", "c_acctbal", "order_id", "status", "work_email")


def _names(spark, d):
    """Column names out of parts: a fixed stem and the part's brand."""
    stem = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("_"), stem).alias("name"))


_N = f"n AS (SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '_' || {list(_NAMES)}[p_partkey % {len(_NAMES)} + 1] AS name FROM part)"


@query(f"WITH {_N} SELECT name, CASE {' '.join(f'WHEN contains(upper(name), {a!r}) THEN {b!r}' for a, b in catalog.DOMAINS)} ELSE 'OTHER' END AS domain FROM n")
def q_domain_rules(spark, d):
    return _names(spark, d).select("name", catalog.domain(F.col("name")).alias("domain"))


_DEC = f"""WITH {_T}, m AS (SELECT 'DW.' || name AS fqn, name, name LIKE '%LEGACY%' AS legacy, (TIMESTAMP '2010-01-01' + to_days(CAST(length(name) * 500 AS INT))) AS seen, CAST(regexp_extract(name, '[0-9]+$') AS INT) AS k FROM t),
 z AS (SELECT *, date_diff('day', seen, TIMESTAMP '2024-06-01') AS days FROM m),
 y AS (SELECT fqn, greatest(0, least(100, 100 - CASE WHEN k BETWEEN 5 AND 20 THEN 30 ELSE 0 END - CASE WHEN k <= 9 THEN 60 ELSE 0 END - CASE WHEN k BETWEEN 30 AND 44 THEN 30 ELSE 0 END - CASE WHEN k >= 40 THEN 10 ELSE 0 END + CASE WHEN days > 2555 THEN 20 ELSE 0 END + CASE WHEN legacy THEN 15 ELSE 0 END)) AS score FROM z)"""


@query(f"{_DEC} SELECT fqn, score::INT AS score, CASE WHEN score >= 80 THEN 'safe' WHEN score >= 50 THEN 'review' ELSE 'blocked' END AS verdict FROM y")
def q_decommission_score(spark, d):
    t = _tables(spark, d)
    k = F.regexp_extract("name", "[0-9]+$", 0).cast("int")
    by = lambda low, high: t.filter(k.between(low, high)).select("fqn", F.lit("p").alias("by"))
    return catalog.decommission(t, by(0, 9), by(5, 20), by(30, 44), by(40, 49), "timestamp_ntz'2024-06-01'").select("fqn", "score", "verdict")


_WRITERS = ("load", "purge", "x_mel", "x_syd", "one", "two", "raw_in")


@query(f"""WITH w AS (SELECT DISTINCT {list(_WRITERS)}[event_id % 7 + 1] AS base, {list(_WRITERS)}[event_id % 7 + 1] || '_' || user_id % 2 AS name, 't' || user_id % 300 || '.csv' AS target FROM events),
 g AS (SELECT target, string_agg(DISTINCT name, ',' ORDER BY name) AS writers, count(DISTINCT name) AS n, bool_or(base = 'purge') AS ends, count(DISTINCT CASE base WHEN 'x_mel' THEN 'mel' WHEN 'x_syd' THEN 'syd' WHEN 'raw_in' THEN 'raw' END) AS origins FROM w GROUP BY 1)
SELECT target, writers, CASE WHEN ends THEN 'lifecycle' WHEN origins >= 2 THEN 'disjoint' WHEN n <= 3 THEN 'update_back' ELSE 'unknown' END AS pattern FROM g WHERE n >= 2""")
def q_multi_writer(spark, d):
    base = F.element_at(F.array(*map(F.lit, _WRITERS)), (F.col("event_id") % 7 + 1).cast("int"))
    rows = table(spark, d, "events").select(F.concat(base, F.lit("_"), F.col("user_id") % 2).alias("name"), F.concat(F.lit("t"), F.col("user_id") % 300, F.lit(".csv")).alias("output_csv"))
    return catalog.multi_writers(rows).select("target", F.array_join("writers", ",").alias("writers"), "pattern")


@query("""SELECT p_partkey, greatest(0, least(100, 100 - 25 * (p_size % 4) - 10 * (p_size % 3) - 5 * (p_size % 2) - CASE WHEN p_size > 40 THEN 10 ELSE 0
  END))::INT AS confidence FROM part""")
def q_confidence_score(spark, d):
    files = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("errors"), (F.col("p_size") % 3).alias("warnings"), (F.col("p_size") % 2).alias("parser_warnings"), (F.col("p_size") > 40).alias("has_star"))
    return catalog.confidence(files).select("p_partkey", "confidence")


# --- parity -----------------------------------------------------------------------------------------------------------


def _copy(spark, d):
    """Orders with one price raised and one column gone."""
    o = table(spark, d, "orders")
    top = F.broadcast(o.agg(F.max("o_orderkey").alias("_top")))  # one row
    return o.crossJoin(top).withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.col("_top"), F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice"))).drop("o_orderpriority", "_top")


@query("""SELECT 'o_orderkey' AS column_name, count(*) FILTER (o_orderkey IS NULL) AS nulls, count(DISTINCT o_orderkey) AS distincts, min(o_orderkey)::DOUBLE AS low, max(o_orderkey)::DOUBLE AS high, NULL::VARCHAR AS low_text FROM orders
UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus IS NULL), count(DISTINCT o_orderstatus), NULL, NULL, min(o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderdate', count(*) FILTER (o_orderdate IS NULL), count(DISTINCT o_orderdate), NULL, NULL, NULL FROM orders""")
def q_profile_columns(spark, d):
    return parity.profile(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")).select("column_name", "nulls", "distincts", "low", "high", "low_text")


@query("SELECT 'orders' AS table_name, count(*) AS a_rows, count(*) AS b_rows, 0::BIGINT AS columns_drifted, 'match' AS status FROM orders")
def q_parity_match(spark, d):
    o = table(spark, d, "orders")
    return parity.verdict(parity.compared(o, o.repartition(3)), "orders").drop("columns_compared")


def _agree(column: str, total: str = "true") -> str:
    pairs = " AND ".join(f"{f} IS NOT DISTINCT FROM {f.replace('a.', 'b.')}" for f in (f"count(DISTINCT a.{column})", f"min(a.{column})", f"max(a.{column})"))
    return f"SELECT '{column}' AS column_name, 'both' AS side, {pairs} AND {total} AS matches FROM o a JOIN c b USING (k)"


@query(f"""WITH o AS (SELECT o_orderkey AS k, *, CAST(o_totalprice AS DECIMAL(14,2)) AS price FROM orders), top AS (SELECT max(o_orderkey) AS m FROM orders),
 c AS (SELECT o.* REPLACE (CASE WHEN k = m THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice, CAST(CASE WHEN k = m THEN o_totalprice + 1000 ELSE o_totalprice END AS DECIMAL(14,2)) AS price) FROM o, top)
{_agree("o_orderkey")} UNION ALL {_agree("o_custkey")} UNION ALL {_agree("o_orderstatus")}
UNION ALL SELECT 'o_orderdate', 'both', count(DISTINCT a.o_orderdate) = count(DISTINCT b.o_orderdate) FROM o a JOIN c b USING (k)
UNION ALL {_agree("o_totalprice", "abs(sum(a.o_totalprice) - sum(b.o_totalprice)) <= 1e-6 * greatest(abs(sum(a.o_totalprice)), 1)")}
UNION ALL {_agree("price", "sum(a.price) = sum(b.price)")} UNION ALL SELECT 'o_orderpriority', 'a_only', false""")
def q_parity_drift(spark, d):
    """One raised price: within the tolerance of a sum of floats, or not, by the table's size; never within that of exact numbers."""
    exact = F.col("o_totalprice").cast("decimal(14,2)")
    a, b = (x.withColumn("price", exact) for x in (table(spark, d, "orders"), _copy(spark, d)))
    return parity.compared(a, b).select("column_name", "side", "matches")


@query("""SELECT upper(column_name) AS column_name, CASE upper(column_name) WHEN 'O_TOTALPRICE' THEN 'retyped' WHEN 'O_ORDERPRIORITY' THEN 'removed' ELSE 'same'
  END AS state FROM information_schema.columns WHERE table_name = 'orders' UNION ALL SELECT 'EXTRA', 'added'""")
def q_schema_diff(spark, d):
    b = _copy(spark, d).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("extra", F.lit(1))
    return parity.schema_diff(spark, table(spark, d, "orders"), b).select("column_name", "state")


@query("""SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'pipeline' ELSE 'source' END AS role, CASE WHEN c_custkey % 5 = 0 THEN 'bq_derived' WHEN
  c_acctbal > 2000 THEN 'oracle_origin' WHEN c_acctbal > 0 THEN 'view_origin' ELSE 'csv_stub' END AS classification, c_acctbal > 2000 AS in_source FROM
  customer""")
def q_parity_targets(spark, d):
    c = table(spark, d, "customer")
    names = c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "pipeline").otherwise("source").alias("role"))
    return parity.classified(names, c.filter("c_acctbal > 2000").select(F.upper("c_name").alias("name")), c.filter("c_acctbal > 0").select(F.lower("c_name").alias("name")))


_PAIRS = """p AS (SELECT 'nation' AS t, 'oracle_origin' AS kind, (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM nation) AS b
 UNION ALL SELECT 'customer', 'oracle_origin', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_acctbal >= 0)
 UNION ALL SELECT 'stub', 'csv_stub', NULL, (SELECT count(*) FROM nation) UNION ALL SELECT 'mart', 'bq_derived', NULL, (SELECT count(*) FROM region) UNION ALL SELECT 'gone', 'view_origin', NULL, NULL),
 v AS (SELECT *, CASE WHEN kind = 'csv_stub' THEN 'skipped' WHEN a IS NULL AND b IS NULL THEN 'missing_both' WHEN a IS NULL THEN 'missing_in_source' WHEN a = b THEN 'match' ELSE 'drift' END AS status FROM p)"""


def _verified(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    pairs = {"nation": (n, n, "oracle_origin"), "customer": (c, c.filter("c_acctbal >= 0"), "oracle_origin"), "stub": (None, n, "csv_stub"), "mart": (None, table(spark, d, "region"), "bq_derived"), "gone": (None, None, "view_origin")}
    return parity.verified(pairs, spark)


@query(f"WITH {_PAIRS} SELECT status, count(*) AS n FROM v GROUP BY 1")
def q_parity_summary(spark, d):
    return parity.summary(_verified(spark, d))


@query(f"""WITH {_PAIRS} SELECT t AS table_name, a AS a_rows, b AS b_rows, status, CASE WHEN kind = 'bq_derived' AND status = 'missing_in_source' THEN
  'target_output' ELSE status END AS display_status FROM v""")
def q_parity_display(spark, d):
    return _verified(spark, d).select("table_name", "a_rows", "b_rows", "status", "display_status")


# --- change data ---------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS action FROM events GROUP BY 1)
SELECT user_id, event_id, value FROM l WHERE action <> 'purchase' UNION ALL SELECT c_custkey, 0, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)""")
def q_cdc_latest_apply(spark, d):
    """The last event of each user applied to a table of customers; a purchase deletes."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.col("c_acctbal").alias("value"))
    changes = table(spark, d, "events").select("user_id", "event_id", "value", "ts", F.when(F.col("event_type") == "purchase", "DELETE").otherwise("UPDATE").alias("action"))
    return cdc.applied(base, changes, ["user_id"], [F.col("ts"), F.col("event_id")])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_windowed_events(spark, d):
    out = cdc.windowed(table(spark, d, "events"), "ts", "10 minutes", "1 hour", None, ["event_type"], [F.count(F.lit(1)).alias("n")])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


# --- further sources, lineage and catalog reports -----------------------------------------------------------------------------


@query("""SELECT c_custkey, CAST(floor(months / 12) AS BIGINT) AS age FROM (SELECT c_custkey, (2024 - (1950 + c_custkey % 50)) * 12 + 6 - (1 + c_custkey % 12) -
  CASE WHEN 1 + c_custkey % 28 > 15 THEN 1 ELSE 0 END AS months FROM customer)""")
def q_calculate_age(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("make_date(1950 + cast(c_custkey % 50 as int), 1 + cast(c_custkey % 12 as int), 1 + cast(c_custkey % 28 as int))").alias("dob"))
    out = xml_frontend.OPERATIONS["calculate_age"]({"dob_column": "dob", "result_column": "age", "as_of": "date'2024-06-15'"})(c)
    return out.select("c_custkey", F.col("age").cast("long").alias("age"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS source FROM orders GROUP BY 1")
def q_source_text_assembly(spark, d):
    lines = table(spark, d, "orders").select(F.lit("o").alias("owner"), F.col("o_custkey").alias("name"), F.lit("P").alias("type"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("text"))
    return readers.source_text(lines).select(F.col("name").alias("o_custkey"), "source")


@query("""SELECT url, CASE WHEN k = 0 THEN 'ddl' WHEN k = 1 THEN 'etl' WHEN k = 2 THEN 'dictionary' WHEN k = 3 THEN 'output' ELSE 'other' END AS kind FROM
  (SELECT 'b/' || event_id || ['.sql', '.xml', '_dba_x.csv', '.csv', '.bin'][event_id % 5 + 1] AS url, event_id % 5 AS k FROM events)""")
def q_file_kinds(spark, d):
    ends = F.element_at(F.array(*map(F.lit, (".sql", ".xml", "_dba_x.csv", ".csv", ".bin"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select(F.concat(F.lit("b/"), "event_id", ends).alias("url")).withColumn("kind", readers.file_kind(F.col("url")))


@query("SELECT DISTINCT event_type || '_' || user_id % 10 AS name, user_id % 10 < 6 AND event_type <> 'view' AS csv_exists FROM events")
def q_output_cross_check(spark, d):
    p = table(spark, d, "events").select(F.concat("event_type", F.lit("_"), F.col("user_id") % 10).alias("name"), (F.col("user_id") % 10).alias("k"), "event_type").distinct()
    files = p.filter("k < 6 and event_type <> 'view'").select(F.concat(F.lit("store/x/"), F.upper("name"), F.lit(".CSV")).alias("path"))
    return catalog.output_check(p.select("name", F.concat(F.lit("out/"), "name", F.lit(".csv")).alias("output_csv")), files).select("name", "csv_exists")


@query("""WITH t AS (SELECT 'ORDERS' AS n, count(*) AS rows FROM orders UNION ALL SELECT 'CUSTOMER', count(*) FROM customer UNION ALL SELECT 'PART', count(*)
  FROM part), u AS (SELECT * FROM (VALUES ('view', 'ORDERS'), ('view', 'CUSTOMER'), ('click', 'ORDERS'), ('click', 'PART'), ('never', 'NATION'),
  ('dark', 'CUSTOMER')) v(name, n)) SELECT name, count(*) AS sources, CAST(coalesce(sum(rows * 100), 0) AS BIGINT) AS bytes, max(rows) AS max_rows FROM
  u LEFT JOIN t USING (n) GROUP BY 1""")
def q_parity_preview(spark, d):
    out = None
    for n in ("orders", "customer", "part"):
        one = table(spark, d, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("row_count")).withColumn("bytes", F.col("row_count") * 100)
        out = one if out is None else out.unionByName(one)
    return catalog.parity_preview(_pipelines(spark), out)


@query(f"""{_S} SELECT 'pipeline' AS kind, p.name, total IS NOT NULL OR csv_exists AS in_scope FROM p LEFT JOIN k ON k.c = p.name UNION ALL SELECT 'table', 'T'
  || i.generate_series, i.generate_series % 2 = 1 FROM generate_series(1, 4) i""")
def q_scope_manifest(spark, d):
    m = catalog.matched_runs(_pipelines(spark), catalog.run_stats(_runs(spark, d)))
    t = spark.range(1, 5).select(F.concat(F.lit("T"), "id").alias("fqn"), F.when(F.col("id") % 2 == 0, "safe").otherwise("review").alias("verdict"))
    return catalog.scope(m, t).select("kind", "name", "in_scope")


@query("""SELECT u * 7.0::DOUBLE + t * 5.0::DOUBLE AS manual_days, u * 0.5::DOUBLE + t * 1.0::DOUBLE AS assisted_days, u * 6.5::DOUBLE + t * 4.0::DOUBLE AS
  days_saved, (u * 7.0::DOUBLE + t * 5.0::DOUBLE) / (u * 0.5::DOUBLE + t) AS speedup, b / 1e9::DOUBLE * 0.02::DOUBLE AS storage_month, b * u * 30 /
  1e12::DOUBLE * 5 AS query_month FROM (SELECT count(DISTINCT user_id) AS u, count(DISTINCT event_type) AS t, count(*) * 1e6::DOUBLE AS b FROM events)""")
def q_roi_projection(spark, d):
    e = table(spark, d, "events").agg(F.count_distinct("user_id").alias("u"), F.count_distinct("event_type").alias("t"), (F.count(F.lit(1)) * F.lit(1e6)).alias("b"))
    return e.select(*catalog.roi(F.col("u"), F.col("t"), F.col("b"))).select("manual_days", "assisted_days", "days_saved", "speedup", "storage_month", "query_month")


@query(f"""WITH RECURSIVE {_E}, w AS (SELECT DISTINCT src AS node, 0 AS depth FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.depth + 1 FROM w
  JOIN e ON w.node = e.src) SELECT node, max(depth)::INT AS depth FROM w GROUP BY 1""")
def q_layout_depth(spark, d):
    return graph.waves(_edges(spark, d)).select("node", (F.col("wave") - 1).alias("depth"))


@query(f"WITH {_N} SELECT name, CASE {' '.join(f'WHEN regexp_matches(name, {p!r}) THEN {v!r}' for v, p in catalog.SENSITIVE)} ELSE 'PUBLIC' END AS s FROM n")
def q_sensitivity_rules(spark, d):
    return _names(spark, d).select("name", catalog.sensitivity(F.col("name")).alias("s"))


@query("""WITH e AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'SOURCE.U' || user_id % 40 ELSE 'PIPELINE.P' || user_id % 15 || '.S' || event_id % 3 END AS src,
 CASE WHEN event_id % 2 = 0 THEN 'PIPELINE.P' || event_id % 15 || '.S' || event_id % 4 ELSE 'OUTPUTS.O' || event_id % 20 END AS dst FROM events)
SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'SOURCE%' AND b.dst LIKE 'OUTPUTS%'""")
def q_table_level_lineage(spark, d):
    return graph.table_level(_lineage(spark, d))


@query("""WITH n AS (SELECT lower(replace(n_name, ' ', '_')) AS t FROM nation), c AS (SELECT * FROM (VALUES ('total', 'total', 'extract'), ('k', 'k', 'extract'), ('total', 'tax', 'transform'), ('total', 'total', 'transform'), ('k', 'k', 'transform'), ('total', 'total', 'load'), ('k', 'k', 'load'), ('tax', 'tax', 'load')) v(source_column, target_column, operation))
SELECT t AS pipeline, source_column, target_column, operation FROM n, c""")
def q_column_lineage(spark, d):
    """One pipeline for each nation, its text made from the row."""
    from weftline.plans import lineage

    text = F.format_string('<pipeline name="%1$s"><steps><extract id="a"><query>SELECT k, total FROM %1$s</query></extract><transform id="b" input="a"><math operation="multiply" col1="total" val2="0.1" result_column="tax"/></transform><load id="c" input="b" type="csv" path="%1$s.csv"/></steps></pipeline>', "t")
    edges = lineage.pipeline_lineage(table(spark, d, "nation").select(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("t")).select(text.alias("text")))
    return edges.select(F.col("origin_object").alias("pipeline"), "source_column", "target_column", "operation").distinct()


@query("SELECT DISTINCT event_type AS file, 'T' || user_id % 90 AS ref FROM events WHERE user_id % 90 NOT IN (SELECT s_suppkey FROM supplier)")
def q_unresolved_refs(spark, d):
    refs = table(spark, d, "events").select(F.col("event_type").alias("file"), F.concat(F.lit("T"), F.col("user_id") % 90).alias("ref")).distinct()
    return parity.unresolved(refs, table(spark, d, "supplier").select(F.concat(F.lit("t"), "s_suppkey").alias("name")))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS size_id, p_name AS site_id FROM part")
def q_key_types(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.col("p_size").alias("size_id"), F.col("p_name").alias("site_id"))
    return R.cast_keys(p, {"partkey": "bigint", "size_id": "bigint", "site_id": "string"})


from weftline import queries_more, queries_stored, queries_text  # noqa: E402, F401  register their queries here
