"""Queries of stored targets, streams and live databases: each writes a target made of the given tables and reads it back."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from weftline.operators import dml, stored, targets
from weftline.queries import ORACLE_SQL, _part_changes, query
from weftline.queries_more import _scratch
from weftline.session import table
from weftline.sources import jdbc, readers
from weftline.streaming import cdc

# --- targets in parts by key -----------------------------------------------------------


@query(ORACLE_SQL["incremental_upsert"])
def q_upsert_stored(spark, d):
    """An incremental target of which only the buckets of incoming keys are written again."""
    path = _scratch(spark, "target")
    stored.created(table(spark, d, "part").select("p_partkey", "p_name"), path, ["p_partkey"])
    stored.upserted(spark, path, _part_changes(spark, d).select(F.col("pk").alias("p_partkey"), F.col("pname").alias("p_name")), ["p_partkey"])
    return stored.current(spark, path)


@query(ORACLE_SQL["merge_conditional"])
def q_merge_stored(spark, d):
    path = _scratch(spark, "target")
    stored.created(table(spark, d, "part").select("p_partkey", "p_size"), path, ["p_partkey"])
    spec = dml.Merge({"p_partkey": "pk"}, [dml.When({"p_size": "0"}, "t.p_size > 25"), dml.When(None, "t.p_size > 10")], [dml.When({"p_partkey": "s.pk", "p_size": "s.psize"}, "s.psize > 20")])
    stored.merged(spark, path, _part_changes(spark, d), spec)
    return stored.current(spark, path)


# --- streams ----------------------------------------------------------------------------


@query(ORACLE_SQL["cdc_latest_apply"])
def q_cdc_stream_apply(spark, d):
    """Events as a stream of shuffled files, so that a user's older events come after newer ones; a purchase deletes."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.col("c_acctbal").alias("value"))
    changes = table(spark, d, "events").select("user_id", "event_id", "value", "ts", F.when(F.col("event_type") == "purchase", "DELETE").otherwise("UPDATE").alias("action"))
    path = _scratch(spark, "stream")
    changes.repartition(6, F.xxhash64("event_id")).write.parquet(f"{path}/in")
    stored.created(base, f"{path}/target", ["user_id"])
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    followed = cdc.follow_stored(stream, f"{path}/target", ["user_id"], "ts", f"{path}/log", late="3650 days", ties=["event_id"])
    followed.awaitTermination()
    return stored.current(spark, f"{path}/target")


# --- live databases -----------------------------------------------------------------------


def _database(spark) -> str:
    """The address of a new in-memory database in the driver's JVM."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:memory:w{uuid.uuid4().hex};create=true"


def _closed(spark, url: str) -> None:
    if ":memory:" in url:
        jdbc.shut(spark, url.replace(";create=true", ""), "drop")
    else:
        jdbc.shut(spark, url)


def _filled(spark, tables: dict[str, tuple]) -> str:
    """The address of a new database of the tables (rows, and types of text columns), which every task can open.

    Executors can't reach a database in the driver's JVM, and Spark brings no
    database server; there it is filled in the shared folder and read from it.
    """
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        url = _database(spark)
        for name, (rows, types) in tables.items():
            jdbc.put(rows, url, name, types)
        return url
    at = spark._jvm.java.net.URI(_scratch(spark, "database").replace(" ", "%20"))
    if at.getScheme() not in (None, "file"):
        raise RuntimeError(f"a database's files can't lie in {at.getScheme()}: on a cluster spark.checkpoint.dir must be a mounted folder here")
    folder = at.getPath()
    os.makedirs(folder)
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    for name, (rows, types) in tables.items():
        jdbc.loaded(rows, f"jdbc:derby:{folder}/live;create=true", name, f"{folder}/{name}", types)
    return jdbc.sealed(spark, folder, "live")


_TEXT = {"o_orderstatus": "VARCHAR(1)", "o_orderpriority": "VARCHAR(20)"}


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def q_jdbc_replication(spark, d):
    """Orders put into a database, replicated with the other tables of its schema by ranges of their key."""
    path = _scratch(spark, "raw")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    url = _filled(spark, {"orders": (o, _TEXT), "region": (table(spark, d, "region").select("r_regionkey", "r_name"), {"r_name": "VARCHAR(40)"})})
    try:
        jdbc.replicate(spark, url, "derby", "APP", path, {"orders": '"o_orderkey"'})
    finally:
        _closed(spark, url)
    return spark.read.parquet(f"{path}/orders")


@query("""SELECT lower(c.s) AS table_name, c.c AS column_name, c.p AS position, (SELECT count(*) FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F') AS rows_found
FROM (VALUES ('orders', 'o_orderkey', 1), ('orders', 'o_orderstatus', 2), ('orders', 'o_totalprice', 3)) c(s, c, p)""")
def q_jdbc_dictionary(spark, d):
    """The dictionary of a database beside a scan whose filters it answers."""
    path = _scratch(spark, "found")
    url = _filled(spark, {"orders": (table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), {"o_orderstatus": "VARCHAR(1)"})})
    try:
        _, columns = jdbc.dictionary(spark, url, "derby")
        rows = jdbc.scan(spark, url, "orders", '"o_orderkey"').filter("o_totalprice > 150000 AND o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("rows_found"))
        found = columns.filter("schema_name = 'APP'").select(F.lower("table_name").alias("table_name"), "column_name", "position").crossJoin(F.broadcast(rows))  # one row
        readers.write(found, path)
    finally:
        _closed(spark, url)
    return spark.read.parquet(path)


# --- several targets, checks and catalog tables --------------------------------------------


@query("""SELECT 'big' AS target, o_orderkey AS id, o_totalprice AS amount, NULL AS status FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT 'open', o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'all', o_custkey, o_totalprice, NULL FROM orders""")
def q_split_written(spark, d):
    """Three targets with columns of their own from one scan."""
    parts = {"big": ("o_totalprice > 200000", {"id": "o_orderkey", "amount": "o_totalprice"}), "open": ("o_orderstatus = 'O'", {"id": "o_orderkey", "status": "o_orderstatus"}), "all": (None, {"id": "o_custkey", "amount": "o_totalprice"})}
    out = targets.split_written(table(spark, d, "orders"), parts, _scratch(spark, "targets"))
    whole = None
    for name, df in out.items():
        columns = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("amount", "double"), ("status", "string"))]
        part = df.select(F.lit(name).alias("target"), *columns)
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query("""SELECT 'rows' AS "check", NULL AS "column", count(*) AS n FROM orders UNION ALL SELECT 'nulls', 'late', count(*) FILTER (o_totalprice <= 250000) FROM orders
UNION ALL SELECT 'repeated keys', 'o_custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def q_checked_write(spark, d):
    """Rows and nulls counted while they are written, repeated keys from what was written."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 250000, F.col("o_orderdate")).alias("late"))
    return targets.checked_write(o, _scratch(spark, "checked"), ["o_custkey"], ["late"])


@query("""WITH t AS (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey, c_name, t.n, t.top FROM customer JOIN t ON c_custkey = o_custkey WHERE t.n >= (SELECT avg(n) FROM t)""")
def q_stored_table(spark, d):
    """CTAS read twice: the aggregate is computed once, bucketed by its key."""
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    name = f"order_totals_{uuid.uuid4().hex[:8]}"
    made = targets.stored_table(by, name, _scratch(spark, "table"), ["o_custkey"])
    least = made.agg(F.avg("n").alias("least"))
    joined = table(spark, d, "customer").join(made, F.col("c_custkey") == F.col("o_custkey")).crossJoin(F.broadcast(least))  # one row
    return joined.filter("n >= least").select("c_custkey", "c_name", "n", "top")
