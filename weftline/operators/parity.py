"""Parity of two copies of a table: aggregates of every column of either side, compared by column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import quoted

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
MEASURES = ("nulls", "distincts", "total", "exact", "low", "high", "low_text", "high_text")
TOLERANCE = 1e-6


def profile(df: DataFrame) -> DataFrame:
    """column_name, kind, row_count and the aggregates of every column.

    Nulls and exact distinct counts for all; sum, least and greatest of numbers
    as doubles, and the exact sum of whole and decimal numbers as text; least
    and greatest of strings as text; of dates the first two only.

    One scan and one exchange of values, whatever the number of columns: each
    row becomes a cell for each column, tasks add cells up by column and value
    before anything moves, and what the values hold is added up by column.
    Values are compared as text; zeros of either sign are one value.
    """
    kinds = {c: "number" if t.split("(")[0] in NUMERIC else "string" if t == "string" else "other" for c, t in df.dtypes}
    scale = {f.name: getattr(f.dataType, "scale", 0) for f in df.schema if kinds[f.name] == "number" and f.dataType.typeName() not in ("float", "double")}
    sums = {n: f"exact{n}" for n in sorted(set(scale.values()))}  # one exact sum for each scale
    cells = []
    for i, f in enumerate(df.schema):
        x, kind = F.col(quoted(f.name)), f.dataType.typeName()
        number = (x.cast("double") + F.lit(0.0)) if kinds[f.name] == "number" else F.lit(None).cast("double")
        text = F.base64(x) if kind == "binary" else F.to_json(x) if kind in ("map", "struct", "array", "variant") else (number if kind in ("float", "double") else x).cast("string")
        exact = [(x if scale.get(f.name) == n else F.lit(None)).cast(f"decimal(38,{n})").alias(c) for n, c in sums.items()]
        cells.append(F.struct(F.lit(i).alias("position"), text.alias("value"), number.alias("number"), *exact))
    values = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("position", "value")
    values = values.agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("number"), F.min("number").alias("low"), F.max("number").alias("high"), *[F.sum(c).alias(c) for c in sums.values()])
    found = values.groupBy("position").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"), F.count("value").alias("distincts"), F.sum("number").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("value").alias("low_text"), F.max("value").alias("high_text"), *[F.sum(c).alias(c) for c in sums.values()],
    )
    names = df.sparkSession.createDataFrame([(c.lower(), k, i, scale.get(c)) for i, (c, k) in enumerate(kinds.items())], "column_name string, kind string, position int, scale int")
    both = names.join(F.broadcast(found), "position", "left")  # a row for each column; of an empty table too
    exact = F.coalesce(*[F.when(F.col("scale") == n, F.col(c).cast("string")) for n, c in sums.items()], F.lit(None).cast("string"))
    total = F.when(F.col("scale").isNotNull(), F.coalesce(*[F.when(F.col("scale") == n, F.col(c).cast("double")) for n, c in sums.items()], F.lit(None).cast("double"))).otherwise(F.col("total"))
    none, text = F.lit(0).cast("long"), F.col("kind") == "string"
    counts = [F.coalesce(c, none).alias(c) for c in ("row_count", "nulls", "distincts")]
    return both.select("column_name", "kind", "position", *counts, total.alias("total"), exact.alias("exact"), "low", "high", F.when(text, F.col("low_text")).alias("low_text"), F.when(text, F.col("high_text")).alias("high_text"))


def compared(a: DataFrame, b: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per column of either side: both profiles, ``side`` (both, a_only, b_only) and ``matches``.

    Sums of whole and decimal numbers are compared exactly; those of floats may
    differ by ``tolerance`` times the larger of side a's sum and 1. Least and
    greatest are compared by type. A column on one side only is drift.
    """
    pa, pb = profile(a), profile(b)
    left = pa.select("column_name", *[F.col(m).alias(f"a_{m}") for m in ("position", "row_count", *MEASURES)])
    right = pb.select("column_name", *[F.col(m).alias(f"b_{m}") for m in ("position", "row_count", *MEASURES)])
    both = left.join(right, "column_name", "full")
    same = lambda m: F.col(f"a_{m}").eqNullSafe(F.col(f"b_{m}"))
    close = F.coalesce(F.abs(F.col("a_total") - F.col("b_total")) <= tolerance * F.greatest(F.abs("a_total"), F.lit(1.0)), F.col("a_total").isNull() & F.col("b_total").isNull())
    side = F.when(F.col("a_nulls").isNull(), "b_only").when(F.col("b_nulls").isNull(), "a_only").otherwise("both")
    close = F.when(F.col("a_exact").isNotNull() & F.col("b_exact").isNotNull(), same("exact")).otherwise(close)
    ok = same("nulls") & same("distincts") & close & same("low") & same("high") & same("low_text") & same("high_text")
    return both.withColumn("side", side).withColumn("matches", (side == "both") & ok)


def verdict(comparison: DataFrame, name: str) -> DataFrame:
    """One row: row counts, columns compared and in drift, and ``status`` match or drift."""
    return comparison.agg(
        F.lit(name).alias("table_name"), F.max("a_row_count").alias("a_rows"), F.max("b_row_count").alias("b_rows"), F.count_if(F.col("side") == "both").alias("columns_compared"),
        F.count_if(~F.col("matches")).alias("columns_drifted"), F.when(F.max("a_row_count").eqNullSafe(F.max("b_row_count")) & F.every(F.col("matches")), "match").otherwise("drift").alias("status"),
    )


def verified(pairs: Mapping[str, tuple[DataFrame | None, DataFrame | None, str]], spark) -> DataFrame:
    """table_name, classification, a_rows, b_rows, status, display_status over several tables.

    A pair is (source copy, target copy, classification); a missing copy is None.
    """
    out = None
    empty = spark.range(1)
    for name, (a, b, kind) in pairs.items():
        if kind == "csv_stub":
            status, rows = "skipped", None
        elif a is None or b is None:
            status, rows = "missing_both" if a is None and b is None else "missing_in_source" if a is None else "missing_in_target", None
        else:
            status, rows = None, verdict(compared(a, b), name)
        if rows is None:
            rows = empty.select(F.lit(name).alias("table_name"), F.lit(status).alias("status"))
            for side, df in (("a_rows", a), ("b_rows", b)):
                rows = rows.withColumn(side, F.lit(None).cast("long")) if df is None else rows.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(side))))  # one row each
        rows = rows.select("table_name", F.lit(kind).alias("classification"), "a_rows", "b_rows", "status")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("display_status", display(F.col("classification"), F.col("status")))


def display(kind, status):
    """Derived tables that the source never had are output, not a failure."""
    return F.when((kind == "bq_derived") & (status == "missing_in_source"), "target_output").otherwise(status)


def classified(names: DataFrame, tables: DataFrame, views: DataFrame) -> DataFrame:
    """``name``, ``role`` (source, pipeline) to its classification and whether the source side has it."""
    low = lambda df: df.select(F.lower("name").alias("_n")).distinct()
    t, v = low(tables).withColumn("_t", F.lit(True)), low(views).withColumn("_v", F.lit(True))
    both = names.withColumn("_n", F.lower("name")).join(t, "_n", "left").join(v, "_n", "left")
    kind = F.when(F.col("role") == "pipeline", "bq_derived").when(F.col("_t"), "oracle_origin").when(F.col("_v"), "view_origin").otherwise("csv_stub")
    return both.select("name", "role", kind.alias("classification"), F.coalesce("_t", F.lit(False)).alias("in_source"))


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def schema_diff(spark, a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of either side paired by upper name, in side a's order and then b's."""
    frame = lambda df, s: spark.createDataFrame([(c.upper(), t, i) for i, (c, t) in enumerate(df.dtypes)], f"column_name string, {s}_type string, {s}_pos int")
    both = frame(a, "a").join(frame(b, "b"), "column_name", "full")
    state = F.when(F.col("a_type").isNull(), "added").when(F.col("b_type").isNull(), "removed").when(F.col("a_type") != F.col("b_type"), "retyped").otherwise("same")
    return both.withColumn("state", state).orderBy(F.coalesce("a_pos", F.lit(1 << 30)), F.coalesce("b_pos", F.lit(0)))


def unresolved(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (file, ref) to names that no file defines."""
    names = files.select(F.lower("name").alias("_n")).distinct()
    return refs.join(names, F.lower("ref") == F.col("_n"), "left_anti")


#: What a project's settings must name.
REQUIRED = ("name", "warehouse", "default_schema")


def validated(spark, settings: Mapping[str, str], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """severity, check and object of a project's faults.

    ``nodes`` has name and kind (source, model), ``edges`` src and dst. Missing
    settings, names that are no identifiers or stand twice, unknown kinds,
    models that read nothing, references that nothing makes, and cycles.
    """
    from .graph import cycle_nodes

    found = lambda df, level, check, column: df.select(F.lit(level).alias("severity"), F.lit(check).alias("check"), F.col(column).cast("string").alias("object"))
    missing = spark.createDataFrame([(k,) for k in REQUIRED if not settings.get(k)], "k string")
    low = nodes.select(F.lower("name").alias("name"), "kind")
    made = low.select("name").distinct()
    ends = edges.select(F.lower("src").alias("src"), F.lower("dst").alias("dst"))
    parts = [
        found(missing, "error", "missing setting", "k"),
        found(nodes.filter(~F.col("name").rlike(r"^[A-Za-z_]\w*$")), "error", "bad name", "name"),
        found(low.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "error", "repeated name", "name"),
        found(nodes.filter(~F.col("kind").isin("source", "model")), "error", "unknown kind", "name"),
        found(low.filter("kind = 'model'").join(ends, F.col("name") == F.col("dst"), "left_anti"), "warn", "reads nothing", "name"),
        found(ends.join(made, F.col("src") == F.col("name"), "left_anti").select("src").distinct(), "error", "unresolved reference", "src"),
        found(cycle_nodes(ends), "error", "cycle", "node"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Conditions of Spark's analyser to the names that findings use; others keep the analyser's own.
CONDITIONS = {"PARSE_SYNTAX_ERROR": "syntax", "PARSE_EMPTY_STATEMENT": "syntax", "UNRESOLVED_COLUMN": "unknown column", "TABLE_OR_VIEW_NOT_FOUND": "unknown table", "UNRESOLVED_ROUTINE": "unknown function", "DATATYPE_MISMATCH": "type mismatch", "MISSING_AGGREGATION": "not grouped", "AMBIGUOUS_REFERENCE": "ambiguous column"}


def analysed(spark, texts, tables: Mapping[str, str]):
    """(name, check, line, position, detail) of each fault that Spark's parser and analyser find in statements; none is run.

    ``texts`` gives (name, text) one after another, such as a folder's files;
    ``tables`` names the relations that they may read, each with its schema, and
    they are empty here. Of a statement that changes a table the query is
    analysed. Parsing and analysis are the driver's work in Spark, so texts pass
    through it one at a time; their faults are yielded, not gathered.
    """
    import logging
    import re

    from pyspark.errors import AnalysisException, ParseException

    from weftline.plans import sqltext

    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL)  # faults are results here
    own = spark.newSession()
    for name, schema in tables.items():
        own.createDataFrame([], schema).createOrReplaceTempView(name)
    parser = own._jsparkSession.sessionState().sqlParser()
    for name, text in texts:
        statement = sqltext.classify(text)
        try:
            if statement.kind != "select":
                parser.parsePlan(text)
            if statement.query:
                own.sql(statement.query)
        except (ParseException, AnalysisException) as fault:
            condition = (fault.getCondition() or "").split(".")[0]
            at = re.search(r"line (\d+),? pos(?:ition)? (\d+)", str(fault))
            detail = fault.getMessageParameters() or {}
            yield name, CONDITIONS.get(condition, condition), int(at[1]) if at else None, int(at[2]) if at else None, (detail.get("objectName") or detail.get("relationName") or detail.get("routineName") or detail.get("error") or "").replace("`", "").strip("'")
