"""Column types of an Oracle dictionary as Spark types, and types guessed from names."""

from __future__ import annotations

import re

from pyspark.sql import types as T

TEXTS = ("VARCHAR2", "NVARCHAR2", "VARCHAR", "CHAR", "NCHAR", "CLOB", "NCLOB", "ROWID", "UROWID", "LONG", "XMLTYPE")
DOUBLES = ("FLOAT", "REAL", "DOUBLE", "DOUBLE PRECISION", "BINARY_FLOAT", "BINARY_DOUBLE")


def spark_type(declared: str) -> T.DataType:
    """Bare NUMBER keeps fractions; whole numbers are as narrow as their precision; a date has a time of day."""
    text = re.sub(r"\s+", " ", declared.strip().upper())
    m = re.match(r"([A-Z_0-9 ]+?)\s*(?:\(\s*(\d+|\*)\s*(?:CHAR|BYTE)?\s*(?:,\s*(-?\d+)\s*)?\))?(\s+WITH(?: LOCAL)? TIME ZONE)?$", text)
    if not m:
        return T.StringType()
    base, p, s = m[1].strip(), m[2], int(m[3] or 0)
    if base in TEXTS:
        return T.StringType()
    if base in ("NUMBER", "DECIMAL", "NUMERIC", "DEC"):
        if p is None:
            return T.DecimalType(38, 10)
        n = 38 if p == "*" else min(38, int(p))
        if s > 0:
            return T.DecimalType(n, min(s, n))
        return T.IntegerType() if n <= 9 else T.LongType() if n <= 18 else T.DecimalType(n, 0)
    if base in ("INTEGER", "INT", "SMALLINT", "BIGINT", "BINARY_INTEGER", "PLS_INTEGER"):
        return T.LongType()
    if base in DOUBLES:
        return T.DoubleType()
    if base == "DATE":
        return T.TimestampNTZType()
    if base == "TIMESTAMP":
        return T.TimestampType() if m[4] else T.TimestampNTZType()
    if base in ("RAW", "LONG RAW", "BLOB", "BFILE"):
        return T.BinaryType()
    return T.BooleanType() if base == "BOOLEAN" else T.StringType()


def guessed(name: str) -> T.DataType:
    """A type from a column's name, for sources without a schema."""
    n = name.lower()
    if n.startswith("is_") or n.endswith("_flag"):
        return T.BooleanType()
    if n.endswith("_date"):
        return T.DateType()
    if n.endswith(("_at", "_time", "_ts")):
        return T.TimestampNTZType()
    if n.endswith(("_amount", "_rate", "_price", "_balance", "_total", "_pct", "_value")):
        return T.DoubleType()
    if n.endswith(("_id", "_count", "_num", "_qty")):
        return T.LongType()
    return T.StringType()


def stub(spark, columns) -> object:
    """An empty frame of columns with guessed types."""
    return spark.createDataFrame([], T.StructType([T.StructField(c, guessed(c)) for c in columns]))
