"""Tables of a live database over JDBC, read by several tasks at once.

A scan is split by bounds of a numeric or date key, which the database says, or
by predicates, one for each task. Filters and column lists reach the database;
a limit does so as a query of its own, in one task, as several could each
return other rows. A whole schema is replicated by one scan for each of its
tables.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.relational import quoted
from weftline.sources import readers

#: Types of keys that bounds can split.
SPLIT = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")
#: Dictionary queries by database: tables (schema_name, table_name) and columns (also column_name, position), fixed values.
DICTIONARY = {
    "oracle": (
        "SELECT owner AS schema_name, table_name FROM all_tables",
        "SELECT owner AS schema_name, table_name, column_name, column_id AS position FROM all_tab_columns",
    ),
    "derby": (
        "SELECT s.SCHEMANAME AS schema_name, t.TABLENAME AS table_name FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID WHERE t.TABLETYPE = 'T'",
        "SELECT s.SCHEMANAME AS schema_name, t.TABLENAME AS table_name, c.COLUMNNAME AS column_name, c.COLUMNNUMBER AS position FROM SYS.SYSCOLUMNS c JOIN SYS.SYSTABLES t ON c.REFERENCEID = t.TABLEID JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID WHERE t.TABLETYPE = 'T'",
    ),
}


def _reader(spark: SparkSession, url: str, properties: Mapping[str, str] | None):
    return spark.read.format("jdbc").option("url", url).options(**(properties or {}))


def scan(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, properties: Mapping[str, str] | None = None, fetch: int = 10_000) -> DataFrame:
    """A table as ``parts`` tasks read it, each a range of ``key``; without a key, or with an empty table, one task does.

    The key's least and greatest value come from one query of the database.
    Rows with a null key are in the first range.
    """
    reader = _reader(spark, url, properties).option("dbtable", table).option("fetchsize", fetch)
    if key is None or parts < 2:
        return reader.load()
    low, high = _reader(spark, url, properties).option("query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}").load().first()
    if low is None:
        return reader.load()
    kind = dict(reader.load().dtypes).get(next(c for c in reader.load().columns if c.lower() == key.strip('"').lower()), "")
    if kind.split("(")[0] not in SPLIT:
        raise ValueError(f"bounds can't split {key}, which is {kind}; give predicates")
    return reader.option("partitionColumn", key).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", parts).load()


def scan_by(spark: SparkSession, url: str, table: str, predicates: Sequence[str], properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table as one task for each predicate reads it; together they must hold for every row once."""
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(properties or {}))


def first_rows(spark: SparkSession, url: str, table: str, n: int, columns: Sequence[str] = (), properties: Mapping[str, str] | None = None) -> DataFrame:
    """At most ``n`` rows, cut off by the database."""
    return _reader(spark, url, properties).option("query", f"SELECT {', '.join(columns) or '*'} FROM {table} FETCH FIRST {int(n)} ROWS ONLY").load()


def dictionary(spark: SparkSession, url: str, kind: str, properties: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables and columns that the database's own dictionary lists, names in lower case."""
    tables, columns = (_reader(spark, url, properties).option("query", q).load() for q in DICTIONARY[kind])
    low = lambda df: df.toDF(*[c.lower() for c in df.columns])
    return low(tables), low(columns)


def replicate(spark: SparkSession, url: str, kind: str, schema: str, folder: str, keys: Mapping[str, str] | None = None, parts: int = 8, limit: int | None = None, properties: Mapping[str, str] | None = None) -> list[str]:
    """Raw copies of a schema's tables as Parquet below ``folder``, binary columns as hexadecimal text; returns the names.

    ``keys`` names the column that splits a table. Only names come to the driver.
    """
    tables, _ = dictionary(spark, url, kind, properties)
    names = sorted(r[0] for r in tables.filter(F.upper("schema_name") == schema.upper()).select("table_name").distinct().collect())
    split = {t.lower(): k for t, k in (keys or {}).items()}
    for name in names:
        full = f'{schema}."{name}"'
        rows = first_rows(spark, url, full, limit, properties=properties) if limit is not None else scan(spark, url, full, split.get(name.lower()), parts, properties)
        rows = rows.toDF(*[c.lower() for c in rows.columns])
        readers.write(readers.replicated(rows), f"{folder.rstrip('/')}/{name.lower()}")
    return names


def put(df: DataFrame, url: str, table: str, types: Mapping[str, str] | None = None, properties: Mapping[str, str] | None = None, mode: str = "overwrite") -> None:
    """Rows written to a table by all tasks at once; ``types`` are the database's types of columns."""
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {})).mode(mode)
    if types:
        writer = writer.option("createTableColumnTypes", ", ".join(f"{quoted(c)} {t}" for c, t in types.items()))
    writer.save()


def loaded(df: DataFrame, url: str, table: str, folder: str, types: Mapping[str, str] | None = None) -> None:
    """Rows put into a table of a Derby database that only the driver's JVM can open, by the database's own import of files.

    All tasks write files of rows below ``folder``, which the driver and the
    executors share; the database reads one after another, so no more than its
    page cache is in memory.
    """
    spark = df.sparkSession
    put(df.limit(0), url, table, types)  # the table, by Spark's types; no task has rows to connect for
    zone, clock = spark.conf.get("spark.sql.session.timeZone"), spark._jvm.java.util.TimeZone.getDefault().getID()  # JDBC reads times by the latter

    def said(name: str, kind: str) -> Column:
        c = F.col(quoted(name))
        if kind == "timestamp":
            c = F.convert_timezone(F.lit(zone), F.lit(clock), c.cast("timestamp_ntz"))
        text = F.hex(c) if kind == "binary" else c.cast("string")
        return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))

    df.select(F.concat_ws(",", *[said(c, t) for c, t in df.dtypes])).write.text(folder)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        call = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        call.setString(1, table[1:-1] if table.startswith('"') else table.upper())
        for name in sorted(os.listdir(folder)):
            if name.startswith("part-"):
                call.setString(2, f"{folder.rstrip('/')}/{name}")
                call.execute()
    finally:
        connection.close()


def sealed(spark: SparkSession, folder: str, name: str) -> str:
    """The address under which the JVMs of the driver and of all executors can read the Derby database ``folder/name`` at once.

    A Derby database belongs to the one JVM that has it open, but for one in an
    archive, which is read only. The database is closed first; its files are
    stored as they are, so that a page is read by its offset.
    """
    shut(spark, f"jdbc:derby:{folder}/{name}")
    with zipfile.ZipFile(f"{folder}/{name}.jar", "w", zipfile.ZIP_STORED) as archive:
        for at, _, files in os.walk(f"{folder}/{name}"):
            for file in files:
                if not file.endswith(".lck"):
                    archive.write(f"{at}/{file}", os.path.relpath(f"{at}/{file}", folder))
    return f"jdbc:derby:jar:({folder}/{name}.jar){name}"


def shut(spark: SparkSession, url: str, how: str = "shutdown") -> None:
    """Closes a Derby database in the driver's JVM, or drops it from memory."""
    try:
        spark._jvm.java.sql.DriverManager.getConnection(f"{url};{how}=true")
    except Exception as gone:  # the database says that it is gone by an error
        if "08006" not in str(gone) and "dropped" not in str(gone) and "shutdown" not in str(gone):
            raise
