"""Readers of files, dictionaries and run logs, and writers of targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.relational import quoted

#: Kinds of files by extension and by parts of their names, in the order tried.
KINDS = (
    ("ddl", (".sql", ".ddl"), ()), ("etl", (".xml", ".dtsx", ".bteq", ".pls", ".pkb"), ()), ("dictionary", (), ("dba_", "all_", "dictionary")),
    ("awr", (), ("awr", "sqlstat")), ("output", (".csv",), ()),
)


def csv(spark: SparkSession, path: str, schema=None, upper: bool = False) -> DataFrame:
    """A CSV with a header; without a schema all columns are texts. Empty fields are null."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.toDF(*[c.upper() for c in df.columns]) if upper else df


def csv_header(spark: SparkSession, path: str) -> tuple[list[str], int]:
    df = csv(spark, path)
    return df.columns, df.count()


def file_kind(path: Column) -> Column:
    p = F.lower(path)
    out = F.when(F.lit(False), "")
    for kind, ends, parts in KINDS:
        hit = F.lit(False)
        for e in ends:
            hit = hit | p.endswith(e)
        for x in parts:
            hit = hit | F.element_at(F.split(p, "/"), -1).contains(x)
        out = out.when(hit, kind)
    return out.otherwise("other")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size and kind of the files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), file_kind(F.col("path")).alias("kind"))


def preview(files: DataFrame, samples: int = 12) -> tuple[DataFrame, DataFrame]:
    """Counts and bytes by kind, and the first paths."""
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), files.orderBy("path").limit(samples)


def source_text(lines: DataFrame) -> DataFrame:
    """owner, name, type and their text put together from (line, text) rows in line order."""
    rows = F.array_sort(F.collect_list(F.struct("line", "text")))
    return lines.groupBy("owner", "name", "type").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("source"))


def dictionary(spark: SparkSession, url: str, query: str, properties: Mapping[str, str]) -> DataFrame:
    """A dictionary query of a live database over JDBC."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**properties).load()


def inventory(tables: DataFrame, segments: DataFrame, columns: DataFrame, primary: DataFrame, foreign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog tables with sizes, and columns with key marks, from dictionary extracts.

    tables: owner, table_name, kind; segments: owner, segment_name, bytes, num_rows, last_analyzed;
    columns: owner, table_name, column_name, data_type, nullable; primary: owner, table_name, column_name;
    foreign: owner, table_name, column_name, r_owner, r_table, r_column.
    """
    seg = segments.groupBy("owner", F.col("segment_name").alias("table_name")).agg(F.sum("bytes").alias("bytes"), F.max("num_rows").alias("row_count"), F.max("last_analyzed").alias("last_analyzed"))
    t = tables.join(seg, ["owner", "table_name"], "left").withColumn("fqn", F.concat_ws(".", "owner", "table_name"))
    key = ["owner", "table_name", "column_name"]
    fk = foreign.groupBy(*key).agg(F.min(F.concat_ws(".", "r_owner", "r_table", "r_column")).alias("fk_target"))
    c = columns.join(primary.select(*key).distinct().withColumn("is_pk", F.lit(True)), key, "left").join(fk, key, "left")
    c = c.withColumn("is_pk", F.coalesce("is_pk", F.lit(False))).withColumn("is_fk", F.col("fk_target").isNotNull())
    return t, c.withColumn("table_fqn", F.concat_ws(".", "owner", "table_name"))


def replicated(df: DataFrame, limit: int | None = None, binary_as_hex: bool = True) -> DataFrame:
    """A raw copy: all columns, binary ones as hexadecimal text, at most ``limit`` rows if one is asked for."""
    out = df.select(*[F.hex(quoted(c)).alias(c) if binary_as_hex and t == "binary" else F.col(quoted(c)) for c, t in df.dtypes])
    return out if limit is None else out.limit(limit)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """A full refresh of a target; CSV has a header."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        getattr(writer, kind)(path)


def refreshed(spark: SparkSession, df: DataFrame, path: str, view: str) -> DataFrame:
    """``df`` written as a stage's target and read again under a view's name, so later steps see the stored rows."""
    write(df, path)
    out = spark.read.parquet(path)
    out.createOrReplaceTempView(view)
    return out


def exported(spark: SparkSession, scope: DataFrame, manifest: DataFrame, folder: str) -> None:
    """A scope's manifest as JSON and its rows as one table of CSV, below ``folder``."""
    write(manifest, f"{folder.rstrip('/')}/manifest", "json")
    write(scope, f"{folder.rstrip('/')}/scope", "csv")


def recent(df: DataFrame, stamp: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(stamp), tie).limit(n)


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, as ordered de-duplication."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def copied(target: DataFrame, path: str, kind: str = "csv") -> DataFrame:
    """COPY INTO: a file's rows appended to ``target`` by column name, cast to its types; columns it lacks are null."""
    spark = target.sparkSession
    rows = csv(spark, path) if kind == "csv" else getattr(spark.read, kind)(path)
    have = {c.lower(): c for c in rows.columns}
    return target.unionByName(rows.select(*[(F.col(quoted(have[c.lower()])) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in target.dtypes]))
