"""Several targets from one pass over a stream, and writes that bring their own checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.operators.relational import quoted

#: A target's condition (None: all rows) and its columns.
Split = tuple[str | None, Mapping[str, str]]


def _schemas(df: DataFrame, targets: Mapping[str, Split]) -> dict[str, StructType]:
    return {name: StructType([StructField(c, f.dataType, True) for c, f in zip(columns, df.select(*[F.expr(e) for e in columns.values()]).schema, strict=True)]) for name, (_, columns) in targets.items()}


def split_written(df: DataFrame, targets: Mapping[str, Split], path: str) -> dict[str, DataFrame]:
    """Every target written by one pass over ``df``, as a partition of one folder, and read back.

    A row becomes one row for each target whose condition holds for it; columns
    are shared by targets that have one of the same name and type. What ``df``
    costs is paid once, however many targets there are.
    """
    schemas = _schemas(df, targets)
    shared: dict[tuple[str, str], str] = {}
    for schema in schemas.values():
        for f in schema:
            shared.setdefault((f.name.lower(), f.dataType.simpleString()), f"c{len(shared)}")
    kinds = {name: kind for (_, kind), name in shared.items()}
    rows = []
    for name, (where, columns) in targets.items():
        own = {shared[f.name.lower(), f.dataType.simpleString()]: e for f, e in zip(schemas[name], columns.values(), strict=True)}
        row = F.struct(F.lit(name).alias("_target"), *[(F.expr(own[c]) if c in own else F.lit(None)).cast(kinds[c]).alias(c) for c in shared.values()])
        rows.append(F.when(F.coalesce(F.expr(where), F.lit(False)), row) if where else row)
    out = df.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select("r.*")
    out.write.mode("overwrite").partitionBy("_target").parquet(path)
    spark = df.sparkSession
    stored = StructType([StructField(c, _type(schemas, shared, c), True) for c in shared.values()])
    whole = spark.read.schema(StructType([*stored.fields, StructField("_target", StringType(), True)])).parquet(path)
    return {name: whole.filter(F.col("_target") == name).select(*[F.col(shared[f.name.lower(), f.dataType.simpleString()]).alias(f.name) for f in schema]) for name, schema in schemas.items()}




def _type(schemas: Mapping[str, StructType], shared: Mapping[tuple[str, str], str], column: str):
    return next(f.dataType for s in schemas.values() for f in s if shared[f.name.lower(), f.dataType.simpleString()] == column)


def checked_write(df: DataFrame, path: str, unique: Sequence[str] = (), not_null: Sequence[str] = (), partition_by: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Writes ``df`` and returns ``check``, ``column`` and ``n``: rows, nulls of ``not_null``, and keys that aren't unique.

    Rows and nulls are observed while they are written. Uniqueness is read from
    the key columns that were written, not from ``df``, which is computed once.
    """
    seen = Observation()
    nulls = [F.count_if(F.col(quoted(c)).isNull()).alias(f"null{i}") for i, c in enumerate(not_null)]
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark = df.sparkSession
    try:
        counts = dict(seen.get)
    except Py4JJavaError:  # a plan that is known to be empty is never observed
        counts = {}
    found = [("rows", None, counts.get("rows", 0)), *[("nulls", c, counts.get(f"null{i}", 0)) for i, c in enumerate(not_null)]]
    out = spark.createDataFrame(found, "check string, column string, n long")
    if unique:
        keys = spark.read.parquet(path).groupBy(*map(quoted, unique)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        out = out.unionByName(keys.agg(F.lit("repeated keys").alias("check"), F.lit(",".join(unique)).alias("column"), F.count(F.lit(1)).alias("n")))
    return out


def stored_table(df: DataFrame, name: str, path: str, keys: Sequence[str] = (), buckets: int = 16) -> DataFrame:
    """CREATE TABLE AS: ``df`` computed once into a catalog table at ``path``; with ``keys`` bucketed and sorted by them.

    Readers of the table read files. A join or a merge on the keys finds the
    table's side where it is, without moving it.
    """
    spark: SparkSession = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.write.mode("overwrite").format("parquet").option("path", path)
    if keys:
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(name)
    return spark.table(name)
