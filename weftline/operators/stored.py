"""Targets that are stored in parts by key, so that a change rewrites the parts it touches and no other.

A target is a folder of Parquet files, partitioned by a bucket column whose name
says how many buckets there are (``_bucket_of_64``); the bucket of a row is a
hash of its key. A change looks up the buckets of its own keys first, reads
those parts of the target, and overwrites them dynamically; files of other
buckets stay as they are. Rows without a key are in the bucket that nulls hash
to. A change that is repeated after a failure gives the same result, as rows are
set, not added.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import dml
from weftline.operators.relational import keys_of, quoted

BUCKETS = 64


def bucket(keys: Sequence[str], types: Sequence[str], buckets: int) -> Column:
    """The bucket of a key; values are cast to the target's types first, as hashes differ by type."""
    return F.pmod(F.xxhash64(*[F.col(quoted(k)).cast(t) for k, t in zip(keys, types, strict=True)]), F.lit(buckets)).cast("int")


def created(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Writes ``df`` as a target with ``keys``."""
    kinds = dict(df.dtypes)
    name = f"_bucket_of_{buckets}"
    rows = df.withColumn(name, bucket(keys, [kinds[k] for k in keys], buckets))
    rows.hint("rebalance", name).write.mode("overwrite").partitionBy(name).parquet(path)


def _layout(stored: DataFrame) -> tuple[str, int]:
    name = next((c for c in stored.columns if re.fullmatch(r"_bucket_of_\d+", c)), None)
    if name is None:
        raise ValueError("the folder isn't a target made by created()")
    return name, int(name.rpartition("_")[2])


def current(spark: SparkSession, path: str) -> DataFrame:
    """The target's rows."""
    stored = spark.read.parquet(path)
    return stored.drop(_layout(stored)[0])


def changed(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], change: Callable[[DataFrame, DataFrame], DataFrame], row_keys: Sequence[str] | None = None, everywhere: bool = False) -> int:
    """The target after ``change(old rows, rows)``, applied to the buckets of the rows' keys alone; returns how many those are.

    ``row_keys`` names the keys in ``rows`` if they are called otherwise there.
    With ``everywhere`` all buckets are read, for changes that reach rows
    without a counterpart; a row whose key falls into a bucket that wasn't read
    is an error before anything is overwritten. At most one number for each
    bucket comes to the driver.
    """
    stored = spark.read.parquet(path)
    name, buckets = _layout(stored)
    kinds = dict(stored.dtypes)
    own = [next(c for c in stored.columns if c.lower() == k.lower()) for k in keys]
    types = [kinds[k] for k in own]
    touched = list(range(buckets)) if everywhere else sorted(r[0] for r in rows.select(bucket(row_keys or keys, types, buckets)).distinct().collect())
    if not touched:
        return 0
    columns = [c for c in stored.columns if c != name]
    old = stored.filter(F.col(name).isin(touched)).select(*map(quoted, columns))
    new = change(old, rows).select(*map(quoted, columns)).withColumn("_b", bucket(own, types, buckets))
    stray = F.raise_error(F.lit("the change sets a key in a bucket that it hasn't read")).cast("int")
    new = new.withColumn(name, F.when(F.col("_b").isin(touched), F.col("_b")).otherwise(stray)).drop("_b")
    before = {b: _files(spark, f"{path.rstrip('/')}/{name}={b}") for b in touched}
    new.hint("rebalance", name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    for b, files in before.items():  # an overwrite passes over buckets that no row is left in
        at = f"{path.rstrip('/')}/{name}={b}"
        if files and _files(spark, at) == files:
            _store(spark, at)[0].delete(_store(spark, at)[1], True)
    return len(touched)


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _files(spark: SparkSession, path: str) -> frozenset[str]:
    store, at = _store(spark, path)
    return frozenset(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else frozenset()


def upserted(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> int:
    """:func:`dml.upsert` of a stored target."""
    return changed(spark, path, rows, keys, lambda old, new: dml.upsert(old, new, keys))


def merged(spark: SparkSession, path: str, source: DataFrame, spec: dml.Merge) -> int:
    """:func:`dml.merge` of a stored target; ``spec.on`` must be its keys.

    Branches for rows that the source lacks reach all buckets.
    """
    pairs = keys_of(spec.on)
    return changed(spark, path, source, [t for t, _ in pairs], lambda old, new: dml.merge(old, new, spec), [s for _, s in pairs], bool(spec.not_matched_by_source))
