"""Reproducible shuffling into shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of a content hash. The number is
permuted by an alternating Feistel network over ``a x b`` cells, the smallest
near-square grid of at least n cells, and cycle walking repeats the
permutation while it lands outside 0..n-1. The place p of a row gives its
shard ``p mod shards`` and its slot ``p div shards``, so shard sizes differ by
one row at most and slots have no gaps; any place is computable from its row
number alone.

Global numbers need no global sort: rows fall into 65,536 hash buckets, each
bucket is numbered by itself, and the prefix sums of the bucket sizes (a table
of fixed size, safe to broadcast) shift them.

Cases: null values are ordinary values of a column; very long texts are values
like others; equal rows are counted before the shuffle and numbered one after
another, so a third of all rows may be one repeated row; an empty table gives an empty result; columns named like
the result's columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 16


def _round(value: Column, number: int, seed: int, size: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(number), F.lit(seed)), F.lit(size))


def permuted(number: Column, n: int, seed: int, rounds: int = 6) -> Column:
    """One pass of the Feistel network over the grid of ``n`` rows; the result may be n or more."""
    a, b = _grid(n)
    left, right = F.call_function("div", number, F.lit(b)), F.pmod(number, F.lit(b)).cast("long")
    for i in range(rounds):
        if i % 2:
            right = F.pmod(right + _round(left, i, seed, b), F.lit(b))
        else:
            left = F.pmod(left + _round(right, i, seed, a), F.lit(a))
    return left * F.lit(b) + right


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def walked(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number``: the permutation repeated until it lands below ``n``.

    A walk visits each of the grid's cells above n once at most, which bounds
    it; as fewer than one cell in sqrt(n) lies there, 64 steps are enough for
    any n, and a walk that did not end would raise rather than misplace a row.
    """
    a, b = _grid(n)
    over = a * b - n
    first = permuted(number, n, seed)
    if not over:
        return first
    step = lambda x: F.when(x < n, x).otherwise(permuted(x, n, seed))
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(min(over, 64))), first, lambda x, _: step(x))
    place = F.when(first < n, first).otherwise(rest)
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def numbered(df: DataFrame, number: str = "row_number") -> DataFrame:
    """``df`` with a dense global row number that depends on the rows' contents alone."""
    names = [c for c in df.columns if c != number]
    rows = (
        df.select(*names)
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_hash", F.xxhash64(*names))
        .withColumn("_bucket", F.shiftrightunsigned("_hash", 48).cast("int"))
    )
    sizes = df.select(F.shiftrightunsigned(F.xxhash64(*names), 48).cast("int").alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    coarse = F.shiftright("_bucket", 8)
    inner = Window.partitionBy("_coarse").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("_coarse", coarse).withColumn("_inner", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    outer = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    above = within.groupBy("_coarse").agg(F.sum("_size").alias("_total")).withColumn("_outer", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
    starts = within.join(F.broadcast(above), "_coarse").select("_bucket", (F.col("_inner") + F.col("_outer")).alias("_start"))
    before = Window.partitionBy("_bucket").orderBy("_hash", *names).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_before", F.coalesce(F.sum("_copies").over(before), F.lit(0)))
        .join(F.broadcast(starts), "_bucket")  # 65,536 rows at most
        .select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("_copy"), (F.col("_start") + F.col("_before")).alias("_from"))
        .select(*names, (F.col("_from") + F.col("_copy")).alias(number))
    )


def shard(df: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """The rows of ``df`` with ``row_number``, ``shard`` and ``slot``."""
    n = df.count()
    new = ("row_number", "shard", "slot", "_copies", "_hash", "_bucket", "_before", "_start", "_from", "_copy", "_place")
    rows = numbered(df.drop(*new))
    place = walked(F.col("row_number"), max(n, 1), seed)
    return rows.withColumn("_place", place).select(*[c for c in rows.columns if c != "row_number"], "row_number", F.pmod("_place", F.lit(shards)).cast("int").alias("shard"), F.call_function("div", F.col("_place"), F.lit(shards)).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
