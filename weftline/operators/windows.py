"""Numbering, top-k, latest snapshots and period comparisons."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row_num", keys: Sequence[str] = ()) -> DataFrame:
    """``row_number`` in a stated order, within ``keys``. Without keys it is global: rows are range-sorted and
    numbered by partition, with the partitions' counts added, so no task holds all rows.
    """
    if not order:
        raise ValueError("a row number needs an order")
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    from weftline.session import cut

    by = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_first", "_before")
    joined = ranged.join(F.broadcast(starts), "_p")
    return joined.withColumn(name, (F.col("_before") + F.col("_i") - F.col("_first") + 1).cast("long")).drop("_p", "_i", "_first", "_before")


def surrogate_keys(new: DataFrame, existing: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """``new`` with keys that go on, without gaps, from the largest existing one."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("m")).first().m
    return numbered(new, order, key).withColumn(key, F.col(key) + F.lit(top))


def top(df: DataFrame, by: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The ``n`` rows largest by ``by``; ties in the order of other columns."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return numbered(df, order, "_n", keys).filter(F.col("_n") <= n).drop("_n")


#: Ranking functions by name; NTILE takes its number of parts, as ``ntile(4)``.
RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: dict[str, str]) -> DataFrame:
    """Columns of ranks within ``keys``: name to one of ``RANKS``, or ``ntile(n)``."""
    over, out = _window(keys, order), {}
    for name, kind in columns.items():
        parts = re.fullmatch(r"ntile\((\d+)\)", kind)
        out[name] = (F.ntile(int(parts[1])) if parts else RANKS[kind]()).over(over)
    return df.withColumns(out)


def _window(keys: Sequence[str], order: Sequence[Column | str]):
    if not keys or not order:
        raise ValueError("a window needs keys, or one task would hold all rows, and an order")
    return Window.partitionBy(*keys).orderBy(*order)


def shifted(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Columns of other rows: name to (column, steps), steps ahead as LEAD or, below zero, back as LAG."""
    over = _window(keys, order)
    return df.withColumns({name: (F.lead(c, n) if n >= 0 else F.lag(c, -n)).over(over) for name, (c, n) in columns.items()})


def framed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: dict[str, Column | str], start: int | None = None, end: int | None = 0, kind: str = "rows") -> DataFrame:
    """Aggregates, FIRST_VALUE or LAST_VALUE over a frame of rows or of the order's values.

    ``start`` and ``end`` are relative to the row, None is unbounded. A frame of
    values (``kind`` range) needs one numeric order column.
    """
    if kind not in ("rows", "range"):
        raise ValueError(f"unknown frame {kind!r}")
    low, high = Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end
    over = getattr(_window(keys, order), f"{kind}Between")(low, high)
    return df.withColumns({name: (F.expr(e) if isinstance(e, str) else e).over(over) for name, e in columns.items()})


#: Findings from the gravest to the mildest.
FINDINGS = ("critical", "error", "warn", "info")


def by_severity(df: DataFrame, severity: str = "severity", ties: Sequence[str] = ("object",), place: str | None = None) -> DataFrame:
    """Findings sorted from the gravest; unknown severities come last, nulls after all values. ``place`` names a column for their number."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FINDINGS)), F.lower(severity)), F.lit(0)), F.lit(len(FINDINGS) + 1))
    order = [rank.asc(), *[F.col(t).asc_nulls_last() for t in ties]]
    return df.orderBy(*order) if place is None else numbered(df, order, place)


def latest(df: DataFrame, stamp: str, keys: Sequence[str] = ()) -> DataFrame:
    """All rows of the latest snapshot, over all or within keys."""
    last = df.groupBy(*keys).agg(F.max(stamp).alias("_last"))
    if not keys:
        return df.join(F.broadcast(last), df[stamp] == F.col("_last")).drop("_last")  # one row
    return df.join(last, list(keys)).filter(F.col(stamp) == F.col("_last")).drop("_last")


def change(df: DataFrame, keys: Sequence[str], stamp: str, value: str, name: str = "pct_change") -> DataFrame:
    """Percentage change of ``value`` against the row before; null without one or after a zero."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(stamp))
    return df.withColumn("_before", before).withColumn(name, F.when(F.col("_before").isNull() | (F.col("_before") == 0), None).otherwise((F.col(value) - F.col("_before")) / F.col("_before") * 100)).drop("_before")


def beside(df: DataFrame, keys: Sequence[str], stamp: str, offset: int, values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """A self join with the row ``offset`` steps of the integer ``stamp`` before."""
    old = df.select(*keys, (F.col(stamp) + offset).alias(stamp), *[F.col(v).alias(prefix + v) for v in values])
    return df.join(old, [*keys, stamp], "left")
