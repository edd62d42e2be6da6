"""Statements that change tables, as functions from the old table to the new one.

Each takes the target as a DataFrame and returns its next state, which a sink
then overwrites; a Parquet table has no MERGE of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import keys_of, quoted


def update(target: DataFrame, set_: Mapping[str, str], where: str | None = None) -> DataFrame:
    """All assignments read the old row; a null condition changes nothing."""
    cond = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    types = dict(target.dtypes)
    new = {c: e for c, e in ((next((t for t in target.columns if t.lower() == k.lower()), k), e) for k, e in set_.items())}
    missing = [c for c in new if c not in types]
    if missing:
        raise KeyError(f"no columns {missing} in the target")
    return target.select(*[F.when(cond, F.expr(new[c]).cast(types[c])).otherwise(F.col(quoted(c))).alias(c) if c in new else F.col(quoted(c)) for c in target.columns])


def delete(target: DataFrame, where: str | None = None) -> DataFrame:
    """Rows whose condition isn't true stay."""
    return truncate(target) if where is None else target.filter(~F.coalesce(F.expr(where), F.lit(False)))


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def extended(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``df`` with null columns of given types for names that later statements fill."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c.lower() not in have])


def insert(target: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """INSERT INTO target(columns) SELECT …: by position; columns not named become null."""
    names = list(columns) if columns is not None else target.columns
    if len(names) != len(rows.columns):
        raise ValueError(f"{len(names)} columns for {len(rows.columns)} values")
    given, types = rows.toDF(*names), dict(target.dtypes)
    have = {c.lower(): c for c in names}
    return target.unionByName(given.select(*[(F.col(quoted(have[c.lower()])) if c.lower() in have else F.lit(None)).cast(types[c]).alias(c) for c in target.columns]))


@dataclass(frozen=True)
class When:
    """A branch of MERGE: an extra condition over ``t`` and ``s``, and assignments (none: delete)."""

    set_: Mapping[str, str] | None = None
    condition: str | None = None


@dataclass(frozen=True)
class Merge:
    on: str | Sequence[str] | Mapping[str, str]
    matched: Sequence[When] = field(default_factory=tuple)
    not_matched: Sequence[When] = field(default_factory=tuple)
    not_matched_by_source: Sequence[When] = field(default_factory=tuple)
    match_condition: str | None = None


def merge(target: DataFrame, source: DataFrame, spec: Merge) -> DataFrame:
    """One full outer join; each row takes the first branch whose condition holds.

    Several source rows for one target row are an error, raised when the result
    is computed, as which of them applies would be left to chance; without
    branches for matched rows or for the target's other rows, they are not.
    """
    pairs = keys_of(spec.on)
    if not spec.matched and not spec.not_matched_by_source:  # rows are only added
        meets = F.lit(True)
        for x, y in pairs:
            meets = meets & (F.col(f"t.{quoted(x)}") == F.col(f"s.{quoted(y)}"))
        if spec.match_condition:
            meets = meets & F.expr(spec.match_condition)
        fresh = source.alias("s").join(target.alias("t"), meets, "left_anti")
        return target.unionByName(_merged(target.limit(0), fresh, spec, pairs))
    return _merged(target, source, spec, pairs)


def _merged(target: DataFrame, source: DataFrame, spec: Merge, pairs: list[tuple[str, str]]) -> DataFrame:
    # Rows with a null key match nothing; a salt of their own, never the same on both sides, spreads them over the join's tasks.
    def salted(df: DataFrame, names: list[str], sign: int) -> DataFrame:
        null = reduce(lambda a, b: a | b, [F.col(quoted(n)).isNull() for n in names])
        return df.withColumn("_salt", F.when(null, F.lit(sign) * (F.monotonically_increasing_id() + 1)).otherwise(F.lit(0).cast("long")))

    t, s = salted(target.withColumn("_in_t", F.lit(True)), [x for x, _ in pairs], 1), salted(source.withColumn("_in_s", F.lit(True)), [y for _, y in pairs], -1)
    guarded = bool(spec.matched or spec.not_matched_by_source)
    by_key = guarded and not spec.match_condition
    if by_key:  # counted on the join's own keys, so the source is shuffled once for both
        s = s.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(*[quoted(y) for _, y in pairs], "_salt")))
    elif guarded:
        t = t.withColumn("_tid", F.monotonically_increasing_id())
    on = F.col("t._salt") == F.col("s._salt")
    for x, y in pairs:
        on = on & (F.col(f"t.{quoted(x)}") == F.col(f"s.{quoted(y)}"))
    if spec.match_condition:
        on = on & F.expr(spec.match_condition)
    both = t.alias("t").join(s.alias("s"), on, "full")
    if guarded and not by_key:
        own = Window.partitionBy("t._tid", F.when(F.col("t._tid").isNull(), F.xxhash64("s._salt", *[F.col(f"s.{quoted(y)}") for _, y in pairs])))
        both = both.withColumn("_many", F.when(F.col("t._in_t") & F.col("s._in_s"), F.count("s._in_s").over(own)))
    is_t, is_s = F.coalesce(F.col("t._in_t"), F.lit(False)), F.coalesce(F.col("s._in_s"), F.lit(False))
    plan = [(is_t & is_s, spec.matched), (~is_t & is_s, spec.not_matched), (is_t & ~is_s, spec.not_matched_by_source)]
    branch, n, branches = F.when(F.lit(False), F.lit(-1)), 0, []
    for where, whens in plan:
        for w in whens:
            cond = where & (F.coalesce(F.expr(w.condition), F.lit(False)) if w.condition else F.lit(True))
            branch = branch.when(cond, F.lit(n))
            branches.append(w)
            n += 1
    kept = F.when(is_t, F.lit(n)).otherwise(F.lit(-1))
    both = both.withColumn("_b", F.coalesce(branch, kept))
    deletes = [i for i, w in enumerate(branches) if w.set_ is None]
    if guarded:
        both = both.filter(F.when((F.col("_many") > 1) & is_t & is_s, F.raise_error(F.lit("several source rows match one target row")).cast("boolean")).otherwise(F.lit(True)))
    rows = both.filter((F.col("_b") >= 0) & ~F.col("_b").isin(deletes) if deletes else F.col("_b") >= 0)
    out = []
    for c, kind in target.dtypes:
        value = F.col(f"t.{quoted(c)}")
        for i, w in enumerate(branches):
            if w.set_ is None:
                continue
            given = {k.lower(): e for k, e in w.set_.items()}
            if c.lower() in given:
                value = F.when(F.col("_b") == i, F.expr(given[c.lower()]).cast(kind)).otherwise(value)
        out.append(value.alias(c))
    return rows.select(*out)


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incremental table with a unique key: incoming rows replace those of their key; of several with one key the greatest stays."""
    rest = [c for c in target.columns if c.lower() not in {k.lower() for k in keys}]
    if rest:
        rows = rows.groupBy(*map(quoted, keys)).agg(F.max(F.struct(*map(quoted, rest))).alias("_row")).select(*map(quoted, keys), "_row.*")
    else:
        rows = rows.select(*map(quoted, keys)).distinct()
    return target.join(rows.select(*map(quoted, keys)).distinct(), list(keys), "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def scd2(dimension: DataFrame, rows: DataFrame, keys: Sequence[str], compare: Sequence[str], as_of: str, sk: str = "sk", start: str = "effective_dt", end: str = "end_dt", current: str = "current_flg") -> DataFrame:
    """Slowly changing dimension: open rows that changed are closed at ``as_of`` and new versions follow them.

    New keys open too. Surrogate keys go on from the largest one in key order.
    """
    from .windows import surrogate_keys

    cond, stamp = F.lit(True), F.expr(as_of)
    incoming = rows.alias("s")
    for k in keys:
        cond = cond & (F.col(f"d.{quoted(k)}") == F.col(f"s.{quoted(k)}"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"d.{quoted(c)}").eqNullSafe(F.col(f"s.{quoted(c)}"))
    changed = dimension.alias("d").join(incoming, cond & (F.col(f"d.{current}") == "Y") & ~same, "left_semi").select(sk).withColumn("_closed", F.lit(True))
    closed = dimension.join(changed, sk, "left").select(
        *[F.when(F.col("_closed"), stamp).otherwise(F.col(c)).cast(dict(dimension.dtypes)[c]).alias(c) if c == end else F.when(F.col("_closed"), F.lit("N")).otherwise(F.col(c)).alias(c) if c == current else F.col(c) for c in dimension.columns]
    )
    fresh = incoming.join(dimension.alias("d"), cond & (F.col(f"d.{current}") == "Y") & same, "left_anti").select(*[F.col(f"s.{quoted(c)}") for c in rows.columns])
    opened = surrogate_keys(fresh, dimension, sk, list(keys)).withColumn(start, stamp).withColumn(end, F.lit(None)).withColumn(current, F.lit("Y"))
    types = dict(dimension.dtypes)
    return closed.unionByName(opened.select(*[F.col(c).cast(types[c]).alias(c) for c in dimension.columns]))


def split_targets(df: DataFrame, targets: Mapping[str, tuple[str | None, Mapping[str, str]]]) -> dict[str, DataFrame]:
    """Several targets from one stream: each with its own predicate and projection."""
    out = {}
    for name, (where, columns) in targets.items():
        part = df.filter(F.expr(where)) if where else df
        out[name] = part.select(*[F.expr(e).alias(c) for c, e in columns.items()])
    return out


def broken_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column`` and ``nulls`` of the columns that ought to have none, in one pass."""
    one = df.agg(*[F.count_if(F.col(quoted(c)).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "nulls")
