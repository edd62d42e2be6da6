"""Dataflow operators: sources, projections, predicates, joins, aggregates, sets and row explosion.

All are lazy and return DataFrames; column names compare without case, as in
Spark's default.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOWS = {
    "INNER": "inner", "LEFT": "left", "LEFT OUTER": "left", "RIGHT": "right", "RIGHT OUTER": "right",
    "FULL": "full", "FULL OUTER": "full", "OUTER": "full", "CROSS": "cross", "SEMI": "left_semi", "ANTI": "left_anti",
}

#: Largest reference table that a lookup may ask to broadcast, by the optimizer's own estimate.
BROADCAST_BYTES = 64 << 20


def how_of(name: str | None, default: str = "left") -> str:
    """Spark's name of a join type in any spelling."""
    if not name:
        return default
    key = re.sub(r"\s+JOIN$", "", re.sub(r"[\s_]+", " ", name.strip().upper()))
    if key not in HOWS:
        raise ValueError(f"unknown join type {name!r}")
    return HOWS[key]


def as_column(value: Column | str) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def quoted(name: str) -> str:
    """A column name as one identifier, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df``, matched without case."""
    real = {c.lower(): c for c in df.columns}
    if name.lower() not in real:
        raise KeyError(f"no column {name!r} among {df.columns}")
    return df[quoted(real[name.lower()])]


# --- sources and projections ------------------------------------------------


def source(df: DataFrame, columns: Mapping[str, Column | str] | Sequence[str] | None = None, where: Column | str | None = None, distinct: bool = False) -> DataFrame:
    """Rows of a table: filter first, so that it reaches the scan, then projection, then DISTINCT."""
    if where is not None:
        df = df.filter(as_column(where))
    if columns:
        items = columns.items() if isinstance(columns, Mapping) else ((c, quoted(c)) for c in columns)
        df = df.select(*[as_column(e).alias(n) for n, e in items])
    return df.distinct() if distinct else df


@dataclass(frozen=True)
class Joined:
    """A further table of a source: its alias, its frame, its condition and type."""

    alias: str
    df: DataFrame
    on: str | None = None
    how: str = "inner"


def multi_source(base: DataFrame, alias: str, others: Sequence[Joined], where: str | None = None) -> DataFrame:
    """A chain of joins. A table without a condition is crossed; a later filter makes it an equi-join where it can."""
    df = base.alias(alias)
    for j in others:
        right = j.df.alias(j.alias)
        df = df.crossJoin(right) if j.on is None else df.join(right, F.expr(j.on), how_of(j.how))
    return df.filter(F.expr(where)) if where else df


def short_aliases(names: Iterable[str], prefixes: Sequence[str] = ("stg_", "dim_", "fact_", "raw_", "rpt_")) -> dict[str, str]:
    """Short distinct aliases of table names: prefix off, four letters, a number where two meet."""
    out: dict[str, str] = {}
    for name in names:
        stem = name.split(".")[-1].lower()
        for p in prefixes:
            stem = stem.removeprefix(p)
        short = re.sub(r"\W", "", stem)[:4] or "t"
        n, taken = 1, set(out.values())
        alias = short
        while alias in taken:
            n += 1
            alias = f"{short}{n}"
        out[name] = alias
    return out


def match_ports(ports: Sequence[str], columns: Sequence[str]) -> dict[str, str]:
    """Port to column: the same name, else a column that ends in it, else the same without underscores. Others are left out."""
    low, out = {c.lower(): c for c in columns}, {}
    bare = {c.lower().replace("_", ""): c for c in columns}
    for p in ports:
        key = p.lower()
        if key in low:
            out[p] = low[key]
            continue
        tail = [c for c in columns if c.lower().endswith("_" + key) or key.endswith("_" + c.lower())]
        if len(tail) == 1:
            out[p] = tail[0]
        elif key.replace("_", "") in bare:
            out[p] = bare[key.replace("_", "")]
    return out


def aliased(df: DataFrame, ports: Sequence[str]) -> DataFrame:
    """``df`` under its ports' names."""
    found = match_ports(ports, df.columns)
    return df.select(*[df[quoted(c)].alias(p) for p, c in found.items()])


def expression(df: DataFrame, columns: Mapping[str, Column | str], pass_upstream: bool = True) -> DataFrame:
    """New columns over the upstream row, and the upstream's own.

    A new column replaces an upstream one of its name, and a plain rename takes
    the place of the column it renames; a column used inside a larger
    expression stays.
    """
    new = {n: as_column(e) for n, e in columns.items()}
    if not pass_upstream:
        return df.select(*[e.alias(n) for n, e in new.items()])
    hidden = {n.lower() for n in new}
    for n, e in columns.items():
        if isinstance(e, str) and re.fullmatch(r"`[^`]+`|[A-Za-z_]\w*", e.strip()) and e.strip("` ").lower() != n.lower():
            if e.strip("` ").lower() in {c.lower() for c in df.columns}:
                hidden.add(e.strip("` ").lower())
    kept = [df[quoted(c)] for c in df.columns if c.lower() not in hidden]
    return df.select(*kept, *[e.alias(n) for n, e in new.items()])


def filtered(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.filter(as_column(condition))


def projected(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Final projection: target column to upstream name or expression."""
    return df.select(*[as_column(e).alias(t) for t, e in mapping.items()])


def router(df: DataFrame, groups: Sequence[tuple[str, str | None]]) -> dict[str, DataFrame]:
    """One frame for each group; a group without a condition is the default and takes rows that no condition accepts, null results included."""
    out, any_ = {}, F.lit(False)
    for _, c in groups:
        if c is not None:
            any_ = any_ | F.coalesce(F.expr(c), F.lit(False))
    for name, c in groups:
        out[name] = df.filter(~any_ if c is None else F.expr(c))
    return out


# --- joins --------------------------------------------------------------------


def keys_of(on: str | Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    """Pairs of left and right key names."""
    if isinstance(on, Mapping):
        return list(on.items())
    names = [x.strip() for x in on.split(",")] if isinstance(on, str) else list(on)
    return [(n, n) for n in names if n]


def joiner(left: DataFrame, right: DataFrame, on: str | Sequence[str] | Mapping[str, str], how: str | None = None) -> DataFrame:
    """Two streams joined on keys. Output: all left columns, then right ones whose names aren't taken (left wins).

    In a right or full join a left key that has no row takes the right key's
    value. Only a cross join may lack keys.
    """
    kind, pairs = how_of(how), keys_of(on)
    if not pairs and kind != "cross":
        raise ValueError("a join needs keys")
    a, b = left.alias("l"), right.alias("r")
    col = lambda side, df, n: F.col(f"{side}.{quoted(next(c for c in df.columns if c.lower() == n.lower()))}")
    if kind == "cross":
        both = a.crossJoin(b)
    else:
        cond = F.lit(True)
        for x, y in pairs:
            cond = cond & (col("l", left, x) == col("r", right, y))
        both = a.join(b, cond, kind)
    if kind in ("left_semi", "left_anti"):
        return both
    same = {x.lower(): y for x, y in pairs}
    out = []
    for c in left.columns:
        value = F.col(f"l.{quoted(c)}")
        if kind in ("right", "full") and c.lower() in same:
            value = F.coalesce(value, col("r", right, same[c.lower()]))
        out.append(value.alias(c))
    taken = {c.lower() for c in left.columns}
    return both.select(*out, *[F.col(f"r.{quoted(c)}").alias(c) for c in right.columns if c.lower() not in taken])


def small(df: DataFrame, bound: int = BROADCAST_BYTES) -> bool:
    """Whether the optimizer's own estimate of ``df`` is under ``bound`` bytes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= bound


def lookup(df: DataFrame, reference: DataFrame, on: str | Sequence[str] | Mapping[str, str], returns: Mapping[str, str] | Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """``df`` with columns of at most one matching reference row; unmatched rows get nulls.

    Of several matches the first by ``order`` (else by the returned values)
    counts, so rows never multiply. The reference is broadcast only if its
    estimated size allows it.
    """
    pairs = keys_of(on)
    names = dict(returns) if isinstance(returns, Mapping) else {r: r for r in returns}
    values = F.struct(*[F.col(quoted(c)).alias(f"o{i}") for i, c in enumerate(order or names.values())], *[F.col(quoted(c)).alias(f"v{i}") for i, c in enumerate(names.values())])
    keys = [F.col(quoted(y)).alias(f"_k{i}") for i, (_, y) in enumerate(pairs)]
    one = reference.select(*keys, values.alias("_v")).groupBy(*[f"_k{i}" for i in range(len(pairs))]).agg(F.min("_v").alias("_v"))
    if small(reference):
        one = F.broadcast(one)
    cond = F.lit(True)
    for i, (x, _) in enumerate(pairs):
        cond = cond & (pick(df, x) == F.col(f"_k{i}"))
    shadow = {n.lower() for n in names}
    kept = [df[quoted(c)] for c in df.columns if c.lower() not in shadow]
    return df.join(one, cond, "left").select(*kept, *[F.col(f"_v.v{i}").alias(n) for i, n in enumerate(names)])


def matched(df: DataFrame, target: DataFrame, on: str | Sequence[str] | Mapping[str, str], flag: str = "is_match") -> DataFrame:
    """``df`` with a flag that a target row of its keys exists; the key is tested, not a whole row."""
    pairs = keys_of(on)
    keys = target.select(*[F.col(quoted(y)).alias(f"_t{i}") for i, (_, y) in enumerate(pairs)]).distinct()
    cond = F.lit(True)
    for i, (x, _) in enumerate(pairs):
        cond = cond & (pick(df, x) == F.col(f"_t{i}"))
    return df.join(keys, cond, "left").withColumn(flag, F.col("_t0").isNotNull()).drop(*[f"_t{i}" for i in range(len(pairs))])


def new_or_changed(df: DataFrame, target: DataFrame, on: str | Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``target``, or whose compared columns differ there (null-safe)."""
    keys = [x for x, _ in keys_of(on)]
    old = target.select(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*map(quoted, compare)).alias("_old"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & (pick(df, k) == F.col(f"_k{i}"))
    now = F.struct(*[pick(df, c) for c in compare])
    return df.join(old, cond, "left").filter(F.col("_k0").isNull() | ~now.eqNullSafe(F.col("_old"))).select(*[df[quoted(c)] for c in df.columns])


# --- aggregates -----------------------------------------------------------------

#: Functions that make an expression an aggregate.
AGGREGATES = ("any_value", "count", "sum", "avg", "min", "max", "string_agg", "array_agg", "count_if", "listagg", "collect_list", "collect_set", "first", "last", "stddev", "variance")


def is_aggregate(expression_: str) -> bool:
    return bool(re.search(rf"\b(?:{'|'.join(AGGREGATES)})\s*\(", re.sub(r"'(?:[^']|'')*'", "''", expression_), re.I))


def aggregator(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """GROUP BY ``keys``; a column that is neither a key nor an aggregate takes any one value of its group."""
    aggs = {n: e for n, e in columns.items() if n.lower() not in {k.lower() for k in keys} or is_aggregate(e)}
    out = [(F.expr(e) if is_aggregate(e) else F.any_value(F.expr(e), F.lit(True))).alias(n) for n, e in aggs.items()]
    if not out:
        return df.select(*map(quoted, keys)).distinct()
    grouped = df.groupBy(*map(quoted, keys)) if keys else df.groupBy()
    return grouped.agg(*out)


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n"))


# --- sets and explosion -----------------------------------------------------------


def union_all(frames: Mapping[str, DataFrame], columns: Sequence[str], mappings: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """UNION ALL of named inputs, each with its own map from output to input column; an unmapped absent column is null."""
    out = None
    for name, df in frames.items():
        have, own = {c.lower(): c for c in df.columns}, (mappings or {}).get(name, {})
        part = df.select(*[(F.expr(own[c]) if c in own else F.col(quoted(have[c.lower()])) if c.lower() in have else F.lit(None)).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a union needs an input")
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that aren't in ``b``."""
    return a.subtract(b)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order, later ones dropped."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*map(quoted, keys)).orderBy(*order))).filter("_n = 1").drop("_n")


def normalizer(df: DataFrame, occurs: int, flat: Sequence[str], groups: Mapping[str, Sequence[str]], index: str = "idx") -> DataFrame:
    """``occurs`` rows for each row: the flat columns, the occurrence's number, and of each group the column of that number."""
    items = [F.struct(F.lit(i + 1).alias(index), *[(F.col(quoted(cols[i])) if i < len(cols) else F.lit(None)).alias(g) for g, cols in groups.items()]) for i in range(occurs)]
    return df.select(*map(quoted, flat), F.explode(F.array(*items)).alias("_o")).select(*map(quoted, flat), "_o.*")


def repeated(df: DataFrame, occurs: int, index: str = "idx") -> DataFrame:
    """Each row ``occurs`` times with its number."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(occurs))).alias(index))


# --- types and registration -----------------------------------------------------------


def cast_keys(df: DataFrame, by_suffix: Mapping[str, str]) -> DataFrame:
    """Columns whose names end in a suffix get its type, so that keys of both sides of a join agree."""
    out = []
    for c, t in df.dtypes:
        want = next((w for s, w in by_suffix.items() if c.lower().endswith(s.lower())), t)
        out.append(F.col(quoted(c)).cast(want).alias(c) if want != t else F.col(quoted(c)))
    return df.select(*out)


def registered(spark, name: str, sql: str) -> DataFrame:
    """A view's translated SQL under its name."""
    df = spark.sql(sql)
    df.createOrReplaceTempView(name)
    return df


def dropped(spark, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def ddl_of(df: DataFrame, name: str) -> str:
    """CREATE TABLE of a frame's schema."""
    columns = ",\n  ".join(f"{quoted(c)} {t}" for c, t in df.dtypes)
    return f"CREATE TABLE {quoted(name)} (\n  {columns}\n)"
