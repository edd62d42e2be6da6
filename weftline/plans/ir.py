"""The dataflow graph: nodes that evaluate to lazy DataFrames.

A node names its inputs; a graph evaluates nodes in order into a dictionary of
frames. No SQL text is generated: nodes a target doesn't need never enter its
plan, and the optimizer prunes and pushes as for any frame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weftline.functions import naming
from weftline.operators import dml
from weftline.operators import relational as R


@dataclass
class Context:
    """A session, how a table name becomes a frame, variables, and what nodes have made."""

    spark: SparkSession
    tables: Callable[[str], DataFrame]
    variables: Mapping[str, str] = field(default_factory=dict)
    made: dict[str, DataFrame] = field(default_factory=dict)
    stages: str | None = None  # a shared folder where targets are written as they are made

    def table(self, name: str) -> DataFrame:
        return self.made[name] if name in self.made else self.tables(name)

    def text(self, value: str) -> str:
        """An expression with its variables as literals."""
        return naming.inlined(value, self.variables) if "$" in value else value

    def sql(self, text: str) -> DataFrame:
        """A statement with its variables as typed parameters."""
        text, args = naming.bound(text, self.variables) if "$" in text else (text, {})
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)


@dataclass
class Node:
    name: str

    def inputs(self) -> list[str]:
        return []

    def evaluate(self, ctx: Context) -> DataFrame:
        raise NotImplementedError


@dataclass
class Source(Node):
    table: str = ""
    sql: str | None = None
    columns: Mapping[str, str] | Sequence[str] | None = None
    where: str | None = None
    distinct: bool = False
    joins: Sequence[tuple[str, str, str | None, str]] = ()  # alias, table, condition, type
    reads: Sequence[str] = ()  # tables that the sql names

    def evaluate(self, ctx: Context) -> DataFrame:
        where = ctx.text(self.where) if self.where else None
        if self.sql is not None:
            for t in self.reads:
                ctx.table(t).createOrReplaceTempView(view_name(t))
            df = ctx.sql(self.sql)
            return R.source(R.aliased(df, list(self.columns)) if self.columns else df, None, where, self.distinct)
        if self.joins:
            base = self.table.split(".")[-1]
            df = R.multi_source(ctx.table(self.table), base, [R.Joined(a, ctx.table(t), on, how) for a, t, on, how in self.joins], where)
            return R.source(df, self.columns, None, self.distinct)
        return R.source(ctx.table(self.table), self.columns, where, self.distinct)


@dataclass
class Expression(Node):
    upstream: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)
    pass_upstream: bool = True

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        return R.expression(ctx.made[self.upstream], {k: ctx.text(v) for k, v in self.columns.items()}, self.pass_upstream)


@dataclass
class Steps(Node):
    """Transform operations one after another, each seeing the ones before."""

    upstream: str = ""
    operations: Sequence[Callable[[DataFrame], DataFrame]] = ()

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        df = ctx.made[self.upstream]
        for op in self.operations:
            df = op(df)
        return df


@dataclass
class Filter(Node):
    upstream: str = ""
    condition: str = "true"

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        return R.filtered(ctx.made[self.upstream], ctx.text(self.condition))


@dataclass
class Lookup(Node):
    upstream: str = ""
    table: str = ""
    on: str | Sequence[str] | Mapping[str, str] = ()
    returns: Mapping[str, str] | Sequence[str] = ()
    sql: str | None = None

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        reference = ctx.spark.sql(ctx.text(self.sql)) if self.sql else ctx.table(self.table)
        df = ctx.made[self.upstream]
        if not R.keys_of(self.on):
            raise ValueError(f"lookup {self.name} has no keys")
        return R.lookup(df, reference, self.on, self.returns)


@dataclass
class Joiner(Node):
    left: str = ""
    right: str = ""
    on: str | Sequence[str] | Mapping[str, str] = ()
    how: str = "left"

    def inputs(self):
        return [self.left, self.right]

    def evaluate(self, ctx):
        return R.joiner(ctx.made[self.left], ctx.made[self.right], self.on, self.how)


@dataclass
class Aggregator(Node):
    upstream: str = ""
    keys: Sequence[str] = ()
    columns: Mapping[str, str] = field(default_factory=dict)

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        return R.aggregator(ctx.made[self.upstream], self.keys, self.columns)


@dataclass
class Union(Node):
    upstreams: Sequence[str] = ()
    columns: Sequence[str] = ()
    mappings: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    def inputs(self):
        return list(self.upstreams)

    def evaluate(self, ctx):
        return R.union_all({u: ctx.made[u] for u in self.upstreams}, self.columns, self.mappings)


@dataclass
class Normalizer(Node):
    upstream: str = ""
    occurs: int = 1
    flat: Sequence[str] = ()
    groups: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        return R.normalizer(ctx.made[self.upstream], self.occurs, self.flat, self.groups)


@dataclass
class Router(Node):
    """Groups are reached as ``name.group``."""

    upstream: str = ""
    groups: Sequence[tuple[str, str | None]] = ()

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        for group, df in R.router(ctx.made[self.upstream], self.groups).items():
            ctx.made[f"{self.name}.{group}"] = df
        return ctx.made[self.upstream]


@dataclass
class Sequence_(Node):
    """A surrogate key that goes on from a table's largest one."""

    upstream: str = ""
    key: str = "sk"
    order: Sequence[str] = ()
    existing: str | None = None

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        from weftline.operators.windows import numbered, surrogate_keys

        df = ctx.made[self.upstream]
        return surrogate_keys(df, ctx.table(self.existing), self.key, self.order) if self.existing else numbered(df, self.order, self.key)


@dataclass
class Target(Node):
    """A table's next rows: projected, checked for a schema of later columns, replaced or merged by key.

    ``upstream`` may be one group of a router, as ``router.group``.
    """

    upstream: str = ""
    columns: Mapping[str, str] | None = None
    unique_key: Sequence[str] = ()
    incremental: bool = False
    later: Mapping[str, str] = field(default_factory=dict)

    def inputs(self):
        return [self.upstream]

    def evaluate(self, ctx):
        df = ctx.made[self.upstream]
        if self.columns:
            df = R.projected(df, self.columns)
        df = dml.extended(df, self.later)
        if self.incremental and self.unique_key:
            df = dml.upsert(ctx.tables(self.name), df, self.unique_key)
        if ctx.stages:  # later steps read what is stored
            from weftline.sources.readers import refreshed

            return refreshed(ctx.spark, df, f"{ctx.stages.rstrip('/')}/{self.name}", view_name(self.name))
        return df


@dataclass
class Statement(Node):
    """A change of a table by a function of its current rows."""

    table: str = ""
    change: Callable[[DataFrame, Context], DataFrame] = lambda df, ctx: df

    def evaluate(self, ctx):
        out = self.change(ctx.table(self.table), ctx)
        ctx.made[self.table] = out
        return out


@dataclass
class Graph:
    name: str
    nodes: list[Node] = field(default_factory=list)

    def ordered(self) -> list[Node]:
        """Nodes after their inputs, otherwise in the order given; a cycle or a missing input is an error."""
        known, out, left = set(), [], list(self.nodes)
        names = {n.name for n in left}
        for n in left:
            lost = [i for i in n.inputs() if i.split(".")[0] not in names and i not in names]
            if lost:
                raise ValueError(f"node {n.name} reads {lost}, which nothing makes")
        while left:
            ready = next((n for n in left if all(i in known or i.split(".")[0] in known for i in n.inputs())), None)
            if ready is None:
                raise ValueError(f"a cycle among {[n.name for n in left]}")
            out.append(ready)
            known.add(ready.name)
            left.remove(ready)
        return out

    def run(self, ctx: Context) -> dict[str, DataFrame]:
        """What every node made. Where stages are written, a router's targets are written in one pass over its upstream."""
        routed: set[str] = set()
        for node in self.ordered():
            if node.name not in routed:
                ctx.made[node.name] = node.evaluate(ctx)
            mates = self._targets_of(node) if isinstance(node, Router) and ctx.stages else []
            if len(mates) > 1:
                ctx.made.update(_written_together(ctx, node, mates))
                routed |= {t.name for t in mates}
        return ctx.made

    def _targets_of(self, router: Router) -> list[Target]:
        """The full-refresh targets that read one of the router's groups."""
        return [n for n in self.nodes if isinstance(n, Target) and n.upstream.split(".")[0] == router.name and "." in n.upstream and not n.incremental]

    def edges(self) -> list[tuple[str, str]]:
        return [(i, n.name) for n in self.nodes for i in n.inputs()]


def _written_together(ctx: Context, router: Router, mates: Sequence[Target]) -> dict[str, DataFrame]:
    from weftline.operators.targets import split_written

    taken = [f"coalesce({c}, false)" for _, c in router.groups if c is not None]
    where = {g: f"NOT ({' OR '.join(taken) or 'false'})" if c is None else c for g, c in router.groups}
    upstream, parts = ctx.made[router.upstream], {}
    for t in mates:
        columns = dict(t.columns) if t.columns else {c: R.quoted(c) for c in upstream.columns}
        have = {c.lower() for c in columns}
        columns |= {c: f"cast(null as {kind})" for c, kind in t.later.items() if c.lower() not in have}
        parts[t.name] = (where[t.upstream.split(".", 1)[1]], columns)
    out = split_written(upstream, parts, f"{ctx.stages.rstrip('/')}/{router.name}")
    for name, df in out.items():
        df.createOrReplaceTempView(view_name(name))
    return out


def view_name(table: str) -> str:
    """The temporary view of a table: its last part."""
    return table.split(".")[-1].strip('"`[]')
