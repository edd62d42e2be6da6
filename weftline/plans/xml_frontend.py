"""Pipelines in XML: ``<pipeline>`` with extract, extract_csv, transform, join, aggregate, load and execute_sql steps.

Parsing happens on the driver; the result is a graph of lazy nodes. Operations
of a transform run from first to last, each on the result of the one before.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import dialect
from weftline.functions.types import guessed
from weftline.operators import dml
from weftline.operators import relational as R
from weftline.plans import sqltext
from weftline.plans.ir import Aggregator, Context, Graph, Joiner, Node, Source, Statement, Steps, Target, view_name

Operation = Callable[[DataFrame], DataFrame]
#: Operation tag to a maker of the operation from its attributes.
OPERATIONS: dict[str, Callable[[Mapping[str, str]], Operation]] = {}


def operation(tag: str):
    """Registers a transform operation under a tag."""

    def add(f):
        OPERATIONS[tag] = f
        return f

    return add


def _names(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


@operation("drop")
def _drop(a):
    gone = {c.lower() for c in _names(a.get("columns") or a.get("column"))}
    return lambda df: df.select(*[F.col(R.quoted(c)) for c in df.columns if c.lower() not in gone])


@operation("rename")
def _rename(a):
    old, new = a["old_col"], a["new_col"]
    return lambda df: df.select(*[F.col(R.quoted(c)).alias(new if c.lower() == old.lower() else c) for c in df.columns])


@operation("math")
def _math(a):
    signs = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
    op = a.get("operation") or a.get("op") or ""
    if op.lower() not in signs:
        raise ValueError(f"unknown math operation {op!r}")

    def side(df, n):
        if a.get(f"col{n}"):
            return R.pick(df, a[f"col{n}"])
        value = a[f"val{n}"]
        if re.fullmatch(r"-?\d+", value):
            return F.lit(int(value))
        return F.lit(float(value)) if re.fullmatch(r"-?\d*\.?\d+(?:[eE]-?\d+)?", value) else R.pick(df, value)

    def run(df):
        x, y = side(df, 1), side(df, 2)
        out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[signs[op.lower()]]()
        return R.expression(df, {a["result_column"]: out})

    return run


@operation("calculate_category")
def _category(a):
    return lambda df: R.expression(df, {a["result_column"]: dialect.category(R.pick(df, a["column"]), float(a["low"]), float(a["high"]))})


@operation("calculate_age")
def _age(a):
    as_of = F.expr(a.get("as_of") or "current_date()")
    return lambda df: R.expression(df, {a.get("result_column", "age"): dialect.age(R.pick(df, a["dob_column"]), as_of)})


@operation("concat")
def _concat(a):
    return lambda df: R.expression(df, {a["result_column"]: F.concat_ws(a.get("separator", " "), *[R.pick(df, c).cast("string") for c in _names(a.get("cols") or a.get("columns"))])})


@operation("filter_text")
def _filter_text(a):
    return lambda df: df.filter(R.pick(df, a["column"]).contains(a["contains"]))


@operation("filter")
def _filter(a):
    text = a.get("condition") or a.get("expression")
    if not text:
        text = f"{R.quoted(a['column'])} {a.get('operator', '=')} {a['value']}"
    return lambda df: df.filter(F.expr(dialect.expression(text)))


@operation("sort")
def _sort(a):
    down = (a.get("order") or a.get("direction") or "asc").lower().startswith("desc")
    return lambda df: df.orderBy(*[(F.desc if down else F.asc)(R.quoted(c)) for c in _names(a.get("columns") or a.get("column"))])


@dataclass
class Step:
    id: str
    kind: str
    inputs: list[str]
    element: ET.Element


@dataclass
class Pipeline:
    name: str
    steps: list[Step]
    graph: Graph
    sources: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _query(el: ET.Element) -> str:
    q = el.find("query")
    return ((q.text if q is not None else None) or el.get("query") or el.text or "").strip()


def _stem(path: str) -> str:
    return re.sub(r"(?i)\.csv$", "", path.replace("\\", "/").split("/")[-1])


def target_name(el: ET.Element) -> str:
    return el.get("table") or _stem(el.get("path") or el.get("file") or el.get("id"))


def steps_of(text: str) -> tuple[str, list[Step]]:
    root = ET.fromstring(text)
    root = root if root.tag == "pipeline" else root.find(".//pipeline")
    if root is None:
        raise ValueError("no <pipeline>")
    holder = root.find("steps")
    out = []
    for el in holder if holder is not None else root:
        if el.tag in ("connection", "connections", "description"):
            continue
        inputs = [x for x in (el.get("input"), el.get("left"), el.get("right")) if x]
        out.append(Step(el.get("id") or el.get("name") or f"{el.tag}_{len(out) + 1}", el.tag, inputs, el))
    return root.get("name") or "pipeline", out


def used_columns(steps: list[Step]) -> dict[str, list[str]]:
    """Columns that later steps need of each CSV extract, in order of first use.

    A need moves up through transforms and joins; a column that a step makes
    itself isn't asked of its input.
    """
    need: dict[str, dict[str, None]] = {s.id: {} for s in steps}
    for s in reversed(steps):
        asks, made = dict(need.get(s.id, {})), set()
        el = s.element
        if s.kind == "transform":
            for op in reversed(list(el)):
                made_here = {(op.get("result_column") or op.get("new_col") or "").lower()}
                asks = {c: None for c in asks if c.lower() not in made_here}
                for attr in ("column", "col1", "col2", "dob_column", "old_col"):
                    if op.get(attr):
                        asks.setdefault(op.get(attr))
                for c in _names(op.get("cols")) + (_names(op.get("columns")) if op.tag in ("drop", "sort") else []):
                    asks.setdefault(c)
        elif s.kind == "join":
            for c in _names(el.get("on")):
                asks.setdefault(c)
        elif s.kind == "aggregate":
            asks = dict.fromkeys(_names(el.get("group_by")))
            for fn in el:
                if fn.get("column"):
                    asks.setdefault(fn.get("column"))
        del made
        for i in s.inputs:
            for c in asks:
                if i in need:
                    need[i].setdefault(c)
    return {s.id: list(need[s.id]) for s in steps if s.kind == "extract_csv"}


def csv_schema(columns: list[str]):
    """A schema of guessed types for an extract whose file isn't at hand."""
    from pyspark.sql import types as T

    return T.StructType([T.StructField(c, guessed(c)) for c in columns])


def later_columns(steps: list[Step]) -> dict[str, dict[str, str]]:
    """Columns that UPDATE statements set in tables that loads make, to be added as nulls; types are guessed."""
    out: dict[str, dict[str, str]] = {}
    for s in steps:
        if s.kind == "execute_sql":
            text = _query(s.element)
            if sqltext.classify(text).kind == "update":
                table, sets, _ = split_update(text)
                for c in sets:
                    out.setdefault(view_name(table).lower(), {})[c] = guessed(c).simpleString()
    return out


def split_update(text: str) -> tuple[str, dict[str, str], str | None]:
    """Target, assignments and condition of UPDATE."""
    flat = sqltext.strip_comments(re.sub(r"\$\{\s*ref\(\s*'([^']+)'\s*\)\s*\}", r"\1", text)).strip().rstrip(";")
    m = re.match(r"(?is)UPDATE\s+([\w.\"`]+)\s+(?:AS\s+)?(?:\w+\s+)?SET\s+(.*)", flat)
    if not m:
        raise ValueError(f"not an UPDATE: {text[:60]!r}")
    w, depth, cut = dialect.tokens(m[2]), 0, None
    for i, t in enumerate(w):
        depth += (t == "(") - (t == ")")
        if not depth and t.upper() == "WHERE":
            cut = i
            break
    sets = {}
    for part in dialect.split_arguments(w[:cut]):
        k, _, v = part.partition("=")
        sets[sqltext.plain(k.strip()).split(".")[-1]] = dialect.expression(v.strip())
    return sqltext.plain(m[1]), sets, dialect.expression("".join(w[cut + 1 :]).strip()) if cut is not None else None


def statement_node(name: str, text: str) -> Node:
    """INSERT, UPDATE, DELETE, TRUNCATE or MERGE as a change of its target."""
    s = sqltext.classify(text)
    flat = re.sub(r"\$\{\s*ref\(\s*'([^']+)'\s*\)\s*\}", r"\1", sqltext.strip_comments(text)).strip().rstrip(";")
    table = view_name(s.target) if s.target else ""

    def views(ctx: Context, names):
        for n in names:
            ctx.table(view_name(n)).createOrReplaceTempView(view_name(n))

    def short(sql: str) -> str:
        for n in sorted(set(s.sources) | {s.target or ""}, key=len, reverse=True):
            if "." in n:
                sql = re.sub(rf"(?i)(?<![\w.]){re.escape(n)}(?!\w)", view_name(n), sql)
        return sql

    if s.kind == "truncate":
        return Statement(name, table, lambda df, ctx: dml.truncate(df))
    if s.kind == "delete":
        m = re.search(r"(?is)\bWHERE\b(.*)$", flat)
        where = dialect.expression(m[1].strip()) if m else None
        return Statement(name, table, lambda df, ctx: dml.delete(df, where))
    if s.kind == "update":
        _, sets, where = split_update(text)
        return Statement(name, table, lambda df, ctx: dml.update(df, sets, where))
    if s.kind == "insert" and s.query:

        def change(df, ctx):
            views(ctx, s.sources)
            return dml.insert(df, ctx.spark.sql(dialect.query(short(s.query))), s.columns or None)

        return Statement(name, table, change)
    if s.kind == "merge":
        spec = sqltext.parse_merge(flat)

        def change(df, ctx):
            if re.match(r"(?i)\s*(SELECT|WITH)\b", spec.source):
                names = [n for n, _ in sqltext.tables_read(spec.source)]
                views(ctx, names)
                source = ctx.spark.sql(dialect.query(short(spec.source)))
            else:
                source = ctx.table(view_name(spec.source))
            return dml.merge(df, source, merge_spec(spec))

        return Statement(name, table, change)
    raise ValueError(f"statement {s.kind!r} isn't a change of a table")


def merge_spec(m: sqltext.MergeText) -> dml.Merge:
    """The MERGE as join keys, further match conditions and branches over ``t`` and ``s``."""

    def own(text: str) -> str:
        text = re.sub(rf"(?i)(?<![\w.]){re.escape(m.source_alias)}\.", "s.", text)
        return dialect.expression(re.sub(rf"(?i)(?<![\w.]){re.escape(m.target_alias)}\.", "t.", text))

    keys, more = {}, []
    for part in re.split(r"(?i)\s+AND\s+", m.on):
        x = own(part.strip())
        e = re.fullmatch(r"([ts])\.(\w+)\s*=\s*([ts])\.(\w+)", x)
        if e and e[1] != e[3]:
            keys[e[2] if e[1] == "t" else e[4]] = e[4] if e[1] == "t" else e[2]
        else:
            more.append(x)
    when = lambda b: dml.When({k: own(v) for k, v in b[3].items()} if b[2] != "delete" else None, own(b[1]) if b[1] else None)
    return dml.Merge(keys, [when(b) for b in m.branches if b[0]], [when(b) for b in m.branches if not b[0]], match_condition=" AND ".join(more) or None)


def parse(text: str) -> Pipeline:
    """A pipeline's graph. Its sources are table names and the stems of CSV files."""
    name, steps = steps_of(text)
    later, asked = later_columns(steps), used_columns(steps)
    out = Pipeline(name, steps, Graph(name))
    for s in steps:
        el = s.element
        if s.kind == "extract":
            sql = _query(el)
            reads = [view_name(n) for n, _ in sqltext.tables_read(sql)]
            short = sql
            for n, _ in sqltext.tables_read(sql):
                if "." in n:
                    short = re.sub(rf"(?i)(?<![\w.]){re.escape(n)}(?!\w)", view_name(n), short)
            out.sources += [r for r in reads if r not in out.sources and r not in out.targets]
            out.graph.nodes.append(Source(s.id, sql=dialect.query(short), reads=reads))
        elif s.kind == "extract_csv":
            stem = _stem(el.get("path") or el.get("file") or s.id)
            out.sources.append(stem)
            out.graph.nodes.append(Source(s.id, table=stem, columns=None))
            if not asked.get(s.id):
                out.warnings.append(f"{s.id}: no column of {stem} is used")
        elif s.kind == "transform":
            ops = []
            for op in el:
                if op.tag not in OPERATIONS:
                    raise ValueError(f"step {s.id}: operation <{op.tag}> has no meaning as data")
                ops.append(OPERATIONS[op.tag](op.attrib))
            out.graph.nodes.append(Steps(s.id, el.get("input"), ops))
        elif s.kind == "join":
            out.graph.nodes.append(Joiner(s.id, el.get("left"), el.get("right"), el.get("on") or "", el.get("how") or el.get("type") or "left"))
        elif s.kind == "aggregate":
            keys, columns = _names(el.get("group_by")), {}
            for fn in el:
                column = fn.get("column")
                result = fn.get("result_column") or f"{fn.tag.upper()}_{column or 'all'}"
                columns[result] = f"{fn.tag}({R.quoted(column) if column else '*'})"
            out.graph.nodes.append(Aggregator(s.id, el.get("input"), keys, columns))
        elif s.kind == "load":
            target = target_name(el)
            out.targets.append(target)
            out.graph.nodes.append(Target(target, el.get("input"), later=later.get(target.lower(), {}), unique_key=_names(el.get("unique_key")), incremental=(el.get("mode") or "").lower() in ("incremental", "upsert")))
        elif s.kind == "execute_sql":
            for i, sql in enumerate(sqltext.statements(_query(el))):
                node = statement_node(f"{s.id}_{i}" if i else s.id, sql)
                out.graph.nodes.append(node)
                if node.table not in out.targets:
                    out.targets.append(node.table)
        else:
            raise ValueError(f"unknown step <{s.kind}>")
    return out


def run(pipeline: Pipeline, ctx: Context) -> dict[str, DataFrame]:
    """The pipeline's targets."""
    made = pipeline.graph.run(ctx)
    return {t: made[t] for t in pipeline.targets}
