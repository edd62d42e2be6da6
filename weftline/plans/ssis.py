"""Data-flow packages (.dtsx): OLE DB sources, lookups, derived columns, conditional splits and destinations."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftline.functions import dialect
from weftline.plans import sqltext
from weftline.plans.ir import Context, Expression, Graph, Lookup, Node, Router, Source, Target, view_name
from weftline.plans.xml_frontend import statement_node


@dataclass
class Package:
    name: str
    graph: Graph
    targets: list[str] = field(default_factory=list)
    variables: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)

    def run(self, ctx: Context) -> dict[str, DataFrame]:
        made = self.graph.run(ctx)
        return {t: made[t] for t in self.targets}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attr(el: ET.Element, name: str) -> str | None:
    return next((v for k, v in el.attrib.items() if _local(k) == name), None)


def _all(el: ET.Element, tag: str) -> list[ET.Element]:
    return [x for x in el.iter() if _local(x.tag) == tag]


def _properties(el: ET.Element) -> dict[str, str]:
    holder = next((x for x in el if _local(x.tag) == "properties"), None)
    return {_attr(p, "name"): (p.text or "").strip() for p in holder} if holder is not None else {}


def _columns(el: ET.Element) -> list[ET.Element]:
    return [c for c in _all(el, "column") if _attr(c, "name")]


def parse(text: str) -> Package:
    """A package's graph: control statements first, then each data flow's components.

    A component reads the output that its path starts from, so what follows a
    conditional split takes that output's rows alone. Without paths each
    component reads the one before it; after a split that is an error.

    ``?`` parameters of a source are filled from the package's variables in order.
    """
    root = ET.fromstring(text)
    package = Package(_attr(root, "ObjectName") or "package", Graph(_attr(root, "ObjectName") or "package"))
    for v in _all(root, "Variable"):
        value = next((x.text for x in v if _local(x.tag) == "VariableValue"), None)
        package.variables[_attr(v, "ObjectName")] = (value or "").strip()
    for i, p in enumerate(x for x in _all(root, "Property") if _attr(x, "Name") == "SqlStatementSource"):
        for j, s in enumerate(sqltext.statements(p.text or "")):
            if sqltext.classify(s).kind in ("insert", "update", "delete", "truncate", "merge"):
                package.graph.nodes.append(statement_node(f"control_{i}_{j}", s))
    for flow in _all(root, "pipeline"):
        before: str | None = None
        starts, ends = {}, {}
        for p in _all(flow, "path"):
            ends[_attr(p, "endId")] = _attr(p, "startId")
        components = [x for x in flow.iter() if _local(x.tag) == "component"]
        for c in components:
            split = (_attr(c, "componentClassID") or "").endswith("ConditionalSplit")
            for out in _all(c, "output"):
                starts[_attr(out, "refId") or _attr(out, "id")] = f"{_attr(c, 'name')}.{_attr(out, 'name')}" if split else _attr(c, "name")
        for c in components:
            inputs = [_attr(x, "refId") or _attr(x, "id") for x in _all(c, "input")]
            given = [starts[ends[i]] for i in inputs if i in ends]
            if given:
                before = given[0]
            elif before in {n.name for n in package.graph.nodes if isinstance(n, Router)}:
                raise ValueError(f"no path says which output of {before} goes to {_attr(c, 'name')}")
            node = _component(c, before, package)
            package.graph.nodes.append(node)
            if isinstance(node, Target):
                package.targets.append(node.name)
            else:
                before = node.name
    return package


def _component(c: ET.Element, before: str | None, package: Package) -> Node:
    name, kind, props = _attr(c, "name"), (_attr(c, "componentClassID") or "").rpartition(".")[2], _properties(c)
    for col in _columns(c):
        package.types[_attr(col, "name")] = _attr(col, "dataType") or ""
    texts = frozenset(n for n, t in package.types.items() if t in ("wstr", "str", "nText", "text"))
    if kind.endswith("Source"):
        columns = [_attr(x, "name") for x in _columns(c)]
        sql = props.get("SqlCommand")
        if sql:
            values = iter(package.variables.values())
            sql = re.sub(r"\?", lambda m: "timestamp_ntz'" + next(values) + "'", sql)
            reads = [view_name(n) for n, _ in sqltext.tables_read(sql)]
            for n, _ in sqltext.tables_read(sql):
                if "." in n:
                    sql = re.sub(rf"(?i)(?<![\w.]){re.escape(n)}(?!\w)", view_name(n), sql)
            return Source(name, sql=dialect.query(sql), reads=reads, columns=columns)
        return Source(name, table=view_name(sqltext.plain(props["OpenRowset"])), columns=columns or None)
    if kind == "Lookup":
        table = view_name(sqltext.plain(props.get("ReferenceTableName") or props.get("OpenRowset") or ""))
        return Lookup(name, before, table, [k.strip() for k in props.get("JoinKeys", "").split(",") if k.strip()], [_attr(x, "name") for x in _columns(c)], sql=props.get("SqlCommand"))
    if kind == "DerivedColumn":
        return Expression(name, before, {_attr(x, "name"): dialect.expression(_attr(x, "expression"), "ssis", texts) for x in _columns(c) if _attr(x, "expression")})
    if kind == "ConditionalSplit":
        groups = []
        for out in _all(c, "output"):
            condition = _properties(out).get("EvaluationExpression")
            default = (_attr(out, "isDefault") or "").lower() == "true"
            groups.append((_attr(out, "name"), None if default or not condition else dialect.expression(condition, "ssis")))
        return Router(name, before, groups)
    if kind.endswith("Destination"):
        return Target(view_name(sqltext.plain(props["OpenRowset"])), before)
    raise ValueError(f"component {name} of kind {kind!r} has no meaning as data")
