"""SQL scripts of other warehouses: BTEQ batches and task pipelines with streams and procedures."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import dialect
from weftline.plans import sqltext
from weftline.plans.ir import Context, Graph, Source, Statement, Target, view_name
from weftline.plans.xml_frontend import statement_node
from weftline.sources.readers import copied


def _short(sql: str) -> str:
    for n, _ in sqltext.tables_read(sql):
        if "." in n:
            sql = re.sub(rf"(?i)(?<![\w.]){re.escape(n)}(?!\w)", view_name(n), sql)
    return sql


@dataclass
class Script:
    """A graph of statements in order, and the notes of those that change no rows."""

    name: str
    graph: Graph
    targets: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def run(self, ctx: Context) -> dict[str, DataFrame]:
        made = self.graph.run(ctx)
        return {t: made[t] for t in self.targets if t in made}


def _add(script: Script, text: str, procedures: dict[str, list[str]] | None = None) -> None:
    s, n = sqltext.classify(text), len(script.graph.nodes) + 1
    if s.kind == "ctas":
        table = view_name(s.target)
        script.graph.nodes.append(Source(f"q{n}", sql=dialect.query(_short(s.query)), reads=[view_name(x) for x, _ in sqltext.tables_read(s.query)]))
        script.graph.nodes.append(Target(table, f"q{n}"))
        script.targets.append(table)
    elif s.kind in ("insert", "update", "delete", "truncate", "merge"):
        node = statement_node(f"s{n}", text)
        script.graph.nodes.append(node)
        if node.table not in script.targets:
            script.targets.append(node.table)
    elif s.kind == "call":
        name = view_name(s.target or "").upper()
        if procedures is None or name not in procedures:
            script.notes.append(f"call of unknown procedure {s.target}")
        else:
            for inner in procedures[name]:
                _add(script, inner, procedures)
    elif s.kind == "copy" and (m := re.search(r"(?is)\bFROM\s+'([^']+)'", text)):
        kind = re.search(r"(?is)\bTYPE\s*=\s*'?(\w+)", text)
        table, path, form = view_name(s.target), m[1], (kind[1].lower() if kind else "csv")
        script.graph.nodes.append(Statement(f"s{n}", table, lambda df, ctx: copied(df, path, form)))
        if table not in script.targets:
            script.targets.append(table)
    elif s.kind in ("drop", "statistics", "copy", "create"):
        script.notes.append(f"{s.kind} {s.target or ''}".strip())
    elif s.kind != "empty":
        script.notes.append(f"left out: {text.strip()[:60]}")


def bteq(text: str, name: str = "batch") -> Script:
    """A BTEQ batch: dot commands are notes, statements run in order."""
    commands = [x.strip() for x in text.splitlines() if x.lstrip().startswith(".")]
    body = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("."))
    script = Script(name, Graph(name))
    for s in sqltext.statements(sqltext.strip_comments(body)):
        _add(script, s)
    script.notes += [c.split()[0].lower() for c in commands]
    return script


@dataclass
class Stream:
    name: str
    table: str
    append_only: bool = False
    initial_rows: bool = False


@dataclass
class Task:
    name: str
    body: str
    after: list[str] = field(default_factory=list)
    schedule: str | None = None
    condition: str | None = None


@dataclass
class TaskPipeline:
    streams: dict[str, Stream] = field(default_factory=dict)
    tasks: dict[str, Task] = field(default_factory=dict)
    procedures: dict[str, list[str]] = field(default_factory=dict)
    other: list[str] = field(default_factory=list)

    def order(self) -> list[str]:
        """Tasks after those they follow; a cycle is an error."""
        out, left = [], dict(self.tasks)
        while left:
            ready = next((n for n, t in left.items() if all(a in out or a not in self.tasks for a in t.after)), None)
            if ready is None:
                raise ValueError(f"a cycle among tasks {sorted(left)}")
            out.append(ready)
            del left[ready]
        return out

    def edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, t.name) for t in self.tasks.values() for a in t.after], "src string, dst string")

    def script(self, name: str = "tasks") -> Script:
        """All tasks in order as one script; calls take the procedure's statements."""
        out = Script(name, Graph(name))
        for t in self.order():
            for s in sqltext.statements(self.tasks[t].body):
                _add(out, re.sub(r"(?i)(\w+\.)?METADATA\$(\w+)", lambda m: (m[1] or "") + "METADATA$" + m[2].upper(), s), self.procedures)
        for n in self.streams:
            out.notes.append(f"stream {n}")
        return out


def procedure_body(text: str) -> list[str]:
    """The statements of a procedure's block, without control words."""
    m = re.search(r"(?is)\bBEGIN\b(.*)\bEND\b", sqltext.strip_comments(text))
    body = m[1] if m else text
    return [s for s in sqltext.statements(body) if sqltext.classify(s).kind in ("insert", "update", "delete", "truncate", "merge", "ctas")]


def task_pipeline(text: str) -> TaskPipeline:
    out = TaskPipeline()
    for s in sqltext.statements(sqltext.strip_comments(text)):
        m = re.match(r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?STREAM\s+([\w.]+)\s+ON\s+TABLE\s+([\w.]+)(.*)", s)
        if m:
            yes = lambda key, rest=m[3]: bool(re.search(rf"(?i){key}\s*=\s*TRUE", rest))
            out.streams[view_name(m[1])] = Stream(m[1], m[2], yes("APPEND_ONLY"), yes("SHOW_INITIAL_ROWS"))
            continue
        m = re.match(r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?TASK\s+([\w.]+)(.*?)\bAS\b\s+(?=MERGE|INSERT|UPDATE|DELETE|CALL|TRUNCATE|CREATE|BEGIN|COPY)(.*)", s)
        if m:
            after = re.search(r"(?is)\bAFTER\s+([\w.]+(?:\s*,\s*[\w.]+)*)", m[2])
            every = re.search(r"(?is)\bSCHEDULE\s*=\s*'([^']*)'", m[2])
            when = re.search(r"(?is)\bWHEN\s+(.*)$", m[2])
            name = view_name(m[1])
            out.tasks[name] = Task(name, m[3].strip(), [view_name(a.strip()) for a in after[1].split(",")] if after else [], every[1] if every else None, when[1].strip() if when else None)
            continue
        m = re.match(r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+([\w.]+)\s*\(.*?\$\$(.*)\$\$", s)
        if m:
            out.procedures[view_name(m[1]).upper()] = procedure_body(m[2])
            continue
        out.other.append(s)
    return out


def stream_frame(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table's stream between two states, with ``METADATA$ACTION`` and ``METADATA$ISUPDATE``.

    An update is a deletion of the old row and an insertion of the new one.
    """
    a = old.withColumn("_in", F.lit(True)).alias("a")
    b = new.withColumn("_in", F.lit(True)).alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    both = a.join(b, on, "full")
    had, has = F.col("a._in").isNotNull(), F.col("b._in").isNotNull()
    row = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in new.columns])
    changed = both.filter(~had | ~has | ~row("a").eqNullSafe(row("b")))
    events = F.array(F.struct(row("a").alias("r"), F.lit("DELETE").alias("action"), had.alias("real")), F.struct(row("b").alias("r"), F.lit("INSERT").alias("action"), has.alias("real")))
    return changed.select(F.explode(events).alias("e"), (had & has).alias("u")).filter("e.real").select("e.r.*", F.col("e.action").alias("METADATA$ACTION"), F.col("u").alias("METADATA$ISUPDATE"))
