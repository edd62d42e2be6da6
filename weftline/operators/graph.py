"""Lineage graphs as edge DataFrames: closure, depth, cycles, focus and propagation.

Edges have ``src`` and ``dst``. Walks follow shortcuts: pairs of nodes that are
2, 4, 8, ... edges apart, made by squaring as long as they stay in proportion to
the edges. With them a walk takes rounds in the logarithm of its length, and in
graphs too dense for that, which are seldom deep, rounds in its length divided
by the longest shortcut. Each round joins what changed last, cuts its lineage in
the shared checkpoint folder, and the walk stops when nothing is new, so graphs
with cycles end too. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


def edges_of(df: DataFrame, src: str = "source_fqn", dst: str = "target_fqn", drop_self: bool = True) -> DataFrame:
    out = df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return out.filter("src <> dst") if drop_self else out


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _kept(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """The results of the rounds so far. What was found stays as it was written; every 16 rounds it is written together."""
    parts = [*parts, new]
    return [cut(_all(parts))] if len(parts) > 16 else parts


#: Squaring stops before it could make more rows than this many times the edges.
DENSE = 8


@dataclass(frozen=True)
class Shortcuts:
    """Distinct pairs that a path of exactly 1, 2, 4, ... edges connects, in that order; ``acyclic`` if no path is twice as long as the last."""

    levels: list[DataFrame]
    acyclic: bool

    def steps(self, reverse: bool = False) -> DataFrame:
        """All of them as ``mid`` and ``next``, followed backwards with ``reverse``."""
        return _steps(_all(self.levels), reverse)

    def tagged(self) -> DataFrame:
        """All of them, and whether a pair is one of the longest."""
        return _all([x.withColumn("last", F.lit(i == len(self.levels) - 1)) for i, x in enumerate(self.levels)])


def shortcuts(edges: DataFrame, dense: int = DENSE) -> Shortcuts:
    """The shortcuts of a graph, until no path is longer, ``dense`` forbids the next, or, on cycles, beyond the number of edges."""
    levels = [cut(edges.select("src", "dst").distinct())]
    size, length = None, 1
    while True:
        last = levels[-1]
        into, out = last.groupBy(F.col("dst").alias("mid")).agg(F.count(F.lit(1)).alias("a")), last.groupBy(F.col("src").alias("mid")).agg(F.count(F.lit(1)).alias("b"))
        total = into.join(out, "mid", "full").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("pairs"), F.coalesce(F.sum("a"), F.lit(0)).alias("edges")).first()
        size = total.edges if size is None else size
        if total.pairs is None:
            return Shortcuts(levels, True)
        if total.pairs > dense * size or length >= size:
            return Shortcuts(levels, False)
        ahead = last.select(F.col("src").alias("mid"), F.col("dst").alias("next"))
        levels.append(cut(last.join(ahead, last["dst"] == ahead["mid"]).select("src", F.col("next").alias("dst")).distinct()))
        length *= 2


def _steps(pairs: DataFrame, reverse: bool = False) -> DataFrame:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return pairs.select(F.col(a).alias("mid"), F.col(b).alias("next"))


def closure(edges: DataFrame, seeds: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """Distinct pairs (src, dst) where a path of one edge or more leads from src to dst.

    With ``seeds`` (a column ``node``) only paths from them, or with ``reverse``
    to them. Each round joins the pairs found last with the shortcuts.
    """
    step = shortcuts(edges).steps(reverse)
    first = step.select(F.col("mid").alias("src"), F.col("next").alias("dst")).distinct()
    if seeds is not None:
        first = first.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    new = cut(first)
    found = [new]
    while not new.isEmpty():
        further = new.join(step, new["dst"] == step["mid"]).select("src", F.col("next").alias("dst")).distinct()
        new = cut(further.join(_all(found), ["src", "dst"], "left_anti"))
        found = _kept(found, new)
    found = _all(found)
    return found.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else found


def reached(edges: DataFrame, seeds: DataFrame, reverse: bool = False) -> DataFrame:
    """Nodes that a path from any seed leads to, seeds included: one walk for all seeds, of nodes, not pairs."""
    return _reached(shortcuts(edges).steps(reverse), seeds)


def _reached(step: DataFrame, seeds: DataFrame) -> DataFrame:
    new = cut(seeds.select("node").distinct())
    found = [new]
    while not new.isEmpty():
        new = cut(step.join(new.select(F.col("node").alias("mid")), "mid", "left_semi").select(F.col("next").alias("node")).distinct().join(_all(found), "node", "left_anti"))
        found = _kept(found, new)
    return _all(found)


def spread(step: DataFrame, state: DataFrame, best: Mapping[str, str]) -> DataFrame:
    """``state`` (node and labels, one row for each node) after labels have followed the steps.

    ``best`` says for each label whether the greatest or the least of a node's
    own and those that lead to it stays; null labels give way. Only nodes whose
    labels changed last send theirs on, so rows are nodes and steps.
    """
    pick = {"greatest": (F.max, F.greatest), "least": (F.min, F.least)}
    names = list(best)
    state = cut(state.select("node", *names, F.lit(True).alias("_new")))
    while not state.filter("_new").isEmpty():
        sent = state.filter("_new").join(step, F.col("node") == F.col("mid")).groupBy("next").agg(*[pick[best[c]][0](c).alias(f"_{c}") for c in names])
        both = state.join(sent, F.col("node") == F.col("next"), "left")
        after = {c: pick[best[c]][1](c, f"_{c}") for c in names}
        moved = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(x) for c, x in after.items()])
        state = cut(both.select("node", *[x.alias(c) for c, x in after.items()], moved.alias("_new")))
    return state.select("node", *names)


def _ends(last: DataFrame) -> list[DataFrame]:
    """Nodes where 1, 2, ... of the longest shortcuts in a row end, as long as they become fewer; the last are all that lie on or behind cycles, or none."""
    at = cut(last.select(F.col("dst").alias("node")).distinct())
    out, n = [at], at.count()
    while n:
        at = cut(last.join(at.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
        out.append(at)
        n, before = at.count(), n
        if n == before:
            break
    return out


def _through(pairs: DataFrame) -> DataFrame:
    """Tagged shortcuts among nodes that the longest ones both lead to and leave: what lies on no path that long is trimmed."""
    last = pairs.filter("last")
    inner = last.select(F.col("src").alias("node")).intersect(last.select(F.col("dst").alias("node")))
    return _among(pairs, inner)


def _among(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "last")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle, self edges included, with the smallest node of their cycle group.

    Each round gives every node the colour of the node with the greatest hash
    that leads to it; those that lead back to that node among nodes of the same
    colour are its group. Groups and the shortcuts between colours go, what lies
    on no long path any more is trimmed, and the next round follows. Hashes split
    a chain of groups at random, so the rounds, too, are few. A path between two
    nodes of one colour never leaves it, so the shortcuts are made once.
    """
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    return _cycles(shortcuts(edges.filter("src <> dst")), loops)


def _cycles(ways: Shortcuts, loops: DataFrame) -> DataFrame:
    groups: list[DataFrame] = []
    pairs = None if ways.acyclic else cut(_through(ways.tagged()))
    while pairs is not None and not pairs.isEmpty():
        every = nodes_of(pairs).withColumn("colour", F.struct(F.xxhash64("node", F.lit(len(groups))).alias("h"), F.col("node").alias("of")))
        colour = spread(_steps(pairs), every, {"colour": "greatest"}).select("node", F.col("colour.of").alias("colour"))
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        pairs = cut(pairs.join(a, "src").join(b, "dst").filter("a = b").select("src", "dst", "last"))
        back = _reached(_steps(pairs, reverse=True), colour.filter("node = colour").select("node"))
        group = cut(colour.join(back, "node"))
        groups.append(group)
        pairs = cut(_through(_among(pairs, colour.join(group, "node", "left_anti"))))
    if not groups:
        return loops.select("node", F.col("node").alias("cycle"))
    every = _all(groups)
    low = every.groupBy("colour").agg(F.min("node").alias("cycle"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = cut(every.join(low, "colour").select("node", "cycle"))
    return found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("cycle")))


def _depths(units: DataFrame, ways: Shortcuts) -> DataFrame | None:
    """``node`` and ``depth``, the edges of the longest path that ends there; None if there are cycles.

    A node is d deep or deeper if a path of exactly d edges ends in it. The
    longest shortcuts give the depth in steps of their length; each shorter one
    then settles a bit: half a step more fits if it leads here from a node that
    is as deep in whole steps.
    """
    levels, stride = ways.levels, 1 << (len(ways.levels) - 1)
    at = [levels[-1].select(F.col("dst").alias("node")).distinct()] if ways.acyclic else _ends(levels[-1])
    if not ways.acyclic and not at[-1].isEmpty():
        return None
    rows = _all([x.select("node", F.lit(stride * i).alias("d")) for i, x in enumerate(at, 1)]).groupBy("node").agg(F.max("d").alias("d"))
    depth = cut(units.join(rows, "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("depth")))
    for level in reversed(levels[:-1]):
        stride //= 2
        before = level.join(depth.select(F.col("node").alias("src"), F.col("depth").alias("d")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("d").alias("d"))
        depth = cut(depth.join(before, "node", "left").select("node", (F.col("depth") + F.when(F.col("d") >= F.col("depth"), F.lit(stride)).otherwise(F.lit(0))).alias("depth")))
    return depth


def waves(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node``, ``wave`` and ``in_cycle``: one more than the longest path from a root; roots are 1.

    Each cycle counts as one node, and its members share a wave; cycles are only
    looked for where there are any.
    """
    every = nodes_of(edges) if nodes is None else nodes.select("node").unionByName(nodes_of(edges)).distinct()
    every = cut(every)
    e = cut(edges.select("src", "dst").distinct())
    loops = e.filter("src = dst").select(F.col("src").alias("node"))
    plain = e.filter("src <> dst")
    ways = shortcuts(plain)
    depth = _depths(every, ways)
    if depth is not None:
        self_edge = loops.withColumn("_loop", F.lit(True))
        return depth.join(self_edge, "node", "left").select("node", (F.col("depth") + 1).alias("wave"), F.coalesce("_loop", F.lit(False)).alias("in_cycle"))
    cycles = cut(_cycles(ways, loops))
    of = cut(every.join(cycles, "node", "left").select("node", F.coalesce("cycle", "node").alias("unit"), F.col("cycle").isNotNull().alias("in_cycle")))
    a, b = of.select(F.col("node").alias("src"), F.col("unit").alias("u")), of.select(F.col("node").alias("dst"), F.col("unit").alias("v"))
    flat = cut(plain.join(a, "src").join(b, "dst").select(F.col("u").alias("src"), F.col("v").alias("dst")).filter("src <> dst").distinct())
    depth = _depths(of.select(F.col("unit").alias("node")).distinct(), shortcuts(flat))
    return of.join(depth.withColumnRenamed("node", "unit"), "unit").select("node", (F.col("depth") + 1).alias("wave"), "in_cycle")


def short(fqn: Column, keep: str | None = None) -> Column:
    """A pipeline's steps under the pipeline's own name, but for the pipeline ``keep``."""
    parts = F.split(fqn, r"\.")
    collapsed = F.when((F.element_at(parts, 1) == "PIPELINE") & (F.size(parts) > 2), F.concat_ws(".", F.slice(parts, 1, 2))).otherwise(fqn)
    return collapsed if keep is None else F.when(F.element_at(parts, 2) == keep, fqn).otherwise(collapsed)


#: How telling an edge's label is when edges fall together.
PRIORITY = {"aggregate": 100, "join": 90, "transform": 80, "VIEW": 70, "fk": 60, "extract": 30, "load": 20, "pipeline": 10}


def priority(operation: Column) -> Column:
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(operation == name, p).otherwise(out)
    return out


def collapsed(lineage: DataFrame, keep: str | None = None) -> DataFrame:
    """src, dst, operation: one edge for each pair after steps fall together, labelled by its most telling operation."""
    e = lineage.select(short(F.col("source_fqn"), keep).alias("src"), short(F.col("target_fqn"), keep).alias("dst"), "operation").filter("src <> dst")
    return e.groupBy("src", "dst").agg(F.min(F.struct((-priority(F.col("operation"))).alias("p"), "operation"))["operation"].alias("operation"))


#: Statements that change a table in place and derive nothing.
IN_PLACE = ("update", "delete", "truncate", "merge")


def focus(lineage: DataFrame, pipeline: str, internals: bool = False) -> DataFrame:
    """Edges among the ancestors and descendants of a pipeline; both walks start from the pipeline alone."""
    keep = pipeline if internals else None
    name = f"PIPELINE.{pipeline}"
    e = lineage.select(short(F.col("source_fqn"), keep).alias("src"), short(F.col("target_fqn"), keep).alias("dst"), "operation").filter("src <> dst")
    deriving = e.filter(~F.col("operation").isin(*IN_PLACE)).select("src", "dst").distinct()
    own = nodes_of(e.select("src", "dst")).filter((F.col("node") == name) | F.col("node").startswith(name + "."))
    around = cut(reached(deriving, own).unionByName(reached(deriving, own, reverse=True)).distinct())
    best = collapsed(lineage, keep)
    return best.join(around.withColumnRenamed("node", "src"), "src", "left_semi").join(around.withColumnRenamed("node", "dst"), "dst", "left_semi")


def exclusive(edges: DataFrame, outputs: DataFrame, least: int = 2) -> DataFrame:
    """``output`` and ``node``: nodes that lead to exactly one output, the output too, in groups of ``least`` or more.

    A node keeps the least and the greatest output that it leads to, never the
    set of them: it leads to one only if they are the same.
    """
    ends = outputs.select("node").distinct().withColumn("low", F.col("node")).withColumn("high", F.col("node"))
    every = nodes_of(edges).unionByName(outputs.select("node")).distinct().join(ends, "node", "left")
    one = spread(shortcuts(edges).steps(reverse=True), every, {"low": "least", "high": "greatest"}).filter("low = high").select(F.col("low").alias("output"), "node")
    big = one.groupBy("output").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    return one.join(big.select("output"), "output").select("output", "node")


def reach_outputs(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``node`` and ``reaches``: whether a source leads to any target. One backward closure serves all sources."""
    back = reached(edges, targets, reverse=True).withColumn("_hit", F.lit(True))
    return sources.select("node").distinct().join(back, "node", "left").select("node", F.coalesce("_hit", F.lit(False)).alias("reaches"))


#: Sensitivity classes from least to most severe.
SEVERITY = ("PUBLIC", "INTERNAL", "FINANCIAL", "TAX", "PII")


def severity(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), F.upper(name)).cast("int") - 1


def resolved(keys: DataFrame, columns: DataFrame, key: str = "key") -> DataFrame:
    """``key`` with the ``column_key`` that equals it, else the smallest one that ends in it after a dot."""
    exact = keys.join(columns.select("column_key"), F.lower(keys[key]) == F.lower("column_key"), "left").groupBy(key).agg(F.min("column_key").alias("exact"))
    tails = columns.select("column_key", F.split(F.lower("column_key"), r"\.").alias("_p")).select("column_key", F.explode(F.expr("transform(sequence(2, size(_p)), i -> array_join(slice(_p, i, size(_p)), '.'))")).alias("tail"))
    suffix = keys.join(tails, F.lower(keys[key]) == F.col("tail")).groupBy(key).agg(F.min("column_key").alias("suffix"))
    return exact.join(suffix, key, "left").select(key, F.coalesce("exact", "suffix").alias("column_key"))


def propagated(columns: DataFrame, edges: DataFrame, least: str = "FINANCIAL") -> DataFrame:
    """``node`` and ``sensitivity`` of columns after explicit classes of ``least`` or more flow along edges; a class only ever rises.

    ``columns`` has node and explicit_sensitivity. A node holds the greatest
    class that has come to it, whatever the number of columns it came from; who
    they are is what :func:`origins` says.
    """
    own = columns.select("node", F.coalesce(severity(F.col("explicit_sensitivity")), F.lit(0)).alias("s"))
    sent = F.when(F.col("s") >= SEVERITY.index(least), F.col("s"))
    every = own.select("node", sent.alias("came")).unionByName(nodes_of(edges).join(own, "node", "left_anti").withColumn("came", F.lit(None).cast("int")))
    came = spread(shortcuts(edges).steps(), every.groupBy("node").agg(F.max("came").alias("came")), {"came": "greatest"})
    names = F.array(*map(F.lit, SEVERITY))
    return own.join(came, "node").select("node", F.element_at(names, F.greatest("s", "came") + 1).alias("sensitivity"))


def origins(columns: DataFrame, edges: DataFrame, least: str = "FINANCIAL") -> DataFrame:
    """``node`` and ``origins``: the explicit columns of ``least`` or more, more severe than the node's own class, that lead to it.

    These are pairs of columns, as many as there are; columns without origins
    have an empty list.
    """
    own = columns.select("node", F.coalesce(severity(F.col("explicit_sensitivity")), F.lit(0)).alias("s"))
    seeds = own.filter(F.col("s") >= SEVERITY.index(least))
    came = closure(edges, seeds.select("node")).join(seeds.select(F.col("node").alias("src"), F.col("s").alias("from_s")), "src").filter("src <> dst")
    return own.join(came, (own["node"] == came["dst"]) & (came["from_s"] > own["s"]), "left").groupBy("node").agg(F.sort_array(F.collect_set("src")).alias("origins"))


def pii_reach(result: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts of columns PII by themselves, PII by inheritance, and sensitive at all."""
    both = result.join(columns.select("node", "explicit_sensitivity"), "node")
    pii = F.upper("explicit_sensitivity") == "PII"
    return both.agg(F.count_if(F.coalesce(pii, F.lit(False))).alias("explicit_pii"), F.count_if((F.col("sensitivity") == "PII") & ~F.coalesce(pii, F.lit(False))).alias("inherited_pii"), F.count_if(F.col("sensitivity").isin("FINANCIAL", "TAX", "PII")).alias("sensitive"))


def overridden(columns: DataFrame, node: str, sensitivity: str) -> DataFrame:
    """``columns`` with one explicit class replaced; propagate again afterwards."""
    return columns.withColumn("explicit_sensitivity", F.when(F.col("node") == node, F.lit(sensitivity)).otherwise(F.col("explicit_sensitivity")))


def partners(lineage: DataFrame) -> DataFrame:
    """node, column, is_key, operations and partners of each column on either end; join keys first in each node."""
    ends = lineage.select(F.explode(F.array(
        F.struct(F.col("source_fqn").alias("node"), F.col("source_column").alias("column"), F.col("target_fqn").alias("partner"), F.col("operation")),
        F.struct(F.col("target_fqn").alias("node"), F.col("target_column").alias("column"), F.col("source_fqn").alias("partner"), F.col("operation")),
    )).alias("e")).select("e.*")
    key = F.max(F.col("operation").isin("join", "fk")).alias("is_key")
    return ends.groupBy("node", "column").agg(key, F.sort_array(F.collect_set("operation")).alias("operations"), F.sort_array(F.collect_set("partner")).alias("partners"))


def fqn(name: Column, kind: Column, pipeline: Column | None = None) -> Column:
    """Namespaced names: outputs and external files by their stem, pipeline steps, else sources; dotted names stay."""
    stem = F.upper(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?i)\.csv$", ""))
    out = F.when(kind == "output", F.concat(F.lit("OUTPUTS."), stem)).when(kind == "external", F.concat(F.lit("EXTERNAL."), stem))
    if pipeline is not None:
        out = out.when(kind == "step", F.concat(F.lit("PIPELINE."), pipeline, F.lit("."), name))
    return out.when(name.contains("."), F.upper(name)).otherwise(F.concat(F.lit("SOURCE."), F.upper(name)))


def fk_edges(columns: DataFrame) -> DataFrame:
    """Edges from foreign-key columns to the ``[SCHEMA.]TABLE.COLUMN`` that they name."""
    parts = F.split("fk_target", r"\.")
    target = F.concat_ws(".", F.slice(parts, F.lit(1), F.size(parts) - 1))
    rows = columns.filter(F.col("is_fk") & (F.size(parts) >= 2))
    return rows.select(F.col("table_fqn").alias("source_fqn"), F.col("name").alias("source_column"), target.alias("target_fqn"), F.element_at(parts, -1).alias("target_column"), F.lit("fk").alias("operation"), F.lit(1.0).alias("confidence"))


def export(lineage: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges with the layer and sensitivity of both ends; a path is personal when either end is."""
    out = lineage
    for side in ("source", "target"):
        c = columns.select(F.col("table_fqn").alias(f"{side}_fqn"), F.col("name").alias(f"{side}_column"), F.col("sensitivity").alias(f"{side}_sensitivity"))
        t = tables.select(F.col("fqn").alias(f"{side}_fqn"), F.col("layer").alias(f"{side}_layer"))
        out = out.join(c, [f"{side}_fqn", f"{side}_column"], "left").join(t, f"{side}_fqn", "left")
    return out.withColumn("is_pii_path", F.coalesce(F.col("source_sensitivity") == "PII", F.lit(False)) | F.coalesce(F.col("target_sensitivity") == "PII", F.lit(False)))


def table_level(lineage: DataFrame) -> DataFrame:
    """Distinct table to table edges, by way of the pipeline steps between them.

    Only steps are walked through, from the tables that they read; nothing is
    closed over tables.
    """
    e = cut(lineage.select(F.col("source_fqn").alias("src"), F.col("target_fqn").alias("dst")).distinct())
    step = F.col("dst").startswith("PIPELINE.")
    hop = e.filter(F.col("src").startswith("PIPELINE.")).select(F.col("src").alias("mid"), F.col("dst").alias("next"))
    new = cut(e.filter(~F.col("src").startswith("PIPELINE.")))
    found = new
    while True:
        reached_ = new.filter(step).join(hop, F.col("dst") == F.col("mid")).select("src", F.col("next").alias("dst")).distinct()
        new = cut(reached_.join(found, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return found.filter(~step)
        found = cut(found.unionByName(new))


def seeds(spark, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def delivery_nodes(nodes: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Edges from outputs to where their file is delivered."""
    stem = F.lower(F.regexp_replace("csv_name", r"(?i)\.csv$", ""))
    d = deliveries.select(stem.alias("_stem"), F.concat(F.when(F.col("kind") == "external", F.lit("DELIVERY_EXT.")).otherwise(F.lit("DELIVERY_INT.")), "csv_name").alias("dst"))
    out = nodes.filter(F.col("node").startswith("OUTPUTS.")).select(F.col("node").alias("src"), F.lower(F.substring_index("node", "OUTPUTS.", -1)).alias("_stem"))
    return out.join(d, "_stem").select("src", "dst")


def as_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
