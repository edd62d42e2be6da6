import random

import pytest

from weftline.operators import graph


def naive_closure(edges):
    out = set()
    step = {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for start in step:
        todo, seen = list(step[start]), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += step.get(n, ())
        out |= {(start, n) for n in seen}
    return out


def frame(spark, edges):
    return spark.createDataFrame(list(edges) or [], "src string, dst string")


CASES = [set(), {("a", "a")}, {("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")}, {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "d")}]
_r = random.Random(5)
CASES += [{(f"n{_r.randrange(12)}", f"n{_r.randrange(12)}") for _ in range(n)} for n in (10,)]


@pytest.mark.parametrize("edges", CASES, ids=range(len(CASES)))
def test_closure_and_cycles(spark, edges):
    df, want = frame(spark, edges), naive_closure(edges)
    assert {tuple(r) for r in graph.closure(df).collect()} == want
    loops = {r.node: r.cycle for r in graph.cycle_nodes(df).collect()}
    assert loops == {a: min(b for x, b in want if x == a and (b, a) in want) for a, y in want if a == y}
    seeds = graph.seeds(spark, ["a", "n1"])
    assert {r.node for r in graph.reached(df, seeds).collect()} == {"a", "n1"} | {b for a, b in want if a in ("a", "n1")}
    assert {tuple(r) for r in graph.closure(df, seeds, reverse=True).collect()} == {(a, b) for a, b in want if b in ("a", "n1")}


@pytest.mark.parametrize("edges", CASES, ids=range(len(CASES)))
def test_waves_condense_cycles(spark, edges):
    want = naive_closure(edges)
    nodes = {n for e in edges for n in e}
    unit = {n: min([b for a, b in want if a == n and (b, n) in want] or [n]) for n in nodes}
    flat = {(unit[a], unit[b]) for a, b in edges if unit[a] != unit[b]}

    def depth(u):
        return 1 + max([depth(a) for a, b in flat if b == u], default=0)

    got = {r.node: (r.wave, r.in_cycle) for r in graph.waves(frame(spark, edges)).collect()}
    assert got == {n: (depth(unit[n]), (n, n) in want) for n in nodes}


def test_propagation_has_explicit_origins_only(spark):
    columns = spark.createDataFrame([("a", "PII"), ("b", None), ("c", "FINANCIAL"), ("d", "public"), ("e", "TAX")], "node string, explicit_sensitivity string")
    edges = frame(spark, {("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e")})
    got = {r.node: (r.sensitivity, r.origins) for r in graph.propagated(columns, edges).join(graph.origins(columns, edges), "node").collect()}
    assert got == {"a": ("PII", []), "b": ("PII", ["a"]), "c": ("PII", ["a"]), "d": ("PII", ["a", "c"]), "e": ("TAX", [])}
    out = graph.propagated(columns, edges)
    assert tuple(graph.pii_reach(out, columns).first()) == (1, 3, 5)
    less = graph.propagated(graph.overridden(columns, "a", "PUBLIC"), edges)
    assert {r.node: r.sensitivity for r in less.collect()}["b"] == "PUBLIC"


def test_keys_resolve_exactly_or_by_suffix(spark):
    keys = spark.createDataFrame([("DW.T.C",), ("t.c",), ("x",)], "key string")
    columns = spark.createDataFrame([("DW.T.C",), ("OLD.T.C",), ("DW.T.D",)], "column_key string")
    assert {tuple(r) for r in graph.resolved(keys, columns).collect()} == {("DW.T.C", "DW.T.C"), ("t.c", "DW.T.C"), ("x", None)}


def test_export_and_deliveries(spark):
    lineage = spark.createDataFrame([("S.A", "x", "O.B", "y")], "source_fqn string, source_column string, target_fqn string, target_column string")
    columns = spark.createDataFrame([("O.B", "y", "PII")], "table_fqn string, name string, sensitivity string")
    tables = spark.createDataFrame([("S.A", "RAW")], "fqn string, layer string")
    r = graph.export(lineage, columns, tables).first()
    assert (r.source_layer, r.target_sensitivity, r.is_pii_path) == ("RAW", "PII", True)
    nodes = spark.createDataFrame([("OUTPUTS.FEES",), ("SOURCE.X",)], "node string")
    deliveries = spark.createDataFrame([("fees.csv", "external")], "csv_name string, kind string")
    assert [tuple(r) for r in graph.delivery_nodes(nodes, deliveries).collect()] == [("OUTPUTS.FEES", "DELIVERY_EXT.fees.csv")]
    fk = spark.createDataFrame([("DW.F", "c_id", True, "DW.C.ID"), ("DW.F", "z", False, None)], "table_fqn string, name string, is_fk boolean, fk_target string")
    assert [(r.source_fqn, r.target_fqn, r.target_column) for r in graph.fk_edges(fk).collect()] == [("DW.F", "DW.C", "ID")]


def test_cycles_of_a_random_graph(spark):
    import random

    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)}
    after = {a: {a} for a, _ in edges} | {b: {b} for _, b in edges}
    for _ in range(60):
        for a, b in edges:
            after[a] |= after[b]
    want = {n: min(m for m in after[n] if n in after[m]) for n in after if (n, n) in edges or any(m != n and n in after[m] for m in after[n])}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {r.node: r.cycle for r in graph.cycle_nodes(df).collect()} == want
    got = {(r.src, r.dst) for r in graph.closure(df.filter("src < 15")).collect()}
    small = {(a, b) for a, b in edges if a < 15}
    pairs = set(small)
    while more := {(a, d) for a, b in pairs for c, d in small if b == c} - pairs:
        pairs |= more
    assert got == pairs


def counted(monkeypatch):
    """Counts the rounds: every one cuts its lineage once or a few times."""
    calls, cut = [], graph.cut

    def one(df):
        calls.append(1)
        return cut(df)

    monkeypatch.setattr(graph, "cut", one)
    return calls


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    calls, used = counted(monkeypatch), {}
    for n in (60, 1000):
        chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
        calls.clear()
        assert {r.node: r.wave for r in graph.waves(chain).collect()} == {i: i + 1 for i in range(n + 1)}
        used["waves", n] = len(calls)
        calls.clear()
        assert graph.reached(chain, spark.range(7, 8).selectExpr("id AS node")).count() == n - 6
        used["reached", n] = len(calls)
    ring = spark.range(1000).selectExpr("id AS src", "(id + 1) % 1000 AS dst").unionByName(spark.createDataFrame([(5, 2000)], "src long, dst long"))
    calls.clear()
    assert {(r.node, r.cycle) for r in graph.cycle_nodes(ring).collect()} == {(i, 0) for i in range(1000)}
    assert len(calls) <= 60
    assert used["waves", 1000] <= used["waves", 60] + 12 and used["reached", 1000] <= used["reached", 60] + 12, used


def test_rows_stay_in_proportion_to_the_edges(spark, monkeypatch):
    """A dense graph of layers: pairs of nodes would be 30 times the edges."""
    layers, width = 12, 12
    edges = {(f"{a:02}-{i}", f"{a + 1:02}-{j}") for a in range(layers) for i in range(width) for j in range(width)}
    df = frame(spark, edges)
    levels = graph.shortcuts(df).levels
    assert sum(x.count() for x in levels) <= (1 + graph.DENSE) * len(levels) * len(edges)
    wide = spark.range(800).selectExpr("concat('a', id) AS src", "concat('b', id % 40) AS dst").unionByName(spark.range(3200).selectExpr("concat('b', id % 40) AS src", "concat('c', id) AS dst"))
    assert len(graph.shortcuts(wide).levels) == 1  # 64,000 pairs from 4,000 edges: not made
    assert {r.wave for r in graph.waves(df).collect()} == set(range(1, layers + 2))
    columns = graph.nodes_of(df).selectExpr("node", "if(node LIKE '00-%', 'PII', if(node = '05-3', 'TAX', null)) AS explicit_sensitivity")
    got = {r.node: r.sensitivity for r in graph.propagated(columns, df).collect()}
    assert set(got.values()) == {"PII"} and len(got) == (layers + 1) * width


def test_exclusive_keeps_two_outputs_at_most(spark):
    edges = {("a", "x"), ("a", "b"), ("b", "x"), ("c", "y"), ("c", "x"), ("d", "c"), ("e", "y"), ("z", "q")}
    outputs = graph.seeds(spark, ["x", "y", "z"])
    got = {(r.output, r.node) for r in graph.exclusive(frame(spark, edges), outputs).collect()}
    assert got == {("x", "a"), ("x", "b"), ("x", "x"), ("y", "e"), ("y", "y")}


def test_chains_of_cycles(spark):
    edges = set()
    for i in range(5):
        edges |= {(2 * i, 2 * i + 1), (2 * i + 1, 2 * i), (2 * i + 1, 2 * i + 2)}
    deep = {r.node: (r.wave, r.in_cycle) for r in graph.waves(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert deep == {n: (n // 2 + 1, n < 10) for n in range(11)}
