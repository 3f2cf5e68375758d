from pyspark.sql import functions as F

from graphlode.model import EDGES, NODES
from graphlode.operators import graph as G
from graphlode.operators import mutate as M


def make(spark, pairs, names=None, label="Function"):
    keys = sorted({k for p in pairs for k in p} | set(names or {}))
    nodes = [("p", label, k, i, k, (names or {}).get(k, k.split(":")[-1]), None, k.split(":")[0], k.split(":")[-1]) + (None,) * 18 for i, k in enumerate(keys)]
    edges = [("p", "CALLS", label, a, label, b, 1.0, None, None, None, None) for a, b in pairs]
    return G.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def q(*names):
    return [f"f.ts:{n}" for n in names]


def line(*names):
    keys = q(*names)
    return list(zip(keys, keys[1:]))


def test_one_process_of_a_line(spark):
    r = G.processes(make(spark, line("a", "b", "c", "d"))).collect()
    assert len(r) == 1 and r[0]["entry"] == "f.ts:a" and r[0]["terminal"] == "f.ts:d" and r[0]["name"] == "a_to_d" and r[0]["steps"] == 4


def test_short_flows_are_no_process(spark):
    assert G.processes(make(spark, line("a", "b")), least=3).count() == 0


def test_named_entry_points_begin_processes(spark):
    r = G.processes(make(spark, line("caller", "handleClick", "s1", "s2"))).collect()
    assert len(r) >= 2 and any(x["name"].startswith("handleClick_to_") for x in r)


def test_cycles_end(spark):
    assert G.processes(make(spark, [*line("a", "b", "c"), *line("c", "b")])).count() >= 1


def test_empty_graph(spark):
    g = G.Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert G.processes(g).count() == 0 and G.hubs(g).count() == 0 and G.cycles(g).count() == 0 and G.reach(g.rel("CALLS"), 3).count() == 0
    assert G.label_propagation(g.rel("CALLS")).count() == 0


def test_fan_out_is_capped_before_the_visited_filter(spark):
    pairs = [("f.ts:a", f"f.ts:b{i}") for i in range(6)] + [(f"f.ts:b{i}", "f.ts:z") for i in range(6)]
    r = G.processes(make(spark, pairs)).collect()
    assert {x["trace"][1] for x in r if x["entry"] == "f.ts:a"} == {f"f.ts:b{i}" for i in range(4)}


def test_reach_and_paths(spark):
    g = make(spark, [*line("a", "b", "c", "a"), *line("c", "d")])
    e = g.rel("CALLS")
    assert {(r["src"][-1], r["dst"][-1], r["depth"]) for r in G.reach(e, 3).collect() if r["src"] == "f.ts:a"} == {("a", "b", 1), ("a", "c", 2), ("a", "a", 3), ("a", "d", 3)}
    # no edge twice: a>b>c>a>b is no path
    assert max(r["depth"] for r in G.paths(e, 9).collect()) == 4
    assert {tuple(x[-1] for x in r["chain"]) for r in G.cycles(g).collect()} == {("a", "b", "c", "a"), ("b", "c", "a", "b"), ("c", "a", "b", "c")}


def test_report_callers_and_callees(spark):
    g = make(spark, line("a", "b", "c"))
    r = {(x["direction"], x["name"]) for x in G.dependency_report(g, "b").collect()}
    assert r == {("caller", "a"), ("callee", "c")}
    assert G.dependency_report(g, "nothing").count() == 0
    assert [x["chain"] for x in G.call_chains(g, "f.ts:a").collect()][0] == q("a", "b", "c")
    assert [x["chain"] for x in G.call_chains(g, "f.ts:c", inward=True).collect()][0] == q("a", "b", "c")


def test_orphans_have_their_module(spark):
    g = make(spark, line("a", "b"), {"f.ts:lone": "lone"})
    assert [(r["name"], r["module"]) for r in G.orphans(g).collect()] == [("lone", None)]


def test_path_prefix_label(spark):
    cases = [([], "unknown"), (["src/a/x.ts"], "src/a"), (["x.ts"], "x.ts"), (["src/a/x.ts", "src/a/y.ts"], "src/a"), (["src/a/x.ts", "src/b/y.ts"], "src"), (["a/x.ts", "b/y.ts"], "mixed"), (["a/b/x.ts", "a/b/x.ts"], "a/b")]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p array<string>")
    got = {r["i"]: r["l"] for r in df.select("i", G.path_prefix_label(F.array_min("p"), F.array_max("p")).alias("l")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_label_propagation_splits_two_cliques(spark):
    a, b = q("a1", "a2", "a3", "a4"), q("b1", "b2", "b3", "b4")
    pairs = [(x, y) for s in (a, b) for x in s for y in s if x < y] + [(a[0], b[0])]
    label = {r["key"]: r["label"] for r in G.label_propagation(make(spark, pairs).rel("CALLS")).collect()}
    assert len({label[x] for x in a}) == 1 and len({label[x] for x in b}) == 1


def test_last_wins(spark):
    n = spark.createDataFrame([("a", "old", 1), ("b", "bee", 2), ("a", "new", 3)], "id string, v string, seq int")
    assert {(r["id"], r["v"]) for r in M.last_wins(n, ["id"], ["seq"]).collect()} == {("a", "new"), ("b", "bee")}


def test_upsert_keeps_what_is_not_set(spark):
    old = spark.createDataFrame([("k", 1, "x"), ("l", 2, "y")], "id string, n int, t string")
    new = spark.createDataFrame([("k", None, "z"), ("m", 3, None)], "id string, n int, t string")
    assert {tuple(r) for r in M.upsert(old, new, ("id",)).collect()} == {("k", 1, "z"), ("l", 2, "y"), ("m", 3, None)}
    batch = spark.createDataFrame([("k", None, "z", ["n", "t"])], "id string, n int, t string, s array<string>")
    assert ("k", None, "z") in {tuple(r) for r in M.upsert(old, batch, ("id",), "s").collect()}


def test_edges_need_both_ends_and_delete_detaches(spark):
    g = make(spark, line("a", "b"))
    extra = g.edges.limit(1).withColumn("dst_key", F.lit("f.ts:missing"))
    assert M.upsert_edges(g.edges, extra, g.nodes).count() == 1
    assert M.append_edges(g.edges, g.edges, g.nodes).count() == 2
    nodes, edges = M.detach_delete(g.nodes, g.edges, g.nodes.where("key = 'f.ts:a'"))
    assert nodes.count() == 1 and edges.count() == 0


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, h string")
    assert {tuple(r) for r in M.changes(old, new, ["path"], "h").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")}


def test_token_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([4, 400, 4])], "i int, t string")
    assert [r["i"] for r in M.token_budget(df, ["i"], F.col("t"), 50).collect()] == [0]
