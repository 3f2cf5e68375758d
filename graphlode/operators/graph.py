"""Pattern primitives, traversals and analytics over node and edge tables.

A graph is two DataFrames. Names in a pattern are (project, key); every primitive returns a DataFrame, so
Catalyst sees one plan, pushes label and relation filters into the scans and picks the joins. Loops exist only
where the number of hops is not known; they cut their lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from graphlode.functions import names
from graphlode.model import CALLABLE, NODE_KEY, STRUCTURE
from graphlode.plans.session import cut, stage, table


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Graph:
        return Graph(table(spark, folder, "nodes"), table(spark, folder, "edges"))

    def scoped(self, project: str | None) -> Graph:
        """Every read of the result is of one project: a filter on both sources, wherever they are used."""
        if project is None:
            return self
        return Graph(self.nodes.where(F.col("project") == project), self.edges.where(F.col("project") == project))

    # -- scans ---------------------------------------------------------------------------------------------
    def scan(self, *labels: str, **equals) -> DataFrame:
        """Nodes with one of the labels (all, without any) whose properties equal the given ones."""
        out = self.nodes
        if labels:
            out = out.where(F.col("label").isin(*labels))
        for name, value in equals.items():
            out = out.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
        return out

    def find(self, label: str, key: str) -> DataFrame:
        return self.scan(label, key=key).orderBy(*NODE_KEY).limit(1)

    def rel(self, *types: str, distinct: bool = True) -> DataFrame:
        """(project, src, dst) of the relations, parallel edges once unless asked otherwise."""
        out = self.edges.where(F.col("rel_type").isin(*types)) if types else self.edges
        out = out.select("project", F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))
        return out.distinct() if distinct else out

    # -- patterns ------------------------------------------------------------------------------------------
    def named(self, *columns: str, labels: tuple[str, ...] = ()) -> DataFrame:
        """(project, key, *columns), one row a key: repeated rows of a node are one.

        A module and its file have the same key; without labels the row of the code node holds, since calls and definitions lead to these.
        """
        chosen = [c for c in columns if c not in ("project", "key")]
        order = F.struct(F.col("label").isin(*STRUCTURE), "label", *[c for c in chosen if c != "label"])
        value = F.struct(*chosen) if chosen else F.struct("label")
        return self.scan(*labels).groupBy("project", "key").agg(F.min_by(value, order).alias("_n")).select("project", "key", *[F.col(f"_n.{c}").alias(c) for c in chosen])

    def expand(self, *types: str, source: tuple[str, ...] = (), target: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
        """(project, src, src_label, src_name, dst, dst_label, dst_name): one hop; how='left' keeps sources without one."""
        own = lambda labels, end: self.scan(*labels).groupBy("project", F.col("key").alias(end), F.col("label").alias(f"{end}_label")).agg(F.min("name").alias(f"{end}_name"))
        e = self.edges.where(F.col("rel_type").isin(*types)) if types else self.edges
        hop = e.select("project", F.col("src_key").alias("src"), "src_label", F.col("dst_key").alias("dst"), "dst_label").distinct()
        hop = hop.join(own(target, "dst"), ["project", "dst", "dst_label"])
        out = own(source, "src").join(hop, ["project", "src", "src_label"], how)
        return out.select("project", "src", "src_label", "src_name", "dst", "dst_label", "dst_name")

    def without(self, *types: str, labels: tuple[str, ...] = CALLABLE) -> DataFrame:
        """Nodes of the labels that no relation of the types leaves or reaches."""
        e = self.rel(*types)
        n = self.named("label", "name", "file_path", labels=labels)
        n = n.join(e.select("project", F.col("src").alias("key")), ["project", "key"], "left_anti")
        return n.join(e.select("project", F.col("dst").alias("key")), ["project", "key"], "left_anti")


def match_symbol(symbol: str | Column, typed: bool = False) -> Column:
    """A node is meant by a name: its qualified name, name or local name, or the qualified name ends with :name or .name."""
    s = F.lit(symbol) if isinstance(symbol, str) else symbol
    named = F.col("name") == s
    if typed:
        named = named & F.col("label").isin("Function", "Method", "Class", "Interface")
    qn = F.col("qualified_name")
    return (qn == s) | named | (F.col("local_name") == s) | qn.endswith(F.concat(F.lit(":"), s)) | qn.endswith(F.concat(F.lit("."), s))


def optional_contains(column: Column, pattern: str | None) -> Column:
    """The filter of an optional parameter: everything passes without one."""
    return F.lit(True) if pattern is None else column.contains(pattern)


# -- traversals ------------------------------------------------------------------------------------------------
def reach(edges: DataFrame, depth: int, starts: DataFrame | None = None) -> DataFrame:
    """(project, src, dst, depth): all ends reachable in 1..depth hops with their least number of hops.

    Semi-naive: only pairs found in the last round are extended, and known pairs drop out, so the work follows
    the number of reachable pairs, not the number of paths.
    """
    hop = edges.select("project", F.col("src").alias("_from"), F.col("dst").alias("_to"))
    first = edges.select("project", "src", "dst").distinct()
    if starts is not None:
        first = first.join(starts.select("project", "src").distinct(), ["project", "src"], "left_semi")
    front = first.withColumn("depth", F.lit(1))
    known = front
    for d in range(2, depth + 1):
        step = front.select("project", "src", F.col("dst").alias("_from")).join(hop, ["project", "_from"]).select("project", "src", F.col("_to").alias("dst")).distinct()
        front = cut(step.join(known.select("project", "src", "dst"), ["project", "src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        known = known.unionByName(front)
    return known


def closure(edges: DataFrame, starts: DataFrame, include_start: bool = False) -> DataFrame:
    """(project, src, dst): all nodes below the starts, to the fix-point; cycles end by themselves."""
    hop = cut(edges.select("project", F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct())
    front = cut(starts.select("project", "src").distinct().withColumn("dst", F.col("src")))
    known = front
    while not front.isEmpty():
        step = front.select("project", "src", F.col("dst").alias("_from")).join(hop, ["project", "_from"]).select("project", "src", F.col("_to").alias("dst")).distinct()
        front = cut(step.join(known, ["project", "src", "dst"], "left_anti"))
        known = known.unionByName(front)
    return known if include_start else known.where("src <> dst")


def paths(edges: DataFrame, depth: int | None, starts: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(project, src, dst, chain, depth): all paths of up to ``depth`` hops that use no edge twice; chain has their nodes.

    Without a depth paths grow until none goes on, which the number of edges bounds.
    """
    hop = edges.select("project", F.col("src").alias("_from"), F.col("dst").alias("_to")).distinct()
    first = edges.select("project", "src", "dst").distinct()
    if starts is not None:
        first = first.join(starts.select("project", "src").distinct(), ["project", "src"], "left_semi")
    used = lambda a, b: F.concat(a, F.lit("\x01"), b)
    front = first.select("project", "src", "dst", F.array("src", "dst").alias("chain"), F.array(used(F.col("src"), F.col("dst"))).alias("_used"))
    out = front.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1) if depth is not None else count(2):
        edge = used(F.col("_from"), F.col("_to"))
        front = (
            front.withColumnRenamed("dst", "_from").join(hop, ["project", "_from"]).where(~F.array_contains("_used", edge))
            .select("project", "src", F.col("_to").alias("dst"), F.concat("chain", F.array("_to")).alias("chain"), F.concat("_used", F.array(edge)).alias("_used"))
        )
        front = cut(front)
        if depth is None and front.isEmpty():
            break
        out = out.unionByName(front.withColumn("depth", F.lit(d)))
    return out.where(F.col("depth") >= least).drop("_used")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))


def counts(g: Graph) -> DataFrame:
    """(nodes, edges): the rows of both tables, in one aggregation."""
    both = g.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).union(g.edges.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


# -- analytics -------------------------------------------------------------------------------------------------
def callers(g: Graph, symbol: str, depth: int = 1, limit: int = 50) -> DataFrame:
    """(project, qualified_name, name, label, confidence, depth): who calls the symbol, by qualified name."""
    return _neighbours(g, symbol, depth, limit, inward=True)


def callees(g: Graph, symbol: str, depth: int = 1, limit: int = 50) -> DataFrame:
    return _neighbours(g, symbol, depth, limit, inward=False)


def _neighbours(g: Graph, symbol: str, depth: int, limit: int, inward: bool) -> DataFrame:
    depth = max(1, min(5, depth))
    target = g.nodes.where(match_symbol(symbol)).select("project", F.col("key").alias("src")).distinct()
    calls = g.rel("CALLS")
    found = reach(reverse(calls) if inward else calls, depth, target)
    if depth == 1:
        best = g.edges.where("rel_type = 'CALLS'").groupBy("project", "src_key", "dst_key").agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
        a, b = ("dst_key", "src_key") if inward else ("src_key", "dst_key")
        found = found.join(best.select("project", F.col(a).alias("src"), F.col(b).alias("dst"), "confidence"), ["project", "src", "dst"])
    else:
        found = found.withColumn("confidence", F.lit(1.0))
    n = g.named("qualified_name", "name", "label").withColumnRenamed("key", "dst")
    out = found.join(n, ["project", "dst"]).groupBy("project", "qualified_name", "name", "label").agg(F.max("confidence").alias("confidence"), F.min("depth").alias("depth"))
    return out.orderBy("qualified_name", "project").limit(limit)


def dependency_report(g: Graph, symbol: str, depth: int = 1, limit: int = 50) -> DataFrame:
    """Callers and callees of the first node that the name means, with a column direction; no rows if there is none."""
    first = g.nodes.where(match_symbol(symbol, typed=True)).orderBy("qualified_name", "project").limit(1)
    row = first.select("project", "qualified_name").first()
    if row is None:
        return callers(g, symbol, 1, 0).withColumn("direction", F.lit("caller"))
    own = g.scoped(row["project"])
    return callers(own, row["qualified_name"], depth, limit).withColumn("direction", F.lit("caller")).unionByName(callees(own, row["qualified_name"], depth, limit).withColumn("direction", F.lit("callee")))


def call_chains(g: Graph, symbol: str, depth: int = 5, limit: int = 50, inward: bool = False) -> DataFrame:
    """(project, chain, depth): paths from (or, inward, to) the exact qualified name, longest first."""
    start = g.scan(qualified_name=symbol).select("project", F.col("key").alias("src")).distinct()
    calls = g.rel("CALLS")
    out = paths(reverse(calls) if inward else calls, depth, start)
    chain = F.reverse("chain") if inward else F.col("chain")
    return out.select("project", chain.alias("chain"), "depth").orderBy(F.desc("depth"), "project", "chain").limit(limit)


def dependency_stats(g: Graph) -> DataFrame:
    """(project, key, name, outgoing, incoming) of symbols that both call and are called."""
    e = g.rel("CALLS")
    out = e.groupBy("project", F.col("src").alias("key")).agg(F.count("*").alias("outgoing"))
    into = e.groupBy("project", F.col("dst").alias("key")).agg(F.count("*").alias("incoming"))
    n = g.named("name", labels=CALLABLE)
    return n.join(out, ["project", "key"]).join(into, ["project", "key"])


def hubs(g: Graph) -> DataFrame:
    """(project, key, name, outgoing, incoming, total): each side is aggregated on its own before the joins."""
    e = g.rel("CALLS")
    out = e.groupBy("project", F.col("src").alias("key")).agg(F.count("*").alias("outgoing"))
    into = e.groupBy("project", F.col("dst").alias("key")).agg(F.count("*").alias("incoming"))
    n = g.named("name", labels=CALLABLE).join(out, ["project", "key"], "left").join(into, ["project", "key"], "left")
    n = n.select("project", "key", "name", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))
    return n.withColumn("total", F.col("outgoing") + F.col("incoming")).where("total > 0")


def incoming_calls(g: Graph) -> DataFrame:
    """(project, key, name, in_calls) of all functions and methods; only callers of the same project count."""
    e = g.edges.where("rel_type = 'CALLS'").groupBy("project", F.col("dst_key").alias("key")).agg(F.count("*").alias("in_calls"))
    n = g.named("name", labels=CALLABLE)
    return n.join(e, ["project", "key"], "left").select("project", "key", "name", F.coalesce("in_calls", F.lit(0)).alias("in_calls"))


def cycles(g: Graph, depth: int = 5) -> DataFrame:
    """(project, chain, depth): circular calls of 2..depth hops; each rotation is its own row."""
    own = g.named("label", labels=CALLABLE).select("project", F.col("key").alias("src"))
    calls = g.rel("CALLS")
    # only calls that some way of depth - 1 hops leads back from: what is enumerated are cycles and little else
    back = reach(calls, depth - 1).select("project", F.col("src").alias("dst"), F.col("dst").alias("src"))
    round_trip = cut(calls.join(back.unionByName(calls.where("src = dst").select("project", "dst", "src")), ["project", "src", "dst"], "left_semi"))
    found = paths(round_trip, depth, own, least=2).where("src = dst")
    return found.select("project", "chain", "depth")


def orphans(g: Graph) -> DataFrame:
    """(project, key, name, module): functions and methods without calls, with the module that defines them if any."""
    lone = g.without("CALLS")
    owner = g.rel("DEFINES", "DEFINES_METHOD")
    module = g.named("label", labels=("Module",)).select("project", F.col("key").alias("src"))
    below = reach(owner, 2, module).select("project", F.col("dst").alias("key"), F.col("src").alias("module"))
    return lone.join(below.groupBy("project", "key").agg(F.min("module").alias("module")), ["project", "key"], "left").select("project", "key", "name", "module")


# -- communities -----------------------------------------------------------------------------------------------
def directory_communities(g: Graph) -> DataFrame:
    """(project, community, key, directory): code nodes by parent directory, numbered by directory within the project."""
    n = g.named("file_path", labels=("Function", "Method", "Class", "Module")).where("file_path is not null")
    n = n.withColumn("directory", names.dirname(F.col("file_path")))
    # directories are few beside nodes: number them and join, instead of ranking all nodes
    numbered = n.select("project", "directory").distinct().withColumn("community", F.row_number().over(Window.partitionBy("project").orderBy("directory")) - 1)
    return n.join(numbered, ["project", "directory"]).select("project", "community", "key", "directory")


def modularity(both: DataFrame, label: DataFrame) -> float:
    """Modularity of a labelling (project, key, label) over the projects together; both has each edge in both directions."""
    of = label.select("project", F.col("key").alias("src"), "label")
    to = label.select("project", F.col("key").alias("dst"), F.col("label").alias("other"))
    ends = both.join(of, ["project", "src"]).join(to, ["project", "dst"])
    parts = ends.groupBy("project", "label").agg(F.count("*").alias("degree"), F.sum((F.col("label") == F.col("other")).cast("int")).alias("inside"))
    whole = parts.groupBy("project").agg(F.sum("degree").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("square"))
    return whole.agg(F.sum(F.col("m") * (F.col("inside") / F.col("m") - F.col("square") / (F.col("m") * F.col("m")))) / F.sum("m")).first()[0] or 0.0


def label_propagation(edges: DataFrame) -> DataFrame:
    """(project, key, label): communities of an undirected graph; each node takes its neighbours' most frequent label.

    Ties go to the least label, and a node's own label counts once, so the result does not depend on partitioning. Rounds go on
    while the modularity of the labelling rises, and the last labelling that raised it is the result: since there are finitely many
    labellings this ends, and labels that swing to and fro end it too. Label counts are combined before the shuffle; a node with many
    neighbours is no hot group.
    """
    e = edges.where("src <> dst").select("project", "src", "dst").distinct()
    both = cut(e.union(e.select("project", F.col("dst"), F.col("src"))).distinct())
    label = cut(both.select("project", F.col("src").alias("key")).distinct().withColumn("label", F.col("key")))
    value = modularity(both, label)
    while True:
        votes = both.join(label.withColumnRenamed("key", "dst"), ["project", "dst"]).select("project", F.col("src").alias("key"), "label").union(label.select("project", "key", "label"))
        counted = votes.groupBy("project", "key", "label").agg(F.count("*").alias("n"))
        step = cut(counted.groupBy("project", "key").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label")))
        risen = modularity(both, step)
        if risen <= value:
            return label
        label, value = step, risen


def path_prefix_label(least: Column, greatest: Column) -> Column:
    """Common leading directories of some paths: none is 'unknown', one its directory (or itself), nothing in common 'mixed'.

    The common prefix of the least and the greatest path is common to all.
    """
    low, high = F.split(least, "/"), F.split(greatest, "/")
    n = F.least(F.size(low), F.size(high))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.get(low, i - 1) == F.get(high, i - 1)), i).otherwise(k))
    common = F.slice(low, 1, same)
    last = F.get(common, same - 1)
    kept = F.when((same > 0) & F.contains(last, F.lit(".")), F.slice(common, 1, F.greatest(same - 1, F.lit(0)))).otherwise(common)
    joined = F.array_join(kept, "/")
    one = F.when(F.contains(least, F.lit("/")), names.dirname(least)).otherwise(least)
    return F.when(least.isNull(), "unknown").when(least == greatest, one).when((same == 0) | (joined == ""), "mixed").otherwise(joined)


def materialise_communities(g: Graph, assigned: DataFrame, least: int = 2) -> DataFrame:
    """(project, id, name, heuristic_label, symbol_count, cohesion) of communities with at least ``least`` members.

    assigned has project, community and key. Cohesion is the number of calls within a community for each member.
    """
    n = g.named("file_path")
    members = assigned.select("project", "community", "key").distinct().join(n, ["project", "key"], "left")
    size = members.groupBy("project", "community").agg(F.count("*").alias("symbol_count"), F.min("file_path").alias("low"), F.max("file_path").alias("high")).where(F.col("symbol_count") >= least)
    a = assigned.select("project", F.col("key").alias("src"), F.col("community").alias("c1"))
    b = assigned.select("project", F.col("key").alias("dst"), F.col("community").alias("c2"))
    within = g.rel("CALLS").join(a, ["project", "src"]).join(b, ["project", "dst"]).where("c1 = c2").groupBy("project", F.col("c1").alias("community")).agg(F.count("*").alias("calls"))
    out = size.join(within, ["project", "community"], "left")
    label = path_prefix_label(F.col("low"), F.col("high"))
    cid = F.col("community").cast("string")
    return out.select(
        "project", F.concat(F.col("project"), F.lit("::community::"), cid).alias("id"), F.concat(label, F.lit(" (#"), cid, F.lit(")")).alias("name"), label.alias("heuristic_label"), "symbol_count",
        F.round(F.coalesce("calls", F.lit(0)) / F.col("symbol_count"), 6).alias("cohesion"),
    )


# -- processes -------------------------------------------------------------------------------------------------
def processes(g: Graph, max_depth: int = 10, branching: int = 4, least: int = 3, most: int | None = 500) -> DataFrame:
    """(project, id, name, entry, terminal, steps, trace): flows along calls from entry points.

    Entry points are callables that nothing calls or whose name is one of an entry. From each, the first ``branching``
    callees by key are followed, never a node already on the path; a path ends where nothing follows or at
    ``max_depth`` nodes. Paths of at least ``least`` nodes are kept, the first ``most`` of each project by entry and, as they are
    met breadth first, by length and trace; repeated traces once. An entry that has ``most`` of them is followed no further.
    """
    own = g.named("name", labels=CALLABLE)
    key = own.select("project", F.col("key").alias("dst"))
    e = g.rel("CALLS").where("src <> dst").join(key, ["project", "dst"], "left_semi").join(key.withColumnRenamed("dst", "src"), ["project", "src"], "left_semi")
    ranked_fan = e.withColumn("r", F.row_number().over(Window.partitionBy("project", "src").orderBy("dst"))).where(F.col("r") <= branching)
    fan = stage(ranked_fan.groupBy("project", F.col("src").alias("last")).agg(F.array_sort(F.collect_list("dst")).alias("callees")))
    called = e.select("project", F.col("dst").alias("key")).distinct().withColumn("called", F.lit(True))
    entry = own.join(called, ["project", "key"], "left").where(F.col("called").isNull() | names.is_entry_name(F.col("name")))
    front = entry.select("project", F.col("key").alias("last"), F.array("key").alias("trace"))
    done: list[DataFrame] = []
    ended = 0
    for depth in range(1, max_depth + 1):
        if depth == max_depth:
            done.append(front)
            break
        fresh = F.filter(F.coalesce("callees", F.array().cast("array<string>")), lambda c: ~F.array_contains("trace", c))
        # a row for each way on, and one without for a path that ends
        seen = Observation()
        step = front.join(fan, ["project", "last"], "left").select("project", "last", "trace", F.explode_outer(fresh).alias("dst"))
        step = stage(step.observe(seen, F.count("dst").alias("going"), F.count(F.when(F.col("dst").isNull() & (F.size("trace") >= least), 1)).alias("over")))
        done.append(step.where("dst is null").select("project", "last", "trace"))
        front = step.where("dst is not null").select("project", F.col("dst").alias("last"), F.concat("trace", F.array("dst")).alias("trace"))
        if not seen.get["going"]:
            break
        ended += seen.get["over"]
        if most is not None and ended >= most:
            tally = reduce(DataFrame.unionByName, [d.where(F.size("trace") >= least).select("project", F.col("trace")[0].alias("entry")) for d in done])
            full = tally.groupBy("project", "entry").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("project", "entry")
            front = front.withColumn("entry", F.col("trace")[0]).join(full, ["project", "entry"], "left_anti").select("project", "last", "trace")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    every = every.where(F.size("trace") >= least).select("project", "trace").distinct()
    # places within an entry and, from one row an entry, within the project
    every = every.withColumn("entry", F.col("trace")[0])
    within = every.withColumn("place", F.row_number().over(Window.partitionBy("project", "entry").orderBy(F.size("trace"), "trace")))
    if most is not None:
        within = within.where(F.col("place") <= most)
    sizes = within.groupBy("project", "entry").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("project").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = within.join(sizes.select("project", "entry", before.alias("before")), ["project", "entry"]).withColumn("n", F.col("before") + F.col("place"))
    if most is not None:
        ranked = ranked.where(F.col("n") <= most)
    short = own.select("project", "key", "name")
    out = ranked.withColumn("terminal", F.element_at("trace", -1))
    out = out.join(short.select("project", F.col("key").alias("entry"), F.col("name").alias("entry_name")), ["project", "entry"]).join(short.select("project", F.col("key").alias("terminal"), F.col("name").alias("terminal_name")), ["project", "terminal"])
    return out.select(
        "project", F.concat(F.col("project"), F.lit("::process::"), F.col("n").cast("string")).alias("id"), F.concat("entry_name", F.lit("_to_"), "terminal_name").alias("name"), "entry", "terminal", F.size("trace").alias("steps"), "trace"
    )


def steps(found: DataFrame) -> DataFrame:
    """(project, id, step_index, key): HAS_STEP edges with their place from 0."""
    return found.select("project", "id", F.posexplode("trace").alias("step_index", "key"))


def listed(nodes: DataFrame, label: str, pattern: str | None, limit: int) -> DataFrame:
    """Communities or processes whose name contains the pattern, largest first."""
    size = "symbol_count" if label == "Community" else "step_count"
    rows = nodes.where((F.col("label") == label) & optional_contains(F.col("name"), pattern)).select("project", F.col("key").alias("id"), "name", size).distinct()
    return rows.orderBy(F.desc(size), "id", "project").limit(limit)


def snippets(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, found, error, file_path, source): the source of each wanted qualified name.

    symbols has a column symbol; items has qualified_name, file_path and source_code, the longest row of a name holds. A
    name without row or with blank source is not found and says why.
    """
    best = items.groupBy("qualified_name").agg(F.max_by(F.struct("file_path", "source_code"), F.struct(F.coalesce(F.length("source_code"), F.lit(-1)), "file_path", "source_code")).alias("v"))
    joined = symbols.select("symbol").distinct().join(best, F.col("symbol") == F.col("qualified_name"), "left")
    there = F.trim(F.coalesce(F.col("v.source_code"), F.lit(""))) != ""
    error = F.when(F.col("v").isNull(), "symbol not found").when(~there, "no source")
    return joined.select("symbol", there.alias("found"), error.alias("error"), F.col("v.file_path").alias("file_path"), F.when(there, F.col("v.source_code")).alias("source"))

