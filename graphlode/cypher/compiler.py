"""Syntax tree to DataFrame.

A row of the working frame binds each variable: a node to a struct of its label, key and the properties that
the query reads, a relation to a struct of its properties, a path to the keys along it. Patterns are joins, optional
patterns left joins of the pattern matched on the distinct bound ends, conditions on patterns existence joins. The project
scope filters the sources themselves, so it holds in every clause and every part of a union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlode.cypher.parser import Clause, NodePattern, Pattern, RelPattern, aggregated, parse, properties
from graphlode.functions.nlq import InvalidQuery, check_read_only
from graphlode.model import EDGE_KEY, EDGES, NODES
from graphlode.operators import graph as G

_ID = ["project", "label", "key"]


class Frame:
    """Rows and what their columns bind: node, rel, path or value."""

    def __init__(self, df: DataFrame | None, kinds: dict[str, str]):
        self.df, self.kinds = df, kinds


class Compiler:
    def __init__(self, graph: G.Graph, params: dict[str, object], wanted: set[str]):
        columns = [f.name for f in NODES if f.name in graph.nodes.columns]
        self.columns = [*_ID, *[c for c in columns if c not in _ID and (c in wanted or "*" in wanted)]]
        self.nodes = graph.nodes.select(*self.columns).dropDuplicates(_ID)
        edge_columns = [f.name for f in EDGES if f.name in graph.edges.columns]
        extra = [c for c in edge_columns if c not in EDGE_KEY and (c in wanted or "*" in wanted)]
        self.edges = graph.edges.select(*EDGE_KEY, *extra).dropDuplicates(list(EDGE_KEY))
        self.edge_extra = extra
        self.params, self.count = params, 0

    def fresh(self, prefix: str) -> str:
        self.count += 1
        return f"_{prefix}{self.count}"

    # -- clauses
    def run(self, clauses: list[Clause]) -> DataFrame:
        frame = Frame(None, {})
        for c in clauses:
            if c.kind == "match":
                frame = self.optional(frame, c) if c.optional else self.match(frame, c.patterns, c.where)
            elif c.kind == "unwind":
                if frame.df is None:
                    raise InvalidQuery("UNWIND needs rows")
                frame = Frame(frame.df.withColumn(c.alias, F.explode(self.value(c.expr, frame))), {**frame.kinds, c.alias: "value"})
            else:
                frame = self.project(frame, c)
        return frame.df

    def match(self, frame: Frame, patterns: list[Pattern], where: tuple | None) -> Frame:
        todo = list(patterns)
        while todo:  # connected patterns first, so that joins have keys
            p = next((x for x in todo if any(n.var in frame.kinds for n in x.nodes if n.var)), todo[0])
            todo.remove(p)
            frame = self.pattern(frame, p)
        return self.filter(frame, where) if where is not None else frame

    def optional(self, frame: Frame, c: Clause) -> Frame:
        if frame.df is None:
            return self.match(frame, c.patterns, c.where)
        bound = [v for v in self.variables(c) if v in frame.kinds]
        if not bound:
            raise InvalidQuery("an optional pattern must share a variable")
        start = Frame(frame.df.select(*bound).distinct(), {v: frame.kinds[v] for v in bound})
        found = self.match(start, c.patterns, c.where)
        new = [v for v in found.kinds if v not in frame.kinds]
        keys = {v: self.fresh("k") for v in bound}
        right = found.df.select(*[self.identity(v, found.kinds[v]).alias(k) for v, k in keys.items()], *new)
        joined = frame.df.join(right, reduce(lambda a, b: a & b, [self.identity(v, frame.kinds[v]).eqNullSafe(F.col(k)) for v, k in keys.items()]), "left").drop(*keys.values())
        return Frame(joined, {**frame.kinds, **{v: found.kinds[v] for v in new}})

    def identity(self, var: str, kind: str) -> Column:
        return F.struct(*[F.col(f"`{var}`.{c}") for c in _ID]) if kind == "node" else F.col(f"`{var}`")

    def variables(self, c: Clause) -> list[str]:
        out: list[str] = []

        def walk(e: object) -> None:
            if isinstance(e, Pattern):
                out.extend([v for v in [e.path, *[n.var for n in e.nodes], *[r.var for r in e.rels]] if v])
                for n in e.nodes:
                    walk(list(n.props.values()))
            elif isinstance(e, tuple):
                if e and e[0] == "var":
                    out.append(e[1])
                for x in e[1:]:
                    walk(x)
            elif isinstance(e, list):
                for x in e:
                    walk(x)

        for p in c.patterns:
            walk(p)
        walk(c.where or ())
        return list(dict.fromkeys(out))

    # -- patterns
    def scan(self, n: NodePattern, frame: Frame) -> DataFrame:
        df = self.nodes
        if n.labels:
            df = df.where(F.col("label").isin(*n.labels))
        for k, e in n.props.items():
            df = df.where(F.col(k) == self.value(e, frame))
        return df

    def struct(self) -> Column:
        return F.struct(*self.columns)

    def restrict(self, frame: Frame, var: str, n: NodePattern) -> Frame:
        """Labels and properties of a pattern on a bound node."""
        df = frame.df
        if n.labels:
            df = df.where(F.col(f"`{var}`.label").isin(*n.labels))
        for k, e in n.props.items():
            df = df.where(F.col(f"`{var}`.{k}") == self.value(e, frame))
        return Frame(df, frame.kinds)

    def pattern(self, frame: Frame, p: Pattern) -> Frame:
        names = [n.var or self.fresh("n") for n in p.nodes]
        # begin at a bound node if there is one, and walk both ways from it
        begin = next((i for i, v in enumerate(names) if v in frame.kinds), None)
        if begin is None:
            begin = next((i for i, n in enumerate(p.nodes) if n.props), 0)
            start = self.scan(p.nodes[begin], frame).select(self.struct().alias(names[begin]))
            if frame.df is None:
                frame = Frame(start, {names[begin]: "node"})
            else:  # patterns without a shared variable meet within their project
                other = next((v for v, k in frame.kinds.items() if k == "node"), None)
                if other is None:
                    raise InvalidQuery("a pattern must be connected")
                frame = Frame(frame.df.join(start, F.col(f"`{other}`.project") == F.col(f"`{names[begin]}`.project")), {**frame.kinds, names[begin]: "node"})
        else:
            frame = self.restrict(frame, names[begin], p.nodes[begin])
        chains: list[str] = []
        for i in range(begin, len(p.rels)):
            frame = self.step(frame, names[i], names[i + 1], p.rels[i], p.nodes[i + 1], False, p.path is not None, chains)
        for i in range(begin - 1, -1, -1):
            frame = self.step(frame, names[i + 1], names[i], p.rels[i], p.nodes[i], True, p.path is not None, chains)
        if p.path:
            if begin != 0:
                raise InvalidQuery("a path must begin at its bound node")
            chain = F.array(F.col(f"`{names[0]}`.key")) if not chains else reduce(lambda a, b: F.concat(a, F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))), [F.col(c) for c in chains])
            frame = Frame(frame.df.withColumn(p.path, F.struct(F.col(f"`{names[0]}`.project").alias("project"), chain.alias("chain"))), {**frame.kinds, p.path: "path"})
        return frame

    def hops(self, r: RelPattern, turned: bool) -> DataFrame:
        """(project, _from, _from_label, _to, _to_label, _rel) in the direction of the walk."""
        e = self.edges.where(F.col("rel_type").isin(*r.types)) if r.types else self.edges
        rel = F.struct("rel_type", *self.edge_extra).alias("_rel")
        out = e.select("project", F.col("src_key").alias("_from"), F.col("src_label").alias("_from_label"), F.col("dst_key").alias("_to"), F.col("dst_label").alias("_to_label"), rel)
        back = e.select("project", F.col("dst_key").alias("_from"), F.col("dst_label").alias("_from_label"), F.col("src_key").alias("_to"), F.col("src_label").alias("_to_label"), rel)
        if r.direction == "both":
            return out.unionByName(back)
        return back if (r.direction == "in") != turned else out

    def step(self, frame: Frame, a: str, b: str, r: RelPattern, n: NodePattern, turned: bool, path: bool, chains: list[str]) -> Frame:
        hop = self.hops(r, turned)
        kinds = dict(frame.kinds)
        chain = self.fresh("c")
        if r.least is not None:
            if r.var:
                raise InvalidQuery("a relation of several hops cannot be bound")
            edges = hop.select("project", F.col("_from").alias("src"), F.col("_to").alias("dst")).distinct()
            starts = frame.df.select(F.col(f"`{a}`.project").alias("project"), F.col(f"`{a}`.key").alias("src")).distinct()
            if r.most is None and not path:
                ends = G.closure(edges, starts, include_start=True)
                if r.least >= 1:  # a start is its own end only on a cycle: walk one hop, then the closure
                    first = edges.join(starts, ["project", "src"], "left_semi")
                    below = G.closure(edges, first.select("project", F.col("dst").alias("src")).distinct(), include_start=True)
                    ends = first.withColumnRenamed("dst", "_m").join(below.withColumnRenamed("src", "_m"), ["project", "_m"]).select("project", "src", "dst").distinct()
                hop = ends.select("project", F.col("src").alias("_from"), F.col("dst").alias("_to"), F.array("src", "dst").alias("_chain"))
            else:
                found = G.paths(edges, r.most, starts, max(1, r.least))
                hop = found.select("project", F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("chain").alias("_chain"))
                if r.least == 0:
                    hop = hop.unionByName(starts.select("project", F.col("src").alias("_from"), F.col("src").alias("_to"), F.array("src").alias("_chain")))
            hop = hop.select("project", "_from", "_to", F.col("_chain").alias(chain))
        else:
            hop = hop.select("project", "_from", "_to", *([F.col("_rel").alias(r.var)] if r.var else []), F.array("_from", "_to").alias(chain))
            if r.var:
                kinds[r.var] = "rel"
        hop = hop.withColumnsRenamed({"project": "_project"})
        on = (F.col(f"`{a}`.project") == F.col("_project")) & (F.col(f"`{a}`.key") == F.col("_from"))
        if b in frame.kinds:
            joined = frame.df.join(hop, on & (F.col(f"`{b}`.key") == F.col("_to")) & (F.col(f"`{b}`.project") == F.col("_project")))
            frame = self.restrict(Frame(joined, kinds), b, n)
        else:
            target = self.scan(n, frame).select(self.struct().alias(b))
            joined = frame.df.join(hop, on).join(target, (F.col(f"`{b}`.project") == F.col("_project")) & (F.col(f"`{b}`.key") == F.col("_to")))
            frame = Frame(joined, {**kinds, b: "node"})
        chains.append(chain)
        drop = ["_project", "_from", "_to", *([] if path else [chain])]
        return Frame(frame.df.drop(*drop), frame.kinds)

    # -- conditions
    def filter(self, frame: Frame, where: tuple) -> Frame:
        frame, where = self.patterns_in(frame, where)
        return Frame(frame.df.where(self.value(where, frame)), frame.kinds)

    def patterns_in(self, frame: Frame, e: tuple) -> tuple[Frame, tuple]:
        """Replace each pattern condition by a column that says whether it holds."""
        if not isinstance(e, tuple):
            return frame, e
        if e[0] == "pattern":
            p = e[1]
            bound = [n.var for n in p.nodes if n.var in frame.kinds]
            if not bound:
                raise InvalidQuery("a pattern in a condition must use a bound variable")
            start = Frame(frame.df.select(*bound).distinct(), {v: "node" for v in bound})
            found = self.pattern(start, p)
            flag, keys = self.fresh("p"), {v: self.fresh("k") for v in bound}
            right = found.df.select(*[self.identity(v, "node").alias(k) for v, k in keys.items()]).distinct().withColumn(flag, F.lit(True))
            on = reduce(lambda x, y: x & y, [self.identity(v, "node") == F.col(k) for v, k in keys.items()])
            return Frame(frame.df.join(right, on, "left").drop(*keys.values()), {**frame.kinds, flag: "flag"}), ("call", "coalesce", False, [("var", flag), ("lit", False)])
        out = [e[0]]
        for x in e[1:]:
            if isinstance(x, tuple):
                frame, x = self.patterns_in(frame, x)
            out.append(x)
        return frame, tuple(out)

    # -- projections
    def project(self, frame: Frame, c: Clause) -> Frame:
        if frame.df is None:
            raise InvalidQuery("nothing to return")
        items = [(i.alias, i.expr) for i in c.items]
        if c.star:
            items = [(v, ("var", v)) for v, k in frame.kinds.items() if not v.startswith("_") and k != "flag"] + items
        paths = {e[3][0][1] for _, e in self.calls(items) if e[1] == "nodes" and e[3][0][0] == "var"}
        for p in paths:
            frame = self.with_nodes(frame, p)
        kinds = {a: frame.kinds.get(e[1], "value") if e[0] == "var" else "value" for a, e in items}
        grouped = any(aggregated(e) for _, e in items)
        orders: list[tuple[Column, bool]] = []
        if grouped:
            keys = [(a, e) for a, e in items if not aggregated(e)]
            aggregates = [self.value(e, frame).alias(a) for a, e in items if aggregated(e)]
            df = frame.df.groupBy(*[self.value(e, frame).alias(a) for a, e in keys]).agg(*aggregates).select(*[F.col(f"`{a}`") for a, _ in items])
        else:
            hidden = []
            for n, (e, _) in enumerate(c.order):
                if not self.named(e, items) and not c.distinct:
                    hidden.append(self.value(e, frame).alias(f"_o{n}"))
            df = frame.df.select(*[self.value(e, frame).alias(a) for a, e in items], *hidden)
            if c.distinct:
                df = df.distinct()
        out = Frame(df, kinds)
        if c.where is not None:
            out = self.filter(out, c.where)
        for n, (e, down) in enumerate(c.order):
            alias = self.named(e, items)
            column = F.col(f"`{alias}`") if alias else F.col(f"_o{n}") if f"_o{n}" in out.df.columns else self.value(e, out)
            orders.append((column.desc() if down else column.asc(), down))
        df = out.df.orderBy(*[o for o, _ in orders]) if orders else out.df
        if c.skip is not None:
            df = df.offset(self.integer(c.skip))
        if c.limit is not None:
            df = df.limit(self.integer(c.limit))
        df = df.drop(*[x for x in df.columns if x.startswith("_o") and x[2:].isdigit()])
        return Frame(df, kinds)

    @staticmethod
    def named(e: tuple, items: list[tuple[str, tuple]]) -> str | None:
        if e[0] == "var":
            for a, _ in items:
                if a == e[1]:
                    return a
        return next((a for a, x in items if x == e), None)

    def calls(self, items: list[tuple[str, tuple]]) -> list[tuple[str, tuple]]:
        out: list[tuple[str, tuple]] = []

        def walk(a: str, e: object) -> None:
            if isinstance(e, tuple):
                if e and e[0] == "call" and e[3] and e[3][0] != ("star",):
                    out.append((a, e))
                for x in e[1:]:
                    walk(a, x)
            elif isinstance(e, list):
                for x in e:
                    walk(a, x)

        for a, e in items:
            walk(a, e)
        return out

    def with_nodes(self, frame: Frame, path: str) -> Frame:
        """The column <path>_nodes: the nodes along a path, in order."""
        chains = frame.df.select(F.col(f"`{path}`.project").alias("project"), F.col(f"`{path}`.chain").alias("chain")).distinct()
        at = chains.select("project", "chain", F.posexplode("chain").alias("_at", "key"))
        full = at.join(self.nodes.dropDuplicates(["project", "key"]), ["project", "key"]).groupBy("project", "chain").agg(F.array_sort(F.collect_list(F.struct("_at", self.struct().alias("n")))).alias("_all"))
        full = full.select(F.struct("project", "chain").alias("_path"), F.transform("_all", lambda x: x["n"]).alias(f"{path}_nodes"))
        return Frame(frame.df.join(full, F.col(f"`{path}`") == F.col("_path"), "left").drop("_path"), {**frame.kinds, f"{path}_nodes": "value"})

    def integer(self, e: tuple) -> int:
        value = e[1] if e[0] == "lit" else self.params.get(e[1]) if e[0] == "param" else None
        if not isinstance(value, (int, float)) or value != int(value):
            raise InvalidQuery("LIMIT and SKIP need an integer")
        return int(value)

    # -- expressions
    def value(self, e: tuple, frame: Frame, local: dict[str, Column] | None = None) -> Column:
        local = local or {}
        go = lambda x: self.value(x, frame, local)
        op = e[0]
        if op == "lit":
            return F.lit(e[1])
        if op == "param":
            if e[1] not in self.params:
                raise InvalidQuery(f"no parameter {e[1]}")
            v = self.params[e[1]]
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        if op == "var":
            if e[1] in local:
                return local[e[1]]
            if e[1] not in frame.kinds:
                raise InvalidQuery(f"unknown variable {e[1]}")
            return F.col(f"`{e[1]}`")
        if op == "prop":
            base = go(e[1])
            if e[1][0] == "var" and e[1][1] not in local and frame.kinds.get(e[1][1]) == "node" and e[2] not in self.columns:
                return F.lit(None).cast("string")
            return base[e[2]]
        if op == "list":
            return F.array(*[go(x) for x in e[1]])
        if op == "map":
            return F.struct(*[go(x).alias(k) for k, x in e[1].items()])
        if op == "haslabel":
            return go(e[1])["label"].isin(*e[2])
        if op == "comprehension":
            _, var, source, where, result = e
            out = go(source)
            if where is not None:
                out = F.filter(out, lambda x: self.value(where, frame, {**local, var: x}))
            return F.transform(out, lambda x: self.value(result, frame, {**local, var: x})) if result is not None else out
        if op == "quantifier":
            _, kind, var, source, where = e
            test = lambda x: F.coalesce(self.value(where, frame, {**local, var: x}), F.lit(False))
            if kind == "single":
                return F.size(F.filter(go(source), test)) == 1
            return F.exists(go(source), test) if kind == "any" else F.forall(go(source), test) if kind == "all" else ~F.exists(go(source), test)
        if op == "case":
            _, subject, branches, other = e
            out = None
            for condition, result in branches:
                test = go(condition) if subject is None else go(subject) == go(condition)
                out = F.when(test, go(result)) if out is None else out.when(test, go(result))
            return out.otherwise(go(other))
        if op == "call":
            return self.call(e[1], e[2], e[3], frame, local)
        unary = {"not": lambda x: ~x, "null": lambda x: x.isNull(), "notnull": lambda x: x.isNotNull(), "negative": lambda x: -x}
        if op in unary:
            return unary[op](go(e[1]))
        if op == "index":
            return F.get(go(e[1]), go(e[2]).cast("int"))
        if op == "slice":
            a, x = go(e[1]), go(e[2]).cast("int")
            z = F.size(a) if e[3] is None else go(e[3]).cast("int")
            return F.slice(a, x + 1, F.greatest(z - x, F.lit(0)))
        if op == "in":
            a = e[2]
            return go(e[1]).isin(*[go(x) for x in a[1]]) if a[0] == "list" and a[1] else F.array_contains(go(a), go(e[1])) if a[0] != "list" else F.lit(False)
        a, b = go(e[1]), go(e[2])
        if op == "+" and (e[1][0] in ("list", "comprehension") or e[2][0] in ("list", "comprehension") or any(x[0] == "call" and x[1] in ("collect", "nodes", "labels") for x in (e[1], e[2])) or self.text(e[1]) or self.text(e[2])):
            return F.concat(a, b)
        binary = {
            "and": lambda: a & b, "or": lambda: a | b, "xor": lambda: a != b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
            "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))), "starts": lambda: a.startswith(b), "ends": lambda: a.endswith(b), "contains": lambda: a.contains(b),
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }
        return binary[op]()

    def text(self, e: tuple) -> bool:
        if e[0] == "lit":
            return isinstance(e[1], str)
        if e[0] == "param":
            return isinstance(self.params.get(e[1]), str)
        if e[0] == "prop":
            kinds = {f.name: f.dataType.simpleString() for f in (*NODES, *EDGES)}
            return kinds.get(e[2]) == "string"
        return e[0] == "+" and (self.text(e[1]) or self.text(e[2])) or e[0] == "call" and e[1] in ("tolower", "toupper", "trim", "tostring", "type", "replace", "substring")

    def call(self, name: str, distinct: bool, args: list[tuple], frame: Frame, local: dict[str, Column]) -> Column:
        if name == "count":
            if args == [("star",)]:
                return F.count("*")
            x = self.countable(args[0], frame, local)
            return F.count_distinct(x) if distinct else F.count(x)
        a = [self.value(x, frame, local) for x in args]
        if name in ("sum", "avg", "min", "max"):
            return getattr(F, name)(a[0])
        if name == "collect":
            return F.array_sort(F.collect_set(a[0])) if distinct else F.array_sort(F.collect_list(a[0]))
        if name == "nodes":
            return F.col(f"`{args[0][1]}_nodes`")
        if name == "length":
            return F.size(a[0]["chain"]) - 1 if args[0][0] == "var" and frame.kinds.get(args[0][1]) == "path" else F.length(a[0])
        if name == "size":
            return F.length(a[0]) if self.text(args[0]) else F.size(a[0])
        if name == "labels":
            return F.array(a[0]["label"])
        table = {
            "type": lambda: a[0]["rel_type"], "id": lambda: a[0]["node_id"], "properties": lambda: F.to_json(a[0]), "tolower": lambda: F.lower(a[0]), "toupper": lambda: F.upper(a[0]), "trim": lambda: F.trim(a[0]),
            "coalesce": lambda: F.coalesce(*a), "range": lambda: F.sequence(a[0], a[1], *a[2:]), "tostring": lambda: a[0].cast("string"), "tointeger": lambda: a[0].try_cast("long"), "tofloat": lambda: a[0].try_cast("double"),
            "head": lambda: F.get(a[0], F.lit(0)), "last": lambda: F.element_at(a[0], -1), "split": lambda: F.split(a[0], F.concat(F.lit("\\Q"), a[1], F.lit("\\E"))), "replace": lambda: F.replace(a[0], a[1], a[2]),
            "substring": lambda: F.substring(a[0], a[1] + 1, a[2] if len(a) > 2 else F.length(a[0])), "abs": lambda: F.abs(a[0]), "ceil": lambda: F.ceil(a[0]), "floor": lambda: F.floor(a[0]), "round": lambda: F.round(a[0]),
            "sqrt": lambda: F.sqrt(a[0]), "exists": lambda: a[0].isNotNull(), "reverse": lambda: F.reverse(a[0]),
        }
        if name not in table:
            raise InvalidQuery(f"unknown function {name}")
        return table[name]()

    def countable(self, e: tuple, frame: Frame, local: dict[str, Column]) -> Column:
        """A node counts by its key."""
        if e[0] == "var" and e[1] not in local and frame.kinds.get(e[1]) == "node":
            return F.when(F.col(f"`{e[1]}`").isNotNull(), self.identity(e[1], "node"))
        return self.value(e, frame, local)


def run(graph: G.Graph, text: str, params: dict[str, object] | None = None, project: str | None = None) -> DataFrame:
    """The rows of a read-only query; with a project, of that project's part of the graph only."""
    check_read_only(text)
    q = parse(text)
    out = None
    for clauses in q.parts:
        wanted = properties(clauses) | {"node_id"}
        if any(i.expr[0] == "var" for c in clauses for i in c.items if c.kind == "return") or "properties(" in text.lower():
            wanted |= {"*"}
        df = Compiler(graph.scoped(project), params or {}, wanted).run(clauses)
        out = df if out is None else out.unionByName(df)
    return out.distinct() if len(q.parts) > 1 and not q.all else out
