"""The eight tools and their dispatcher. Each takes plain arguments and returns a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlode.cypher import run
from graphlode.functions import nlq
from graphlode.operators import graph as G
from graphlode.operators import similarity as S
from graphlode.operators.index import index_tree
from graphlode.plans.session import stage
from graphlode.sources.extract import BUILTINS
from graphlode.sources.store import Store

Generator = Callable[[str], str]


def template_generator(question: str) -> str:
    """An offline generator: query text for the common forms of question."""
    r = nlq.route(question)
    low = question.lower()
    listed = "RETURN n.qualified_name AS qualified_name, n.name AS name ORDER BY qualified_name LIMIT 50"
    label = next((x for x in ("Interface", "Class", "Method", "Module", "Function") if x.lower() in low), "Function")
    s = (r.symbol or "").replace("\\", "").replace("'", "")
    named = f"(n.name = '{s}' OR n.local_name = '{s}' OR n.qualified_name = '{s}' OR n.qualified_name ENDS WITH ':{s}' OR n.qualified_name ENDS WITH '.{s}')"
    if s and r.kind == "dependency":
        hops = f"*1..{r.depth}" if r.depth > 1 else ""
        arrow = f"(n)-[:CALLS{hops}]->(c)" if r.direction == "callees" else f"(c)-[:CALLS{hops}]->(n)"
        return f"MATCH {arrow} WHERE {named} RETURN DISTINCT c.qualified_name AS qualified_name, c.name AS name ORDER BY qualified_name LIMIT 50"
    if r.kind == "exact_text":
        kind = "Literal" if "literal" in low else "Builtin" if s in BUILTINS else "Comment"
        wanted = s or ("FIXME" if "fixme" in low else "TODO")
        field_ = "name" if kind == "Builtin" else "text"
        return f"MATCH (n:{kind}) WHERE n.{field_} CONTAINS '{wanted}' {listed}"
    if s and "implement" in low:
        return f"MATCH (c)-[:IMPLEMENTS]->(n) WHERE {named} RETURN c.qualified_name AS qualified_name, c.name AS name ORDER BY qualified_name LIMIT 50"
    if m := re.search(r"\b(?:contains?|containing|named like)\s+['\"`]?(\w+)", low):
        return f"MATCH (n:{label}) WHERE toLower(n.name) CONTAINS '{m[1]}' {listed}"
    if s:
        return f"MATCH (n) WHERE {named} {listed}"
    if "how many" in low or "count" in low:
        return f"MATCH (n:{label}) RETURN count(n) AS total"
    return f"MATCH (n:{label}) {listed}"


@dataclass
class Tools:
    store: Store
    project: str | None = None
    generator: Generator = template_generator
    allow_index: bool = False

    def _graph(self, project: str | None = None) -> G.Graph:
        return self.store.graph().scoped(project or self.project)

    def ask(self, question: str, project: str | None = None) -> nlq.Answer:
        """A question to rows: routed, generated, cleaned, checked, scoped, run and truncated; errors come as values.

        meta has the route, its symbol and, with rows, total, returned and was_truncated.
        """
        r = nlq.route(question)
        meta: dict[str, object] = {"route": r.kind, "symbol": r.symbol}
        if r.kind == "unsupported":
            return nlq.Answer(question, error="the graph is read-only", meta=meta)
        if r.kind == "grep_recommended":
            return nlq.Answer(question, error="search the files' text for this (scan.grep)", meta=meta)
        try:
            text = nlq.repair(self.generator, question)
            rows = run(self.store.graph(), text, {"project": project or self.project}, project or self.project)
        except nlq.InvalidQuery as error:
            return nlq.Answer(question, error=str(error), meta=meta)
        rows = stage(rows)
        kept = stage(nlq.truncated(rows, rows.columns))
        total, returned = rows.count(), kept.count()
        return nlq.Answer(question, text, kept.orderBy(*rows.columns), meta={**meta, "total": total, "returned": returned, "was_truncated": returned < total})

    def query_code_graph(self, question: str, project: str | None = None) -> DataFrame:
        answer = self.ask(question, project)
        if answer.error:
            raise nlq.InvalidQuery(answer.error)
        return answer.rows

    def get_code_from_graph(self, qualified_names: list[str], files: DataFrame) -> DataFrame:
        """(symbol, found, error, file_path, source): the source lines of symbols; files has project, path and text."""
        spark = self.store.spark
        wanted = spark.createDataFrame([(q,) for q in dict.fromkeys(qualified_names)], "symbol string")
        n = self._graph().nodes.groupBy("project", "qualified_name").agg(F.min(F.struct("file_path", "start_line", "end_line")).alias("n")).select("project", "qualified_name", "n.*")
        from graphlode.functions.names import line_slice

        located = n.join(wanted, n["qualified_name"] == wanted["symbol"], "left_semi").join(files.select("project", F.col("path").alias("file_path"), "text"), ["project", "file_path"], "left")
        items = located.select("qualified_name", "file_path", line_slice(F.col("text"), F.col("start_line"), F.col("end_line")).alias("source_code"))
        return G.snippets(items, wanted)

    def semantic_code_search(self, query: list[float], top_k: int = 5, node_type: str | None = None, project: str | None = None) -> DataFrame:
        """(id, score, ...): the most similar vectors with their place in the graph."""
        equals = {k: v for k, v in (("project", project or self.project), ("node_type", node_type)) if v}
        hits = S.top_k(self.store.vectors(), query, max(1, min(20, top_k)), **equals)
        n = self._graph(project).nodes.groupBy("project", "qualified_name").agg(F.min(F.struct("start_line", "end_line")).alias("n")).select("project", "qualified_name", "n.*")
        return hits.select("id", "project", "qualified_name", "file_path", F.round("score", 3).alias("score")).join(n, ["project", "qualified_name"], "left")

    def analyze_code_dependencies(self, target: str, direction: str = "both", depth: int = 1, limit: int = 50) -> DataFrame:
        report = G.dependency_report(self._graph(), target, max(1, min(5, depth)), limit)
        return report if direction == "both" else report.where(F.col("direction") == direction.rstrip("s"))

    def analysis(self, kind: str, target: str = "", depth: int = 5, limit: int = 50) -> DataFrame:
        """One of callers, callees, chains, reverse_chains, stats, hubs, cycles, orphans."""
        g = self._graph()
        kinds: dict[str, Callable[[], DataFrame]] = {
            "callers": lambda: G.callers(g, target, depth, limit), "callees": lambda: G.callees(g, target, depth, limit), "chains": lambda: G.call_chains(g, target, depth, limit),
            "reverse_chains": lambda: G.call_chains(g, target, depth, limit, inward=True), "stats": lambda: G.dependency_stats(g).orderBy(F.desc("incoming"), "key").limit(limit),
            "hubs": lambda: G.hubs(g).orderBy(F.desc("total"), "key").limit(limit), "cycles": lambda: G.cycles(g, depth).orderBy("depth", "project", "chain").limit(limit), "orphans": lambda: G.orphans(g).orderBy("key").limit(limit),
        }
        if kind not in kinds:
            raise ValueError(f"unknown analysis {kind}")
        return kinds[kind]()

    def list_graph_projects(self) -> DataFrame:
        return self.store.graph().nodes.select("project").distinct().orderBy("project")

    def find_communities(self, pattern: str | None = None, limit: int = 20) -> DataFrame:
        return G.listed(self._graph().nodes, "Community", pattern, limit)

    def find_processes(self, pattern: str | None = None, limit: int = 20) -> DataFrame:
        return G.listed(self._graph().nodes, "Process", pattern, limit)

    def index_repository(self, root: str, project: str, exclude: tuple[str, ...] = (), unignore: tuple[str, ...] = (), fresh: bool = False) -> DataFrame:
        if not self.allow_index:
            raise PermissionError("indexing is not allowed")
        if fresh:
            self.store.delete_project(project)
        return index_tree(self.store.spark, self.store, root, project, exclude, unignore)

    def call(self, name: str, **arguments) -> DataFrame:
        """Dispatch by tool name."""
        if name not in TOOL_NAMES:
            raise ValueError(f"unknown tool {name}")
        return getattr(self, name)(**arguments)


TOOL_NAMES = ("query_code_graph", "get_code_from_graph", "semantic_code_search", "analyze_code_dependencies", "list_graph_projects", "find_communities", "find_processes", "index_repository")
