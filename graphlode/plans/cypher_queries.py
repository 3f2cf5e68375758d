"""openCypher texts over the whole graph, each checked against plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.cypher import run
from graphlode.operators.graph import Graph
from graphlode.plans.graph_queries import _PATHS, CALLS, NODE
from graphlode.plans.registry import Registry

query = Registry()


def _run(spark, sf_dir, text, params=None, project=None):
    return run(Graph.load(spark, sf_dir), text, params, project)


@query(f"WITH {CALLS}, {NODE} SELECT c.project AS project, s.qualified_name AS caller, t.qualified_name AS callee FROM calls c JOIN node s ON s.project = c.project AND s.key = c.src AND s.label IN ('Function', 'Method') JOIN node t ON t.project = c.project AND t.key = c.dst")
def q_cypher_callers(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (a:Function|Method)-[:CALLS]->(b) RETURN a.project AS project, a.qualified_name AS caller, b.qualified_name AS callee ORDER BY caller")


@query(f"WITH {CALLS}, {NODE} SELECT t.name AS name, count(*) AS calls, count(DISTINCT s.name) AS names FROM calls c JOIN node s ON s.project = c.project AND s.key = c.src JOIN node t ON t.project = c.project AND t.key = c.dst AND t.label = 'Function' GROUP BY t.name ORDER BY calls DESC, name LIMIT 25")
def q_cypher_agg(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (s)-[r:CALLS]->(t:Function) RETURN t.name AS name, count(r) AS calls, count(DISTINCT s.name) AS names ORDER BY calls DESC, name LIMIT 25")


@query(f"""WITH {CALLS}, {NODE} SELECT n.project AS project, n.key AS key, count(s.key) AS callers FROM node n LEFT JOIN calls c ON c.project = n.project AND c.dst = n.key LEFT JOIN node s ON s.project = c.project AND s.key = c.src AND starts_with(s.file_path, 'src/')
WHERE n.label = 'Method' GROUP BY n.project, n.key""")
def q_cypher_optional(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (n:Method) OPTIONAL MATCH (s)-[:CALLS]->(n) WHERE s.file_path STARTS WITH 'src/' RETURN n.project AS project, n.key AS key, count(s) AS callers")


@query(_PATHS.format(calls=CALLS, depth=3) + f""", {NODE} SELECT DISTINCT p.project AS project, a.qualified_name AS source, z.qualified_name AS target FROM p JOIN node a ON a.project = p.project AND a.key = p.src AND a.label = 'Function'
JOIN node z ON z.project = p.project AND z.key = p.dst AND z.label = 'Method'""")
def q_cypher_var_len(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (a:Function)-[:CALLS*1..3]->(z:Method) RETURN DISTINCT a.project AS project, a.qualified_name AS source, z.qualified_name AS target")


@query(_PATHS.format(calls=CALLS, depth=3) + f""", {NODE} SELECT array_to_string(chain, ' > ') AS chain, depth FROM p JOIN node a ON a.project = p.project AND a.key = p.src AND a.label = 'Method' JOIN node z ON z.project = p.project AND z.key = p.dst""")
def q_cypher_path(spark, sf_dir):
    rows = _run(spark, sf_dir, "MATCH path = (a:Method)-[:CALLS*1..3]->(z) RETURN [n IN nodes(path) | n.qualified_name] AS chain, length(path) AS depth")
    return rows.select(F.array_join("chain", " > ").alias("chain"), "depth")


@query(f"""WITH {NODE} SELECT n.project AS project, n.key AS key FROM node n WHERE n.label IN ('Function', 'Method') AND NOT EXISTS (SELECT 1 FROM edges e JOIN node x ON x.project = e.project AND x.key = e.dst_key WHERE e.rel_type = 'CALLS' AND e.project = n.project AND e.src_key = n.key)
AND NOT EXISTS (SELECT 1 FROM edges e JOIN node x ON x.project = e.project AND x.key = e.src_key WHERE e.rel_type = 'CALLS' AND e.project = n.project AND e.dst_key = n.key)""")
def q_cypher_anti(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (n) WHERE (n:Function OR n:Method) AND NOT (n)-[:CALLS]->() AND NOT ()-[:CALLS]->(n) RETURN n.project AS project, n.key AS key")


@query(f"""WITH {CALLS}, {NODE}, o AS (SELECT c.project, c.src AS key, count(*) AS n FROM calls c JOIN node t ON t.project = c.project AND t.key = c.dst GROUP BY ALL), i AS (SELECT c.project, c.dst AS key, count(*) AS n FROM calls c JOIN node s ON s.project = c.project AND s.key = c.src GROUP BY ALL)
SELECT n.project AS project, n.key AS key, o.n AS outgoing, i.n AS incoming FROM node n JOIN o USING (project, key) JOIN i USING (project, key) WHERE n.label IN ('Function', 'Method')""")
def q_cypher_with(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (n:Function|Method)-[r:CALLS]->(t) WITH n, count(r) AS outgoing MATCH (c)-[q:CALLS]->(n) RETURN n.project AS project, n.key AS key, outgoing, count(q) AS incoming")


@query("SELECT DISTINCT project, name, 'class' AS kind FROM nodes WHERE label = 'Class' AND is_exported UNION SELECT DISTINCT project, name, 'module' FROM nodes WHERE label = 'Module' AND contains(lower(name), 'cache')")
def q_cypher_union(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (n:Class) WHERE n.is_exported = true RETURN n.project AS project, n.name AS name, 'class' AS kind UNION MATCH (m:Module) WHERE toLower(m.name) CONTAINS 'cache' RETURN m.project AS project, m.name AS name, 'module' AS kind")


@query("""SELECT DISTINCT n.project AS project, n.key AS process, i - 1 AS step, n.trace[i] AS key FROM (SELECT DISTINCT project, key, trace FROM nodes WHERE label = 'Process' AND trace IS NOT NULL) n, unnest(generate_series(1, len(n.trace))) AS t(i)""")
def q_cypher_unwind(spark, sf_dir):
    rows = _run(spark, sf_dir, "MATCH (p:Process) WHERE p.trace IS NOT NULL UNWIND range(0, size(p.trace) - 1) AS step RETURN p.project AS project, p.key AS process, step, p.trace[step] AS key")
    return rows.withColumn("step", F.col("step").cast("long"))


@query("SELECT DISTINCT project, key FROM nodes WHERE label IN ('Function', 'Method') AND len(list_filter(decorators, lambda d: lower(d) IN ('cached', 'guarded'))) > 0 AND project = 'moorhen-index'")
def q_cypher_any_scoped(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (n:Function|Method) WHERE ANY(d IN n.decorators WHERE toLower(d) IN ['cached', 'guarded']) RETURN n.project AS project, n.key AS key", project="moorhen-index")


@query("""WITH RECURSIVE owns AS (SELECT DISTINCT project, src_key AS src, dst_key AS dst FROM edges WHERE rel_type IN ('DEFINES', 'DEFINES_METHOD')), r AS (SELECT project, src, dst FROM owns UNION SELECT r.project, r.src, o.dst FROM r JOIN owns o ON o.project = r.project AND o.src = r.dst)
SELECT m.project AS project, m.key AS module, count(DISTINCT r.dst) AS symbols FROM (SELECT DISTINCT project, key FROM nodes WHERE label = 'Module') m JOIN r ON r.project = m.project AND r.src = m.key JOIN (SELECT DISTINCT project, key FROM nodes) n ON n.project = r.project AND n.key = r.dst GROUP BY m.project, m.key""")
def q_cypher_unbounded(spark, sf_dir):
    return _run(spark, sf_dir, "MATCH (m:Module)-[:DEFINES|DEFINES_METHOD*]->(s) RETURN m.project AS project, m.key AS module, count(DISTINCT s) AS symbols")


QUERIES, ORACLES = query.queries, query.oracles
