"""Graph queries over the whole node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlode.functions import names
from graphlode.operators import graph as G
from graphlode.operators import mutate as M
from graphlode.plans.registry import Registry
from graphlode.plans.session import table

query = Registry()

CALLS = "calls AS (SELECT DISTINCT project, src_key AS src, dst_key AS dst FROM edges WHERE rel_type = 'CALLS')"
NODE = "node AS (SELECT project, key, any_value(label) AS label, any_value(name) AS name, any_value(qualified_name) AS qualified_name, any_value(file_path) AS file_path FROM nodes GROUP BY project, key)"
CHAIN = r"array_to_string(chain, ' > ')"


def _g(spark: SparkSession, sf_dir: str) -> G.Graph:
    return G.Graph.load(spark, sf_dir)


def _chain() -> F.Column:
    return F.array_join("chain", " > ").alias("chain")


# -- scans and predicates --------------------------------------------------------------------------------------
@query("SELECT DISTINCT project, key, name FROM nodes WHERE label = 'Module'")
def p_label_scan(spark, sf_dir):
    return _g(spark, sf_dir).scan("Module").select("project", "key", "name").distinct()


@query("SELECT DISTINCT project, qualified_name FROM nodes WHERE label IN ('Function', 'Method')")
def p_label_disjunction(spark, sf_dir):
    return _g(spark, sf_dir).scan("Function", "Method").select("project", "qualified_name").distinct()


@query("SELECT label, count(DISTINCT project || chr(1) || key) AS n FROM nodes GROUP BY label ORDER BY n DESC, label")
def p_all_nodes_by_label(spark, sf_dir):
    return _g(spark, sf_dir).nodes.select("label", "project", "key").distinct().groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("SELECT DISTINCT project, key, start_line FROM nodes WHERE label = 'Function' AND extension = '.ts' AND is_exported")
def p_property_equals(spark, sf_dir):
    return _g(spark, sf_dir).scan("Function", extension=".ts", is_exported=True).select("project", "key", "start_line").distinct()


@query("SELECT DISTINCT project, key, label FROM nodes WHERE label = 'Class' AND key = (SELECT min(key) FROM nodes WHERE label = 'Class')")
def p_key_lookup(spark, sf_dir):
    classes = _g(spark, sf_dir).scan("Class")
    return classes.join(F.broadcast(classes.agg(F.min("key").alias("key"))), "key").select("project", "key", "label").distinct()


@query("SELECT DISTINCT project, key, name FROM nodes WHERE contains(lower(name), 'cache')")
def p_contains_ci(spark, sf_dir):
    return _g(spark, sf_dir).nodes.where(F.lower("name").contains("cache")).select("project", "key", "name").distinct()


@query("SELECT DISTINCT project, key FROM nodes WHERE starts_with(file_path, 'src/')")
def p_starts_with(spark, sf_dir):
    return _g(spark, sf_dir).nodes.where(F.col("file_path").startswith("src/")).select("project", "key").distinct()


@query("SELECT DISTINCT project, key FROM nodes WHERE ends_with(qualified_name, '.' || name)")
def p_ends_with(spark, sf_dir):
    return _g(spark, sf_dir).nodes.where(F.col("qualified_name").endswith(F.concat(F.lit("."), F.col("name")))).select("project", "key").distinct()


@query("SELECT DISTINCT project, key, name FROM nodes WHERE label = 'Community' AND (NULL IS NULL OR contains(name, NULL))")
def p_null_param_filter(spark, sf_dir):
    return _g(spark, sf_dir).scan("Community").where(G.optional_contains(F.col("name"), None)).select("project", "key", "name").distinct()


@query("SELECT DISTINCT project, key, label FROM nodes WHERE is_external IS NULL OR is_external = false")
def p_null_or_false(spark, sf_dir):
    return _g(spark, sf_dir).nodes.where(~F.coalesce("is_external", F.lit(False))).select("project", "key", "label").distinct()


@query("SELECT DISTINCT n.project, n.key FROM nodes n WHERE (n.project, n.key) IN (SELECT project, dst_key FROM edges WHERE rel_type = 'CALLS')")
def p_in_list(spark, sf_dir):
    g = _g(spark, sf_dir)
    return g.nodes.select("project", "key").distinct().join(g.rel("CALLS").select("project", F.col("dst").alias("key")), ["project", "key"], "left_semi")


@query("SELECT DISTINCT project, key FROM nodes WHERE list_contains(decorators, 'cached')")
def p_array_contains(spark, sf_dir):
    return _g(spark, sf_dir).nodes.where(F.array_contains("decorators", "cached")).select("project", "key").distinct()


@query("SELECT DISTINCT project, key FROM nodes WHERE len(list_filter(decorators, lambda d: lower(d) LIKE '%retry%' OR lower(d) IN ('cached', 'guarded'))) > 0")
def p_array_any(spark, sf_dir):
    return _g(spark, sf_dir).nodes.where(F.exists("decorators", lambda d: F.lower(d).contains("retry") | F.lower(d).isin("cached", "guarded"))).select("project", "key").distinct()


@query("""SELECT DISTINCT s.name AS symbol, n.project, n.key FROM nodes n JOIN (SELECT DISTINCT name FROM result_items WHERE type = 'Method') s
ON n.qualified_name = s.name OR n.name = s.name OR n.local_name = s.name OR ends_with(n.qualified_name, ':' || s.name) OR ends_with(n.qualified_name, '.' || s.name)""")
def p_symbol_match(spark, sf_dir):
    # an equi-join on the ends of a qualified name instead of an OR of suffix tests
    n = _g(spark, sf_dir).nodes.select("project", "key", "qualified_name", "name", "local_name").distinct()
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split("local", r"[.]"))), lambda i: F.array_join(F.slice(F.split("local", r"[.]"), i, F.size(F.split("local", r"[.]"))), "."))
    local = n.withColumn("local", F.coalesce(names.qn_local(F.col("qualified_name")), F.col("qualified_name"), F.lit("")))
    candidates = F.array_distinct(F.array_compact(F.concat(F.array("qualified_name", "name", "local_name"), ends, F.array(F.substring_index("qualified_name", ".", -1)))))
    wide = local.select("project", "key", F.explode(candidates).alias("symbol"))
    symbols = table(spark, sf_dir, "result_items").where("type = 'Method'").select(F.col("name").alias("symbol")).distinct()
    return wide.join(symbols, "symbol").select("symbol", "project", "key").distinct()


@query("""SELECT symbol, qualified_name, project FROM (SELECT s.name AS symbol, n.qualified_name, n.project, row_number() OVER (PARTITION BY s.name ORDER BY n.qualified_name, n.project) AS r
FROM (SELECT DISTINCT project, name, qualified_name FROM nodes WHERE label IN ('Function', 'Method', 'Class', 'Interface')) n JOIN (SELECT DISTINCT name FROM result_items) s ON n.name = s.name) WHERE r = 1""")
def p_first_match(spark, sf_dir):
    n = _g(spark, sf_dir).scan("Function", "Method", "Class", "Interface").select("project", F.col("name").alias("symbol"), "qualified_name").distinct()
    s = table(spark, sf_dir, "result_items").select(F.col("name").alias("symbol")).distinct()
    first = n.join(s, "symbol").groupBy("symbol").agg(F.min(F.struct("qualified_name", "project")).alias("m"))
    return first.select("symbol", "m.qualified_name", "m.project")


@query("SELECT DISTINCT project, coalesce(nullif(trim(name), ''), nullif(trim(qualified_name), ''), nullif(trim(key), '')) AS title, 1.0::DOUBLE AS confidence FROM nodes")
def p_projection(spark, sf_dir):
    n = _g(spark, sf_dir).nodes
    return n.select("project", names.first_of(n.columns, ["caller_name", "name", "qualified_name", "key"]).alias("title"), F.lit(1.0).alias("confidence")).distinct()


@query("SELECT DISTINCT project, key, label FROM nodes WHERE project = 'kestrel-graph'")
def p_project_scope(spark, sf_dir):
    return _g(spark, sf_dir).scoped("kestrel-graph").nodes.select("project", "key", "label").distinct()


@query("SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_filter(members, lambda m: m IS NOT NULL))), '|') AS members FROM communities WHERE members IS NOT NULL")
def p_compact_array(spark, sf_dir):
    c = table(spark, sf_dir, "communities").where("members is not null")
    return c.select("id", F.array_join(F.array_sort(F.array_distinct(F.array_compact("members"))), "|").alias("members")).distinct()


# -- joins -----------------------------------------------------------------------------------------------------
@query(f"WITH {CALLS}, {NODE} SELECT c.project, c.src, s.name AS src_name, c.dst, t.name AS dst_name FROM calls c JOIN node s ON s.project = c.project AND s.key = c.src JOIN node t ON t.project = c.project AND t.key = c.dst")
def j_expand_1hop(spark, sf_dir):
    return _g(spark, sf_dir).expand("CALLS").select("project", "src", "src_name", "dst", "dst_name")


@query(f"""WITH {NODE} SELECT DISTINCT e.project, e.src_key AS src, e.dst_key AS dst FROM edges e JOIN node s ON s.project = e.project AND s.key = e.src_key AND s.label = 'Class'
JOIN node t ON t.project = e.project AND t.key = e.dst_key AND t.label = 'Method' WHERE rel_type = 'DEFINES_METHOD'""")
def j_expand_labels(spark, sf_dir):
    return _g(spark, sf_dir).expand("DEFINES_METHOD", source=("Class",), target=("Method",)).select("project", "src", "dst")


@query("SELECT DISTINCT project, src_key AS src, dst_key AS dst FROM edges WHERE rel_type IN ('DEFINES', 'DEFINES_METHOD')")
def j_expand_multi_type(spark, sf_dir):
    return _g(spark, sf_dir).rel("DEFINES", "DEFINES_METHOD")


@query(f"""WITH {NODE} SELECT n.project, n.key AS src, t.key AS dst FROM node n LEFT JOIN (SELECT DISTINCT e.project, e.src_key, t.key FROM edges e JOIN node t ON t.project = e.project AND t.key = e.dst_key WHERE rel_type = 'CALLS') t
ON t.project = n.project AND t.src_key = n.key WHERE n.label IN ('Function', 'Method')""")
def j_optional_expand(spark, sf_dir):
    return _g(spark, sf_dir).expand("CALLS", source=("Function", "Method"), how="left").select("project", "src", "dst")


@query(f"""WITH {CALLS}, {NODE} SELECT n.project, n.key, count(c.src) AS callers FROM node n LEFT JOIN calls c ON c.project = n.project AND c.dst = n.key AND starts_with(c.src, 'src/')
WHERE n.label = 'Function' GROUP BY n.project, n.key""")
def j_optional_filtered(spark, sf_dir):
    g = _g(spark, sf_dir)
    inside = g.rel("CALLS").where(F.col("src").startswith("src/")).groupBy("project", F.col("dst").alias("key")).agg(F.count("*").alias("n"))
    return g.named("label", labels=("Function",)).join(inside, ["project", "key"], "left").select("project", "key", F.coalesce("n", F.lit(0)).alias("callers"))


@query(f"""WITH {NODE}, owner AS (SELECT DISTINCT project, src_key AS src, dst_key AS dst FROM edges WHERE rel_type IN ('DEFINES', 'DEFINES_METHOD')),
below AS (SELECT o.project, o.dst AS key, o.src AS module FROM owner o JOIN node m ON m.project = o.project AND m.key = o.src AND m.label = 'Module'
          UNION SELECT o.project, p.dst, o.src FROM owner o JOIN owner p ON p.project = o.project AND p.src = o.dst JOIN node m ON m.project = o.project AND m.key = o.src AND m.label = 'Module')
SELECT n.project, n.key, n.name, min(b.module) AS module FROM node n LEFT JOIN below b ON b.project = n.project AND b.key = n.key
WHERE n.label IN ('Function', 'Method') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.rel_type = 'CALLS' AND e.project = n.project AND (e.src_key = n.key))
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.rel_type = 'CALLS' AND e.project = n.project AND e.dst_key = n.key) GROUP BY n.project, n.key, n.name""")
def j_anti_orphans(spark, sf_dir):
    return G.orphans(_g(spark, sf_dir))


_REACH = """WITH RECURSIVE {calls}, r AS (SELECT project, {a} AS start, {b} AS finish, 1 AS depth FROM calls
UNION SELECT r.project, r.start, c.{b}, r.depth + 1 FROM r JOIN calls c ON c.project = r.project AND c.{a} = r.finish WHERE r.depth < 3)
SELECT project, start, finish, min(depth) AS depth FROM r GROUP BY project, start, finish"""


@query(_REACH.format(calls=CALLS, a="dst", b="src"))
def j_reach_callers_d3(spark, sf_dir):
    return G.reach(G.reverse(_g(spark, sf_dir).rel("CALLS")), 3).select("project", F.col("src").alias("start"), F.col("dst").alias("finish"), "depth")


@query(_REACH.format(calls=CALLS, a="src", b="dst"))
def j_reach_callees_d3(spark, sf_dir):
    return G.reach(_g(spark, sf_dir).rel("CALLS"), 3).select("project", F.col("src").alias("start"), F.col("dst").alias("finish"), "depth")


_PATHS = """WITH RECURSIVE {calls}, p AS (SELECT project, src, dst, [src, dst] AS chain, [src || chr(1) || dst] AS used, 1 AS depth FROM calls
UNION ALL SELECT p.project, p.src, c.dst, list_append(p.chain, c.dst), list_append(p.used, c.src || chr(1) || c.dst), p.depth + 1
FROM p JOIN calls c ON c.project = p.project AND c.src = p.dst WHERE p.depth < {depth} AND NOT list_contains(p.used, c.src || chr(1) || c.dst))"""


@query(_PATHS.format(calls=CALLS, depth=4) + f" SELECT project, {CHAIN} AS chain, depth FROM p ORDER BY depth DESC, project, chain")
def j_chains_forward_d4(spark, sf_dir):
    return G.paths(_g(spark, sf_dir).rel("CALLS"), 4).select("project", _chain(), "depth")


@query(_PATHS.format(calls=CALLS, depth=4) + f" SELECT project, dst AS target, {CHAIN} AS chain, depth FROM p")
def j_chains_reverse_d4(spark, sf_dir):
    found = G.paths(G.reverse(_g(spark, sf_dir).rel("CALLS")), 4)
    return found.select("project", F.col("src").alias("target"), F.array_join(F.reverse("chain"), " > ").alias("chain"), "depth")


@query(_PATHS.format(calls=CALLS, depth=5) + f", node AS (SELECT DISTINCT project, key FROM nodes WHERE label IN ('Function', 'Method')) SELECT p.project, {CHAIN} AS chain, depth FROM p JOIN node n ON n.project = p.project AND n.key = p.src WHERE p.src = p.dst AND depth >= 2")
def j_cycles_d5(spark, sf_dir):
    return G.cycles(_g(spark, sf_dir), 5).select("project", _chain(), "depth")


_OWNS = "owns AS (SELECT DISTINCT project, src_key AS src, dst_key AS dst FROM edges WHERE rel_type IN ('DEFINES', 'DEFINES_METHOD'))"


@query(f"""WITH RECURSIVE {_OWNS}, below AS (SELECT DISTINCT n.project, n.key AS src, n.key AS dst FROM nodes n WHERE label = 'Module'
UNION SELECT b.project, b.src, o.dst FROM below b JOIN owns o ON o.project = b.project AND o.src = b.dst) SELECT project, src AS module, dst AS key FROM below WHERE src <> dst""")
def j_containment_closure(spark, sf_dir):
    g = _g(spark, sf_dir)
    modules = g.scan("Module").select("project", F.col("key").alias("src"))
    return G.closure(g.rel("DEFINES", "DEFINES_METHOD"), modules).select("project", F.col("src").alias("module"), F.col("dst").alias("key"))


@query("""WITH n AS (SELECT DISTINCT project, label, key FROM nodes)
SELECT e.rel_type, count(*) AS created FROM edges e JOIN n s ON s.project = e.project AND s.label = e.src_label AND s.key = e.src_key JOIN n t ON t.project = e.project AND t.label = e.dst_label AND t.key = e.dst_key GROUP BY e.rel_type""")
def j_edge_upsert_endpoints(spark, sf_dir):
    g = _g(spark, sf_dir)
    return M.with_endpoints(g.edges, g.nodes).groupBy("rel_type").agg(F.count("*").alias("created"))


@query(f"""WITH {CALLS}, {NODE}, o AS (SELECT project, src AS key, count(*) AS outgoing FROM calls GROUP BY ALL), i AS (SELECT project, dst AS key, count(*) AS incoming FROM calls GROUP BY ALL)
SELECT n.project, n.key, n.name, o.outgoing, i.incoming FROM node n JOIN o USING (project, key) JOIN i USING (project, key) WHERE n.label IN ('Function', 'Method')""")
def j_dep_stats(spark, sf_dir):
    return G.dependency_stats(_g(spark, sf_dir))


@query("""SELECT e.project, e.src_key, n.node_id FROM (SELECT DISTINCT project, src_key FROM edges WHERE rel_type = 'CALLS') e JOIN (SELECT project, key, min(node_id) AS node_id FROM nodes GROUP BY project, key) n ON n.project = e.project AND n.key = e.src_key""")
def j_node_id_lookup(spark, sf_dir):
    g = _g(spark, sf_dir)
    ids = g.nodes.groupBy("project", "key").agg(F.min("node_id").alias("node_id"))
    return g.rel("CALLS").select("project", F.col("src").alias("src_key")).distinct().join(ids.withColumnRenamed("key", "src_key"), ["project", "src_key"])


@query("""WITH c AS (SELECT DISTINCT project, id, unnest(members) AS member FROM communities), n AS (SELECT DISTINCT project, key, label FROM nodes)
SELECT c.project, c.id, c.member, n.label FROM c JOIN n ON n.project = c.project AND n.key = c.member""")
def j_unwind_members(spark, sf_dir):
    c = table(spark, sf_dir, "communities").select("project", "id", F.explode("members").alias("member")).distinct()
    n = _g(spark, sf_dir).named("label").withColumnRenamed("key", "member")
    return c.join(n, ["project", "member"]).select("project", "id", "member", "label")


@query(f"""WITH {CALLS}, a AS (SELECT DISTINCT project, id, unnest(members) AS key FROM communities)
SELECT c.project, s.id, count(*) AS inside FROM calls c JOIN a s ON s.project = c.project AND s.key = c.src JOIN a t ON t.project = c.project AND t.key = c.dst AND s.id = t.id GROUP BY c.project, s.id""")
def j_community_edges(spark, sf_dir):
    a = table(spark, sf_dir, "communities").select("project", "id", F.explode("members").alias("key")).distinct()
    calls = _g(spark, sf_dir).rel("CALLS")
    both = calls.join(a.withColumnRenamed("key", "src"), ["project", "src"]).join(a.withColumnRenamed("key", "dst"), ["project", "dst", "id"])
    return both.groupBy("project", "id").agg(F.count("*").alias("inside"))


# -- aggregates ------------------------------------------------------------------------------------------------
@query("SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type")
def a_counts_by_type(spark, sf_dir):
    return _g(spark, sf_dir).edges.groupBy("rel_type").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def a_global_counts(spark, sf_dir):
    g = _g(spark, sf_dir)
    return G.counts(g)


@query("SELECT count(DISTINCT project || chr(1) || key) AS total FROM nodes WHERE label = 'Class'")
def a_total_single(spark, sf_dir):
    return _g(spark, sf_dir).scan("Class").select("project", "key").distinct().agg(F.count("*").alias("total"))


@query(f"""WITH {CALLS}, {NODE}, o AS (SELECT project, src AS key, count(*) AS n FROM calls GROUP BY ALL), i AS (SELECT project, dst AS key, count(*) AS n FROM calls GROUP BY ALL)
SELECT n.project, n.key, n.name, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) + coalesce(i.n, 0) AS total
FROM node n LEFT JOIN o USING (project, key) LEFT JOIN i USING (project, key) WHERE n.label IN ('Function', 'Method') AND coalesce(o.n, 0) + coalesce(i.n, 0) > 0""")
def a_hubs(spark, sf_dir):
    return G.hubs(_g(spark, sf_dir))


@query(f"""WITH {NODE} SELECT n.project, n.key, n.name, count(e.dst_key) AS in_calls FROM node n LEFT JOIN edges e ON e.rel_type = 'CALLS' AND e.project = n.project AND e.dst_key = n.key
WHERE n.label IN ('Function', 'Method') GROUP BY n.project, n.key, n.name""")
def a_in_calls(spark, sf_dir):
    return G.incoming_calls(_g(spark, sf_dir))


@query("""SELECT project, label, key, node_id, name FROM (SELECT project, label, key, node_id, name, row_number() OVER (PARTITION BY project, label, key ORDER BY node_id DESC, name DESC) AS r FROM nodes) WHERE r = 1""")
def a_dedupe_last_wins_nodes(spark, sf_dir):
    return M.last_wins(_g(spark, sf_dir).nodes.select("project", "label", "key", "node_id", "name"), ["project", "label", "key"], ["node_id", "name"])


@query("""SELECT project, rel_type, src_key, dst_key, max(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END) AS confidence FROM edges GROUP BY project, rel_type, src_key, dst_key""")
def a_dedupe_last_wins_edges(spark, sf_dir):
    e = _g(spark, sf_dir).edges.select("project", "rel_type", "src_key", "dst_key", F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence"))
    return M.last_wins(e, ["project", "rel_type", "src_key", "dst_key"], ["confidence"])


@query(f"WITH {CALLS} SELECT project, src, count(*) AS n, array_to_string(list_sort(list(dst)), '|') AS callees FROM calls GROUP BY project, src")
def a_collect_sets(spark, sf_dir):
    return _g(spark, sf_dir).rel("CALLS").groupBy("project", "src").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("dst")), "|").alias("callees"))


@query("""WITH c AS (SELECT DISTINCT project, id, unnest(members) AS member FROM communities) SELECT project, id, count(member) AS members FROM c WHERE member IS NOT NULL GROUP BY project, id HAVING count(member) >= 2""")
def a_member_groups(spark, sf_dir):
    c = table(spark, sf_dir, "communities").select("project", "id", F.explode("members").alias("member")).where("member is not null").distinct()
    return c.groupBy("project", "id").agg(F.count("member").alias("members")).where("members >= 2")


@query("SELECT max(score) AS best, round(avg(score), 6) AS mean FROM result_items WHERE score BETWEEN 0 AND 1")
def a_max_score(spark, sf_dir):
    return table(spark, sf_dir, "result_items").where("score between 0 and 1").agg(F.max("score").alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query("""WITH s AS (SELECT DISTINCT qualified_name, string_split(local_name, '.') AS parts FROM nodes WHERE local_name IS NOT NULL AND label IN ('Function', 'Method', 'Class')),
w AS (SELECT qualified_name, array_to_string(parts[i:len(parts)], '.') AS suffix FROM s, unnest(generate_series(1, len(parts))) AS t(i))
SELECT suffix, count(DISTINCT qualified_name) AS names, min(qualified_name) AS least FROM w GROUP BY suffix""")
def a_suffix_map(spark, sf_dir):
    s = _g(spark, sf_dir).scan("Function", "Method", "Class").where("local_name is not null").select("qualified_name", F.explode(names.suffixes(F.col("local_name"), ".")).alias("suffix")).distinct()
    return s.groupBy("suffix").agg(F.count("*").alias("names"), F.min("qualified_name").alias("least"))


# -- order, limits, set operations -----------------------------------------------------------------------------
@query(f"WITH {CALLS}, i AS (SELECT project, dst AS key, count(*) AS n FROM calls GROUP BY ALL) SELECT project, key, n FROM i ORDER BY n DESC, project, key LIMIT 50")
def l_topk_multi_key(spark, sf_dir):
    into = _g(spark, sf_dir).rel("CALLS").groupBy("project", F.col("dst").alias("key")).agg(F.count("*").alias("n"))
    return into.orderBy(F.desc("n"), "project", "key").limit(50)


@query("SELECT DISTINCT project, key, name FROM nodes WHERE label = 'Process' ORDER BY name, project, key")
def l_order_asc(spark, sf_dir):
    return _g(spark, sf_dir).scan("Process").select("project", "key", "name").distinct().orderBy("name", "project", "key")


@query("""WITH f AS (SELECT DISTINCT project, key FROM nodes WHERE label = 'Function'), k AS (SELECT * FROM f ORDER BY project, key LIMIT 500)
SELECT (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM k) AS returned, (SELECT count(*) FROM f) > 500 AS was_truncated""")
def l_row_cap(spark, sf_dir):
    from graphlode.functions.nlq import capped

    rows, meta = capped(_g(spark, sf_dir).scan("Function").select("project", "key").distinct(), ["project", "key"], 500)
    return meta


@query("""WITH f AS (SELECT DISTINCT project, key FROM nodes WHERE label = 'Function'), t AS (SELECT project, key, sum(ceil(length(key) / 4.0)) OVER (PARTITION BY project ORDER BY key) AS used FROM f)
SELECT project, key FROM t WHERE used <= 2000""")
def l_token_budget(spark, sf_dir):
    f = _g(spark, sf_dir).scan("Function").select("project", "key").distinct()
    return M.token_budget(f, ["key"], F.col("key"), 2000, ["project"])


@query(_PATHS.format(calls=CALLS, depth=3) + f" SELECT project, {CHAIN} AS chain, depth FROM p ORDER BY depth DESC, project, chain LIMIT 50")
def l_longest_paths(spark, sf_dir):
    return G.paths(_g(spark, sf_dir).rel("CALLS"), 3).select("project", _chain(), "depth").orderBy(F.desc("depth"), "project", "chain").limit(50)


@query("SELECT project, src_key AS key FROM edges WHERE rel_type = 'CALLS' UNION SELECT project, dst_key FROM edges WHERE rel_type = 'CALLS'")
def u_union_distinct(spark, sf_dir):
    e = _g(spark, sf_dir).rel("CALLS", distinct=False)
    return e.select("project", F.col("src").alias("key")).union(e.select("project", "dst")).distinct()


@query("SELECT project, src_key AS key FROM edges WHERE rel_type = 'CALLS' EXCEPT SELECT project, dst_key FROM edges WHERE rel_type = 'CALLS'")
def u_difference(spark, sf_dir):
    e = _g(spark, sf_dir).rel("CALLS")
    return e.select("project", F.col("src").alias("key")).subtract(e.select("project", "dst"))


@query("SELECT project, src_key AS key FROM edges WHERE rel_type = 'CALLS' INTERSECT SELECT project, dst_key FROM edges WHERE rel_type = 'CALLS'")
def u_intersect(spark, sf_dir):
    e = _g(spark, sf_dir).rel("CALLS")
    return e.select("project", F.col("src").alias("key")).intersect(e.select("project", "dst"))


@query("SELECT DISTINCT project, array_to_string(trace, ' > ') AS trace FROM nodes WHERE label = 'Process' AND trace IS NOT NULL")
def u_distinct_traces(spark, sf_dir):
    return _g(spark, sf_dir).scan("Process").where("trace is not null").select("project", F.array_join("trace", " > ").alias("trace")).distinct()


# -- mutations -------------------------------------------------------------------------------------------------
@query("""WITH o AS (SELECT project, label, key, max(docstring) AS docstring, max(start_line) AS start_line FROM nodes GROUP BY ALL),
b AS (SELECT project, 'Function' AS label, qualified_name AS key, max(docstring) AS docstring, max(start_line) AS start_line FROM result_items WHERE type = 'Function' GROUP BY project, qualified_name)
SELECT coalesce(b.project, o.project) AS project, coalesce(b.label, o.label) AS label, coalesce(b.key, o.key) AS key, coalesce(b.docstring, o.docstring) AS docstring, coalesce(b.start_line, o.start_line) AS start_line
FROM o FULL OUTER JOIN b ON o.project = b.project AND o.label = b.label AND o.key = b.key""")
def m_upsert_merge_props(spark, sf_dir):
    old = _g(spark, sf_dir).nodes.groupBy("project", "label", "key").agg(F.max("docstring").alias("docstring"), F.max("start_line").alias("start_line"))
    items = table(spark, sf_dir, "result_items").where("type = 'Function'")
    new = items.groupBy("project", F.lit("Function").alias("label"), F.col("qualified_name").alias("key")).agg(F.max("docstring").alias("docstring"), F.max("start_line").alias("start_line"))
    return M.upsert_nodes(old, new)


@query("""SELECT DISTINCT project, key, CASE WHEN label = 'Module' THEN 'indexed' ELSE kind END AS kind FROM nodes""")
def m_partial_update(spark, sf_dir):
    n = _g(spark, sf_dir).nodes.select("project", "label", "key", "kind")
    return M.update(n, F.col("label") == "Module", kind="indexed").select("project", "key", "kind").distinct()


@query("""WITH gone AS (SELECT DISTINCT project, label, key FROM nodes WHERE label = 'Method' AND is_exported = false)
SELECT e.project, e.rel_type, e.src_key, e.dst_key, count(*) AS n FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.project = e.project AND g.label = e.src_label AND g.key = e.src_key)
AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.project = e.project AND g.label = e.dst_label AND g.key = e.dst_key) GROUP BY ALL""")
def m_detach_delete(spark, sf_dir):
    g = _g(spark, sf_dir)
    _, edges = M.detach_delete(g.nodes, g.edges, g.scan("Method", is_exported=False))
    return edges.groupBy("project", "rel_type", "src_key", "dst_key").agg(F.count("*").alias("n"))


@query("SELECT project, label, count(*) AS n FROM nodes WHERE project <> 'fellside' GROUP BY ALL")
def m_delete_project(spark, sf_dir):
    g = _g(spark, sf_dir)
    return M.delete_project(g.nodes, g.edges, "fellside")[0].groupBy("project", "label").agg(F.count("*").alias("n"))


@query("SELECT project, label, key, count(*) AS n FROM nodes GROUP BY ALL HAVING count(*) > 1")
def m_constraint_violations(spark, sf_dir):
    return M.violations(_g(spark, sf_dir).nodes)


@query("SELECT DISTINCT project FROM nodes ORDER BY project")
def m_list_projects(spark, sf_dir):
    return _g(spark, sf_dir).nodes.select("project").distinct().orderBy("project")


@query("SELECT project, count(*) AS n FROM edges WHERE rel_type <> 'CALLS' GROUP BY project")
def m_delete_type(spark, sf_dir):
    return M.delete_relations(_g(spark, sf_dir).edges, "CALLS").groupBy("project").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE owns AS (SELECT DISTINCT project, src_key AS src, dst_key AS dst FROM edges WHERE rel_type IN ('DEFINES', 'DEFINES_METHOD')),
below AS (SELECT DISTINCT project, key AS dst FROM nodes WHERE label = 'Module' AND extension = '.go' UNION SELECT b.project, o.dst FROM below b JOIN owns o ON o.project = b.project AND o.src = b.dst)
SELECT label, count(*) AS n FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM below b WHERE b.project = n.project AND b.dst = n.key) GROUP BY label""")
def m_delete_modules(spark, sf_dir):
    g = _g(spark, sf_dir)
    starts = g.scan("Module", extension=".go").select("project", F.col("key").alias("src"))
    below = G.closure(g.rel("DEFINES", "DEFINES_METHOD"), starts, include_start=True).select("project", F.col("dst").alias("key")).distinct()
    return g.nodes.join(below, ["project", "key"], "left_anti").groupBy("label").agg(F.count("*").alias("n"))


# -- communities, processes, retrieval -------------------------------------------------------------------------
_DIRS = """code AS (SELECT project, key, any_value(file_path) AS file_path FROM nodes WHERE label IN ('Function', 'Method', 'Class', 'Module') AND file_path IS NOT NULL GROUP BY project, key),
dirs AS (SELECT project, key, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, file_path FROM code),
assigned AS (SELECT project, key, directory, file_path, dense_rank() OVER (PARTITION BY project ORDER BY directory) - 1 AS community FROM dirs)"""


@query(f"WITH {_DIRS} SELECT project, CAST(community AS INTEGER) AS community, key, directory FROM assigned")
def g_dir_communities(spark, sf_dir):
    return G.directory_communities(_g(spark, sf_dir))


@query(f"""WITH {CALLS}, {_DIRS}, size AS (SELECT project, community, count(*) AS symbol_count, count(DISTINCT file_path) AS files, any_value(directory) AS directory, any_value(file_path) AS a_file FROM assigned GROUP BY ALL HAVING count(*) >= 2),
inside AS (SELECT c.project, s.community, count(*) AS calls FROM calls c JOIN assigned s ON s.project = c.project AND s.key = c.src JOIN assigned t ON t.project = c.project AND t.key = c.dst AND s.community = t.community GROUP BY ALL)
SELECT s.project, s.project || '::community::' || s.community AS id, s.directory || ' (#' || s.community || ')' AS name, s.directory AS heuristic_label, symbol_count, round(coalesce(i.calls, 0) / symbol_count, 6) AS cohesion
FROM size s LEFT JOIN inside i ON i.project = s.project AND i.community = s.community""")
def g_community_nodes(spark, sf_dir):
    g = _g(spark, sf_dir)
    return G.materialise_communities(g, G.directory_communities(g))


@query()
def g_label_propagation(spark, sf_dir):
    return G.label_propagation(_g(spark, sf_dir).rel("CALLS"))


_FLOW = f"""WITH RECURSIVE own AS (SELECT project, key, any_value(name) AS name FROM nodes WHERE label IN ('Function', 'Method') GROUP BY project, key), {CALLS},
e AS (SELECT c.* FROM calls c JOIN own s ON s.project = c.project AND s.key = c.src JOIN own t ON t.project = c.project AND t.key = c.dst WHERE src <> dst),
fan AS (SELECT project, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY project, src ORDER BY dst) AS r FROM e) WHERE r <= 4),
entry AS (SELECT project, key FROM own o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.project = o.project AND e.dst = o.key) OR regexp_matches(name, '^(main|run|handle.*|on[A-Z_].*|register.*)$')),
flow AS (SELECT project, key AS last, [key] AS trace FROM entry UNION ALL
         SELECT f.project, n.dst, list_append(f.trace, n.dst) FROM flow f JOIN fan n ON n.project = f.project AND n.src = f.last WHERE len(f.trace) < 10 AND NOT list_contains(f.trace, n.dst)),
ended AS (SELECT DISTINCT f.project, f.trace FROM flow f WHERE len(f.trace) >= 3 AND (len(f.trace) = 10 OR NOT EXISTS (SELECT 1 FROM fan n WHERE n.project = f.project AND n.src = f.last AND NOT list_contains(f.trace, n.dst)))),
ranked AS (SELECT project, trace, row_number() OVER (PARTITION BY project ORDER BY trace[1], len(trace), trace) AS n FROM ended),
kept AS (SELECT * FROM ranked WHERE n <= 500)"""


@query(f"""{_FLOW} SELECT k.project, k.project || '::process::' || k.n AS id, a.name || '_to_' || z.name AS name, len(trace) AS steps, array_to_string(trace, ' > ') AS trace
FROM kept k JOIN own a ON a.project = k.project AND a.key = trace[1] JOIN own z ON z.project = k.project AND z.key = trace[-1]""")
def g_process_traces(spark, sf_dir):
    return G.processes(_g(spark, sf_dir)).select("project", "id", "name", F.col("steps").cast("long").alias("steps"), F.array_join("trace", " > ").alias("trace"))


@query(f"""{_FLOW} SELECT project, project || '::process::' || n AS id, i - 1 AS step_index, trace[i] AS key FROM kept, unnest(generate_series(1, len(trace))) AS t(i)""")
def g_has_step(spark, sf_dir):
    return G.steps(G.processes(_g(spark, sf_dir))).withColumn("step_index", F.col("step_index").cast("long"))


@query("SELECT DISTINCT project, key AS id, name, symbol_count FROM nodes WHERE label = 'Community' AND contains(name, '#') ORDER BY symbol_count DESC, id, project LIMIT 50")
def g_list_communities(spark, sf_dir):
    return G.listed(_g(spark, sf_dir).nodes, "Community", "#", 50)


@query("SELECT DISTINCT project, key AS id, name, step_count FROM nodes WHERE label = 'Process' AND contains(name, '_to_') ORDER BY step_count DESC, id, project LIMIT 50")
def g_list_processes(spark, sf_dir):
    return G.listed(_g(spark, sf_dir).nodes, "Process", "_to_", 50)


@query(f"""WITH {CALLS}, c AS (SELECT e.project, e.src_key, e.dst_key, max(coalesce(CASE WHEN isnan(confidence) THEN 'NaN'::DOUBLE ELSE confidence END, 1.0)) AS confidence FROM edges e WHERE rel_type = 'CALLS' GROUP BY ALL),
s AS (SELECT min(n.name) AS s FROM edges e JOIN nodes n ON n.project = e.project AND n.key = e.dst_key WHERE rel_type = 'CALLS'),
target AS (SELECT DISTINCT project, key FROM nodes, s WHERE qualified_name = s OR name = s OR local_name = s OR ends_with(qualified_name, ':' || s) OR ends_with(qualified_name, '.' || s)),
n AS (SELECT DISTINCT project, key, qualified_name, name, label FROM nodes)
SELECT n.project, n.qualified_name, n.name, n.label, max(c.confidence) AS confidence, 1 AS depth FROM target t JOIN c ON c.project = t.project AND c.dst_key = t.key JOIN n ON n.project = c.project AND n.key = c.src_key
GROUP BY n.project, n.qualified_name, n.name, n.label ORDER BY n.qualified_name, n.project LIMIT 50""")
def g_callers(spark, sf_dir):
    g = _g(spark, sf_dir)
    called = g.expand("CALLS").agg(F.min("dst_name")).first()[0]
    return G.callers(g, called or "")


@query("""WITH w AS (SELECT DISTINCT qualified_name AS symbol FROM nodes WHERE label IN ('Function', 'Method')),
i AS (SELECT qualified_name, file_path, source_code, row_number() OVER (PARTITION BY qualified_name ORDER BY coalesce(length(source_code), -1) DESC, file_path DESC, source_code DESC NULLS LAST) AS r FROM code_snippets WHERE found)
SELECT w.symbol, coalesce(trim(i.source_code), '') <> '' AS found, CASE WHEN i.qualified_name IS NULL THEN 'symbol not found' WHEN coalesce(trim(i.source_code), '') = '' THEN 'no source' END AS error,
i.file_path, CASE WHEN coalesce(trim(i.source_code), '') <> '' THEN i.source_code END AS source FROM w LEFT JOIN i ON i.qualified_name = w.symbol AND i.r = 1""")
def g_snippets(spark, sf_dir):
    symbols = _g(spark, sf_dir).scan("Function", "Method").select(F.col("qualified_name").alias("symbol"))
    return G.snippets(table(spark, sf_dir, "code_snippets").where("found"), symbols)


@query("""SELECT file_path, entry, exit FROM (SELECT DISTINCT e.project, n.file_path, min(n.key) OVER (PARTITION BY e.project, n.file_path) AS entry, max(n.key) OVER (PARTITION BY e.project, n.file_path) AS exit, e.project AS p
FROM (SELECT DISTINCT project, dst_key FROM edges WHERE rel_type = 'HAS_STEP') e JOIN nodes n ON n.project = e.project AND n.key = e.dst_key)""")
def w_first_last(spark, sf_dir):
    g = _g(spark, sf_dir)
    hit = g.rel("HAS_STEP").select("project", F.col("dst").alias("key")).distinct().join(g.named("file_path"), ["project", "key"])
    return hit.groupBy("project", "file_path").agg(F.min("key").alias("entry"), F.max("key").alias("exit")).select("file_path", "entry", "exit")


@query("""SELECT project, src_key, dst_key, r FROM (SELECT project, src_key, dst_key, row_number() OVER (PARTITION BY project, src_key ORDER BY dst_key) AS r FROM (SELECT DISTINCT project, src_key, dst_key FROM edges WHERE rel_type = 'CALLS')) WHERE r <= 4""")
def w_fan_out_cap(spark, sf_dir):
    e = _g(spark, sf_dir).rel("CALLS").select("project", F.col("src").alias("src_key"), F.col("dst").alias("dst_key"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("project", "src_key").orderBy("dst_key"))).where("r <= 4")


_SYMBOL = """s AS (SELECT min(n.name) AS s FROM edges e JOIN nodes n ON n.project = e.project AND n.key = e.dst_key WHERE rel_type = 'CALLS'),
first AS (SELECT n.project, n.qualified_name FROM nodes n, s WHERE n.qualified_name = s OR (n.name = s AND label IN ('Function', 'Method', 'Class', 'Interface')) OR n.local_name = s OR ends_with(n.qualified_name, ':' || s) OR ends_with(n.qualified_name, '.' || s) ORDER BY n.qualified_name, n.project LIMIT 1),
target AS (SELECT DISTINCT n.project, n.key FROM nodes n JOIN first f ON f.project = n.project AND n.qualified_name = f.qualified_name)"""


def _called(g: G.Graph) -> str:
    return g.expand("CALLS").agg(F.min("dst_name")).first()[0] or ""


@query(f"""WITH RECURSIVE {CALLS}, {_SYMBOL}, n AS (SELECT DISTINCT project, key, qualified_name, name, label FROM nodes),
up AS (SELECT t.project, c.src AS key, 1 AS depth FROM target t JOIN calls c ON c.project = t.project AND c.dst = t.key UNION SELECT u.project, c.src, u.depth + 1 FROM up u JOIN calls c ON c.project = u.project AND c.dst = u.key WHERE u.depth < 3),
down AS (SELECT t.project, c.dst AS key, 1 AS depth FROM target t JOIN calls c ON c.project = t.project AND c.src = t.key UNION SELECT u.project, c.dst, u.depth + 1 FROM down u JOIN calls c ON c.project = u.project AND c.src = u.key WHERE u.depth < 3),
a AS (SELECT 'caller' AS direction, n.qualified_name, n.name, n.label, min(u.depth) AS depth FROM up u JOIN n ON n.project = u.project AND n.key = u.key GROUP BY ALL ORDER BY n.qualified_name LIMIT 50),
b AS (SELECT 'callee' AS direction, n.qualified_name, n.name, n.label, min(u.depth) AS depth FROM down u JOIN n ON n.project = u.project AND n.key = u.key GROUP BY ALL ORDER BY n.qualified_name LIMIT 50)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def g_dependency_report(spark, sf_dir):
    g = _g(spark, sf_dir)
    return G.dependency_report(g, _called(g), depth=3).select("direction", "qualified_name", "name", "label", "depth")


@query(_PATHS.format(calls=CALLS, depth=5) + f""", {_SYMBOL} SELECT p.project, {CHAIN} AS chain, depth FROM p JOIN target t ON t.project = p.project AND t.key = p.dst ORDER BY depth DESC, p.project, list_reverse(chain) LIMIT 50""")
def g_reverse_chains(spark, sf_dir):
    g = _g(spark, sf_dir)
    row = g.nodes.where(G.match_symbol(_called(g), typed=True)).orderBy("qualified_name", "project").select("project", "qualified_name").first()
    own = g.scoped(row["project"]) if row else g
    return G.call_chains(own, row["qualified_name"] if row else "", 5, inward=True).select("project", _chain(), "depth")


@query("""WITH v AS (SELECT id, project, qualified_name, embedding FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS r FROM vectors) WHERE r = 1 AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT embedding AS q FROM v ORDER BY id LIMIT 1), hit AS (SELECT v.id, v.project, v.qualified_name, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM v, q ORDER BY s DESC, v.id LIMIT 10),
n AS (SELECT project, qualified_name, min(start_line) AS start_line FROM nodes GROUP BY ALL)
SELECT h.id, round(h.s, 3) AS score, n.start_line FROM hit h LEFT JOIN n ON n.project = h.project AND n.qualified_name = h.qualified_name""")
def g_semantic_search(spark, sf_dir):
    """The ten vectors most like the first one, with their place in the graph."""
    from graphlode.operators import similarity as S

    v = table(spark, sf_dir, "vectors")
    latest = v.groupBy("id").agg(F.max_by(F.struct("project", "qualified_name", "embedding"), "indexed_at").alias("v")).select("id", "v.*")
    good = latest.where(S.usable(F.col("embedding"), 96))
    first = good.orderBy("id").select("embedding").first()
    hits = S.top_k(good, [float(x) for x in first[0]] if first else [0.0] * 96, 10)
    n = _g(spark, sf_dir).nodes.groupBy("project", "qualified_name").agg(F.min("start_line").alias("start_line"))
    return hits.join(n, ["project", "qualified_name"], "left").select("id", F.round("score", 3).alias("score"), "start_line")


QUERIES, ORACLES = query.queries, query.oracles
