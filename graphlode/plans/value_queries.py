"""Queries of functions, vectors, files, incremental steps and retrieval over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlode.functions import names
from graphlode.operators import mutate as M
from graphlode.operators import resolve as R
from graphlode.operators import similarity as S
from graphlode.plans.registry import Registry
from graphlode.plans.session import table
from graphlode.sources import scan
from graphlode.sources.extract import facts

query = Registry()
QN = "SELECT DISTINCT qualified_name AS qn FROM nodes WHERE qualified_name IS NOT NULL"


def _qns(spark, sf_dir):
    return table(spark, sf_dir, "nodes").select(F.col("qualified_name").alias("qn")).where("qn is not null").distinct()


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "nodes").where("label = 'Module'").select("project", "path").where("path is not null").distinct()


# -- names and text --------------------------------------------------------------------------------------------
@query(f"WITH q AS ({QN}) SELECT qn, CASE WHEN contains(qn, ':') THEN regexp_extract(qn, '^(.*):[^:]*$', 1) ELSE qn END AS path, CASE WHEN contains(qn, ':') THEN regexp_extract(qn, ':([^:]*)$', 1) END AS local, CASE WHEN contains(qn, ':') THEN regexp_extract(qn, '^(.*):[^:]*$', 1) || ':' || regexp_extract(qn, ':([^:]*)$', 1) ELSE qn END AS built FROM q")
def f_qn_build_parse(spark, sf_dir):
    q = _qns(spark, sf_dir)
    path, local = names.qn_path(F.col("qn")), names.qn_local(F.col("qn"))
    return q.select("qn", path.alias("path"), local.alias("local"), F.when(local.isNull(), path).otherwise(names.build_qn(path, local)).alias("built"))


@query(f"""WITH q AS ({QN}), p AS (SELECT qn, CASE WHEN contains(qn, ':') THEN regexp_extract(qn, ':([^:]*)$', 1) END AS local FROM q)
SELECT qn, regexp_extract(coalesce(local, regexp_extract(qn, '([^/]*)$', 1)), '([^.]*)$', 1) AS short, CASE WHEN contains(local, '.') THEN regexp_extract(local, '^(.*)\\.[^.]*$', 1) END AS container FROM p""")
def f_short_container(spark, sf_dir):
    return _qns(spark, sf_dir).select("qn", names.short_name(F.col("qn")).alias("short"), names.container_name(F.col("qn")).alias("container"))


@query(r"""SELECT DISTINCT path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '[^./](\.[^./]+)$', 1) AS ext,
regexp_replace(path, '\.(tsx?|jsx?|mjs|cjs|py|go|rs|java|php|cs|cpp|c|h|hpp)$', '') AS bare FROM nodes WHERE label = 'Module' AND path IS NOT NULL""")
def f_paths(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("path").distinct().select("path", names.dirname(p).alias("dir"), names.basename(p).alias("base"), names.extension(p).alias("ext"), names.strip_extension(p).alias("bare"))


@query(r"""SELECT DISTINCT path, regexp_replace(path, '[^/]+/[^/]+$', '') || 'x.ts' AS resolved FROM nodes WHERE label = 'Module' AND regexp_matches(path, '^[^/]+/[^/]+/')""")
def f_relative_path(spark, sf_dir):
    p = _paths(spark, sf_dir).select("path").distinct().where(F.col("path").rlike("^[^/]+/[^/]+/"))
    return p.select("path", names.resolve_relative(names.dirname(F.col("path")), F.lit("../y/.././x.ts")).alias("resolved"))


@query("""WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM nodes WHERE label = 'Module' AND path IS NOT NULL)
SELECT path, array_to_string(parts[i:len(parts)], '/') AS suffix FROM p, unnest(generate_series(1, len(parts))) AS t(i)""")
def f_suffixes(spark, sf_dir):
    return _paths(spark, sf_dir).select("path").distinct().select("path", F.explode(names.suffixes(F.col("path"))).alias("suffix"))


@query(f"WITH q AS ({QN}) SELECT qn, CASE WHEN length(qn) <= 64 THEN qn ELSE substr(sha256(qn), 1, 16) || '_' || right(qn, 47) END AS id FROM q")
def f_docid(spark, sf_dir):
    return _qns(spark, sf_dir).select("qn", names.doc_id(F.col("qn")).alias("id"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def f_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT DISTINCT qualified_name || chr(10) || substr(source_code, 1, 500) AS text FROM result_items WHERE source_code IS NOT NULL")
def f_embedding_text(spark, sf_dir):
    return table(spark, sf_dir, "result_items").where("source_code is not null").select(names.embedding_text(F.col("qualified_name"), F.col("source_code")).alias("text")).distinct()


@query(r"SELECT DISTINCT name, regexp_matches(name, '^(main|run|handle.*|on[A-Z_].*|register.*)$') AS entry FROM nodes WHERE name IS NOT NULL")
def f_entry_name(spark, sf_dir):
    return table(spark, sf_dir, "nodes").where("name is not null").select("name", names.is_entry_name(F.col("name")).alias("entry")).distinct()


@query("SELECT item_id, coalesce(labels[1], 'Unknown') AS kind, count(*) AS n FROM result_items GROUP BY ALL")
def f_extract_type(spark, sf_dir):
    return table(spark, sf_dir, "result_items").select("item_id", F.coalesce(F.get("labels", F.lit(0)), F.lit("Unknown")).alias("kind")).groupBy("item_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT item_id, count(*) AS n, max(CASE WHEN isnan(score) THEN NULL ELSE floor(score * 1000 + 0.5) / 1000 END) AS score FROM result_items GROUP BY item_id")
def f_round3(spark, sf_dir):
    r = table(spark, sf_dir, "result_items")
    return r.groupBy("item_id").agg(F.count("*").alias("n"), F.max(F.when(~F.isnan("score"), F.floor(F.col("score") * 1000 + 0.5) / 1000)).alias("score"))


@query()
def f_type_simplify(spark, sf_dir):
    found = facts(scan_files(spark, sf_dir))
    return found.where("kind = 'return' and target is not null").select("target", names.simple_type(F.col("target")).alias("simple")).distinct()


_TYPES = [
    ("User", "User"), (": User", "User"), ("User | null", "User"), ("undefined | User", "User"), ("User[]", "User"), ("Array<User>", "User"), ("Promise<User>", "User"), ("Promise<User | undefined>", "User"), ("Map<string, User>", "User"), ("Record<string, User[]>", "User"),
    ("Optional[User]", "User"), ("list[User]", "User"), ("dict[str, User]", "User"), ("User | None", "User"), ("Vec<User>", "User"), ("Option<Box<User>>", "User"), ("HashMap<String, Vec<User>>", "User"), ("User?", "User"), ("Repo<User>", "Repo"), ("ns.User", "ns.User"), ("string", "string"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TYPES) + ") t(target, simple)")
def f_type_simplify_fixed(spark, sf_dir):
    """Annotations with the class they are about; the SQL has the expected rows."""
    return spark.createDataFrame([(a,) for a, _ in _TYPES], "target string").select("target", names.simple_type(F.col("target")).alias("simple"))


# -- vectors ---------------------------------------------------------------------------------------------------
_QUERY = "query AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_COS = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6)"


def _first(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    row = e.orderBy("vec_id").select("embedding").first()
    return e, [float(x) for x in row[0]] if row else []


@query(f"WITH {_QUERY} SELECT vec_id, {_COS} AS score FROM embeddings, query ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id LIMIT 10")
def v_cosine_topk(spark, sf_dir):
    e, q = _first(spark, sf_dir)
    return S.top_k(e, q, 10, id_col="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_QUERY} SELECT vec_id, {_COS} AS score FROM embeddings, query WHERE label = 1 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id LIMIT 5")
def v_filtered_topk(spark, sf_dir):
    e, q = _first(spark, sf_dir)
    return S.top_k(e, q, 5, id_col="vec_id", label=1).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_QUERY} SELECT vec_id, {_COS} AS score FROM embeddings, query WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) >= 0.2")
def v_min_score(spark, sf_dir):
    e, q = _first(spark, sf_dir)
    return e.select("vec_id", S.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q])).alias("s")).where("s >= 0.2").select("vec_id", F.round("s", 6).alias("score"))


@query(f"WITH {_QUERY} SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS d FROM embeddings, query")
def v_euclid(spark, sf_dir):
    e, q = _first(spark, sf_dir)
    return e.select("vec_id", F.round(S.euclid(F.col("embedding"), F.array(*[F.lit(x) for x in q])), 6).alias("d"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings)")
def v_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", S.normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(S.dot(F.col("v"), F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


@query("""WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m, count(*) AS n FROM embeddings, unnest(generate_series(1, len(embedding))) AS t(i) GROUP BY label, i)
SELECT label, max(n) AS n, round(sum(m), 5) AS total FROM x GROUP BY label""")
def a_vector_mean(spark, sf_dir):
    m = S.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return m.select("label", "n", F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("""SELECT id, project FROM (SELECT id, project, row_number() OVER (PARTITION BY id ORDER BY coalesce(indexed_at, TIMESTAMP '0001-01-01') DESC, project) AS r FROM vectors WHERE id IS NOT NULL) WHERE r = 1""")
def v_store_latest(spark, sf_dir):
    v = table(spark, sf_dir, "vectors").where("id is not null")
    at = F.coalesce("indexed_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    top = v.groupBy("id").agg(F.max(at).alias("at"))
    return v.select("id", "project", at.alias("at")).join(top, ["id", "at"]).groupBy("id").agg(F.min("project").alias("project"))


@query("SELECT round(max(score), 6) AS best, coalesce(max(score) < 0.35, true) AS low FROM result_items WHERE score BETWEEN 0 AND 1")
def g_low_confidence(spark, sf_dir):
    hits = S.low_confidence(table(spark, sf_dir, "result_items").where("score between 0 and 1"))
    return hits.select(F.round("best", 6).alias("best"), "low")


@query()
def v_hashed_search(spark, sf_dir):
    items = table(spark, sf_dir, "result_items").where("source_code is not null").select("item_id", S.hashed_embedding(F.col("source_code")).alias("embedding")).dropDuplicates(["item_id"])
    q = spark.range(1).select(S.hashed_embedding(F.lit("drain the retry queue")).alias("q")).first()[0]
    return S.top_k(items, list(q), 10, id_col="item_id").select("item_id", F.round("score", 6).alias("score"))


# -- files -----------------------------------------------------------------------------------------------------
def scan_files(spark, sf_dir):
    """(project, path, text): whole files, the latest text of each."""
    whole = table(spark, sf_dir, "code_snippets").where("found and qualified_name = file_path and source_code is not null")
    last = whole.groupBy("project", F.col("file_path").alias("path")).agg(F.max_by("source_code", F.struct(F.coalesce("retrieved_at", F.lit("0001-01-01").cast("timestamp_ntz")), "source_code")).alias("text"))
    return last


_FILES = """files AS (SELECT project, file_path AS path, source_code AS text FROM (SELECT *, row_number() OVER (PARTITION BY project, file_path ORDER BY coalesce(retrieved_at, TIMESTAMP '0001-01-01') DESC, source_code DESC) AS r
FROM code_snippets WHERE found AND qualified_name = file_path AND source_code IS NOT NULL) WHERE r = 1)"""


@query(f"WITH {_FILES} SELECT project, path, sha256(text) AS sha256 FROM files")
def s_sha256(spark, sf_dir):
    return scan_files(spark, sf_dir).select("project", "path", F.sha2("text", 256).alias("sha256"))


@query("""WITH p AS (SELECT DISTINCT file_path AS path FROM vectors WHERE file_path IS NOT NULL), x AS (SELECT path, string_split(path, '/') AS parts FROM p)
SELECT path, len(list_intersect(parts, ['node_modules', 'vendor', 'build', 'site-packages', 'dist', 'bin', 'out', 'target', 'obj', 'env', 'venv', 'tmp', 'temp', 'coverage'])) > 0 AS skip FROM x""")
def s_ignore_paths(spark, sf_dir):
    p = table(spark, sf_dir, "vectors").select(F.col("file_path").alias("path")).where("path is not null").distinct()
    return p.select("path", scan.skipped(F.col("path")).alias("skip"))


@query(r"""SELECT language, count(*) AS files FROM (SELECT DISTINCT file_path, CASE regexp_extract(file_path, '\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' END AS language FROM vectors WHERE file_path IS NOT NULL) GROUP BY language""")
def s_language(spark, sf_dir):
    p = table(spark, sf_dir, "vectors").select("file_path").where("file_path is not null").distinct()
    return p.select(scan.language(F.col("file_path")).alias("language")).groupBy("language").agg(F.count("*").alias("files"))


@query(f"""WITH {_FILES}, s AS (SELECT DISTINCT project, qualified_name, file_path, line_start, line_end FROM code_snippets WHERE found AND qualified_name <> file_path AND line_start IS NOT NULL AND line_end >= line_start)
SELECT s.project, s.qualified_name, s.line_start, s.line_end, array_to_string(string_split(f.text, chr(10))[greatest(s.line_start, 1):s.line_end], chr(10)) AS source FROM s JOIN files f ON f.project = s.project AND f.path = s.file_path""")
def s_line_slice(spark, sf_dir):
    s = table(spark, sf_dir, "code_snippets").where("found and qualified_name <> file_path and line_start is not null and line_end >= line_start").select("project", "qualified_name", F.col("file_path").alias("path"), "line_start", "line_end").distinct()
    j = s.join(scan_files(spark, sf_dir), ["project", "path"])
    return j.select("project", "qualified_name", "line_start", "line_end", names.line_slice(F.col("text"), F.col("line_start"), F.col("line_end")).alias("source"))


@query(f"""WITH {_FILES}, l AS (SELECT project, path, string_split(regexp_replace(text, '\\r', '', 'g'), chr(10)) AS lines FROM files)
SELECT project, path, i AS line, lines[i] AS content FROM l, unnest(generate_series(1, len(lines))) AS t(i) WHERE regexp_matches(lines[i], 'TODO|FIXME')""")
def s_text_grep(spark, sf_dir):
    rows = scan.grep(scan_files(spark, sf_dir).withColumn("text", F.regexp_replace("text", "\r", "")), "text", "TODO|FIXME", "project", "path")
    return rows.withColumn("line", F.col("line").cast("long"))


@query()
def x_comment_lines(spark, sf_dir):
    return facts(scan_files(spark, sf_dir)).where("kind = 'comment'").select("project", "path", "start_line", "text")


@query()
def i_extract_facts(spark, sf_dir):
    return facts(scan_files(spark, sf_dir)).where("kind not in ('comment', 'literal')").groupBy("project", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_FILES}, new AS (SELECT project, path, sha256(text) AS h FROM files), old AS (SELECT project, file_path AS path, min(sha256(source_code)) AS h FROM code_snippets WHERE found AND qualified_name = file_path AND source_code IS NOT NULL AND retrieved_at < TIMESTAMP '2025-07-01' GROUP BY ALL)
SELECT coalesce(n.project, o.project) AS project, coalesce(n.path, o.path) AS path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change
FROM new n FULL OUTER JOIN old o ON o.project = n.project AND o.path = n.path""")
def j_hash_diff(spark, sf_dir):
    new = scan_files(spark, sf_dir).select("project", "path", F.sha2("text", 256).alias("sha256"))
    old = table(spark, sf_dir, "code_snippets").where("found and qualified_name = file_path and source_code is not null and retrieved_at < timestamp_ntz'2025-07-01'")
    old = old.groupBy("project", F.col("file_path").alias("path")).agg(F.min(F.sha2("source_code", 256)).alias("sha256"))
    return M.changes(old, new, ["project", "path"], "sha256")


@query("""SELECT DISTINCT project, label, key FROM nodes n WHERE file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vectors v WHERE v.project = n.project AND v.file_path = n.file_path)""")
def j_orphan_prune(spark, sf_dir):
    files = table(spark, sf_dir, "vectors").select("project", F.col("file_path").alias("path"))
    return M.prune(table(spark, sf_dir, "nodes"), files)


@query("""WITH cache AS (SELECT DISTINCT sha256(source_code) AS h FROM vectors WHERE embedding IS NOT NULL AND source_code IS NOT NULL), t AS (SELECT DISTINCT sha256(source_code) AS h FROM result_items WHERE source_code IS NOT NULL)
SELECT t.h AS sha256, c.h IS NOT NULL AS hit FROM t LEFT JOIN cache c USING (h)""")
def j_cache_split(spark, sf_dir):
    cache = table(spark, sf_dir, "vectors").where("embedding is not null and source_code is not null").groupBy(F.sha2("source_code", 256).alias("sha256")).agg(F.first("embedding").alias("vec"))
    texts = table(spark, sf_dir, "result_items").where("source_code is not null").select("source_code")
    hits, misses = S.split_by_cache(texts, cache, "source_code")
    return hits.select("sha256", F.lit(True).alias("hit")).distinct().union(misses.select("sha256", F.lit(False)))


@query("""WITH f AS (SELECT DISTINCT project, path FROM nodes WHERE label = 'Module' AND path IS NOT NULL), asked AS (SELECT project, path AS target, regexp_replace(regexp_replace(path, '^[^/]+/', ''), '\\.(tsx?|jsx?|mjs|py)$', '') AS import_path FROM f WHERE regexp_matches(path, '\\.(tsx?|jsx?|mjs|py)$') AND contains(path, '/')),
hit AS (SELECT a.project, a.import_path, f.path, row_number() OVER (PARTITION BY a.project, a.import_path ORDER BY array_position(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.py'], regexp_extract(f.path, '(\\.[a-z]+)$', 1)), f.path) AS r
 FROM (SELECT DISTINCT project, import_path FROM asked) a JOIN f ON f.project = a.project AND (ends_with(f.path, '/' || a.import_path || regexp_extract(f.path, '(\\.[a-z]+)$', 1))) AND regexp_matches(f.path, '\\.(tsx?|jsx?|mjs|py)$'))
SELECT project, import_path, path AS target FROM hit WHERE r = 1""")
def j_import_suffix_resolve(spark, sf_dir):
    f = _paths(spark, sf_dir)
    asked = f.where(F.col("path").rlike(r"/.*\.(?:tsx?|jsx?|mjs|py)$")).select("project", F.regexp_replace(F.regexp_replace("path", r"^[^/]+/", ""), r"\.(?:tsx?|jsx?|mjs|py)$", "").alias("import_path")).distinct()
    return R.suffix_resolve(asked, R.suffix_index(f)).where("target is not null").select("project", "import_path", "target")


_ALIASES = [("@/", True, "src/"), ("@lib/", True, "lib/"), ("src/", True, "source/"), ("src/cache/", True, "store/"), ("config", False, "config/index.ts")]


@query("""WITH a(prefix, is_glob, target) AS (VALUES ('@/', true, 'src/'), ('@lib/', true, 'lib/'), ('src/', true, 'source/'), ('src/cache/', true, 'store/'), ('config', false, 'config/index.ts')),
p AS (SELECT DISTINCT path FROM nodes WHERE label = 'Module' AND path IS NOT NULL),
h AS (SELECT path, CASE WHEN is_glob THEN target || substr(path, length(prefix) + 1) ELSE target END AS rewritten, row_number() OVER (PARTITION BY path ORDER BY length(prefix) DESC) AS r FROM p JOIN a ON (is_glob AND starts_with(path, prefix)) OR path = prefix)
SELECT p.path AS import_path, h.rewritten FROM p LEFT JOIN h ON h.path = p.path AND r = 1""")
def j_alias_longest_prefix(spark, sf_dir):
    aliases = spark.createDataFrame(_ALIASES, "prefix string, is_glob boolean, target string")
    return R.alias_rewrite(_paths(spark, sf_dir).select(F.col("path").alias("import_path")).distinct(), aliases)


def _edges_of(files):
    from graphlode.operators.index import graph_of, imports_of, nodes_of, symbols_of
    from graphlode.plans.session import stage

    files = stage(files)
    found = stage(facts(files))
    symbols = symbols_of(nodes_of(found).select("project", "label", "key"))
    imports = stage(imports_of(found, files.select("project", "path")))
    return graph_of(found, imports, symbols)[1]


@query()
def j_call_cascade(spark, sf_dir):
    """Resolved calls of all whole files, by confidence."""
    edges = _edges_of(scan_files(spark, sf_dir))
    return edges.groupBy("rel_type", "confidence").agg(F.count("*").alias("n"))


_SOURCES = {
    "src/app.ts": "import { Session } from './session';\nimport { make } from './make';\nexport class App extends Base<Session> implements Runs {\n  constructor(private session: Session) {}\n  auth() { this.session.registry.store.login(); this.help(); }\n  help() { const s = make(); s.open(); }\n}\nexport class Base<T> { shut() {} }\nexport interface Runs { auth(): void }\nexport const add = (a: number) => { return twice(a); };\nfunction twice(n: number) { return n * 2; }\n",
    "src/session.ts": "export class Session {\n  registry: Registry;\n  open(): void {}\n}\nexport class Registry { store: Store; }\nexport class Store { login(): boolean { return true; } }\n",
    "src/make.ts": "import { Session } from './session';\nexport function make(): Session { return new Session(); }\n",
    "src/tool.py": "from src.lib import clean\n\nclass Tool:\n    def run(self, x):\n        self.check(x)\n        return clean(x)\n\n    def check(self, x):\n        return x\n\ndef main():\n    t = Tool()\n    t.run(1)\n",
    "src/lib.py": "def clean(x):\n    return str(x)\n", "main.go": "package main\ntype T struct{}\nfunc (t *T) Run(a int) int { return add(a, 1) }\nfunc add(a, b int) int { return a + b }\n",
    "lib.rs": "pub struct A;\nimpl A {\n  pub fn x(&self) -> u32 { helper() }\n}\nfn helper() -> u32 { 1 }\n", "A.java": "public class A {\n  public int run(int k) { return help(k); }\n  int help(int k) { return k; }\n}\n",
}


def _sources(spark):
    return spark.createDataFrame([("demo", p, t) for p, t in _SOURCES.items()], "project string, path string, text string")


@query("""SELECT caller, callee, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('src/app.ts:App.auth', 'src/session.ts:Store.login', 0.9), ('src/app.ts:App.auth', 'src/app.ts:App.help', 1.0), ('src/app.ts:App.help', 'src/make.ts:make', 1.0), ('src/app.ts:App.help', 'src/session.ts:Session.open', 1.0), ('src/app.ts:add', 'src/app.ts:twice', 1.0),
('src/tool.py:Tool.run', 'src/tool.py:Tool.check', 1.0), ('src/tool.py:Tool.run', 'src/lib.py:clean', 1.0), ('src/tool.py:main', 'src/tool.py:Tool.run', 1.0), ('main.go:T.Run', 'main.go:add', 1.0), ('lib.rs:A.x', 'lib.rs:helper', 1.0), ('A.java:A.run', 'A.java:A.help', 1.0)) t(caller, callee, confidence)""")
def j_calls_fixed(spark, sf_dir):
    """Calls of a small tree in six languages, resolved; the SQL has the expected rows."""
    return _edges_of(_sources(spark)).where("rel_type = 'CALLS'").select(F.col("src_key").alias("caller"), F.col("dst_key").alias("callee"), "confidence")


@query("""SELECT * FROM (VALUES ('class', 'src/app.ts:App'), ('class', 'src/app.ts:Base'), ('interface', 'src/app.ts:Runs'), ('method', 'src/app.ts:App.constructor'), ('method', 'src/app.ts:App.auth'), ('method', 'src/app.ts:App.help'), ('method', 'src/app.ts:Base.shut'), ('method', 'src/app.ts:Runs.auth'),
('function', 'src/app.ts:add'), ('function', 'src/app.ts:twice'), ('class', 'src/session.ts:Session'), ('class', 'src/session.ts:Registry'), ('class', 'src/session.ts:Store'), ('method', 'src/session.ts:Session.open'), ('method', 'src/session.ts:Store.login'), ('function', 'src/make.ts:make'),
('class', 'src/tool.py:Tool'), ('method', 'src/tool.py:Tool.run'), ('method', 'src/tool.py:Tool.check'), ('function', 'src/tool.py:main'), ('function', 'src/lib.py:clean'), ('class', 'main.go:T'), ('method', 'main.go:T.Run'), ('function', 'main.go:add'), ('class', 'lib.rs:A'), ('method', 'lib.rs:A.x'), ('function', 'lib.rs:helper'),
('class', 'A.java:A'), ('method', 'A.java:A.run'), ('method', 'A.java:A.help'), ('base', 'src/app.ts:App'), ('implements', 'src/app.ts:App')) t(kind, qn)""")
def i_facts_fixed(spark, sf_dir):
    """Definitions, bases and interfaces of a small tree; the SQL has the expected rows."""
    return facts(_sources(spark)).where("kind in ('class', 'interface', 'method', 'function', 'base', 'implements')").select("kind", "qn")


@query("""SELECT project, sum(CASE WHEN starts_with(file_path, 'src/') THEN 1 ELSE 0 END) AS in_src, count(DISTINCT regexp_extract(file_path, '^([^/]+)', 1)) AS tops FROM (SELECT DISTINCT project, file_path FROM nodes WHERE label = 'Module' AND file_path IS NOT NULL) GROUP BY project""")
def s_structure(spark, sf_dir):
    dirs, contains = scan.structure(_paths(spark, sf_dir))
    top = contains.where("src_label = 'Project' and rel_type like 'CONTAINS_FOLDER'").groupBy("project").agg(F.count("*").alias("tops"))
    inside = _paths(spark, sf_dir).groupBy("project").agg(F.sum(F.when(F.col("path").startswith("src/"), 1).otherwise(0)).alias("in_src"))
    return inside.join(top, "project")


QUERIES, ORACLES = query.queries, query.oracles
