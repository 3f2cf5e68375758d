"""The indexer: scan, hash and diff, extract, resolve, upsert, prune, commit. Every step is a DataFrame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.functions import names
from graphlode.model import NODE_KEY
from graphlode.operators import graph as G
from graphlode.operators import mutate, resolve
from graphlode.operators import similarity as S
from graphlode.operators.graph import Graph
from graphlode.plans.session import ship, stage
from graphlode.sources import manifests, scan
from graphlode.sources.extract import facts
from graphlode.sources.store import Store

_LABEL = {"module": "Module", "class": "Class", "interface": "Interface", "enum": "Enum", "function": "Function", "method": "Method", "comment": "Comment", "literal": "Literal", "builtin": "Builtin"}


def nodes_of(found: DataFrame) -> DataFrame:
    """Node rows of the facts."""
    label = F.create_map(*[F.lit(x) for p in _LABEL.items() for x in p])[F.col("kind")]
    rows = found.withColumn("label", label).where("label is not null")
    textual = F.col("kind").isin("comment", "literal", "builtin")
    return rows.select(
        "project", "label", F.col("qn").alias("key"), F.xxhash64("project", "label", "qn").alias("node_id"), F.col("qn").alias("qualified_name"), "name", F.when(F.col("kind") == "module", F.col("path")).alias("path"), F.col("path").alias("file_path"),
        names.qn_local(F.col("qn")).alias("local_name"), names.extension(F.col("path")).alias("extension"), "start_line", "end_line", F.when(~textual & (F.col("kind") != "module"), F.col("parameters")).alias("parameters"),
        F.when(~textual & (F.col("kind") != "module"), F.col("decorators")).alias("decorators"), "docstring", F.when(~textual, F.col("exported")).alias("is_exported"), F.lit(False).alias("is_external"),
        F.when(textual, F.col("text")).alias("text"), F.when(textual, F.col("kind")).alias("kind"),
    ).dropDuplicates(list(NODE_KEY))


def containment(found: DataFrame) -> DataFrame:
    """DEFINES from modules and DEFINES_METHOD from classes."""
    tops = found.where(F.col("kind").isin("function", "class", "interface", "enum"))
    label = F.create_map(*[F.lit(x) for p in _LABEL.items() for x in p])[F.col("kind")]
    defines = tops.select("project", F.lit("DEFINES").alias("rel_type"), F.lit("Module").alias("src_label"), F.col("path").alias("src_key"), label.alias("dst_label"), F.col("qn").alias("dst_key"))
    owners = found.where(F.col("kind").isin("class", "interface", "enum")).select("project", "path", F.col("qn").alias("src_key"), label.alias("src_label")).dropDuplicates(["project", "src_key"])
    methods = found.where("kind = 'method'").select("project", F.col("qn").alias("dst_key"), names.build_qn(F.col("path"), F.col("owner")).alias("src_key"))
    inside = methods.join(owners.drop("path"), ["project", "src_key"]).select("project", F.lit("DEFINES_METHOD").alias("rel_type"), "src_label", "src_key", F.lit("Method").alias("dst_label"), "dst_key")
    return defines.unionByName(inside).distinct()


def imports_of(found: DataFrame, files: DataFrame, aliases: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(project, module, local_name, target, target_module): imports with the file they mean, if it is indexed."""
    spark = found.sparkSession
    aliases = aliases if aliases is not None else spark.createDataFrame([], "prefix string, is_glob boolean, target string")
    packages = packages if packages is not None else spark.createDataFrame([], "package string, subpath string, target string")
    raw = found.where("kind = 'import' and target is not null").select("project", F.col("path").alias("module"), F.col("name").alias("local_name"), "target")
    source = F.regexp_extract("target", r"^([^:]*)", 1)
    member = F.when(F.instr("target", ":") > 0, F.regexp_extract("target", r"^[^:]*:(.*)$", 1))
    raw = raw.withColumn("source", source).withColumn("member", F.nullif(member, F.lit("")))
    python = F.col("module").endswith(".py")
    dots = F.length(F.regexp_extract("source", r"^(\.*)", 1))
    # Python: leading dots are parent folders, other dots are folders
    up = F.when(dots > 0, F.array_join(F.slice(F.split("module", "/"), F.lit(1), F.greatest(F.size(F.split("module", "/")) - dots, F.lit(0))), "/"))
    as_path = F.when(python, F.concat_ws("/", F.nullif(up, F.lit("")), F.translate(F.regexp_replace("source", r"^\.+", ""), ".", "/"))).otherwise(F.regexp_replace(F.regexp_replace("source", r"^crate::", ""), r"::|(?<=\w)\.(?=\w)", "/"))
    js = F.col("module").rlike(r"\.(?:[jt]sx?|mjs)$")
    asked = raw.withColumn("import_path", F.when(js, F.col("source")).otherwise(as_path))
    scripts = resolve.resolve_js(asked.where(js).select("project", "module", "import_path").distinct(), files, aliases, packages)
    others = resolve.suffix_resolve(asked.where(~js).select("project", "module", "import_path").distinct(), resolve.suffix_index(files))
    found_module = scripts.unionByName(others.select("project", "module", "import_path", "target")).withColumnRenamed("target", "target_module")
    out = asked.join(found_module, ["project", "module", "import_path"], "left")
    base = F.coalesce("target_module", F.concat(F.lit("external/"), F.col("source")))
    plain = F.when(F.col("member").isin("default") | F.col("member").isNull(), base).otherwise(names.build_qn(base, F.col("member")))
    return out.select("project", "module", "local_name", plain.alias("target"), "target_module", "source").distinct()


#: Methods of a class that give one of its instances where nothing says what they return.
FACTORIES = ("create", "getInstance", "instance", "from", "of", "build", "new", "default")


def returned_types(found: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, caller, variable, start_line, type) of variables that are given what a call returns.

    The call is one of the same file, an imported function, a method of this or of a named class; a factory without a return
    type gives its class.
    """
    asked = found.where("kind = 'assigned'").select("project", F.col("owner").alias("caller"), F.col("path").alias("module"), F.nullif("text", F.lit("")).alias("class_name"), F.col("name").alias("variable"), "start_line", F.split("target", "[.]").alias("parts"))
    asked = asked.where(F.size("parts") <= 2).withColumn("head", F.col("parts")[0]).withColumn("last", F.element_at("parts", -1)).withColumn("several", F.size("parts") == 2)
    returns = found.where("kind = 'return'").groupBy("project", "qn").agg(F.min(names.simple_type(F.col("target"))).alias("type"))
    brought = imports.groupBy("project", "module", F.col("local_name").alias("head")).agg(F.min("target").alias("brought"))
    own = F.when(~F.col("several"), names.build_qn(F.col("module"), F.col("head"))).when(F.col("head").isin("this", "self"), names.build_qn(F.col("module"), F.concat_ws(".", "class_name", "last"))).otherwise(names.build_qn(F.col("module"), F.concat_ws(".", "head", "last")))
    away = F.when(F.col("several"), F.concat_ws(".", "brought", "last")).otherwise(F.col("brought"))
    step = asked.join(brought, ["project", "module", "head"], "left").withColumn("qn", own).withColumn("away", F.when(F.col("brought").isNotNull(), away))
    step = step.join(returns, ["project", "qn"], "left").join(returns.select("project", F.col("qn").alias("away"), F.col("type").alias("other")), ["project", "away"], "left")
    made = F.when(F.col("several") & F.col("head").rlike("^[A-Z]") & F.col("last").isin(*FACTORIES), F.col("head"))
    return step.select("project", "caller", "variable", "start_line", F.coalesce("type", "other", made).alias("type")).where("type is not null")


def graph_of(found: DataFrame, imports: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the facts; calls and bases are resolved against all symbols, also those of unchanged files."""
    nodes = nodes_of(found)
    external = imports.where("target_module is null").select(
        "project", F.lit("Module").alias("label"), F.concat(F.lit("external/"), F.col("source")).alias("key"), F.concat(F.lit("external/"), F.col("source")).alias("qualified_name"), F.col("source").alias("name"), F.lit(True).alias("is_external")
    ).distinct()
    nodes = nodes.unionByName(external.withColumn("node_id", F.xxhash64("project", "label", "key")), allowMissingColumns=True)
    imported = imports.select("project", F.lit("IMPORTS").alias("rel_type"), F.lit("Module").alias("src_label"), F.col("module").alias("src_key"), F.lit("Module").alias("dst_label"), F.coalesce("target_module", F.concat(F.lit("external/"), F.col("source"))).alias("dst_key")).distinct()
    calls = found.where("kind = 'call'").select("project", F.when(F.col("owner") == "", F.col("path")).otherwise(F.col("owner")).alias("caller"), F.col("path").alias("module"), F.nullif("text", F.lit("")).alias("class_name"), F.col("name").alias("callee_text")).distinct()
    fields = found.where("kind = 'field' and owner <> ''").select("project", F.col("owner").alias("class_name"), F.col("name").alias("field"), F.col("path").alias("module"), names.simple_type(F.col("target")).alias("type")).where("type is not null").distinct()
    variables = found.where("kind = 'variable' and owner <> ''").select("project", F.col("owner").alias("caller"), F.col("name").alias("variable"), "start_line", names.simple_type(F.col("target")).alias("type")).where("type is not null")
    variables = variables.unionByName(returned_types(found, imports))
    variables = variables.groupBy("project", "caller", "variable").agg(F.max(F.struct("start_line", "type"))["type"].alias("type"))
    bases = found.where("kind = 'base'").select("project", F.col("path").alias("module"), F.col("owner").alias("class_name"), F.col("name").alias("base")).distinct()
    resolved = resolve.resolve_bases(bases, imports, symbols)
    targets = resolve.resolve_calls(calls, symbols, imports.select("project", "module", "local_name", "target"), fields, resolved.select("project", "class_name", F.col("target").alias("base")), variables)
    own = symbols.select("project", F.col("qn").alias("caller"), F.col("label").alias("src_label"))
    called = targets.join(own, ["project", "caller"], "left").select("project", F.lit("CALLS").alias("rel_type"), F.coalesce("src_label", F.lit("Module")).alias("src_label"), F.col("caller").alias("src_key"), F.col("label").alias("dst_label"), F.col("target").alias("dst_key"), "confidence")
    called = called.groupBy("project", "rel_type", "src_label", "src_key", "dst_label", "dst_key").agg(F.max("confidence").alias("confidence"))
    labels = symbols.select("project", F.col("qn").alias("target"), F.col("label").alias("dst_label"))
    inherits = resolved.join(labels, ["project", "target"]).select("project", F.lit("INHERITS").alias("rel_type"), F.lit("Class").alias("src_label"), names.build_qn(F.col("module"), F.col("class_name")).alias("src_key"), "dst_label", F.col("target").alias("dst_key"))
    pending = found.where("kind = 'implements'").select("project", F.col("qn").alias("implementer"), F.col("name").alias("interface"))
    implements = resolve.resolve_interfaces(pending, symbols).select("project", F.lit("IMPLEMENTS").alias("rel_type"), F.lit("Class").alias("src_label"), F.col("implementer").alias("src_key"), F.lit("Interface").alias("dst_label"), F.col("target").alias("dst_key"))
    edges = containment(found)
    for e in (imported, called, inherits.distinct(), implements.distinct()):
        edges = edges.unionByName(e, allowMissingColumns=True)
    return nodes, edges


def symbols_of(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin("Function", "Method", "Class", "Interface", "Enum", "Type")).groupBy("project", F.col("key").alias("qn")).agg(F.min("label").alias("label"))


def path_configuration(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases (project, prefix, is_glob, target), packages (project, package, subpath, target)) of the projects' configuration files.

    A project's few configuration files are read together by one task.
    """
    base = names.basename(F.col("path"))
    wanted = base.rlike(r"^(?:[tj]sconfig.*\.json|package\.json|pnpm-workspace\.yaml)$") | F.col("path").rlike(r"(?:^|/)[^/]*tsconfig[^/]*\.json$|^base\.json$")
    texts = files.where(wanted & F.col("text").isNotNull()).select("project", "path", "text")
    ship(files.sparkSession)

    def read(table: pa.Table) -> pa.Table:
        project = table.column("project")[0].as_py()
        held = dict(zip(table.column("path").to_pylist(), table.column("text").to_pylist()))
        start = "tsconfig.json" if "tsconfig.json" in held else "jsconfig.json"
        rows = [(project, "alias", prefix, "", glob, target) for prefix, glob, target in resolve.read_aliases(held, start)]
        rows += [(project, "package", name, subpath, False, target) for name, subpath, target in resolve.workspace_packages(held)]
        kinds = [("project", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("subpath", pa.string()), ("is_glob", pa.bool_()), ("target", pa.string())]
        return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))

    found = stage(texts.groupBy("project").applyInArrow(read, "project string, kind string, name string, subpath string, is_glob boolean, target string"))
    aliases = found.where("kind = 'alias'").select("project", F.col("name").alias("prefix"), "is_glob", "target")
    return aliases, found.where("kind = 'package'").select("project", F.col("name").alias("package"), "subpath", "target")


def embedded(found: DataFrame, files: DataFrame, embed=S.hashed_embedding) -> DataFrame:
    """Vector rows of the functions, methods, classes and interfaces of the facts; the text is name, parameters, description and source."""
    symbols = found.where(F.col("kind").isin("function", "method", "class", "interface")).groupBy("project", "path", "qn").agg(F.min(F.struct("start_line", "end_line", "kind", "name", "parameters", "docstring")).alias("s")).select("project", "path", "qn", "s.*")
    rows = symbols.join(files.select("project", "path", "text"), ["project", "path"]).withColumn("source_code", names.line_slice(F.col("text"), F.col("start_line"), F.greatest("start_line", "end_line")))
    document = F.concat_ws("\n", "name", F.array_join("parameters", ", "), "docstring", "source_code")
    label = F.create_map(*[F.lit(x) for p in _LABEL.items() for x in p])[F.col("kind")]
    return rows.select(F.col("qn").alias("id"), embed(document).alias("embedding"), F.col("qn").alias("qualified_name"), F.col("path").alias("file_path"), "project", label.alias("node_type"), "source_code")


def derived(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the communities and processes of a graph, with MEMBER_OF and HAS_STEP."""
    assigned = G.directory_communities(g)
    communities = stage(G.materialise_communities(g, assigned))
    label = g.named("label")
    cid = F.concat(F.col("project"), F.lit("::community::"), F.col("community").cast("string"))
    member = assigned.select("project", "key", cid.alias("id")).join(communities.select("project", "id"), ["project", "id"], "left_semi").join(label, ["project", "key"])
    member = member.select("project", F.lit("MEMBER_OF").alias("rel_type"), F.col("label").alias("src_label"), F.col("key").alias("src_key"), F.lit("Community").alias("dst_label"), F.col("id").alias("dst_key"))
    found = stage(G.processes(g))
    step = G.steps(found).join(label, ["project", "key"])
    step = step.select("project", F.lit("HAS_STEP").alias("rel_type"), F.lit("Process").alias("src_label"), F.col("id").alias("src_key"), F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), F.col("step_index").cast("int").alias("step_index"))
    nodes = communities.select("project", F.lit("Community").alias("label"), F.col("id").alias("key"), "name", "heuristic_label", "symbol_count", "cohesion")
    flows = found.select("project", F.lit("Process").alias("label"), F.col("id").alias("key"), "name", F.col("entry").alias("entry_point_qn"), F.col("terminal").alias("terminal_qn"), F.col("steps").cast("int").alias("step_count"), "trace")
    nodes = nodes.unionByName(flows, allowMissingColumns=True).withColumn("node_id", F.xxhash64("project", "label", "key"))
    return nodes, member.unionByName(step, allowMissingColumns=True)


def _like(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(other.schema[c].dataType).alias(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns])


def index_project(store: Store, files: DataFrame, project: str, aliases: DataFrame | None = None, packages: DataFrame | None = None, embed=S.hashed_embedding) -> DataFrame:
    """Index the files of one project incrementally; (path, change) of what was found.

    files has project, path, text and sha256. Unchanged files keep their rows and vectors; changed ones lose them before the
    new ones come; rows of deleted files go. Calls of changed files are resolved against the whole symbol table; communities and
    processes are those of the whole new graph. Aliases and workspace packages come from the project's configuration files
    unless they are given. ``embed`` is a function of a text column (None: no vectors). Hashes are committed last.
    """
    files = stage(files.where(F.col("project") == project))
    store.recover(project)
    old = store.graph().scoped(project)
    old = Graph(stage(old.nodes), stage(old.edges))
    diff = stage(mutate.changes(store.hashes().where(F.col("project") == project), files, ["path"], "sha256"))
    work = files.join(diff.where(F.col("change").isin("new", "changed")).select("path"), "path", "left_semi")
    found = stage(facts(work))
    gone = diff.where("change <> 'unchanged'").select(F.col("path").alias("file_path"))
    dropped = old.nodes.join(gone, "file_path", "left_semi").select("project", "label", "key")
    kept = old.nodes.join(gone, "file_path", "left_anti")
    # edges that begin in a changed file are made again; edges into it stay if their target is still there
    kept_edges = old.edges.join(dropped.select("project", F.col("label").alias("src_label"), F.col("key").alias("src_key")), ["project", "src_label", "src_key"], "left_anti")
    symbols = stage(symbols_of(kept.select("project", "label", "key").unionByName(nodes_of(found).select("project", "label", "key"))))
    if aliases is None or packages is None:
        own_aliases, own_packages = path_configuration(files)
        aliases = aliases if aliases is not None else own_aliases.drop("project")
        packages = packages if packages is not None else own_packages.drop("project")
    imports = stage(imports_of(found, files.select("project", "path"), aliases, packages))
    nodes, edges = graph_of(found, imports, symbols)
    dirs, contains = scan.structure(files)
    layout = scan.file_nodes(files).unionByName(dirs.select("project", "label", "key", "path", "name", F.col("path").alias("file_path")), allowMissingColumns=True)
    layout = layout.unionByName(dirs.sparkSession.createDataFrame([(project, "Project", project, project)], "project string, label string, key string, name string"), allowMissingColumns=True)
    needs = manifests.dependency_edges(manifests.dependencies(files))
    packages_ = needs.select("project", F.lit("ExternalPackage").alias("label"), F.col("dst_key").alias("key"), F.col("dst_key").alias("name")).distinct()
    new_nodes = nodes.unionByName(layout, allowMissingColumns=True).unionByName(packages_, allowMissingColumns=True).dropDuplicates(list(NODE_KEY))
    base = kept.where(~F.col("label").isin("File", "Folder", "Package", "Project", "ExternalPackage", "Community", "Process"))
    shaped = new_nodes.select(*[F.col(c) if c in new_nodes.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    all_nodes = stage(mutate.upsert_nodes(base, shaped))
    fresh = edges.unionByName(contains, allowMissingColumns=True).unionByName(needs, allowMissingColumns=True)
    fresh = fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(kept_edges.schema[c].dataType).alias(c) for c in kept_edges.columns])
    structural = ["CONTAINS_FILE", "CONTAINS_FOLDER", "CONTAINS_PACKAGE", "DEPENDS_ON_EXTERNAL", "MEMBER_OF", "HAS_STEP"]
    all_edges = stage(mutate.with_endpoints(mutate.upsert_edges(kept_edges.where(~F.col("rel_type").isin(*structural)), fresh, all_nodes), all_nodes))
    more_nodes, more_edges = derived(Graph(all_nodes, all_edges))
    store.replace_project(project, mutate.append_nodes(all_nodes, more_nodes), all_edges.unionByName(_like(more_edges, all_edges)))
    if embed is not None:
        vectors = store.vectors().where(F.col("project") == project)
        kept_vectors = vectors.join(gone, "file_path", "left_anti").select(*vectors.columns)
        store.replace_vectors(project, kept_vectors.unionByName(_like(embedded(found, work, embed), vectors)))
    store.commit_hashes(project, files.select("project", "path", "sha256"))
    return diff


def index_tree(spark: SparkSession, store: Store, root: str, project: str, exclude: tuple[str, ...] = (), unignore: tuple[str, ...] = ()) -> DataFrame:
    files = scan.read_tree(spark, root, project, exclude, unignore).select("project", "path", "text", "sha256")
    return index_project(store, files, project)
