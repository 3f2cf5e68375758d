"""Resolution of imports and calls as joins. First-match cascades are one left join per rule and a choice by rank."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlode.functions import names
from graphlode.plans.session import cut, stage

SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".py")


# -- import paths ----------------------------------------------------------------------------------------------
def suffix_index(files: DataFrame) -> DataFrame:
    """(project, suffix, folded, path, rank): every trailing part of each source path; rank is the path's place."""
    ranked = files.select("project", "path").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy("path")))
    wide = ranked.select("project", "path", "rank", F.explode(names.suffixes(F.col("path"))).alias("suffix"))
    return wide.withColumn("folded", F.lower("suffix"))


def suffix_resolve(imports: DataFrame, index: DataFrame) -> DataFrame:
    """imports (project, import_path) with the column target: the indexed path that an import means, or null.

    The import's own suffixes are tried from the longest; for each the source extensions, then /index with them, then the
    bare path; an exact hit before one without case, the first indexed path before later ones.
    """
    asked = imports.select("project", "import_path").distinct()
    clean = F.regexp_replace(F.regexp_replace("import_path", r"^(?:\./|\.\./|@/|~/)+", ""), r"\.(?:tsx?|jsx?|mjs|py)$", "")
    parts = asked.select("project", "import_path", F.posexplode(names.suffixes(clean)).alias("cut", "part"))
    endings = [(e, i) for i, e in enumerate([*SOURCE_EXTENSIONS, *[f"/index{e}" for e in SOURCE_EXTENSIONS], ""])]
    tries = parts.select("project", "import_path", "cut", F.explode(F.array(*[F.struct(F.concat("part", F.lit(e)).alias("suffix"), F.lit(i).alias("ending")) for e, i in endings])).alias("t"))
    tries = tries.select("project", "import_path", "cut", F.col("t.ending").alias("ending"), F.col("t.suffix").alias("wanted"), F.lower("t.suffix").alias("folded"))
    hit = tries.join(index, ["project", "folded"])
    best = hit.groupBy("project", "import_path").agg(F.min(F.struct("cut", "ending", (F.col("wanted") != F.col("suffix")).alias("inexact"), "rank", "path"))["path"].alias("target"))
    return imports.join(best, ["project", "import_path"], "left")


def alias_rewrite(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports with the column rewritten: by the longest alias prefix (or exact alias) that fits, else null.

    aliases has prefix, is_glob and target. An import is looked up by its own prefixes, so the join is on equality.
    """
    asked = imports.select("import_path").distinct()
    cuts = asked.select("import_path", F.explode(F.sequence(F.lit(0), F.length("import_path"))).alias("n")).select("import_path", "n", F.expr("substring(import_path, 1, n)").alias("prefix"))
    hit = cuts.join(aliases, "prefix").where(F.col("is_glob") | (F.col("n") == F.length("import_path")))
    new = F.when(F.col("is_glob"), F.concat("target", F.expr("substring(import_path, n + 1)"))).otherwise(F.col("target"))
    best = hit.groupBy("import_path").agg(F.max_by(new, F.struct("n", (~F.col("is_glob")).alias("exact"), "target")).alias("rewritten"))
    return imports.join(best, "import_path", "left")


def read_aliases(files: dict[str, str], start: str = "tsconfig.json") -> list[tuple[str, bool, str]]:
    """(prefix, is_glob, target) of a configuration's ``paths``, along its extends chain; the first file with paths wins.

    files maps relative paths to texts; comments and trailing commas are allowed in them.
    """
    seen: set[str] = set()
    path: str | None = start
    while path and path in files and path not in seen:
        seen.add(path)
        try:
            text = re.sub(r'("(?:[^"\\]|\\.)*")|/\*[\s\S]*?\*/|//[^\n]*', lambda m: m[1] or "", files[path])
            data = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
        except ValueError:
            return []
        options = data.get("compilerOptions") or {}
        folder = posixpath.dirname(path)
        if options.get("paths"):
            base = posixpath.normpath(posixpath.join(folder, options.get("baseUrl", ".")))
            out = []
            for alias, targets in options["paths"].items():
                if targets:
                    target = posixpath.normpath(posixpath.join(base, targets[0].rstrip("*")))
                    glob = alias.endswith("*")
                    target = "" if target == "." else target
                    out.append((alias.rstrip("*"), glob, target + "/" if glob and target and targets[0].rstrip("*").endswith("/") else target))
            return sorted(out, key=lambda a: -len(a[0]))
        parent = data.get("extends")
        if not isinstance(parent, str) or not parent.startswith("."):
            return []
        path = posixpath.normpath(posixpath.join(folder, parent))
        path = path if path.endswith(".json") else f"{path}.json"
    return []


def workspace_packages(files: dict[str, str]) -> list[tuple[str, str, str]]:
    """(package, subpath, target file) of a monorepo's members: npm and yarn workspaces, yarn's object form, pnpm's yaml."""
    patterns: list[str] = []
    try:
        work = json.loads(files.get("package.json", "{}")).get("workspaces") or []
        patterns += work.get("packages", []) if isinstance(work, dict) else work
    except ValueError:
        pass
    patterns += re.findall(r"^\s*-\s*['\"]?([^'\"\n#]+?)['\"]?\s*$", files.get("pnpm-workspace.yaml", ""), re.MULTILINE)
    out = []
    for path, text in files.items():
        folder = posixpath.dirname(path)
        if posixpath.basename(path) != "package.json" or not folder:
            continue
        if not any(re.fullmatch(re.escape(p.rstrip("/")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*"), folder) for p in patterns if not p.startswith("!")):
            continue
        try:
            data = json.loads(text)
        except ValueError:
            continue
        name = data.get("name")
        if not name:
            continue
        exports = data.get("exports")
        table = exports if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else {".": exports} if exports else {}
        entries = {k: _target(v) for k, v in table.items()}
        main = entries.get(".") or data.get("source") or data.get("module") or data.get("main") or "src/index.ts"
        out.append((name, "", _source(folder, main)))
        out += [(name, k[2:], _source(folder, v)) for k, v in entries.items() if k.startswith("./") and v and "*" not in k]
    return out


def _target(value: object) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return next((t for k in ("source", "types", "import", "default", "require") if (t := _target(value.get(k)))), None)
    return None


def _source(folder: str, target: str) -> str:
    """A built file stands for its source: dist and lib become src, .js and .d.ts become .ts."""
    path = re.sub(r"^(?:\./)?(?:dist|lib|build)/", "src/", target)
    path = re.sub(r"(?:\.d)?\.(?:js|mjs|cjs|ts)$", ".ts", path)
    return posixpath.normpath(posixpath.join(folder, path))


def workspace_resolve(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """imports with the column target: the whole package, its exported subpath, or the raw subpath in its folder.

    packages has package, subpath, target; the main entry has an empty subpath.
    """
    asked = imports.select("import_path").distinct()
    scoped = F.col("import_path").startswith("@")
    n = F.when(scoped, 2).otherwise(1)
    parts = F.split("import_path", "/")
    keyed = asked.withColumn("package", F.array_join(F.slice(parts, F.lit(1), n), "/")).withColumn("subpath", F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts), F.lit(1))), "/"))
    exact = keyed.join(packages.withColumnRenamed("target", "exact"), ["package", "subpath"], "left")
    main = packages.where("subpath = ''").select("package", F.regexp_replace("target", r"(?:/src)?/[^/]*$", "").alias("folder"))
    found = exact.join(main, "package", "left").select("import_path", F.coalesce("exact", F.when(F.col("subpath") != "", F.concat_ws("/", F.col("folder"), F.col("subpath")))).alias("target"))
    found = found.where(F.col("target").isNotNull())
    return imports.join(found, "import_path", "left")


def resolve_js(imports: DataFrame, files: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """imports (project, module, import_path) with the column target: alias, workspace, relative path, then suffix."""
    step = alias_rewrite(imports, aliases)
    step = workspace_resolve(step, packages).withColumnRenamed("target", "_workspace")
    relative = F.when(F.col("import_path").rlike(r"^\.\.?(?:/|$)"), names.resolve_relative(names.dirname(F.col("module")), F.col("import_path")))
    step = step.withColumn("_path", F.coalesce("rewritten", "_workspace", relative, "import_path"))
    found = suffix_resolve(step.select("project", F.col("_path").alias("import_path")).distinct(), suffix_index(files))
    return step.join(found.withColumnRenamed("import_path", "_path"), ["project", "_path"], "left").select(*imports.columns, "target")


def python_module_path(dotted: Column) -> Column:
    """a.b.c as the paths a/b/c.py and a/b/c/__init__.py that it may mean."""
    base = F.translate(dotted, ".", "/")
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


# -- symbols and calls -----------------------------------------------------------------------------------------
def symbol_suffixes(symbols: DataFrame) -> DataFrame:
    """(project, suffix, qn, label): each dotted end of a symbol's local name, so that suffix search is an equality join."""
    local = F.coalesce(names.qn_local(F.col("qn")), F.col("qn"))
    return symbols.select("project", "qn", "label", F.explode(names.suffixes(local, ".")).alias("suffix"))


def find_prefix(symbols: DataFrame, prefix: str) -> DataFrame:
    return symbols.where((F.col("qn") == prefix) | F.col("qn").startswith(prefix + ".") | F.col("qn").startswith(prefix + ":"))


def find_suffix(symbols: DataFrame, suffix: str) -> DataFrame:
    return symbols.where((F.col("qn") == suffix) | F.col("qn").endswith("." + suffix) | F.col("qn").endswith(":" + suffix))


def find_prefix_and_suffix(symbols: DataFrame, prefix: str, suffix: str) -> DataFrame:
    return find_suffix(find_prefix(symbols, prefix), suffix)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, fields: DataFrame | None = None, bases: DataFrame | None = None, variables: DataFrame | None = None) -> DataFrame:
    """(project, caller, module, callee_text, target, label, confidence): calls with the symbol they mean.

    calls has project, caller, module (file path), class_name (null outside one) and callee_text. symbols has project, qn,
    label and name. imports has project, module, local_name and target (a qualified name or a module path; '*' as
    local_name is a wildcard). fields (project, class_name, field, type), bases (project, class_name, base) and variables
    (project, caller, variable, type) are optional. Rules in order, the first hit wins:

    one part: own module 1.0; method of the current class 1.0; import target 1.0; import of unknown target: the only
    symbol of that name in the same top directory 0.6, else no edge; wildcard import 1.0. More parts: typed fields from
    this or a variable 0.9; typed receiver 1.0; imported receiver 1.0 or 0.6, else no edge; own or inherited method by
    this 1.0; class of the same file 1.0. Classes are no targets of calls.
    """
    parts = F.split("callee_text", r"[.]")
    c = calls.withColumn("_id", F.xxhash64("project", "caller", "callee_text")).withColumn("_n", F.size(parts)).withColumn("_head", parts[0]).withColumn("_last", F.element_at(parts, -1)).withColumn("_parts", parts)
    rest = [x for x in c.columns if x not in ("project", "caller", "callee_text")]
    c = c.groupBy("project", "caller", "callee_text").agg(F.min(F.struct(*rest)).alias("_c")).select("project", "caller", "callee_text", "_c.*")
    c, symbols = stage(c), stage(symbols)  # read by every rule
    top = lambda p: F.substring_index(p, "/", 1)
    known = symbols.groupBy("project", "qn").agg(F.min("label").alias("label"))
    own_this = F.col("_head").isin("this", "self", "cls")

    def hit(rows: DataFrame, wanted: Column, rank: int, confidence: float) -> DataFrame:
        asked = rows.withColumn("qn", wanted).where("qn is not null")
        return asked.join(known, ["project", "qn"]).select("project", "_id", F.lit(rank).alias("rank"), "qn", "label", F.lit(confidence).alias("confidence"))

    module_path = F.col("module")
    one, many = c.where("_n = 1"), c.where("_n > 1")
    found = [
        hit(one, names.build_qn(module_path, F.col("_head")), 1, 1.0),
        hit(one.where("class_name is not null"), names.build_qn(module_path, F.concat_ws(".", "class_name", "_head")), 2, 1.0),
    ]
    imp = imports.select("project", "module", F.col("local_name").alias("_head"), F.col("target").alias("_target"))
    brought = one.join(imp, ["project", "module", "_head"])
    found.append(hit(brought, F.col("_target"), 3, 1.0))
    found.append(hit(brought, names.build_qn(F.col("_target"), F.col("_head")), 3, 1.0))
    single = symbols.withColumn("top", top(names.qn_path(F.col("qn")))).withColumn("name", names.short_name(F.col("qn"))).groupBy("project", "top", "name").agg(F.count("*").alias("n"), F.min("qn").alias("only")).where("n = 1").drop("n")
    guess = lambda rows: rows.withColumn("top", top(F.col("module"))).withColumn("name", F.col("_last")).join(single, ["project", "top", "name"])
    found.append(hit(guess(brought), F.col("only"), 4, 0.6))
    stop = brought.select("project", "_id", F.lit(5).alias("rank"), F.lit(None).cast("string").alias("qn"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("confidence"))
    found.append(stop)
    wild = imports.where("local_name = '*'").select("project", "module", F.col("target").alias("_target"))
    found.append(hit(one.join(wild, ["project", "module"]), names.build_qn(F.col("_target"), F.col("_head")), 6, 1.0))

    suffix = symbol_suffixes(symbols).groupBy("project", "suffix").agg(F.min(F.struct("qn", "label")).alias("s")).select("project", "suffix", "s.*")

    def by_type(rows: DataFrame, kind: Column, rank: int, confidence: float) -> DataFrame:
        asked = rows.withColumn("suffix", F.concat_ws(".", kind, F.col("_last"))).where(kind.isNotNull())
        return asked.join(suffix, ["project", "suffix"]).select("project", "_id", F.lit(rank).alias("rank"), "qn", "label", F.lit(confidence).alias("confidence"))

    def typed(rows: DataFrame) -> DataFrame:
        """With the type of the variable that a call begins with: the caller's own, else its module's."""
        v = variables.select("project", "caller", F.col("variable").alias("_head"), F.col("type").alias("_mine"))
        top_ = v.select("project", F.col("caller").alias("module"), "_head", F.col("_mine").alias("_top"))
        return rows.join(v, ["project", "caller", "_head"], "left").join(top_, ["project", "module", "_head"], "left").withColumn("_vtype", F.coalesce("_mine", "_top")).drop("_mine", "_top")

    if fields is not None:
        start = many.where("_n > 2").withColumn("_type", F.when(own_this, F.col("class_name")))
        if variables is not None:
            start = typed(start).withColumn("_type", F.coalesce("_type", "_vtype")).drop("_vtype")
        if "module" not in fields.columns:
            fields = fields.withColumn("module", F.lit(None).cast("string"))
        # the class of the same module first; of several classes of one name elsewhere the one of the least module
        own = fields.where("module is not null").groupBy("project", "module", F.col("class_name").alias("_type"), F.col("field").alias("_field")).agg(F.min("type").alias("_own"))
        any_ = fields.groupBy("project", F.col("class_name").alias("_type"), F.col("field").alias("_field")).agg(F.min(F.struct("module", "type"))["type"].alias("_any"))
        walked = cut(start.where("_type is not null").withColumn("_at", F.lit(1)))
        while not walked.isEmpty():  # a field a round, until the longest chain is at its end
            step = walked.where(F.col("_at") < F.col("_n") - 1).withColumn("_field", F.col("_parts")[F.col("_at")])
            step = step.join(any_, ["project", "_type", "_field"]).join(own, ["project", "module", "_type", "_field"], "left")
            step = cut(step.withColumn("_type", F.coalesce("_own", "_any")).withColumn("_at", F.col("_at") + 1).select(*walked.columns))
            found.append(by_type(step.where(F.col("_at") == F.col("_n") - 1), F.col("_type"), 7, 0.9))
            walked = step
    if variables is not None:
        found.append(by_type(typed(many.where("_n = 2")).where("_vtype is not null"), F.col("_vtype"), 8, 1.0))
    received = many.where(~own_this).join(imp, ["project", "module", "_head"])
    rest = F.array_join(F.slice("_parts", 2, F.size("_parts")), ".")
    found.append(hit(received, names.build_qn(F.col("_target"), rest), 9, 1.0))
    found.append(hit(received, F.concat_ws(".", F.col("_target"), rest), 9, 1.0))
    found.append(hit(guess(received), F.col("only"), 10, 0.6))
    found.append(received.select("project", "_id", F.lit(11).alias("rank"), F.lit(None).cast("string").alias("qn"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("confidence")))
    mine = many.where(own_this & (F.col("_n") == 2) & F.col("class_name").isNotNull())
    found.append(hit(mine, names.build_qn(module_path, F.concat_ws(".", "class_name", "_last")), 12, 1.0))
    if bases is not None:
        b = bases.select("project", "class_name", "base")
        found.append(by_type(mine.join(b, ["project", "class_name"]), names.short_name(F.col("base")), 13, 1.0))
    found.append(hit(many.where(~own_this & (F.col("_n") == 2)), names.build_qn(module_path, F.concat_ws(".", "_head", "_last")), 14, 1.0))

    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    best = every.groupBy("project", "_id").agg(F.min(F.struct("rank", "qn", "label", "confidence")).alias("b"))
    out = c.join(best, ["project", "_id"]).where(F.col("b.qn").isNotNull() & F.col("b.label").isin("Function", "Method"))
    return out.select("project", "caller", "module", "callee_text", F.col("b.qn").alias("target"), F.col("b.label").alias("label"), F.col("b.confidence").alias("confidence"))


def resolve_bases(bases: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, module, class_name, base, target): a base by import, then in the same file, else its bare name."""
    i = imports.select("project", "module", F.col("local_name").alias("base"), F.col("target").alias("_imported"))
    known = symbols.select("project", F.col("qn").alias("_local"), F.lit(True).alias("_there")).distinct()
    step = bases.join(i, ["project", "module", "base"], "left").withColumn("_local", names.build_qn(F.col("module"), F.col("base"))).join(known, ["project", "_local"], "left")
    return step.select("project", "module", "class_name", "base", F.coalesce("_imported", F.when(F.col("_there"), F.col("_local")), "base").alias("target"))


def resolve_interfaces(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project, implementer, target): deferred implementations by the interface's name, each pair once."""
    wanted = pending.select("project", "implementer", F.col("interface").alias("suffix")).distinct()
    faces = symbol_suffixes(symbols.where("label = 'Interface'")).groupBy("project", "suffix").agg(F.min("qn").alias("target"))
    return wanted.join(faces, ["project", "suffix"]).select("project", "implementer", "target")
