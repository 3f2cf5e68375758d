"""Reading source trees and text tables: files, ignore rules, languages, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.functions import names

# Directory names that are never indexed.
IGNORED = (
    ".cache", ".claude", ".eclipse", ".eggs", ".env", ".git", ".gradle", ".hg", ".idea", ".maven", ".mypy_cache", ".nox", ".npm", ".nyc_output", ".pnpm-store", ".pytest_cache",
    ".qdrant_code_embeddings", ".ruff_cache", ".svn", ".tmp", ".tox", ".venv", ".vs", ".vscode", ".yarn", "__pycache__", "bin", "bower_components", "build", "coverage", "dist", "env", "htmlcov",
    "node_modules", "obj", "out", "Pods", "site-packages", "target", "temp", "tmp", "vendor", "venv",
)
# Suffixes of files that are never indexed, and of binary files.
IGNORED_SUFFIXES = (".tmp", "~", ".pyc", ".pyo", ".o", ".a", ".so", ".dll", ".class")
BINARY = (".pdf", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".tiff", ".webp")
# Languages by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".rs": "rust", ".go": "go", ".java": "java",
    ".scala": "scala", ".sc": "scala", ".c": "c", ".cpp": "cpp", ".h": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hxx": "cpp", ".hh": "cpp", ".ixx": "cpp", ".cppm": "cpp", ".ccm": "cpp",
    ".cs": "csharp", ".php": "php", ".lua": "lua",
}
#: A directory that holds one of these files is a package.
PACKAGE_FILES = ("package.json", "__init__.py", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "composer.json", "CMakeLists.txt", "setup.py", "pyproject.toml")


def skipped(path: Column, exclude: tuple[str, ...] = (), unignore: tuple[str, ...] = ()) -> Column:
    """Whether a relative path is left out: an unignored prefix wins, then ignored segments, then exclusions.

    An exclusion is a path prefix or the name of a segment.
    """
    p = names.normal_path(path)
    parts = F.split(p, "/")
    below = lambda prefix: (p == prefix) | p.startswith(prefix.rstrip("/") + "/")
    kept = names.any_of([below(u) for u in unignore])
    hit = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED])) | F.exists(parts, lambda x: x.endswith(".egg-info"))
    out = names.any_of([below(e) | F.array_contains(parts, e) for e in exclude])
    return ~kept & (hit | out)


def keeps_directory(name: str, prefix: str, unignore: tuple[str, ...] = ()) -> bool:
    """Whether a walk enters a directory: not an ignored one, unless something unignored lies on, below or above it."""
    path = f"{prefix}/{name}" if prefix else name
    wanted = any(u == path or u.startswith(path + "/") or path.startswith(u.rstrip("/") + "/") for u in unignore)
    return wanted or not (name in IGNORED or name.endswith(".egg-info"))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.create_map(*pairs)[F.lower(names.extension(path))]


def read_tree(spark: SparkSession, root: str, project: str, exclude: tuple[str, ...] = (), unignore: tuple[str, ...] = ()) -> DataFrame:
    """(project, path, content, text, sha256, language) of the files under a root, or of one file.

    Paths are relative to the root. Ignored folders are not entered while folders are listed, so nothing in them is read.
    """
    folders = kept_folders(spark, root, unignore)
    files = spark.read.format("binaryFile").load(folders)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    full = F.regexp_replace("path", r"^\w+:/+", "/")
    relative = F.when(full == base, names.basename(full)).otherwise(F.expr("substring(full, length(base) + 2)"))
    rows = files.withColumn("full", full).withColumn("base", base).withColumn("relative", relative)
    rows = rows.where(~skipped(F.col("relative"), exclude, unignore)).where(~names.any_of([F.lower("relative").endswith(s) for s in (*IGNORED_SUFFIXES, *BINARY)]))
    return rows.select(
        F.lit(project).alias("project"), F.col("relative").alias("path"), "content", names.decode(F.col("content")).alias("text"), F.sha2("content", 256).alias("sha256"), language(F.col("relative")).alias("language")
    )


def kept_folders(spark: SparkSession, root: str, unignore: tuple[str, ...] = ()) -> list[str]:
    """The folders below a root, with it, that a walk enters (the root itself if it is a file)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.getFileStatus(path).isDirectory():
        return [root]
    out, todo = [], [("", path)]
    while todo:
        prefix, folder = todo.pop()
        entries = fs.listStatus(folder)
        if any(not e.isDirectory() for e in entries):
            out.append(folder.toString())
        for e in entries:
            name = e.getPath().getName()
            if e.isDirectory() and keeps_directory(name, prefix, unignore):
                todo.append((f"{prefix}/{name}" if prefix else name, e.getPath()))
    return out or [root]


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directories (project, path, label, key, name), contains (project, rel_type, src_label, src_key, dst_label, dst_key)).

    A directory with an indicator file is a Package, keyed by its dotted name, any other a Folder, keyed by its path.
    files has project and path.
    """
    parts = F.split("path", "/")
    up = files.select("project", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir")).where("dir <> ''")
    indicators = files.where(names.basename(F.col("path")).isin(*PACKAGE_FILES) | F.col("path").endswith(".csproj")).select("project", names.dirname(F.col("path")).alias("dir")).distinct().withColumn("package", F.lit(True))
    dirs = up.select("project", "dir").distinct().join(indicators, ["project", "dir"], "left")
    key = F.when(F.col("package"), F.concat_ws(".", "project", F.translate("dir", "/", "."))).otherwise(F.col("dir"))
    label = F.when(F.col("package"), F.lit("Package")).otherwise(F.lit("Folder"))
    dirs = dirs.select("project", F.col("dir").alias("path"), label.alias("label"), key.alias("key"), names.basename(F.col("dir")).alias("name"))
    parent = dirs.select("project", F.col("path").alias("parent"), F.col("label").alias("src_label"), F.col("key").alias("src_key"))

    def under(children: DataFrame, rel: Column | str) -> DataFrame:
        joined = children.withColumn("parent", names.dirname(F.col("path"))).join(parent, ["project", "parent"], "left")
        kind = rel if isinstance(rel, Column) else F.lit(rel)
        return joined.select("project", kind.alias("rel_type"), F.coalesce("src_label", F.lit("Project")).alias("src_label"), F.coalesce("src_key", F.col("project")).alias("src_key"), F.col("label").alias("dst_label"), F.col("key").alias("dst_key"))

    leaves = files.select("project", "path", F.lit("File").alias("label"), F.col("path").alias("key"))
    inner = under(dirs.select("project", "path", "label", "key"), F.when(F.col("label") == "Package", "CONTAINS_PACKAGE").otherwise("CONTAINS_FOLDER"))
    return dirs, inner.unionByName(under(leaves, "CONTAINS_FILE"))


def file_nodes(files: DataFrame) -> DataFrame:
    return files.select("project", F.lit("File").alias("label"), F.col("path").alias("key"), "path", names.basename(F.col("path")).alias("name"), names.extension(F.col("path")).alias("extension"), F.col("path").alias("file_path"))


def grep(df: DataFrame, text_col: str, pattern: str, *keep: str) -> DataFrame:
    """(*keep, line, content): the lines of texts that match a regular expression, from 1."""
    lines = df.where(F.col(text_col).rlike(pattern)).select(*keep, F.posexplode(F.split(text_col, "\r?\n")).alias("_at", "content"))
    return lines.where(F.col("content").rlike(pattern)).select(*keep, (F.col("_at") + 1).alias("line"), "content")
